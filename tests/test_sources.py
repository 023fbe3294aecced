"""Logs, configuration, sidecars, bitstreams and scalars."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from camloom.functions import bitstream as B
from camloom.functions import scalars as S
from camloom.sources import eventlog as E
from camloom.sources import sinks

T0 = dt.datetime(2026, 5, 16, 23, 59, 59)


def log_rows(spark):
    rows = [(f"{k:026d}", f"cam{k % 2}", T0 + dt.timedelta(hours=6 * k), float(k)) for k in range(10)]
    return spark.createDataFrame(rows, "event_id string, camera string, ts timestamp, z_score double")


def test_log_round_trip_and_range(spark, tmp_path):
    E.append_log(log_rows(spark), f"{tmp_path}/log")
    E.append_log(log_rows(spark).limit(1).withColumn("event_id", F.lit("again")), f"{tmp_path}/log")
    everything = E.log_range(spark, f"{tmp_path}/log", limit=-1)
    assert everything.count() == 11
    some = E.log_range(spark, f"{tmp_path}/log", "2026-05-17 00:00:00", "2026-05-18 05:59:59", "cam1")
    assert [r.z_score for r in some.collect()] == [1.0, 3.0, 5.0]
    assert E.log_range(spark, f"{tmp_path}/log", limit=3).count() == 3
    assert E.log_range(spark, f"{tmp_path}/nothing").count() == 0
    plan = some._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(camera" in plan and "date" in plan.split("PartitionFilters")[1][:300]


def test_malformed_rows(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"event_id": "a", "z_score": 1.5, "unknown": 1}\n{broken\n\n{"event_id": "b"}\n')
    assert sorted(r.event_id for r in E.read_json(spark, f"{tmp_path}/x.jsonl", E.RAW_EVENT).collect()) == ["a", "b"]
    with pytest.raises(Exception, match="(?i)malformed"):
        E.read_json(spark, f"{tmp_path}/x.jsonl", E.RAW_EVENT, E.FAIL).collect()
    filled = E.with_defaults(E.read_json(spark, f"{tmp_path}/x.jsonl", E.RAW_EVENT)).where("event_id = 'b'").first()
    assert filled.reason == "" and filled.z_score == 0.0


def test_clip_files_and_sidecars(spark, tmp_path):
    (tmp_path / "cam1").mkdir()
    for name, n in (("a.ts", 3), ("b.mp4", 5), ("c.txt", 1)):
        (tmp_path / "cam1" / name).write_bytes(b"x" * n)
    (tmp_path / "cam1" / "a.ts.label.json").write_text(json.dumps({"label": "tp", "clip": "a.ts"}))
    (tmp_path / "cam1" / "b.mp4.label.json").write_text("{broken")
    files = E.clip_files(spark, str(tmp_path), (".ts", ".mp4"))
    assert sorted((r.camera, r.filename, r.size) for r in files.collect()) == [("cam1", "a.ts", 3), ("cam1", "b.mp4", 5)]
    labels = E.sidecars(spark, f"{tmp_path}/*/*.label.json", E.LABEL, ".label.json")
    assert sorted((r.clip_path.rpartition("/")[2], r.label) for r in labels.collect()) == [("a.ts", "tp"), ("b.mp4", None)]


def test_frame_fixture(spark, tmp_path):
    frames = [{"key_frame": 1, "pkt_size": "900", "pict_type": "I"}, {"key_frame": 0, "pkt_size": "35", "pict_type": "P"}]
    (tmp_path / "cam_fixture.json").write_text(json.dumps({"frames": frames}, indent=1))
    assert [tuple(r) for r in E.frame_fixture(spark, f"{tmp_path}/cam_fixture.json").orderBy("seq").collect()] == [("cam", 1, 900, True), ("cam", 2, 35, False)]


def test_camera_config(spark):
    good = '[[cameras]]\nname = "a"\nurl = "rtsp://x"\nmotion_z_high = 4\n[[cameras]]\nname = "b"\nurl = "u"\n'
    table = {r.camera: r for r in E.camera_config_table(spark, good).collect()}
    assert table["a"].motion_z_high == 4.0 and table["b"].off_threshold == 45
    for bad in ('[[cameras]]\nname = "a"\nurl = ""', '[[cameras]]\nname = "a"\nurl = "u"\nmotion_z_high = 150', '[[cameras]]\nname = "a"\nurl = "u"\non_threshold = 0', '[[cameras]]\nname="a"\nurl="u"\npre_roll_seconds=99'):
        with pytest.raises(ValueError):
            E.camera_config(bad)


def test_camera_config_of_named_tables():
    good = '[mqtt]\nqos = 2\n[recording]\ncontainer = "fmp4"\n[cameras.a]\nurl = "u"\ntransport = "udp"\nbuffer_frames = 500\npre_roll_seconds = 99\n[cameras.b]\nurl = "v"\ncodec_hint = "h265"\n'
    assert [c["camera"] for c in E.camera_config(good)] == ["a", "b"]
    for bad, why in (
        ("[mqtt]\nqos = 3\n", "mqtt.qos"), ('[recording]\ncontainer = "avi"\n', "recording.container"), ('[recording]\nfsync_policy = "x"\n', "fsync_policy"), ('[runtime]\nlog_level = "loud"\n', "log_level"),
        ('[cameras.a]\nurl = "u"\ntransport = "pigeon"\n', "a: transport"), ('[cameras.a]\nurl = "u"\ncodec_hint = "av1"\n', "codec_hint"), ('[cameras.a]\nurl = "u"\nbuffer_seconds = 0\n', "buffer_seconds or buffer_frames"),
        ('[cameras.a]\nurl = "u"\nmotion_z_high = 0.0\n', "must be positive"), ('[cameras.a]\n', "no url"),
    ):
        with pytest.raises(ValueError, match=why):
            E.camera_config(bad)


def test_payloads_escape_what_they_quote(spark):
    rows = spark.createDataFrame([('c"1', "e\\", "gradual", None, 1.5, None, 7)], "camera string, event_id string, type string, reason string, z_score double, intra_ratio double, bytes long")
    value = json.loads(sinks.mqtt_payload(rows).first().value)
    assert (value["cam_id"], value["event_id"], value["type"], value["reason"], value["z_score"], value["intra_ratio"], value["byte_count"]) == ('c"1', "e\\", "motion", "", 1.5, 0, 7) and len(value) == 18
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(sinks.html_escaped(F.lit("<a href=\"x\">'&'"))) == "&lt;a href=&#34;x&#34;&gt;&#39;&amp;&#39;"
    assert json.loads('"' + one(sinks.json_escaped(F.lit('a"b\\\n\u0001é'))) + '"') == 'a"b\\\n\u0001é' and one(sinks.json_escaped(F.lit(None).cast("string"))) == ""
    assert one(sinks.status_payload(F.lit(False), F.lit("disk full"))) == '{"online":false,"reason":"disk full"}'


def test_config_history(spark):
    h = spark.createDataFrame([(f"run{k}", "c", k, f"p{k}", f"n{k}") for k in range(25)], "run_id string, camera string, applied_at long, previous_cfg string, new_cfg string")
    assert E.latest_configs(h, 20).count() == 20 and E.rolled_back(h, "run24").first().cfg == "p24"
    plan = h.limit(1).select("camera", "previous_cfg", "new_cfg")
    assert sinks.applied(h, plan, "new", F.lit(99).cast("long")).count() == 26 and sinks.applied(h, plan, "new", F.lit(99).cast("long"), True).count() == 25


def test_prometheus(spark):
    df = spark.createDataFrame([("n", {"b": 'x"y', "a": "1"}, 2.0), ("m", {}, 3.0)], "name string, labels map<string,string>, value double")
    assert sorted(r.value for r in sinks.prometheus(df).collect()) == ["m 3.0", 'n{a="1",b="x\\"y"} 2.0']


def test_rtp(spark):
    packet = bytes([0x80, 0xE0, 0x12, 0x34, 0, 0, 1, 0, 0, 0, 0, 9]) + b"hello"
    padded = bytes([0xA0, 0x60, 0, 1]) + bytes(8) + b"ab\0\0\x03"
    extended = bytes([0x90, 0x60, 0, 1]) + bytes(8) + bytes([0, 0, 0, 1]) + b"wxyz" + b"pay"
    df = spark.createDataFrame([(1, packet), (2, padded), (3, b"short"), (4, bytes([0x40]) + packet[1:]), (5, extended)], "k int, p binary")
    got = {r.k: (r.h, bytes(r.d) if r.d is not None else None) for r in df.select("k", B.rtp_header(F.col("p")).alias("h"), B.rtp_payload(F.col("p")).alias("d")).collect()}
    assert got[1][0].seq == 0x1234 and got[1][0].marker and got[1][0].payload_type == 0x60 and got[1][0].ssrc == 9 and got[1][1] == b"hello"
    assert got[2][1] == b"ab" and got[5][1] == b"pay" and got[3][0] is None and got[4][0] is None


def test_sequence_wraps(spark):
    df = spark.createDataFrame([("c", 1, 65534), ("c", 2, 0), ("c", 3, 65535), ("c", 4, 4), ("c", 5, 0)], "camera string, arrival long, seq int")
    got = [(r.seq, r.lost) for r in B.reordered(df).orderBy("seq_long").collect()]
    assert got == [(65534, 0), (65535, 0), (0, 0), (4, 3)]


def test_exp_golomb_and_sps(spark):
    r = B.Bits(bytes([0b10100110, 0b00100000]))
    assert [r.ue(), r.ue(), r.ue(), r.ue()] == [0, 1, 2, 7]
    s = B.Bits(bytes([0b01001100]))
    assert [s.se(), s.se()] == [1, -1]
    with pytest.raises(EOFError):
        B.Bits(b"\0").ue()
    assert B.unescaped(b"\0\0\3\1\0\0\3\4") == b"\0\0\1\0\0\3\4"

    def bits(*fields):
        text = "".join(format(v, f"0{n}b") if n else ("0" * ((v + 1).bit_length() - 1) + format(v + 1, "b")) for v, n in fields) + "1"
        return int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")

    # baseline, 1280 x 720 after cropping none; order type 2
    sps = b"\x67" + bits((66, 8), (0, 8), (31, 8), (0, 0), (0, 0), (2, 0), (1, 0), (0, 1), (79, 0), (44, 0), (1, 1), (1, 1), (0, 1), (0, 1))
    got = B.with_sps(spark.createDataFrame([(sps,), (b"\x65abc",), (None,)], "payload binary")).collect()
    assert (got[0].sps.width, got[0].sps.height, got[0].sps.level) == (1280, 720, 31) and got[1].sps is None and got[2].sps is None
    assert B.h264_pps(b"\x68" + bits((0, 0), (0, 0), (1, 1), (0, 1), (0, 0), (0, 0), (0, 0), (0, 3), (4, 0))) == {"id": 0, "sps_id": 0, "cabac": True, "init_qp": 24}
    assert B.slice_type(b"\x41" + bits((0, 0), (6, 0))) == 1 and B.slice_type(b"\x67") is None
    hevc = b"\x42\x01" + bits((0, 4), (0, 3), (1, 1), (0, 88), (90, 8), (0, 0), (1, 0), (1920, 0), (1088, 0), (1, 1), (0, 0), (0, 0), (0, 0), (4, 0))
    assert B.h265_sps(hevc) == {"id": 0, "width": 1920, "height": 1080} and B.h265_sps(b"\x42") is None
    report = bytes([0x80, 200, 0, 6]) + b"".join(n.to_bytes(4, "big") for n in (7, 1, 2, 3, 4, 5))
    sr = spark.createDataFrame([(report,), (b"x",)], "p binary").select(B.rtcp_sender_report(F.col("p")).alias("r")).collect()
    assert sr[0].r.ssrc == 7 and sr[0].r.n_bytes == 5 and sr[1].r is None
    assert B.crc32_mpeg(b"123456789") == 0x0376E6E7
    assert B.annex_b(b"\0\0\0\1\x67ab\0\0\1\x68c\0\0\0\1\x65de") == [b"\x67ab", b"\x68c", b"\x65de"]


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(S.mask_classes(F.lit(133).cast("smallint"))) == ["person", "animal", "other"]
    assert one(S.classes_mask(F.array(F.lit("vehicle"), F.lit("ghost"), F.lit("other")))) == 130
    assert [one(S.z_of_reason(F.lit(r))) for r in ("z=3.25,intra_ratio=1", "intra_ratio=1", "z=x", "z=-1.5")] == [3.25, 0.0, 0.0, -1.5]
    assert one(S.ulid_millis(F.concat(S.ulid_time_letters(F.lit(1_700_000_000_123)), F.lit("x" * 16)))) == 1_700_000_000_123
    assert one(S.ulid_millis(F.lit("01KRQBBZU!"))) is None
    assert [one(S.size_text(F.lit(n))) for n in (0, 512, 1536, 5 << 30)] == ["0 B", "512 B", "1.5 KB", "5 GB"]
    assert [one(S.age_text(F.lit(n))) for n in (59, 7200, 90000)] == ["0m ago", "2h ago", "1d ago"]
    assert [S.parse_duration(x) for x in ("7d", "1.5d", "24h", "1h30m", "250ms")] == [604800, 129600, 86400, 5400, 0.25]
    with pytest.raises(ValueError):
        S.parse_duration("soon")
    name = one(S.clip_filename(F.lit("cam"), F.lit(T0), F.lit("01KRQBBZXX"), F.lit("ts")))
    assert name == "cam_20260516_235959_01KRQBBZ.ts" and one(S.clip_filename_time(F.lit(name))) == T0
    assert one(S.clip_url(F.lit("c"), F.lit("x.mpegts"))) == "/api/clips/c/x.m3u8" and one(S.percent(F.lit(1), F.lit(3))) == 33.3
    assert one(S.ring_bytes(F.lit(20), F.lit(8_000_000))) == 1 << 25 and one(S.duration_estimate(F.lit(10))) == 8.0
    assert one(S.unsafe_path(F.lit("a/../b"))) and one(S.off_threshold(F.lit(None).cast("int"))) == 22
