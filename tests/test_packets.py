"""Depacketising and sequence numbers against plain loops over the packets of a camera."""

import random

import pytest

from camloom.functions import bitstream as B
from camloom.operators.depacketize import depacketized, packet_kind, split_units
from camloom.operators.slices import h265_pps, h265_slice, h265_vps, slice_headers
from pyspark.sql import functions as F

DDL = "camera string, seq_long long, timestamp long, marker boolean, payload binary"


def plain_units(packets, codec, donl):
    """What a receiver that is given one camera's packets in sequence puts out."""
    two = codec == "h265"
    head, out, run, due = 2 if two else 1, [], None, None
    for seq, ts, marker, p in packets:
        run = run if due is None or seq == due else None
        due = seq + 1
        if not p or len(p) < head:
            continue
        kind = p[0] >> 1 & 63 if two else p[0] & 31
        if kind == (48 if two else 24):
            units, at = [], head + 2 * donl
            while True:
                skip = int(donl and bool(units))
                if at + skip + 2 > len(p):
                    break
                n = int.from_bytes(p[at + skip : at + skip + 2], "big")
                if at + skip + 2 + n > len(p):
                    at = -1
                    break
                units.append(p[at + skip + 2 : at + skip + 2 + n])
                at += skip + 2 + n
                if at == len(p):
                    break
            out += [(seq, k, ts, marker and k + 1 == len(units) and at == len(p), u) for k, u in enumerate(units)]
        elif kind == (49 if two else 28):
            start = len(p) > head and p[head] & 128
            skip = head + 1 + (2 if donl and start else 0)
            if len(p) <= head or len(p) < skip:
                continue
            if start:
                run = [ts, bytes([(p[2] & 63) << 1, 1]) if two else bytes([p[0] & 224 | p[1] & 31])]
            if run is not None:
                run.append(p[skip:])
                if p[head] & 64:
                    out.append((seq, 0, run[0], marker, b"".join(run[1:])))
                    run = None
        elif (kind < 48 or kind > 50) if two else 0 < kind < 24:
            out.append((seq, 0, ts, marker, p))
    return out


def drawn(rng, codec):
    """A payload of any kind, whole or cut."""
    two = codec == "h265"
    body = bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 2, 5, 9])))
    head = bytes([rng.choice([1, 19, 33, 50, 60]) << 1, 1]) if two else bytes([rng.choice([0x61, 0x65, 0x67, 0x19, 0x60, 0x7F])])
    what = rng.choice(["single", "fragment", "fragment", "fragment", "fragment", "aggregate", "empty"])
    if what == "fragment":
        bits = rng.choice([0, 0, 0, 0x80, 0x80, 0x40, 0x40, 0xC0])
        return (b"\x62\x01" if two else b"\x7c") + bytes([bits | rng.choice([1, 5, 19])]) + body
    if what == "aggregate":
        units = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 4]))) for _ in range(rng.randrange(4))]
        return (b"\x60\x01" if two else b"\x78") + b"".join(len(u).to_bytes(2, "big") + u for u in units) + rng.choice([b"", b"", b"\x00", b"\x00\x09x"])
    return None if what == "empty" and rng.random() < 0.5 else b"" if what == "empty" else head + body


@pytest.mark.parametrize(("codec", "donl", "span"), [("h264", False, 1 << 20), ("h264", False, 5), ("h265", False, 7), ("h265", True, 1 << 20), ("h265", True, 1)])
def test_units_against_a_receiver(spark, codec, donl, span):
    rng, rows, expected = random.Random(span), [], []
    for camera in ("a", "b"):
        seq, mine = rng.randrange(100), []
        for _ in range(700):
            seq += rng.choice([1] * 12 + [2, 5])
            mine.append((seq, seq * 3, rng.random() < 0.5, drawn(rng, codec)))
        rows += [(camera, *r) for r in mine]
        expected += [(camera, *r) for r in plain_units(mine, codec, donl)]
    got = depacketized(spark.createDataFrame(rows, DDL).repartition(5), codec, donl, span).collect()
    assert sorted((*r[:5], bytes(r.nal)) for r in got) == sorted(expected) and len({len(r.nal) for r in got}) > 5


def test_units_of_known_packets(spark):
    rows = [
        ("c", 1, 90, True, b"\x65one"), ("c", 2, 91, True, b"\x18\0\2ab\0\3cde"), ("c", 3, 92, False, b"\x7c\x85AA"), ("c", 4, 92, False, b"\x7c\x05BB"), ("c", 5, 92, True, b"\x7c\x45CC"),
        ("c", 6, 93, False, b"\x7c\x85XX"), ("c", 8, 93, True, b"\x7c\x45YY"), ("c", 9, 94, True, b""),
    ]
    got = depacketized(spark.createDataFrame(rows, DDL)).orderBy("seq_long", "part").collect()
    assert [(bytes(r.nal), r.timestamp, r.marker) for r in got] == [(b"\x65one", 90, True), (b"ab", 91, False), (b"cde", 91, True), (b"\x65AABBCC", 92, True)]
    h265 = spark.createDataFrame([("c", 1, 1, None, b"\x60\x01\0\2ab\0\1c"), ("c", 2, 1, None, b"\x62\x01\x93FF"), ("c", 3, 1, None, b"\x62\x01\x53GG"), ("c", 4, 1, None, b"\x64\x01??")], DDL)
    assert [bytes(r.nal) for r in depacketized(h265.drop("marker"), "h265").orderBy("seq_long", "part").collect()] == [b"ab", b"c", b"\x26\x01FFGG"]
    assert depacketized(h265.limit(0)).count() == 0
    kinds = spark.createDataFrame([(b"\x7c",), (b"\x7c\x85",), (b"\x18",), (b"\x1a00",), (None,)], "p binary").select(packet_kind(F.col("p"), "h264").alias("k")).collect()
    assert [r.k for r in kinds] == ["short", "fragment", "aggregate", "unsupported", "empty"]
    assert split_units(b"\x60\x01\0\0\0\2ab\7\0\1c", "h265", donl=True) == [b"ab", b"c"]


@pytest.mark.parametrize("span", [1 << 20, 50])
def test_numbers_that_wrap(spark, span):
    rng = random.Random(1)
    sent = [(c, p) for c in "ab" for p in range(65_400, 66_000) if p % 7 != 3]
    rows = []
    for c in "ab":
        mine = [p for k, p in sent if k == c]
        mine = [p for at in range(0, len(mine), 4) for p in rng.sample(mine[at : at + 4], len(mine[at : at + 4]))] + [mine[-1]]
        rows += [(c, k, p % 65536) for k, p in enumerate(mine)]
    df = spark.createDataFrame(rows, "camera string, arrival long, seq int").repartition(4)
    got = sorted((r.camera, r.seq_long, r.lost) for r in B.reordered(df, span=span).collect())
    assert [(c, s) for c, s, _ in got] == sent and sum(lost for *_, lost in got) == sum(2 for p in range(65_401, 65_999) if p % 7 == 3)


def bits(text):
    text = text.replace(" ", "") + "1"
    return int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")


def test_headers_under_the_active_set(spark):
    pps = lambda i, cabac: b"\x68" + bits(f"{['1', '010', '011'][i]} 1 {cabac} 0 1 1 1 0 00 1")
    p_slice = b"\x61" + bits("1 00110 010 0101 011")  # slice type 5, set 1, frame 5, run 2
    rows = [(0, p_slice), (1, pps(1, 1)), (2, p_slice), (3, pps(0, 0)), (4, p_slice), (5, pps(1, 0)), (6, p_slice), (7, b"\x65" + bits("1 00100 1 0001")), (8, None), (9, b"\x61"), (10, b"\x67\x42\x00")]
    units = spark.createDataFrame([("c", k, n) for k, n in rows] + [("d", 9, p_slice)], "camera string, seq long, nal binary").repartition(3)
    for span in (1 << 20, 2):
        got = {(r.camera, r.seq): tuple(r)[2:] for r in slice_headers(units, span).collect()}
        assert got == {
            ("c", 0): (False, 5, 1, 5, False, 2), ("c", 2): (False, 5, 1, 5, True, None), ("c", 4): (False, 5, 1, 5, True, None), ("c", 6): (False, 5, 1, 5, False, 2),
            ("c", 7): (True, 3, 0, 1, False, None), ("d", 9): (False, 5, 1, 5, False, 2),
        }
    assert slice_headers(units.limit(0)).count() == 0


def test_h265_headers():
    assert h265_slice(b"\x02\x01" + bits("1 010 10000001")) == {"first": True, "pps_id": 1, "poc_lsb": 129}
    assert h265_slice(b"\x26\x01" + bits("0 1 011 0")) == {"first": False, "pps_id": 2, "poc_lsb": None}
    assert h265_slice(b"\x02\x01" + bits("1 1 001"[:5])) is None and h265_slice(b"\x40\x01\x0c") is None and h265_slice(b"") is None
    assert h265_vps(b"\x40\x01" + bits("0011 11 000001 010 0000")) == {"id": 3, "layers": 2, "sub_layers": 3} and h265_vps(b"\x42\x01\0\0\0") is None
    assert h265_pps(b"\x44\x01" + bits("010 1 0000000 1 1 00101")) == {"id": 1, "sps_id": 0, "init_qp": 24} and h265_pps(b"\x44\x01\0") is None


def test_rows_are_made_once(spark):
    """Packets are numbered, and headers read, in one pass over what makes them; of equal numbers the first to arrive stays."""
    made = spark.sparkContext.accumulator(0)

    def counted(df):
        def run(batches):
            for b in batches:
                made.add(b.num_rows)
                yield b

        return df.mapInArrow(run, df.schema)

    packets = spark.createDataFrame([("c", k, s) for k, s in enumerate([65534, 65535, 1, 0, 0, 1, 4])], "camera string, arrival long, seq int")
    got = sorted((r.seq_long, r.arrival, r.lost) for r in B.reordered(counted(packets), span=2).collect())
    assert got == [(65534, 0, 0), (65535, 1, 0), (65536, 3, 0), (65537, 2, 0), (65540, 6, 2)] and made.value == 7
    units = spark.createDataFrame([("c", k, b"\x61" + bits("1 00110 010 0101 011")) for k in range(9)], "camera string, seq long, nal binary")
    assert slice_headers(counted(units), 2).count() == 9 and made.value == 16


@pytest.mark.parametrize(("codec", "donl", "span", "per_batch"), [("h264", False, 64, 3), ("h265", True, 2, 10_000), ("h265", False, 1 << 20, 1)])
def test_packets_are_looked_at_once(spark, codec, donl, span, per_batch):
    """Runs go on from batch to batch and over ranges of the sequence, also whole ranges without a fragment; repeats count as they came first."""
    rng, made, rows, expected = random.Random(per_batch), spark.sparkContext.accumulator(0), [], []
    head = b"\x62\x01" if codec == "h265" else b"\x7c"
    for camera in ("a", "b", None):
        seq, mine = -5, []
        for _ in range(300):
            seq += rng.choice([1] * 60 + [2])
            long_run = head + bytes([rng.choice([0] * 12 + [128, 64])]) + bytes(rng.randrange(256) for _ in range(rng.choice([2, 3])))
            mine.append((seq, seq * 3, rng.random() < 0.5, rng.choice([long_run, long_run, drawn(rng, codec)])))
        again = [(s, 0, False, b"\x61later") for s, *_ in rng.sample(mine, 40)] if camera else []
        rows += [(camera, *r, k) for k, r in enumerate(mine + again)]
        expected += [(camera, *u) for u in plain_units(mine, codec, donl)] if camera else []

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    df = spark.createDataFrame(rows, f"{DDL}, arrival long").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(per_batch))
    try:
        got = depacketized(df.mapInArrow(counted, df.schema), codec, donl, span, order="arrival").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((*r[:5], bytes(r.nal)) for r in got if r.camera) == sorted(expected) and made.value == len(rows)
    assert max(len(r.nal) for r in got) > 20


def test_runs_over_ranges(spark):
    """A unit in three ranges of two packets each, one of them without a fragment; the same with a gap at an edge gives nothing."""
    one = [(1, 7, False, b"\x7c\x85AA"), (2, 7, False, b"\x61.."), (3, 7, False, b"\x61.."), (4, 7, True, b"\x7c\x45BB")]
    for lost, expected in ((None, [b"\x65AABB"]), (2, []), (3, [])):
        df = spark.createDataFrame([("c", *r) for r in one if r[0] != lost], DDL)
        got = [(bytes(r.nal), r.timestamp, r.marker, r.seq_long) for r in depacketized(df, span=2).where("length(nal) > 3").collect()]
        assert got == [(n, 7, True, 4) for n in expected]


def test_scratch_tables_leave_no_shuffle_files(spark):
    import glob

    from camloom.sources.shared import dropped, scratch

    path = spark.sparkContext.getConf().get("spark.local.dir", "/tmp")
    files = lambda: set(glob.glob(f"{path}/blockmgr-*/*/shuffle_*.data"))
    before = files()
    table = scratch(spark.range(1000).repartition(3, "id"), "moved")
    assert files() <= before and table.count() == 1000
    dropped(table)
