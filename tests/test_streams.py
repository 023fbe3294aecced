"""Streams against their batch twins, over several batches."""

import collections
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from camloom.operators import detector as D
from camloom.operators import rules as R
from camloom.sources.shared import drained
from camloom.streaming import streams
from camloom.streaming.receive import received

T0 = dt.datetime(2026, 5, 16)


def stream_of(spark, batches, ddl, path):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("overwrite").parquet(f"{path}/{k:03d}")
    schema = spark.createDataFrame([], ddl).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


FRAMES = "camera string, ts timestamp, src_id long, byte_count long, is_keyframe boolean"


def test_detector_keeps_state_over_batches(spark, tmp_path):
    rows = [("c", T0 + dt.timedelta(seconds=k), k, 9000 - k if k % 40 == 20 else 100, k % 40 == 1) for k in range(400)]
    late = [("c", T0, -5, 10, False)]
    got = drained(streams.detector_stream(stream_of(spark, [rows[:150], rows[150:151], rows[151:] + late], FRAMES, f"{tmp_path}/in"), D.Config(on_threshold=1, off_threshold=3, intra_ratio_high=1e9)))
    expected = D.fold([(r[3], r[4], None) for r in rows], D.Config(on_threshold=1, off_threshold=3, intra_ratio_high=1e9))
    found = sorted((r.src_id, round(r.z_score, 9)) for r in got.collect())
    assert found == sorted((i, round(x[1], 9)) for i, x in enumerate(expected) if x[0]) and found
    assert got.agg(F.max("late")).first()[0] == 1


EVENTS = "event_id string, site string, camera string, ts timestamp, reason string, z_score double, intra_ratio double, bytes long, bpf_slow double"


def test_router_writes_each_event_once(spark, tmp_path):
    rows = [(f"{k:08d}", "s", "c", T0, "unexpected_idr" if k % 3 == 0 else "z=4", 4.0, 1.0, 5000, 100.0) for k in range(30)]
    stream = stream_of(spark, [rows[:10], rows[10:]], EVENTS, f"{tmp_path}/in")
    for _ in range(2):
        streams.start_router(stream, R.default_stages(), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert {r.verdict: r["count"] for r in out.groupBy("verdict").count().collect()} == {"suppressed": 10, "confirmed": 20}


def test_spikes_and_silence(spark, tmp_path):
    at = lambda minute, n: [("c", T0 + dt.timedelta(minutes=minute, seconds=k)) for k in range(n)]
    batches = [at(0, 2), at(2, 9), at(4, 9), at(30, 1), at(60, 1)]
    got = drained(streams.spikes(stream_of(spark, batches, "camera string, ts timestamp", f"{tmp_path}/in"), delay="1 second"))
    alarms = sorted((r.window_start, r.alarm) for r in got.collect())
    assert alarms[0] == (T0 + dt.timedelta(minutes=2), "spike") and (T0 + dt.timedelta(minutes=6), "silent") in alarms


def plain_alarms(times, size, factor, mark):
    counts = collections.Counter(t - t % size for t in times)
    out = []
    for w, n in counts.items():
        before = counts.get(w - size, 0)
        if before and n >= factor * before and w + size <= mark:
            out.append((w, n, before, "spike"))
        if not counts.get(w + size) and w + 2 * size <= mark:
            out.append((w + size, 0, n, "silent"))
    return sorted(out)


def test_spikes_do_not_depend_on_how_rows_come(spark, tmp_path):
    """The same rows sorted, shuffled over parts of far more than Arrow's 10,000 rows, and in batches out of order within the delay."""
    rng = random.Random(5)
    minutes = [m for m in range(0, 240) for _ in range(rng.choice([0, 0, 60, 60, 100, 400]) if m % 20 > 3 else 0)]
    rows = [("c", T0 + dt.timedelta(minutes=m, seconds=rng.randrange(60))) for m in minutes] + [("d", T0 + dt.timedelta(minutes=239))]
    assert len(rows) > 15_000
    epoch = lambda t: int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1000)
    times = sorted(epoch(t) for c, t in rows if c == "c")
    mark = max(epoch(t) for _, t in rows) - 30 * 60_000
    expected = plain_alarms(times, 120_000, 3.0, mark)
    assert {a for *_, a in expected} == {"spike", "silent"}
    shuffled = rng.sample(rows, len(rows))
    by_time = sorted(rows, key=lambda r: r[1])
    near = [r for k in range(0, len(by_time), 500) for r in rng.sample(by_time[k : k + 500], len(by_time[k : k + 500]))]
    for name, batches in (("sorted", [by_time]), ("shuffled", [shuffled]), ("batches", [near[k : k + 3000] for k in range(0, len(near), 3000)])):
        got = drained(streams.spikes(stream_of(spark, batches, "camera string, ts timestamp", f"{tmp_path}/{name}"), delay="30 minutes"))
        assert sorted((epoch(r.window_start), r.n, r.before, r.alarm) for r in got.where("camera = 'c'").collect()) == expected, name


PACKETS = "camera string, arrival long, seq long"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def plain_receiver(seqs, window=32):
    due, place, held, out = None, 0, {}, []
    for arrival, seq in seqs:
        due = seq if due is None else due
        ahead = (seq - due + 32768) % 65536 - 32768
        if ahead < 0:
            continue
        if 0 < ahead < window:
            held[seq] = arrival
            continue
        ready = [(s, held[s], 0) for s in sorted(held, key=lambda s: (s - due) % 65536)] if ahead else []
        held = {} if ahead else held
        ready.append((seq, arrival, max(ahead - 1, 0)))
        due = (seq + 1) % 65536
        while due in held:
            ready.append((due, held.pop(due), 0))
            due = (due + 1) % 65536
        for s, a, lost in ready:
            place += 1
            out.append((a, s, place, lost))
    return out


def test_received_keeps_its_window_over_batches(spark, tmp_path, rocks):
    rng, rows = random.Random(2), []
    for camera in ("a", "b"):
        sent = [(65_300 + k) % 65536 for k in range(700) if rng.random() > 0.03 and not 300 < k < 340]
        sent = [s for at in range(0, len(sent), 9) for s in rng.sample(sent[at : at + 9], len(sent[at : at + 9]))]
        rows += [(camera, k, s) for k, s in enumerate(sent)] + [(camera, 5000, sent[3])]
    rows.sort(key=lambda r: r[1])
    batches = [rows[k : k + 400] for k in range(0, len(rows), 400)]
    got = collections.defaultdict(list)
    for r in drained(received(stream_of(spark, batches, PACKETS, f"{tmp_path}/in"))).orderBy("camera", "place").collect():
        got[r.camera].append((r.arrival, r.seq, r.place, r.lost))
    expected = {c: plain_receiver([r[1:] for r in rows if r[0] == c]) for c in "ab"}
    assert got == expected and sum(lost for *_, lost in expected["a"]) > 30
