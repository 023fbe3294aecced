"""Groups of cameras, fallback thresholds, and the outbox, on small made-up tables."""

import datetime as dt
import random

from pyspark.sql import functions as F

from camloom.operators import clusters as CL
from camloom.sources.shared import drained
from camloom.streaming import outbox
from tests.test_streams import stream_of

T0 = dt.datetime(2026, 5, 16)


def test_groups_that_stand_apart(spark):
    rng = random.Random(1)
    rows = [(f"c{k}", [100.0, 5000.0, 90_000.0][k % 3] + rng.random() * 40, [1.0, 9.0, 2.0][k % 3] + rng.random() / 9, None if k == 4 else 0.5) for k in range(60)]
    prints = spark.createDataFrame(rows, "camera string, a double, b double, c double")
    got = {r.camera: r.cluster for r in CL.clustered(prints.repartition(4), ["a", "b", "c"], 3).collect()}
    assert len(got) == 60 and all(len({got[f"c{k}"] for k in range(m, 60, 3)}) == 1 for m in range(3)) and len(set(got.values())) == 3
    assert CL.clustered(prints.limit(0), ["a"], 3).count() == 0
    assert {r.cluster for r in CL.clustered(prints.withColumn("a", F.lit(7.0)), ["a"], 4).collect()} == {0}


def test_cameras_with_few_labels_take_their_groups_thresholds(spark):
    events = [(f"e{c}{k}", c, 4.0 if k % 2 else 2.6, 9000, 100.0, 1 if k % 2 else -1) for c, n in (("a", 120), ("b", 6)) for k in range(n)]
    events += [(f"x{k}", "d", 2.6, 9000, 100.0, 1) for k in range(150)]
    table = spark.createDataFrame(events, "event_id string, camera string, z_score double, bytes long, bpf_slow double, label_value int")
    clusters = spark.createDataFrame([("a", 0), ("b", 0), ("d", 1), ("e", 1), ("f", 2)], "camera string, cluster int")
    got = {r.camera: r for r in CL.tuned(table, clusters).collect()}
    assert {c: (r.level, r.n_labels) for c, r in got.items()} == {"a": ("camera", 120), "b": ("cluster", 6), "d": ("camera", 150), "e": ("cluster", 0), "f": ("cluster", 0)}
    assert got["a"].motion_z_high == got["b"].motion_z_high == 3.0 and got["d"].motion_z_high == got["e"].motion_z_high == 2.5 and got["f"].motion_z_high is None


def test_what_is_not_acknowledged_in_time_is_put_out(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    records = [[("a", at(0)), ("b", at(10)), ("c", at(20)), ("c", at(20))], [("d", at(2000)), (None, at(2000)), ("e", at(2010))], [("late", at(4000)), ("end", at(9000))]]
    acks = [[("a", at(30)), ("b", at(10 + 301)), ("x", at(40))], [("d", at(2299)), ("e", at(1999))], [("end", at(9000))]]
    left = stream_of(spark, records, "event_id string, ts timestamp", f"{tmp_path}/records")
    right = stream_of(spark, acks, "event_id string, ack_ts timestamp", f"{tmp_path}/acks")
    got = sorted(r.event_id for r in drained(outbox.unacknowledged_stream(left, right, "5 minutes", "1 minute")).collect())
    assert got == ["b", "c", "c", "e", "late"]


def test_replay_in_key_order_and_back_pressure(spark):
    keys = [f"{k:026d}" for k in range(300)]
    records = spark.createDataFrame([("events", k) for k in random.Random(2).sample(keys, 300)] + [("clips", keys[5]), ("events", None), ("events", keys[1])], "bucket string, key string")
    acks = spark.createDataFrame([("events", k) for k in keys if int(k) % 3 == 0] * 2 + [("clips", "other")], "bucket string, key string")
    got = sorted((r.bucket, r.place, r.key) for r in outbox.replay(records, acks, letters=25).collect())
    expected = sorted([k for k in keys if int(k) % 3] + [keys[1]])
    assert got == [("clips", 1, keys[5]), *(("events", n, k) for n, k in enumerate(expected, 1))]
    levels = spark.createDataFrame([(80, False), (90, False), (95, True), (100, True)], "level long, urgent boolean")
    assert [r[0] for r in levels.select(outbox.admitted(F.col("level"), 100, F.col("urgent"))).collect()] == ["taken", "drop_outbox_full", "taken", "dropped"]
