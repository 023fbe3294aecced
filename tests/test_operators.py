"""Rules, clips, tuner, statistics and ordered operators on small tables."""

import datetime as dt
import random

from pyspark.sql import functions as F

from camloom.operators import clips as C
from camloom.operators import ordered as O
from camloom.operators import rules as R
from camloom.operators import stats as ST
from camloom.operators import tuner as T
from camloom.plans import catalog

EVENT = "event_id string, camera string, reason string, z_score double, intra_ratio double, bytes long, bpf_slow double"
NOW = dt.datetime(2026, 5, 20)


def decided(spark, row, stages):
    return R.cascade(spark.createDataFrame([row], EVENT), stages).first()


def test_cascade_order_and_defaults(spark):
    stages = [R.idr_burst(2.0), R.bytes_floor(1.5, 500), R.intra_ratio(2.5, 3.5), R.pass_through()]
    r = decided(spark, ("e", "c", "unexpected_idr", 2.5, 9.0, 10, 400.0), stages)
    assert (r.verdict, r.decided_by, r.suppress_reason) == ("suppressed", "idr_burst", "idr_burst z=2.50")
    r = decided(spark, ("e", "c", "unexpected_idr", 1.0, 9.0, 550, 400.0), stages)
    assert (r.decided_by, r.suppress_reason) == ("bytes_floor", "bytes 550 < 600 (1.5x bpf_slow)")
    r = decided(spark, ("e", "c", "z=3", 1.0, 9.0, 300, 0.0), stages)
    assert r.suppress_reason == "bytes 300 < min 500"
    r = decided(spark, ("e", "c", "z=3", 3.0, 2.6, 9000, 400.0), stages)
    assert r.decided_by == "intra_ratio"
    r = decided(spark, ("e", "c", "z=3", 3.5, 2.6, 9000, 400.0), stages)
    assert (r.verdict, r.decided_by) == ("confirmed", "passthrough")
    assert decided(spark, ("e", "c", "unexpected_idr", 0.0, 0.0, 0, 0.0), R.default_stages()).decided_by == "idr_burst"
    assert decided(spark, ("e", "c", "z=3", 9.0, 9.0, 9, 9.0), []).decided_by == "default"
    assert decided(spark, ("e", "c", None, None, None, None, None), stages).decided_by == "passthrough"


def test_subjects(spark):
    df = spark.createDataFrame([("events.raw.a.b",), ("events.raw.a",), ("events.raw.a.b.c",)], "s string")
    match = lambda p: [r.s for r in df.where(R.subject_matches(F.col("s"), p)).collect()]
    assert match("events.raw.*.>") == ["events.raw.a.b", "events.raw.a.b.c"] and match("events.raw.*") == ["events.raw.a"]


def clips_of(spark, rows):
    return spark.createDataFrame([(c, n, s, NOW - dt.timedelta(days=d)) for c, n, s, d in rows], "camera string, filename string, size long, mod_time timestamp_ntz")


MIB = 1 << 20


def deleted(spark, rows, days, quota=0, **kw):
    return sorted((r.filename, r.reason) for r in C.retention(clips_of(spark, rows), F.lit(NOW), days, quota, **kw).collect())


def test_retention(spark):
    ages = [("c", "a.ts", MIB, 5), ("c", "b.ts", MIB, 1), ("c", "c.ts", MIB, 0.1)]
    assert deleted(spark, ages, 3) == [("a.ts", "age")]
    assert deleted(spark, ages, 0, 2 * MIB) == [("a.ts", "quota")]
    four = [("c", "a.ts", MIB, 10), ("c", "b.ts", MIB, 5), ("c", "c.ts", MIB, 1), ("c", "d.json", MIB, 99)]
    assert deleted(spark, four, 3, 10 * MIB) == [("a.ts", "age")]
    assert deleted(spark, four, 3, 10 * MIB, quota_stops_age=False) == [("a.ts", "age"), ("b.ts", "age")]
    assert deleted(spark, four, 3, 2 * MIB) == [("a.ts", "age+quota")]


def test_listing_and_pages(spark):
    clips = clips_of(spark, [("camera1", "clip1.ts", MIB, 3), ("camera1", "clip2.ts", 2 * MIB, 2), ("camera2", "clip3.mp4", MIB // 2, 1), ("camera2", "x.json", 1, 0)])
    assert C.listed(clips).count() == 3 and C.listed(clips, "camera1").count() == 2 and C.listed(clips, "nobody").count() == 0
    assert [r.filename for r in C.page(C.listed(clips), 1, 2).collect()] == ["clip3.mp4", "clip2.ts"]
    assert [r.filename for r in C.page(C.listed(clips), 99, 2).collect()] == ["clip1.ts"]
    assert C.page(C.listed(clips), 0, 0).count() == 3
    numbers = spark.range(1).select(C.page_numbers(F.lit(6), F.lit(20)).alias("p")).first().p
    assert numbers == [1, -1, 4, 5, 6, 7, 8, -1, 20]


def test_label_upsert(spark):
    ddl = "event_id string, label string, labeled_at timestamp_ntz"
    old = spark.createDataFrame([("a", "tp", NOW), ("b", "fp", NOW)], ddl)
    new = spark.createDataFrame([("a", "fp", NOW + dt.timedelta(1)), ("b", None, NOW + dt.timedelta(1)), ("c", "maybe", NOW), ("d", "reference", NOW)], ddl)
    assert sorted((r.event_id, r.label) for r in C.clip_labels_upserted(old, new).collect()) == [("a", "fp"), ("d", "reference")]


def test_tuner_acceptance(spark):
    tps = [(f"t{k}", "c", "z", 5.0, 0.0, 6000, 500.0) for k in range(300)]
    fps = [(f"f{k}", "c", "z", 3.2, 0.0, 700, 500.0) for k in range(700)]
    labels = spark.createDataFrame([(e[0], "tp" if e[0][0] == "t" else "fp") for e in tps + fps], "event_id string, label string")
    events = T.labelled(spark.createDataFrame(tps + fps, EVENT), labels)
    grid = T.grid_scores(events)
    assert grid.count() == 576
    best = T.ranked(grid).limit(1)
    plan = T.valid_plan(T.plan_summary(events, best)).first()
    assert plan.expected_fp_reduction_pct > 50 and plan.expected_tp_loss_pct < 2 and plan.valid
    none = T.grid_scores(events.limit(0))
    assert none.count() == 576 and none.agg(F.max("score")).first()[0] == 0


def test_any_other_label_stays_true_positive(spark):
    events = spark.createDataFrame([("a", "c", "z", 5.0, 0.0, 100, 500.0), ("b", "c", "z", 5.0, 0.0, 100, 500.0)], EVENT)
    labels = spark.createDataFrame([("a", "odd"), ("a", "odd")], "event_id string, label string")
    assert {r.event_id: r.label_value for r in T.labelled(events, labels).collect()} == {"a": 1, "b": -1}


NAL = "camera string, seq long, pts_90khz long, length long, flags smallint"


def test_access_units_leave_the_last_open(spark):
    nal = spark.createDataFrame([("c", 1, 0, 10, 2), ("c", 2, 0, 20, 1), ("c", 3, 3003, 0, 0), ("c", 4, 6006, 5, 8), ("c", 5, 9009, 7, 0)], NAL)
    got = [(r.pts_90khz, r.byte_count, r.is_keyframe, r.is_intra, r.is_bframe) for r in O.access_units(nal).orderBy("first_seq").collect()]
    assert got == [(0, 30, True, True, False), (6006, 5, False, False, True)]


def test_snapshot_widens_to_a_keyframe(spark):
    nal = spark.createDataFrame([("c", k + 1, 3003 * k, 10, 1 if k == 0 else 0) for k in range(10)], NAL)
    windows = spark.createDataFrame([("c", 1, 3003, 18018), ("c", 2, 0, 0), ("c", 3, -9, -5)], "camera string, window_id long, from_pts long, to_pts long")
    got = {r.window_id: (r.first_seq, r.last_seq, r.n_records, r.n_bytes) for r in O.snapshots(nal, windows).collect()}
    assert got == {1: (1, 7, 7, 70), 2: (1, 1, 1, 10)}


def test_timeline_shifts_back(spark):
    rows = spark.createDataFrame([("c", 1, 0, 1, 1, 0.0), ("c", 2, 0, 1, 0, 2.5), ("c", 3, 3000, 1, 8, 4.0), ("c", 4, 6000, 1, 0, 0.0)], NAL + ", z_score double")
    got = [(r.offset_ms, r.z_score, r.is_keyframe, r.is_bframe) for r in O.z_timeline(rows).orderBy("offset_ms").collect()]
    assert got == [(0, 4.0, True, False), (33, 0.0, False, True), (66, 0.0, False, False)]


def test_ring_and_fragments(spark):
    nal = spark.createDataFrame([("c", k, k * 3003, 1, 1 if k in (1, 4, 9) else 0) for k in range(1, 13)], NAL)
    assert sorted(r.seq for r in O.newest(nal, 8).collect()) == list(range(6, 13))
    assert [r.fragment for r in O.fragments(nal).orderBy("seq").collect()] == [0, 0, 0, 1, 1, 1, 1, 1, 2, 2, 2, 2]


def test_readiness_and_histograms(spark):
    ready = lambda rows: ST.readiness(spark.createDataFrame(rows, "camera string, connected boolean, ready boolean")).first().ready
    assert ready([("a", True, True), ("b", False, True)]) and not ready([("a", False, True)]) and not ready([("a", True, False)]) and not ready([])
    h = ST.histogram(spark.createDataFrame([(v,) for v in (1.0, 5.0, 7.0, 99.0, None)], "v double"), "v", (5.0, 10.0))
    assert sorted((r.le or 1e9, r.cumulative, r.total) for r in h.collect()) == [(5.0, 2, 4), (10.0, 3, 4), (1e9, 4, 4)]


def test_ranges_change_nothing(spark):
    import random

    rnd = random.Random(1)
    rows = [(c, k, 3003 * (k // 3), rnd.randint(0, 9), rnd.choice([0, 0, 0, 1, 2, 8]), rnd.choice([0.0, 1.5, 4.0])) for c in ("a", "b") for k in range(1, 60)]
    nal = spark.createDataFrame(rows, NAL + ", z_score double")
    frames = nal.select("camera", "seq", (F.col("flags") == 1).alias("is_keyframe"))
    windows = spark.createDataFrame([(c, i, rnd.randint(0, 60_000), rnd.randint(0, 60_000)) for c in ("a", "b") for i in range(20)], "camera string, window_id long, from_pts long, to_pts long")
    same = lambda f: sorted(map(tuple, f(4).collect()), key=repr) == sorted(map(tuple, f(1 << 20).collect()), key=repr)
    assert same(lambda n: O.access_units(nal, n)) and same(lambda n: O.fragments(nal, n)) and same(lambda n: O.since_keyframe(frames, n))
    assert same(lambda n: O.z_timeline(nal, 9, span=n)) and same(lambda n: O.snapshots(nal, windows, n, n * 4000))
    events = spark.createDataFrame([("c", f"{k:03d}", NOW + dt.timedelta(hours=rnd.randint(0, 200))) for k in range(60)], "camera string, event_id string, ts timestamp")
    day = sorted(map(tuple, O.sessions(events, 7200).collect()))
    assert day == sorted(map(tuple, O.sessions(events, 7200, days=1000).collect())) and len(day) > 5


def test_snapshot_of_every_record_against_brute_force(spark, monkeypatch):
    """Windows before the first keyframe, equal PTS at a bound, and cameras of few records included."""
    rng, rows = random.Random(3), []
    for camera, n in (("a", 60), ("b", 3), ("c", 1), ("d", 40)):
        pts = 0
        for seq in range(1, n + 1):
            pts += 90_000 * rng.choice((0, 1, 1, 2, 5))
            rows.append((camera, seq, pts, rng.choice((0, 0, 0, 1, 2)) if seq > 4 else 0, rng.randint(1, 999)))
    nal = spark.createDataFrame(rows, "camera string, seq long, pts_90khz long, flags int, length long")
    monkeypatch.setattr(catalog, "view", lambda *_: nal)
    expected = []
    for camera, window, at, *_ in rows:
        mine = [r for r in rows if r[0] == camera]
        last = max(r[1] for r in mine if r[2] <= at + 8 * 90_000)
        first = max((r[1] for r in mine if r[2] < max(0, at - 6 * 90_000) and r[3] & 3), default=1)
        inside = [r[4] for r in mine if first <= r[1] <= last]
        expected.append((camera, window, first, last, len(inside), sum(inside)))
    got = catalog.QUERIES["snapshot_every_record"](spark, None)
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_delivered_packets(spark):
    """In order, waiting, late, twice, far ahead, past the wrap."""
    from camloom.functions.bitstream import delivered

    seqs = [65533, 65535, 65534, 65534, 0, 2, 3, 1, 10, 12, 60, 59, 61]
    rows = [("a", k, s) for k, s in enumerate(seqs)] + [("b", k, 5 + k) for k in range(3)]
    out = sorted((r.camera, r.place, r.seq, r.lost) for r in delivered(spark.createDataFrame(rows, "camera string, arrival long, seq long").repartition(3)).collect())
    assert [(s, lost) for c, _, s, lost in out if c == "a"] == [(65533, 0), (65534, 0), (65535, 0), (0, 0), (1, 0), (2, 0), (3, 0), (10, 0), (12, 0), (60, 55), (61, 0)]
    assert [s for c, _, s, _ in out if c == "b"] == [5, 6, 7]


def test_playlist_durations_at_ties(spark):
    """Sixteenths of a second end in a 5 at the fourth decimal, where printf takes the even neighbour."""
    from camloom.functions.scalars import playlist

    sizes = [24576 * (16 + k) for k in (1, 3, 5, 15)] + [393216 * 1000, 500_000, 1]
    got = [r.p for r in spark.createDataFrame([("a.ts", s) for s in sizes], "f string, s long").select(playlist(F.col("f"), F.col("s")).alias("p")).collect()]
    seconds = [s / 393216 if s >= 393216 else 8.0 for s in sizes]
    assert [p.split("#EXTINF:")[1].split(",")[0] for p in got] == [f"{s:.3f}" for s in seconds]
    assert "#EXTINF:1.062,\na.ts\n" in got[0]


def test_median_of_many_sizes(spark):
    """More distinct sizes than a sketch tells apart; nulls, an even number, negative ones."""
    many = spark.range(0, 300_001, 1, 8).select(F.lit("a").alias("camera"), ((F.col("id") * 7919) % 300_001 - 5).alias("byte_count"), (F.col("id") < 3).alias("is_keyframe"))
    few = spark.createDataFrame([("b", 4, True), ("b", -9, False), ("b", None, False), ("b", 6, True), ("b", 5, True), ("c", None, True), (None, 3, False)], "camera string, byte_count long, is_keyframe boolean")
    got = {r.camera: (r.n, r.median_bytes) for r in ST.fingerprints(many.unionByName(few)).collect()}
    assert got == {"a": (300_001, 149_995), "b": (5, 4), "c": (1, None), None: (1, 3)}
