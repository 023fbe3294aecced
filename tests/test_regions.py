"""Clips cut by length, accumulated activity, and regions, against plain folds."""

import collections
import datetime as dt
import functools
import operator
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from camloom.operators import regions as RG
from camloom.operators.coalesce import capped_sessions
from camloom.plans.region_queries import _rounded
from camloom.sources.adapters import view
from tests.conftest import SMALL

T0 = dt.datetime(2026, 5, 16)


def plain_sessions(times, gap, most):
    out, first, before = [], None, None
    for t in times:
        if first is None or (t - before).total_seconds() > gap or (t - first).total_seconds() > most:
            out.append([t, t, 0])
            first = t
        before = t
        out[-1][1:] = [t, out[-1][2] + 1]
    return [tuple(x) for x in out]


@pytest.mark.parametrize(("gap", "most", "days"), [(10, 60, 1), (10, 35, 0.001), (1, 0, 0.0005), (1000, 7, 1)])
def test_sessions_cut_by_length(spark, gap, most, days):
    rng = random.Random(most)
    rows, expected = [], {}
    for camera, n in (("a", 900), ("b", 40), ("c", 1)):
        times, t = [], T0
        for _ in range(n):
            t += dt.timedelta(seconds=rng.choice([0, 1, 1, 3, 10, 11, 0.5]))
            times.append(t)
        rows += [(camera, t, f"{k:05d}") for k, t in enumerate(times)]
        expected[camera] = plain_sessions(times, gap, most)
    events = spark.createDataFrame(rows + [("a", None, "x"), (None, T0, "y")], "camera string, ts timestamp, event_id string").repartition(4)
    got = collections.defaultdict(list)
    for r in capped_sessions(events, gap, most, days=days, span=50).orderBy("camera", "session").collect():
        got[r.camera].append((r.first_ts, r.last_ts, r.n))
    assert got == expected and capped_sessions(events.limit(0), gap, most).count() == 0


def plain_accumulator(rows, cells, decay, gain):
    """frame -> the accumulator of every cell after it, for one camera."""
    by = collections.defaultdict(dict)
    for frame, cell, score in rows:
        by[frame][cell] = max(by[frame].get(cell, 0.0), score)
    acc, out = [0.0] * cells, {}
    for frame in range(min(by), max(by) + 1):
        acc = [min(255.0, a * decay + by.get(frame, {}).get(c, 0.0) * gain) for c, a in enumerate(acc)]
        if frame in by:
            out[frame] = acc
    return out


@pytest.mark.parametrize(("span", "part"), [(256, 64), (4, 5), (1, 1)])
def test_accumulated_in_ranges(spark, span, part):
    rng = random.Random(span)
    rows = [(camera, rng.choice([k, k, k + 30]), rng.randrange(12), rng.choice([0.0, 0.3, 1.0, 4.0])) for camera in ("a", "b") for k in range(60) for _ in range(5)]
    df = spark.createDataFrame([(*r, 1.0, None) for r in rows] + [("a", None, 1, 1.0, 0.0, 0.0), ("a", 1, 99, 1.0, 0.0, 0.0), (None, 1, 1, 1.0, 0.0, 0.0)], "camera string, frame long, cell int, score double, mv_x double, mv_y double")
    got = {(r.camera, r.frame): dict(zip(r.cell, r.acc, strict=True)) for r in RG.accumulated(df.repartition(5), 4, 3, threshold=100.0, span=span, part=part).collect()}
    for camera in ("a", "b"):
        expected = plain_accumulator([r[1:] for r in rows if r[0] == camera], 12, RG.DECAY, RG.GAIN)
        for frame, acc in expected.items():
            assert got.pop((camera, frame)) == pytest.approx({c: a for c, a in enumerate(acc) if a > 100.0})
    assert not got and RG.accumulated(df.limit(0), 4, 3).count() == 0


def plain_regions(cells, w, h):
    on = {(c % w, c // w) for c in cells}
    square = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    eroded = {(x, y) for x, y in on if all((x + dx, y + dy) in on for dx, dy in square)}
    left, out = {(x + dx, y + dy) for x, y in eroded for dx, dy in square}, []
    while left:
        todo, region = [min(left, key=lambda p: (p[1], p[0]))], set()
        while todo:
            p = todo.pop()
            if p in left:
                left.discard(p)
                region.add(p)
                todo += [(p[0] + dx, p[1] + dy) for dx, dy in square]
        out.append(region)
    return sorted(out, key=lambda r: (-len(r), min((y, x) for x, y in r)))


def test_regions_against_a_flood_fill(spark):
    rng, w, h = random.Random(3), 21, 17
    frames = []
    for k in range(120):
        on = set()
        for _ in range(rng.randrange(9)):
            x, y, a, b = rng.randrange(w), rng.randrange(h), rng.randint(1, 7), rng.randint(1, 7)
            on |= {(y + j) * w + x + i for i in range(a) for j in range(b) if x + i < w and y + j < h}
        on |= {rng.randrange(w * h) for _ in range(8)}
        frames.append(sorted(on))
    spiral = [y * w + x for y in range(h) for x in range(w) if y % 4 != 3 or (x >= w - 3 if y % 8 == 3 else x < 3)]
    frames += [spiral, list(range(w * h)), []]
    df = spark.createDataFrame([("c", k, f, [float(c) for c in f], [1.0] * len(f)) for k, f in enumerate(frames)], "camera string, frame long, cell array<int>, mv_x array<double>, mv_y array<double>").repartition(3)
    got = collections.defaultdict(list)
    for r in RG.regions(df, w, h, most=3).orderBy("frame", "rank").collect():
        got[r.frame].append(r)
    for k, cells in enumerate(frames):
        expected = [r for r in plain_regions(cells, w, h) if len(r) >= 8][:3]
        assert len(got[k]) == len(expected)
        for r, region in zip(got[k], expected, strict=True):
            xs, ys = [x for x, _ in region], [y for _, y in region]
            assert (r.mb_count, r.mb_x_min, r.mb_y_min, r.mb_x_max, r.mb_y_max) == (len(region), min(xs), min(ys), max(xs), max(ys))
            assert (r.centroid_x, r.centroid_y, r.mean_mv_x, r.mean_mv_y) == pytest.approx((np.mean(xs), np.mean(ys), np.mean([y * w + x for x, y in region]), 1.0))
    assert len(got[120]) == 1 and got[121][0].mb_count == w * h


def test_activity_and_gate(spark):
    rows = [(True, 99.0, 0.0, True, True), (False, 3.0, 4.0, False, False), (False, 300.0, 0.0, True, True)]
    df = spark.createDataFrame(rows, "s boolean, x double, y double, i boolean, r boolean")
    got = [r[0] for r in df.select(RG.activity(F.col("s"), F.col("x"), F.col("y"), F.col("i"), F.col("r"))).collect()]
    assert got == pytest.approx([0.0, 0.6 * 5 / 16, 1.0])
    gate = spark.createDataFrame([(True, None, "z=4"), (True, 8, "z=4"), (True, None, "z=4,unexpected_idr"), (False, 99, "")], "f boolean, n long, why string")
    assert [r[0] for r in gate.select(RG.spatial_gate(F.col("f"), F.col("n"), F.col("why"))).collect()] == [False, True, True, False]


def test_blocks_move_in_packed_rows(spark):
    """Repeated blocks of a frame in many small batches are told apart once more after the shuffle, which moves a row for each frame and batch."""
    rng = random.Random(8)
    rows = [("ab"[k % 2], k // 400, rng.randrange(12), rng.choice([0.0, 0.5, 1.0, 4.0]), float(rng.randrange(3)), 0.0) for k in range(4000)]
    df = spark.createDataFrame(rows, "camera string, frame long, cell int, score double, mv_x double, mv_y double").repartition(3)
    assert RG._packed(df, 12).count() <= 60
    most = {}
    for camera, frame, cell, *b in rows:
        most[camera, frame, cell] = max(most.get((camera, frame, cell), [-1.0]), b)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        table = RG.grids(df, 4, 3, span=4).where("part is null").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(table) == 20
    assert {(r.camera, r.frame, c): list(b) for r in table for c, *b in zip(r.cell, r.score, r.mv_x, r.mv_y, strict=True)} == most


def squares(rng, w, h, side, cameras="ab"):
    """Rows of squares with repeats, gaps and frames far apart, and the same as single blocks that lie in the grid."""
    rows = []
    for camera in cameras:
        for start in (-3, 595, 1195, 1700, 9000):
            rows += [(camera, start + rng.randrange(40), rng.randrange(w * h), rng.choice([0.0, 0.1, 0.3, 0.7, 1.0, 1.3]), float(rng.randrange(-2, 3)), float(rng.randrange(2))) for _ in range(150)]
    at = [(dx, dy) for dy in range(side) for dx in range(side)]
    single = [(c, f, cell + dy * w + dx, *v) for c, f, cell, *v in rows for dx, dy in at if cell % w + dx < w and cell // w + dy < h]
    return rows, single


BLOCKS = "camera string, frame long, cell int, score double, mv_x double, mv_y double"


@pytest.mark.parametrize(("per_batch", "side", "at_once"), [(10_000, 3, 1 << 18), (7, 3, 1 << 18), (100, 1, 300)])
def test_ranges_run_by_themselves(spark, monkeypatch, per_batch, side, at_once):
    """A range runs from what is left of the frames before it: every digit is that of one fold over a camera's frames."""
    monkeypatch.setattr(RG, "AT_ONCE", at_once)
    rows, single = squares(random.Random(side), 8, 7, side)
    odd = [("a", None, 1, 1.0, 0.0, 0.0), ("a", 1, 56, 1.0, 0.0, 0.0), ("a", 1, -1, 1.0, 0.0, 0.0), (None, 1, 1, 1.0, 0.0, 0.0), ("a", 1, 1, None, 0.0, 0.0), ("a", 1, None, 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows + odd, BLOCKS).repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(per_batch))
    try:
        got = {(r.camera, r.frame): r for r in RG.accumulated(df, 8, 7, threshold=20.0, span=600, side=side).collect()}
        found = sorted(tuple(r) for r in RG.block_regions(df, 8, 7, 9, 2, span=600, side=side).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    greatest = {}
    for camera, frame, cell, *b in single:
        greatest[camera, frame, cell] = max(greatest.get((camera, frame, cell), [-1.0]), b)
    for camera in "ab":
        for frame, acc in plain_accumulator([r[1:4] for r in single if r[0] == camera], 56, RG.DECAY, RG.GAIN).items():
            r, hit = got.pop((camera, frame)), [c for c, a in enumerate(acc) if a > 20.0]
            assert (r.cell, r.acc) == (hit, [acc[c] for c in hit])
            assert list(zip(r.mv_x, r.mv_y, strict=True)) == [tuple(greatest.get((camera, frame, c), [0, 0.0, 0.0])[1:]) for c in hit]
    maps = RG.accumulated(spark.createDataFrame(single, BLOCKS), 8, 7, span=4)
    assert not got and found == sorted(tuple(r) for r in RG.regions(maps, 8, 7, 9, 2).collect()) and (side == 1 or len(found) > 20)
    assert RG.accumulated(df.limit(0), 8, 7, side=side).count() == 0 and RG.block_regions(df.limit(0), 8, 7, side=side).count() == 0


def test_ranges_of_slow_decays_are_maps(spark):
    rows, single = squares(random.Random(5), 5, 4, 2, "a")
    df = spark.createDataFrame(rows, BLOCKS).repartition(3)
    assert RG.memory(0.85) < RG.RANGE < RG.memory(0.999) < RG.memory(1.0) == float("inf")
    expected = plain_accumulator([r[1:4] for r in single], 20, 0.999, 1.0)
    got = {r.frame: dict(zip(r.cell, r.acc, strict=True)) for r in RG.accumulated(df, 5, 4, 0.999, 1.0, 2.0, side=2).collect()}
    assert got == {f: pytest.approx({c: a for c, a in enumerate(acc) if a > 2.0}) for f, acc in expected.items()}


def test_squares_are_the_macroblocks(spark):
    names = ["camera", "frame", "cell", "mv_x", "mv_y", "skipped", "intra", "residual"]
    blocks, each = view(spark, SMALL, "macroblocks").select(names), RG._single(view(spark, SMALL, "block_squares"), 16, 13, 4).select(names)
    assert each.count() == blocks.count() and each.exceptAll(blocks).count() == 0


def test_activity_of_frames(spark):
    """Means, marks and largest regions come from one pass, a row for each frame that has any block."""
    rows, single = squares(random.Random(9), 8, 7, 3)
    got = {(r.camera, r.frame): tuple(r)[2:] for r in RG.frame_activity(spark.createDataFrame(rows, BLOCKS).repartition(3), 8, 7, lambda x, y: (x < 0) & (y == 0), 9, side=3).collect()}
    greatest = collections.defaultdict(dict)
    for camera, frame, cell, *b in single:
        greatest[camera, frame][cell] = max(greatest[camera, frame].get(cell, [-1.0]), b)
    maps = RG.accumulated(spark.createDataFrame(single, BLOCKS), 8, 7, span=4)
    largest = {(r.camera, r.frame): r.mb_count for r in RG.regions(maps, 8, 7, 9, 1).collect()}
    for key, blocks in greatest.items():
        mean, marked, most = got.pop(key)
        assert mean == functools.reduce(operator.add, (blocks[c][0] for c in sorted(blocks))) / len(blocks) and marked == any(x < 0 and y == 0 for _, x, y in blocks.values()) and most == largest.get(key)
    assert not got and largest


def test_six_digits(spark):
    df = spark.createDataFrame([(a,) for a in (128.0000005, 255.0, 200.1234564999, 134.2177275, 1 / 3)], "acc double")
    assert [r[0] for r in df.select(_rounded(F.col("acc"))).collect()] == [128.000001, 255.0, 200.123456, 134.217728, 0.333333]
