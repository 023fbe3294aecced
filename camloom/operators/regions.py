"""Where a picture moves: activity of blocks over time, cleaned maps, and connected regions.

Each block of a camera's grid has an accumulator: acc = min(255, acc * decay + score * gain) at each frame (scores are never
negative, so the lower bound of 0 is never met). What an accumulator held has faded to nothing after ``memory`` frames, so frames are cut into
ranges, and each range runs by itself from as many frames before it: blocks are shuffled once, and a camera with a third of all frames is many tasks.

Where an accumulator fades too slowly for that, ranges go as maps. A frame maps acc to min(hi, a * acc + b), and such maps compose to one of the same
form: each range becomes one map a block (a side by side task), the maps run over the ranges of a camera and part of its grid, and then the frames
of a range run from the value it begins with. The middle step holds a few numbers for each range.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from camloom.sources.shared import scratch

DECAY, GAIN, TOP = 0.85, 64.0, 255.0
THRESHOLD, MIN_BLOB, MOST = 128.0, 8, 8
MV_CLIP, MV_WEIGHT, INTRA_WEIGHT, RESIDUAL_WEIGHT = 16.0, 0.6, 0.3, 0.1
#: Frames of a range that runs by itself; of a range that becomes maps, and blocks of the grid that run over the ranges in one task.
RANGE, SPAN, PART = 4096, 256, 64
#: What an accumulator fades to before it counts as nothing: far below the last digit of a score.
FADED = 1e-30
#: Blocks of frames that are held, and whose regions are told, at once.
AT_ONCE = 1 << 18


def activity(skipped: Column, mv_x: Column, mv_y: Column, intra: Column, residual: Column) -> Column:
    """The score of a block, from 0 to 1: how far it moves, and whether it is coded anew or has a residual; 0 for a skipped one."""
    length = F.sqrt(mv_x * mv_x + mv_y * mv_y)
    score = F.lit(MV_WEIGHT) * F.least(length, F.lit(MV_CLIP)) / F.lit(MV_CLIP) + F.when(intra, INTRA_WEIGHT).otherwise(0.0) + F.when(residual, RESIDUAL_WEIGHT).otherwise(0.0)
    return F.when(skipped, 0.0).otherwise(score)


LISTS = ("score", "mv_x", "mv_y")


def _greatest(place: np.ndarray, values: list[np.ndarray]) -> np.ndarray:
    """For each place, in order, where its greatest (score, mv_x, mv_y) is."""
    order = np.lexsort((*reversed(values), place))
    return order[np.append(place[order][1:] != place[order][:-1], True)] if len(order) else order


def _lists(lengths: np.ndarray, cell: np.ndarray, values: list[np.ndarray]) -> list[pa.Array]:
    ends = pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32))
    return [pa.ListArray.from_arrays(ends, pa.array(v, kind)) for v, kind in ((cell, pa.int32()), *((v, pa.float64()) for v in values))]


def _packed(blocks: DataFrame, cells: int) -> DataFrame:
    """Blocks as a row for each (camera, frame) of an Arrow batch, so that a frame moves in few rows: camera, frame, cell, score, mv_x, mv_y."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                frame, cell, *values = (batch.column(k).to_numpy() for k in range(1, 6))
                frames, at = np.unique(frame, return_inverse=True)
                code = batch.column(0).dictionary_encode().indices.to_numpy().astype(np.int64)
                _, first, group = np.unique(code * len(frames) + at, return_index=True, return_inverse=True)
                kept = _greatest(group * cells + cell, values)
                lists = _lists(np.bincount(group[kept], minlength=len(first)), cell[kept], [v[kept] for v in values])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first)), pa.array(frame[first]), *lists], names=["camera", "frame", "cell", *LISTS])

    kind = blocks.schema["camera"].dataType.simpleString()
    rows = blocks.select("camera", F.col("frame").cast("long"), F.col("cell").cast("int"), *(F.col(c).cast("double") for c in LISTS))
    return rows.mapInArrow(run, f"camera {kind}, frame long, cell array<int>, score array<double>, mv_x array<double>, mv_y array<double>")


def _sorted(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def grids(blocks: DataFrame, width: int, height: int, span: int = SPAN, decay: float = DECAY, gain: float = GAIN, part: int = PART) -> DataFrame:
    """(camera, frame, cell, score, mv_x, mv_y), of repeated blocks the greatest -> a table of two kinds of rows, written once.

    A row for each frame that has any block: camera, q_range, frame, and of its blocks cell, score, mv_x, mv_y. And each range of frames as a map
    of the accumulator, a row for each ``part`` blocks: camera, q_range, part, b, hi (a is decay ** span). Blocks are shuffled once, as packed rows.
    """
    cells = width * height
    valid = blocks.where(F.col("camera").isNotNull() & F.col("frame").isNotNull() & F.col("score").isNotNull() & F.col("cell").between(0, cells - 1))
    packed = _packed(valid.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("mv_x", "mv_y")}), cells)
    kind, names = packed.schema["camera"].dataType.simpleString(), ["camera", "q_range", "frame", "cell", *LISTS, "part", "b", "hi"]
    doubles = pa.list_(pa.float64())

    def merged(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Rows of one frame, which are next to each other, as one."""
        code, frame = batch.column("camera").dictionary_encode().indices.to_numpy(), batch.column("frame").to_numpy()
        fresh = np.append(True, (code[1:] != code[:-1]) | (frame[1:] != frame[:-1]))
        group = np.repeat(np.cumsum(fresh) - 1, batch.column("cell").value_lengths().to_numpy())
        cell, *values = (batch.column(c).flatten().to_numpy() for c in ("cell", *LISTS))
        kept = _greatest(group * cells + cell, values)
        first = np.flatnonzero(fresh)
        lists = _lists(np.bincount(group[kept], minlength=len(first)), cell[kept], [v[kept] for v in values])
        return pa.RecordBatch.from_arrays([batch.column("camera").take(pa.array(first)), pa.array(frame[first]), *lists], names=["camera", "frame", "cell", *LISTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, b, hi, waiting, camera_kind = None, 0, None, None, None, pa.string()
        starts = range(0, cells, part)

        def closed() -> list[tuple]:
            fade = decay ** ((key[1] + 1) * span - 1 - at)
            return [(key[0], key[1], n, b[s : s + part] * fade, hi[s : s + part] * fade) for n, s in enumerate(starts)]

        def maps(rows: list[tuple]) -> pa.RecordBatch:
            camera, q_range, n, *ends = zip(*rows, strict=True)
            heads = [pa.array(camera, camera_kind), pa.array(q_range, pa.int64()), pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.list_(pa.int32())), *(pa.nulls(len(rows), doubles) for _ in LISTS)]
            return pa.RecordBatch.from_arrays([*heads, pa.array(n, pa.int64()), *(pa.array(v, doubles) for v in ends)], names=names)

        def done(frames: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            nonlocal key, at, b, hi
            out, frame, q_range = [], frames.column("frame").to_numpy(), frames.column("frame").to_numpy() // span
            ends = frames.column("cell").offsets.to_numpy() - frames.column("cell").offsets[0].as_py()
            cell, score = frames.column("cell").flatten().to_numpy(), frames.column("score").flatten().to_numpy() * gain
            for k, camera in enumerate(frames.column("camera").to_pylist()):
                if (camera, q_range[k]) != key:
                    if key is not None:
                        out += closed()
                    key, at, b, hi = (camera, q_range[k]), q_range[k] * span - 1, np.zeros(cells), np.full(cells, TOP)
                add = np.zeros(cells)
                add[cell[ends[k] : ends[k + 1]]] = score[ends[k] : ends[k + 1]]
                fade = decay ** float(frame[k] - at)
                b, hi, at = b * fade + add, np.minimum(TOP, hi * fade + add), frame[k]
            none = [pa.nulls(len(frame), t) for t in (pa.int64(), doubles, doubles)]
            yield pa.RecordBatch.from_arrays([frames.column("camera"), pa.array(q_range), *frames.columns[1:], *none], names=names)
            if out:
                yield maps(out)

        for batch in batches:
            if batch.num_rows:
                camera_kind = batch.schema.field("camera").type
                rows = batch if waiting is None else pa.Table.from_batches([waiting, batch.cast(waiting.schema)]).combine_chunks().to_batches()[0]
                frames = merged(rows)
                waiting = frames.slice(frames.num_rows - 1)  # the next batch may have more of it
                if frames.num_rows > 1:
                    yield from done(frames.slice(0, frames.num_rows - 1))
        if waiting is not None:
            yield from done(waiting)
            yield maps(closed())

    placed = _sorted(packed.withColumn("q_range", F.floor(F.col("frame") / span)), ["camera", "q_range"], ["frame"]).drop("q_range")
    return scratch(placed.mapInArrow(run, f"camera {kind}, q_range long, frame long, cell array<int>, score array<double>, mv_x array<double>, mv_y array<double>, part long, b array<double>, hi array<double>"), "grids")


def entries(maps: DataFrame, span: int, decay: float) -> DataFrame:
    """The accumulator that each range begins with: camera, q_range, part, acc. One map after the other, for each camera and part of the grid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, acc = None, 0, None
        for batch in batches:
            out = []
            for camera, part, q_range, b, hi in zip(*(batch.column(c).to_pylist() for c in ("camera", "part", "q_range")), batch.column("b"), batch.column("hi"), strict=True):
                b, hi = (x.values.to_numpy() for x in (b, hi))
                if (camera, part) != key:
                    key, at, acc = (camera, part), q_range, np.zeros(len(b))
                acc = acc * decay ** (span * (q_range - at))
                out.append(acc)
                acc, at = np.minimum(hi, acc * decay**span + b), q_range + 1
            yield pa.RecordBatch.from_arrays([batch.column("camera"), batch.column("q_range"), batch.column("part"), pa.array(out, pa.list_(pa.float64()))], names=["camera", "q_range", "part", "acc"])

    kind = maps.schema["camera"].dataType.simpleString()
    return _sorted(maps, ["camera", "part"], ["q_range"]).mapInArrow(run, f"camera {kind}, q_range long, part long, acc array<double>")


def memory(decay: float) -> float:
    """Frames after which the greatest accumulator has faded; infinite if it does not."""
    return math.ceil(math.log(FADED / TOP) / math.log(decay)) if 0 < decay < 1 else 1 if decay == 0 else math.inf


def _single(blocks: DataFrame, width: int, height: int, side: int) -> DataFrame:
    """Squares of side x side blocks as rows of one block; what lies beyond the grid's edges is left out."""
    if side == 1:
        return blocks
    x, y, step = F.col("cell") % width, F.floor(F.col("cell") / width), F.explode(F.sequence(F.lit(0), F.lit(side * side - 1)))
    dx, dy = F.col("q_step") % side, F.floor(F.col("q_step") / side)
    each = blocks.withColumn("q_step", step).where((x + dx < width) & (y + dy < height))
    return each.withColumn("cell", (F.col("cell") + dy * width + dx).cast("int")).drop("q_step")


class Frames(NamedTuple):
    """Whole frames one after the other: accumulators by (frame, block of the grid), and there the place of a block's row in score, mv_x and mv_y.

    A block without a row has place -1, the last, where there is a 0.
    """

    camera: pa.Array
    frame: np.ndarray
    acc: np.ndarray
    place: np.ndarray
    score: np.ndarray
    mv_x: np.ndarray
    mv_y: np.ndarray


def folded(blocks: DataFrame, width: int, height: int, each: Callable[[Frames], pa.RecordBatch], schema: str, decay: float = DECAY, gain: float = GAIN, span: int = RANGE, side: int = 1) -> DataFrame:
    """What ``each`` makes of the frames of (camera, frame, cell, score, mv_x, mv_y), of repeated blocks the greatest, with their accumulators.

    A row is a square of ``side`` blocks each way, from its cell to the right and down. Ranges are at least as long as an accumulator's memory.
    """
    cells, before = width * height, memory(decay)
    span = max(span, before)
    valid = blocks.where(F.col("camera").isNotNull() & F.col("frame").isNotNull() & F.col("score").isNotNull() & F.col("cell").between(0, cells - 1))
    rows = valid.select("camera", F.col("frame").cast("long"), F.col("cell").cast("int"), F.col("score").cast("double"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in LISTS[1:]))
    ranges = F.sequence(F.floor(F.col("frame") / span), F.floor((F.col("frame") + before) / span))
    placed = _sorted(rows.withColumn("q_range", F.explode(ranges)), ["camera", "q_range"], ["frame"])
    step = np.arange(side * side)
    dx, dy = step % side, step // side

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, acc, kind = None, 0, np.zeros(cells), None
        head, open_cells, open_values = None, np.zeros(0, np.int64), [np.zeros(0)] * 3  # the frame that the next rows may have more of

        def close(heads: list[tuple], index: np.ndarray, values: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            nonlocal key, at, acc
            values = [np.append(v, 0.0) for v in values]
            past, gained, own = np.empty(index.shape), (values[0] * gain)[index], np.empty(len(heads), bool)
            for k, (camera, q_range, frame) in enumerate(heads):
                if (camera, q_range) != key:
                    key, at, acc = (camera, q_range), frame, np.zeros(cells)
                if frame - at >= before:
                    acc[:] = 0.0
                else:
                    for _ in range(frame - at):
                        np.multiply(acc, decay, out=acc)
                np.add(acc, gained[k], out=acc)
                np.minimum(acc, TOP, out=acc)
                past[k], at, own[k] = acc, frame, frame // span == q_range
            if own.any():
                camera, _, frame = zip(*(h for h, mine in zip(heads, own, strict=True) if mine), strict=True)
                rows = slice(None) if own.all() else own
                yield each(Frames(pa.array(camera, kind), np.array(frame, np.int64), past[rows], index[rows], *values))

        def taken(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            nonlocal head, open_cells, open_values
            code, (q_range, frame, cell) = part.column(0).dictionary_encode().indices.to_numpy(), (part.column(k).to_numpy() for k in (1, 2, 3))
            fresh = np.append(True, (code[1:] != code[:-1]) | (q_range[1:] != q_range[:-1]) | (frame[1:] != frame[:-1]))
            first = np.flatnonzero(fresh)
            heads = list(zip(part.column(0).take(pa.array(first)).to_pylist(), q_range[first].tolist(), frame[first].tolist(), strict=True))
            slot, kept = np.cumsum(fresh) - 1, len(open_cells)
            if head is not None and head != heads[0]:
                heads, slot = [head, *heads], slot + 1
            values = [np.concatenate([old, part.column(k).to_numpy()]) for k, old in zip((4, 5, 6), open_values, strict=True)]
            place, own = (slot * cells + cell)[:, None] + dy * width + dx, np.ones((len(cell), side * side), bool)
            if side > 1:
                own = (cell[:, None] % width + dx < width) & (cell[:, None] // width + dy < height)
            order = np.lexsort(values[::-1])  # the greatest of a place comes last, and stays
            index = np.full(len(heads) * cells, -1)
            late = order[order >= kept] - kept
            number = np.broadcast_to(late[:, None] + kept, (len(late), side * side))
            index[place[late][own[late]]] = number[own[late]]
            if kept:
                rank = np.empty(len(order) + 1, np.int64)
                rank[order], rank[-1] = np.arange(len(order)), -1
                better = rank[:kept] > rank[index[open_cells]]
                index[open_cells[better]] = np.flatnonzero(better)
            index = index.reshape(len(heads), cells)
            if len(heads) > 1:
                yield from close(heads[:-1], index[:-1], values)
            head, open_cells = heads[-1], np.flatnonzero(index[-1] >= 0)
            open_values = [v[index[-1][open_cells]] for v in values]

        most = max(1, AT_ONCE // cells)
        for batch in batches:
            if batch.num_rows:
                kind = batch.schema.field("camera").type
                frame = batch.column(2).to_numpy()
                ends = np.flatnonzero(frame[1:] != frame[:-1]) + 1
                cuts = [0, *ends[most - 1 :: most].tolist(), batch.num_rows]
                for a, b in zip(cuts, cuts[1:]):
                    yield from taken(batch.slice(a, b - a))
        if head is not None:
            index = np.full((1, cells), -1)
            index[0, open_cells] = np.arange(len(open_cells))
            yield from close([head], index, open_values)

    return placed.select("camera", "q_range", "frame", "cell", *LISTS).mapInArrow(run, schema)


def accumulated(blocks: DataFrame, width: int, height: int, decay: float = DECAY, gain: float = GAIN, threshold: float = THRESHOLD, span: int = RANGE, part: int = PART, side: int = 1) -> DataFrame:
    """camera, frame, and of its blocks above the threshold: cell (y * width + x), acc, mv_x, mv_y (0 where the frame has no row of it).

    A row for each frame that has any block, also where none is above. Frames without rows let the accumulators fade. Cells outside
    the grid, and null cameras, frames, cells or scores, are left out. An empty table gives an empty result. A row may be a square
    of ``side`` blocks each way, from its cell to the right and down.
    """
    if memory(decay) > span:  # ranges as maps
        single = _single(blocks, width, height, side)
        return accumulated_grids(grids(single, width, height, min(span, SPAN), decay, gain, part), width, height, decay, gain, threshold, min(span, SPAN), part)

    def each(f: Frames) -> pa.RecordBatch:
        hit = f.acc > threshold
        place = f.place[hit]
        lists = _lists(hit.sum(axis=1), np.flatnonzero(hit) % hit.shape[1], [f.acc[hit], f.mv_x[place], f.mv_y[place]])
        return pa.RecordBatch.from_arrays([f.camera, pa.array(f.frame), *lists], names=["camera", "frame", "cell", "acc", "mv_x", "mv_y"])

    kind = blocks.schema["camera"].dataType.simpleString()
    return folded(blocks, width, height, each, f"camera {kind}, frame long, cell array<int>, acc array<double>, mv_x array<double>, mv_y array<double>", decay, gain, span, side)


def accumulated_grids(table: DataFrame, width: int, height: int, decay: float = DECAY, gain: float = GAIN, threshold: float = THRESHOLD, span: int = SPAN, part: int = PART) -> DataFrame:
    """``accumulated`` of what ``grids`` wrote with the same settings."""
    cells, frames = width * height, table.where("part is null")
    begun = entries(table.where("part is not null").select("camera", "part", "q_range", "b", "hi"), span, decay)
    kind = frames.schema["camera"].dataType.simpleString()
    asked = begun.select("camera", "q_range", F.lit(None).cast("long").alias("frame"), F.col("part").alias("part"), F.lit(None).cast("array<int>").alias("cell"), F.col("acc").alias("score"), *(F.lit(None).cast("array<double>").alias(c) for c in LISTS[1:]))
    both = asked.unionByName(frames.select("camera", "q_range", "frame", "part", "cell", *LISTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, acc = None, 0, np.zeros(cells)
        for batch in batches:
            keys, out = [], [[] for _ in range(4)]
            columns = [batch.column(c).to_pylist() for c in ("camera", "q_range", "frame", "part")]
            for camera, q_range, frame, begins, *rest in zip(*columns, *(batch.column(c) for c in ("cell", *LISTS)), strict=True):
                if (camera, q_range) != key:
                    key, at, acc = (camera, q_range), q_range * span - 1, np.zeros(cells)
                if frame is None:  # what this part of the grid begins with; sorted before the frames
                    values = rest[1].values.to_numpy()
                    acc[begins * part : begins * part + len(values)] = values
                    continue
                cell, score, x, y = (r.values.to_numpy() for r in rest)
                add, mv_x, mv_y = np.zeros(cells), np.zeros(cells), np.zeros(cells)
                add[cell], mv_x[cell], mv_y[cell] = score * gain, x, y
                acc, at = np.minimum(TOP, acc * decay ** (frame - at) + add), frame
                hit = np.flatnonzero(acc > threshold)
                keys.append((camera, frame))
                for o, values in zip(out, (hit, acc[hit], mv_x[hit], mv_y[hit]), strict=True):
                    o.append(values)
            if keys:
                heads = [pa.array([k[0] for k in keys], batch.schema.field("camera").type), pa.array([k[1] for k in keys], pa.int64())]
                cell, *values = map(np.concatenate, out)
                yield pa.RecordBatch.from_arrays([*heads, *_lists(np.array([len(o) for o in out[0]]), cell, values)], names=["camera", "frame", "cell", "acc", "mv_x", "mv_y"])

    placed = _sorted(both.select("camera", "q_range", "frame", "part", "cell", *LISTS), ["camera", "q_range"], ["frame", "part"])
    return placed.mapInArrow(run, f"camera {kind}, frame long, cell array<int>, acc array<double>, mv_x array<double>, mv_y array<double>")


def _nine(op: np.ufunc, maps: np.ndarray, fill: object) -> np.ndarray:
    """The operation over each block of the maps (frames, rows, columns) and its eight neighbours; beyond the edge is ``fill``."""
    wide = np.pad(maps, ((0, 0), (1, 1), (1, 1)), constant_values=fill)
    rows = op(op(wide[:, :-2], wide[:, 1:-1]), wide[:, 2:])
    return op(op(rows[:, :, :-2], rows[:, :, 1:-1]), rows[:, :, 2:])


def opened(maps: np.ndarray) -> np.ndarray:
    """Erosion, then dilation, by 3 x 3: what stays is covered by full squares of nine."""
    return _nine(np.logical_or, _nine(np.logical_and, maps, False), False)


def labelled(maps: np.ndarray) -> np.ndarray:
    """For each block the least place (in its frame) of its region, blocks that touch at a side or corner; -1 outside."""
    n, h, w = maps.shape
    none = h * w
    kind = np.int16 if none < 1 << 15 else np.int64
    out = np.where(maps, np.arange(none, dtype=kind).reshape(1, h, w), kind(none))
    left = np.flatnonzero(maps.reshape(n, none).any(axis=1))
    while len(left):  # frames whose labels still change
        label, inside = out[left], maps[left]
        least = np.where(inside, _nine(np.minimum, label, kind(none)), kind(none))
        flat = np.concatenate([least.reshape(len(left), none), np.full((len(left), 1), none, kind)], axis=1)
        jumped = np.take_along_axis(flat, flat[:, :none], axis=1).reshape(label.shape)  # a label's own label is no greater
        moved = (jumped != label).reshape(len(left), none).any(axis=1)
        out[left] = jumped
        left = left[moved]
    return np.where(maps, out, -1)


REGION = {"rank": pa.int32(), "mb_count": pa.int64(), "mb_x_min": pa.int32(), "mb_y_min": pa.int32(), "mb_x_max": pa.int32(), "mb_y_max": pa.int32(), "centroid_x": pa.float64(), "centroid_y": pa.float64(), "mean_mv_x": pa.float64(), "mean_mv_y": pa.float64()}
REGION_DDL = "rank int, mb_count long, mb_x_min int, mb_y_min int, mb_x_max int, mb_y_max int, centroid_x double, centroid_y double, mean_mv_x double, mean_mv_y double"


def _found(hit: np.ndarray, width: int, moves: Callable[[np.ndarray], list[np.ndarray]], min_blob: int, most: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Regions of maps (frames, blocks): the frame of each, and what REGION names. ``moves`` gives mv_x and mv_y at places of the flat maps."""
    n, cells = hit.shape
    label = labelled(opened(hit.reshape(n, cells // width, width))).reshape(-1)
    at = np.flatnonzero(label >= 0)
    own = at // cells * cells + label[at]
    key = at[own == at]  # a region begins at its least place
    number = np.empty(n * cells, np.int64)
    number[key] = np.arange(len(key))
    group = number[own]
    count = np.bincount(group, minlength=len(key))
    x, y = at % cells % width, at % cells // width
    sums = [np.bincount(group, v, len(key)) for v in (x, y, *moves(at))]
    low, high = ([np.full(len(key), s) for _ in range(2)] for s in (cells, -1))
    for v, (lo, hi) in zip((x, y), zip(low, high, strict=True), strict=True):
        np.minimum.at(lo, group, v)
        np.maximum.at(hi, group, v)
    order = np.lexsort((key, -count, key // cells))
    order = order[count[order] >= min_blob]
    owner = key[order] // cells
    rank = np.arange(len(order)) - np.searchsorted(owner, owner) + 1
    order, owner, rank = order[rank <= most], owner[rank <= most], rank[rank <= most]
    return owner, [rank, count[order], low[0][order], low[1][order], high[0][order], high[1][order], *(s[order] / count[order] for s in sums)]


def _region_rows(camera: pa.Array, frame: pa.Array, owner: np.ndarray, values: list[np.ndarray]) -> pa.RecordBatch:
    heads = [c.take(pa.array(owner)) for c in (camera, frame)]
    return pa.RecordBatch.from_arrays([*heads, *(pa.array(v, kind) for v, kind in zip(values, REGION.values(), strict=True))], names=["camera", "frame", *REGION])


def regions(maps: DataFrame, width: int, height: int, min_blob: int = MIN_BLOB, most: int = MOST) -> DataFrame:
    """(camera, frame, cell, mv_x, mv_y) -> the regions of each frame's cleaned map: camera, frame, rank, and what REGION names.

    Regions of fewer than min_blob blocks are left out, and all but the ``most`` largest (of equals, those that begin first). Frames
    without a region give no row. A frame is looked at by itself, wherever its row is.
    """

    def of(batch: pa.RecordBatch, first: int, last: int) -> pa.RecordBatch:
        n, cells = last - first, width * height
        part = batch.slice(first, n)
        lists = part.column("cell")
        frame = np.repeat(np.arange(n), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        place = frame * cells + lists.flatten().to_numpy()
        hit, mv_x, mv_y = np.zeros(n * cells, bool), np.zeros(n * cells), np.zeros(n * cells)
        hit[place], mv_x[place], mv_y[place] = True, part.column("mv_x").flatten().to_numpy(), part.column("mv_y").flatten().to_numpy()
        return _region_rows(part.column("camera"), part.column("frame"), *_found(hit.reshape(n, cells), width, lambda at: [mv_x[at], mv_y[at]], min_blob, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, AT_ONCE // (width * height))
        for batch in batches:
            for first in range(0, batch.num_rows, step):
                yield of(batch, first, min(first + step, batch.num_rows))

    kind = maps.schema["camera"].dataType.simpleString()
    return maps.select("camera", "frame", "cell", "mv_x", "mv_y").mapInArrow(run, f"camera {kind}, frame long, {REGION_DDL}")


def _of_frames(f: Frames, width: int, min_blob: int, most: int) -> tuple[np.ndarray, list[np.ndarray]]:
    place = f.place.reshape(-1)
    return _found(f.acc > THRESHOLD, width, lambda at: [f.mv_x[place[at]], f.mv_y[place[at]]], min_blob, most)


def block_regions(blocks: DataFrame, width: int, height: int, min_blob: int = MIN_BLOB, most: int = MOST, span: int = RANGE, side: int = 1) -> DataFrame:
    """``regions`` of ``accumulated`` with the usual decay, gain and threshold, told where blocks are accumulated."""

    def each(f: Frames) -> pa.RecordBatch:
        return _region_rows(f.camera, pa.array(f.frame), *_of_frames(f, width, min_blob, most))

    kind = blocks.schema["camera"].dataType.simpleString()
    return folded(blocks, width, height, each, f"camera {kind}, frame long, {REGION_DDL}", span=span, side=side)


def frame_activity(blocks: DataFrame, width: int, height: int, marked: Callable[[np.ndarray, np.ndarray], np.ndarray], min_blob: int = MIN_BLOB, span: int = RANGE, side: int = 1) -> DataFrame:
    """A row for each frame that has any block: camera, frame, mean (of its blocks' scores, in the grid's order), marked (whether any block's mv_x and
    mv_y are), largest (blocks of its largest region, of min_blob at least; else null)."""

    def each(f: Frames) -> pa.RecordBatch:
        given = f.place >= 0
        mean = np.cumsum(f.score[f.place], axis=1)[:, -1] / given.sum(axis=1)
        owner, values = _of_frames(f, width, min_blob, 1)
        largest = np.zeros(len(mean), np.int64)
        largest[owner] = values[1]
        any_marked = (np.append(marked(f.mv_x[:-1], f.mv_y[:-1]), False)[f.place]).any(axis=1)
        return pa.RecordBatch.from_arrays([f.camera, pa.array(f.frame), pa.array(mean), pa.array(any_marked), pa.array(largest, mask=largest == 0)], names=["camera", "frame", "mean", "marked", "largest"])

    kind = blocks.schema["camera"].dataType.simpleString()
    return folded(blocks, width, height, each, f"camera {kind}, frame long, mean double, marked boolean, largest long", span=span, side=side)


def spatial_gate(fires: Column, largest: Column, reason: Column, min_blob: int = MIN_BLOB) -> Column:
    """An event fires only with a region of min_blob blocks or more, but for an unexpected keyframe, whose picture tells nothing."""
    return fires & ((F.coalesce(largest, F.lit(0)) >= min_blob) | reason.contains("unexpected_idr"))
