"""Units from RTP payloads: single ones as they are, aggregates split, fragments joined.

Packets are shuffled once, by ranges of a camera's sequence, and looked at in order: a fragment with the start bit begins a run, which goes on
without a gap until an end bit. So a camera with a third of all packets is many tasks. What a run leaves at a range's edges (the fragments before
its first start, and a run that is open at its end) are pieces, a few for each range, that are put together afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from camloom.functions.bitstream import byte_at, nal_type
from camloom.operators.running import SPAN, ranged
from camloom.sources.shared import scratch

#: Payload types of RFC 6184 and RFC 7798: aggregates, fragments, and the first and last of single units.
AGGREGATE = {"h264": 24, "h265": 48}
FRAGMENT = {"h264": 28, "h265": 49}
HEADER = {"h264": 1, "h265": 2}


def packet_kind(payload: Column, codec: str, donl: bool = False) -> Column:
    """single, aggregate, fragment, unsupported, or empty and short for payloads without the headers they need."""
    n, kind = F.coalesce(F.octet_length(payload), F.lit(0)), nal_type(byte_at(payload, 0), F.lit(codec))
    head = HEADER[codec]
    starts = byte_at(payload, head).bitwiseAND(0x80) > 0
    needed = F.when(starts, head + 3).otherwise(head + 1) if donl else F.lit(head + 1)
    single = kind.between(1, 23) if codec == "h264" else (kind < 48) | (kind > 50)
    out = F.when(n < head, "empty").when(kind == AGGREGATE[codec], "aggregate").when(kind == FRAGMENT[codec], F.when((n > head) & (n >= needed), "fragment").otherwise("short"))
    return out.when(single, "single").otherwise("unsupported")


def split_units(payload: bytes, codec: str, donl: bool = False) -> list[bytes]:
    """The units of an aggregate, as far as they are whole. donl: a decoding order number is before the first, a difference before the rest."""
    out, at = [], HEADER[codec] + (2 if donl else 0)
    while at + 2 + (1 if donl and out else 0) <= len(payload):
        at += 1 if donl and out else 0
        n = int.from_bytes(payload[at : at + 2], "big")
        at += 2
        if at + n > len(payload):
            break
        out.append(payload[at : at + n])
        at += n
    return out


NAMES = ["camera", "seq_long", "part", "timestamp", "marker", "nal", "q_range", "q_piece"]
#: Pieces of a run at a range's edges: its end before the range's first start, no end and no start in the range, its beginning.
ENDS, GOES_ON, BEGINS = 0, 1, 2
SINGLE, SPLIT, PART = 1, 2, 3


def _bytes(payload: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array, and where each of its values begins and the last ends; a null is empty."""
    buffers, n = payload.buffers(), len(payload)
    at = np.frombuffer(buffers[1], np.int32)[payload.offset : payload.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    return np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8), at


def _glued(data: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray, heads: np.ndarray) -> pa.BinaryArray:
    """A unit for each of heads (bytes, all of a length): its head and the parts from ``first`` to before the next unit's."""
    units, parts, width = len(first), len(begin), heads.shape[1]
    owner = np.repeat(np.arange(units), np.diff(np.append(first, parts)))
    start, length = np.empty(units + parts, np.int64), np.empty(units + parts, np.int64)
    of_part, of_head = np.arange(parts) + owner + 1, first + np.arange(units)
    start[of_part], length[of_part] = begin, end - begin
    start[of_head], length[of_head] = len(data) + np.arange(units) * width, width
    ends = np.cumsum(length)
    taken = np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
    offsets = np.append(0, ends)[np.append(of_head, units + parts)].astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), units, [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate([data, heads.reshape(-1)])[taken])])


def _kinds(data: np.ndarray, at: np.ndarray, codec: str, donl: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each payload SINGLE, SPLIT, PART or 0, and the first byte of it and of the fragment's header."""
    head, n = HEADER[codec], np.diff(at)
    padded = np.append(data, np.zeros(head + 1, np.uint8))
    first, second = np.where(n > 0, padded[at[:-1]], 0), np.where(n > head, padded[at[:-1] + head], 0)
    kind = first >> 1 & 63 if codec == "h265" else first & 31
    needed = np.where(second & 128 > 0, head + 3, head + 1) if donl else head + 1
    single = (kind > 0) & (kind < 24) if codec == "h264" else (kind < 48) | (kind > 50)
    out = np.select([n < head, kind == AGGREGATE[codec], kind == FRAGMENT[codec], single], [0, SPLIT, np.where(n >= needed, PART, 0), SINGLE], 0)
    return out, first, second


class _Range:
    """The packets of one range of a camera's sequence as they come in order. ``taken`` and ``closed`` give rows of NAMES."""

    def __init__(self, camera: object, kind: pa.DataType, q_range: int | None, codec: str, donl: bool, span: int) -> None:
        self.camera, self.kind, self.q_range, self.codec, self.donl, self.span = camera, kind, q_range, codec, donl, span
        self.loose = camera is None or q_range is None  # no sequence: no repeats, no runs
        self.last, self.waits = None, None  # the number before; fragments of the open run: number, timestamp, marker, payload
        self.open = self.from_before = False  # whether a run may go on, and whether it began before this range

    def rows(self, seq: pa.Array, part: np.ndarray, timestamp: pa.Array, marker: pa.Array, nal: pa.Array, piece: int | None = None) -> pa.RecordBatch:
        n = len(nal)
        camera = pa.nulls(n, self.kind) if self.camera is None else pa.array([self.camera], self.kind).take(pa.array(np.zeros(n, np.int64)))
        place = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())] if piece is None else [pa.array([self.q_range] * n, pa.int64()), pa.array([piece] * n, pa.int32())]
        return pa.RecordBatch.from_arrays([camera, seq, pa.array(part, pa.int64()), timestamp, marker, nal, *place], names=NAMES)

    def taken(self, seq: pa.Array, timestamp: pa.Array, marker: pa.Array, payload: pa.Array) -> Iterator[pa.RecordBatch]:
        gap = np.zeros(len(seq), bool)
        if not self.loose:
            number = seq.to_numpy()
            if self.last is None:
                self.open = self.from_before = bool(number[0] == self.q_range * self.span)
            before = np.append(number[0] - 1 if self.last is None else self.last, number[:-1])
            once = number != before
            if not once.all():
                seq, timestamp, marker, payload = (c.filter(pa.array(once)) for c in (seq, timestamp, marker, payload))
            gap, self.last = (number != before + 1)[once], number[-1]
        data, at = _bytes(payload)
        kind = _kinds(data, at, self.codec, self.donl)[0]
        if (single := np.flatnonzero(kind == SINGLE)).size:
            yield self.rows(*(c.take(pa.array(single)) if c is not None else np.zeros(len(single), np.int64) for c in (seq, None, timestamp, marker, payload)))
        if (split := np.flatnonzero(kind == SPLIT)).size:
            yield from self.split(*(c.take(pa.array(split)) for c in (seq, timestamp, marker, payload)))
        if not self.loose:
            chosen = pa.array(np.flatnonzero(kind == PART))
            yield from self.runs([c.take(chosen) for c in (seq, timestamp, marker, payload)], np.cumsum(gap)[chosen.to_numpy()], int(gap.sum()))

    def split(self, seq: pa.Array, timestamp: pa.Array, marker: pa.Array, payload: pa.Array) -> Iterator[pa.RecordBatch]:
        of, parts, last, units = [], [], [], []
        for k, whole in enumerate(payload.to_pylist()):
            found = split_units(whole, self.codec, self.donl)
            used = HEADER[self.codec] + 2 * len(found) + sum(map(len, found)) + (1 + len(found) if self.donl and found else 0)
            of += [k] * len(found)
            parts += range(len(found))
            last += [False] * (len(found) - 1) + [used >= len(whole)] if found else []
            units += found
        if units:
            of = pa.array(of, pa.int64())
            marked = pa.array(marker.take(of).to_numpy(zero_copy_only=False).astype(bool) & np.array(last))
            yield self.rows(seq.take(of), np.array(parts), timestamp.take(of), marked, pa.array(units, pa.binary()))

    def runs(self, fragments: list[pa.Array], gaps: np.ndarray, gaps_in_all: int) -> Iterator[pa.RecordBatch]:
        """gaps: those up to each fragment since the last packet before these."""
        if self.waits is not None:
            gaps = np.append(np.zeros(len(self.waits[0]), np.int64), gaps)
            fragments = [pa.concat_arrays([a, b]) for a, b in zip(self.waits, fragments, strict=True)]
        data, at = _bytes(fragments[3])
        _, first, second = _kinds(data, at, self.codec, self.donl)
        start, ends = np.flatnonzero(second & 128 > 0), np.flatnonzero(second & 64 > 0)
        goes_on = self.open and (self.waits is None or self.from_before)  # a run from before the range, without a start
        runs = np.append(0, start) if goes_on else start
        base = np.append(0, gaps[start]) if goes_on else gaps[start].copy()
        if not goes_on and self.waits is not None:
            base[0] = 0
        n = len(gaps)
        if len(runs):
            until, nth = np.append(runs[1:], n), np.searchsorted(ends, runs)
            end = np.append(ends, n)[nth]
            ended = end < until
            whole = np.flatnonzero(ended & (gaps[np.minimum(end, n - 1)] == base)) if n else np.zeros(0, np.int64)
            if goes_on and whole.size and whole[0] == 0:
                yield from self.piece(ENDS, fragments, data, at, second, 0, int(end[0]) + 1)
                whole = whole[1:]
            if whole.size:
                rows = np.repeat(runs[whole] - np.append(0, np.cumsum(end[whole] - runs[whole] + 1)[:-1]), end[whole] - runs[whole] + 1)
                rows = rows + np.arange(len(rows))
                firsts = np.append(0, np.cumsum(end[whole] - runs[whole] + 1)[:-1])
                nal = _glued(data, at[rows] + self.skip(second[rows]), at[rows + 1], firsts, self.head(first[runs[whole]], second[runs[whole]]))
                s, e = pa.array(runs[whole]), pa.array(end[whole])
                yield self.rows(fragments[0].take(e), np.zeros(len(nal), np.int64), fragments[1].take(s), fragments[2].take(e), nal)
            self.open = bool(not ended[-1] and gaps_in_all == base[-1])
            self.from_before = goes_on and len(runs) == 1
            self.waits = [c.slice(int(runs[-1])) for c in fragments] if self.open else None

    def skip(self, second: np.ndarray) -> np.ndarray:
        return HEADER[self.codec] + 1 + np.where(second & 128 > 0, 2, 0) * self.donl

    def head(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        made = [(second & 63) << 1, np.ones_like(second)] if self.codec == "h265" else [first & 224 | second & 31]
        return np.stack(made, axis=1).astype(np.uint8)

    def piece(self, piece: int, fragments: list[pa.Array], data: np.ndarray, at: np.ndarray, second: np.ndarray, a: int, b: int, head: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """Fragments a to b as one piece, with the timestamp of its first if it begins a run, else of its last."""
        heads = np.zeros((1, 0), np.uint8) if head is None else head
        nal = _glued(data, at[a:b] + self.skip(second[a:b]), at[a + 1 : b + 1], np.zeros(1, np.int64), heads)
        heads = [c.slice(b - 1, 1) if b > a else pa.nulls(1, c.type) for c in fragments[:3]]
        if piece == BEGINS:
            heads[1] = fragments[1].slice(a, 1)
        yield self.rows(heads[0], np.zeros(1, np.int64), heads[1], heads[2], nal, piece)

    def closed(self, types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        """The run that is open when the range is over, if its last number was there."""
        if self.open and self.last == (self.q_range + 1) * self.span - 1:
            fragments = self.waits or [pa.array([], t) for t in types]
            data, at = _bytes(fragments[3])
            _, first, second = _kinds(data, at, self.codec, self.donl)
            begins = not self.from_before
            yield from self.piece(BEGINS if begins else GOES_ON, fragments, data, at, second, 0, len(second), self.head(first[:1], second[:1]) if begins else None)


def _put_together(pieces: DataFrame) -> DataFrame:
    """Units of runs over more than one range: a beginning, ranges that go on, and an end, each in the range after the one before."""
    order = Window.partitionBy("camera").orderBy("q_range", "q_piece")
    linked = (F.lag("q_range").over(order) == F.col("q_range") - 1) & (F.lag("q_piece").over(order) != ENDS)
    begins = F.col("q_piece") == BEGINS
    rows = pieces.withColumns({"q_linked": begins | F.coalesce(linked, F.lit(False)), "q_run": F.sum(begins.cast("int")).over(order)})
    broken = F.sum((~F.col("q_linked")).cast("int")).over(Window.partitionBy("camera", "q_run").orderBy("q_range", "q_piece"))
    runs = rows.withColumn("q_broken", broken).where("q_run > 0 and q_broken = 0").groupBy("camera", "q_run")
    ends = F.col("q_piece") == ENDS
    units = runs.agg(
        F.max(F.when(ends, F.col("seq_long"))).alias("seq_long"), F.max(F.when(begins, F.col("timestamp"))).alias("timestamp"), F.max(F.when(ends, F.col("marker"))).alias("marker"),
        F.max(ends).alias("q_whole"), F.sort_array(F.collect_list(F.struct("q_range", "nal"))).alias("q_parts"),
    )
    nal = F.unhex(F.array_join(F.transform("q_parts", lambda p: F.hex(p["nal"])), ""))
    return units.where("q_whole").select("camera", "seq_long", F.lit(0).cast("long").alias("part"), "timestamp", "marker", nal.alias("nal"))


def depacketized(packets: DataFrame, codec: str = "h264", donl: bool = False, span: int = SPAN, order: str | None = None) -> DataFrame:
    """(camera, seq_long, timestamp, marker, payload), each packet once -> camera, seq_long, part, timestamp, marker, nal.

    seq_long is the packet that a unit was complete with, part its place in an aggregate. A unit of fragments has the time of its first
    and the marker of its last packet; the marker of an aggregate goes to its last unit. Runs with a gap, without a start or
    without an end give nothing, nor do payloads that are null, empty, short or of other kinds. Without a marker column it is false. An empty table
    gives an empty result. Where ``order`` names a column packets may be repeated, and of equal numbers the first in that order counts.
    """
    marker = F.coalesce("marker", F.lit(False)) if "marker" in packets.columns else F.lit(False)
    kind = packets.schema["camera"].dataType.simpleString()
    keys, along = ["camera", "q_range"], ["seq_long", *([order] if order else [])]
    typed = packets.select("camera", F.col("seq_long").cast("long"), F.col("timestamp").cast("long"), marker.alias("marker"), F.col("payload").cast("binary"), *along[1:])
    rows = ranged(typed, "seq_long", span).repartition(*keys).sortWithinPartitions(*keys, *along)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, types = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            types = [f.type for f in batch.schema][2:]
            code, q_range = batch.column(0).dictionary_encode().indices.fill_null(-1).to_numpy(), batch.column(1).fill_null(np.iinfo(np.int64).min).to_numpy()
            cuts = [0, *(np.flatnonzero((code[1:] != code[:-1]) | (q_range[1:] != q_range[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                camera, place = part.column(0)[0].as_py(), part.column(1)[0].as_py()
                if now is None or (camera, place) != (now.camera, now.q_range):
                    if now is not None:
                        yield from now.closed(types)
                    now = _Range(camera, batch.schema.field(0).type, place, codec, donl, span)
                yield from now.taken(*part.columns[2:])
        if now is not None:
            yield from now.closed(types)

    schema = f"camera {kind}, seq_long long, part long, timestamp long, marker boolean, nal binary, q_range long, q_piece int"
    units = scratch(rows.select(*keys, "seq_long", "timestamp", "marker", "payload").mapInArrow(run, schema), "units")
    return units.where("q_piece is null").select(NAMES[:6]).unionByName(_put_together(units.where("q_piece is not null")))
