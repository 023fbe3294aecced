"""Media columns: baseline JPEG written, parsed and decoded to DC-only luminance thumbnails in numpy.

The decoder handles any baseline Huffman JPEG (one or more components, any tables, sampling and restart interval): it parses
the markers, then decodes all restart intervals of all images with equal tables side by side, a lane each. The encoder makes
an image in which every 8 x 8 block is flat and its DC coefficient one sample, so the thumbnail is the stored payload,
exactly: a row of 64 samples is a restart interval, and 64 x 8191 samples are the most in one image; longer payloads go
on in further images of the same stream.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from camloom.llm.common import text_of

ROW, MOST_ROWS = 64, 8191
#: Payload bytes encoded, and media bytes decoded, at once: bounds a worker's memory. A single text may be larger.
BLOCK = 2 << 20
#: Code lengths of the DC size categories 0 to 8, short for those frequent in text; the AC table has the end of block only.
DC_LENGTHS = (4, 4, 4, 3, 2, 4, 4, 2, 5)
DC_QUANTUM = 8


# ---------------------------------------------------------------- writing


def huffman_codes(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(symbol, code, length), canonical, from a DHT segment's 16 counts and its symbols."""
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out.append((s, code, length))
            code += 1
        at += n
        code <<= 1
    return out


def _dc_table() -> tuple[bytes, bytes]:
    symbols = sorted(range(len(DC_LENGTHS)), key=lambda s: (DC_LENGTHS[s], s))
    return bytes(DC_LENGTHS.count(k) for k in range(1, 17)), bytes(symbols)


@lru_cache(maxsize=1)
def _emitted() -> tuple[np.ndarray, np.ndarray]:
    """For each DC difference + 255: the bits of its category, magnitude and the end of block, and their number."""
    codes = {s: (c, n) for s, c, n in huffman_codes(*_dc_table())}
    bits, sizes = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = codes[size]
        magnitude = d if d >= 0 else d + (1 << size) - 1
        bits[d + 255], sizes[d + 255] = ((code << size) | magnitude) << 1, n + size + 1
    return bits, sizes


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(maxsize=4096)
def _header(rows: int) -> bytes:
    frame = struct.pack(">BHHB", 8, 8 * rows, 8 * ROW, 1) + bytes([1, 0x11, 0])
    counts, symbols = _dc_table()
    return b"".join([
        b"\xff\xd8",
        _segment(0xDB, b"\0" + bytes([DC_QUANTUM] * 64)),
        _segment(0xC0, frame),
        _segment(0xC4, b"\0" + counts + symbols),
        _segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\0"),
        _segment(0xDD, struct.pack(">H", ROW)),
        _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
    ])


def encode(payloads: list[bytes]) -> list[bytes]:
    """A JPEG stream for each payload, whose length is a positive multiple of 64."""
    data = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ROW).astype(np.int16) - 128
    images = [(k, min(MOST_ROWS, len(p) // ROW - at)) for k, p in enumerate(payloads) for at in range(0, len(p) // ROW, MOST_ROWS)]
    n = np.array([rows for _, rows in images])
    first = np.cumsum(n) - n
    bits, sizes = _emitted()
    step = np.diff(data, axis=1, prepend=0) + 255
    size = sizes[step]
    total = size.sum(axis=1)
    length = (total + 7) // 8
    start = np.cumsum(length) - length
    at = 8 * start[:, None] + np.cumsum(size, axis=1) - size
    value = (bits[step] << (24 - (at & 7) - size)).ravel()
    at = (at >> 3).ravel()
    coded = np.zeros(int(length.sum()) + 2)
    for k in range(3):
        coded[k : k + int(at[-1]) + 1] += np.bincount(at, (value >> (16 - 8 * k)) & 255)
    coded = coded[:-2].astype(np.uint8)
    coded[start + length - 1] |= ((1 << (8 * length - total)) - 1).astype(np.uint8)
    # Each byte moves on by the zeros stuffed after 0xFF and the two bytes of a marker after each row.
    row = np.repeat(np.arange(len(length)), length)
    full = coded == 255
    moved = np.arange(len(coded)) + np.cumsum(full) - full + 2 * row
    end = moved[start + length - 1] + 1 + full[start + length - 1]
    out = np.zeros(int(end[-1]) + 2, np.uint8)
    out[moved] = coded
    out[end] = 255
    inside = np.arange(len(length)) - np.repeat(first, n)
    out[end + 1] = np.where(inside == np.repeat(n, n) - 1, 0xD9, 0xD0 + inside % 8)
    scans = out.tobytes()
    streams: list[list[bytes]] = [[] for _ in payloads]
    for (k, rows), r in zip(images, first, strict=True):
        begin = int(moved[start[r]])
        streams[k] += [_header(rows), scans[begin : int(end[r + rows - 1]) + 2]]
    return [b"".join(s) for s in streams]


# ---------------------------------------------------------------- reading


@dataclass(frozen=True)
class Scan:
    """One image: its size, the luminance quantum of DC, and per block of an MCU (component, DC table, AC table)."""

    width: int
    height: int
    quantum: int
    blocks: tuple[tuple[int, tuple, tuple], ...]
    sampling: tuple[int, int, int, int]  # luminance across and down, and the most of any component
    restart: int
    begin: int
    end: int


def parse(stream: bytes) -> list[Scan]:
    """The images of a stream, one after another. Raises ValueError for what is not baseline."""
    out, at = [], 0
    while at < len(stream):
        if stream[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at += 2
        quanta, tables, frame, restart = {}, {}, None, 0
        while True:
            while stream[at : at + 2] == b"\xff\xff":
                at += 1
            if at + 4 > len(stream) or stream[at] != 0xFF:
                raise ValueError("no marker")
            marker, size = stream[at + 1], int.from_bytes(stream[at + 2 : at + 4], "big")
            body = stream[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quanta[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    tables[body[0]] = (body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xC0:
                height, width = struct.unpack(">HH", body[1:5])
                frame = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
            elif 0xC1 <= marker <= 0xCF:
                raise ValueError("not baseline")
            elif marker == 0xDD:
                restart = int.from_bytes(body, "big")
            elif marker == 0xDA:
                break
        if frame is None or len(frame) != body[0]:
            raise ValueError("scans of some components are not handled")
        used = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
        one = len(frame) == 1
        blocks = tuple((k, tables[used[c] >> 4], tables[16 | used[c] & 15]) for k, (c, h, v, _) in enumerate(frame) for _ in range(1 if one else h * v))
        sampling = (1, 1, 1, 1) if one else (frame[0][1], frame[0][2], max(f[1] for f in frame), max(f[2] for f in frame))
        begin = at
        while True:  # the next marker that is neither stuffing nor a restart
            at = stream.find(b"\xff", at)
            if at < 0 or at + 1 >= len(stream):
                raise ValueError("no end of scan")
            if stream[at + 1] != 0 and not 0xD0 <= stream[at + 1] <= 0xD7:
                break
            at += 2
        out.append(Scan(width, height, quanta[frame[0][3]], blocks, sampling, restart, begin, at))
        if stream[at : at + 2] != b"\xff\xd9":
            raise ValueError("more than one scan")
        at += 2
    return out


@lru_cache(maxsize=64)
def _lookup(table: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 bits: the symbol they begin with and its code's length (0: none)."""
    symbol, length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for s, code, n in huffman_codes(*table):
        low = code << (16 - n)
        symbol[low : low + (1 << (16 - n))], length[low : low + (1 << (16 - n))] = s, n
    return symbol, length


def _signed(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(size > 0, np.where(bits >> np.maximum(size - 1, 0), bits, bits - (1 << size) + 1), 0)


@lru_cache(maxsize=64)
def _whole_blocks(dc: tuple, ac: tuple) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 bits that begin with a whole block without AC coefficients: its DC difference and number of bits (else 0)."""
    symbol, length = _lookup(dc)
    at = np.arange(1 << 16)
    used = length + symbol
    fits = (length > 0) & (used < 16)
    rest = np.where(fits, 16 - used, 1)
    diff = _signed((at >> rest) & ((1 << symbol) - 1), symbol)
    after, n = _lookup(ac)
    tail = (at << np.where(fits, used, 0)) & 0xFFFF
    fits &= (after[tail] == 0) & (n[tail] > 0) & (used + n[tail] <= 16)
    return diff.astype(np.int32), np.where(fits, used + n[tail], 0).astype(np.int32)


def _lanes(words: np.ndarray, at: np.ndarray, blocks: tuple, mcus: np.ndarray) -> np.ndarray:
    """DC differences (MCU, block, lane) of lanes whose bits begin at ``at``; lanes with fewer MCUs have 0 at the end."""
    out = np.zeros((int(mcus.max()), len(blocks), len(at)), np.int32)
    at = at.copy()
    peek = lambda p, n: (words[p >> 3] << (p & 7).astype(np.uint32)) >> n.astype(np.uint32)
    sixteen, even = np.uint32(16), int(mcus.min())
    for m in range(out.shape[0]):
        on = None if m < even else np.flatnonzero(mcus > m)
        for b, (_, dc, ac) in enumerate(blocks):
            diff, bits = _whole_blocks(dc, ac)
            p = at if on is None else at[on]
            top = (words[p >> 3] << (p & 7).astype(np.uint32)) >> sixteen
            used, value = bits[top], diff[top]
            slow = np.flatnonzero(used == 0)
            if len(slow):
                q, got = p[slow], value.copy()
                symbol, length = _lookup(dc)
                top = peek(q, np.full(len(q), 16))
                size, n = symbol[top], length[top]
                if not n.all():
                    raise ValueError("bad DC code")
                q = q + n
                got[slow] = np.where(size > 0, _signed((peek(q, 32 - np.maximum(size, 1)) if len(q) else q).astype(np.int64), size), 0)
                q, k, open_ = q + size, np.ones(len(q), np.int64), np.arange(len(q))
                symbol, length = _lookup(ac)
                while len(open_):
                    top = peek(q[open_], np.full(len(open_), 16))
                    rs, n = symbol[top], length[top]
                    if not n.all():
                        raise ValueError("bad AC code")
                    q[open_] += n + (rs & 15)
                    k[open_] += (rs >> 4) + 1
                    open_ = open_[(rs != 0) & (k[open_] < 64)]
                used, value = used.copy(), got
                used[slow] = q - p[slow]
            if on is None:
                out[m, b] = value
                at = at + used
            else:
                out[m, b, on] = value
                at[on] += used
    return out


def thumbnails(streams: list[bytes]) -> list[list[np.ndarray]]:
    """For each stream, its images' DC-only luminance thumbnails: a sample for each 8 x 8 block."""
    scans = [(k, s) for k, stream in enumerate(streams) for s in parse(stream)]
    out: list[list[np.ndarray]] = [[] for _ in streams]
    made: dict[int, np.ndarray] = {}
    alike: dict[tuple, list[int]] = {}
    for i, (_, s) in enumerate(scans):
        alike.setdefault((s.blocks, s.restart), []).append(i)
    for (blocks, restart), members in alike.items():
        data = np.frombuffer(b"".join(streams[scans[i][0]][scans[i][1].begin : scans[i][1].end] for i in members), np.uint8)
        size = np.array([scans[i][1].end - scans[i][1].begin for i in members])
        after = np.zeros(len(data), np.uint8)
        after[1:] = data[:-1]
        mark = np.flatnonzero((after == 255) & (data >= 0xD0) & (data <= 0xD7)) if restart else np.zeros(0, np.int64)
        keep = ~((after == 255) & (data == 0))
        keep[mark] = keep[mark - 1] = False
        first = np.cumsum(size) - size
        begin = np.sort(np.concatenate([first, mark + 1]))
        owner = np.searchsorted(first, begin, "right") - 1
        place = (np.cumsum(keep) - keep)[np.minimum(begin, len(data) - 1)]
        clean = np.concatenate([data[keep], np.full(8, 255, np.uint8)]).astype(np.uint32)
        words = (clean[:-3] << 24) | (clean[1:-2] << 16) | (clean[2:-1] << 8) | clean[3:]
        grid = [_grid(scans[i][1]) for i in members]
        all_mcus = np.array([a * d for a, d in grid])
        if (all_mcus * len(blocks) > 4 * size + 4).any():
            raise ValueError("fewer bits than blocks")  # each takes two at least
        nth = np.arange(len(begin)) - np.searchsorted(owner, owner, "left")
        mcus = np.minimum(all_mcus[owner] - nth * restart, restart) if restart else all_mcus[owner]
        if (mcus <= 0).any() or np.bincount(owner, mcus, len(members)).astype(np.int64).tolist() != all_mcus.tolist():
            raise ValueError("restart markers do not fit the image")
        luminance = [b for b, x in enumerate(blocks) if x[0] == 0]
        steps = _lanes(words, 8 * place.astype(np.int64), blocks, mcus)[:, luminance]
        dc = np.cumsum(steps.reshape(-1, len(begin)), axis=0).reshape(steps.shape).transpose(2, 0, 1)  # lane, MCU, block
        flat = dc.reshape(len(begin), -1) if (mcus == dc.shape[1]).all() else None
        rows = np.searchsorted(owner, np.arange(len(members) + 1))
        for j, i in enumerate(members):
            lanes = range(rows[j], rows[j + 1])
            values = flat[rows[j] : rows[j + 1]].ravel() if flat is not None else np.concatenate([dc[r, : mcus[r]].ravel() for r in lanes])
            made[i] = _placed(scans[i][1], grid[j], values)
    for i, (k, _) in enumerate(scans):
        out[k].append(made[i])
    return out


def _grid(s: Scan) -> tuple[int, int]:
    """MCUs across and down."""
    return -(-s.width // (8 * s.sampling[2])), -(-s.height // (8 * s.sampling[3]))


def _placed(s: Scan, grid: tuple[int, int], dc: np.ndarray) -> np.ndarray:
    h, v, most_h, most_v = s.sampling
    across, down = grid
    image = dc.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    width, height = -(-(-(-s.width * h // most_h)) // 8), -(-(-(-s.height * v // most_v)) // 8)
    return np.clip((image[:height, :width] * s.quantum + 4) // 8 + 128, 0, 255).astype(np.uint8)


def hashes(*images: np.ndarray) -> tuple[int, int]:
    """Average hash and difference hash of 64 bits each, from means over a grid of areas of all images, one below the other.

    Narrower images are filled up with zeros. Rows are summed image by image, so no copy of the whole is made.
    """
    height, width = sum(x.shape[0] for x in images), max(x.shape[1] for x in images)
    edges = lambda n, k: ((a := np.arange(k) * n // k), np.maximum(a + 1, (np.arange(k) + 1) * n // k))
    y0, y1 = edges(height, 8)
    sums, top = np.zeros((8, width + 1), np.int64), 0
    for image in images:
        for k in range(8):
            part = image[max(0, y0[k] - top) : max(0, y1[k] - top)]
            if len(part):
                sums[k, 1 : 1 + image.shape[1]] += part.sum(axis=0, dtype=np.int64)
        top += image.shape[0]
    sums = sums.cumsum(axis=1)

    def means(across: int) -> np.ndarray:
        x0, x1 = edges(width, across)
        return (sums[:, x1] - sums[:, x0]) / np.outer(y1 - y0, x1 - x0)

    a, d = means(8), means(9)
    number = lambda bits: int.from_bytes(np.packbits(bits.ravel()).tobytes(), "big")
    return number(a > a.mean()), number(d[:, 1:] > d[:, :-1])


# ---------------------------------------------------------------- columns


def _in_blocks(columns: list[list], weight: list[int]) -> Iterator[slice]:
    start, total = 0, 0
    for i, w in enumerate(weight):
        if i > start and total + w > BLOCK:
            yield slice(start, i)
            start, total = i, 0
        total += w
    if start < len(weight):
        yield slice(start, len(weight))


def stored(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """carry's columns, n_bytes and media: each row's whole text as a JPEG stream of its UTF-8 bytes, padded with zeros to 64.

    A null text counts as empty (64 zeros). Equal texts make equal media, repeated rows included. Empty in, empty out. A
    carried column named like an output is replaced by it.
    """
    carry = [c for c in carry if c.lower() not in ("n_bytes", "media")]
    wanted = docs.select(*(docs[f"`{c}`"] for c in carry), text_of(f"`{text}`").cast("binary").alias("q_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1)
            size = pa.compute.binary_length(texts).to_pylist()
            for part in _in_blocks([], size):
                payloads = [(x := t.as_buffer().to_pybytes()) + b"\0" * (-len(x) % 64 or 64 * (not x)) for t in texts[part.start : part.stop]]
                held = [c.slice(part.start, part.stop - part.start) for c in b.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*held, pa.array(size[part], pa.int64()), pa.array(encode(payloads), pa.binary())], names=[*carry, "n_bytes", "media"])

    import pyarrow.compute  # noqa: F401  (pa.compute)

    return wanted.mapInArrow(run, wanted.drop("q_text").schema.add("n_bytes", "long").add("media", "binary"))


MEASURED = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "width", "height", "feature", "problem")


def decoded(streams: list[bytes]) -> list[tuple[list[np.ndarray], str | None]]:
    """For each stream its thumbnails, or none and what is wrong with it. Streams are decoded side by side; one by one if any is bad."""
    try:
        return [(images, None) for images in thumbnails(streams)]
    except (ValueError, LookupError, struct.error, ArithmeticError) as e:
        if len(streams) == 1:
            return [([], str(e) or type(e).__name__)]
        half = len(streams) // 2
        return decoded(streams[:half]) + decoded(streams[half:])


def media_columns(media: DataFrame, carry: list[str], column: str = "media") -> DataFrame:
    """carry's columns and what decoding each stream gives: payload digests, dimensions and the thumbnail hashes as feature.

    A stream may hold several images: payloads join in order, dimensions and hashes are of all of them, one below the other,
    and feature counts the images. A null or empty stream gives nulls; so does one that is broken or not baseline, with what is
    wrong in ``problem``. Rows are independent; an empty table gives an empty result.
    """
    carry = [c for c in carry if c.lower() not in MEASURED]
    wanted = media.select(*(media[f"`{c}`"] for c in carry), media[f"`{column}`"].alias("q_media"))

    def measured(stream: bytes, images: list[np.ndarray], problem: str | None) -> tuple:
        if not images:
            return *(None,) * (len(MEASURED) - 1), problem
        payload = b"".join(x.tobytes() for x in images)
        height, width = sum(x.shape[0] for x in images), max(x.shape[1] for x in images)
        average, difference = hashes(*images)
        feature = f"{8 * width}x{8 * height}*{len(images)}:{average:016x}:{difference:016x}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stream), hashlib.sha256(stream).hexdigest(), 8 * width, 8 * height, feature, None

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(b.num_columns - 1)
            size = [n or 0 for n in pa.compute.binary_length(column).to_pylist()]
            for part in _in_blocks([], size):
                streams = [(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in column[part.start : part.stop]]
                rows = [measured(s, *found) for s, found in zip(streams, decoded(streams), strict=True)]
                held = [c.slice(part.start, part.stop - part.start) for c in b.columns[:-1]]
                made = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*held, *made], names=[*carry, *MEASURED])

    schema = wanted.drop("q_media").schema
    for name, kind in zip(MEASURED, ("long", "string", "long", "long", "string", "long", "long", "string", "string"), strict=True):
        schema = schema.add(name, kind)
    import pyarrow.compute  # noqa: F401

    return wanted.mapInArrow(run, schema)


def op2_media_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    read = media_columns(stored(docs, ["doc_id"]), ["doc_id", "n_bytes"])
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")
