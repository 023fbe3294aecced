"""Repeated passages by a distributed, sparse suffix array.

Every byte string of ``LENGTH`` bytes that starts at two places is to be found. Sorting the suffix of each byte would move
hundreds of times the input, so the array is sparse, without losing any:

* Anchors. A window (a string of LENGTH bytes) is owned by the place in it whose ``GRAM`` bytes hash lowest, the leftmost of
  equals. Equal windows are owned at equal places, so they meet among the suffixes that start at anchors with equal grams.
  Consecutive windows mostly share their anchor; those that do are one suffix record, whose span is what they cover.
* Classes. Grams that occur once can't repeat: their records go (counts are summed map-side). The others are classes of
  equal spans, one representative each, with its number of occurrences.
* Suffix array. Spark samples splitters and range-partitions the classes by the bytes from their anchor on. A bucket sorts
  its windows by multikey quicksort, 8 bytes a key, group by group, so equal windows stand together.
* Boundaries. In sort order a gram is contiguous, so only a bucket's first and last can go on in others: the windows of those
  are compared across buckets by 128-bit digests, each different one once a bucket: first what eight neighbouring windows
  have in common, then, where buckets share that, the windows themselves.

What is repeated goes back to the texts that the records came from, under the digest of the text, so that any number of
copies of a text is decided once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from camloom.llm.common import dropped, text_of, written

LENGTH, GRAM = 200, 64
#: Windows whose anchors are found at once, and classes sorted in one bucket: both bound a worker's memory.
BLOCK, BUCKET = 1 << 19, 15_000
#: Neighbouring windows whose common string is compared across buckets before they are.
CORE = 8
ASK = ("gram", "span", "o", "w1", "w2", "c")
PLACE = np.uint64((1 << 20) - 1)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed 64-bit polynomial hash of the gram bytes from each place on; gram is a power of two."""
    h, p = data.astype(np.uint64) + np.uint64(1), np.uint64(0x9E3779B97F4A7C15)
    k = 1
    with np.errstate(over="ignore"):
        while k < gram:
            h = h[:-k] * p + h[k:]
            p, k = p * p, 2 * k
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """The least of the width values from each place on."""
    size = 1
    while 2 * size <= width:
        v, size = np.minimum(v[:-size], v[size:]), 2 * size
    return np.minimum(v[: len(v) - (width - size)], v[width - size :]) if size < width else v


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, anchor, first window, number of windows) of each record in texts that end at ``ends`` in data."""
    none = np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    if len(data) < length:
        return none
    h = gram_hashes(data, gram)
    owner = (sliding_min((h & ~PLACE) | np.arange(len(h), dtype=np.uint64), length - gram + 1) & PLACE).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    inside = np.zeros(len(owner) + 1, np.int32)  # windows that lie in one text
    long = ends - starts >= length
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - length + 1, -1)
    window = np.flatnonzero(np.cumsum(inside[:-1]))
    if not len(window):
        return none
    owner = owner[window]
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    return h[owner[first]], owner[first], window[first], np.diff(first, append=len(window))


def blocks(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]:
    """Texts joined to blocks, and those beyond a block cut so that each window is in one part: data, ends, (text, offset)."""
    parts: list[bytes] = []
    where: list[tuple[int, int]] = []
    total = 0

    def joined() -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), where

    for k, text in enumerate(texts):
        for at in range(0, max(len(text) - length + 1, 0), BLOCK):
            part = text[at : at + BLOCK + length - 1]
            if parts and total + len(part) > BLOCK + length:
                yield joined()
                parts, where, total = [], [], 0
            parts.append(part)
            where.append((k, at))
            total += len(part)
    if parts:
        yield joined()


def records(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """(t1, t2, q_text) -> the suffix records: gram, span (hashes), t1, t2, at (first window), anchor (in the span), n (windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t1, t2 = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            texts = [x.as_buffer().to_pybytes() for x in b.column(2)]
            for data, ends, where in blocks(texts, length):
                grams, anchor, first, n = anchors(data, ends, length, gram)
                whole, digest = data.tobytes(), xxhash.xxh3_64_intdigest
                spans = [digest(whole[a:e]) for a, e in zip(first.tolist(), (first + n + length - 1).tolist(), strict=True)]
                part = np.searchsorted(ends, first, "right")
                text = np.array([k for k, _ in where])[part]
                at = first - np.concatenate([[0], ends[:-1]])[part] + np.array([o for _, o in where])[part]
                columns = [grams.view(np.int64), np.array(spans, np.uint64).view(np.int64), t1[text], t2[text], at, anchor - first, n]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["gram", "span", "t1", "t2", "at", "anchor", "n"])

    return keyed.mapInArrow(run, "gram long, span long, t1 long, t2 long, at long, anchor long, n long")


def equal_windows(words: list[np.ndarray], group: np.ndarray) -> np.ndarray:
    """Multikey quicksort over all groups at once: members of a group are split by one 8-byte key after another.

    Returns a number for each member; those of one group with equal keys share it. Members alone in their group drop out.
    """
    out = np.full(len(group), -1, np.int64)
    on, g, fresh = np.arange(len(group)), group, 0
    for key in [None, *words]:
        order = np.lexsort((g,) if key is None else (key(on), g))
        on, g = on[order], g[order]
        new = g[1:] != g[:-1]
        if key is not None:
            k = key(on)
            new |= k[1:] != k[:-1]
        g = np.cumsum(np.concatenate([[False], new]))
        many = np.bincount(g)[g] > 1
        out[on[~many]] = fresh + np.arange((~many).sum())
        fresh += int((~many).sum())
        on, g = on[many], g[many]
        if not len(on):
            return out
    out[on] = fresh + g
    return out


def sorted_bucket(rows: list[tuple], length: int) -> Iterator[tuple]:
    """Rows (gram, span, n, c, anchor, bytes) of a bucket -> (gram, span, offset of a window, how many, None, None, None) of
    runs that repeat here, and (None, None, None, None, digest, digest, windows) of cores to be compared with other buckets:
    a core is what CORE neighbouring windows have in common, its windows those of ASK with how often they occur here."""
    grams, n, c, anchor = (np.array([r[k] for r in rows], np.int64) for k in (0, 2, 3, 4))
    data = np.frombuffer(b"".join(r[5] for r in rows) + b"\0" * 8, np.uint8)
    size = np.array([len(r[5]) for r in rows])
    base = np.cumsum(size) - size
    row = np.repeat(np.arange(len(rows)), n)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = base[row] + offset
    # Equal windows have equal grams at equal places: those are the first keys.
    gram_rank = np.unique(grams, return_inverse=True)[1]
    group = gram_rank[row] * (2 * length) + (anchor[row] - offset)
    long = np.zeros(len(data) - 7, np.uint64)
    for k in range(8):
        long |= data[k : len(data) - 7 + k].astype(np.uint64) << np.uint64(56 - 8 * k)
    steps = [min(8 * k, length - 8) for k in range(-(-length // 8))]
    number = equal_windows([(lambda on, s=s: long[start[on] + s]) for s in steps], group)
    total = np.bincount(number, c[row])
    repeats = total[number] >= 2
    if repeats.any():
        edge = np.flatnonzero(np.diff(np.concatenate([[0], repeats, [0]])))
        place = np.flatnonzero(np.diff(row, prepend=-1))  # runs end with their row
        cuts = np.unique(np.concatenate([edge, place, [len(row)]]))
        for a, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if repeats[a]:
                r = rows[row[a]]
                yield r[0], r[1], int(offset[a]), e - a, None, None, None
    # Each different window of the bucket's first and last gram, once, under the string that it shares with its neighbours.
    open_ = np.flatnonzero(np.isin(grams, [rows[0][0], rows[-1][0]])[row])
    open_ = open_[np.unique(number[open_], return_index=True)[1]]
    whole, digest, cores = data.tobytes(), xxhash.xxh3_128_digest, {}
    inner = (base + anchor)[row[open_]] - (anchor[row[open_]] - offset[open_]) // CORE * CORE
    for k, at, core, o, here in zip(row[open_].tolist(), start[open_].tolist(), inner.tolist(), offset[open_].tolist(), total[number[open_]].tolist(), strict=True):
        asks = cores.setdefault(digest(whole[core : core + length - CORE + 1]), [])
        asks.append((rows[k][0], rows[k][1], o, *halves(digest(whole[at : at + length])), int(here)))
    for d, asks in cores.items():
        yield None, None, None, None, *halves(d), [dict(zip(ASK, x, strict=True)) for x in asks]


def halves(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def keyed_texts(docs: DataFrame, carry: list[str], text: str) -> DataFrame:
    t = text_of(f"`{text}`")
    return docs.select(*(docs[f"`{c}`"] for c in carry), F.xxhash64(t).alias("t1"), F.xxhash64(F.lit(1), t).alias("t2"), t.cast("binary").alias("q_text"))


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(t1, t2, spans): for each text with repeats, by its digest, [start, end) of bytes in repeated strings; they may overlap."""
    texts = keyed_texts(docs, [], text)
    found = written(records(texts, length, gram), "records")
    # Small tables that are joined with large ones are written first: then both sides of the join are plain shuffles, and Spark
    # can split a hot gram's rows over tasks.
    often = written(found.groupBy("gram").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("gram"), "often")
    names = ["gram", "span", "t1", "t2", "at", "anchor", "n"]
    # Grouping comes in a stage of its own, as it would need the rows of a gram together.
    repeated = written(found.join(often, "gram").select(*names), "repeated")
    dropped(found, often)
    again = written(repeated.groupBy(*names).agg(F.count(F.lit(1)).alias("c")), "again")
    dropped(repeated)
    classes = again.groupBy("gram", "span").agg(F.sum("c").alias("c"), F.min(F.struct("t1", "t2", "at", "anchor", "n")).alias("r"))
    wanted = classes.select("r.t1", "r.t2", F.struct("gram", "span", "c", "r.at", "r.anchor", "r.n").alias("s")).groupBy("t1", "t2").agg(F.collect_list("s").alias("s"))
    one = texts.dropDuplicates(["t1", "t2"])
    spans = (
        one.join(wanted, ["t1", "t2"])
        .select("q_text", F.explode("s").alias("s"))
        .select("s.gram", "s.span", "s.n", "s.c", "s.anchor", F.expr(f"substring(q_text, cast(s.at + 1 as int), cast(s.n + {length - 1} as int))").alias("bytes"))
    )
    array = written(spans, "spans")
    buckets = max(1, -(-array.count() // BUCKET))
    # The sort key is the suffix's first bytes, then digests of its gram and of all its bytes: short, as samples of it go to the driver.
    order = [F.expr("substring(bytes, cast(anchor + 1 as int), 16)").alias("leading"), F.col("gram"), F.col("span")]
    placed = array.repartitionByRange(buckets, *order).sortWithinPartitions(*order)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        if rows:
            out = list(sorted_bucket(rows, length))
            window = pa.struct([(x, pa.int64()) for x in ASK])
            kinds = [*[pa.int64()] * 6, pa.list_(window)]
            for at in range(0, len(out), 20_000):
                columns = zip(*out[at : at + 20_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["gram", "span", "o", "m", "d1", "d2", "asks"])

    asks = "array<struct<" + ", ".join(f"{x}: bigint" for x in ASK) + ">>"
    runs = written(placed.mapInArrow(sort, f"gram long, span long, o long, m long, d1 long, d2 long, asks {asks}"), "runs")
    dropped(array)
    # A bucket gives each core once: one that more than one gives may have equal windows in them.
    cores = runs.where("d1 is not null").select("d1", "d2", "asks")
    shared = cores.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("d1", "d2")
    windows = cores.join(shared, ["d1", "d2"]).select(F.explode("asks").alias("a")).select("a.*")
    across = windows.groupBy("w1", "w2").agg(F.sum("c").alias("k")).where("k > 1").select("w1", "w2")
    alone = windows.where("c = 1").join(across, ["w1", "w2"]).select("gram", "span", "o", F.lit(1).cast("long").alias("m"))
    both = runs.where("d1 is null").select("gram", "span", "o", "m").unionByName(alone)
    each = written(both.groupBy("gram", "span").agg(F.collect_set(F.struct("o", "m")).alias("runs")), "each")  # no more than a span has windows
    back = again.join(each, ["gram", "span"]).select("t1", "t2", F.explode(F.transform("runs", lambda r: F.struct((F.col("at") + r["o"]).alias("a"), (F.col("at") + r["o"] + r["m"] + length - 1).alias("e")))).alias("s"))
    return back.groupBy("t1", "t2").agg(F.collect_list("s").alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Overlapping and touching spans joined, in order."""
    if not spans:
        return []
    pairs = np.array([(s["a"], s["e"]) for s in spans], np.int64)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    end = np.maximum.accumulate(pairs[:, 1])
    first = np.flatnonzero(np.concatenate([[True], pairs[1:, 0] > end[:-1]]))
    return list(zip(pairs[first, 0].tolist(), np.append(end[first[1:] - 1], end[-1]).tolist(), strict=True))


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, e in spans:
        out.append(text[at:a])
        at = e
    return b"".join([*out, text[at:]])


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans shrunk to begin and end between characters."""
    out = []
    for a, e in spans:
        while a < e and text[a] & 0xC0 == 0x80:
            a += 1
        while e > a and e < len(text) and text[e] & 0xC0 == 0x80:
            e -= 1
        if a < e:
            out.append((a, e))
    return out


OUTPUT = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame, carry: list[str], text: str = "text", length: int = LENGTH, gram: int = GRAM, texts: bool = False) -> DataFrame:
    """carry's columns with n_bytes, n_removed, n_spans (maximal runs) and kept_sha256 of every row; with texts also kept_text.

    Each byte in a string of ``length`` bytes that starts at another place too, in this or any other row, is removed; all
    copies go, judged on the input. Null texts count as empty; texts shorter than length lose nothing; repeated rows are
    copies of each other. kept_text is whole characters: a run that begins or ends inside one leaves that one. An empty
    table gives an empty result. A carried column named like an output is replaced by it.
    """
    gone = {*OUTPUT, "kept_text"}
    carry = [c for c in carry if c.lower() not in gone]
    held = {c: f"q_{k}" for k, c in enumerate(carry)}
    spans = repeated_spans(docs, text, length, gram)
    rows = keyed_texts(docs.select(*(docs[f"`{c}`"].alias(to) for c, to in held.items()), docs[f"`{text}`"].alias("q_in")), list(held.values()), "q_in")
    joined = rows.join(spans, ["t1", "t2"], "left").select(*held.values(), "q_text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made: list[list] = [[] for _ in range(4 + texts)]
            for x, s in zip(b.column(b.num_columns - 2), b.column(b.num_columns - 1), strict=True):
                data, found = x.as_buffer().to_pybytes(), merged(s.as_py())
                values = [len(data), sum(e - a for a, e in found), len(found), hashlib.sha256(kept_bytes(data, found)).hexdigest()]
                if texts:
                    values.append(kept_bytes(data, whole_characters(data, found)).decode())
                for column, v in zip(made, values, strict=True):
                    column.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array(c, k) for c, k in zip(made, kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *columns], names=[*held.values(), *OUTPUT, *["kept_text"] * texts])

    schema = joined.drop("q_text", "spans").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    if texts:
        schema = schema.add("kept_text", "string")
    return joined.mapInArrow(run, schema).withColumnsRenamed({to: c for c, to in held.items()})


def op3_suffix_dedup(spark, sf_dir):
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
