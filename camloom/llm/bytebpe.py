"""Byte-level BPE by overlapping chunks.

A text is cut into chunks of ``CHUNK`` code points that share ``OVERLAP`` with the next. The pattern that splits text before the
merges looks forward only, so where two scans have one boundary in common, all after it is the same. Chunks are scanned
side by side, each from its own start; the first boundary that a chunk and the next share in their overlap is where they are stitched.
Between two such places a piece is encoded as the chunk's scan splits it, and pieces are joined in order.

Two chunks without a common boundary (one match covers the overlap) become one chunk, scanned again, until all are stitched. Texts of
one chunk need none of this and stay where they are. Decoding concatenates the raw bytes of ids, by their places in the vocabulary.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType
from pyspark.sql.window import Window

from camloom.llm.common import text_of, written

RANKS = "byte_bpe_multi_50k.tiktoken"
CHUNK, OVERLAP = 1 << 16, 1 << 8
#: A match is sure only if so many characters after it were seen: the longest look ahead ('re, or white space before a word).
AHEAD = 2
#: Distinct matches that a worker remembers at most, and the longest of them; beyond, it starts anew.
REMEMBERED, LONGEST = 1 << 17, 64
#: Bytes of decoded text that are sent at once; a single longer text goes alone.
BLOCK = 1 << 26


def ranks_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


class ByteBpe:
    """Splits texts by the pattern and encodes each match by itself."""

    def __init__(self, path: str, pattern: str | None = None) -> None:
        import public_tokenizers
        import regex
        import tiktoken

        self.pattern = regex.compile(pattern or public_tokenizers.PATTERN)
        # The whole of what it is given is one match, so a match is merged as it is and never split anew.
        self.merges = tiktoken.Encoding("matches", pat_str=r"[\s\S]+", mergeable_ranks=read_ranks(path), special_tokens={})
        self.known: dict[str, bytes] = {}

    def boundaries(self, text: str) -> np.ndarray:
        """The places between matches, 0 and the end included; the matches cover the text."""
        return np.cumsum([0, *map(len, self.pattern.findall(text))])

    def encode(self, text: str, start: int = 0, end: int | None = None) -> bytes:
        """The ids between two boundaries of a text, as 32-bit numbers. How it is split before the end depends on what comes after."""
        whole = end is None
        matches, known = self.pattern.findall(text[start:] if whole else text[start : end + AHEAD]), self.known
        beyond = 0 if whole else len(text[end : end + AHEAD])
        while beyond > 0:
            beyond -= len(matches.pop())
        if len(known) > REMEMBERED:
            known.clear()
        try:
            return b"".join(map(known.__getitem__, matches))
        except KeyError:
            for m in set(matches):
                if m not in known and len(m) <= LONGEST:
                    known[m] = self._merged(m)
        return b"".join([known.get(m) or self._merged(m) for m in matches])

    def _merged(self, match: str) -> bytes:
        return np.array(self.merges.encode_ordinary(match), np.int32).tobytes()


@lru_cache(maxsize=2)
def _coder(path: str) -> ByteBpe:
    return ByteBpe(path)


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> pa.Array:
    """The bytes of each id, in order; null where there is none."""
    ranks = read_ranks(path)
    pieces: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return pa.array(pieces, pa.large_binary())


def _lists(ids: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(ids), np.int32)))


def _chunked(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(q_key, q_text) -> the chunks: q_key, k, start, final, q_text, once for equal texts. Dealt by (q_key, k), so that a text's chunks part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                starts = range(0, max(len(text) - overlap, 1), chunk)
                parts = [text[s : s + chunk + overlap] for s in starts]
                final = [s + chunk + overlap >= len(text) for s in starts]
                columns = [pa.array([key] * len(parts)), pa.array(range(len(parts)), pa.int64()), pa.array(starts, pa.int64()), pa.array(final), pa.array(parts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["q_key", "k", "start", "final", "q_text"])

    cut = texts.mapInArrow(run, "q_key string, k long, start long, final boolean, q_text string")
    return cut.groupBy("q_key", "k").agg(*(F.first(c).alias(c) for c in ("start", "final", "q_text")))


def _edges(chunks: DataFrame, overlap: int, path: str) -> DataFrame:
    """Of each chunk q_key, k, start, and its scan's boundaries in what it shares with the chunk before (head) and after (tail)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for b in batches:
            heads, tails = [], []
            for start, final, text in zip(*(b.column(c).to_pylist() for c in ("start", "final", "q_text")), strict=True):
                at = coder.boundaries(text)
                heads.append(start + at[at <= overlap])
                tails.append(start + at[(at >= len(text) - overlap) & (at <= len(text) - AHEAD)] if not final else at[:0])
            columns = [*(b.column(c) for c in ("q_key", "k", "start")), pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["q_key", "k", "start", "head", "tail"])

    return chunks.mapInArrow(run, "q_key string, k long, start long, head array<bigint>, tail array<bigint>")


def _stitched(chunks: DataFrame, overlap: int, path: str) -> tuple[DataFrame, DataFrame]:
    """The chunks, as far as need be made one with the next, and of each where its piece begins and ends (null: its text's end)."""
    order = Window.partitionBy("q_key").orderBy("k")
    while True:
        shared = F.array_min(F.array_intersect("tail", F.lead("head").over(order)))
        met = _edges(chunks, overlap, path).select("q_key", "k", "start", F.lead("k").over(order).alias("after"), shared.alias("to"))
        met = written(met, "stitches")
        if met.where("after is not null and to is null").isEmpty():
            return chunks, met.select("q_key", "k", F.coalesce(F.lag("to").over(order), F.lit(0)).alias("from"), "to")
        # A chunk begins a new group unless the one before it was not stitched to it.
        apart = F.coalesce((F.lag("to").over(order).isNotNull()).cast("int"), F.lit(1))
        groups = met.select("q_key", "k", F.sum(apart).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("group"))
        own = F.when(F.col("k") == F.max("k").over(Window.partitionBy("q_key", "group")), F.col("q_text")).otherwise(F.expr(f"left(q_text, char_length(q_text) - {overlap})"))
        parts = chunks.join(groups, ["q_key", "k"]).select("q_key", "group", "k", "start", "final", own.alias("own"))
        joined = parts.groupBy("q_key", "group").agg(F.min("start").alias("start"), F.max("final").alias("final"), F.sort_array(F.collect_list(F.struct("k", "own"))).alias("parts"))
        chunks = written(joined.select("q_key", F.col("group").cast("long").alias("k"), "start", "final", F.array_join("parts.own", "").alias("q_text")), "chunks")


def _pieces(pieces: DataFrame, path: str) -> DataFrame:
    """(q_key, k, q_text, a, e) -> q_key, k, ids of q_text[a:e]; a null e is the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("q_text", "a", "e")), strict=True)
            yield pa.RecordBatch.from_arrays([b.column("q_key"), b.column("k"), _lists([coder.encode(*row) for row in rows])], names=["q_key", "k", "ids"])

    return pieces.mapInArrow(run, "q_key string, k long, ids array<int>")


def encoded(docs: DataFrame, carry: list[str], text: str = "text", path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """carry's columns with ids, the byte-level BPE ids of every row's whole text: each match of the pattern by itself, no special tokens.

    Null texts count as empty and have no ids. Rows are independent: repeated ones get equal ids, an empty table an empty
    result. A carried column named ids is replaced; others are neither read nor in the way. Texts beyond chunk + overlap code points
    are encoded in chunks, equal texts once; a text of any number of chunks is one row of ids in the end, which has to fit a task.
    path: a file of ranks, which each worker opens. chunk has to be overlap at least.
    """
    if chunk < overlap or overlap <= AHEAD:
        raise ValueError("chunk must be overlap at least, and overlap more than the pattern looks ahead")
    path = path or ranks_path()
    carry = [c for c in carry if c.lower() != "ids"]
    t = text_of(f"`{text}`")
    # The carried columns go by number, so that none clashes with the names used here.
    names = {c: f"c_{n}" for n, c in enumerate(carry)}
    rows = docs.select(*(docs[f"`{c}`"].alias(n) for c, n in names.items()), t.alias("q_text"))
    long = F.char_length("q_text") > chunk + overlap
    kept = list(names.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for b in batches:
            ids = _lists([coder.encode(x.as_py()) for x in b.column(b.num_columns - 1)])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], ids], names=[*kept, "ids"])

    short = rows.where(~long).mapInArrow(run, rows.drop("q_text").schema.add("ids", ArrayType(IntegerType())))
    keyed = rows.where(long).withColumn("q_key", F.sha2("q_text", 256))
    chunks, places = _stitched(written(_chunked(keyed.select("q_key", "q_text"), chunk, overlap), "chunks"), overlap, path)
    within = chunks.join(places, ["q_key", "k"]).select("q_key", "k", "q_text", (F.col("from") - F.col("start")).alias("a"), (F.col("to") - F.col("start")).alias("e"))
    whole = _pieces(within, path).groupBy("q_key").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts")).select("q_key", F.flatten("parts.ids").alias("ids"))
    both = short.unionByName(keyed.drop("q_text").join(whole, "q_key").select(*kept, "ids"))
    return both.select(*(F.col(n).alias(c) for c, n in names.items()), "ids")


def decoded(tokens: DataFrame, carry: list[str], ids: str = "ids", path: str | None = None) -> DataFrame:
    """carry's columns with decoded, the raw bytes of every row's ids in order.

    Null or empty ids give no bytes; an id that the vocabulary lacks fails the job. A carried column named decoded is replaced.
    Repeated rows stay, an empty table gives an empty result.
    """
    path = path or ranks_path()
    carry = [c for c in carry if c.lower() != "decoded"]
    wanted = tokens.select(*(tokens[f"`{c}`"].alias(f"c_{n}") for n, c in enumerate(carry)), F.coalesce(F.col(f"`{ids}`").cast("array<int>"), F.array().cast("array<int>")).alias("q_ids"))
    names = [f"c_{n}" for n in range(len(carry))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path)
        for b in batches:
            lists = b.column(b.num_columns - 1)
            flat = lists.flatten()
            places = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            taken = vocabulary.take(flat)
            if taken.null_count:
                raise ValueError("an id is not in the vocabulary")
            ends = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1][places] if len(taken) else np.zeros(len(places), np.int64)
            data, first = taken.buffers()[2], 0
            while first < b.num_rows:
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + BLOCK, "right")) - 1)
                texts = [data[int(a) : int(e)].to_pybytes() if e > a else b"" for a, e in zip(ends[first:last], ends[first + 1 : last + 1], strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.slice(first, last - first) for c in b.columns[:-1]), pa.array(texts, pa.binary())], names=[*names, "decoded"])
                first = last

    out = wanted.mapInArrow(run, wanted.drop("q_ids").schema.add("decoded", BinaryType()))
    return out.select(*(F.col(n).alias(c) for c, n in zip(carry, names, strict=True)), "decoded")


def op13_byte_bpe(spark, sf_dir):
    """The ids of every document and what they decode to, as digests. Nulls, empties and repeats as in ``encoded``."""
    ids = encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    facts = ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), "ids")
    return decoded(facts, ["doc_id", "n_tokens", "ids_sha256"]).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
