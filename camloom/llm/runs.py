"""Periodic runs of words by a scan over all lags.

A run is a maximal stretch of words with smallest period q that is MIN_EXP periods long at least, and MIN_WORDS words. Word ids
are compared with themselves shifted by each lag q up to n / MIN_EXP: where they stay equal over ``need`` = max(MIN_WORDS - q,
(MIN_EXP - 1) * q) places, there is a run with period q.

Such a stretch covers a multiple of ``need``, so a lag is compared at these places first, for many texts at once (laid end
to end with a mark between them that equals no word): n / need of them, which sum to n * log(n) over all lags. Around
what is equal there, the true stretch is measured to its ends. Two periods of one long stretch have their
greatest common divisor as a period too, so a place inside a run that is known already, for a lag that its period divides, is passed over,
and of runs over the same words the one with the least lag has the smallest period.

Texts of up to ``LONG`` bytes are scanned for all lags where they are. Longer ones are dealt to tasks by (text, range of lags), each
range twice as long as all before it, so that their number grows with the logarithm of the text; equal texts are scanned once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from camloom.llm.common import SPACES, text_of

MIN_EXP, MIN_WORDS = 4, 6
#: Bytes of a text beyond which its lags are dealt out, and lags of the first range.
LONG, FIRST_RANGE = 1 << 16, 1 << 10
#: Words that are laid end to end at once; a longer text is alone.
BLOCK = 1 << 19
#: Runs of a text: starts, lengths and periods, by start and then period.
Runs = tuple[np.ndarray, np.ndarray, np.ndarray]
NONE: Runs = (np.zeros(0, np.int64),) * 3


def words_of(text: str) -> list[bytes]:
    """The words, as UTF-8. bytes.split() parts at just the six white space characters that are meant."""
    return text.encode().split()


def equal_span(ids: np.ndarray, q: int, at: int) -> tuple[int, int]:
    """The stretch of places i around ``at`` where ids[i] == ids[i + q], measured in growing steps: its first place and its end."""
    start, end, last, step = at, at + 1, len(ids) - q, 64
    while end < last:
        other = np.flatnonzero(ids[end : min(end + step, last)] != ids[end + q : min(end + step, last) + q])
        if len(other):
            end += int(other[0])
            break
        end, step = min(end + step, last), 2 * step
    step = 64
    while start > 0:
        low = max(start - step, 0)
        other = np.flatnonzero(ids[low:start] != ids[low + q : start + q])
        if len(other):
            start = low + int(other[-1]) + 1
            break
        start, step = low, 2 * step
    return start, end


def scan(ids: np.ndarray, ends: np.ndarray, lags: range | None = None, min_exp: int = MIN_EXP, min_words: int = MIN_WORDS) -> Runs:
    """The stretches of all lags (or those given) in texts that lie end to end, by falling length, each followed by its mark.

    ids: word ids, the marks all different. ends: where each text's mark is. A stretch that is found for several lags is given for the least.
    """
    starts, lengths, periods = [], [], []
    size = np.diff(ends, prepend=-1) - 1
    most = int(size[0]) if len(size) else 0
    begin, inside, period = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), np.ones(len(ids), np.int64)  # the known run over a place: its start, end and a period
    for q in lags or range(1, most // min_exp + 1):
        need = max(min_words - q, (min_exp - 1) * q, 1)
        texts = int(np.searchsorted(-size, -max(min_exp * q, min_words), "right"))  # the longest, in which the lag can have a run
        if not texts:
            break
        n = int(ends[texts - 1])
        hits = np.flatnonzero(ids[need - 1 : n - q : need] == ids[need - 1 + q : n : need]) * need + need - 1
        if not len(hits):
            continue
        # Of the need places around it on one side, half are equal too: looked at 1, 2, 4, ... places away.
        half = need // 2
        left, right = hits >= half, hits + half + q < n
        away = 1
        while away <= half:
            before, after = np.maximum(hits - away, 0), np.minimum(hits + away, n - q - 1)
            left &= ids[before] == ids[before + q]
            right &= ids[after] == ids[after + q]
            away *= 2
        hits = hits[left | right]
        known = hits[(inside[hits] <= hits + q) | (q % period[hits] != 0)]
        past = -1
        for at in known.tolist():
            if at < past or (inside[at] > at + q and q % period[at] == 0):
                continue
            start, past = equal_span(ids[:n], q, at)
            if past - start >= need:
                run = slice(start, past + q)
                same = begin[at] == start and inside[at] == past + q
                period[run] = math.gcd(q, int(period[at])) if same else q
                if not same:
                    starts.append(start)
                    lengths.append(past - start + q)
                    periods.append(q)
                    begin[run], inside[run] = start, past + q
    return first_of_each(np.array(starts, np.int64), np.array(lengths, np.int64), np.array(periods, np.int64))


def first_of_each(starts: np.ndarray, lengths: np.ndarray, periods: np.ndarray) -> Runs:
    """Of stretches over the same words the one with the least period, by start and then period."""
    order = np.lexsort((periods, lengths, starts))
    s, n, q = starts[order], lengths[order], periods[order]
    new = np.concatenate([[True], (s[1:] != s[:-1]) | (n[1:] != n[:-1])])[: len(s)]
    s, n, q = s[new], n[new], q[new]
    order = np.lexsort((q, s))
    return s[order], n[order], q[order]


def runs_of(texts: list[list[bytes]], min_exp: int = MIN_EXP, min_words: int = MIN_WORDS) -> list[Runs]:
    """The runs of each text, by start and then period."""
    out: list[Runs] = [NONE] * len(texts)
    by_length = sorted((k for k, words in enumerate(texts) if len(words) >= min_words), key=lambda k: -len(texts[k]))
    if not by_length:
        return out
    ids: dict[bytes, int] = {}
    parts = []
    for mark, k in enumerate(by_length):
        parts.append(np.array([ids.setdefault(w, len(ids)) for w in texts[k]] + [-1 - mark], np.int32))
    ends = np.cumsum([len(p) for p in parts]) - 1
    starts, lengths, periods = scan(np.concatenate(parts), ends, None, min_exp, min_words)
    text = np.searchsorted(ends, starts)
    cut = np.searchsorted(text, np.arange(len(by_length) + 1))
    for place, k in enumerate(by_length):
        a, e = cut[place], cut[place + 1]
        if e > a:
            first = ends[place - 1] + 1 if place else 0
            out[k] = starts[a:e] - first, lengths[a:e], periods[a:e]
    return out


def lag_ranges(n: Column, min_exp: int = MIN_EXP, first: int = FIRST_RANGE) -> Column:
    """The lags of a text of n words in ranges (from, to), each as long as all before it."""
    most = F.floor(n / min_exp)
    count = F.greatest(F.ceil(F.log2(F.greatest(most, F.lit(1)) / F.lit(first))), F.lit(0)).cast("int") + 1
    edge = lambda k: (F.lit(first) * F.pow(F.lit(2.0), k)).cast("long")
    return F.transform(F.sequence(F.lit(0), count), lambda k: F.struct(F.when(k == 0, 1).otherwise(edge(k - 1) + 1).cast("long").alias("from"), F.least(edge(k), most).cast("long").alias("to")))


def longest_run(runs: Runs) -> tuple[int, int, int] | None:
    """(start, length, period) of the run with the greatest length / period; of equals the least start, then period."""
    best = None
    for s, n, q in zip(*(x.tolist() for x in runs), strict=True):
        if best is None or n * best[2] > best[1] * q:
            best = s, n, q
    return best


def collapsed(words: list[bytes], runs: Runs) -> bytes:
    """The words without those that a run holds after its first period, joined by a space."""
    if not len(runs[0]):
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, runs[0] + runs[2], 1)
    np.add.at(edges, runs[0] + runs[1], -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()])


OUT = {"n_runs": pa.int64(), "starts": pa.list_(pa.int64()), "lengths": pa.list_(pa.int64()), "periods": pa.list_(pa.int64()), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(), "collapsed": pa.string()}
OUT_DDL = "n_runs long, starts array<bigint>, lengths array<bigint>, periods array<bigint>, start long, length long, period long, collapsed string"


def _facts(words: list[bytes], runs: Runs) -> tuple:
    best = longest_run(runs) or (None, None, None)
    return (len(runs[0]), *runs, *best, collapsed(words, runs).decode())


def _columns(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), OUT.values(), strict=True)]


def periodic_runs(docs: DataFrame, carry: list[str], text: str = "text", long: int = LONG, first: int = FIRST_RANGE) -> DataFrame:
    """carry's columns with what was found in every row's whole text.

    n_runs; starts, lengths, periods of all runs, by start and then period (words numbered from 0); start, length, period of the
    run with the greatest length / period (of equals the least start, then period), null without a run; collapsed: the words without
    those that a run holds after its first period, joined by a space. Null texts count as empty and have no runs. Rows are
    independent, so repeated ones get equal results, and an empty table an empty one. Carried columns named as an output are
    replaced; others are not in the way. One text and its runs have to fit a task; its lags are dealt out.
    """
    carry = [c for c in carry if c.lower() not in OUT]
    names = {c: f"c_{n}" for n, c in enumerate(carry)}
    kept = list(names.values())
    rows = docs.select(*(docs[f"`{c}`"].alias(n) for c, n in names.items()), text_of(f"`{text}`").alias("q_text"))
    is_long = F.octet_length("q_text") > long

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first_row, texts, size = 0, [], 0
            for k, x in enumerate(b.column(b.num_columns - 1)):
                texts.append(words_of(x.as_py()))
                size += len(texts[-1])
                if size >= BLOCK or k + 1 == b.num_rows:
                    made = _columns([_facts(words, runs) for words, runs in zip(texts, runs_of(texts), strict=True)])
                    yield pa.RecordBatch.from_arrays([*(c.slice(first_row, k + 1 - first_row) for c in b.columns[:-1]), *made], names=[*kept, *OUT])
                    first_row, texts, size = k + 1, [], 0

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text_, low, high in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids: dict[bytes, int] = {}
                numbers = np.array([ids.setdefault(w, len(ids)) for w in words_of(text_)] + [-1], np.int32)
                found = scan(numbers, np.array([len(numbers) - 1]), range(low, high + 1))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(found[0]), pa.string()), *map(pa.array, found)], names=["q_key", "s", "n", "q"])

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for text_, found in zip(b.column("q_text").to_pylist(), b.column("found").to_pylist(), strict=True):
                parts = [np.array([f[c] for f in found or []], np.int64) for c in ("s", "n", "q")]
                made.append(_facts(words_of(text_), first_of_each(*parts)))
            if made:
                yield pa.RecordBatch.from_arrays([b.column("q_key"), *_columns(made)], names=["q_key", *OUT])

    short = rows.where(~is_long).mapInArrow(run, StructType(rows.drop("q_text").schema.fields + StructType.fromDDL(OUT_DDL).fields))
    keyed = rows.where(is_long).withColumn("q_key", F.sha2("q_text", 256))
    texts = keyed.groupBy("q_key").agg(F.first("q_text").alias("q_text"))
    n = F.size(F.array_remove(F.split("q_text", f"[{SPACES}]+"), ""))
    dealt = texts.select("q_key", "q_text", F.explode(lag_ranges(n, first=first)).alias("r")).where("r.from <= r.to").select("q_key", "q_text", "r.from", "r.to")
    found = dealt.repartition("q_key", "from").mapInArrow(ranges, "q_key string, s long, n long, q long")
    listed = found.groupBy("q_key", "s", "n").agg(F.min("q").alias("q")).groupBy("q_key").agg(F.collect_list(F.struct("s", "n", "q")).alias("found"))
    whole = texts.select("q_key", "q_text").join(listed, "q_key", "left").mapInArrow(finished, StructType(texts.select("q_key").schema.fields + StructType.fromDDL(OUT_DDL).fields))
    both = short.unionByName(keyed.select(*kept, "q_key").join(whole, "q_key").select(*kept, *OUT))
    return both.select(*(F.col(n).alias(c) for c, n in names.items()), *OUT)


def planted(doc_id: Column, text: Column) -> Column:
    """The text, made periodic where the contract of op11 says so: h = crc32(doc_id), g = h / 10; if h ends in 0, each word i >= a is word
    a + (i - a) % p, with a = g % n and p = 1 + (n - a) / (3 + g % 8). A null id changes nothing."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.array_remove(F.split(text, f"[{SPACES}]+"), "")
    n = F.size(words).cast("long")
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
    times = F.ceil((n - a) / p).cast("int")
    repeated = F.slice(F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), times)), F.lit(1), (n - a).cast("int"))
    made = F.concat(F.slice(words, F.lit(1), a.cast("int")), repeated)
    # In two steps, so that the words of the other texts are never looked for.
    return F.when(h % 10 == 0, F.when(n > 0, F.array_join(made, " ")).otherwise(text)).otherwise(text)


def op11_periodic_runs(spark, sf_dir):
    """The runs of every document, with its planted period. Nulls, empties and repeats as in ``periodic_runs``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = periodic_runs(docs.select("doc_id", planted(F.col("doc_id"), text_of()).alias("text")), ["doc_id"])
    listed = F.array_join(F.transform(F.arrays_zip("starts", "lengths", "periods"), lambda r: F.concat_ws(",", r["starts"], r["lengths"], r["periods"])), "\n")
    text = F.when(F.col("n_runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    return found.select("doc_id", "n_runs", "start", "length", "period", F.expr("(1000 * length) div period").alias("exponent_milli"), F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
