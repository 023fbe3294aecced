"""Ranked lexical search with block-max pruning.

Documents are indexed forward, in blocks of ``BLOCK`` consecutive ones: of each document, the terms that any query has, with
their impact. A block also holds the greatest impact of each term in it, so the sum of these over a query's terms, times their
weights, bounds what any of its documents can score. First each query's most promising block of all is scored, for a
threshold that its answers have to reach; then every task sorts its blocks by a query's bound and scores them one after the other until
the bound drops below what the query's best documents so far have. Only the best of each task are shuffled.

The queries are the set that is asked, in parts of some ``PART`` bytes: a part's terms and texts go to every task, documents never leave
theirs. The score follows a rank function of 64-bit numbers: weight of a term (rarity) times (10^9 tf) div (1000 tf + 8 m), where m
grows with the document's length.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from camloom.llm.common import delete, dropped, path_of, text_of, written

TOP = 10
#: Documents of a block, and bytes of query texts that are answered at once.
BLOCK, PART = 128, 2 << 20
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: All of ASCII but letters and digits parts terms; A-Z are lower-cased, bytes of other characters stay.
FOLD = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return text.translate(FOLD).split()


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term that occurs tf times adds, but for its weight, to the score of a document of n terms."""
    m = 10 + (90 * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Queries:
    """A part of the query set: its terms by number, and each query's terms end to end."""

    def __init__(self, texts: list[str | None]) -> None:
        sets = [sorted(set(terms_of((t or "").encode()))) for t in texts]
        self.numbers: dict[bytes, int] = {}
        self.terms = [np.array([self.numbers.setdefault(t, len(self.numbers)) for t in s], np.int64) for s in sets]
        self.asked = [k for k, t in enumerate(self.terms) if len(t)]
        self.flat = np.concatenate([self.terms[k] for k in self.asked] or [np.zeros(0, np.int64)])
        self.first = np.cumsum([0, *(len(self.terms[k]) for k in self.asked)])[:-1]

    def bounds(self, terms: np.ndarray, tops: np.ndarray) -> np.ndarray:
        """For each asked query, what a document of a block with these greatest (weighted) impacts can score at most."""
        greatest = np.zeros(len(self.numbers), np.int64)
        greatest[terms] = tops
        return np.add.reduceat(greatest[self.flat], self.first)


def _arrays(b: pa.RecordBatch, name: str) -> list[np.ndarray]:
    return [x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, np.int64) for x in b.column(name)]


def forward_index(docs: DataFrame, numbers: dict[bytes, int], doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Blocks of documents that have any of the numbered terms: block, ids, n, first, term, tf, and over all documents that were
    read for it n_docs (with a term at all) and n_terms. Of document k: n[k] terms, and postings first[k] to first[k + 1]."""
    named = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_of(f"`{text}`").alias("text"))
    kind = named.schema["doc_id"].dataType
    shared = docs.sparkSession.sparkContext.broadcast(numbers)
    schema = StructType([StructField("block", LongType()), *StructType.fromDDL("n array<bigint>, first array<int>, term array<int>, tf array<int>, n_docs bigint, n_terms bigint").fields])
    schema = StructType([schema.fields[0], StructField("ids", StructType.fromDDL(f"x array<{kind.simpleString()}>").fields[0].dataType), *schema.fields[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        made = TaskContext.get().partitionId() << 32
        ids, n, first, term, tf, n_docs, n_terms, id_kind = [], [], [0], [], [], 0, 0, pa.null()

        def full() -> pa.RecordBatch:
            columns = [pa.array([made]), pa.array([ids], pa.list_(id_kind)), pa.array([n], pa.list_(pa.int64())), *(pa.array([x], pa.list_(pa.int32())) for x in (first, term, tf)), pa.array([n_docs]), pa.array([n_terms])]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for b in batches:
            id_kind = b.column(0).type
            for doc, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                terms = terms_of(x.as_buffer().to_pybytes())
                n_docs, n_terms = n_docs + bool(terms), n_terms + len(terms)
                found = Counter([k for k in map(get, terms) if k is not None])
                if not found:
                    continue
                ids.append(doc)
                n.append(len(terms))
                term += found.keys()
                tf += found.values()
                first.append(len(term))
                if len(ids) == block:
                    yield full()
                    ids, n, first, term, tf, n_docs, n_terms, made = [], [], [0], [], [], 0, 0, made + 1
        if n_docs:
            yield full()

    return named.mapInArrow(run, schema)


def block_maxima(index: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """A forward index with impacts in place of frequencies, and each block's terms (top_term) with their greatest impact (top_impact)."""
    kind = index.schema["ids"].dataType
    schema = StructType([StructField("block", LongType()), StructField("ids", kind), *StructType.fromDDL("first array<int>, term array<int>, impact array<int>, top_term array<int>, top_impact array<int>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made, top_term, top_impact = [], [], []
            for n, first, term, tf in zip(*(_arrays(b, c) for c in ("n", "first", "term", "tf")), strict=True):
                impact = impacts(tf.astype(np.int64), np.repeat(n, np.diff(first)), n_docs, n_terms)
                order = np.lexsort((impact, term))
                last = order[np.flatnonzero(np.append(term[order][1:] != term[order][:-1], True))] if len(term) else order
                made.append(impact)
                top_term.append(term[last])
                top_impact.append(impact[last])
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (made, top_term, top_impact)]
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("ids"), b.column("first"), b.column("term"), *lists], names=schema.names)

    return index.select("block", "ids", "n", "first", "term", "tf").mapInArrow(run, schema)


def _before(a: tuple, b_none_first: bool = True) -> tuple:
    """The order of answers: greater scores first, of equals the least id, a null one before all."""
    score, doc = a
    return -score, doc is not None, doc


class Best:
    """The best answers to a query so far."""

    def __init__(self, top: int, threshold: int) -> None:
        self.top, self.threshold, self.rows = top, max(threshold, 1), []

    def add(self, scores: np.ndarray, ids: list) -> None:
        reach = np.flatnonzero(scores >= self.threshold)
        if len(reach):
            self.rows += [(int(scores[k]), ids[k]) for k in reach.tolist()]
            self.rows.sort(key=_before)
            del self.rows[self.top :]
            if len(self.rows) == self.top:
                self.threshold = self.rows[-1][0]


def _most_promising(blocks: DataFrame, queries: Queries, weights: np.ndarray) -> dict[int, list[int]]:
    """Each block that bounds some query highest, and those queries. The driver gets a row for each query of the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, place = np.zeros(len(queries.asked), np.int64), np.zeros(len(queries.asked), np.int64)
        for b in batches:
            for block, term, impact in zip(b.column("block").to_pylist(), _arrays(b, "top_term"), _arrays(b, "top_impact"), strict=True):
                bounds = queries.bounds(term, weights[term] * impact)
                higher = bounds > best
                best[higher], place[higher] = bounds[higher], block
        some = np.flatnonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(best[some]), pa.array(place[some])], names=["q", "bound", "block"])

    found = blocks.select("block", "top_term", "top_impact").mapInArrow(run, "q long, bound long, block long")
    out: dict[int, list[int]] = {}
    for q, block in found.groupBy("q").agg(F.max_by("block", F.struct("bound", "block"))).collect():
        out.setdefault(block, []).append(q)
    return out


def _scored(blocks: DataFrame, queries: Queries, weights: np.ndarray, thresholds: np.ndarray, top: int, only: dict[int, list[int]] | None = None) -> DataFrame:
    """The best ``top`` of each task as (q, doc_id, score), of those that reach a query's threshold. only: the queries that a block is for."""
    kind = blocks.schema["ids"].dataType.elementType
    schema = StructType([StructField("q", IntegerType()), StructField("doc_id", kind), StructField("score", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        asks = np.zeros(len(queries.numbers), bool)
        id_kind = pa.null()
        for b in batches:
            id_kind = b.schema.field("ids").type.value_type
            names, ids = b.column("block").to_pylist(), b.column("ids")
            firsts, terms, worth = _arrays(b, "first"), _arrays(b, "term"), _arrays(b, "impact")
            worth = [weights[t] * w for t, w in zip(terms, worth, strict=True)]
            bounds = np.array([queries.bounds(t, weights[t] * w) for t, w in zip(_arrays(b, "top_term"), _arrays(b, "top_impact"), strict=True)]).reshape(len(names), -1)
            if only is not None:
                for k, name in enumerate(names):
                    meant = np.zeros(bounds.shape[1], bool)
                    meant[only.get(name, [])] = True
                    bounds[k, ~meant] = 0
            lists: dict[int, list] = {}
            for q in np.flatnonzero((bounds >= np.maximum(thresholds, 1)).any(axis=0)).tolist():
                now = best.setdefault(q, Best(top, int(thresholds[q])))
                mine = queries.terms[queries.asked[q]]
                asks[mine] = True
                for k in np.argsort(-bounds[:, q], kind="stable").tolist():
                    if bounds[k, q] < now.threshold:
                        break
                    if k not in lists:
                        lists[k] = ids[k].as_py()
                    now.add(np.add.reduceat(np.where(asks[terms[k]], worth[k], 0), firsts[k][:-1]), lists[k])
                asks[mine] = False
        rows = [(q, doc, score) for q, x in best.items() for score, doc in x.rows]
        columns = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], id_kind), pa.array(columns[2], pa.int64())], names=schema.names)

    return blocks.where(F.size("ids") > 0).mapInArrow(run, schema)


def _thresholds(blocks: DataFrame, queries: Queries, weights: np.ndarray, top: int) -> np.ndarray:
    """What the answers to each query have to reach: the score of the last of the ``top`` best in its most promising block, 0 if it has fewer."""
    only = _most_promising(blocks, queries, weights)
    none = np.zeros(len(queries.asked), np.int64)
    if not only:
        return none
    asked = F.broadcast(blocks.sparkSession.createDataFrame([(k,) for k in only], "block long"))
    rows = _scored(blocks.join(asked, "block"), queries, weights, none, top, only)
    last = rows.groupBy("q").agg(F.sort_array(F.collect_list("score"), asc=False).alias("scores")).where(F.size("scores") >= top)
    for q, score in last.select("q", F.element_at("scores", top)).collect():
        none[q] = score
    return none


def _answered(docs: DataFrame, texts: list[str | None], doc_id: str, text: str, top: int, block: int) -> DataFrame:
    """(q, rank, doc_id, score) for a part of the query set, q counting its texts."""
    spark = docs.sparkSession
    queries = Queries(texts)
    index = written(forward_index(docs, queries.numbers, doc_id, text, block), "forward")
    n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    kind = index.schema["ids"].dataType.elementType
    if not n_docs or not queries.asked:
        dropped(index)
        return spark.createDataFrame([], StructType([StructField("q", IntegerType()), StructField("rank", IntegerType()), StructField("doc_id", kind), StructField("score", LongType())]))
    weights = np.full(len(queries.numbers), term_weight(n_docs, 0), np.int64)
    for term, df in index.select(F.explode("term").alias("term")).groupBy("term").count().collect():
        weights[term] = term_weight(n_docs, df)
    blocks = written(block_maxima(index, n_docs, n_terms), "blocks")
    dropped(index)
    found = written(_scored(blocks, queries, weights, _thresholds(blocks, queries, weights, top), top), "answers")
    delete(spark, path_of(blocks))
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    numbers = F.array(*(F.lit(k) for k in queries.asked))
    return ranked.select(F.element_at(numbers, F.col("q") + 1).alias("q"), "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, queries: DataFrame, query_id: str, doc_id: str = "doc_id", text: str = "text", query_text: str = "text", top: int = TOP, part: int = PART, block: int = BLOCK) -> DataFrame:
    """query_id's column, rank, doc_id and score: each query's ``top`` best documents with a score above 0, rank 1 the highest.

    Equal scores stand by ascending doc_id, a null one first. Null and empty texts have no terms: such documents count nowhere and
    such queries have no answers. Every row of the queries is answered by itself, also where rows or ids repeat; so is every row of
    the documents a document. Empty tables give an empty result; other columns are not read. The query set is answered in parts of some ``part`` bytes,
    dealt by a hash: a part goes through the driver and to all tasks, and the documents are read once for each.
    """
    asked = queries.select(F.col(f"`{query_id}`").alias("query_id"), text_of(f"`{query_text}`").alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(size / part))
    spark, out = docs.sparkSession, None
    for k in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("query_id", "text"), F.lit(parts)) == k).collect()
        found = _answered(docs, [r["text"] for r in rows], doc_id, text, top, block)
        kind = asked.schema["query_id"].dataType
        names = spark.createDataFrame([(n, r["query_id"]) for n, r in enumerate(rows)], StructType([StructField("q", IntegerType()), StructField("query_id", kind)]))
        answers = found.join(F.broadcast(names), "q").select(F.col("query_id").alias(query_id), "rank", F.col("doc_id").alias(doc_id), "score")
        out = answers if out is None else out.unionByName(answers)
    return out


def op12_ranked_search(spark, sf_dir):
    """The 10 best documents for every benchmark item. Nulls, ties, empties and repeats as in ``ranked_search``."""
    read = lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return ranked_search(read("documents"), read("benchmark"), "item_id")


def oracle_sql() -> str:
    terms = f"regexp_extract_all(translate(coalesce(\"text\", ''), '{LETTERS}', '{LETTERS.lower()}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
with d as (select row_number() over () as r, doc_id, {terms} as terms from documents),
n as (select r, doc_id, cast(len(terms) as bigint) as n from d where len(terms) > 0),
c as (select cast(count(*) as bigint) as n_docs, cast(sum(n) as bigint) as n_terms from n),
b as (select row_number() over () as i, item_id, {terms} as terms from benchmark),
q as (select distinct i, item_id, term from (select i, item_id, unnest(terms) as term from b)),
p as (select r, term, cast(count(*) as bigint) as tf from (select r, unnest(terms) as term from d) where term in (select term from q) group by r, term),
w as (select term, cast(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) as bigint) as w from p, c group by term),
s as (select i, any_value(item_id) as item_id, r, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) as bigint) as score
    from q join p using (term) join w using (term) join n using (r), c group by i, r),
o as (select item_id, doc_id, score, cast(row_number() over (partition by i order by score desc, doc_id asc nulls first) as int) as rank from s join n using (r) where score > 0)
select item_id, rank, doc_id, score from o where rank <= {TOP}"""
