"""Periodic runs, ranked search and byte-level BPE: brute force, the library, odd rows, and texts cut into many parts."""

import collections
import hashlib
import random
import re
import zlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from camloom.llm import bytebpe, runs, search
from camloom.llm.queries import QUERIES
from tests.conftest import SMALL
from tests.llm.test_edges import empty, odd, table  # noqa: F401

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_runs(words, min_exp=4, min_words=6):
    out, n = [], len(words)
    for q in range(1, n // min_exp + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(min_words, min_exp * q) and not any(all(words[k] == words[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(text):
    words = WORD.findall(text or "")
    found = brute_runs(words)
    best = None
    for s, n, q in found:
        if best is None or n * best[2] > best[1] * q:
            best = s, n, q
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    return found, best, " ".join(w for k, w in enumerate(words) if k not in gone)


def brute_planted(doc_id, text):
    h = zlib.crc32(str(doc_id).encode())
    g, words = h // 10, WORD.findall(text or "")
    n = len(words)
    if h % 10 or not n:
        return text or ""
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return " ".join(words[i] if i < a else words[a + (i - a) % p] for i in range(n))


def got_runs(r):
    return list(zip(r.starts, r.lengths, r.periods, strict=True)), None if r.start is None else (r.start, r.length, r.period), r.collapsed


def made_up(seed, count):
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        words, alphabet = [], rng.choice(["a", "ab", "abc", "abcdefgh"])
        while len(words) < rng.choice([3, 10, 40, 120]):
            block = [rng.choice(alphabet) for _ in range(rng.randint(1, 9))]
            words += block * rng.choice([1, 1, 2, 4, 5, 9])
        out.append(rng.choice([" ", "\n", " \t"]).join(words))
    return out


@pytest.mark.parametrize(("long", "first"), [(1 << 16, 4096), (5, 1), (20, 3)])
def test_runs_against_brute_force(spark, long, first):
    texts = made_up(long, 300) + ["a " * 500, "a b " * 400 + "c " * 40, "", " ", "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: got_runs(r) for r in runs.periodic_runs(docs, ["doc_id"], long=long, first=first).collect()}
    assert got == {k: brute_row(t) for k, t in enumerate(texts)}


def test_runs_of_the_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, SMALL).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(got) == len(docs) and sum(r.n_runs > 0 for r in got.values()) > 5
    for d in docs:
        text = brute_planted(d.doc_id, d.text)
        if len(text) > 12_000:
            continue  # brute force takes the square of a text
        found, best, left = brute_row(text)
        s, n, q = best or (None, None, None)
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in found)
        assert tuple(got[d.doc_id]) == (d.doc_id, len(found), s, n, q, best and 1000 * n // q, sha(listed), sha(left))


def test_planted_texts(spark):
    rows = [(i, t) for i in range(200) for t in ["one", "a  b\tc", "w1 w2 w3 w4 w5 w6 w7 w8 w9", "", None]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = docs.select(runs.planted(F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("t")).collect()
    assert [r.t for r in got] == [brute_planted(i, t) for i, t in rows]


def test_runs_of_odd_rows(spark, odd):  # noqa: F811
    got = runs.periodic_runs(odd, ["doc_id", "lang", "spans", "kept"]).collect()
    assert len(got) == 9 and got[0].__fields__[:4] == ["doc_id", "lang", "spans", "kept"]
    by = {r.doc_id: r for r in got}
    assert (by[4].n_runs, by[4].start, by[4].length, by[4].period, by[4].collapsed) == (1, 0, 300_000, 5, "long words in a row")
    assert (by[6].n_runs, by[6].collapsed) == (1, "Ünï çødé 😀") and all(by[k].n_runs == 0 and by[k].collapsed == "" for k in (1, 2, 5))
    split = {r.doc_id: r for r in runs.periodic_runs(odd, ["doc_id"], long=2, first=2).collect()}
    assert all(split[k].collapsed == by[k].collapsed and split[k].starts == by[k].starts for k in by)
    assert runs.periodic_runs(empty(odd), ["doc_id"]).count() == 0


def test_lag_ranges_hold_each_lag_once(spark):
    n = spark.range(1, 300).select("id", runs.lag_ranges(F.col("id"), first=3).alias("r")).collect()
    for row in n:
        assert [q for r in row.r for q in range(r["from"], r["to"] + 1)] == list(range(1, row.id // 4 + 1))


def brute_search(docs, queries, top=10):
    import math

    terms = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    listed = [(d, terms(t)) for d, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in listed), sum(len(t) for _, t in listed)
    df = collections.Counter(x for _, t in listed for x in set(t))
    out = []
    for q, text in queries:
        scored = []
        for d, t in listed:
            tf, m = collections.Counter(t), n_terms and 10 + (90 * len(t) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1_000_000_000 * tf[x]) // (1000 * tf[x] + 8 * m)) for x in set(terms(text)) if tf[x])
            if score > 0:
                scored.append((-score, d is not None, d or 0, d))
        out += [(q, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("block", "part"), [(1, 1 << 20), (3, 40), (128, 1 << 20)])
def test_search_against_brute_force(spark, block, part):
    rng = random.Random(block)
    vocabulary = ["Wort", "wort", "ÉTÉ", "été", "x1", "naïve", "THE", "the", "a", "日本"]
    sentence = lambda k: rng.choice([" ", "-", "\n", "__"]).join(rng.choices(vocabulary, range(1, 11), k=k))
    docs = [(rng.choice([None, *range(150)]), rng.choice([None, "", "?!", sentence(3), sentence(rng.randint(1, 60))])) for _ in range(250)]
    docs += [(1000 + k, "the same text") for k in range(30)]
    queries = [(k % 7, sentence(rng.randint(1, 4))) for k in range(9)] + [(90, None), (91, ""), (92, "unheard"), (None, "the same text"), (93, "the same text"), (93, "the same text")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")).repartition(4)
    q = spark.createDataFrame(queries, "item_id long, text string").withColumn("rank", F.lit("x"))
    got = search.ranked_search(d, q, "item_id", block=block, part=part).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_search(docs, queries)


def test_search_of_odd_rows(spark, odd):  # noqa: F811
    q = spark.createDataFrame([(1, "one two"), (2, "LONG words"), (3, None)], "item_id long, text string")
    got = search.ranked_search(odd, q, "item_id").collect()
    assert sorted((r.item_id, r.rank, r.doc_id) for r in got)[-1][:3] == (2, 1, 4) and {r.doc_id for r in got if r.item_id == 1} == {3, 7, None}
    for d, items in ((empty(odd), q), (odd, empty(q)), (odd, q.where("item_id = 3")), (odd.where("doc_id = 5"), q)):
        assert search.ranked_search(d, items, "item_id").collect() == []


def test_blocks_below_the_threshold_are_not_scored(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "needle hay" if k == 7 else f"hay filler{k}") for k in range(400)], "doc_id long, text string").coalesce(1)
    queries = search.Queries(["needle hay"])
    index = search.forward_index(docs, queries.numbers, block=10)
    facts = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    assert tuple(facts) == (400, 800)
    import numpy as np

    weights = np.array([search.term_weight(400, 400 if t == b"hay" else 1) for t in queries.numbers])
    bounds = [queries.bounds(np.array(r.top_term), weights[r.top_term] * np.array(r.top_impact)) for r in search.block_maxima(index, 400, 800).collect()]
    assert len(bounds) == 40 and sum(b[0] > bounds[1][0] for b in bounds) == 1


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(bytebpe.ranks_path()), special_tokens={})


def test_bytes_of_the_query(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_byte_bpe"](spark, SMALL).collect()}
    for d in docs:
        ids = library.encode_ordinary(d.text or "")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        assert got[d.doc_id] == (len(ids), sha(",".join(map(str, ids)).encode()), sha((d.text or "").encode()))
    assert len(got) == len(docs)


@pytest.mark.parametrize(("chunk", "overlap"), [(3, 3), (8, 5), (40, 12), (bytebpe.CHUNK, bytebpe.OVERLAP)])
def test_chunks_give_what_the_library_gives(spark, library, chunk, overlap):
    rng = random.Random(chunk)
    parts = ["'s", "'re", "'ll", " ", "  ", "\n", "\t\n ", "word", "Straße", "123", "?!", "'", "日本語", "😀", " ", "́", " a" * 5, "x" * 30, " " * 30, "<|endoftext|>", "\0"]
    texts = ["".join(rng.choices(parts, k=rng.choice([0, 1, 5, 30, 80]))) for _ in range(250)] + [None, "", " " * 100 + "x", "y" * 300, "z " * 200]
    docs = spark.createDataFrame([(k, t, "c", "d") for k, t in enumerate(texts * 2)], "doc_id long, text string, ids string, start string").repartition(3)
    tokens = bytebpe.encoded(docs, ["doc_id", "ids", "start"], chunk=chunk, overlap=overlap)
    assert tokens.columns == ["doc_id", "start", "ids"]
    back = {r.doc_id: (list(r.ids), bytes(r.decoded).decode()) for r in bytebpe.decoded(tokens, ["doc_id", "ids"]).collect()}
    assert back == {k: (library.encode_ordinary(t or ""), t or "") for k, t in enumerate(texts * 2)}


def test_bytes_of_odd_rows(spark, odd, library):  # noqa: F811
    got = bytebpe.encoded(odd, ["doc_id", "lang"]).collect()
    assert sorted(list(r.ids) for r in got) == sorted(library.encode_ordinary(r.text or "") for r in odd.collect())
    assert bytebpe.encoded(empty(odd), ["doc_id"]).count() == 0 and bytebpe.decoded(empty(odd).select("doc_id", F.lit(None).alias("ids")), ["doc_id"]).count() == 0
    rows = spark.createDataFrame([(1, None), (2, []), (3, [64])], "doc_id long, ids array<int>")
    assert [len(r.decoded) for r in bytebpe.decoded(rows, ["doc_id"]).orderBy("doc_id").collect()][:2] == [0, 0]
    with pytest.raises(ValueError, match="overlap"):
        bytebpe.encoded(odd, ["doc_id"], chunk=3, overlap=8)
