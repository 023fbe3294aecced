"""The registered queries on the small tables: SQL twins, round trips and brute force over whole tables."""

import collections
import hashlib
import html
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from camloom.llm import chat, media, packing, simhash, suffixes, tokens
from camloom.llm.queries import ORACLES, QUERIES
from tests.conftest import SMALL, rows_of


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, duck, name):
    got, expected = QUERIES[name](spark, SMALL), duck.sql(ORACLES[name])
    assert rows_of(got) == rows_of(expected)


def test_op2_reads_back_what_it_stored(spark, texts):
    rows = QUERIES["op2_media_columns"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        payload = texts[r.doc_id] + b"\0" * (-len(texts[r.doc_id]) % 64 or 64 * (not texts[r.doc_id]))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stream = media.encode([payload])[0]
        assert (r.media_bytes, r.media_sha256) == (len(stream), hashlib.sha256(stream).hexdigest())


def brute_repeats(all_texts, length):
    seen = collections.Counter(t[i : i + length] for t in all_texts for i in range(len(t) - length + 1))
    out = []
    for t in all_texts:
        gone, reach = bytearray(len(t)), 0
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                for k in range(max(i, reach), i + length):
                    gone[k] = 1
                reach = i + length
        runs = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(t)))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


def test_op3_against_brute_force(spark, texts):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op3_suffix_dedup"](spark, SMALL).collect()}
    assert [got[k] for k in texts] == brute_repeats(list(texts.values()), 200)


def test_op4_keeps_the_article_alone(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    got = {r.page_id: r for r in QUERIES["op4_html_extraction"](spark, SMALL).collect()}
    assert len(got) == len(pages)
    for p in pages:
        text = got[p.page_id].text
        assert text and got[p.page_id].n_chars == len(text) and "©" not in text and "<p" not in text and "track(" not in text
        assert text.split("\n\n")[0] == " ".join(html.unescape(p.html.partition("<h1>")[2].partition("</h1>")[0]).split())


def test_op5_covers_each_id_once(spark, texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.tokenizer_path(packing.TOKENIZER))
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in QUERIES["op5_packing"](spark, SMALL).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for k, t in texts.items():
        ids = packing.packed([*whole.encode(t.decode(), add_special_tokens=False).ids, 2])
        at = 0
        for r in sorted(pieces[k], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) // 4 and r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(ids) // 4
    padding = 0
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding == 0


def test_op6_agrees_with_the_library(spark, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokens.tokenizer_path(tokens.MODEL))
    for r in QUERIES["op6_token_counts"](spark, SMALL).collect():
        n = len(model.encode(texts[r.doc_id].decode()))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id]), n, n > 4096)


def brute_fingerprint(text):
    import re

    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text))
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, near):
    parent = {k: k for k in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if near(prints[a], prints[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_op7_against_brute_force(spark, texts):
    prints = {k: brute_fingerprint(t) for k, t in texts.items()}
    expected = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op7_simhash"](spark, SMALL).collect()}
    assert got == {k: (f"{p:016x}", expected[k]) for k, p in prints.items()}


def test_op9_reads_back_all_turns(spark):
    talks = collections.defaultdict(list)
    for r in spark.read.parquet(f"{SMALL}/conversations.parquet").orderBy("conv_id", "turn").collect():
        talks[r.conv_id].append((r.role, r.text or ""))
    talks[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: r for r in QUERIES["op9_chat_formatting"](spark, SMALL).collect()}
    assert set(got) == set(talks)
    for k, turns in talks.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (got[k].n_turns, got[k].loss_chars, got[k].loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[k].formatted_chars == len(chat.render(turns)[0])


def test_mix_comes_near_its_targets(spark):
    rows = QUERIES["op1_mixing"](spark, SMALL).collect()
    assert all(r.taken <= 3 * r.size for r in rows)
    by, left = collections.defaultdict(int), collections.defaultdict(lambda: float("inf"))
    for r in rows:
        by[r.source_size, r.target] += r.taken
        if r.taken < 3 * r.size:
            left[r.source_size, r.target] = min(left[r.source_size, r.target], r.size)
    assert all(abs(taken - source[1]) < left[source] for source, taken in by.items())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, QUERIES["op1_mixing"](spark, SMALL).collect()))


def test_pipeline_stages(spark):
    docs = first = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SMALL)
        out[name] = (before, docs)
        if name != "packed":
            assert docs.columns == first.columns and docs.dtypes == first.dtypes
            docs = docs.cache()
    before, after = out["near_duplicates"]
    words = {r.doc_id: simhash.shingle_set((r.text or "").encode(), 5) for r in before.collect()}
    kept = {r.doc_id for r in after.collect()}
    groups = brute_components(words, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    assert kept == set(groups.values())
    before, after = out["repeated_passages"]
    texts = {r.doc_id: (r.text or "").encode() for r in before.collect()}
    expected = dict(zip(texts, brute_repeats(list(texts.values()), 200), strict=True))
    for r in after.collect():
        lost = len(texts[r.doc_id]) - len((r.text or "").encode())
        assert 0 <= expected[r.doc_id][1] - lost <= 6 * expected[r.doc_id][2] and r.n_chars == len(r.text or "")
    before, after = out["mixed_sources"]
    assert set(r.doc_id for r in after.collect()) <= set(r.doc_id for r in before.collect())
    assert corpus_pipeline.run(spark, SMALL).agg(F.sum("length")).first()[0] == out["packed"][1].agg(F.sum("length")).first()[0]
