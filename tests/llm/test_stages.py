"""Pipeline stages on odd input: nulls, empty and long texts, repeated rows, no rows, extra columns named like outputs."""

import pytest

import corpus_pipeline as pipeline
from camloom.llm import components, quality, simhash
from tests.llm.test_edges import LONG, table


@pytest.fixture(scope="module")
def odd(spark):
    good = " ".join(f"w{k % 97}x{k * k % 89}" for k in range(120))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, good, "en", "a"), (3, good, "en", "a"), (None, good + " tail", None, "a"), (4, LONG, "en", None), (5, " \n\t", "de", ""), (6, good[::-1], "de", "b"), (7, good.upper(), "en", "b")]
    return table(spark, rows)


@pytest.mark.parametrize(("name", "stage"), pipeline.STAGES)
def test_stage(spark, odd, name, stage):
    out = stage(spark, odd, None)
    rows = out.collect()
    assert stage(spark, odd.limit(0), None).count() == 0
    if name == "packed":
        assert sum(r.start == 0 for r in rows) == 9
        return
    assert out.dtypes == odd.dtypes and {(r.kept, r.spans, r.size, r.n_words) for r in rows} <= {("z", "x", 1, 3)}
    ids = sorted((r.doc_id or 0) for r in rows)
    if name == "quality_rules":
        assert ids == [0, 3, 3, 6, 7]
    elif name == "near_duplicates":
        assert ids == [0, 1, 3, 4, 6]
    elif name == "repeated_passages":
        texts = {r.doc_id: r.text for r in rows}
        assert len(rows) == 9 and texts[3] == "" and texts[1] is None and texts[None].endswith("tail") and texts[4] == "" and len(texts[6]) > 400
    else:
        assert set(ids) <= {0, 1, 2, 3, 4, 5, 6, 7} and {1, 2, 5} <= set(ids)


def test_estimates_go_along(spark, odd, monkeypatch):
    """No table of estimates comes from a sort-merge join: each goes along with its counts, which keeps plans and tasks few."""
    plans, write = {}, quality.written
    monkeypatch.setattr(quality, "written", lambda df, name: plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    assert pipeline.quality_rules(spark, odd, None).count() == 5
    for name in ("sums", "starts", "cut", "edge", "step"):
        assert plans[name] and not any("SortMergeJoin" in p for p in plans[name]), name
    assert all(p.count("Exchange hashpartitioning") <= 2 for name in ("cut", "edge", "step") for p in plans[name])


def test_rounds_of_components(spark, monkeypatch):
    """Stars need one round, which shows that nothing changes any more; no edges need none. Later edges go between roots."""
    names, write = [], components.written
    monkeypatch.setattr(components, "written", lambda df, name: names.append(name) or write(df, name))
    edges = spark.createDataFrame([(1, 2), (1, 3), (5, 6), (8, 9)], "u long, v long")
    roots = components.components(edges)
    assert {r.node: r.root for r in roots.collect()} == {2: 1, 3: 1, 6: 5, 9: 8} and len(names) == 2
    names.clear()
    assert components.components(edges.limit(0)).count() == 0 and len(names) == 1
    more = simhash.between(spark.createDataFrame([(3, 6), (2, 3), (7, 10), (9, 9)], "u long, v long"), roots)
    assert {tuple(r) for r in more.collect()} == {(1, 5), (1, 1), (7, 10), (8, 8)}
    ids = spark.createDataFrame([(10 + n, n) for n in range(1, 11)], "id long, node long")
    got = {r.id - 10: r.node for r in simhash.rooted(simhash.rooted(ids, roots), components.components(more)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 1, 6: 1, 4: 4, 7: 7, 10: 7, 8: 8, 9: 8}
