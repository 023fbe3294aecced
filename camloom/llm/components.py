"""Connected components of an edge list by alternating large-star and small-star steps, all in shuffles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from camloom.llm.common import dropped, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: every node's greater neighbours point to the least of it and its neighbours. Small: the lesser ones do, and it."""
    a, b = F.greatest("u", "v"), F.least("u", "v")
    pairs = edges.select(a.alias("u"), b.alias("v"))
    if large:
        pairs = pairs.unionByName(edges.select(b.alias("u"), a.alias("v")))
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = pairs.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


#: Edges of one file of a round.
EDGES = 1 << 18


def components(edges: DataFrame) -> DataFrame:
    """(u, v), whole numbers in any direction -> node, root: the least node of its component. Roots themselves are left out.

    The number of rounds grows with the logarithm of the longest path. Each round is a table in the shared folder; the driver
    sees its number of edges and a checksum only. Repeated edges and loops do no harm; an empty list gives an empty result.
    """
    seen = lambda table: tuple(table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())
    now = written(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state, before = seen(now), None
    while state[0] and state != before:
        after = written(_star(_star(now, large=True), large=False).coalesce(max(1, math.ceil(state[0] / EDGES))), "edges")
        dropped(now)
        now, before, state = after, state, seen(after)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
