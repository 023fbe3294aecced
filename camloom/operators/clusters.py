"""Groups of cameras that behave alike, and thresholds of a group for cameras with too few labels.

A camera is told by its fingerprint (median and variance of bytes a frame, share of keyframes, ...), each number scaled to its range over
all cameras. Groups are found by rounds: each camera goes to the nearest centre (sum of absolute differences), each centre becomes the
median of its cameras. Centres are k rows and travel as literals; cameras are assigned row by row and medians are one aggregation, so a
round is one pass over the cameras, with no pairs of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from camloom.operators import tuner as T
from camloom.sources.shared import scratch

#: Values up to which percentile_approx is exact.
ACCURACY = 100_000


def scaled(prints: DataFrame, features: list[str]) -> DataFrame:
    """camera and the features, each from 0 (its least) to 1 (its greatest); 0 where all are equal or it is null."""
    ends = prints.agg(*(f(c).alias(f"{name}_{c}") for c in features for name, f in (("lo", F.min), ("hi", F.max)))).first()
    of = lambda c: F.when(F.lit(ends[f"hi_{c}"] is not None and ends[f"hi_{c}"] > ends[f"lo_{c}"]) & F.col(c).isNotNull(), (F.col(c) - F.lit(ends[f"lo_{c}"])) / (F.lit(ends[f"hi_{c}"]) - F.lit(ends[f"lo_{c}"]))).otherwise(0.0)
    return prints.select("camera", *(of(c).cast("double").alias(c) for c in features))


def nearest(rows: DataFrame, features: list[str], centres: list[tuple]) -> DataFrame:
    """rows with cluster: the number (from 0) of the nearest centre, the first of equals."""
    far = lambda centre: reduce(lambda a, b: a + b, (F.abs(F.col(c) - F.lit(float(v))) for c, v in zip(features, centre, strict=True)))
    return rows.withColumn("cluster", F.array_min(F.array(*(F.struct(far(centre).alias("far"), F.lit(k).alias("k")) for k, centre in enumerate(centres))))["k"])


def clustered(prints: DataFrame, features: list[str], k: int, rounds: int = 10) -> DataFrame:
    """(camera, features) -> camera, cluster. The first centres are the features' k quantiles in the middle of equal parts; rounds end when
    no centre moves. A centre that loses all its cameras stays where it was. An empty table gives an empty result."""
    rows = scratch(scaled(prints, features), "prints")
    parts = [(i + 0.5) / k for i in range(k)]
    first = rows.agg(*(F.percentile_approx(c, parts, ACCURACY).alias(c) for c in features)).first()
    if first[features[0]] is None:
        return rows.select("camera", F.lit(0).alias("cluster"))
    centres = list(zip(*(first[c] for c in features), strict=True))
    for _ in range(rounds):
        found = nearest(rows, features, centres).groupBy("cluster").agg(*(F.percentile_approx(c, 0.5, ACCURACY).alias(c) for c in features)).collect()
        moved = list(centres)
        for r in found:
            moved[r["cluster"]] = tuple(r[c] for c in features)
        if moved == centres:
            break
        centres = moved
    return nearest(rows, features, centres).select("camera", "cluster")


def best_of(events: DataFrame, by: str) -> DataFrame:
    """The best candidate of each key: by, the grid's parameters, score."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), *T.GRID, *T.WARMUP)
    return T.grid_scores(events, by=[by]).withColumn("q_rank", F.row_number().over(order)).where("q_rank = 1").select(by, *T.GRID, *T.WARMUP, "score")


def tuned(events: DataFrame, clusters: DataFrame, least: int = 100) -> DataFrame:
    """camera, cluster, n_labels, level, and the best candidate: of the camera where it has ``least`` labelled events, else of its cluster.

    Cameras without events are tuned as their cluster; those of a cluster without any have null parameters.
    """
    counts = events.groupBy("camera").agg(F.count(F.lit(1)).alias("n_labels"))
    cameras = clusters.join(counts, "camera", "left").withColumn("n_labels", F.coalesce("n_labels", F.lit(0)))
    enough = F.col("n_labels") >= least
    names = [*T.GRID, *T.WARMUP, "score"]
    own = best_of(events.join(cameras.where(enough).select("camera"), "camera", "left_semi"), "camera").select("camera", F.struct(*names).alias("own"))
    group = best_of(events.join(clusters, "camera"), "cluster").select("cluster", F.struct(*names).alias("shared"))
    both = cameras.join(own, "camera", "left").join(group, "cluster", "left").withColumn("best", F.when(enough, F.col("own")).otherwise(F.col("shared")))
    return both.select("camera", "cluster", "n_labels", F.when(enough, "camera").otherwise("cluster").alias("level"), "best.*")
