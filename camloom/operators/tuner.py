"""The tuner: labels, a grid of thresholds, confusion tables, F-beta ranking, and a plan with its evidence.

The rule that the grid tries never reads the two warm-up parameters, so tables are made for the 144 triples that matter and
joined with the four valid warm-up pairs afterwards. Events are first reduced to their distinct signals' counts per triple's
thresholds: each event becomes its place in the sorted thresholds, so what is joined with the grid is a small histogram whose
size does not depend on the number of events.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from camloom.operators.detector import would_fire

Z_VALUES = (2.5, 3.0, 3.5, 4.0, 4.5, 5.0)
MIN_BYTES_VALUES = (0, 500, 1000, 2000, 4000, 8000)
FLOOR_VALUES = (0.0, 1.5, 2.0, 3.0)
WARMUP_VALUES = (0.0, 5.0, 8.0)
WARMUP_FRAMES_VALUES = (0, 4)
GRID = ["motion_z_high", "min_bytes_threshold", "bpf_relative_floor"]
WARMUP = ["z_high_warmup", "z_high_warmup_frames"]
TP, FP = 1, -1


def _values(spark: SparkSession, name: str, values: tuple, kind: str) -> DataFrame:
    return spark.range(0, 1, 1, 1).select(F.explode(F.array(*(F.lit(v).cast(kind) for v in values))).alias(name))


def triples(spark: SparkSession) -> DataFrame:
    parts = [_values(spark, GRID[0], Z_VALUES, "double"), _values(spark, GRID[1], MIN_BYTES_VALUES, "long"), _values(spark, GRID[2], FLOOR_VALUES, "double")]
    return reduce(lambda a, b: a.crossJoin(b), parts)


def warmups(spark: SparkSession) -> DataFrame:
    """A higher bar during warm-up needs warm-up frames."""
    both = _values(spark, WARMUP[0], WARMUP_VALUES, "double").crossJoin(_values(spark, WARMUP[1], WARMUP_FRAMES_VALUES, "int"))
    return both.where(~((F.col(WARMUP[0]) > 0) & (F.col(WARMUP[1]) == 0)))


def labelled(events: DataFrame, labels: DataFrame) -> DataFrame:
    """events with label_value: an operator's label, else a heuristic for false positives, else true positive.

    The labels of an event are one: the greatest, so that repeated ones don't multiply events.
    """
    one = labels.groupBy("event_id").agg(F.max("label").alias("label"))
    noise = (F.col("bpf_slow") > 0) & (F.col("bytes") < 1.5 * F.col("bpf_slow")) & (F.col("z_score") > 4.0)
    value = F.when(F.col("label") == "fp", FP).when(F.col("label").isNotNull(), TP).when(noise, FP).otherwise(TP)
    return events.join(one, "event_id", "left").withColumn("label_value", value)


def rank_of(x: Column, values: tuple) -> Column:
    """How many of the values are at most x."""
    return reduce(lambda a, b: a + b, ((x >= v).cast("int") for v in values))


def histogram(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of events by label and by how many thresholds of each kind they pass: a few hundred rows from any number."""
    floors = reduce(lambda a, b: a + b, ((~((F.lit(f) > 0) & (F.col("bpf_slow") > 0) & (F.col("bytes") < f * F.col("bpf_slow")))).cast("int") for f in FLOOR_VALUES))
    ranks = [rank_of(F.col("z_score"), Z_VALUES).alias("rz"), rank_of(F.col("bytes"), MIN_BYTES_VALUES).alias("rb"), floors.alias("rf")]
    return events.groupBy(*(by or []), "label_value", *ranks).agg(F.count(F.lit(1)).alias("n"))


def confusion(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn for each of the 144 triples (and group). Labels other than TP and FP are ignored."""
    spark, by = events.sparkSession, by or []
    grid = triples(spark)
    ranked = grid.select(
        *GRID, rank_of(F.col(GRID[0]), Z_VALUES).alias("gz"), rank_of(F.col(GRID[1]), MIN_BYTES_VALUES).alias("gb"), rank_of(F.col(GRID[2]), FLOOR_VALUES).alias("gf")
    )
    groups = histogram(events, by)
    fires = (F.col("rz") >= F.col("gz")) & (F.col("rb") >= F.col("gb")) & (F.col("rf") >= F.col("gf"))
    of = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).alias
    # The floors rise, so an event that clears one clears all lower ones: its rank tells which.
    pairs = F.broadcast(ranked).crossJoin(groups) if by else F.broadcast(ranked).join(groups, F.lit(True), "left")
    return pairs.groupBy(*by, *GRID).agg(
        of((F.col("label_value") == TP) & fires)("tp"), of((F.col("label_value") == FP) & fires)("fp"), of((F.col("label_value") == TP) & ~fires)("fn")
    )


def scored(tables: DataFrame, beta: float = 0.5) -> DataFrame:
    """with precision, recall and score (F-beta); 0 where a denominator is 0."""
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    pr = tables.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    b2 = beta * beta
    return pr.withColumn("score", ratio((1 + b2) * F.col("precision") * F.col("recall"), b2 * F.col("precision") + F.col("recall")))


def grid_scores(events: DataFrame, beta: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """All 576 candidates with their tables and scores."""
    return scored(confusion(events, by), beta).crossJoin(F.broadcast(warmups(events.sparkSession)))


def ranked(candidates: DataFrame, metric: str = "score", least_recall: float | None = None) -> DataFrame:
    """Best first. Ties are certain (warm-up never changes a score), so the parameters order them."""
    kept = candidates if least_recall is None else candidates.where(F.col("recall") >= least_recall)
    return kept.orderBy(F.desc(metric), *GRID, *WARMUP)


def plan_summary(events: DataFrame, best: DataFrame) -> DataFrame:
    """One row: counts of labels, and against the baseline (z at 3.0 alone) what ``best`` (one row) is expected to change."""
    base_fire = F.col("z_score") >= 3.0
    of = lambda c: F.count_if(c)
    facts = events.agg(
        F.count(F.lit(1)).alias("event_count"), of(F.col("label_value") == TP).alias("labelled_tps"), of(F.col("label_value") == FP).alias("labelled_fps"),
        of((F.col("label_value") == TP) & base_fire).alias("b_tp"), of((F.col("label_value") == FP) & base_fire).alias("b_fp"), of((F.col("label_value") == TP) & ~base_fire).alias("b_fn"),
    )
    both = facts.crossJoin(F.broadcast(best.select(*GRID, *WARMUP, "fp", "fn")))
    less = F.when(F.col("b_fp") > 0, (F.col("b_fp") - F.col("fp")) / F.col("b_fp") * 100).otherwise(0.0)
    loss = F.when(F.col("b_tp") > 0, F.col("fn") / (F.col("b_tp") + F.col("b_fn")) * 100).otherwise(0.0)
    return both.select("event_count", "labelled_tps", "labelled_fps", *GRID, *WARMUP, less.alias("expected_fp_reduction_pct"), loss.alias("expected_tp_loss_pct"))


def valid_plan(plan: DataFrame, most_loss: float = 2.0) -> DataFrame:
    return plan.withColumn("valid", ~(F.col("expected_tp_loss_pct") > most_loss))


def flip_samples(events: DataFrame, best: DataFrame, n: int = 10) -> DataFrame:
    """The first n events of each label that ``best`` (one row) would hold back, in event order."""
    joined = events.crossJoin(F.broadcast(best.select(*GRID)))
    held = joined.where(~would_fire(F.col(GRID[0]), F.col(GRID[1]), F.col(GRID[2])))
    # A first cut per task keeps what is shuffled for a label to a few rows from each.
    first = Window.partitionBy("label_value").orderBy("ts", "event_id")
    return held.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= n).select("label_value", "rank", "event_id", "camera", "z_score", "bytes")


def plan_json(plan: DataFrame) -> DataFrame:
    return plan.select(F.to_json(F.struct(*plan.columns), {"pretty": "true"}).alias("plan"))


def canary(before: DataFrame, after: DataFrame, low: float = 0.3, high: float = 3.0) -> DataFrame:
    """camera, rates (events an hour) before and after, and whether the second is within [low, high] times the first."""
    rate = lambda df, name: df.groupBy("camera").agg((F.count(F.lit(1)) / F.greatest(F.lit(1.0), (F.max(F.unix_timestamp(F.col("ts").cast("timestamp"))) - F.min(F.unix_timestamp(F.col("ts").cast("timestamp")))) / 3600)).alias(name))
    both = rate(before, "before_rate").join(rate(after, "after_rate"), "camera", "full")
    ratio = F.col("after_rate") / F.col("before_rate")
    return both.withColumn("healthy", F.coalesce(ratio.between(low, high), F.lit(False)))


def with_synthetic(events: DataFrame, cameras: DataFrame, n: int = 5, z: float = 3.2) -> DataFrame:
    """Labelled events and n made-up true positives for each camera of slow targets, so that tuning doesn't forget them."""
    made = cameras.select("camera", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("k")).select(
        F.concat(F.lit("synthetic-"), F.col("camera"), F.lit("-"), F.col("k").cast("string")).alias("event_id"), "camera", F.lit(z).alias("z_score"), F.lit(100_000).cast("long").alias("bytes"), F.lit(1000.0).alias("bpf_slow"), F.lit(TP).alias("label_value")
    )
    return events.unionByName(made, allowMissingColumns=True)
