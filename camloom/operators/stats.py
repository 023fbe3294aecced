"""Statistics: cameras over a day, audits with totals, histograms, rates, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from camloom.operators.running import ranged, running, with_previous

LINEAR = tuple(5.0 * k for k in range(1, 11))
EXPONENTIAL = tuple(0.0001 * 2**k for k in range(12))


def camera_stats(events: DataFrame, cameras: DataFrame, start: Column, end: Column, cap: int | None = None) -> DataFrame:
    """A row for each camera, also those without events (zeros, no last time): counts, means, the greatest z (not below 0) and
    the last row's values, over [start, end]; with cap over the first cap rows only."""
    rows = events.where(F.col("ts").between(start, end))
    if cap is not None:
        rows = rows.withColumn("q_n", F.row_number().over(Window.partitionBy("camera").orderBy("ts", "event_id"))).where(F.col("q_n") <= cap)
    last = lambda c: F.max_by(c, F.struct("ts", "event_id"))
    agg = rows.groupBy("camera").agg(
        F.count(F.lit(1)).alias("event_count_24h"), F.max("ts").alias("last_event_ts"), F.avg("z_score").alias("z_score_avg"), F.greatest(F.max("z_score"), F.lit(0.0)).alias("z_score_max"),
        last("z_score").alias("z_score_last"), last("bpf_slow").alias("bpf_slow_last"), last("intra_ratio").alias("intra_ratio_last"), F.avg("intra_ratio").alias("intra_ratio_avg"),
    )
    filled = [c for c in agg.columns if c not in ("camera", "last_event_ts")]
    return cameras.select("camera").distinct().join(agg, "camera", "left").fillna(0, filled)


def audit(events: DataFrame, clips: DataFrame, labels: DataFrame) -> DataFrame:
    """Per camera and over all (camera TOTAL): events, clips, true and false positives, their share, means of what is above 0,
    and a flag: ! under half true, - nothing validated."""
    one = labels.groupBy("event_id").agg(F.max("label").alias("label"))
    seen = events.join(one, "event_id", "left")
    positive = lambda c: F.avg(F.when(F.col(c) > 0, F.col(c)))
    name = F.when(F.grouping_id() == 1, "TOTAL").otherwise(F.col("camera"))
    facts = seen.rollup("camera").agg(
        name.alias("name"), F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("label").isin("tp", "reference")).alias("tp"), F.count_if(F.col("label") == "fp").alias("fp"),
        positive("z_score").alias("avg_z"), positive("bytes").alias("avg_bytes"), positive("bpf_slow").alias("avg_bpf_slow"),
    )
    n_clips = clips.rollup("camera").agg(name.alias("name"), F.count(F.lit(1)).alias("n_clips"))
    both = facts.drop("camera").join(n_clips.drop("camera"), "name", "full")
    zeros = both.fillna(0, ["n_events", "tp", "fp", "n_clips", "avg_z", "avg_bytes", "avg_bpf_slow"])
    done = F.col("tp") + F.col("fp")
    share = F.when(done > 0, F.col("tp") / done * 100).otherwise(0.0)
    flag = F.when(done == 0, "-").when(share < 50, "!").otherwise("")
    return zeros.select(F.col("name").alias("camera"), "n_events", "n_clips", "tp", "fp", share.alias("tp_pct"), flag.alias("flag"), "avg_z", "avg_bytes", "avg_bpf_slow")


def histogram(df: DataFrame, value: str, bounds: tuple[float, ...], by: list[str] | None = None) -> DataFrame:
    """Cumulative buckets (value <= le; null le: all), with the sum and count of each group. One bucket index a row, summed
    first: the bounds meet the few sums, not the rows."""
    by = by or []
    at = sum((F.col(value) > b).cast("int") for b in bounds)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"))
    les = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(b).alias("le")) for k, b in enumerate(bounds)), F.struct(F.lit(len(bounds)).alias("k"), F.lit(None).cast("double").alias("le")))
    each = counts.select("*", F.explode(les).alias("b"))
    return each.groupBy(*by, F.col("b.k").alias("k"), F.col("b.le").alias("le")).agg(
        F.sum(F.when(F.col("at") <= F.col("b.k"), F.col("n")).otherwise(0)).alias("cumulative"), F.sum("n").alias("total"), F.sum("s").alias("value_sum")
    ).drop("k")


def histogram_quantile(buckets: DataFrame, q: float, by: list[str] | None = None) -> DataFrame:
    """The q quantile by linear interpolation in the first bucket that reaches it; in the last, its lower bound."""
    by = by or []
    w = Window.partitionBy(*by).orderBy(F.col("le").isNull(), "le") if by else Window.partitionBy(F.lit(0)).orderBy(F.col("le").isNull(), "le")
    low = F.coalesce(F.lag("le").over(w), F.lit(0.0))
    below = F.coalesce(F.lag("cumulative").over(w), F.lit(0))
    rows = buckets.withColumn("low", low).withColumn("below", below).where(F.col("cumulative") >= q * F.col("total"))
    value = F.when(F.col("le").isNull(), F.col("low")).when(F.col("cumulative") == F.col("below"), F.col("le")).otherwise(
        F.col("low") + (F.col("le") - F.col("low")) * (q * F.col("total") - F.col("below")) / (F.col("cumulative") - F.col("below"))
    )
    return rows.groupBy(*by).agg(F.min_by(value, F.struct(F.col("le").isNull(), F.col("le"))).alias("quantile"))


def event_rate(events: DataFrame, minutes: int = 5, slide: int | None = None, by: tuple[str, ...] = ("camera",)) -> DataFrame:
    """Events and events a second in each window of minutes (every ``slide`` minutes): window_start, by, n, rate."""
    ts, step = F.col("ts").cast("timestamp"), slide or minutes
    if minutes % step:
        raise ValueError("the window must be whole steps")
    # Events are counted by step first; the few counts, not the events, go to the windows over them.
    counts = events.groupBy(F.window(ts, f"{step} minutes").alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    starts = F.array(*(F.col("w.start") - F.make_dt_interval(mins=F.lit(k * step)) for k in range(minutes // step)))
    out = counts.select(F.explode(starts).alias("window_start"), *by, "n") if minutes > step else counts.select(F.col("w.start").alias("window_start"), *by, "n")
    out = out.groupBy("window_start", *by).agg(F.sum("n").alias("n")) if minutes > step else out
    return out.select("window_start", *by, "n", (F.col("n") / (60.0 * minutes)).alias("rate"))


def counters(events: DataFrame) -> DataFrame:
    """Counts by camera and type, by each alone, and over all: absent labels are null."""
    return events.cube("camera", "type").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


def readiness(status: DataFrame) -> DataFrame:
    """(camera, connected, ready) -> one row: ready where the flag is up and a camera is connected."""
    return status.agg(F.count(F.lit(1)).alias("n_cameras"), F.count_if("connected").alias("n_connected"), (F.coalesce(F.bool_or("connected"), F.lit(False)) & F.coalesce(F.bool_or("ready"), F.lit(False))).alias("ready"))


def fingerprints(frames: DataFrame) -> DataFrame:
    """What tells cameras apart: the median and variance of bytes per frame, frames, keyframe share.

    The median is exact (of an even number the lower middle): counts of equal sizes run along the sizes, in ranges.
    """
    totals = frames.groupBy(F.struct("camera").alias("q_key")).agg(
        F.count(F.lit(1)).alias("n"), F.count("byte_count").alias("q_n"), F.var_pop("byte_count").alias("var_bytes"), F.avg(F.col("is_keyframe").cast("double")).alias("keyframe_share")
    )
    counts = frames.where("byte_count is not null").groupBy(F.struct("camera").alias("q_key"), "byte_count").agg(F.count(F.lit(1)).alias("q_each"))
    upto = running(ranged(counts, "byte_count"), {"q_upto": ("sum", F.col("q_each"))}, "q_key", ["byte_count"])
    median = upto.join(totals.select("q_key", "q_n"), "q_key").where("2 * q_upto >= q_n").groupBy("q_key").agg(F.min("byte_count").alias("median_bytes"))
    return totals.join(median, "q_key", "left").select("q_key.camera", "n", "median_bytes", "var_bytes", "keyframe_share")


def size_distribution(frames: DataFrame) -> DataFrame:
    return frames.groupBy("is_keyframe", "byte_count").agg(F.count(F.lit(1)).alias("n"))


def cpu_percent(samples: DataFrame) -> DataFrame:
    """(host, ts, total, idle: counters) -> busy share between each sample and the one before, to one decimal; null for the first."""
    ranged = samples.withColumn("q_range", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000))
    before = with_previous(ranged, {"q_total": "total", "q_idle": "idle"}, "host", ["ts"])
    total, idle = F.col("total") - F.col("q_total"), F.col("idle") - F.col("q_idle")
    return before.select("host", "ts", F.when(total > 0, F.round((total - idle) / total * 1000) / 10).otherwise(F.when(total.isNotNull(), 0.0)).alias("cpu_percent"))


def top_per_event(blobs: DataFrame, n: int = 8, size: str = "size") -> DataFrame:
    """The n largest blobs of each event, ranked."""
    w = Window.partitionBy("event_id").orderBy(F.desc(size), "blob_id")
    return blobs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def macroblock_stats(blocks: DataFrame) -> DataFrame:
    """(camera, seq, skipped, intra, motion, qp: a row for each block) -> per frame: shares, median and 90th percentile of motion, mean QP."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    return blocks.groupBy("camera", "seq").agg(
        F.count(F.lit(1)).alias("n_blocks"), share("skipped").alias("skip_share"), share("intra").alias("intra_share"), F.percentile("motion", 0.5).alias("motion_median"), F.percentile("motion", 0.9).alias("motion_p90"), F.avg("qp").alias("qp_mean")
    )


def chart_scale(z: Column) -> Column:
    """The top of a chart: a little above the greatest value, at least 8."""
    return F.greatest(F.lit(8.0), F.max(z) * 1.05)
