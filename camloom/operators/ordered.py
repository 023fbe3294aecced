"""Operators that follow the order of a camera's records: access units, fragments, timelines, snapshots, sessions.

Running values go in two levels (``running``): a camera with a third of all records is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from camloom.operators.running import SPAN, numbered, ranged, running, with_next, with_previous

KEYFRAME, PARAMSET, BFRAME = 1, 2, 8
CLOCK = 90  # ticks a millisecond


def flag(bit: int, column: str = "flags") -> Column:
    return F.col(column).bitwiseAND(F.lit(bit).cast("smallint")) > 0


def islands(df: DataFrame, value: str, by: str = "camera", order: str = "seq", span: int = SPAN) -> DataFrame:
    """with ``island``: consecutive rows of equal value share a number.

    Ranges number their own; a range whose first value is the last one of the range before goes on with its island.
    """
    inside = Window.partitionBy(by, "q_range").orderBy(order)
    rows = ranged(df, order, span).withColumn("q_new", ((F.row_number().over(inside) == 1) | ~F.col(value).eqNullSafe(F.lag(value).over(inside))).cast("long"))
    here = rows.withColumn("q_local", F.sum("q_new").over(inside))
    each = here.groupBy(by, "q_range").agg(F.max("q_local").alias("k"), F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))
    over = Window.partitionBy(by).orderBy("q_range")
    goes_on = ((F.row_number().over(over) > 1) & F.col("first").eqNullSafe(F.lag("last").over(over))).cast("long")
    offsets = each.withColumn("on", goes_on).select(by, "q_range", (F.coalesce(F.sum("k").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.sum("on").over(over)).alias("q_off"))
    return here.join(offsets, [by, "q_range"]).select(*df.columns, (F.col("q_local") + F.col("q_off")).alias("island"))


def access_units(nal: DataFrame, span: int = SPAN) -> DataFrame:
    """Consecutive NAL records with equal PTS are one unit: bytes summed, flags joined. The last unit of a camera is still
    open and is not given, nor is one of 0 bytes."""
    units = islands(nal, "pts_90khz", span=span).groupBy("camera", "island").agg(
        F.min("seq").alias("first_seq"), F.min("pts_90khz").alias("pts_90khz"), F.sum("length").alias("byte_count"), F.count(F.lit(1)).alias("n_nal"),
        F.bool_or(flag(KEYFRAME)).alias("is_keyframe"), F.bool_or(flag(PARAMSET)).alias("is_intra"), F.bool_or(flag(BFRAME)).alias("is_bframe"),
    )
    # The camera's last record, from a scan of one column: asking the units for it would make them twice.
    last = nal.groupBy("camera").agg(F.max("seq").alias("q_last"))
    return units.join(last, "camera").where((F.col("first_seq") + F.col("n_nal") - 1 < F.col("q_last")) & (F.col("byte_count") > 0)).drop("q_last")


def since_keyframe(frames: DataFrame, span: int = SPAN) -> DataFrame:
    """Frames since the last keyframe; null before the first."""
    placed = running(ranged(frames, "seq", span), {"q_n": ("sum", F.lit(1).cast("long"))}, "camera", ["seq"])
    found = running(ranged(placed, "seq", span), {"q_kf": ("max", F.when(F.col("is_keyframe"), F.col("q_n")))}, "camera", ["seq"])
    return found.select(*frames.columns, (F.col("q_n") - F.col("q_kf")).alias("since_kf"))


def fragments(nal: DataFrame, span: int = SPAN) -> DataFrame:
    """with fragment: a new one at each keyframe but the first record; offset from the camera's first PTS; tables every 90."""
    first = nal.groupBy("camera").agg(F.min_by("pts_90khz", "seq").alias("q_pts"), F.min("seq").alias("q_seq"))
    starts = (flag(KEYFRAME) & (F.col("seq") > F.col("q_seq"))).cast("long")
    rows = running(ranged(nal.join(first, "camera"), "seq", span), {"q_n": ("sum", F.lit(1).cast("long")), "fragment": ("sum", starts)}, "camera", ["seq"])
    return rows.select(*nal.columns, "fragment", (F.col("pts_90khz") - F.col("q_pts")).alias("pts_offset"), ((F.col("q_n") - 1) % 90 == 0).alias("with_tables"))


def z_timeline(records: DataFrame, cap: int | None = None, by: str = "camera", span: int = SPAN) -> DataFrame:
    """(by, seq, pts_90khz, flags, z_score) -> by, offset_ms, z_score, is_keyframe, is_bframe, width_ms: consecutive equal PTS are
    one point with the last z that is not 0; then each point takes the z of the next, the last 0; at most cap points."""
    points = islands(records, "pts_90khz", by, span=span).groupBy(by, "island").agg(
        F.min("pts_90khz").alias("pts"), F.bool_or(flag(KEYFRAME)).alias("is_keyframe"), F.bool_or(flag(BFRAME)).alias("is_bframe"),
        F.max(F.when(F.col("z_score") != 0, F.struct("seq", "z_score"))).alias("last"),
    )
    if cap is not None:
        points = points.where(F.col("island") <= cap + 1)
    points = points.select(by, "island", "pts", "is_keyframe", "is_bframe", F.coalesce(F.col("last.z_score"), F.lit(0.0)).alias("z"))
    first = points.where("island = 1").select(by, F.col("pts").alias("q_first"))
    both = with_next(ranged(points, "island", span), {"q_next": "pts", "q_z": "z"}, by, ["island"]).join(first, by)
    shown = both if cap is None else both.where(F.col("island") <= cap)
    ms = lambda ticks: (ticks / CLOCK).cast("long")
    return shown.select(by, ms(F.col("pts") - F.col("q_first")).alias("offset_ms"), F.coalesce("q_z", F.lit(0.0)).alias("z_score"), "is_keyframe", "is_bframe", ms(F.col("q_next") - F.col("pts")).alias("width_ms"))


def roll_windows(events: DataFrame) -> DataFrame:
    """with pre_pts and post_pts around pts_90khz from pre_roll_seconds and post_roll_seconds."""
    second = 1000 * CLOCK
    return events.withColumn("pre_pts", F.greatest(F.lit(0), F.col("pts_90khz") - F.col("pre_roll_seconds") * second)).withColumn("post_pts", F.col("pts_90khz") + F.col("post_roll_seconds") * second)


def snapshots(nal: DataFrame, windows: DataFrame, span: int = SPAN, ticks: int = 1 << 30) -> DataFrame:
    """For each window (camera, window_id, from_pts, to_pts) the first and last seq of its records and their sums.

    The end is the newest record at or before to_pts; the start the newest keyframe or parameter set strictly before
    from_pts, else the camera's oldest record. Without a record at or before to_pts there is none. PTS must not fall within a
    camera. Both bounds are as-of lookups: windows and records are merged in one order per camera and the greatest record so
    far runs along it; the sums are differences of running sums. No record is paired with the windows that cover it.
    """
    summed = running(ranged(nal, "seq", span), {"upto": ("sum", F.col("length"))}, "camera", ["seq"])
    record = F.struct("seq", "upto", (F.col("upto") - F.col("length")).alias("before"))
    kind = summed.select(record.alias("r")).schema["r"].dataType
    rows = summed.select("camera", F.col("pts_90khz").alias("pts"), F.lit(0).alias("late"), record.alias("r"), (flag(KEYFRAME) | flag(PARAMSET)).alias("entry"), F.lit(None).cast("long").alias("window_id"), F.lit(None).cast("boolean").alias("is_end"))
    # A window's end comes after the records of its PTS, its start before them.
    bound = lambda pts, late, end: F.struct(F.col(pts).alias("pts"), F.lit(late).alias("late"), F.lit(end).alias("is_end"))
    asks = windows.select("camera", "window_id", F.explode(F.array(bound("to_pts", 1, True), bound("from_pts", -1, False))).alias("e")).select(
        "camera", "e.pts", "e.late", F.lit(None).cast(kind).alias("r"), F.lit(None).cast("boolean").alias("entry"), F.col("window_id").cast("long").alias("window_id"), "e.is_end"
    )
    merged = rows.unionByName(asks).withColumn("q_range", F.floor(F.col("pts") / ticks))
    seen = running(merged, {"newest": ("max", F.col("r")), "entry_at": ("max", F.when(F.col("entry"), F.col("r")))}, "camera", ["pts", "late"])
    oldest = summed.groupBy("camera").agg(F.min(record).alias("oldest"))
    found = seen.where(F.col("window_id").isNotNull()).groupBy("camera", "window_id").agg(F.max(F.when(F.col("is_end"), F.col("newest"))).alias("head"), F.max(F.when(~F.col("is_end"), F.col("entry_at"))).alias("tail"))
    whole = found.where(F.col("head").isNotNull()).join(oldest, "camera").withColumn("tail", F.coalesce("tail", "oldest"))
    return whole.select(
        "camera", "window_id", F.col("tail.seq").alias("first_seq"), F.col("head.seq").alias("last_seq"), (F.col("head.seq") - F.col("tail.seq") + 1).alias("n_records"), (F.col("head.upto") - F.col("tail.before")).alias("n_bytes")
    )


def clip_times(first_pts: Column, last_pts: Column, trigger_pts: Column, pre_roll_seconds: Column) -> Column:
    """duration_ms of a clip, and trigger_offset_ms: from its true start to the trigger, which is before the pre-roll where the clip
    was widened to a keyframe; the pre-roll where that is not known or 0."""
    duration = F.when(last_pts > first_pts, F.floor((last_pts - first_pts) / CLOCK)).otherwise(0)
    offset = F.when((trigger_pts > 0) & (trigger_pts >= first_pts), F.floor((trigger_pts - first_pts) / CLOCK)).otherwise(0)
    return F.struct(duration.cast("long").alias("duration_ms"), F.when(offset > 0, offset).otherwise(pre_roll_seconds * 1000).cast("long").alias("trigger_offset_ms"))


def extended(nal: DataFrame, windows: DataFrame, more: int) -> DataFrame:
    """Snapshots of windows whose end is moved on by so many ticks."""
    return snapshots(nal, windows.withColumn("to_pts", F.col("to_pts") + more))


def newest(records: DataFrame, cap: int) -> DataFrame:
    """A bounded ring's content: the last cap - 1 records of each camera."""
    return records.withColumn("q_rank", F.row_number().over(Window.partitionBy("camera").orderBy(F.desc("seq")))).where(F.col("q_rank") <= cap - 1).drop("q_rank")


def sessions(events: DataFrame, gap_seconds: int, by: str = "camera", days: int = 1) -> DataFrame:
    """Events no more than gap_seconds after the one before are one session: by, session, first_ts, last_ts, n."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.select(by, "ts", "event_id", micros.alias("q_us")).withColumn("q_range", F.floor(F.col("q_us") / (days * 86_400_000_000)))
    order = ["ts", "event_id"]
    fresh = (F.col("q_first") | (F.col("q_us") - F.col("q_before") > gap_seconds * 1_000_000)).cast("long")
    numbered = running(with_previous(rows, {"q_before": "q_us"}, by, order), {"session": ("sum", fresh)}, by, order)
    return numbered.groupBy(by, "session").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))


def rate_limited(events: DataFrame, n: int, unit: str = "second") -> DataFrame:
    """The first n events of each camera and unit of time."""
    w = Window.partitionBy("camera", F.date_trunc(unit, F.col("ts").cast("timestamp"))).orderBy("ts", "event_id")
    return events.withColumn("q_rank", F.row_number().over(w)).where(F.col("q_rank") <= n).drop("q_rank")


def sampled(frames: DataFrame, every: int = 150, span: int = SPAN) -> DataFrame:
    """Each every-th frame of a camera."""
    return numbered(ranged(frames, "seq", span), "camera", ["seq"], "q_n").where(F.col("q_n") % every == 0).drop("q_n", "q_range")
