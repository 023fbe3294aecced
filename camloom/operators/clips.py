"""Clips: listing, paging, labels, retention, disk usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from camloom.operators.running import running

LISTED = (".ts", ".mpegts", ".mp4", ".fmp4", ".mkv")
RETAINED = (".ts", ".mp4", ".mkv")


def extension(filename: Column) -> Column:
    """From the last dot on, case kept."""
    return F.regexp_extract(filename, r"(\.[^./]*)$", 1)


def listed(clips: DataFrame, camera: str | None = None, extensions: tuple[str, ...] = LISTED) -> DataFrame:
    kept = clips.where(extension(F.col("filename")).isin(*extensions))
    return kept if camera is None else kept.where(F.col("camera") == camera)


def with_sidecars(clips: DataFrame, meta: DataFrame | None, labels: DataFrame) -> DataFrame:
    """Clips with their metadata and label where they have some. A clip whose event id is not known has no label."""
    out = clips if meta is None else clips.join(meta, "event_id", "left")
    return out.join(labels.groupBy("event_id").agg(F.max("label").alias("label")), "event_id", "left")


def page(clips: DataFrame, number: int = 1, size: int = 50) -> DataFrame:
    """Newest first; size 1 to 500, else 50; a number below 1 is 1, beyond the end the last page. Only counts leave the rows."""
    size = size if 1 <= size <= 500 else 50
    total = clips.count()
    pages = max(1, -(-total // size))
    number = min(max(1, number), pages)
    return clips.orderBy(F.desc("mod_time"), "camera", "filename").offset((number - 1) * size).limit(size)


def totals(clips: DataFrame) -> DataFrame:
    return clips.agg(F.count(F.lit(1)).alias("n_clips"), F.sum("size").alias("total_bytes"), F.countDistinct("camera").alias("n_cameras"))


def page_totals(clips: DataFrame, number: int = 1, size: int = 50) -> DataFrame:
    """Clips and bytes of one page, as a listing shows them."""
    return page(clips, number, size).agg(F.count(F.lit(1)).alias("n_clips"), F.sum("size").alias("total_bytes"))


def disk_usage(clips: DataFrame) -> DataFrame:
    return clips.groupBy("camera").agg(F.sum("size").alias("total_bytes"), F.count(F.lit(1)).alias("n_clips"))


def page_numbers(current: Column, last: Column) -> Column:
    """First, last and two on either side of the current page, in order; -1 where numbers are left out."""
    near = F.filter(F.sequence(current - 2, current + 2), lambda n: (n >= 1) & (n <= last))
    shown = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(1), last), near)))
    with_gaps = F.transform(shown, lambda n, i: F.when((i > 0) & (n - F.get(shown, i - 1) > 1), F.array(F.lit(-1), n)).otherwise(F.array(n)))
    return F.flatten(with_gaps)


def retention(clips: DataFrame, now: Column, keep_days: int, quota_bytes: int = 0, quota_stops_age: bool = True, days: int = 30) -> DataFrame:
    """Clips to delete, per camera oldest first, with why: age, quota or age+quota.

    With a quota, a pass deletes while the camera is over it; once under, it looks at no more clips, so at most the oldest goes
    for its age (quota_stops_age=False: all aged ones go). Without one, all aged clips go.
    """
    kept = clips.where(extension(F.col("filename")).isin(*RETAINED)).withColumn("q_range", F.floor(F.unix_micros(F.col("mod_time").cast("timestamp")) / (days * 86_400_000_000)))
    upto = running(kept, {"q_upto": ("sum", F.col("size")), "q_place": ("sum", F.lit(1).cast("long"))}, "camera", ["mod_time", "filename"])
    rows = upto.withColumn("q_before", F.col("q_upto") - F.col("size")).join(kept.groupBy("camera").agg(F.sum("size").alias("q_total")), "camera")
    aged = F.lit(False) if keep_days <= 0 else F.col("mod_time") < now - F.make_dt_interval(F.lit(keep_days))
    over = F.lit(quota_bytes > 0) & ((F.col("q_total") - F.col("q_before")) > quota_bytes)
    goes_for_age = aged & (F.lit(quota_bytes <= 0 or not quota_stops_age) | (F.col("q_place") == 1))
    reason = F.when(aged & over, "age+quota").when(over, "quota").otherwise("age")
    return rows.where(over | goes_for_age).select("camera", "filename", "mod_time", "size", reason.alias("reason"))


def clip_labels_upserted(current: DataFrame, changes: DataFrame) -> DataFrame:
    """(event_id, label, labeled_at) after changes (same columns): the latest for each event; a null label deletes; others than
    tp, fp and reference are refused."""
    good = changes.where(F.col("label").isNull() | F.col("label").isin("tp", "fp", "reference"))
    latest = F.max(F.struct("labeled_at", F.col("label").isNull().alias("gone"), "label")).alias("l")
    return current.unionByName(good).groupBy("event_id").agg(latest).where("not l.gone").select("event_id", "l.label", "l.labeled_at")
