"""Ordered rule cascades: the first stage that decides wins, an event that none decides is confirmed by default.

A stage is a name, a condition, a verdict and a reason, all column expressions, so a cascade is one CASE and the plan stays
a map. A stage whose condition is null or fails to apply passes the event on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONFIRM, SUPPRESS = "confirmed", "suppressed"


@dataclass(frozen=True)
class Stage:
    name: str
    when: Column
    verdict: str = SUPPRESS
    reason: Column | None = None


def idr_burst(min_z: float = 0.0) -> Stage:
    fires = F.contains(F.col("reason"), F.lit("unexpected_idr")) & ((F.lit(min_z) <= 0) | (F.col("z_score") >= min_z))
    return Stage("idr_burst", fires, SUPPRESS, F.format_string("idr_burst z=%.2f", F.col("z_score")))


def bytes_floor(ratio: float = 0.0, least: int = 0) -> Stage:
    low = (F.lit(ratio) > 0) & (F.col("bpf_slow") > 0) & (F.col("bytes") < F.lit(ratio) * F.col("bpf_slow"))
    small = (F.lit(least) > 0) & (F.col("bytes") < least)
    text = F.when(low, F.format_string("bytes %d < %.0f (%.1fx bpf_slow)", F.col("bytes"), F.lit(ratio) * F.col("bpf_slow"), F.lit(ratio)))
    return Stage("bytes_floor", low | small, SUPPRESS, text.otherwise(F.format_string("bytes %d < min %d", F.col("bytes"), F.lit(least))))


def intra_ratio(most: float = 0.0, below_z: float = 0.0) -> Stage:
    fires = (F.lit(most) > 0) & (F.lit(below_z) > 0) & (F.col("intra_ratio") > most) & (F.col("z_score") < below_z)
    text = F.format_string("intra_ratio=%.2f > %.2f with z=%.2f < %.2f", F.col("intra_ratio"), F.lit(most), F.col("z_score"), F.lit(below_z))
    return Stage("intra_ratio", fires, SUPPRESS, text)


def pass_through() -> Stage:
    return Stage("passthrough", F.lit(True), CONFIRM, F.lit("passthrough"))


def vision_gate(min_area: float, max_ssim: float, min_conf: float, classes: list[str], slow_target: Column) -> list[Stage]:
    """Over precomputed scores in ``label``: little foreground, an unchanged picture, or no wanted class, unless a target is slow."""
    frames = F.col("label.frames")
    area = F.array_max(F.transform(frames, lambda f: f["bgsub_area"]))
    ssim = F.array_min(F.transform(frames, lambda f: f["ssim"]))
    seen = F.exists(frames, lambda f: F.exists(f["detections"], lambda d: d["class"].isin(classes) & (d["confidence"] >= min_conf)))
    return [
        Stage("bgsub", area < min_area, SUPPRESS, F.lit("low_area")),
        Stage("ssim", ssim > max_ssim, SUPPRESS, F.lit("unchanged")),
        Stage("classes", ~seen & ~slow_target, SUPPRESS, F.lit("no_class")),
    ]


def default_stages() -> list[Stage]:
    """The order of the live post-processor; all but the first are off until given thresholds."""
    return [idr_burst(), bytes_floor(), intra_ratio(), pass_through()]


def cascade(events: DataFrame, stages: list[Stage]) -> DataFrame:
    """events with verdict, decided_by and suppress_reason (null where confirmed)."""
    decided: Column | None = None
    for s in stages:
        values = F.struct(F.lit(s.verdict).alias("verdict"), F.lit(s.name).alias("decided_by"), (F.lit(None).cast("string") if s.verdict == CONFIRM or s.reason is None else s.reason).alias("suppress_reason"))
        decided = (F.when if decided is None else decided.when)(s.when, values)
    default = F.struct(F.lit(CONFIRM).alias("verdict"), F.lit("default").alias("decided_by"), F.lit(None).cast("string").alias("suppress_reason"))
    decided = default if decided is None else decided.otherwise(default)
    return events.withColumn("q_decided", decided).select(*events.columns, "q_decided.*")


def subject_matches(subject: Column, pattern: str) -> Column:
    """Bus subjects: * is one token, > at the end one or more."""
    import re

    parts = [("[^.]+" if p == "*" else "[^.]+([.][^.]+)*" if p == ">" else re.escape(p)) for p in pattern.split(".")]
    return subject.rlike("^" + "[.]".join(parts) + "$")


def gate(events: DataFrame, drops: list[Column], overrides: list[Column]) -> DataFrame:
    """events with ``dropped``: any drop rule matches and no override does."""
    any_of = lambda rules: F.coalesce(F.greatest(*(F.coalesce(r, F.lit(False)) for r in [*rules, F.lit(False), F.lit(False)])), F.lit(False))
    return events.withColumn("dropped", any_of(drops) & ~any_of(overrides))


Decide = Callable[[DataFrame], DataFrame]


def deadline(events: DataFrame, latency_ms: Column, most_ms: int = 5000) -> DataFrame:
    """Verdicts that came too late are confirmed: a stage that hangs must not lose an event."""
    late = F.coalesce(latency_ms > most_ms, F.lit(False))
    put = lambda c, value: F.when(late, value).otherwise(F.col(c)).alias(c)
    values = {"verdict": F.lit(CONFIRM), "decided_by": F.lit("deadline"), "suppress_reason": F.lit(None).cast("string")}
    return events.select(*(put(c, values[c]) if c in values else F.col(c) for c in events.columns))
