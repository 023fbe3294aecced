"""Clips from events: sessions that end after a pause, and are cut where they last too long.

Where a session is cut depends on where it was cut before: a cut is the first event more than the limit after the event that
the clip began with. So each event points to the one that would be cut after it (an as-of lookup in the order of the camera),
and the cuts are what the first event of a session reaches along these pointers. Pointers are doubled: with those over 2^k
cuts the first 2^k cuts give the next 2^k, so rounds grow with the logarithm of a session's cuts, and each is two joins on (camera, number). Only
sessions that last longer than the limit take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from camloom.operators.running import SPAN, ranged, running, with_previous
from camloom.sources.shared import dropped, scratch

MICROS = 1_000_000


def next_cuts(events: DataFrame, max_seconds: float, by: str, days: float) -> DataFrame:
    """(by, n, us, last) -> by, n, to: the first event more than max_seconds after event n, if its session's last is not before it."""
    row = lambda us, late: (F.col(us).alias("us"), F.lit(late).alias("late"))
    here = events.select(by, *row("us", 0), F.col("n").alias("seen"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("last"))
    limit = events.withColumn("us", F.col("us") + F.lit(int(max_seconds * MICROS)))
    asks = limit.select(by, *row("us", 1), F.lit(None).cast("long").alias("seen"), "n", "last")
    merged = here.unionByName(asks).withColumn("q_range", F.floor(F.col("us") / (days * 86_400 * MICROS)))
    found = running(merged, {"upto": ("max", F.col("seen"))}, by, ["us", "late"])
    return found.where(F.col("n").isNotNull() & (F.col("upto") < F.col("last"))).select(by, "n", (F.col("upto") + 1).alias("to"))


def reached(firsts: DataFrame, pointers: DataFrame, by: str) -> DataFrame:
    """(by, n) of all that firsts reach along pointers (by, n, to), themselves included. Nothing is reached twice: pointers go forward
    and no two sessions share events."""
    marks, step = scratch(firsts.select(by, "n"), "marks"), scratch(pointers.select(by, "n", "to"), "pointers")
    while True:
        new = scratch(marks.join(step, [by, "n"]).select(by, F.col("to").alias("n")), "marks")
        if new.isEmpty():
            dropped(new, step)
            return marks
        both = scratch(marks.unionByName(new), "marks")
        far = step.select(by, F.col("n").alias("to"), F.col("to").alias("q_far"))
        twice = scratch(step.join(far, [by, "to"]).select(by, "n", F.col("q_far").alias("to")), "pointers")
        dropped(marks, new, step)
        marks, step = both, twice


def capped_sessions(events: DataFrame, gap_seconds: float, max_seconds: float, by: str = "camera", days: float = 1, span: int = SPAN) -> DataFrame:
    """Events no more than gap_seconds after the one before, and no more than max_seconds after their session's first, are one
    session: by, session, first_ts, last_ts, n. An event beyond max_seconds begins the next.

    Events are in order of (ts, event_id); those with a null ts or key belong to no session. Ties in ts are never parted by the gap. An
    empty table gives an empty result.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.where(F.col("ts").isNotNull() & F.col(by).isNotNull()).select(by, "ts", "event_id", us.alias("us"))
    rows = rows.withColumn("q_range", F.floor(F.col("us") / (days * 86_400 * MICROS)))
    order = ["ts", "event_id"]
    fresh = (F.col("q_first") | (F.col("us") - F.col("q_before") > int(gap_seconds * MICROS))).cast("long")
    placed = running(with_previous(rows, {"q_before": "us"}, by, order), {"island": ("sum", fresh), "n": ("sum", F.lit(1).cast("long"))}, by, order)
    table = scratch(placed.select(by, "ts", "us", "island", "n"), "events")
    islands = table.groupBy(by, "island").agg(F.min("n").alias("first"), F.max("n").alias("last"), F.min("us").alias("q_from"), F.max("us").alias("q_to"))
    long = scratch(islands.where(F.col("q_to") - F.col("q_from") > int(max_seconds * MICROS)).select(by, "island", "first", "last"), "islands")
    inside = table.join(long, [by, "island"]).select(by, "n", "us", "last")
    cuts = reached(long.select(by, F.col("first").alias("n")), next_cuts(inside, max_seconds, by, days), by)
    starts = islands.select(by, F.col("first").alias("n")).unionByName(cuts).distinct().withColumn("q_starts", F.lit(1).cast("long"))
    marked = table.join(starts, [by, "n"], "left")
    numbered = running(ranged(marked, "n", span), {"session": ("sum", F.coalesce("q_starts", F.lit(0)))}, by, ["n"])
    return numbered.groupBy(by, "session").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))
