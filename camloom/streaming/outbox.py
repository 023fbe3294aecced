"""The outbox: what was written before it was published, and is published again until it is acknowledged.

Records and acknowledgements are two streams. A record is joined with acknowledgements that come within the time allowed; once the
watermark is past that, one without is put out, to be published again. In batch, what is not acknowledged is an anti join, numbered in the order
of its keys (which rise with time) in two levels. ``admitted`` keeps a full outbox from growing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from camloom.operators.running import numbered

#: Shares of the capacity from which events are held back, and from which none is taken.
BUSY, FULL = 0.9, 1.0


def unacknowledged_stream(records: DataFrame, acks: DataFrame, allowed: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """(event_id, ts, ...) and (event_id, ack_ts) as streams -> the records that are not acknowledged from their ts until ``allowed`` later.

    Both sides are kept in state only as long as they may still meet. Repeated records are each put out; a record whose id or time is null
    is never acknowledged and never put out.
    """
    left = records.withWatermark("ts", delay)
    right = acks.select(F.col("event_id").alias("ack_id"), "ack_ts").withWatermark("ack_ts", delay)
    met = (F.col("event_id") == F.col("ack_id")) & (F.col("ack_ts") >= F.col("ts")) & (F.col("ack_ts") <= F.col("ts") + F.expr(f"interval {allowed}"))
    return left.join(right, met, "leftOuter").where(F.col("ack_id").isNull() & F.col("event_id").isNotNull()).drop("ack_id", "ack_ts")


def replay(records: DataFrame, acks: DataFrame, letters: int = 20) -> DataFrame:
    """(bucket, key, ...) less those with an acknowledgement (bucket, key), with place: from 1, in key order of their bucket.

    Keys are texts that sort by time. Ranges of the order go by the first ``letters`` of a key. Records that repeat a key are each replayed;
    records with a null key are left out, as nothing could acknowledge them.
    """
    left = records.where(F.col("key").isNotNull()).join(acks.select("bucket", "key").distinct(), ["bucket", "key"], "left_anti")
    return numbered(left.withColumn("q_range", F.substring("key", 1, letters)), "bucket", ["key"], "place").drop("q_range")


def admitted(level: Column, capacity: int, urgent: Column) -> Column:
    """How an event fares at an outbox that holds so many bytes: taken, drop_outbox_full (90 % or more, unless it is urgent), or dropped (full)."""
    share = level / F.lit(float(capacity))
    return F.when(share >= FULL, "dropped").when((share >= BUSY) & ~urgent, "drop_outbox_full").otherwise("taken")
