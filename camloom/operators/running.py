"""Running aggregates in two levels: a key's rows are cut into ranges of their order, so a busy key is many tasks.

First each range is aggregated (map-side, one row a range), and the aggregates run over the ranges of a key; then rows run
inside their range, on top of what came before it. ``range_`` is a whole number that never falls along the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a key in one task, where the order is a dense number.
SPAN = 1 << 20


def ranged(df: DataFrame, order: str, span: int = SPAN) -> DataFrame:
    return df.withColumn("q_range", F.floor(F.col(order) / span))


def running(df: DataFrame, values: dict[str, tuple[str, Column]], by: str, order: list[str]) -> DataFrame:
    """df, which has q_range, with a column for each (name: (sum or max, value)): over the rows of the key up to and with this one."""
    kinds = {"sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), "max": (F.max, lambda a, b: F.greatest(a, b))}
    rows = df.withColumns({f"q_{n}": v for n, (_, v) in values.items()})
    over = Window.partitionBy(by).orderBy("q_range").rowsBetween(Window.unboundedPreceding, -1)
    each = rows.groupBy(by, "q_range").agg(*(kinds[k][0](f"q_{n}").alias(f"q_all_{n}") for n, (k, _) in values.items()))
    before = each.select(by, "q_range", *(kinds[k][0](f"q_all_{n}").over(over).alias(f"q_before_{n}") for n, (k, _) in values.items()))
    inside = Window.partitionBy(by, "q_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    here = rows.withColumns({f"q_{n}": kinds[k][0](f"q_{n}").over(inside) for n, (k, _) in values.items()})
    both = here.join(before, [by, "q_range"])
    return both.select(*df.columns, *(kinds[k][1](F.col(f"q_{n}"), F.col(f"q_before_{n}")).alias(n) for n, (k, _) in values.items()))


def numbered(df: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """df, which has q_range, with a number from 1 along the order of its key."""
    counts = df.groupBy(by, "q_range").agg(F.count(F.lit(1)).alias("q_n"))
    over = Window.partitionBy(by).orderBy("q_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(by, "q_range", F.coalesce(F.sum("q_n").over(over), F.lit(0)).alias("q_before"))
    place = F.row_number().over(Window.partitionBy(by, "q_range").orderBy(*order))
    return df.withColumn("q_place", place).join(before, [by, "q_range"]).select(*df.columns, (F.col("q_place") + F.col("q_before")).cast("long").alias(name))


def with_previous(df: DataFrame, columns: dict[str, str], by: str, order: list[str]) -> DataFrame:
    """df, which has q_range, with a column for each (name: column) of the key's row before this one, and q_first: there is none."""
    key = F.struct(*order)
    last = df.groupBy(by, "q_range").agg(*(F.max_by(c, key).alias(f"q_last_{n}") for n, c in columns.items()))
    over = Window.partitionBy(by).orderBy("q_range")
    before = last.select(by, "q_range", (F.row_number().over(over) == 1).alias("q_opens"), *(F.lag(f"q_last_{n}").over(over).alias(f"q_before_{n}") for n in columns))
    inside = Window.partitionBy(by, "q_range").orderBy(*order)
    here = df.withColumn("q_place", F.row_number().over(inside)).withColumns({n: F.lag(c).over(inside) for n, c in columns.items()})
    both = here.join(before, [by, "q_range"])
    starts = F.col("q_place") == 1
    return both.select(*df.columns, *(F.when(starts, F.col(f"q_before_{n}")).otherwise(F.col(n)).alias(n) for n in columns), (starts & F.col("q_opens")).alias("q_first"))


def with_next(df: DataFrame, columns: dict[str, str], by: str, order: list[str]) -> DataFrame:
    """df, which has q_range, with a column for each (name: column) of the key's row after this one; null for its last."""
    key = F.struct(*order)
    first = df.groupBy(by, "q_range").agg(*(F.min_by(c, key).alias(f"q_first_{n}") for n, c in columns.items()))
    over = Window.partitionBy(by).orderBy("q_range")
    after = first.select(by, "q_range", *(F.lead(f"q_first_{n}").over(over).alias(f"q_after_{n}") for n in columns))
    inside = Window.partitionBy(by, "q_range").orderBy(*order)
    here = df.withColumns({n: F.lead(c).over(inside) for n, c in columns.items()}).withColumn("q_last", F.lead(F.lit(True)).over(inside).isNull())
    both = here.join(after, [by, "q_range"])
    return both.select(*df.columns, *(F.when(F.col("q_last"), F.col(f"q_after_{n}")).otherwise(F.col(n)).alias(n) for n in columns))
