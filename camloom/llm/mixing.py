"""Mixing sources to target weights by weighted fair queueing.

The documents of a source form a queue in a random order fixed by a hash. A document's virtual finish time is the words
of its source's queue up to and with it, over the source's target; a source that is to give more than it has queues
again in the same order, up to three times. The targets add up to the budget, so what has finished by time 1 is within it, for
every source.

A long document would keep all behind it waiting. So what has not finished by time 1 queues again behind what has, the smallest
first, and takes what of it finishes by time 1 now. Then no entry that is left fits its source, and each source's next one, the smallest
that is left, comes last if it brings the source nearer to its target: these are sorted by finish time over all sources and cut where the words reach the
total budget. A source's words differ from its target by less than its smallest entry that is left.

Running sums never need one task: within a source they go by ranges of the hash (sums of ranges first, in
two levels, then inside each). The smallest that are left are found from sums by size, and inside one size by ranges of the hash again.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from camloom.llm.common import text_of, word_count, written

WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
SEED = "mix-1"
#: Rows of a range in which running sums are made by one task.
RANGE_ROWS = 5_000


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) -> with weight and target: the total shared by weight, none above MOST_PASSES times its size.

    Sources take the weights in code point order, null last. Where some stop at their limit, the rest share what is left by
    weight: with sources in order of limit / weight, those that stop come first.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    all_ = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cap = F.col("cap")
    up = Window.orderBy(cap / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    capped = sources.withColumn("weight", w).withColumn("cap", (F.col("source_size") * MOST_PASSES).cast("double"))
    shared = (
        capped.withColumn("rest", F.sum("source_size").over(all_).cast("double") - F.coalesce(F.sum("cap").over(up), F.lit(0.0)))
        .withColumn("w_rest", F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(up), F.lit(0.0)))
        .withColumn("stops", cap * F.col("w_rest") <= F.col("rest") * F.col("weight"))
    )
    first = F.min(F.when(~F.col("stops"), F.struct(cap / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("rest"), F.col("w_rest")))).over(all_)
    level = shared.withColumn("level", first)
    return level.select("source", "source_size", F.when(F.col("stops"), cap).otherwise(F.col("level")["rest"] * F.col("weight") / F.col("level")["w_rest"]).alias("target"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (= copies * size) of every row.

    Null texts have size 0; so have empty ones. Documents of size 0 take no words and count one copy. A null source is a
    source, the last. The order is by a hash of the id, then id and size, so it is the same on every run; rows that repeat
    an id stand beside each other and each takes words of its own. An empty table gives an empty result. Columns other than
    the three named are not read.
    """
    sized = written(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), word_count(text_of(f"`{text}`")).alias("size")), "sized")
    n = sized.count()
    digits = max(1, math.ceil(math.log(max(n / RANGE_ROWS, 1), 16)))
    keyed = sized.withColumn("key", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(SEED))))
    keyed = keyed.withColumn("range", F.substring("key", 1, digits))
    offsets = before_ranges(keyed.groupBy("source", "range").agg(F.sum("size").alias("range_size")), digits)
    aims = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights)
    same = lambda a, b: a.join(b.withColumnRenamed("source", "q_source"), F.col("source").eqNullSafe(F.col("q_source"))).drop("q_source")
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    summed = keyed.withColumn("upto", F.sum("size").over(inside))
    placed = summed.join(same(offsets, aims).withColumnsRenamed({"source": "q_source", "range": "q_range"}), F.col("source").eqNullSafe(F.col("q_source")) & (F.col("range") == F.col("q_range")))
    finished = lambda e: F.col("offset") + F.col("upto") + e * F.col("source_size") <= F.col("target")
    first = F.when(F.col("size") == 0, MOST_PASSES).otherwise(sum((finished(e).cast("int") for e in range(MOST_PASSES)), F.lit(0)))
    queue = written(placed.select("doc_id", "source", "size", "key", "range", "source_size", "target", first.alias("first")), "queue")

    rest = MOST_PASSES - F.col("first")
    marks = written(refilled(queue.withColumn("rest", rest)), "marks")
    marked = same(queue.withColumn("rest", rest), marks.select("source", "mark", "at_mark"))
    at = marked.where("size = mark and rest > 0")
    before = before_ranges(at.groupBy("source", "range").agg(F.sum("rest").cast("long").alias("range_size")), digits)
    up = Window.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    numbered = at.withColumn("earlier", F.coalesce(F.sum("rest").over(up), F.lit(0)))
    inner = numbered.join(before.withColumnsRenamed({"source": "q_source", "range": "q_range"}), F.col("source").eqNullSafe(F.col("q_source")) & (F.col("range") == F.col("q_range")))
    among = inner.withColumn("again", F.least(F.greatest(F.col("at_mark") - F.col("offset") - F.col("earlier"), F.lit(0)), F.col("rest")))
    others = marked.where("size != mark or mark is null or rest = 0").withColumn("again", F.when(F.col("mark").isNull() | (F.col("size") < F.col("mark")), F.col("rest")).otherwise(0))
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("first") + F.col("again")).cast("int")
    names = ["doc_id", "source", "size", "source_size", "target"]
    return others.unionByName(among, allowMissingColumns=True).select(*names, copies.alias("copies"), (F.col("size") * copies).cast("long").alias("taken"))


def refilled(queue: DataFrame) -> DataFrame:
    """(source, size, source_size, target, first, rest) -> for each source the size (mark) below which all that is left is taken, and how many
    entries of that size are (at_mark). A null mark: all is taken. Sums go by size, so a source is as many rows as it has sizes."""
    named = {"source": "q_source"}
    taken = queue.groupBy("source").agg(F.first("target").alias("target"), F.first("source_size").alias("source_size"), F.sum(F.col("size") * F.col("first")).cast("long").alias("taken"), F.sum(F.when(F.col("size") > 0, F.col("size") * F.col("rest"))).cast("long").alias("all"))
    sizes = queue.where("size > 0 and rest > 0").groupBy("source", "size").agg(F.sum(F.col("size") * F.col("rest")).cast("long").alias("words"))
    upto = sizes.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("size")))
    gaps = taken.withColumn("gap", F.col("target") - F.col("taken"))
    over = upto.join(gaps.select(F.col("source").alias("q_source"), "gap"), F.col("source").eqNullSafe(F.col("q_source"))).where("upto > gap")
    least = over.groupBy("source").agg(F.min(F.struct("size", (F.col("upto") - F.col("words")).alias("below"))).alias("least"))
    marks = gaps.join(least.withColumnsRenamed(named), F.col("source").eqNullSafe(F.col("q_source")), "left")
    fit = F.floor((F.col("gap") - F.col("least.below")) / F.col("least.size")).cast("long")
    filled = marks.select("source", "target", "source_size", F.col("least.size").alias("mark"), fit.alias("fit"), (F.col("taken") + F.coalesce(F.col("least.below") + fit * F.col("least.size"), F.col("all"), F.lit(0))).alias("taken"))
    # One row a source: the next entry of each that comes nearer by it, in order of finish time, as long as the budget lasts.
    every = Window.partitionBy(F.lit(0))
    budget = F.sum("source_size").over(every) - F.sum("taken").over(every)  # in whole words
    nearer = F.coalesce(F.col("mark") < 2 * (F.col("target") - F.col("taken")), F.lit(False))
    order = Window.partitionBy(F.lit(0)).orderBy((F.col("taken") + F.col("mark")) / F.col("target"), F.col("source").isNull(), "source")
    words = F.sum(F.when(F.col("nearer"), F.col("mark")).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    last = filled.withColumn("nearer", nearer).withColumn("budget", budget).withColumn("one", (F.col("nearer") & (words <= F.col("budget"))).cast("int"))
    return last.select("source", "mark", (F.col("fit") + F.col("one")).alias("at_mark"))


def before_ranges(sums: DataFrame, digits: int) -> DataFrame:
    """(source, range, range_size) -> (source, range, offset): the words before each range. In two levels, by the first half
    of the range's digits and inside it, so that no task holds more than about the root of a source's ranges."""
    earlier = lambda *by: Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    halved = sums.withColumn("half", F.substring("range", 1, digits // 2))
    halves = halved.groupBy("source", "half").agg(F.sum("range_size").alias("range_size")).withColumnRenamed("half", "range")
    far = halves.select(F.col("source").alias("q_source"), F.col("range").alias("q_half"), F.coalesce(F.sum("range_size").over(earlier("source")), F.lit(0)).alias("far"))
    close = halved.withColumn("close", F.coalesce(F.sum("range_size").over(earlier("source", "half")), F.lit(0)))
    both = close.join(far, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("half") == F.col("q_half")))
    return both.select("source", "range", (F.col("far") + F.col("close")).alias("offset"))


def op1_mixing(spark, sf_dir):
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


def oracle_sql() -> str:
    return f"""
with sized as (select doc_id, source, cast(len(regexp_extract_all(coalesce("text", ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size,
    md5(coalesce(cast(doc_id as varchar), 'null') || ':{SEED}') as key from documents),
s0 as (select source, cast(sum(size) as bigint) as source_size, cast({MOST_PASSES} * sum(size) as double) as cap from sized group by source),
s1 as (select *, [5e0, 2e0, 1e0][((row_number() over (order by source is null, source) - 1) % 3) + 1] as weight from s0),
s2 as (select *, cast(sum(source_size) over () as double) - coalesce(sum(cap) over (order by cap / weight, source is null, source rows between unbounded preceding and 1 preceding), 0) as rest,
    sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, source is null, source rows between unbounded preceding and 1 preceding), 0) as w_rest from s1),
s3 as (select *, cap * w_rest <= rest * weight as stops from s2),
lv as (select rest as l_rest, w_rest as l_w from s3 where not stops order by cap / weight, source is null, source limit 1),
aims as (select source, source_size, case when stops then cap else (select l_rest from lv) * weight / (select l_w from lv) end as target from s3),
queue as (select z.*, source_size, target, sum(size) over (partition by z.source order by key, doc_id, size rows between unbounded preceding and current row) as upto
    from sized z join aims a on z.source is not distinct from a.source),
firsts as (select *, case when size = 0 then 0 else {MOST_PASSES} - ({' + '.join(f"cast(upto + {e} * source_size <= target as int)" for e in range(MOST_PASSES))}) end as rest from queue),
gaps as (select source, any_value(target) as target, cast(sum(size * ({MOST_PASSES} - rest)) as bigint) as had, any_value(target) - had as gap from firsts group by source),
line as (select f.*, gap, sum(rest * size) over (partition by f.source order by size, key, doc_id rows between unbounded preceding and current row) - rest * size as before
    from firsts f join gaps g on f.source is not distinct from g.source where size > 0),
fill as (select *, cast(greatest(0, least(rest, floor((gap - before) / size))) as bigint) as again, row_number() over (partition by source order by size, key, doc_id) as place from line),
nexts as (select source, min_by(size, place) as mark, min(place) as place from fill where again < rest group by source),
ends as (select g.source, g.target, cast(g.had + coalesce(sum(f.again * f.size), 0) as bigint) as had from gaps g left join fill f on g.source is not distinct from f.source group by g.source, g.target, g.had),
near as (select e.source, mark, place, (e.had + mark) / e.target as finish from ends e join nexts n on e.source is not distinct from n.source where mark < 2 * (e.target - e.had)),
lasts as (select source, place, sum(mark) over (order by finish, source is null, source rows between unbounded preceding and current row) as words from near),
extra as (select source, place from lasts where words <= (select sum(size) from sized) - (select sum(had) from ends))
select f.doc_id, f.size, f.source_size, f.target, cast(0 as bigint) as taken from firsts f where f.size = 0
union all
select f.doc_id, f.size, f.source_size, f.target, cast(f.size * ({MOST_PASSES} - rest + again + cast(x.place is not null as int)) as bigint) as taken
from fill f left join extra x on f.source is not distinct from x.source and f.place = x.place"""
