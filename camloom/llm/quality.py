"""Quality rules: per-document text statistics, fixed rules, and robust multivariate outliers per language and source.

Native: DataFrame functions only. Statistics become four bounded, transformed features in whole thousandths, so every sum
is exact and reruns agree. Location and scatter of each (language, source) group are minimum-covariance-determinant
estimates: of all subsets of ``SUPPORT`` of the group, the one whose (regularised) covariance has the least determinant is
looked for by concentration steps from three starts: quartiles, hyperbolic tangents, spatial signs. A step measures
the group from the estimate and refits on the nearest h of its n rows, exactly h; it can only lower the determinant, and
steps go on until none falls. The start with the least determinant wins, rows within the 0.975 quantile are fitted once more
(reweighting), and squared Mahalanobis distances from that fit are judged.

The nearest h are found without sorting a group: rows are counted by bins of distance, then by parts of the one bin in which
the h-th lies, and so on (all map-side); only the few rows of the last part are ordered.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from camloom.llm.common import SPACES, text_of, written

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
OUTPUT = (*STATS, "base_failed", "distance", "kept")
P = 4
#: Share of a group's rows that an estimate is of, least rows of one, and 0.75 / P(chi2(6) <= chi2(4) quantile of 0.75).
SUPPORT, LEAST, CONSISTENCY = 0.75, 10, 1.485
#: The chi-square quantile with 4 degrees of freedom at 0.975 that the last fit takes rows within, and its consistency factor.
REWEIGHT, REWEIGHT_CONSISTENCY = 11.143, 1.0645
#: Groups with fewer documents are pooled by language, pools with fewer over all languages; the last pool is fitted at any size.
MIN_GROUP = 100
#: Squared distance from which a document is an outlier: the chi-square quantile with 4 degrees of freedom at 1 - 3e-7.
CUTOFF = 36.0
#: A standard deviation of each feature, in thousandths, whose square is added to each variance: the regularisation that keeps the
#: scatter of features that are mostly 0 invertible.
FLOORS = (100, 180, 80, 80)

#: In SQL that Spark and DuckDB share; each is whole thousandths.
FEATURES = (
    "cast(floor(1000e0 * ln((word_chars + 250e0) / (n_words + 50e0)) + 5e-1) as bigint)",
    "cast(floor(1000e0 * ln(1e0 + 20e0 * n_symbols / (n_words + 20e0)) + 5e-1) as bigint)",
    "cast(floor(1000e0 * ln(1e0 + 10e0 * n_dup_lines / (n_words + 50e0)) + 5e-1) as bigint)",
    "cast(floor(1000e0 * n_repeat_words / (n_words + 20e0) + 5e-1) as bigint)",
)
BASE_FAILED = "(n_words < 20 or 100 * n_repeat_words > 30 * n_words)"
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def repeated_words(hashes: Column) -> Column:
    """Words inside 8-word windows whose 64-bit hash occurs at least twice in the array ``hashes``, one hash a window.

    Sorted by (hash, place), a window that repeats has a neighbour with its hash; the places of those windows in order
    give the words covered: 8 from each, or fewer up to the next one's first word.
    """
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        same = lambda a, b: F.get(s, a)["h"] == F.get(s, b)["h"]
        return F.filter(
            F.transform(s, lambda x, k: F.when(F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)), x["i"])),
            lambda i: i.isNotNull(),
        )

    def covered(at: Column) -> Column:
        return F.aggregate(
            F.transform(at, lambda i, k: F.least(F.lit(8), F.coalesce(F.get(at, k + 1) - i, F.lit(8)))),
            F.lit(0).cast("long"),
            lambda n, x: n + x,
        )

    # An array of one element binds its value to a variable, so it is computed once and not again for each element.
    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    return once(pairs, lambda s: once(F.array_sort(places(s)), covered))


def with_statistics(docs: DataFrame, carry: list[str], text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """carry and the statistics of every whole text; group keys g_lang and g_source, never null."""
    t = text_of(text)
    spaced = docs.select(
        *(F.col(f"`{c}`") for c in carry),
        F.coalesce(F.concat(F.lit("="), F.col(lang)), F.lit("-")).alias("g_lang"),
        F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("-")).alias("g_source"),
        F.char_length(F.regexp_replace(t, f"[{SPACES}]+", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(f"[^{SPACES}]"))).alias("q_lines"),
        F.transform(F.filter(F.split(t, f"[{SPACES}]+"), lambda w: w != ""), lambda w: F.xxhash64(w)).alias("q_words"),
    )
    pair = lambda a, k: F.zip_with(F.slice(a, 1, F.size(a) - k), F.slice(a, k + 1, F.size(a)), lambda x, y: F.xxhash64(x, y))
    keep = [c for c in spaced.columns if c not in ("q_lines", "q_words")]
    step = spaced.select(
        *(F.col(f"`{c}`") for c in keep),
        F.size("q_words").cast("long").alias("n_words"),
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("q_words") >= 8, F.col("q_words")).otherwise(F.array().cast("array<bigint>")).alias("q1"),
    )
    keep = [c for c in step.columns if c != "q1"]
    for k in (1, 2, 4):  # hashes of 2, then 4, then 8 words
        a = F.col("q1")
        step = step.select(*(F.col(f"`{c}`") for c in keep), F.when(F.size(a) >= k, pair(a, k)).otherwise(a).alias("q1"))
    return step.select(
        *(F.col(f"`{c}`") for c in keep),
        F.when(F.size(F.array_distinct("q1")) < F.size("q1"), repeated_words(F.col("q1"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _cholesky(cov: dict[tuple[int, int], str]) -> list[tuple[str, str]]:
    """(name, SQL) of the lower factor's entries, each in terms of earlier ones."""
    out = []
    for j in range(P):
        for i in range(j, P):
            rest = "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            out.append((f"l{i}{j}", f"sqrt({cov[i, j]}{rest})" if i == j else f"({cov[i, j]}{rest}) / l{j}{j}"))
    return out


def _distance() -> tuple[list[tuple[str, str]], str]:
    """Forward substitution: (name, SQL) of its steps, and the squared distance."""
    steps = [(f"y{i}", f"(x{i} - m{i}" + "".join(f" - l{i}{k} * y{k}" for k in range(i)) + f") / l{i}{i}") for i in range(P)]
    return steps, " + ".join(f"y{i} * y{i}" for i in range(P))


KEYS = ["g_lang", "g_source", "start"]
SUMS = ["n", *(f"s{i}" for i in range(P)), *(f"p{i}{j}" for i, j in PAIRS)]
FIT = [*(f"m{i}" for i in range(P)), *(f"l{i}{j}" for i, j in PAIRS)]
#: The root of the determinant: the product of the factor's diagonal.
ROOT_DET = " * ".join(f"l{i}{i}" for i in range(P))
STARTS = ("quartiles", "tanh", "signs")


def _with(df: DataFrame, named: list[tuple[str, str]]) -> DataFrame:
    """df with a column for each (name, SQL), which may use earlier ones; df has none of these names."""
    return df.select("*", *(F.expr(sql).alias(name) for name, sql in named))


def _regular(i: int, j: int, sql: str) -> str:
    return f"({sql} + {FLOORS[i] ** 2}e0)" if i == j else f"({sql})"


def _moments(consistency: float) -> list[tuple[str, str]]:
    """(name, SQL) of the means, Cholesky factor and root_det from SUMS."""
    cov = {(i, j): _regular(i, j, f"{consistency}e0 * (p{i}{j} / cast(n as double) - m{i} * m{j})") for i, j in PAIRS}
    return [*((f"m{i}", f"s{i} / cast(n as double)") for i in range(P)), *_cholesky(cov), ("root_det", ROOT_DET)]


def _summed(weight: Column | None = None) -> list[Column]:
    """The aggregates SUMS of rows with x0.., each counted ``weight`` times."""
    w = F.lit(1).cast("long") if weight is None else weight
    return [F.sum(w).alias("n"), *(F.sum(w * F.col(f"x{i}")).alias(f"s{i}") for i in range(P)), *(F.sum(w * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i, j in PAIRS)]


#: Width of a first bin of feature values.
VALUES = 32


def _quartiles(features: DataFrame) -> DataFrame:
    """g_lang, g_source, m0.. (medians), r0.. (quartile ranges): from counts of values by bins, then of the values in three bins."""
    entries = F.explode(F.array(*(F.struct(F.lit(i).alias("dim"), F.col(f"x{i}").alias("v")) for i in range(P))))
    long = features.select("g_lang", "g_source", entries.alias("e")).select("g_lang", "g_source", "e.*")
    keys = ["g_lang", "g_source", "dim"]
    bin_, each = F.floor(F.col("v") / VALUES), Window.partitionBy(*keys)
    bins = long.groupBy(*keys, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("k"))
    ranked = bins.withColumn("upto", F.sum("k").over(each.orderBy("bin"))).withColumn("n", F.sum("k").over(each)).withColumn("q", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    wanted, before = F.col("q") * F.col("n"), 4 * (F.col("upto") - F.col("k"))
    inside = ranked.where((4 * F.col("upto") >= wanted) & (before < wanted)).select(*keys, "q", F.col("bin").alias("at"), (wanted - before).alias("left"))
    values = long.join(inside, keys).where(bin_ == F.col("at")).groupBy(*keys, "q", "left", "v").agg(F.count(F.lit(1)).alias("k"))
    upto = values.withColumn("upto", F.sum("k").over(Window.partitionBy(*keys, "q").orderBy("v")))
    found = upto.where(4 * F.col("upto") >= F.col("left")).groupBy(*keys, "q").agg(F.min("v").alias("v"))
    of = lambda i, q: F.max(F.when((F.col("dim") == i) & (F.col("q") == q), F.col("v")))
    return found.groupBy("g_lang", "g_source").agg(*(of(i, 2).cast("double").alias(f"m{i}") for i in range(P)), *((of(i, 3) - of(i, 1)).cast("double").alias(f"r{i}") for i in range(P)))


#: A feature's scale from its quartile range (of a normal one, 1.349 standard deviations), its score, and what two starts take of it.
SCALES = [(f"c{i}", f"sqrt(r{i} * r{i} / 1819801e-6 + {FLOORS[i] ** 2}e0)") for i in range(P)]
SCORES = [*((f"z{i}", f"(x{i} - m{i}) / c{i}") for i in range(P)), ("z", " + ".join(f"z{i} * z{i}" for i in range(P)))]
TANH = [f"cast(floor(1000e0 * tanh(z{i}) + 5e-1) as bigint)" for i in range(P)]
SIGNS = [f"case when z > 0 then cast(floor(1000e0 * z{i} / sqrt(z) + 5e-1) as bigint) else 0 end" for i in range(P)]
#: SQL of the starts' covariances; a sign's square is a quarter on average.
DIAGONAL = {(i, j): f"c{i} * c{i}" if i == j else "0e0" for i, j in PAIRS}
OF_TANH = {(i, j): _regular(i, j, f"c{i} * c{j} * t{i}{j} / (1e6 * n)") for i, j in PAIRS}
OF_SIGNS = {(i, j): _regular(i, j, f"c{i} * c{j} * u{i}{j} / (25e4 * n)") for i, j in PAIRS}


#: Estimates that one task makes.
TOGETHER = 16


def _together(fits: DataFrame, n: int) -> DataFrame:
    """fits, of which there are about n, in as many tasks as they are worth. More than there are shuffle partitions change nothing."""
    return fits.coalesce(max(1, math.ceil(n / TOGETHER)))


def _held(names: list[str]) -> list[Column]:
    """Aggregates of columns that are the same in all rows of a group: kept so, they need no join afterwards."""
    return [F.first(c).alias(c) for c in names]


def _started(features: DataFrame, groups: DataFrame, n: int, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The three starts of each of n groups: KEYS, h and FIT. One pass over the features after their quartiles."""
    middle = written(_together(_with(_quartiles(features), SCALES), n), "quartiles")
    scored = _with(features.join(near(middle), ["g_lang", "g_source"]), [*SCORES, *((f"t{i}", x) for i, x in enumerate(TANH)), *((f"u{i}", x) for i, x in enumerate(SIGNS))])
    products = [F.sum(F.col(f"{x}{i}") * F.col(f"{x}{j}")).alias(f"{x}{i}{j}") for x in "tu" for i, j in PAIRS]
    sums = scored.groupBy("g_lang", "g_source").agg(F.count(F.lit(1)).alias("n"), *products, *_held([f"{x}{i}" for x in "mc" for i in range(P)]))
    central = written(_together(sums.join(near(groups), ["g_lang", "g_source"]), n), "sums")
    fits = [_with(central, _cholesky(DIAGONAL)), _with(central, _cholesky(OF_TANH)), _with(central, _cholesky(OF_SIGNS))]
    named = [fit.select("g_lang", "g_source", F.lit(name).alias("start"), "h", *FIT) for name, fit in zip(STARTS, fits, strict=True)]
    return reduce(DataFrame.unionByName, named)


def _measured(features: DataFrame, fit: DataFrame) -> DataFrame:
    steps, square = _distance()
    return _with(features.join(fit, ["g_lang", "g_source"]), [*steps, ("distance", square)])


#: Rows of a group that one task puts in order.
ORDERED = 5_000
#: A bin of distance is an eighth of an octave; each further cut makes PARTS of one.
PARTS = 256
PLACE = "8e0 * ln(1e0 + distance) / 6931471805599453e-16"


def _binned(features: DataFrame, asked: DataFrame, level: int) -> DataFrame:
    """The rows of ``asked`` (KEYS, FIT, at0, at1, ... of ``level`` cuts) in the parts that are cut: with ``bin``, the next part."""
    rows = _measured(features, asked).withColumn("rest", F.expr(PLACE))
    for k in range(level):
        rows = rows.where(F.floor("rest") == F.col(f"at{k}")).withColumn("rest", (F.col("rest") - F.floor("rest")) * F.lit(float(PARTS)))
    return rows.withColumn("bin", F.floor("rest"))


def _concentrated(features: DataFrame, fit: DataFrame, cuts: int, n: int, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One concentration step for each of ``fit`` (about n; KEYS, h, FIT, root_det): KEYS, h, the next FIT and its root_det, and q_before, that of before.

    Counts by bins tell in which the h-th row is, counts of its parts in which of them (``cuts`` times), and of the rows of the
    last the order (by distance, then features) tells it; one more pass sums what is before it. All counts and sums are map-side,
    and an estimate goes along with its counts.
    """
    x, each, held = [f"x{i}" for i in range(P)], Window.partitionBy(*KEYS), ["h", "q_before", *FIT]
    reached = (F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("n") < F.col("left"))
    left = F.col("left") - (F.col("upto") - F.col("n"))
    asked = fit.select(*KEYS, F.col("root_det").alias("q_before"), "h", *FIT, F.col("h").alias("left"))
    for level in range(cuts + 1):
        ats = [f"at{k}" for k in range(level)]
        bins = _binned(features, near(asked), level).groupBy(*KEYS, "left", "bin").agg(F.count(F.lit(1)).alias("n"), *_held([*held, *ats])).withColumn("upto", F.sum("n").over(each.orderBy("bin")))
        asked = written(_together(bins.where(reached).select(*KEYS, *held, *ats, F.col("bin").alias(f"at{level}"), left.alias("left")), n), "cut")
    alike = _binned(features, near(asked), cuts + 1).groupBy(*KEYS, "left", "distance", *x).agg(F.count(F.lit(1)).alias("n"), *_held(held)).withColumn("upto", F.sum("n").over(each.orderBy("distance", *x)))
    edge = written(_together(alike.where(reached).select(*KEYS, *held, F.col("distance").alias("q_distance"), *(F.col(c).alias(f"q_{c}") for c in x), left.alias("q_take")), n), "edge")
    closer = F.struct("distance", *x) < F.struct(F.col("q_distance").alias("distance"), *(F.col(f"q_{c}").alias(c) for c in x))
    inside = _measured(features, near(edge)).groupBy(*KEYS).agg(*_summed(closer.cast("long")), *_held(["q_before", "q_take", *(f"q_{c}" for c in x)]))
    # The rows at the edge are alike: so many of them as make h.
    at_edge = {"n": "1", **{f"s{i}": f"q_x{i}" for i in range(P)}, **{f"p{i}{j}": f"q_x{i} * q_x{j}" for i, j in PAIRS}}
    sums = inside.select(*KEYS, "q_before", *(F.expr(f"{c} + q_take * {at_edge[c]}").alias(c) for c in SUMS)).withColumn("h", F.col("n"))
    return _with(sums, _moments(CONSISTENCY)).select(*KEYS, "h", *FIT, "root_det", "q_before")


def fitted(features: DataFrame, groups: DataFrame, cuts: int = 1) -> DataFrame:
    """(g_lang, g_source, x0..) -> the minimum-covariance-determinant fit of each group: g_lang, g_source, FIT, root_det.

    groups: (g_lang, g_source, h), h the rows that a fit is of. Starts whose determinant no longer falls leave; the rest go on.
    """
    n = groups.count() * len(STARTS)
    near = F.broadcast if n <= BROADCAST_GROUPS else lambda df: df
    found, falls = [], written(_started(features, groups, n, near).withColumn("root_det", F.lit(float("inf"))), "starts")
    while not falls.isEmpty():
        # All that were met: of one start, each is less than those before it, so that the least of all is the least of the last.
        found.append(falls)
        step = written(_together(_concentrated(features, falls, cuts, n, near), n), "step")
        falls = step.where(F.col("root_det") < F.col("q_before")).drop("q_before")
    best = F.min(F.struct("root_det", "start", *FIT)).alias("b")
    return _together(reduce(DataFrame.unionByName, found or [falls]).groupBy("g_lang", "g_source").agg(best).select("g_lang", "g_source", "b.*").drop("start"), n)


def reweighted(features: DataFrame, fit: DataFrame) -> DataFrame:
    """The fit of all rows within the 0.975 quantile of distance from ``fit``."""
    inside = _measured(features, near(fit.drop("root_det"))).where(F.col("distance") <= REWEIGHT)
    return _with(inside.groupBy("g_lang", "g_source").agg(*_summed()), _moments(REWEIGHT_CONSISTENCY)).select("g_lang", "g_source", *FIT)


def pooled(features: DataFrame, min_group: int = MIN_GROUP) -> tuple[DataFrame, DataFrame]:
    """features with the keys of their pool, and the pools: (g_lang, g_source, h, n).

    Small groups share their language's key '*'; what is small then is one pool ('*', '*') of all languages, of any size.
    """
    sizes = features.groupBy("g_lang", "g_source").agg(F.count(F.lit(1)).alias("q_n"))
    own = F.col("q_n") >= min_group
    pools = sizes.where(~own).groupBy("g_lang").agg(F.sum("q_n").alias("q_pool"))
    lang = F.when(own | (F.col("q_pool") >= min_group), F.col("g_lang")).otherwise("*")
    keys = written(sizes.join(pools, "g_lang", "left").select("g_lang", "g_source", "q_n", lang.alias("q_lang"), F.when(own, F.col("g_source")).otherwise("*").alias("q_source")), "groups")
    rows = features.join(near(keys.drop("q_n")), ["g_lang", "g_source"]).drop("g_lang", "g_source").withColumnsRenamed({"q_lang": "g_lang", "q_source": "g_source"})
    n = F.sum("q_n")
    h = F.greatest(F.floor(n * F.lit(SUPPORT)), F.least(n, F.lit(LEAST))).cast("long")
    return rows, keys.groupBy(F.col("q_lang").alias("g_lang"), F.col("q_source").alias("g_source")).agg(h.alias("h"), n.alias("n"))


#: Groups up to which their keys and estimates (some 300 bytes each, one a start) are broadcast; beyond, rows are shuffled to them.
BROADCAST_GROUPS = 10_000


def near(groups: DataFrame) -> DataFrame:
    return F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups


def quality_rules(docs: DataFrame, carry: list[str], text: str = "text", lang: str = "lang", source: str = "source", cutoff: float = CUTOFF, min_group: int = MIN_GROUP) -> DataFrame:
    """carry's columns of every row, with the statistics, base_failed, distance (squared Mahalanobis) and kept.

    Each row is judged by itself, so repeated rows and ids get equal verdicts. Null texts count as empty (and fail the base
    rules), null languages and sources form groups of their own, an empty table gives an empty result. A carried column
    whose name is one of the outputs is replaced by the output. Documents that fail the base rules still count for their
    group's estimates: the estimates withstand up to a quarter of outliers. Rows of equal features are ordered alike, so ties at
    the h-th place change no sum. A pool of ten or fewer is fitted whole and rejects nothing.
    """
    carry = [c for c in carry if c.lower() not in OUTPUT]
    held = [(c, f"q_carry_{k}") for k, c in enumerate(carry)]
    named = docs.select(*(F.col(f"`{c}`").alias(to) for c, to in held), F.col(f"`{text}`").alias("q_text"), F.col(f"`{lang}`").alias("q_lang"), F.col(f"`{source}`").alias("q_source"))
    stats = with_statistics(named, [to for _, to in held], "q_text", "q_lang", "q_source")
    table, pools = pooled(written(_with(stats, [(f"x{i}", sql) for i, sql in enumerate(FEATURES)]), "quality"), min_group)
    features, pools = written(table.select("g_lang", "g_source", *(f"x{i}" for i in range(P))), "features"), written(pools, "pools")
    largest, n = pools.agg(F.coalesce(F.max("n"), F.lit(1)), F.count(F.lit(1))).first()
    cuts = max(1, math.ceil(math.log(largest / (10 * ORDERED), PARTS)))
    fit = written(_together(reweighted(features, written(fitted(features, pools.select("g_lang", "g_source", "h"), cuts), "least")), n), "fit")
    judged = _measured(table, near(fit)).withColumn("base_failed", F.expr(BASE_FAILED))
    kept = ~F.col("base_failed") & (F.col("distance") <= cutoff)
    return judged.select(*(F.col(to).alias(c) for c, to in held), *STATS, "base_failed", "distance", kept.alias("kept"))


def op10_quality_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs, ["doc_id"]).select("doc_id", *STATS, "base_failed", "kept")


def oracle_sql() -> str:
    """The same in DuckDB's SQL, for op10_quality_rules: each step takes the h nearest rows by their number in order."""
    xs, fit = ", ".join(f"x{i}" for i in range(P)), ", ".join(FIT)
    nested = lambda inner, named: reduce(lambda q, x: f"select *, {x[1]} as {x[0]} from ({q})", named, inner)
    steps, square = _distance()
    raw = ", ".join(["cast(count(*) as bigint) as n", *(f"sum(x{i}) as s{i}" for i in range(P)), *(f"sum(x{i} * x{j}) as p{i}{j}" for i, j in PAIRS)])
    measured = lambda table, fits, more="": nested(f"select t.*, {fit}{more} from {table} t join {fits} f on t.g_lang = f.g_lang and t.g_source = f.g_source", [*steps, ("distance", square)])
    products = ", ".join(f"sum({x}{i} * {x}{j}) as {x}{i}{j}" for x in "tu" for i, j in PAIRS)
    made = zip(STARTS, (DIAGONAL, OF_TANH, OF_SIGNS), strict=True)
    starts = " union all ".join(f"select g_lang, g_source, '{name}' as start, {fit} from ({nested('select * from mids', _cholesky(cov))})" for name, cov in made)
    nearest = f"select *, row_number() over (partition by g_lang, g_source, start order by distance, {xs}) as r from ({measured('feat', '(select * from fits where falls)', ', start, h, root_det as q_before')})"
    refitted = nested(f"select g_lang, g_source, start, any_value(h) as h, any_value(q_before) as q_before, {raw} from ({nearest}) where r <= h group by g_lang, g_source, start", _moments(CONSISTENCY))
    return f"""with recursive words as (select doc_id, coalesce("text", '') as t, coalesce('=' || lang, '-') as g_lang, coalesce('=' || source, '-') as g_source,
    regexp_extract_all(coalesce("text", ''), '[^\\x20\\x09-\\x0D]+') as w,
    list_filter(string_split(coalesce("text", ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from documents),
windows as (select *, row_number() over () as rid, [array_to_string(w[i:i + 7], ' ') for i in range(1, len(w) - 6)] as win from words),
places as (select rid, x, i from (select rid, unnest(win) as x, unnest(range(len(win))) as i from windows) where true),
twice as (select rid, i, lead(i) over (partition by rid order by i) as nxt from (select *, count(*) over (partition by rid, x) as c from places) where c > 1),
covered as (select rid, sum(least(8, coalesce(nxt - i, 8))) as n from twice group by rid),
stats as (select doc_id, g_lang, g_source, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
    cast(coalesce(n, 0) as bigint) as n_repeat_words from windows left join covered using (rid)),
sized as (select *, count(*) over (partition by g_lang, g_source) as c from stats),
sharing as (select *, count(*) filter (where c < {MIN_GROUP}) over (partition by g_lang) as pool from sized),
tab as materialized (select * exclude (g_lang, g_source, c, pool), case when c >= {MIN_GROUP} or pool >= {MIN_GROUP} then g_lang else '*' end as g_lang, case when c >= {MIN_GROUP} then g_source else '*' end as g_source,
    {', '.join(f'{sql} as x{i}' for i, sql in enumerate(FEATURES))} from sharing),
feat as materialized (select g_lang, g_source, {xs} from tab),
hs as (select g_lang, g_source, greatest(3 * count(*) // 4, least(count(*), {LEAST})) as h from feat group by all),
vals as ({' union all '.join(f'select g_lang, g_source, {i} as dim, x{i} as v from feat' for i in range(P))}),
ranked as (select *, row_number() over (partition by g_lang, g_source, dim order by v) as r, count(*) over (partition by g_lang, g_source, dim) as c from vals),
quarters as (select g_lang, g_source, dim, min(v) filter (where 4 * r >= c) as q1, min(v) filter (where 4 * r >= 2 * c) as q2, min(v) filter (where 4 * r >= 3 * c) as q3 from ranked group by all),
wide as (select g_lang, g_source, {', '.join(f'cast(max(q2) filter (where dim = {i}) as double) as m{i}, cast(max(q3 - q1) filter (where dim = {i}) as double) as r{i}' for i in range(P))} from quarters group by all),
middle as ({nested('select * from wide', SCALES)}),
scored as (select *, {', '.join(f'{x} as t{i}' for i, x in enumerate(TANH))}, {', '.join(f'{x} as u{i}' for i, x in enumerate(SIGNS))} from ({nested('select * from feat join middle using (g_lang, g_source)', SCORES)})),
mids as (select m.*, n, {', '.join(f'{x}{i}{j}' for x in 'tu' for i, j in PAIRS)} from middle m join (select g_lang, g_source, count(*) as n, {products} from scored group by all) using (g_lang, g_source)),
fits as (select g_lang, g_source, start, h, {fit}, cast('inf' as double) as root_det, true as falls from ({starts}) join hs using (g_lang, g_source)
  union all select g_lang, g_source, start, h, {fit}, root_det, root_det < q_before as falls from ({refitted})),
least_ as (select * from fits qualify row_number() over (partition by g_lang, g_source order by root_det, start) = 1),
fit as ({nested(f"select g_lang, g_source, {raw} from ({measured('feat', 'least_')}) where distance <= {REWEIGHT} group by g_lang, g_source", _moments(REWEIGHT_CONSISTENCY))})
select doc_id, {', '.join(STATS)}, {BASE_FAILED} as base_failed, not {BASE_FAILED} and distance <= {CUTOFF} as kept from ({measured('tab', 'fit')})"""
