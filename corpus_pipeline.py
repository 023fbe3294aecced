"""The corpus pipeline: quality rules, near-duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return the columns
of documents. ``run`` writes each stage's result to the shared folder and reads it back for the next.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from camloom.llm import mixing, packing, quality, simhash, suffixes
from camloom.llm.common import text_of, written


def held(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs under names that no operator's output has, and which name stands for which column."""
    names = {c: f"held_{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(to) for c, to in names.items())), names


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are outliers go; all others stay as they are."""
    rows, names = held(docs)
    judged = quality.quality_rules(rows, rows.columns, names["text"], names["lang"], names["source"])
    return judged.where("kept").select(*(F.col(to).alias(c) for c, to in names.items()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents similar by 0.8 or more on five-word shingles, the one with the least id stays; once, if its row repeats."""
    firsts = simhash.near_duplicate_groups(docs).where("doc_id = group_id").select("doc_id").distinct()
    rows = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("q_rows"))
    # Written first: then Spark knows its size, and where that is small the documents stay where they are.
    kept = written(firsts.join(rows, "doc_id"), "kept")
    stays = docs.join(kept, "doc_id")
    repeated = stays.where("q_rows > 1").withColumn("q_hash", F.xxhash64(text_of())).dropDuplicates(["doc_id", "q_hash"])
    parts = stays.where("q_rows = 1"), repeated, docs.where("doc_id is null")
    return reduce(DataFrame.unionByName, (part.select(*docs.columns) for part in parts))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that occur twice are cut out of the texts; n_chars, a column that docs must have, follows. Null texts stay null."""
    rows, names = held(docs)
    cut = suffixes.without_repeats(rows, rows.columns, names["text"], texts=True)
    lost = F.col("n_removed") > 0
    new = {"text": F.when(lost, F.col("kept_text")).otherwise(F.col(names["text"])), "n_chars": F.when(lost, F.char_length("kept_text").cast("long")).otherwise(F.col(names["n_chars"]))}
    return cut.select(*(new.get(c, F.col(to)).alias(c) for c, to in names.items()))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Rows alike in id, source and size are taken alike: as the least of them."""
    rows, names = held(docs)
    keys = {"doc_id": F.col(names["doc_id"]), "source": F.col(names["source"]), "size": mixing.word_count(text_of(names["text"]))}
    copies = mixing.mixed(docs).groupBy(*keys).agg(F.min("copies").alias("copies")).where("copies > 0")
    sized = rows.withColumns({f"q_{k}": v for k, v in keys.items()})
    same = [sized[f"q_{k}"].eqNullSafe(copies[k]) for k in keys]
    return sized.join(copies, same).withColumn("q_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*(F.col(to).alias(c) for c, to in names.items()))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence. Null and empty texts are a document of the end mark alone, repeated rows documents of
    their own; an empty table gives an empty result."""
    return packing.packed_sequences(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixed_sources", mixed_sources),
    ("packed", packed),
]
#: SQL can't express tokenization or the choice of sequences; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. Rows with nulls in any column go through all of them; an empty table gives an empty result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
