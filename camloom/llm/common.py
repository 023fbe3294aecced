"""Shared helpers: words, digests, and tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white space characters that separate words.
SPACES = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACES}]+"
SHUFFLES_REMOVED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def text_of(name: str = "text") -> Column:
    """The text column, a null one as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    """Words of a text. The empty pieces that a split leaves at either end are not words."""
    return (F.size(F.split(F.concat(F.lit(" "), text, F.lit(" ")), f"[{SPACES}]+")) - 2).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset (a local session), a folder of this session's own."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="camloom-"))
    return context.getCheckpointDir().rstrip("/")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that run in here delete their shuffle files as they end, instead of when the driver next collects garbage."""
    before = spark.conf.get(SHUFFLES_REMOVED)
    spark.conf.set(SHUFFLES_REMOVED, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES_REMOVED, before)


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and outlives the loss of executors.

    Its shuffle files go as soon as it is written. ``path_of`` gives its place and ``dropped`` deletes it, once nothing reads
    it any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/camloom/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.options(**(options or {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.camloom_path = path
    return out


def path_of(table: DataFrame) -> str:
    return table.camloom_path


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made."""
    for table in tables:
        delete(table.sparkSession, path_of(table))


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
