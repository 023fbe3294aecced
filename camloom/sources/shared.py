"""Tables and checkpoints in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SHUFFLES_REMOVED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's place below spark.checkpoint.dir; where that is unset, in a local session only, below a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="camloom-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/camloom/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that run in here delete their shuffle files as they end, instead of when the driver next collects garbage."""
    before = spark.conf.get(SHUFFLES_REMOVED)
    spark.conf.set(SHUFFLES_REMOVED, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES_REMOVED, before)


def scratch(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, for what is read more than once. ``dropped`` deletes it; else it goes when the session's process ends."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    with shuffles_removed(spark):
        df.write.parquet(path)
    atexit.register(deleted, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.camloom_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that ``scratch`` made, once nothing reads them."""
    for table in tables:
        deleted(table.sparkSession, table.camloom_path)


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a folder; nothing where the session has ended before."""
    context = spark.sparkContext
    if context._jsc is not None and not context._jsc.sc().isStopped():
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def stream_table(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table's files as a stream, so many at once if that is given. A pattern that matches just the table: a stream takes a single file
    only by a pattern."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    limits = {} if files_per_trigger is None else {"maxFilesPerTrigger": files_per_trigger}
    return spark.readStream.schema(schema).options(**limits).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


def drained(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Runs a stream over all that is there; what it put out, as a table. A batch that is run again replaces its own output;
    in complete mode each batch replaces all."""
    spark = stream.sparkSession
    root = shared_folder(spark, "stream")
    schema = []

    def write(df: DataFrame, batch: int) -> None:
        out = each(df) if each else df
        schema.append(out.schema)
        out.write.mode("overwrite").parquet(f"{root}/out" if mode == "complete" else f"{root}/out/batch={batch}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if not schema:
        return spark.createDataFrame([], stream.schema)
    atexit.register(deleted, spark, root)
    out = spark.read.schema(schema[0]).parquet(f"{root}/out")
    return out.select(*schema[0].names)
