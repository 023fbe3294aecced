"""Sharding by size-tiered compaction under a versioned manifest.

Arrivals are appended as small immutable Parquet shards. Shards whose sizes are within a factor of ``FANOUT`` of each other
form a tier; a tier with at least FANOUT shards is merged into files of about the target size, by reading those files and
writing them anew without a shuffle. The manifest lists the live shards; a new version is written beside the old one and
takes effect by one rename that fails if that version exists, so a reader sees all of a commit or nothing of it, and of two
writers one tries again on what the other left. Replaced shards are deleted by ``vacuum`` alone, so readers of older versions go on.

Native: the data goes through DataFrame reads and writes only; the driver handles file names, sizes and the manifest.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from camloom.llm.common import delete, shared_dir, text_of

FANOUT, TARGET_BYTES, ARRIVALS = 4, 64 << 20, 8
#: Bytes of arrivals that one task writes, so that a table in many small parts doesn't become as many tiny shards.
TASK_BYTES = 16 << 20
#: Commits that a writer tries, each on what the others left.
ATTEMPTS = 20


class Conflict(RuntimeError):
    """Another writer has committed this version."""


def _nullable(schema: StructType) -> StructType:
    return StructType([StructField(f.name, f.dataType, True) for f in schema])


class ShardStore:
    """Shards and manifests below one folder that all machines share. All rows of a store have one schema."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT) -> None:
        self.spark, self.root, self.target, self.fanout = spark, root.rstrip("/"), target_bytes, fanout
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path(f"{self.root}/manifest"))

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def version(self) -> int:
        """The version in effect; 0 before the first commit."""
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(f"{self.root}/manifest"))]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def _place(self, version: int):
        return self._path(f"{self.root}/manifest/v{version:010d}.json")

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        stream = self.fs.open(self._place(version))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, old: dict, schema: str, shards: list[dict]) -> dict:
        """The next version, or Conflict if another writer was first."""
        new = {"version": old["version"] + 1, "schema": schema, "shards": sorted(shards, key=lambda s: s["path"])}
        draft, final = self._path(f"{self.root}/manifest/draft-{uuid.uuid4().hex}"), self._place(new["version"])
        out = self.fs.create(draft, False)
        out.write(json.dumps(new).encode())
        out.close()
        if self.fs.exists(final) or not self.fs.rename(draft, final):
            self.fs.delete(draft, False)
            raise Conflict(f"version {new['version']} exists")
        return new

    def _files(self, folder: str, **facts) -> list[dict]:
        if not self.fs.exists(self._path(folder)):
            return []
        found, it = [], self.fs.listFiles(self._path(folder), True)
        while it.hasNext():
            f = it.next()
            if f.getPath().getName().startswith("part-"):
                found.append({"path": f.getPath().toString(), "bytes": f.getLen(), **facts})
        return found

    def _committed(self, change: Callable[[dict], dict | None]) -> dict | None:
        """Commits what ``change`` makes of the version in effect; where another writer is first, of the next one. None where change gives None."""
        for _ in range(ATTEMPTS):
            now = self.manifest()
            new = change(now)
            if new is None:
                return None
            try:
                return self.commit(now, new["schema"], new["shards"])
            except Conflict:
                continue
        raise Conflict(f"others were first {ATTEMPTS} times")

    def _added(self, folder: str, schema: str) -> dict:
        """Commits a written folder as arrivals; where that fails for good, the folder goes."""
        files = self._files(folder, level=0)

        def change(now: dict) -> dict:
            self._same_columns(now, schema)
            return {"schema": now["schema"] or schema, "shards": now["shards"] + files}

        try:
            return self._committed(change)
        except (Conflict, ValueError):
            delete(self.spark, folder)
            raise

    def _same_columns(self, now: dict, schema: str) -> None:
        """ValueError unless the names and types are those of the store. Whether nulls may occur is not compared."""
        columns = lambda text: [(f.name, f.dataType.simpleString()) for f in StructType.fromJson(json.loads(text))]
        if now["schema"] and columns(now["schema"]) != columns(schema):
            raise ValueError(f"the store has {columns(now['schema'])}, not {columns(schema)}")

    def append(self, arrivals: DataFrame) -> dict:
        """Commits a new arrival, whose columns must be those of the store. An empty one commits nothing but the schema.

        Rows are stored as they are: nulls, repeated rows and ties stay. If others keep being first, or the columns differ,
        what was written is deleted and the error raised.
        """
        schema = _nullable(arrivals.schema).json()
        self._same_columns(self.manifest(), schema)
        folder = f"{self.root}/shards/{uuid.uuid4().hex}"
        arrivals.write.parquet(folder)
        return self._added(folder, schema)

    def append_batches(self, arrivals: DataFrame, batch: Column, task_bytes: int = TASK_BYTES) -> dict:
        """Rows of many arrivals, read and written once; each batch number in order is a commit of its own, a null one the last.

        Parts of the arrivals are read together, some ``task_bytes`` (as Spark estimates them) in a task, without a shuffle; a task
        writes a shard for each batch it meets. Nulls, repeated rows and ties stay; an empty table commits nothing but the schema.
        """
        schema = _nullable(arrivals.schema).json()
        self._same_columns(self.manifest(), schema)
        folder = f"{self.root}/shards/{uuid.uuid4().hex}"
        size = int(str(arrivals._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        packed = arrivals.coalesce(max(1, min(math.ceil(size / task_bytes), 1 << 20)))
        packed.withColumn("q_batch", batch.cast("int")).write.partitionBy("q_batch").parquet(folder)
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(folder)) if s.isDirectory()]
        number = lambda name: int(name.partition("=")[2]) if re.fullmatch("q_batch=-?[0-9]+", name) else math.inf
        for name in sorted(names, key=number):
            self._added(f"{folder}/{name}", schema)
        return self._added(f"{folder}/none", schema) if self.version() == 0 else self.manifest()

    def tiers(self, shards: list[dict]) -> dict[int, list[dict]]:
        """Shards below the target size by the logarithm of their size."""
        out: dict[int, list[dict]] = {}
        for s in shards:
            if s["bytes"] < self.target:
                out.setdefault(int(math.log(max(s["bytes"], 1), self.fanout)), []).append(s)
        return out

    def compact(self, keep_old: bool = True) -> dict:
        """Merges tiers, least sizes first, until none has FANOUT shards. Each merge is a commit of its own.

        Spark packs a tier's shards, each below the target, into tasks of up to twice the target, and each task writes a file: all
        but the last are above the target. Shards that a merge replaced stay until ``vacuum``, for readers of older versions; a writer
        that owns the store may let them go after each commit (``keep_old=False``). Where another writer has meanwhile replaced a
        shard, what the merge wrote is deleted and the tiers are looked at anew. No rows, one file or an empty store change nothing.
        """
        while True:
            now = self.manifest()
            full = [s for _, s in sorted(self.tiers(now["shards"]).items()) if len(s) >= self.fanout]
            if not full:
                return now
            merged = full[0]
            folder = f"{self.root}/shards/{uuid.uuid4().hex}"
            # Fewer files than there were, whatever sizes the session reads in.
            most = max(1, sum(s["bytes"] for s in merged) // self.target)
            with self._tasks_of(2 * self.target):
                self.read(merged, now["schema"]).coalesce(most).write.parquet(folder)
            made, gone = self._files(folder, level=max(s["level"] for s in merged) + 1), {s["path"] for s in merged}

            def change(now: dict, made: list[dict] = made, gone: set[str] = gone) -> dict | None:
                if not gone <= {s["path"] for s in now["shards"]}:
                    return None
                return {"schema": now["schema"], "shards": [s for s in now["shards"] if s["path"] not in gone] + made}

            try:
                done = self._committed(change)
            except Conflict:
                delete(self.spark, folder)
                raise
            if done is None:
                delete(self.spark, folder)
            elif not keep_old:
                self.vacuum()

    @contextmanager
    def _tasks_of(self, size: int) -> Iterator[None]:
        """Reads are cut into tasks of up to so many bytes of whole files."""
        wanted = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
        before = {k: self.spark.conf.get(k, None) for k in wanted}
        try:
            for k, v in wanted.items():
                self.spark.conf.set(k, v)
            yield
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def vacuum(self, versions: int = 1) -> int:
        """Deletes manifests but the last ``versions`` and the shards that only they list; how many shards. Files that no manifest
        lists stay: a writer may be about to commit them. An empty store has nothing to delete."""
        last = self.version()
        numbers = [v for v in range(last, 0, -1) if self.fs.exists(self._place(v))]
        live = {s["path"] for v in numbers[:versions] for s in self.manifest(v)["shards"]}
        gone = {s["path"] for v in numbers[versions:] for s in self.manifest(v)["shards"]} - live
        for path in gone:
            self.fs.delete(self._path(path), False)
        for v in numbers[versions:]:
            self.fs.delete(self._place(v), False)
        return len(gone)

    def read(self, shards: list[dict] | None = None, schema: str | None = None) -> DataFrame:
        """The rows of the live shards, or of those given; none where there are no shards, in no order."""
        if shards is None:
            now = self.manifest()
            shards, schema = now["shards"], now["schema"]
        kind = StructType.fromJson(json.loads(schema)) if schema else StructType()
        if not shards:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*(s["path"] for s in shards))

    def shards(self) -> DataFrame:
        """The live shards: path, bytes, level."""
        return self.spark.createDataFrame([(s["path"], s["bytes"], s["level"]) for s in self.manifest()["shards"]], "path string, bytes long, level int")

    def drop(self) -> None:
        delete(self.spark, self.root)


def op8_sharding(spark, sf_dir):
    """Documents arrive in ARRIVALS batches (by their id's remainder), each a commit; then the store is compacted and read.

    Null ids arrive with the batch of 0, null texts count as empty, repeated rows stay. An empty table gives an empty result.
    Per document: arrival, n_bytes and text_md5 as read from the compacted shards, and listed: its file is in the manifest.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    store = ShardStore(spark, f"{shared_dir(spark)}/camloom/shards-{uuid.uuid4().hex}")
    # The remainder has the sign of the id; batches go by the remainder that is never negative.
    arrival = F.coalesce(F.col("doc_id"), F.lit(0)) % ARRIVALS
    store.append_batches(docs.withColumn("arrival", arrival), F.pmod(arrival, F.lit(ARRIVALS)))
    store.compact(keep_old=False)
    store.vacuum()
    # file:/a and file:///a are one place
    place = lambda c: F.regexp_replace(c, "^([a-z]+):/+", "$1:/")
    live = store.shards().select(place(F.col("path")).alias("q_path"), F.lit(True).alias("found"))
    rows = store.read().select("doc_id", "arrival", F.octet_length(text_of()).cast("long").alias("n_bytes"), F.md5(text_of()).alias("text_md5"), place(F.col("_metadata.file_path")).alias("q_path"))
    return rows.join(live, "q_path", "left").select("doc_id", "arrival", "n_bytes", "text_md5", F.coalesce("found", F.lit(False)).alias("listed"))


def oracle_sql() -> str:
    return f"""select doc_id, coalesce(doc_id, 0) % {ARRIVALS} as arrival, cast(strlen(coalesce("text", '')) as bigint) as n_bytes,
    md5(coalesce("text", '')) as text_md5, true as listed from documents"""
