"""Event logs, clips and configuration as tables: readers that prune, and writers whose layout lets them.

A log is partitioned by camera and date (UTC). ``root`` and paths are read by Spark, so they may be in any store it reads.
"""

from __future__ import annotations

import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, ShortType, StringType, StructField, StructType, TimestampType
from pyspark.sql.window import Window

KINDS = {"string": StringType(), "int": IntegerType(), "long": LongType(), "smallint": ShortType(), "double": DoubleType(), "boolean": BooleanType(), "timestamp": TimestampType()}


def fields(text: str) -> StructType:
    """A schema from 'name kind, ...' without a session."""
    return StructType([StructField(name, KINDS[kind]) for name, kind in (part.split() for part in text.split(","))])


RAW_EVENT = fields("""event_id string, site string, camera string, cam_id int, ts timestamp, ts_mono_ns long, type string, z_score double, intra_ratio double, bytes long,
bpf_slow double, bpf_ewma double, bpf_var double, since_kf long, fsm_before smallint, fsm_after smallint, reason string, pts_start long, pts_end long, codec string, fps double,
clip_id string, clip_path string, clip_url string, thumbs_url string, z_timeline_url string, trigger_offset_ms long, target_class_mask smallint, agent_version string""")
META = fields("event_id string, camera string, z_score double, intra_ratio double, bytes long, pre_roll_seconds long, post_roll_seconds long, trigger_offset_ms long, codec string, fps double")
LABEL = fields("label string, labeled_at timestamp, camera string, clip string")
FRAME = StructType([StructField("frames", ArrayType(fields("key_frame int, pkt_size string, pict_type string")))])
DEFAULT_LIMIT = 10_000
SKIP, FAIL = "skip", "fail"
TEXT = [f.name for f in RAW_EVENT.fields if f.dataType.simpleString() == "string"]


def read_json(spark: SparkSession, path: str | list[str], schema: StructType, malformed: str = SKIP, multiline: bool = False) -> DataFrame:
    """JSON rows of a fixed schema; unknown fields are ignored. Malformed rows are skipped, or fail the job."""
    if malformed == FAIL:
        return spark.read.option("multiLine", multiline).option("timeZone", "UTC").option("mode", "FAILFAST").schema(schema).json(path)
    # Lines parsed by from_json: the JSON reader would skip parsing, and so the check, for queries that need no column.
    lines = spark.read.text(path, wholetext=multiline).where(F.trim("value") != "")
    outer = [c for c in lines.columns if c != "value"]  # partition columns
    kept = StructType([f for f in schema.fields if f.name not in outer] + [StructField("_corrupt_record", StringType())])
    parsed = lines.select(*outer, F.from_json("value", kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", "timeZone": "UTC"}).alias("r"))
    return parsed.where(F.col("r._corrupt_record").isNull() & F.col("r").isNotNull()).select(*(F.col(f.name).cast(f.dataType) if f.name in outer else F.col(f"r.{f.name}") for f in schema.fields))


def append_log(events: DataFrame, root: str, fmt: str = "json") -> None:
    """Appends events to the log: a folder for each camera and UTC day. Rows are brought together by these before the write, with
    a salt by hash, so that a busy camera's day is several files and not one task."""
    day = events.withColumn("date", F.to_date(F.col("ts").cast("timestamp")))
    placed = day.repartition("camera", "date", F.pmod(F.xxhash64("event_id"), F.lit(8)))
    placed.write.mode("append").partitionBy("camera", "date").format(fmt).save(root)


def log_range(spark: SparkSession, root: str, start: str | None = None, end: str | None = None, camera: str | None = None, limit: int = 0, fmt: str = "json", malformed: str = SKIP) -> DataFrame:
    """Rows with start <= ts <= end (UTC, text), first by time, at most limit (0: 10,000; below 0: all). A missing root is empty.

    The dates of the bounds prune folders, which bounds on ts alone would not.
    """
    from pyspark.errors import AnalysisException

    inner = StructType([f for f in RAW_EVENT.fields if f.name != "camera"])
    try:
        if fmt == "json":
            base = read_json(spark, root, StructType(inner.fields).add("camera", "string").add("date", "date"), malformed)
        else:
            base = spark.read.format(fmt).load(root)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], RAW_EVENT)
    rows = base
    if camera is not None:
        rows = rows.where(F.col("camera") == camera)
    ts = F.col("ts").cast("timestamp")
    if start is not None:
        rows = rows.where((F.col("date") >= F.to_date(F.lit(start))) & (ts >= F.lit(start).cast("timestamp")))
    if end is not None:
        rows = rows.where((F.col("date") <= F.to_date(F.lit(end))) & (ts <= F.lit(end).cast("timestamp")))
    return first_rows(rows.drop("date"), limit or DEFAULT_LIMIT)


def first_rows(events: DataFrame, limit: int) -> DataFrame:
    return events if limit < 0 else events.orderBy("ts", "event_id").limit(limit)


def with_defaults(events: DataFrame) -> DataFrame:
    """Left-out fields as the zero values that writers mean: empty text, 0."""
    return events.fillna("", [c for c in events.columns if c in TEXT]).fillna(0, [f.name for f in events.schema.fields if f.dataType.simpleString() in ("int", "bigint", "smallint", "double")])


def expired_partitions(log: DataFrame, now: Column, keep_days: int) -> DataFrame:
    """Camera and date of the folders older than keep_days."""
    return log.select("camera", "date").distinct().where(F.col("date") < F.date_sub(F.to_date(now), keep_days))


def clip_files(spark: SparkSession, root: str, extensions: tuple[str, ...]) -> DataFrame:
    """camera, filename, path, size, mod_time of files below root; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "modificationTime", "length")
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    return files.where(F.regexp_extract(name, r"(\.[^./]*)$", 1).isin(*extensions)).select(F.element_at(parts, -2).alias("camera"), name.alias("filename"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("mod_time"))


def sidecars(spark: SparkSession, paths: str | list[str], schema: StructType, suffix: str) -> DataFrame:
    """JSON documents beside clips, with clip_path: their own path without the suffix; broken ones give null fields."""
    rows = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").schema(schema).json(paths)
    return rows.withColumn("clip_path", F.regexp_replace(F.input_file_name(), suffix.replace(".", r"\.") + "$", ""))


def frame_fixture(spark: SparkSession, path: str) -> DataFrame:
    """camera (the file's name), seq, byte_count, is_keyframe of recorded frame lists."""
    rows = read_json(spark, path, FRAME, multiline=True).withColumn("camera", F.regexp_extract(F.input_file_name(), r"([^/]+?)(_fixture)?\.json$", 1))
    return rows.select("camera", F.posexplode("frames").alias("seq", "f")).select("camera", (F.col("seq") + 1).cast("long").alias("seq"), F.col("f.pkt_size").cast("long").alias("byte_count"), (F.col("f.key_frame") == 1).alias("is_keyframe"))


def labels_by_event(clips: DataFrame) -> DataFrame:
    """One label for each event that has one: of several clips' the newest."""
    good = clips.where((F.coalesce("label", F.lit("")) != "") & (F.coalesce("event_id", F.lit("")) != ""))
    return good.groupBy("event_id").agg(F.max_by("label", F.struct("mod_time", "filename")).alias("label"))


CAMERA_DEFAULTS = {
    "motion_z_high": 3.0, "intra_ratio_high": 2.5, "on_threshold": 2, "off_threshold": 45, "bpf_floor": 100.0, "min_bytes_threshold": 0, "configured_periodic_kf": False,
    "gradual_enabled": False, "gradual_threshold": 0.4, "pre_roll_seconds": 6, "post_roll_seconds": 8,
}
MOST_CAMERAS = 64
#: Fixed values that keys of a camera, and of other tables, may have.
CAMERA_CHOICES = {"transport": ("tcp", "udp"), "codec_hint": ("auto", "h264", "h265")}
CHOICES = {
    ("runtime", "log_level"): ("trace", "debug", "info", "warn", "error", "fatal"), ("recording", "container"): ("mpegts", "fmp4"),
    ("recording", "fsync_policy"): ("on_close", "always", "never"), ("mqtt", "qos"): (0, 1, 2),
}


def camera_config(text: str) -> list[dict]:
    """The cameras of a TOML configuration, with defaults; ValueError says what is wrong."""
    config = tomllib.loads(text)
    cameras = config.get("cameras", config.get("camera", []))
    if len(cameras) > MOST_CAMERAS:
        raise ValueError(f"{len(cameras)} cameras; at most {MOST_CAMERAS}")
    if isinstance(cameras, dict):  # a table for each camera, by its name
        cameras = [{"name": name, **c} for name, c in cameras.items()]
    out, wrong = [], [f"{part}.{k}: unknown value {config[part][k]!r}" for (part, k), allowed in CHOICES.items() if k in config.get(part, {}) and config[part][k] not in allowed]
    for c in cameras:
        row = {**CAMERA_DEFAULTS, **{k: v for k, v in {**config.get("detection", {}), **c, **c.get("detection", {})}.items() if k in CAMERA_DEFAULTS}, "camera": c.get("name", ""), "url": c.get("url", "")}
        checks = [
            (row["camera"] == "", "a camera has no name"), (row["url"] == "", "no url"), (not 0 <= row["motion_z_high"] <= 100, "motion_z_high"), (not 0 <= row["intra_ratio_high"] <= 100, "intra_ratio_high"),
            (not 1 <= row["on_threshold"] <= 255, "on_threshold"), (not 1 <= row["off_threshold"] <= 255, "off_threshold"),
            *((c[k] not in allowed, f"{k}: unknown value {c[k]!r}") for k, allowed in CAMERA_CHOICES.items() if k in c), (row["motion_z_high"] <= 0, "motion_z_high must be positive"),
            (not (c.get("buffer_seconds", 60) or c.get("buffer_frames", 0)), "buffer_seconds or buffer_frames must be above 0"),
            (not c.get("buffer_frames") and row["pre_roll_seconds"] > c.get("buffer_seconds", config.get("recording", {}).get("buffer_seconds", 60)), "pre_roll_seconds exceeds the buffer"),
        ]
        wrong += [f"{row['camera']}: {what}" for bad, what in checks if bad]
        out.append(row)
    if wrong:
        raise ValueError("; ".join(wrong))
    return out


def camera_config_table(spark: SparkSession, text: str) -> DataFrame:
    rows = camera_config(text)
    kinds = {bool: "boolean", float: "double", int: "long", str: "string"}
    sample = {**CAMERA_DEFAULTS, "camera": "", "url": ""}
    ddl = ", ".join(f"{k} {kinds[type(v)]}" for k, v in sample.items())
    return spark.createDataFrame([tuple(type(sample[k])(r[k]) for k in sample) for r in rows], ddl)


def latest_configs(history: DataFrame, n: int = 20) -> DataFrame:
    """The last n configurations of each camera, newest first by rank."""
    w = Window.partitionBy("camera").orderBy(F.desc("applied_at"), F.desc("run_id"))
    return history.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def rolled_back(history: DataFrame, run_id: str) -> DataFrame:
    """The configuration before the run whose id begins so: the first by path."""
    return history.where(F.col("run_id").startswith(run_id)).orderBy("run_id").limit(1).select("camera", F.col("previous_cfg").alias("cfg"))
