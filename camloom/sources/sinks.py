"""Writers: routed verdicts, plans, sidecars, metrics text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from camloom.functions.scalars import subject


def routed(verdicts: DataFrame) -> DataFrame:
    """subject, value: each event as JSON under the bus subject of its verdict."""
    kind = F.when(F.col("verdict") == "suppressed", "suppressed").otherwise("confirmed")
    topic = F.concat_ws(".", F.lit("events"), kind, F.col("site"), F.col("camera"))
    return verdicts.select(topic.alias("subject"), F.to_json(F.struct(*verdicts.columns)).alias("value"))


def published(events: DataFrame) -> DataFrame:
    return events.select(subject("raw", F.col("site"), F.col("camera")).alias("subject"), F.to_json(F.struct(*events.columns)).alias("value"))


def write_verdicts(verdicts: DataFrame, root: str, batch_id: int | None = None) -> None:
    """One table partitioned by verdict. With a batch id, the batch has a folder of its own that a repeated batch replaces, so a
    stream that starts over writes nothing twice."""
    out = root if batch_id is None else f"{root}/batch={batch_id}"
    verdicts.write.mode("append" if batch_id is None else "overwrite").partitionBy("verdict").parquet(out)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_text(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").text(path)


def prometheus(series: DataFrame) -> DataFrame:
    """(name, labels map, value) -> lines of text exposition, labels in order of name."""
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), escaped(e["value"]), F.lit('"')))
    body = F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    return series.select(F.concat(F.col("name"), body, F.lit(" "), F.col("value").cast("string")).alias("value"))


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


TEXT = -1


def json_escaped(text: Column) -> Column:
    """A text as it stands between the quotes of a JSON string; a null one is empty."""
    whole = F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("t")))
    return whole.substr(F.lit(7), F.char_length(whole) - 8)


def html_escaped(text: Column) -> Column:
    out = text
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def json_line(fields: list[tuple[str, Column, int | None]]) -> Column:
    """An object with fields in this order: (name, value, decimals). Texts (TEXT) are quoted and escaped, numbers as they are (None) or with
    fixed decimals, as subscribers parse them. A null text is empty, a null number 0."""

    def of(value: Column, decimals: int | None) -> Column:
        if decimals == TEXT:
            return F.concat(F.lit('"'), json_escaped(value), F.lit('"'))
        number = F.coalesce(value, F.lit(0))
        return number.cast("string") if decimals is None else F.format_string(f"%.{decimals}f", number.cast("double"))

    return F.concat(*(F.concat(F.lit(f'{"," if k else "{"}"{name}":'), of(value, decimals)) for k, (name, value, decimals) in enumerate(fields)), F.lit("}"))


def mqtt_payload(events: DataFrame, instance: str = "") -> DataFrame:
    """camera, value: an event for subscribers, version 2. Columns that events lack are empty or 0, the codec h264."""
    has = lambda name, other: F.col(name) if name in events.columns else F.lit(other)
    kind = F.when(F.col("type") == "scene_change", "scene_change").otherwise("motion")
    # Fixed names, order and decimals.
    fields = [
        ("v", F.lit(2), None), ("instance", F.lit(instance), TEXT), ("cam_id", F.col("camera"), TEXT), ("event_id", F.col("event_id"), TEXT), ("type", kind, TEXT), ("reason", has("reason", ""), TEXT),
        ("started_pts_90khz", has("pts_start", 0), None), ("fps_estimate", has("fps", 0.0), 2), ("codec", has("codec", "h264"), TEXT), ("z_score", F.col("z_score"), 4), ("intra_ratio", F.col("intra_ratio"), 4),
        ("byte_count", F.col("bytes"), None), ("bpf_slow", has("bpf_slow", 0.0), 4), ("bpf_ewma", has("bpf_ewma", 0.0), 4), ("bpf_var", has("bpf_var", 0.0), 4), ("since_kf", has("since_kf", 0), None),
        ("fsm_before", has("fsm_before", 0), None), ("fsm_after", has("fsm_after", 0), None),
    ]
    return events.select("camera", json_line(fields).alias("value"))


def clip_payload(clips: DataFrame, instance: str = "", carry: list[str] | None = None) -> DataFrame:
    """camera, value: a finished clip for subscribers, version 1; with carry's columns."""
    # Fixed names and order.
    texts, numbers = ("container", "codec", "path"), ("size_bytes", "duration_ms", "pre_roll_ms", "post_roll_ms")
    heads = [("v", F.lit(1), None), ("instance", F.lit(instance), TEXT), ("event_id", F.col("event_id"), TEXT), ("cam_id", F.col("camera"), TEXT)]
    fields = [*heads, *((n, F.col(n), TEXT) for n in texts), *((n, F.col(n), None) for n in numbers), ("sha256", F.col("sha256"), TEXT)]
    return clips.select("camera", json_line(fields).alias("value"), *(carry or []))


def status_payload(online: Column, reason: Column) -> Column:
    return F.concat(F.lit('{"online":'), F.when(online, "true").otherwise("false"), F.lit(',"reason":"'), json_escaped(reason), F.lit('"}'))


def clip_digest(files: DataFrame) -> DataFrame:
    """path, size, sha256 of binary files."""
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def applied(history: DataFrame, plan: DataFrame, run_id: str, at: Column, dry_run: bool = False) -> DataFrame:
    """History with the plan (camera, previous_cfg, new_cfg) as one more entry; unchanged in a dry run."""
    entry = plan.select(F.lit(run_id).alias("run_id"), "camera", at.alias("applied_at"), "previous_cfg", "new_cfg")
    return history if dry_run else history.unionByName(entry)
