"""Queries on payloads, texts and labels as others read them, and on configurations that were applied and taken back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from camloom.operators import tuner as T
from camloom.plans.catalog import _GRID, _ORDER, labelled_events
from camloom.plans.registry import query
from camloom.sources import eventlog, sinks
from camloom.sources.adapters import cte, view


@query(f"""with {cte('raw_events')} select camera, '{{"v":2,"instance":"hub \\"1\\"","cam_id":"' || camera || '","event_id":"' || event_id || '","type":"' || case type when 'scene_change' then 'scene_change' else 'motion' end || '","reason":"' || reason
  || '","started_pts_90khz":0,"fps_estimate":0.00,"codec":"h264","z_score":' || printf('%.4f', z_score) || ',"intra_ratio":' || printf('%.4f', intra_ratio) || ',"byte_count":' || bytes || ',"bpf_slow":' || printf('%.4f', bpf_slow)
  || ',"bpf_ewma":0.0000,"bpf_var":0.0000,"since_kf":0,"fsm_before":0,"fsm_after":0}}' as value from raw_events""")
def event_payloads(spark, d):
    """Every event as subscribers get it."""
    return sinks.mqtt_payload(view(spark, d, "raw_events"), 'hub "1"')


@query(f"""with {cte('clips')} select camera, '{{"v":1,"instance":"hub","event_id":"' || event_id || '","cam_id":"' || camera || '","container":"mpegts","codec":"h264","path":"/clips/' || filename || '","size_bytes":' || size || ',"duration_ms":' || size // 1000
  || ',"pre_roll_ms":6000,"post_roll_ms":8000,"sha256":"' || sha256(filename) || '"}}' as value, '{{"online":' || case when size > 10000000 then 'true' else 'false' end || ',"reason":"' || camera || '"}}' as status from clips""")
def clip_payloads(spark, d):
    """Every clip as subscribers get it, and a state of its camera."""
    rows = view(spark, d, "clips").withColumns({
        "container": F.lit("mpegts"), "codec": F.lit("h264"), "path": F.concat(F.lit("/clips/"), "filename"), "size_bytes": F.col("size"), "duration_ms": F.expr("size div 1000"),
        "pre_roll_ms": F.lit(6000), "post_roll_ms": F.lit(8000), "sha256": F.sha2("filename", 256), "status": sinks.status_payload(F.col("size") > 10_000_000, F.col("camera")),
    })
    return sinks.clip_payload(rows, "hub", ["status"])


@query(f"""with {cte('raw_events')}, n as (select camera, type, count(*) as n, cast(sum(bytes) as bigint) as b from raw_events group by 1, 2)
select 'events_total{{camera="' || camera || '",type="' || type || '"}} ' || n as value from n union all select 'bytes_total{{camera="' || camera || '",type="' || type || '"}} ' || b from n union all select 'up 1'""")
def metrics_text(spark, d):
    """Counters of events and bytes by camera and type, as lines of text."""
    counts = view(spark, d, "raw_events").groupBy("camera", "type").agg(F.count(F.lit(1)).alias("events_total"), F.sum("bytes").alias("bytes_total"))
    labels = F.create_map(F.lit("type"), "type", F.lit("camera"), "camera")
    series = counts.select(labels.alias("labels"), F.explode(F.create_map(F.lit("events_total"), "events_total", F.lit("bytes_total"), "bytes_total")).alias("name", "value"))
    up = spark.range(1).select(F.create_map().cast("map<string,string>").alias("labels"), F.lit("up").alias("name"), F.lit(1).cast("long").alias("value"))
    return sinks.prometheus(series.unionByName(up))


@query(f"""with {cte('clips', 'event_labels')}, one as (select event_id, max(label) as label from event_labels group by event_id),
c as (select lpad(cast(cast(c.event_id as bigint) % 1000 as varchar), 26, '0') as event_id, filename, mod_time, case when size % 3 = 0 then '' else l.label end as label from clips c left join one l on l.event_id = c.event_id)
select event_id, arg_max(label, (mod_time, filename)) as label from c where coalesce(label, '') != '' group by event_id""")
def labels_of_events(spark, d):
    """The newest label of each event, of all its clips that have one."""
    one = view(spark, d, "event_labels").groupBy("event_id").agg(F.max("label").alias("label"))
    clips = view(spark, d, "clips").join(one, "event_id", "left")
    shared = F.lpad((F.col("event_id").cast("long") % 1000).cast("string"), 26, "0")
    return eventlog.labels_by_event(clips.select(shared.alias("event_id"), "filename", "mod_time", F.when(F.col("size") % 3 == 0, "").otherwise(F.col("label")).alias("label")))


@query(f"""with {cte('raw_events')}, runs as (select camera, date_trunc('day', ts) as applied_at, count(*) as n from raw_events group by 1, 2),
history as (select camera, applied_at, lag(n) over w as previous_cfg, n as new_cfg from runs window w as (partition by camera order by applied_at)),
plan as (select camera, new_cfg, new_cfg + 1 as next from (select *, row_number() over (partition by camera order by applied_at desc) as r from history) where r = 1),
after as (select * from history union all select camera, timestamp '2030-01-01', new_cfg, next from plan)
select camera, count(*) as n_runs, max_by(previous_cfg, applied_at) as rolled_back_to, max_by(new_cfg, applied_at) as in_effect from after group by camera""")
def config_rollback(spark, d):
    """A plan for every camera applied on top of its history; what is in effect, and what taking the run back would bring."""
    runs = view(spark, d, "raw_events").groupBy("camera", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("applied_at")).agg(F.min("event_id").alias("run_id"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("camera").orderBy("applied_at")
    history = runs.select("run_id", "camera", "applied_at", F.lag("n").over(w).alias("previous_cfg"), F.col("n").alias("new_cfg"))
    plan = eventlog.latest_configs(history, 1).select("camera", F.col("new_cfg").alias("previous_cfg"), (F.col("new_cfg") + 1).alias("new_cfg"))
    after = sinks.applied(history, plan, "run-next", F.lit("2030-01-01").cast("timestamp_ntz"))
    now = eventlog.latest_configs(after, 1).select("camera", F.col("previous_cfg").alias("rolled_back_to"), F.col("new_cfg").alias("in_effect"))
    return after.groupBy("camera").agg(F.count(F.lit(1)).alias("n_runs")).join(now, "camera")


@query("""select doc_id, md5(replace(replace(replace(replace(replace(coalesce("text", ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&#34;'), '''', '&#39;')) as html_md5,
  md5(cast(to_json(coalesce("text", '')) as varchar)[2:-2]) as json_md5 from documents""")
def escaped_texts(spark, d):
    """Texts as HTML and JSON hold them."""
    text = F.coalesce("text", F.lit(""))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.md5(sinks.html_escaped(text)).alias("html_md5"), F.md5(sinks.json_escaped(text)).alias("json_md5"))


_METRICS = {"f0.5": "score", "f1": "case when precision + recall = 0 then 0e0 else 2e0 * precision * recall / (precision + recall) end", "precision": "precision", "recall": "recall"}


@query(_GRID + " union all ".join(f" (select '{name}' as objective, {_ORDER}, round(m, 6) as value from (select *, {sql} as m from c) order by m desc, {_ORDER} limit 1)" for name, sql in _METRICS.items()))
def best_by_objective(spark, d):
    """The best candidate under each objective that a tuner may be given."""
    events, out = labelled_events(spark, d), None
    for name, beta, metric in (("f0.5", 0.5, "score"), ("f1", 1.0, "score"), ("precision", 0.5, "precision"), ("recall", 0.5, "recall")):
        best = T.ranked(T.grid_scores(events, beta), metric).limit(1).select(F.lit(name).alias("objective"), *T.GRID, *T.WARMUP, F.round(metric, 6).alias("value"))
        out = best if out is None else out.unionByName(best)
    return out
