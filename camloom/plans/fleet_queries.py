"""Queries on groups of cameras, and on the outbox."""

from __future__ import annotations

from pyspark.sql import functions as F

from camloom.operators import clusters as CL
from camloom.operators.stats import fingerprints
from camloom.operators.tuner import GRID, WARMUP, labelled
from camloom.plans.catalog import _GRID, _ORDER, _events_stream
from camloom.plans.registry import query
from camloom.sources.adapters import cte, view
from camloom.streaming import outbox

FEATURES = ["median_bytes", "var_bytes", "keyframe_share"]
GROUPS, ROUNDS, LEAST = 3, 6, 640


def _cluster_sql() -> str:
    scale = ", ".join(f"case when max({c}) over () > min({c}) over () then ({c} - min({c}) over ()) / (max({c}) over () - min({c}) over ()) else 0e0 end as {c}" for c in FEATURES)
    steps = [
        f"""{cte('frames')}, prints as (select camera, cast(quantile_disc(byte_count, 5e-1) as double) as median_bytes, var_pop(byte_count) as var_bytes, avg(is_keyframe::int) as keyframe_share from frames group by camera),
scaled as (select camera, {scale} from prints)""",
        "centre0 as (" + " union all ".join(f"select {k} as cluster, " + ", ".join(f"quantile_disc({c}, {(k + 0.5) / GROUPS}) as {c}" for c in FEATURES) + " from scaled" for k in range(GROUPS)) + ")",
    ]
    far = " + ".join(f"abs(s.{c} - e.{c})" for c in FEATURES)
    for r in range(ROUNDS + 1):
        steps.append(f"near{r} as (select camera, arg_min(cluster, far) as cluster from (select s.camera, e.cluster, ({far}, e.cluster) as far from scaled s, centre{r} e) group by camera)")
        medians = ", ".join(f"quantile_disc({c}, 5e-1) as {c}" for c in FEATURES)
        moved = ", ".join(f"coalesce(m.{c}, e.{c}) as {c}" for c in FEATURES)
        steps.append(f"centre{r + 1} as (select e.cluster, {moved} from centre{r} e left join (select cluster, {medians} from scaled join near{r} using (camera) group by cluster) m on m.cluster = e.cluster)")
    return ", ".join([*steps, f"cl as (select camera, cast(cluster as int) as cluster from near{ROUNDS})"])


_CLUSTERS = _cluster_sql()


def groups(spark, d):  # noqa: ANN001, ANN201
    return CL.clustered(fingerprints(view(spark, d, "frames")), FEATURES, GROUPS, ROUNDS)


@query(f"with {_CLUSTERS} select camera, cluster from cl")
def camera_clusters(spark, d):
    """Cameras in three groups by their fingerprints."""
    return groups(spark, d)


def _best_sql(by: str, name: str, events: str) -> str:
    grid = _GRID.partition("grid as (")[2].replace("select grid.*, label_value,", f"select grid.*, {by}, label_value,").replace("from ev, grid)", f"from ({events}) ev, grid)").replace("t as (select motion", f"t as (select {by}, motion")
    renamed = "grid as (" + grid
    for part in ("grid", "f", "t", "pr", "sc", "c"):
        renamed = renamed.replace(f"\n{part} as (", f"\n{name}_{part} as (").replace(f"from {part})", f"from {name}_{part})").replace(f"from {part} ", f"from {name}_{part} ").replace(f"from {part},", f"from {name}_{part},")
    return f"""{renamed.replace('grid as (', f'{name}_grid as (', 1).replace('ev, grid)', f'ev, {name}_grid)').replace('select grid.*', f'select {name}_grid.*').replace('select sc.*', f'select {name}_sc.*')},
{name}_best as (select {by}, {_ORDER}, score from (select *, row_number() over (partition by {by} order by score desc, {_ORDER}) as r from {name}_c) where r = 1)"""


@query(f"""{_GRID.partition('grid as (')[0].rstrip().rstrip(',')}, {_CLUSTERS},
{_best_sql('camera', 'own', 'select * from ev')},
{_best_sql('cluster', 'grp', 'select ev.*, cl.cluster from ev join cl using (camera)')},
n as (select camera, count(*) as n_labels from ev group by camera)
select cl.camera, cl.cluster, coalesce(n_labels, 0) as n_labels, case when coalesce(n_labels, 0) >= {LEAST} then 'camera' else 'cluster' end as level,
  {', '.join(f'case when coalesce(n_labels, 0) >= {LEAST} then o.{c} else g.{c} end as {c}' for c in (*GRID, *WARMUP))}, round(case when coalesce(n_labels, 0) >= {LEAST} then o.score else g.score end, 6) as score
from cl left join n using (camera) left join own_best o on o.camera = cl.camera left join grp_best g on g.cluster = cl.cluster""")
def best_by_cluster(spark, d):
    """The best thresholds of each camera, or of its group where it has fewer than 640 labelled events."""
    events = labelled(view(spark, d, "raw_events"), view(spark, d, "event_labels"))
    return CL.tuned(events, groups(spark, d), LEAST).withColumn("score", F.round("score", 6))


_ACKED = "cast(event_id as bigint) % 7 <> 3"
_AFTER = "cast(event_id as bigint) % 10"


@query(f"""with {cte('raw_events')} select event_id, camera from raw_events where not ({_ACKED} and {_AFTER} <= 5)
and ts + interval 5 minute < (select least(max(ts), max(ts + {_AFTER} * interval 1 minute) filter (where {_ACKED})) - interval 10 minute from raw_events)""")
def stream_outbox(spark, d):
    """Events that no acknowledgement reached within five minutes; some are acknowledged later, some never."""
    from camloom.sources.shared import drained

    acks = _events_stream(spark, d).where(_ACKED).select("event_id", F.expr(f"ts + make_interval(0, 0, 0, 0, 0, cast({_AFTER} as int), 0)").alias("ack_ts"))
    return drained(outbox.unacknowledged_stream(_events_stream(spark, d).select("event_id", "camera", "ts"), acks)).select("event_id", "camera")


@query(f"""with {cte('raw_events')}, r as (select site as bucket, event_id as key from raw_events union all select 'clips', event_id from raw_events where type = 'motion')
select bucket, key, row_number() over (partition by bucket order by key) as place from r where not (bucket <> 'clips' and {_ACKED.replace('event_id', 'key')})""")
def outbox_replay(spark, d):
    """What is published again at a start, in key order: events of each site without an acknowledgement, and all clips."""
    events = view(spark, d, "raw_events")
    records = events.select(F.col("site").alias("bucket"), F.col("event_id").alias("key")).unionByName(events.where("type = 'motion'").select(F.lit("clips").alias("bucket"), F.col("event_id").alias("key")))
    return outbox.replay(records, events.where(_ACKED).select(F.col("site").alias("bucket"), F.col("event_id").alias("key")))
