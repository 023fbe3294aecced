"""All named queries, each with its twin in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from camloom.functions import scalars as S
from camloom.operators import clips as C
from camloom.operators import detector as D
from camloom.operators import ordered as O
from camloom.operators import rules as R
from camloom.operators import stats as ST
from camloom.operators import tuner as T
from camloom.plans import packet_queries, region_queries  # noqa: F401  (they register their queries)
from camloom.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from camloom.sources.adapters import cte, view

FLAGSHIP = D.Config(off_threshold=5)


def last_ts(events: DataFrame):  # noqa: ANN201
    """The latest time of the data: what "now" means in queries on recorded data."""
    return F.lit(events.agg(F.max("ts")).first()[0])


# ---------------------------------------------------------------- detector

_FOLD = f"with recursive {cte('frames')}, {D.fold_sql(FLAGSHIP)}"


@query(f"{_FOLD} select camera, seq, byte_count, round(z_score, 6) as z_score, round(intra_ratio, 6) as intra_ratio from fold where event")
def detector_events(spark, d):
    out = D.signals(view(spark, d, "plain_frames"), FLAGSHIP, events_only=True, order=("ts", "src_id"))
    return out.select("camera", "seq", "byte_count", F.round("z_score", 6).alias("z_score"), F.round("intra_ratio", 6).alias("intra_ratio"))


@query(f"{_FOLD} select camera, seq, round(z_score, 6) as z_score, cast(fsm_before as smallint) as fsm_before, cast(fsm as smallint) as fsm_after, since_kf, event as is_event from fold where seq > 0")
def detector_signals(spark, d):
    out = D.signals(view(spark, d, "plain_frames"), FLAGSHIP, order=("ts", "src_id"))
    return out.select("camera", "seq", F.round("z_score", 6).alias("z_score"), "fsm_before", "fsm_after", "since_kf", F.col("event").isNotNull().alias("is_event"))


@query(f"{_FOLD} select camera, cast(count(*) filter (where event) as bigint) as n_events, round(max(z_score), 6) as z_max from fold where seq > 0 group by camera")
def detector_by_camera(spark, d):
    out = D.signals(view(spark, d, "plain_frames"), FLAGSHIP, order=("ts", "src_id"))
    return out.groupBy("camera").agg(F.count("event").alias("n_events"), F.round(F.max("z_score"), 6).alias("z_max"))


_COLUMNS = {"on": "on_threshold", "off": "off_threshold", "z": "motion_z_high", "intra": "intra_ratio_high", "floor": "bpf_floor", "min_bytes": "min_bytes_threshold"}
_OF_CAMERAS = f"""with recursive {cte('frames', 'camera_config').replace('frames as (', 'numbered as (', 1)},
frames as (select n.*, {', '.join(f"coalesce(c.{c}, {getattr(D.Config(), c)}) as {c}" for c in _COLUMNS.values())} from numbered n left join camera_config c on c.camera = n.camera), {D.fold_sql(D.Config(), _COLUMNS)}"""


@query(f"""{_OF_CAMERAS} select fold.camera, fold.seq, fold.byte_count, round(z_score, 6) as z_score, case when fold.is_keyframe then 'unexpected_idr'
  else concat_ws(',', case when z_score > motion_z_high then printf('z=%.2f', z_score) end, case when intra_ratio > intra_ratio_high then printf('intra_ratio=%.2f', intra_ratio) end) end as reason
from fold join frames f on f.camera = fold.camera and f.seq = fold.seq where event""")
def detector_per_camera_config(spark, d):
    out = D.signals(view(spark, d, "plain_frames"), D.Config(), view(spark, d, "camera_config"), events_only=True, order=("ts", "src_id"))
    return out.select("camera", "seq", "byte_count", F.round("z_score", 6).alias("z_score"), "reason")


SLOW_CHANGE = D.Config(off_threshold=5, gradual_enabled=True, gradual_threshold=0.03, gradual_window_frames=40)


@query(f"""with recursive {cte('frames')}, {D.fold_sql(SLOW_CHANGE)}
select camera, seq, case when event then 'motion' else 'scene_change' end as event, case when scene then printf('gradual:diverge=%.3f', diverge) end as reason from fold where event or scene""")
def detector_gradual(spark, d):
    """Motion, and scenes that change slowly: slow means that stay apart for 40 frames."""
    out = D.signals(view(spark, d, "plain_frames"), SLOW_CHANGE, events_only=True, order=("ts", "src_id"))
    return out.select("camera", "seq", "event", F.when(F.col("event") == "scene_change", F.col("reason")).alias("reason"))


@query(f"""with {cte('frames')}, s as (select *, min(seq) filter (where not is_keyframe) over (partition by camera) as seed from frames)
select camera, cast(count(*) as bigint) as n, round(list_reduce(list(cast(byte_count as double) order by seq) filter (where seq >= coalesce(seed, 0)), lambda m, x: 2e-1 * x + (1e0 - 2e-1) * m), 6) as bpf_ewma from s group by camera""")
def ewma_by_camera(spark, d):
    return D.ewma(view(spark, d, "plain_frames"), ("ts", "src_id")).select("camera", "n", F.round("bpf_ewma", 6).alias("bpf_ewma"))


# ---------------------------------------------------------------- order


@query(f"""with {cte('frames')}, g as (select *, sum(is_keyframe::int) over (partition by camera order by seq) as gop from frames)
select camera, seq, case when gop > 0 then cast(row_number() over (partition by camera, gop order by seq) - 1 as bigint) end as since_kf from g""")
def since_keyframe(spark, d):
    return O.since_keyframe(view(spark, d, "frames")).select("camera", "seq", "since_kf")


_UNITS = f"""with {cte('nal')}, c as (select *, case when pts_90khz is not distinct from lag(pts_90khz) over (partition by camera order by seq) and seq > 1 then 0 else 1 end as ch from nal),
i as (select *, sum(ch) over (partition by camera order by seq) as island from c),
u as (select camera, island, min(seq) as first_seq, min(pts_90khz) as pts_90khz, cast(sum(length) as bigint) as byte_count, count(*) as n_nal,
  bool_or((flags & 1) > 0) as is_keyframe, bool_or((flags & 2) > 0) as is_intra, bool_or((flags & 8) > 0) as is_bframe from i group by camera, island),
units as (select * from (select *, max(island) over (partition by camera) as last from u) where island < last and byte_count > 0)"""


@query(_UNITS + " select camera, first_seq, pts_90khz, byte_count, n_nal, is_keyframe, is_intra, is_bframe from units")
def au_assembly(spark, d):
    return O.access_units(view(spark, d, "nal")).drop("island")


@query(f"""with {cte('nal')}, p as (select *, row_number() over (partition by camera order by seq) - 1 as place from nal)
select camera, seq, cast(sum(case when (flags & 1) > 0 and place > 0 then 1 else 0 end) over (partition by camera order by seq) as bigint) as fragment,
  pts_90khz - first(pts_90khz) over (partition by camera order by seq) as pts_offset, place % 90 = 0 as with_tables from p""")
def gop_fragments(spark, d):
    return O.fragments(view(spark, d, "nal")).select("camera", "seq", "fragment", "pts_offset", "with_tables")


def timeline_records(spark, d):
    """NAL records with a made-up z: 0 for one in three."""
    return view(spark, d, "nal").withColumn("z_score", F.when(F.col("length") % 3 == 0, 0.0).otherwise((F.col("length") % 1000) / 100.0))


@query(f"""with {cte('nal')}, r as (select *, case when length % 3 = 0 then 0e0 else (length % 1000) / 100e0 end as z from nal),
c as (select *, case when pts_90khz is not distinct from lag(pts_90khz) over (partition by camera order by seq) and seq > 1 then 0 else 1 end as ch from r),
i as (select *, sum(ch) over (partition by camera order by seq) as island from c),
p as (select camera, island, min(pts_90khz) as pts, bool_or((flags & 1) > 0) as kf, bool_or((flags & 8) > 0) as bf, arg_max(z, seq) filter (where z <> 0) as z from i group by camera, island),
t as (select camera, island, cast(floor((pts - first(pts) over w) / 90) as bigint) as offset_ms, lead(coalesce(z, 0e0), 1, 0e0) over w as z_score, kf as is_keyframe, bf as is_bframe,
  cast(trunc((lead(pts) over w - pts) / 90) as bigint) as width_ms from p window w as (partition by camera order by island))
select camera, offset_ms, z_score, is_keyframe, is_bframe, width_ms from t where island <= 480""")
def z_timeline(spark, d):
    return O.z_timeline(timeline_records(spark, d), cap=480)


def _snapshot_sql(asked: str) -> str:
    return f"""with {cte('nal')},
r as (select *, cast(sum(length) over (partition by camera order by seq) as bigint) as upto from nal),
w as (select camera, seq as window_id, greatest(0, pts_90khz - 6 * 90000) as from_pts, pts_90khz + 8 * 90000 as to_pts from nal{asked}),
newest as (select camera, pts_90khz, max_by(seq, seq) as seq, max_by(upto, seq) as upto from r group by all),
entries as (select camera, pts_90khz, max_by(seq, seq) as seq, max_by(upto - length, seq) as before from r where (flags & 3) > 0 group by all),
o as (select camera, min(seq) as seq, min_by(upto - length, seq) as before from r group by camera),
h as (select w.*, n.seq as last_seq, n.upto from w asof join newest n on n.camera = w.camera and n.pts_90khz <= w.to_pts)
select h.camera, h.window_id, coalesce(e.seq, o.seq) as first_seq, h.last_seq, h.last_seq - coalesce(e.seq, o.seq) + 1 as n_records, h.upto - coalesce(e.before, o.before) as n_bytes
from h asof left join entries e on e.camera = h.camera and e.pts_90khz < h.from_pts join o on o.camera = h.camera"""


@query(_snapshot_sql(" where (flags & 1) > 0"))
def snapshot_window(spark, d):
    """A window around every keyframe."""
    nal = view(spark, d, "nal")
    return _snapshots(nal, nal.where(O.flag(O.KEYFRAME)))


@query(_snapshot_sql(""))
def snapshot_every_record(spark, d):
    """A window around every record."""
    nal = view(spark, d, "nal")
    return _snapshots(nal, nal)


def _snapshots(nal, asked):
    events = asked.withColumns({"pre_roll_seconds": F.lit(6), "post_roll_seconds": F.lit(8), "window_id": F.col("seq")})
    windows = O.roll_windows(events).select("camera", "window_id", F.col("pre_pts").alias("from_pts"), F.col("post_pts").alias("to_pts"))
    return O.snapshots(nal, windows)


@query(f"""with {cte('raw_events')}, s as (select *, case when date_diff('microsecond', lag(ts) over w, ts) <= 300000000 then 0 else 1 end as fresh from raw_events where type = 'motion' window w as (partition by camera order by ts, event_id)),
n as (select *, sum(fresh) over (partition by camera order by ts, event_id) as session from s)
select camera, cast(session as bigint) as session, min(ts) as first_ts, max(ts) as last_ts, count(*) as n from n group by camera, session""")
def coalesce_sessions(spark, d):
    return O.sessions(view(spark, d, "raw_events").where("type = 'motion'"), 300)


@query(f"with {cte('raw_events')} select event_id, camera, ts from (select *, row_number() over (partition by camera, date_trunc('hour', ts) order by ts, event_id) as r from raw_events) where r <= 2")
def rate_limited(spark, d):
    return O.rate_limited(view(spark, d, "raw_events"), 2, "hour").select("event_id", "camera", "ts")


@query(f"with {cte('nal')} select camera, seq, length from (select *, row_number() over (partition by camera order by seq desc) as r from nal) where r <= 63")
def ring_content(spark, d):
    return O.newest(view(spark, d, "nal"), 64).select("camera", "seq", "length")


@query(f"with {cte('frames')} select camera, seq, byte_count from frames where seq % 150 = 0")
def stats_samples(spark, d):
    return O.sampled(view(spark, d, "frames")).select("camera", "seq", "byte_count")


# ---------------------------------------------------------------- logs and rules


@query(f"""with {cte('raw_events')}, b as (select max(ts) as now from raw_events)
select event_id, camera, ts, z_score from raw_events, b where ts between now - interval 7 day and now order by ts, event_id limit 1000""")
def event_log_range(spark, d):
    from camloom.sources.eventlog import first_rows

    events = view(spark, d, "raw_events")
    now = last_ts(events)
    rows = events.where(F.col("ts").between(now - F.make_dt_interval(F.lit(7)), now))
    return first_rows(rows.select("event_id", "camera", "ts", "z_score"), 1000)


_VERDICTS = f"""with {cte('raw_events')}, v as (select *, case when contains(reason, 'unexpected_idr') and z_score >= 2e0 then 'idr_burst'
  when (bpf_slow > 0 and bytes < 12e-1 * bpf_slow) or bytes < 800 then 'bytes_floor' when intra_ratio > 25e-1 and z_score < 35e-1 then 'intra_ratio' else 'passthrough' end as decided_by from raw_events)"""


def verdicts(spark, d):
    return R.cascade(view(spark, d, "raw_events"), [R.idr_burst(2.0), R.bytes_floor(1.2, 800), R.intra_ratio(2.5, 3.5), R.pass_through()])


@query(_VERDICTS + " select event_id, decided_by, case when decided_by = 'passthrough' then 'confirmed' else 'suppressed' end as verdict from v")
def postproc_verdicts(spark, d):
    return verdicts(spark, d).select("event_id", "decided_by", "verdict")


@query(_VERDICTS + " select camera, decided_by, count(*) as n from v group by camera, decided_by")
def postproc_counts(spark, d):
    return verdicts(spark, d).groupBy("camera", "decided_by").agg(F.count(F.lit(1)).alias("n"))


@query(_VERDICTS + """ select case when decided_by = 'passthrough' then 'events.confirmed.' else 'events.suppressed.' end || site || '.' || camera as subject, count(*) as n from v group by 1""")
def routed_subjects(spark, d):
    from camloom.sources.sinks import routed

    return routed(verdicts(spark, d)).groupBy("subject").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {cte('raw_events')} select event_id from raw_events where 'events.raw.' || site || '.' || camera like 'events.raw.site-1.%'")
def subject_filter(spark, d):
    events = view(spark, d, "raw_events")
    return events.where(R.subject_matches(S.subject("raw", F.col("site"), F.col("camera")), "events.raw.site-1.>")).select("event_id")


@query(f"""with {cte('raw_events')} select event_id, (bytes < 500 or (type = 'motion' and z_score < 1) or cast(event_id as bigint) % 100 = 0) and not (z_score >= 9) as dropped from raw_events""")
def gate_rules(spark, d):
    z, kind = F.col("z_score"), F.col("type")
    drops = [F.col("bytes") < 500, (kind == "motion") & (z < 1), F.col("event_id").cast("long") % 100 == 0]
    return R.gate(view(spark, d, "raw_events"), drops, [z >= 9]).select("event_id", "dropped")


@query(f"with {cte('raw_events')} select event_id, (z_score > 3)::int + (intra_ratio > 25e-1)::int + (bytes > 4000)::int as votes, (z_score > 3)::int + (intra_ratio > 25e-1)::int + (bytes > 4000)::int >= 2 as accepted from raw_events")
def signal_vote(spark, d):
    votes = (F.col("z_score") > 3).cast("int") + (F.col("intra_ratio") > 2.5).cast("int") + (F.col("bytes") > 4000).cast("int")
    return view(spark, d, "raw_events").select("event_id", votes.alias("votes"), (votes >= 2).alias("accepted"))


@query(f"""with {cte('raw_events')}, s as (select *, (bytes % 200) / 100e0 as area, (cast(event_id as bigint) % 100) / 100e0 as ssim, (bytes % 97) / 97e0 as conf, (target_class_mask & 1) > 0 as person from raw_events)
select event_id, case when area < 5e-1 then 'bgsub' when ssim > 9e-1 then 'ssim' when not (person and conf >= 4e-1) and not (cam_id = 3) then 'classes' else 'default' end as decided_by from s""")
def vision_cascade(spark, d):
    events = view(spark, d, "raw_events")
    person = F.col("target_class_mask").bitwiseAND(F.lit(1).cast("smallint")) > 0
    seen = F.struct(F.when(person, "person").otherwise("other").alias("class"), ((F.col("bytes") % 97) / 97.0).alias("confidence"), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("bbox"))
    frame = F.struct(F.lit(0).alias("offset_ms"), F.array(seen).alias("detections"), ((F.col("event_id").cast("long") % 100) / 100.0).alias("ssim"), ((F.col("bytes") % 200) / 100.0).alias("bgsub_area"))
    labelled = events.withColumn("label", F.struct(F.array(frame).alias("frames")))
    return R.cascade(labelled, R.vision_gate(0.5, 0.9, 0.4, ["person"], F.col("cam_id") == 3)).select("event_id", "decided_by")


# ---------------------------------------------------------------- tuner

_LABELLED = f"""{cte('raw_events', 'event_labels')}, one as (select event_id, max(label) as label from event_labels group by event_id),
ev as (select r.*, case when label = 'fp' then -1 when label is not null then 1 when bpf_slow > 0 and bytes < 15e-1 * bpf_slow and z_score > 4 then -1 else 1 end as label_value
  from raw_events r left join one o on r.event_id = o.event_id)"""
_GRID = f"""with {_LABELLED}, grid as (select z as motion_z_high, mb as min_bytes_threshold, bf as bpf_relative_floor from (select unnest([25e-1, 3e0, 35e-1, 4e0, 45e-1, 5e0]) as z),
  (select cast(unnest([0, 500, 1000, 2000, 4000, 8000]) as bigint) as mb), (select unnest([0e0, 15e-1, 2e0, 3e0]) as bf)),
f as (select grid.*, label_value, not (min_bytes_threshold > 0 and bytes < min_bytes_threshold) and not (bpf_relative_floor > 0 and bpf_slow > 0 and bytes < bpf_relative_floor * bpf_slow) and z_score >= motion_z_high as fire from ev, grid),
t as (select motion_z_high, min_bytes_threshold, bpf_relative_floor, cast(count(*) filter (where label_value = 1 and fire) as bigint) as tp, cast(count(*) filter (where label_value = -1 and fire) as bigint) as fp,
  cast(count(*) filter (where label_value = 1 and not fire) as bigint) as fn from f group by all),
pr as (select *, case when tp + fp = 0 then 0e0 else tp / (tp + fp) end as precision, case when tp + fn = 0 then 0e0 else tp / (tp + fn) end as recall from t),
sc as (select *, case when 25e-2 * precision + recall = 0 then 0e0 else 125e-2 * precision * recall / (25e-2 * precision + recall) end as score from pr),
c as (select sc.*, wu as z_high_warmup, wf as z_high_warmup_frames from sc, (values (0e0, 0), (0e0, 4), (5e0, 4), (8e0, 4)) w(wu, wf))"""
_ORDER = "motion_z_high, min_bytes_threshold, bpf_relative_floor, z_high_warmup, z_high_warmup_frames"


def labelled_events(spark, d):
    return T.labelled(view(spark, d, "raw_events"), view(spark, d, "event_labels"))


@query(f"with {_LABELLED} select label_value, count(*) as n from ev group by label_value")
def autolabel_counts(spark, d):
    return labelled_events(spark, d).groupBy("label_value").agg(F.count(F.lit(1)).alias("n"))


@query(_GRID + f" select {_ORDER}, tp, fp, fn, round(precision, 6) as precision, round(recall, 6) as recall, round(score, 6) as score from c")
def grid_scores(spark, d):
    out = T.grid_scores(labelled_events(spark, d))
    return out.select(*T.GRID, *T.WARMUP, "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "score")))


def _best(spark, d):
    return T.ranked(T.grid_scores(labelled_events(spark, d))).limit(1)


@query(_GRID + f" select {_ORDER}, tp, fp, fn, round(score, 6) as score from c order by c.score desc, {_ORDER} limit 1")
def best_candidate(spark, d):
    return _best(spark, d).select(*T.GRID, *T.WARMUP, "tp", "fp", "fn", F.round("score", 6).alias("score"))


@query(_GRID + f" select {_ORDER}, round(score, 6) as score from c where recall >= 9e-1 order by c.score desc, {_ORDER} limit 10")
def recall_constrained(spark, d):
    out = T.ranked(T.grid_scores(labelled_events(spark, d)), least_recall=0.9).limit(10)
    return out.select(*T.GRID, *T.WARMUP, F.round("score", 6).alias("score"))


_BEST = _GRID + f", best as (select * from c order by score desc, {_ORDER} limit 1)"


@query(_BEST + f""", facts as (select count(*) as event_count, cast(count(*) filter (where label_value = 1) as bigint) as labelled_tps, cast(count(*) filter (where label_value = -1) as bigint) as labelled_fps,
  count(*) filter (where label_value = 1 and z_score >= 3) as b_tp, count(*) filter (where label_value = -1 and z_score >= 3) as b_fp, count(*) filter (where label_value = 1 and not z_score >= 3) as b_fn from ev),
p as (select event_count, labelled_tps, labelled_fps, {_ORDER}, case when b_fp > 0 then (b_fp - fp) / b_fp * 100 else 0e0 end as less, case when b_tp > 0 then fn / (b_tp + b_fn) * 100 else 0e0 end as loss from facts, best)
select event_count, labelled_tps, labelled_fps, {_ORDER}, round(less, 6) as expected_fp_reduction_pct, round(loss, 6) as expected_tp_loss_pct, not (loss > 2e0) as valid from p""")
def plan_summary(spark, d):
    events = labelled_events(spark, d)
    plan = T.valid_plan(T.plan_summary(events, _best(spark, d)))
    return plan.withColumns({c: F.round(c, 6) for c in ("expected_fp_reduction_pct", "expected_tp_loss_pct")})


@query(_BEST + """ select label_value, cast(rank as int) as rank, event_id, camera, z_score, bytes from (select ev.*, row_number() over (partition by label_value order by ts, event_id) as rank from ev, best
where not (not (min_bytes_threshold > 0 and bytes < min_bytes_threshold) and not (bpf_relative_floor > 0 and bpf_slow > 0 and bytes < bpf_relative_floor * bpf_slow) and z_score >= motion_z_high)) where rank <= 10""")
def flip_samples(spark, d):
    return T.flip_samples(labelled_events(spark, d), _best(spark, d))


@query(_GRID.replace("select grid.*, label_value,", "select grid.*, camera, label_value,").replace("t as (select motion", "t as (select camera, motion") + f" select camera, {_ORDER}, tp, fp, fn, round(score, 6) as score from (select *, row_number() over (partition by camera order by score desc, {_ORDER}) as r from c) where r = 1")
def best_by_camera(spark, d):
    from pyspark.sql.window import Window

    out = T.grid_scores(labelled_events(spark, d), by=["camera"])
    w = Window.partitionBy("camera").orderBy(F.desc("score"), *T.GRID, *T.WARMUP)
    return out.withColumn("r", F.row_number().over(w)).where("r = 1").select("camera", *T.GRID, *T.WARMUP, "tp", "fp", "fn", F.round("score", 6).alias("score"))


@query(f"""with {cte('raw_events')}, m as (select max(ts) - interval 15 day as cut from raw_events),
r as (select camera, ts >= cut as late, count(*) / greatest(1e0, cast(epoch_us(max(ts)) // 1000000 - epoch_us(min(ts)) // 1000000 as double) / 3600) as rate from raw_events, m group by all),
b as (select camera, rate from r where not late), a as (select camera, rate from r where late)
select coalesce(a.camera, b.camera) as camera, round(b.rate, 6) as before_rate, round(a.rate, 6) as after_rate, coalesce(a.rate / b.rate between 3e-1 and 3e0, false) as healthy from b full join a on a.camera = b.camera""")
def canary(spark, d):
    events = view(spark, d, "raw_events")
    cut = last_ts(events) - F.make_dt_interval(F.lit(15))
    out = T.canary(events.where(F.col("ts") < cut), events.where(F.col("ts") >= cut))
    return out.withColumns({c: F.round(c, 6) for c in ("before_rate", "after_rate")})


# ---------------------------------------------------------------- clips

_LISTED = f"{cte('clips', 'event_labels')}, l as (select * from clips where regexp_extract(filename, '(\\.[^./]*)$', 1) in ('.ts', '.mpegts', '.mp4', '.fmp4', '.mkv'))"


@query(f"with {_LISTED} select camera, filename, size, mod_time from l order by mod_time desc, camera, filename limit 50 offset 50")
def clips_page(spark, d):
    return C.page(C.listed(view(spark, d, "clips")), 2, 50).select("camera", "filename", "size", "mod_time")


@query(f"with {_LISTED}, one as (select event_id, max(label) as label from event_labels group by event_id) select camera, coalesce(label, 'none') as label, count(*) as n, cast(sum(size) as bigint) as total_bytes from l left join one on l.event_id = one.event_id group by 1, 2")
def clip_label_join(spark, d):
    both = C.with_sidecars(C.listed(view(spark, d, "clips")), None, view(spark, d, "event_labels"))
    return both.groupBy("camera", F.coalesce("label", F.lit("none")).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total_bytes"))


@query(f"with {_LISTED} select count(*) as n_clips, cast(sum(size) as bigint) as total_bytes, count(distinct camera) as n_cameras from l")
def clip_totals(spark, d):
    return C.totals(C.listed(view(spark, d, "clips")))


@query(f"with {_LISTED}, p as (select * from l order by mod_time desc, camera, filename limit 50 offset 100) select count(*) as n_clips, cast(sum(size) as bigint) as total_bytes from p")
def clips_page_totals(spark, d):
    return C.page_totals(C.listed(view(spark, d, "clips")), 3, 50)


@query(f"""with {_LISTED}, {cte('raw_events')}, one as (select event_id, max(label) as label from event_labels group by event_id)
select filename, z_score, bytes, coalesce(label, 'none') as label from l left join raw_events r on r.event_id = l.event_id left join one on one.event_id = l.event_id""")
def clips_with_sidecars(spark, d):
    meta = view(spark, d, "raw_events").select("event_id", "z_score", "bytes")
    out = C.with_sidecars(C.listed(view(spark, d, "clips")), meta, view(spark, d, "event_labels"))
    return out.select("filename", "z_score", "bytes", F.coalesce("label", F.lit("none")).alias("label"))


@query(f"""with {cte('raw_events', 'event_labels')}, c as (select event_id, label, timestamp '2024-01-01 00:00:00' as labeled_at from event_labels
  union all select event_id, case cast(event_id as bigint) % 5 when 0 then null when 1 then 'tp' when 2 then 'fp' when 3 then 'reference' else 'maybe' end, ts from raw_events),
g as (select *, row_number() over (partition by event_id order by labeled_at desc, label is null desc, label desc) as r from c where label is null or label in ('tp', 'fp', 'reference'))
select event_id, label, labeled_at from g where r = 1 and label is not null""")
def clip_labels_after_changes(spark, d):
    import datetime

    current = view(spark, d, "event_labels").select("event_id", "label", F.lit(datetime.datetime(2024, 1, 1)).cast("timestamp_ntz").alias("labeled_at"))
    k = F.col("event_id").cast("long") % 5
    label = F.when(k == 1, "tp").when(k == 2, "fp").when(k == 3, "reference").when(k == 4, "maybe")
    return C.clip_labels_upserted(current, view(spark, d, "raw_events").select("event_id", label.alias("label"), F.col("ts").cast("timestamp_ntz").alias("labeled_at")))


@query(f"with {cte('clips')} select camera, cast(sum(size) as bigint) as total_bytes, count(*) as n_clips from clips where regexp_extract(filename, '(\\.[^./]*)$', 1) in ('.ts', '.mp4', '.mkv') group by camera")
def disk_usage(spark, d):
    clips = view(spark, d, "clips")
    return C.disk_usage(clips.where(C.extension(F.col("filename")).isin(*C.RETAINED)))


@query(f"""with {cte('clips')}, k as (select *, max(mod_time) over () as now from clips),
r as (select *, coalesce(sum(size) over (partition by camera order by mod_time, filename rows between unbounded preceding and 1 preceding), 0) as before, sum(size) over (partition by camera) as total,
  row_number() over (partition by camera order by mod_time, filename) as place from k where regexp_extract(filename, '(\\.[^./]*)$', 1) in ('.ts', '.mp4', '.mkv')),
x as (select *, mod_time < now - interval 2000 day as aged, total - before > 4000000000 as over from r)
select camera, filename, mod_time, size, case when aged and over then 'age+quota' when over then 'quota' else 'age' end as reason from x where over or (aged and place = 1)""")
def retention_deletes(spark, d):
    clips = view(spark, d, "clips")
    now = F.lit(clips.agg(F.max("mod_time")).first()[0])
    return C.retention(clips, now, 2000, 4_000_000_000)


@query("""with p as (select p_partkey as k, cast(p_partkey % 40 + 1 as int) as last, cast(p_partkey % 13 % (p_partkey % 40 + 1) + 1 as int) as cur from part),
n as (select distinct k, unnest(list_concat([1, last], list_filter(range(cur - 2, cur + 3), lambda x: x >= 1 and x <= last))) as n from p),
g as (select k, n, lag(n) over (partition by k order by n) as b from n)
select k, string_agg(case when n - b > 1 then '-1,' else '' end || n, ',' order by n) as pages from g group by k""")
def page_window(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    last = (F.col("p_partkey") % 40 + 1).cast("int")
    cur = (F.col("p_partkey") % 13 % last + 1).cast("int")
    return part.select(F.col("p_partkey").alias("k"), F.array_join(C.page_numbers(cur, last).cast("array<string>"), ",").alias("pages"))


# ---------------------------------------------------------------- statistics


@query(f"""with {cte('raw_events', 'camera_config')}, m as (select max(ts) as now from raw_events), e as (select r.* from raw_events r, m where ts between now - interval 1 day and now),
a as (select camera, count(*) as n, max(ts) as last_event_ts, avg(z_score) as za, greatest(max(z_score), 0e0) as zm, arg_max(z_score, ts) as zl, arg_max(bpf_slow, ts) as bl, arg_max(intra_ratio, ts) as il, avg(intra_ratio) as ia from e group by camera)
select c.camera, coalesce(n, 0) as event_count_24h, last_event_ts, round(coalesce(za, 0e0), 6) as z_score_avg, coalesce(zm, 0e0) as z_score_max, coalesce(zl, 0e0) as z_score_last,
  coalesce(bl, 0e0) as bpf_slow_last, coalesce(il, 0e0) as intra_ratio_last, round(coalesce(ia, 0e0), 6) as intra_ratio_avg from (select distinct camera from camera_config) c left join a on a.camera = c.camera""")
def camera_stats_24h(spark, d):
    events = view(spark, d, "raw_events")
    now = last_ts(events)
    out = ST.camera_stats(events, view(spark, d, "camera_config"), now - F.make_dt_interval(F.lit(1)), now)
    return out.withColumns({c: F.round(c, 6) for c in ("z_score_avg", "intra_ratio_avg")})


@query(f"""with {_LABELLED.replace('ev as', 'unused as')}, s as (select r.*, label from raw_events r left join one o on r.event_id = o.event_id), {cte('clips')},
f as (select case when grouping(camera) = 1 then 'TOTAL' else camera end as camera, count(*) as n_events, cast(count(*) filter (where label in ('tp', 'reference')) as bigint) as tp, cast(count(*) filter (where label = 'fp') as bigint) as fp,
  avg(z_score) filter (where z_score > 0) as avg_z, avg(bytes) filter (where bytes > 0) as avg_bytes, avg(bpf_slow) filter (where bpf_slow > 0) as avg_bpf_slow from s group by rollup (camera)),
k as (select case when grouping(camera) = 1 then 'TOTAL' else camera end as camera, count(*) as n_clips from clips group by rollup (camera)),
b as (select coalesce(f.camera, k.camera) as camera, coalesce(n_events, 0) as n_events, coalesce(n_clips, 0) as n_clips, coalesce(tp, 0) as tp, coalesce(fp, 0) as fp, coalesce(avg_z, 0e0) as avg_z,
  coalesce(avg_bytes, 0e0) as avg_bytes, coalesce(avg_bpf_slow, 0e0) as avg_bpf_slow from f full join k on f.camera = k.camera)
select camera, n_events, n_clips, tp, fp, round(case when tp + fp > 0 then tp / (tp + fp) * 100 else 0e0 end, 6) as tp_pct, case when tp + fp = 0 then '-' when tp / (tp + fp) * 100 < 50 then '!' else '' end as flag,
  round(avg_z, 6) as avg_z, round(avg_bytes, 6) as avg_bytes, round(avg_bpf_slow, 6) as avg_bpf_slow from b""")
def audit_rollup(spark, d):
    out = ST.audit(view(spark, d, "raw_events"), view(spark, d, "clips"), view(spark, d, "event_labels"))
    return out.withColumns({c: F.round(c, 6) for c in ("tp_pct", "avg_z", "avg_bytes", "avg_bpf_slow")})


@query(f"""with {cte('raw_events')}, b as (select unnest([5e0, 1e1, 15e0, 2e1, 25e0, 3e1, 35e0, 4e1, 45e0, 5e1, null]) as le)
select camera, le, cast(count(*) filter (where le is null or z_score <= le) as bigint) as cumulative, count(*) as total, round(sum(z_score), 6) as value_sum from raw_events, b group by camera, le""")
def histogram_buckets(spark, d):
    out = ST.histogram(view(spark, d, "raw_events"), "z_score", ST.LINEAR, ["camera"])
    return out.withColumn("value_sum", F.round("value_sum", 6))


@query(f"""with {cte('raw_events')}, b as (select unnest([5e0, 1e1, 15e0, 2e1, 25e0, 3e1, 35e0, 4e1, 45e0, 5e1, null]) as le),
h as (select camera, le, count(*) filter (where le is null or z_score <= le) as cum, count(*) as total from raw_events, b group by camera, le),
w as (select *, coalesce(lag(le) over o, 0e0) as low, coalesce(lag(cum) over o, 0) as below from h window o as (partition by camera order by le is null, le)),
q as (select camera, case when le is null then low when cum = below then le else low + (le - low) * (95e-2 * total - below) / (cum - below) end as v, row_number() over (partition by camera order by le is null, le) as r from w where cum >= 95e-2 * total)
select camera, round(v, 6) as quantile from q where r = 1""")
def latency_quantile(spark, d):
    buckets = ST.histogram(view(spark, d, "raw_events"), "z_score", ST.LINEAR, ["camera"])
    return ST.histogram_quantile(buckets, 0.95, ["camera"]).withColumn("quantile", F.round("quantile", 6))


@query(f"with {cte('raw_events')} select time_bucket(interval 5 minute, ts) as window_start, camera, count(*) as n, round(count(*) / 300e0, 6) as rate from raw_events group by 1, 2")
def event_rate_5m(spark, d):
    out = ST.event_rate(view(spark, d, "raw_events"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "camera", "n", F.round("rate", 6).alias("rate"))


@query(f"""with {cte('raw_events')}, e as (select camera, ts, unnest(range(10)) as k from raw_events)
select date_trunc('minute', ts) - to_minutes(k) as window_start, camera, count(*) as n from e group by 1, 2""")
def rolling_10m(spark, d):
    out = ST.event_rate(view(spark, d, "raw_events"), 10, 1)
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "camera", "n")


@query(f"with {cte('raw_events')} select cast(ts as date) as day, camera, count(*) as n, cast(sum(bytes) as bigint) as total_bytes from raw_events group by 1, 2")
def daily_counts(spark, d):
    return view(spark, d, "raw_events").groupBy(F.to_date("ts").alias("day"), "camera").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("total_bytes"))


@query(f"with {cte('raw_events')} select camera, type, count(*) as n, cast(sum(bytes) as bigint) as bytes from raw_events group by cube (camera, type)")
def metrics_cube(spark, d):
    return ST.counters(view(spark, d, "raw_events"))


@query(f"""with {cte('raw_events', 'camera_config')}, e as (select * from (select *, row_number() over (partition by camera order by ts, event_id) as r from raw_events) where r <= 100),
a as (select camera, count(*) as n, max(ts) as last_event_ts, avg(z_score) as za, arg_max(z_score, (ts, event_id)) as zl from e group by camera)
select c.camera, coalesce(n, 0) as event_count_24h, last_event_ts, round(coalesce(za, 0e0), 6) as z_score_avg, coalesce(zl, 0e0) as z_score_last from (select distinct camera from camera_config) c left join a on a.camera = c.camera""")
def camera_stats_capped(spark, d):
    events = view(spark, d, "raw_events")
    bounds = events.agg(F.min("ts"), F.max("ts")).first()
    out = ST.camera_stats(events, view(spark, d, "camera_config"), F.lit(bounds[0]), F.lit(bounds[1]), cap=100)
    return out.select("camera", "event_count_24h", "last_event_ts", F.round("z_score_avg", 6).alias("z_score_avg"), "z_score_last")


@query(f"with {cte('frames')} select is_keyframe, byte_count, count(*) as n from frames group by 1, 2")
def frame_sizes(spark, d):
    return ST.size_distribution(view(spark, d, "frames"))


@query(f"with {cte('frames')} select camera, count(*) as n, quantile_disc(byte_count, 5e-1) as median_bytes, round(var_pop(byte_count), 3) as var_bytes, round(avg(is_keyframe::int), 6) as keyframe_share from frames group by camera")
def camera_fingerprints(spark, d):
    out = ST.fingerprints(view(spark, d, "frames"))
    return out.select("camera", "n", "median_bytes", F.round("var_bytes", 3).alias("var_bytes"), F.round("keyframe_share", 6).alias("keyframe_share"))


@query("select count(*) as n_cameras, cast(count(*) filter (where n_nationkey % 3 > 0) as bigint) as n_connected, bool_or(n_nationkey % 3 > 0) and bool_or(n_nationkey = 1) as ready from nation")
def readiness(spark, d):
    nation = spark.read.parquet(f"{d}/nation.parquet")
    return ST.readiness(nation.select("n_name", (F.col("n_nationkey") % 3 > 0).alias("connected"), (F.col("n_nationkey") == 1).alias("ready")))


# ---------------------------------------------------------------- set operations and feedback


@query(_VERDICTS + f""", {cte('event_labels')} select v.event_id, v.camera from v where decided_by = 'passthrough' and not exists (select 1 from event_labels l where l.event_id = v.event_id)""")
def unknown_events(spark, d):
    confirmed = verdicts(spark, d).where("verdict = 'confirmed'")
    return confirmed.join(view(spark, d, "event_labels"), "event_id", "left_anti").select("event_id", "camera")


@query(_VERDICTS + f""", {cte('event_labels')}, one as (select event_id, max(label) as label from event_labels group by event_id)
select v.event_id, case when label = 'fp' then 'suppressed' when label is not null then 'confirmed' when decided_by = 'passthrough' then 'confirmed' else 'suppressed' end as verdict, label is not null as overridden from v left join one on v.event_id = one.event_id""")
def feedback_override(spark, d):
    labels = view(spark, d, "event_labels").groupBy("event_id").agg(F.max("label").alias("label"))
    both = verdicts(spark, d).join(labels, "event_id", "left")
    verdict = F.when(F.col("label") == "fp", "suppressed").when(F.col("label").isNotNull(), "confirmed").otherwise(F.col("verdict"))
    return both.select("event_id", verdict.alias("verdict"), F.col("label").isNotNull().alias("overridden"))


@query(f"with {cte('raw_events', 'clips')} select camera, max(e) as n_events, max(c) as n_clips from (select camera, count(*) as e, 0 as c from raw_events group by camera union all select camera, 0, count(*) from clips group by camera) group by camera")
def events_and_clips(spark, d):
    e = view(spark, d, "raw_events").groupBy("camera").agg(F.count(F.lit(1)).alias("n_events"))
    c = view(spark, d, "clips").groupBy("camera").agg(F.count(F.lit(1)).alias("n_clips"))
    return e.join(c, "camera", "full").fillna(0, ["n_events", "n_clips"])


@query(f"with {cte('raw_events', 'camera_config')} select camera from raw_events union select camera from camera_config")
def all_cameras(spark, d):
    return view(spark, d, "raw_events").select("camera").unionByName(view(spark, d, "camera_config").select("camera")).distinct()


@query(f"""with {cte('raw_events', 'camera_config')} select e.event_id, e.z_score > motion_z_high and (min_bytes_threshold = 0 or bytes >= min_bytes_threshold) as above from raw_events e join camera_config c on c.camera = e.camera""")
def config_lookup(spark, d):
    both = view(spark, d, "raw_events").join(view(spark, d, "camera_config"), "camera")
    above = (F.col("z_score") > F.col("motion_z_high")) & ((F.col("min_bytes_threshold") == 0) | (F.col("bytes") >= F.col("min_bytes_threshold")))
    return both.select("event_id", above.alias("above"))


# ---------------------------------------------------------------- scalars


@query(f"""with {cte('raw_events')} select event_id, array_to_string(list_filter([case when (target_class_mask & 1) > 0 then 'person' end, case when (target_class_mask & 2) > 0 then 'vehicle' end,
  case when (target_class_mask & 4) > 0 then 'animal' end, case when (target_class_mask & 128) > 0 then 'other' end], lambda x: x is not null), ',') as classes, target_class_mask as mask from raw_events""")
def class_mask_decode(spark, d):
    names = S.mask_classes(F.col("target_class_mask"))
    return view(spark, d, "raw_events").select("event_id", F.array_join(names, ",").alias("classes"), S.classes_mask(names).alias("mask"))


@query(f"""with {cte('raw_events')} select event_id, coalesce(try_cast(nullif(regexp_extract(reason, '^z=([-+]?[0-9]*\\.?[0-9]+)', 1), '') as double), 0e0) as z,
  try_cast(nullif(regexp_extract(reason, 'intra_ratio=([0-9.]+)', 1), '') as double) as intra, contains(reason, 'unexpected_idr') as idr from raw_events""")
def reason_parse(spark, d):
    parts = S.reason_map(F.col("reason"))
    return view(spark, d, "raw_events").select(
        "event_id", S.z_of_reason(F.col("reason")).alias("z"), parts["intra_ratio"].cast("double").alias("intra"), F.array_contains(F.map_keys(parts), "unexpected_idr").alias("idr")
    )


@query("select o_orderkey as k, o_orderkey * 7919 + 1600000000000 as millis from orders")
def ulid_time(spark, d):
    millis = F.col("o_orderkey") * 7919 + 1600000000000
    ids = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.concat(S.ulid_time_letters(millis), F.lit("0123456789ABCDEF")).alias("id"))
    return ids.select("k", S.ulid_millis(F.col("id")).alias("millis"))


@query(f"with {cte('raw_events')} select event_id, case when z_score < 35e-1 then 'ok' when z_score < 6 then 'warn' else 'crit' end as band from raw_events")
def z_band(spark, d):
    return view(spark, d, "raw_events").select("event_id", S.z_band(F.col("z_score")).alias("band"))


@query(f"""with {cte('clips')} select filename, case when size * 8 / 3145728 < 1 then 8e0 else round(size * 8 / 3145728, 6) end as seconds, regexp_extract(filename, '(\\.[^./]*)$', 1) as ext,
  '/api/clips/' || camera || '/' || regexp_replace(filename, '\\.(ts|mpegts)$', '.m3u8') as url,
  case when filename similar to '.*\\.(ts|mpegts)' then 'video/mp2t' when filename similar to '.*\\.mp4' then 'video/mp4' when filename similar to '.*\\.mkv' then 'video/x-matroska' else 'application/octet-stream' end as mime from clips""")
def clip_facts(spark, d):
    f = F.col("filename")
    return view(spark, d, "clips").select("filename", F.round(S.duration_estimate(F.col("size")), 6).alias("seconds"), C.extension(f).alias("ext"), S.clip_url(F.col("camera"), f).alias("url"), S.mime_type(f).alias("mime"))


@query(f"""with {cte('clips')}, s as (select filename, case when size * 8 / 3145728 < 1 then 8e0 else size * 8 / 3145728 end as s from clips)
select filename, concat_ws(chr(10), '#EXTM3U', '#EXT-X-VERSION:3', '#EXT-X-TARGETDURATION:' || cast(floor(s) + 1 as bigint), '#EXT-X-MEDIA-SEQUENCE:0', '#EXTINF:' || printf('%.3f', s) || ',', filename, '#EXT-X-ENDLIST', '') as playlist from s""")
def hls_manifest(spark, d):
    return view(spark, d, "clips").select("filename", S.playlist(F.col("filename"), F.col("size")).alias("playlist"))


@query("""with s as (select p_partkey as k, p_partkey * p_partkey * 977 as n from part)
select k, rtrim(rtrim(printf('%.2f', round(n / (case when n < 1024 then 1 when n < 1048576 then 1024 when n < 1073741824 then 1048576 else 1073741824 end), 2)), '0'), '.') || ' ' || case when n < 1024 then 'B' when n < 1048576 then 'KB' when n < 1073741824 then 'MB' else 'GB' end as size from s""")
def size_band(spark, d):
    n = F.col("p_partkey") * F.col("p_partkey") * 977
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("k"), S.size_text(n).alias("size"))


@query(f"""with {cte('camera_config')}, p as (select camera, case when camera < 'cam-08' then motion_z_high * 50 else motion_z_high end as z, case when camera > 'cam-12' then 0 else on_threshold end as o from camera_config)
select camera, unnest(list_filter([case when not z between 0 and 100 then 'motion_z_high must be 0 to 100' end, case when not o between 1 and 255 then 'on_threshold must be 1 to 255' end], lambda x: x is not null)) as violation from p""")
def config_validation(spark, d):
    cfg = view(spark, d, "camera_config").select(
        "camera", F.when(F.col("camera") < "cam-08", F.col("motion_z_high") * 50).otherwise(F.col("motion_z_high")).alias("motion_z_high"), F.when(F.col("camera") > "cam-12", 0).otherwise(F.col("on_threshold")).alias("on_threshold")
    )
    return cfg.select("camera", F.explode(S.violations(cfg.columns)).alias("violation"))


@query(f"""with {cte('camera_config')}, p as (select camera, case when camera < 'cam-05' then 7e0 end as z, case when camera > 'cam-10' then cast(99 as smallint) end as o from camera_config)
select c.camera, coalesce(z, motion_z_high) as motion_z_high, coalesce(o, off_threshold) as off_threshold from camera_config c left join p on p.camera = c.camera""")
def config_merge(spark, d):
    cfg = view(spark, d, "camera_config")
    patch = cfg.select("camera", F.when(F.col("camera") < "cam-05", 7.0).alias("z"), F.when(F.col("camera") > "cam-10", F.lit(99).cast("smallint")).alias("o"))
    both = cfg.join(patch, "camera", "left")
    return both.select("camera", S.merged(F.col("z"), F.col("motion_z_high")).alias("motion_z_high"), S.merged(F.col("o"), F.col("off_threshold")).alias("off_threshold"))


@query("select l_orderkey as a, l_partkey as b, ((l_orderkey % 65536 - l_partkey % 65536 + 98304) % 65536) - 32768 > 0 as later from lineitem")
def serial_compare(spark, d):
    from camloom.functions.bitstream import seq_after

    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"))
    return rows.select("a", "b", seq_after(F.col("a") % 65536, F.col("b") % 65536).alias("later"))


@query(f"""with {cte('nal')} select camera, seq, case when nal_type = 5 then 1 when nal_type in (7, 8) then 2 else 0 end as flags from nal""")
def nal_classification(spark, d):
    from camloom.functions.bitstream import nal_flags, nal_type

    kind = nal_type(F.col("nal_type") + 96, F.lit("h264"))
    return view(spark, d, "nal").select("camera", "seq", nal_flags(kind, F.lit("h264")).alias("flags"))


# ---------------------------------------------------------------- further operators


@query(_VERDICTS + " select time_bucket(interval 1 hour, ts) as window_start, camera, case when decided_by = 'passthrough' then 'confirmed' else 'suppressed' end as verdict, count(*) as n from v group by all")
def verdict_rates(spark, d):
    out = ST.event_rate(verdicts(spark, d), 60, by=("camera", "verdict"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "camera", "verdict", "n")


@query(_VERDICTS + " select event_id, case when bytes % 7 = 3 then 'deadline' else decided_by end as decided_by, case when bytes % 7 = 3 or decided_by = 'passthrough' then 'confirmed' else 'suppressed' end as verdict from v")
def deadline_verdicts(spark, d):
    out = R.deadline(verdicts(spark, d), F.when(F.col("bytes") % 7 == 3, 6000).otherwise(10))
    return out.select("event_id", "decided_by", "verdict")


@query(f"""with {cte('raw_events')}, s as (select camera as host, ts, event_id, row_number() over w as total, sum(bytes % 2) over w as idle from raw_events window w as (partition by camera order by ts, event_id)),
k as (select host, ts, total - lag(total) over w as t, idle - lag(idle) over w as i from (select host, ts, max(total) * 10 as total, cast(max(idle) as bigint) * 7 as idle from s group by host, ts) window w as (partition by host order by ts))
select host, ts, case when t > 0 then round((t - i) / t * 1000) / 10 end as cpu_percent from k""")
def cpu_samples(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("camera").orderBy("ts", "event_id")
    rows = view(spark, d, "raw_events").select(F.col("camera").alias("host"), "ts", F.row_number().over(w).alias("total"), F.sum(F.col("bytes") % 2).over(w).alias("idle"))
    return ST.cpu_percent(rows.groupBy("host", "ts").agg((F.max("total") * 10).alias("total"), (F.max("idle") * 7).alias("idle")))


@query("""select l_orderkey as event_id, l_partkey as blob_id, size, rank from (select l_orderkey, l_partkey, cast(l_quantity as bigint) as size, row_number() over (partition by l_orderkey order by cast(l_quantity as bigint) desc, l_partkey) as rank
from (select distinct l_orderkey, l_partkey, l_quantity from lineitem)) where rank <= 3""")
def top_blobs(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_quantity").distinct()
    out = ST.top_per_event(rows.select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("blob_id"), F.col("l_quantity").cast("long").alias("size")), 3)
    return out.select("event_id", "blob_id", "size", F.col("rank").cast("long").alias("rank"))


@query("""select l_suppkey % 16 as camera, l_orderkey as seq, count(*) as n_blocks, round(avg((l_returnflag = 'N')::int), 6) as skip_share, round(quantile_cont(l_quantity, 5e-1), 6) as motion_median, round(quantile_cont(l_quantity, 9e-1), 6) as motion_p90,
round(avg(l_linenumber), 6) as qp_mean from lineitem group by 1, 2""")
def macroblock_stats(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(
        (F.col("l_suppkey") % 16).alias("camera"), F.col("l_orderkey").alias("seq"), (F.col("l_returnflag") == "N").alias("skipped"), (F.col("l_returnflag") == "A").alias("intra"), F.col("l_quantity").alias("motion"), F.col("l_linenumber").alias("qp")
    )
    out = ST.macroblock_stats(rows)
    return out.select("camera", "seq", "n_blocks", *(F.round(c, 6).alias(c) for c in ("skip_share", "motion_median", "motion_p90", "qp_mean")))


@query(f"""with {_LABELLED}, {cte('camera_config')}
select camera, label_value, count(*) as n from (select camera, label_value from ev union all select camera, 1 from camera_config, range(5) where camera < 'cam-04') group by all""")
def synthetic_positives(spark, d):
    slow = view(spark, d, "camera_config").where("camera < 'cam-04'")
    return T.with_synthetic(labelled_events(spark, d), slow).groupBy("camera", "label_value").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {cte('nal')} select camera, nal_type, max(seq) as seq, arg_max(length, seq) as length from nal where (flags & 2) > 0 group by all")
def parameter_sets(spark, d):
    from camloom.functions.bitstream import latest_parameter_sets

    return latest_parameter_sets(view(spark, d, "nal").where(O.flag(O.PARAMSET)).select("camera", "nal_type", "seq", "length"), "nal_type").select("camera", "nal_type", "seq", "length")


@query(f"with {cte('raw_events')} select camera, round(greatest(8e0, max(z_score) * 105e-2), 6) as top from raw_events group by camera")
def chart_scales(spark, d):
    return view(spark, d, "raw_events").groupBy("camera").agg(F.round(ST.chart_scale(F.col("z_score")), 6).alias("top"))


@query(f"with {cte('raw_events')} select min(event_id) as event_id, camera, date_trunc('day', ts) as day, row_number() over (partition by camera order by date_trunc('day', ts) desc) as rank from raw_events group by camera, date_trunc('day', ts) qualify rank <= 20")
def config_history(spark, d):
    from camloom.sources.eventlog import latest_configs

    runs = view(spark, d, "raw_events").groupBy("camera", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("applied_at")).agg(F.min("event_id").alias("run_id"))
    return latest_configs(runs, 20).select(F.col("run_id").alias("event_id"), "camera", F.col("applied_at").alias("day"), F.col("rank").cast("long").alias("rank"))


@query(_VERDICTS + """ select event_id, case when bpf_slow > 0 and bytes < 12e-1 * bpf_slow then 'bytes ' || bytes || ' < ' || printf('%.0f', 12e-1 * bpf_slow) || ' (1.2x bpf_slow)' else 'bytes ' || bytes || ' < min 800' end as suppress_reason
from v where decided_by = 'bytes_floor'""")
def suppress_reasons(spark, d):
    return verdicts(spark, d).where("decided_by = 'bytes_floor'").select("event_id", "suppress_reason")


@query("""select l_orderkey * 10 + l_linenumber as k, case when a < 3600 then a // 60 || 'm ago' when a < 86400 then a // 3600 || 'h ago' else a // 86400 || 'd ago' end as age, case when p < 70 then 'ok' when p < 85 then 'warn' else 'crit' end as band,
  p, case l_linenumber when 1 then 'motion' when 2 then 'scene_change' when 3 then 'idr_burst' else 'none' end as kind, case l_linenumber when 2 then 'h265' when 1 then 'h264' else 'unknown' end as codec
from (select *, l_partkey * l_suppkey % 400000 as a, case when l_suppkey % 7 = 0 then 0e0 else round(l_linenumber / (l_suppkey % 7 + 7) * 1000) / 10 end as p from lineitem)""")
def dashboard_texts(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    n, p = F.col("l_linenumber"), S.percent(F.col("l_linenumber"), F.when(F.col("l_suppkey") % 7 == 0, 0).otherwise(F.col("l_suppkey") % 7 + 7))
    return rows.select(
        (F.col("l_orderkey") * 10 + n).alias("k"), S.age_text(F.col("l_partkey") * F.col("l_suppkey") % 400000).alias("age"), S.percent_band(p).alias("band"), p.alias("p"), S.event_type(n).alias("kind"), S.codec(n, strict=True).alias("codec")
    )


@query(f"""with {cte('raw_events')} select event_id, 'clips/' || site || '/' || camera || '/' || strftime(ts, '%Y%m%dT%H%M%SZ') || '.ts' as key, camera || '_' || strftime(ts, '%Y%m%d_%H%M%S') || '_' || substr(event_id, 1, 8) || '.mp4' as filename,
  date_trunc('second', ts) as filename_time from raw_events""")
def clip_names(spark, d):
    events, ts = view(spark, d, "raw_events"), F.col("ts").cast("timestamp_ntz")
    name = S.clip_filename(F.col("camera"), ts, F.col("event_id"), F.lit("mp4"))
    return events.select("event_id", S.object_key("clips/", F.col("site"), F.col("camera"), ts).alias("key"), name.alias("filename"), S.clip_filename_time(name).cast("timestamp_ntz").alias("filename_time"))


@query("""select p_partkey as k, cast(floor(w * h * 15 * 7e-2) as bigint) as bitrate, cast(greatest(10, floor(p_size * 15e-1)) as bigint) as off_frames, cast(pow(2, ceil(log2(greatest(1e0, p_size * 1000e0 * w / 8 * 5 / 4)))) as bigint) as ring
from (select *, 160 + p_size * 16 as w, 120 + p_size * 12 as h from part)""")
def camera_sizing(spark, d):
    w, h, fps = 160 + F.col("p_size") * 16, 120 + F.col("p_size") * 12, F.col("p_size")
    out = spark.read.parquet(f"{d}/part.parquet")
    return out.select(F.col("p_partkey").alias("k"), S.bitrate(w, h, F.lit(None).cast("int")).cast("long").alias("bitrate"), S.off_threshold(fps).cast("long").alias("off_frames"), S.ring_bytes(fps, w * 1000).alias("ring"))


@query(f"with {cte('raw_events')} select distinct camera, cast(ts as date) as date from raw_events where cast(ts as date) < (select cast(max(ts) as date) - 7 from raw_events)")
def expired_log_partitions(spark, d):
    from camloom.sources.eventlog import expired_partitions

    events = view(spark, d, "raw_events")
    return expired_partitions(events.withColumn("date", F.to_date("ts")), last_ts(events), 7)


@query(f"""with {cte('raw_events')}, b as (select max(ts) as now from raw_events) select event_id, camera, site, z_score, bytes, reason from raw_events, b where ts >= date_trunc('day', now) - interval 3 day""")
def event_log_readback(spark, d):
    """All events written to a log by camera and day, and the last days read back from its folders."""
    from camloom.sources.eventlog import append_log, log_range
    from camloom.sources.shared import shared_folder

    events, root = view(spark, d, "raw_events"), shared_folder(spark, "log")
    start = events.agg(F.max("ts")).first()[0].date()
    append_log(events.withColumn("ts", F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())), root)
    import datetime

    return log_range(spark, root, str(start - datetime.timedelta(days=3)), limit=-1).select("event_id", "camera", "site", "z_score", "bytes", "reason")


@query(f"""with {cte('nal')} select camera, seq, case when nal_type = 5 then 1 when nal_type in (7, 8) then 2 when nal_type = 1 and length % 10 % 5 = 1 then 8 else 0 end as h264, case when length % 10 = 0 then 8 else 0 end as h265 from nal""")
def slice_flags(spark, d):
    from camloom.functions.bitstream import nal_flags

    kind, of_slice = F.col("nal_type").cast("int"), F.col("length") % 10
    return view(spark, d, "nal").select("camera", "seq", nal_flags(kind, F.lit("h264"), of_slice).alias("h264"), nal_flags(kind, F.lit("h265"), of_slice).alias("h265"))


@query("""select l_orderkey * 10 + l_linenumber as k, l_linenumber % 2 = 1 as marker, cast(l_suppkey % 128 as int) as payload_type, cast(l_orderkey % 65536 as int) as seq, cast(l_partkey * 3003 % 4294967296 as bigint) as timestamp, l_suppkey as ssrc,
  12 + 4 * (l_linenumber % 3) as payload_start, lpad(printf('%x', l_orderkey), 16, '0') as payload from lineitem""")
def rtp_packets(spark, d):
    """Packets made of the columns, and what their headers say."""
    from camloom.functions.bitstream import rtp_header, rtp_payload

    hexed = lambda c, n: F.lpad(F.hex(c.cast("long")), n, "0")
    n, key = F.col("l_linenumber"), F.col("l_orderkey")
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select((key * 10 + n).alias("k"), F.unhex(F.concat(
        hexed(128 + n % 3, 2), hexed(n % 2 * 128 + F.col("l_suppkey") % 128, 2), hexed(key % 65536, 4), hexed(F.col("l_partkey") * 3003 % 4294967296, 8), hexed(F.col("l_suppkey"), 8),
        F.expr("repeat('0badcafe', cast(l_linenumber % 3 as int))"), hexed(key, 16),
    )).alias("packet"))
    h = rtp_header(F.col("packet"))
    out = rows.withColumn("h", h).select("k", "h.marker", "h.payload_type", "h.seq", "h.timestamp", "h.ssrc", "h.payload_start", F.lower(F.hex(rtp_payload(F.col("packet")))).alias("payload"))
    return out.withColumn("payload_start", F.col("payload_start").cast("long"))


@query("""select l_orderkey as k, l_linenumber as n, case when l_partkey > l_suppkey then (l_partkey - l_suppkey) * 1000 // 90 else 0 end as duration_ms,
  case when t > 0 and t >= l_suppkey * 1000 and (t - l_suppkey * 1000) // 90 > 0 then (t - l_suppkey * 1000) // 90 else 6000 end as trigger_offset_ms from (select *, l_linenumber * 9000 as t from lineitem)""")
def clip_offsets(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    times = O.clip_times(F.col("l_suppkey") * 1000, F.col("l_partkey") * 1000, F.col("l_linenumber") * 9000, F.lit(6))
    return rows.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), times.alias("t")).select("k", "n", "t.*")


# ---------------------------------------------------------------- streams, run to the end of what is there


def _events_stream(spark, d):  # noqa: ANN202
    """Raw events of the events table as a stream: the adapter's row-wise expressions, with a time that watermarks take."""
    from camloom.sources.adapters import ADAPTERS
    from camloom.sources.shared import stream_table

    rows = spark.sql(ADAPTERS["raw_events"], events=stream_table(spark, d, "events"))
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query(ORACLES["postproc_verdicts"])
def stream_verdicts(spark, d):
    from camloom.sources.shared import drained
    from camloom.streaming.streams import routed_stream

    stages = [R.idr_burst(2.0), R.bytes_floor(1.2, 800), R.intra_ratio(2.5, 3.5), R.pass_through()]
    return drained(routed_stream(_events_stream(spark, d), stages).select("event_id", "decided_by", "verdict"))


@query(f"{_FOLD} select fold.camera, src_id, fold.byte_count, round(z_score, 6) as z_score from fold join frames f on f.camera = fold.camera and f.seq = fold.seq where event")
def stream_detector(spark, d):
    from camloom.sources.shared import drained, stream_table
    from camloom.streaming.streams import detector_stream

    raw = stream_table(spark, d, "events")
    frames = raw.select(
        F.concat(F.lit("cam-"), F.lpad((F.col("user_id") % 16).cast("string"), 2, "0")).alias("camera"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("src_id"),
        F.round(F.col("value") * 100).cast("long").alias("byte_count"), (F.col("event_type") == "signup").alias("is_keyframe"),
    )
    return drained(detector_stream(frames, FLAGSHIP).select("camera", "src_id", "byte_count", F.round("z_score", 6).alias("z_score")))


@query("select lpad(cast(event_id as varchar), 26, '0') as event_id from events")
def stream_deduplicated(spark, d):
    from camloom.sources.shared import drained
    from camloom.streaming.streams import deduplicated

    stream = _events_stream(spark, d)
    return drained(deduplicated(stream.unionByName(_events_stream(spark, d))).select("event_id"))


@query(ORACLES["event_rate_5m"].replace(", round(count(*) / 300e0, 6) as rate", ""))
def stream_rates(spark, d):
    from camloom.sources.shared import drained
    from camloom.streaming.streams import rates

    out = drained(rates(_events_stream(spark, d)), "complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "camera", "n")


@query(f"""with {cte('raw_events')}, s as (select *, case when date_diff('microsecond', lag(ts) over w, ts) <= 300000000 then 0 else 1 end as fresh from raw_events where type = 'motion' window w as (partition by camera order by ts, event_id)),
n as (select *, sum(fresh) over (partition by camera order by ts, event_id) as session from s)
select camera, min(ts) as first_ts, max(ts) as last_ts, count(*) as n from n group by camera, session having max(ts) + interval 15 minutes <= (select max(ts) from raw_events where type = 'motion')""")
def stream_sessions(spark, d):
    """Sessions that the watermark has closed: five minutes after their last event, ten before the newest."""
    from camloom.sources.shared import drained
    from camloom.streaming.streams import sessions

    out = drained(sessions(_events_stream(spark, d).where("type = 'motion'"), "5 minutes"))
    return out.select("camera", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_ts", "last_ts")), "n")


_WIDE = 360 * 60_000


@query(f"""with {cte('raw_events')}, c as (select camera, epoch_ms(ts) - epoch_ms(ts) % {_WIDE} as w, count(*) as n from raw_events group by 1, 2),
l as (select *, lag(w) over k as pw, lag(n) over k as pn, lead(w) over k as nw, (select max(epoch_ms(ts)) - 300000 from raw_events) as mark from c window k as (partition by camera order by w))
select camera, make_timestamp(w * 1000) as window_start, n, pn as before, 'spike' as alarm from l where pw = w - {_WIDE} and n >= 3 * pn and w + {_WIDE} <= mark
union all select camera, make_timestamp((w + {_WIDE}) * 1000), 0, n, 'silent' from l where (nw is null or nw > w + {_WIDE}) and w + 2 * {_WIDE} <= mark""")
def stream_spikes(spark, d):
    from camloom.sources.shared import drained
    from camloom.streaming.streams import spikes

    out = drained(spikes(_events_stream(spark, d), window_minutes=360))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


from camloom.plans import fleet_queries, reader_queries  # noqa: E402, F401  (they take labelled events from here)
