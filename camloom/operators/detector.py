"""The motion detector: per camera, an order-dependent fold over access units.

State per camera: fast, slow and very slow exponentially weighted means of bytes per frame, a variance around the slow one,
frames since the last keyframe, and a debounce machine (idle, active, cooldown). In batch, frames are partitioned by camera
and sorted; one pass folds each partition with memory for one state, whatever the length of a camera's series. Batches of frames
are folded as arrays (``recurrence``); ``step`` says what happens at one frame.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHA_FAST, ALPHA_SLOW, ALPHA_VSLOW = 0.2, 0.005, 0.0005
IDLE, ACTIVE, COOLDOWN = 0, 1, 2
#: Frames since the keyframe while none was seen.
UNKNOWN = 4294967295


@dataclass(frozen=True)
class Config:
    """Thresholds of one camera. extended gates (off by default) also hold back frames small against the slow mean, and ask
    for more while the first frames warm up."""

    motion_z_high: float = 3.0
    intra_ratio_high: float = 2.5
    on_threshold: int = 2
    off_threshold: int = 45
    bpf_floor: float = 100.0
    min_bytes_threshold: int = 0
    configured_periodic_kf: bool = False
    gradual_enabled: bool = False
    gradual_threshold: float = 0.4
    gradual_window_frames: int = 900
    strict_idr: bool = False
    bpf_relative_floor: float = 0.0
    z_high_warmup: float = 0.0
    z_high_warmup_frames: int = 0
    extended_gates: bool = False


@dataclass
class State:
    ewma: float = 0.0
    slow: float = 0.0
    vslow: float = 0.0
    var: float = 0.0
    since_kf: int = UNKNOWN
    above: int = 0
    below: int = 0
    fsm: int = IDLE
    gradual: int = 0
    frames: int = 0


NAMES = ["event", "z_score", "intra_ratio", "reason", "fsm_before", "fsm_after", "since_kf", "bpf_ewma", "bpf_slow", "bpf_var"]
DDL = "event string, z_score double, intra_ratio double, reason string, fsm_before smallint, fsm_after smallint, since_kf long, bpf_ewma double, bpf_slow double, bpf_var double"


def step(s: State, size: int, keyframe: bool, intra: float | None, c: Config) -> tuple:
    """Advances s by one access unit; the values of NAMES. intra: an explicit ratio, else bytes over the slow mean before."""
    x = float(size)
    if intra is None:
        intra = x / (s.slow if s.slow > 0 else 100.0)
    s.frames += 1
    if not keyframe:
        if s.slow == 0.0:
            s.ewma = s.slow = s.vslow = x
            s.var = x * 0.01
        else:
            s.slow = ALPHA_SLOW * x + (1.0 - ALPHA_SLOW) * s.slow
            s.vslow = ALPHA_VSLOW * x + (1.0 - ALPHA_VSLOW) * s.vslow
    s.ewma = x if s.ewma == 0.0 else ALPHA_FAST * x + (1.0 - ALPHA_FAST) * s.ewma
    before_kf, before = s.since_kf, s.fsm
    if keyframe:
        s.since_kf = 0
    elif s.since_kf != UNKNOWN:
        s.since_kf += 1
    if s.slow == 0.0:
        return None, 0.0, 0.0, "", before, before, s.since_kf, s.ewma, s.slow, s.var
    z = 0.0
    if not keyframe:
        d = x - s.slow
        s.var = (1.0 - ALPHA_SLOW) * (s.var + ALPHA_SLOW * d * d)
        z = d / max(math.sqrt(s.var), c.bpf_floor)
    enough = c.min_bytes_threshold == 0 or size >= c.min_bytes_threshold
    z_high = c.motion_z_high
    if c.extended_gates:
        enough = enough and not (c.bpf_relative_floor > 0 and x < c.bpf_relative_floor * s.slow)
        z_high = max(z_high, c.z_high_warmup) if s.frames <= c.z_high_warmup_frames else z_high
    z_signal = enough and not keyframe and z > z_high
    intra_signal = enough and not keyframe and intra > c.intra_ratio_high
    idr_signal = keyframe and not c.configured_periodic_kf and (before_kf == 0 or c.strict_idr)
    signal, event, reason = z_signal or intra_signal or idr_signal, None, "none"
    if signal:
        parts = [f"z={z:.2f}" if z_signal else "", f"intra_ratio={intra:.2f}" if intra_signal else "", "unexpected_idr" if idr_signal else ""]
        reason = ",".join(filter(None, parts))
    if s.fsm == IDLE:
        s.above = s.above + 1 if signal else 0
        if signal:
            s.below = 0
            if s.above >= c.on_threshold:
                s.fsm, s.above, event = ACTIVE, 0, "motion"
    elif s.fsm == ACTIVE:
        if signal:
            s.below, s.above = 0, (s.above + 1) % 256
        else:
            s.below, s.above = s.below + 1, 0
            if s.below >= c.off_threshold:
                s.fsm, s.below = COOLDOWN, 0
    else:
        s.fsm, s.above, s.below = IDLE, 0, 0
    if event is None and c.gradual_enabled and s.vslow > 0.0:
        diverge = abs(s.slow - s.vslow) / s.vslow
        if diverge > c.gradual_threshold:
            s.gradual += 1
            if s.gradual >= c.gradual_window_frames:
                event, reason, s.gradual = "scene_change", f"gradual:diverge={diverge:.3f}", 0
        elif s.gradual:
            s.gradual -= 1
    return event, z, intra, reason, before, s.fsm, s.since_kf, s.ewma, s.slow, s.var


def fold(frames: list[tuple], c: Config, s: State | None = None) -> list[tuple]:
    """(bytes, keyframe, intra or None) -> the values of NAMES for each; for tests and streams."""
    s = State() if s is None else s
    return [step(s, *f, c) for f in frames]


CONFIG_COLUMNS = ["motion_z_high", "intra_ratio_high", "on_threshold", "off_threshold", "bpf_floor", "min_bytes_threshold"]


def signals(frames: DataFrame, config: Config = Config(), configs: DataFrame | None = None, events_only: bool = False, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """camera, seq, byte_count, is_keyframe and the detector's values for each frame, or for those with an event.

    configs: (camera, ...) with any of the detector's thresholds; cameras without a row take ``config``. A column
    ``intra_ratio_proxy`` in frames is an explicit ratio. Order: (camera, *order); frames without seq are numbered from 1 along it,
    in the fold itself. Null sizes count as 0, null flags as no keyframe.
    """
    given = "intra_ratio_proxy" in frames.columns
    named = [c for c in Config.__dataclass_fields__ if configs is not None and c in configs.columns]
    rows = frames.join(configs.select("camera", *named), "camera", "left") if configs is not None else frames
    intra = [F.col("intra_ratio_proxy").cast("double").alias("intra")] if given else []
    has_seq = "seq" in frames.columns
    seq = F.col("seq") if has_seq else F.lit(0).cast("long").alias("seq")
    more = [c for c in order if c != "seq"]
    rows = rows.select("camera", seq, "byte_count", "is_keyframe", *intra, *named, *more)
    placed = rows.repartition("camera").sortWithinPartitions("camera", *order).drop(*more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from camloom.operators.recurrence import advanced

        now, s, c = None, None, config
        for b in batches:
            cameras = b.column(0)
            changes = pc.fill_null(pc.not_equal(cameras[1:], cameras[:-1]), True).to_numpy(zero_copy_only=False) if b.num_rows > 1 else np.zeros(0, bool)
            edges = [0, *(np.flatnonzero(changes) + 1).tolist(), b.num_rows]
            size = b.column(2).cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
            keyframe = b.column(3).fill_null(False).to_numpy(zero_copy_only=False)
            intra = b.column(4).cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False) if given else None
            for at, end in zip(edges[:-1], edges[1:], strict=True):
                camera = cameras[at].as_py()
                if s is None or camera != now:
                    now, s = camera, State()
                    own = {k: b.column(4 + given + i)[at].as_py() for i, k in enumerate(named)}
                    c = replace(config, **{k: v for k, v in own.items() if v is not None}) if named else config
                part, before = slice(at, end), s.frames
                made = advanced(s, size[part], keyframe[part], None if intra is None else intra[part], c)
                keep = sorted(made.events) if events_only else range(end - at)
                if not len(keep):
                    continue
                head = pa.record_batch(b.columns[:4], names=["camera", "seq", "byte_count", "is_keyframe"]).slice(at, end - at)
                if not has_seq:
                    head = head.set_column(1, "seq", pa.array(np.arange(before + 1, s.frames + 1)))
                if events_only:
                    head = head.take(pa.array(keep))
                of = lambda values, kind: pa.array(values[keep] if events_only else values, kind)  # noqa: B023, E731
                columns = [
                    pa.array([made.events.get(k) for k in keep], pa.string()), of(made.z_score, pa.float64()), of(made.intra_ratio, pa.float64()), pa.array([made.reasons.get(k, "none") for k in keep], pa.string()),
                    of(made.fsm_before, pa.int16()), of(made.fsm_after, pa.int16()), of(made.since_kf, pa.int64()), *(of(x, pa.float64()) for x in (made.bpf_ewma, made.bpf_slow, made.bpf_var)),
                ]
                yield pa.RecordBatch.from_arrays([*head.columns, *columns], names=[*head.schema.names, *NAMES])

    kinds = dict(rows.dtypes)
    return placed.mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in ("camera", "seq", "byte_count", "is_keyframe")) + ", " + DDL)


def ewma(frames: DataFrame, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Frames and the fast mean after the last one, per camera."""
    return signals(frames, order=order).groupBy("camera").agg(F.count(F.lit(1)).alias("n"), F.max_by("bpf_ewma", "seq").alias("bpf_ewma"))


def would_fire(z: Column, min_bytes: Column, floor: Column) -> Column:
    """The tuner's simplified rule, with >= where the detector has >."""
    small = (min_bytes > 0) & (F.col("bytes") < min_bytes)
    low = (floor > 0) & (F.col("bpf_slow") > 0) & (F.col("bytes") < floor * F.col("bpf_slow"))
    return ~small & ~low & (F.col("z_score") >= z)


#: The same fold as a recursive query, a step for each frame of all cameras at once.
FOLD_SQL = """
fold as (
  select camera, cast(0 as bigint) as seq, cast(0 as bigint) as byte_count, false as is_keyframe, 0e0 as ewma, 0e0 as slow, 0e0 as var, cast(4294967295 as bigint) as since_kf,
         0 as above, 0 as below, 0 as fsm, 0 as fsm_before, 0e0 as z_score, 0e0 as intra_ratio, false as event, 0e0 as vslow, 0 as gradual, false as scene, 0e0 as diverge
  from (select distinct camera from frames)
  union all
  select camera, seq, byte_count, is_keyframe, ewma, slow, var, since_kf,
         case when quiet then p_above when p_fsm = 0 then case when not signal then 0 when p_above + 1 >= {on} then 0 else p_above + 1 end
              when p_fsm = 1 then case when signal then p_above + 1 else 0 end else 0 end as above,
         case when quiet then p_below when p_fsm = 0 then case when signal then 0 else p_below end
              when p_fsm = 1 then case when signal or p_below + 1 >= {off} then 0 else p_below + 1 end else 0 end as below,
         case when quiet then p_fsm when p_fsm = 0 then case when signal and p_above + 1 >= {on} then 1 else 0 end
              when p_fsm = 1 then case when not signal and p_below + 1 >= {off} then 2 else 1 end else 0 end as fsm,
         p_fsm as fsm_before, z_score, case when quiet then 0e0 else intra end as intra_ratio, not quiet and p_fsm = 0 and signal and p_above + 1 >= {on} as event,
         vslow, case when quiet or (p_fsm = 0 and signal and p_above + 1 >= {on}) then p_gradual when diverge <= {apart} then greatest(p_gradual - 1, 0) when p_gradual + 1 >= {frames} then 0 else p_gradual + 1 end as gradual,
         not quiet and not (p_fsm = 0 and signal and p_above + 1 >= {on}) and diverge > {apart} and p_gradual + 1 >= {frames} as scene, diverge
  from (select *, not quiet and ((ok and not is_keyframe and (z_score > {z} or intra > {intra})) or (is_keyframe and p_since = 0)) as signal
    from (select *, case when quiet or is_keyframe then 0e0 else (x - slow) / greatest(sqrt(var), {floor}) end as z_score, {min_bytes} = 0 or byte_count >= {min_bytes} as ok,
                 case when quiet then 0e0 else abs(slow - vslow) / vslow end as diverge
      from (select *, case when is_keyframe then p_var when p_slow = 0 then (1e0 - 5e-3) * (x * 1e-2 + 5e-3 * (x - slow) * (x - slow)) else (1e0 - 5e-3) * (p_var + 5e-3 * (x - slow) * (x - slow)) end as var,
                   slow = 0 as quiet
        from (select f.camera, f.seq, f.byte_count, f.is_keyframe, cast(f.byte_count as double) as x, p.slow as p_slow, p.var as p_var, p.since_kf as p_since, p.above as p_above, p.below as p_below, p.fsm as p_fsm, p.gradual as p_gradual{more},
                     cast(f.byte_count as double) / case when p.slow > 0 then p.slow else 1e2 end as intra,
                     case when f.is_keyframe then p.slow when p.slow = 0 then cast(f.byte_count as double) else 5e-3 * f.byte_count + (1e0 - 5e-3) * p.slow end as slow,
                     case when f.is_keyframe then p.vslow when p.slow = 0 then cast(f.byte_count as double) else 5e-4 * f.byte_count + (1e0 - 5e-4) * p.vslow end as vslow,
                     case when p.ewma = 0 and (f.is_keyframe or p.slow > 0) then cast(f.byte_count as double)
                          when not f.is_keyframe and p.slow = 0 then 2e-1 * f.byte_count + (1e0 - 2e-1) * f.byte_count
                          else 2e-1 * f.byte_count + (1e0 - 2e-1) * p.ewma end as ewma,
                     case when f.is_keyframe then 0 when p.since_kf = 4294967295 then p.since_kf else p.since_kf + 1 end as since_kf
              from fold p join frames f on f.camera = p.camera and f.seq = p.seq + 1)))))"""


def fold_sql(c: Config, more: dict[str, str] | None = None) -> str:
    """The fold under one configuration; more: thresholds (names of FOLD_SQL) that are columns of frames instead."""
    apart = f"{c.gradual_threshold}e0" if c.gradual_enabled else "1e300"
    values = {"on": c.on_threshold, "off": c.off_threshold, "z": f"{c.motion_z_high}e0", "intra": f"{c.intra_ratio_high}e0", "floor": f"{c.bpf_floor}e0", "min_bytes": c.min_bytes_threshold, "apart": apart, "frames": c.gradual_window_frames}
    return FOLD_SQL.format(**(values | (more or {})), more="".join(f", f.{column}" for column in (more or {}).values()))
