"""Structured Streaming twins: the detector with state, routing, duplicates, rates, sessions, canaries.

Batches are unordered inside a key, so the detector sorts each camera's rows by (ts, event_id); a row at or before the last
one processed is late and is counted, not folded.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from camloom.operators.detector import DDL, NAMES, Config, State
from camloom.operators.recurrence import advanced
from camloom.operators.rules import Stage, cascade
from camloom.sources.sinks import write_verdicts

FIELDS = list(State.__dataclass_fields__)
STATE_DDL = "ewma double, slow double, vslow double, var double, since_kf long, above long, below long, fsm long, gradual long, frames long, last_ts long, last_id long, late long"
OUT_DDL = f"camera string, src_id long, byte_count long, is_keyframe boolean, {DDL}, late long"


def detector_stream(frames: DataFrame, config: Config = Config()) -> DataFrame:
    """(camera, ts timestamp, src_id, byte_count, is_keyframe) -> a row for each event, with late: rows of the camera so far that
    came too late. State is one fixed-size record a camera."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        values = held.get if held.exists else None
        s = State(*values[: len(FIELDS)]) if values else State()
        last_ts, last_id, late = values[len(FIELDS) :] if values else (-(1 << 62), -(1 << 62), 0)
        rows = pd.concat(list(parts), ignore_index=True)
        rows["us"] = rows["ts"].astype("datetime64[us]").astype("int64")
        rows = rows.sort_values(["us", "src_id"], ignore_index=True)
        us, ids = rows["us"].to_numpy(), rows["src_id"].to_numpy()
        # A row at or before the one processed last is late, as is one that repeats the row before it.
        again = np.concatenate([[False], (us[1:] == us[:-1]) & (ids[1:] == ids[:-1])])
        is_late = again | (us < last_ts) | ((us == last_ts) & (ids <= last_id))
        missed = late + np.cumsum(is_late)[~is_late]
        late, rows = late + int(is_late.sum()), rows[~is_late]
        out = None
        if len(rows):
            last_ts, last_id = int(us[~is_late][-1]), int(ids[~is_late][-1])
            made = advanced(s, rows["byte_count"].to_numpy(float), rows["is_keyframe"].to_numpy(bool), None, config)
            at = sorted(made.events)
            values = [[made.events[k] for k in at], made.z_score[at], made.intra_ratio[at], [made.reasons[k] for k in at], *(v[at] for v in (made.fsm_before, made.fsm_after, made.since_kf, made.bpf_ewma, made.bpf_slow, made.bpf_var))]
            out = rows.iloc[at][["src_id", "byte_count", "is_keyframe"]].assign(camera=key[0], late=missed[at], **dict(zip(NAMES, values, strict=True)))
        held.update((*(getattr(s, f) for f in FIELDS), int(last_ts), int(last_id), int(late)))
        if out is not None and len(out):
            yield out[[f.strip().split()[0] for f in OUT_DDL.split(",")]]

    rows = frames.select("camera", "ts", "src_id", "byte_count", "is_keyframe")
    return rows.groupBy("camera").applyInPandasWithState(run, OUT_DDL, STATE_DDL, "append", GroupStateTimeout.NoTimeout)


def deduplicated(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each event id once within the delay: publishers repeat what was not acknowledged."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def routed_stream(events: DataFrame, stages: list[Stage]) -> DataFrame:
    return cascade(events, stages)


def start_router(events: DataFrame, stages: list[Stage], root: str, checkpoint: str, **trigger) -> object:  # noqa: ANN003
    """Confirmed and suppressed events to one table; a batch that is run again replaces what it wrote."""
    query = cascade(events, stages).writeStream.foreachBatch(lambda df, batch: write_verdicts(df, root, batch)).option("checkpointLocation", checkpoint)
    return query.trigger(**(trigger or {"availableNow": True})).start()


def rates(events: DataFrame, window: str = "5 minutes", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    out = events.withWatermark("ts", delay).groupBy(w.alias("w"), "camera").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("window_start"), "camera", "n")


def sessions(events: DataFrame, gap: str, delay: str = "10 minutes") -> DataFrame:
    out = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "camera").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))
    return out.select("camera", F.col("w.start").alias("first_ts"), "last_ts", "n")


def spikes(events: DataFrame, factor: float = 3.0, window_minutes: int = 2, delay: str = "5 minutes") -> DataFrame:
    """camera, window_start, n, before, alarm: a window with factor times the events of the one before, or none after some.

    State is the counts of a camera's open windows, and the last one closed. A window is closed when the watermark is past its end, and
    only then compared, so the order in which rows come, and how they are cut into parts and batches, changes nothing. Rows that come
    after that are late and dropped. A timer in event time closes windows in which nothing comes. Null times are dropped.
    """
    size = window_minutes * 60_000

    def run(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        starts, counts, last, before = held.get if held.exists else ([], [], -1, 0)
        windows = Counter(dict(zip(starts, counts, strict=True)))
        now = held.getCurrentWatermarkMs()
        for part in parts:
            ms = part["ts"].dropna().astype("datetime64[ms]").astype("int64")
            for start, n in (ms - ms % size).value_counts().items():
                if start + size > now:
                    windows[int(start)] += int(n)
        out = []
        for start in sorted(w for w in windows if w + size <= now):
            n = windows.pop(start)
            if last >= 0 and start > last + size:
                out.append((key[0], pd.Timestamp(last + size, unit="ms"), 0, before, "silent"))
            elif last >= 0 and n >= factor * before:
                out.append((key[0], pd.Timestamp(start, unit="ms"), n, before, "spike"))
            last, before = start, n
        if last >= 0 and last + 2 * size <= now:  # the window after it is closed as well, and none came
            out.append((key[0], pd.Timestamp(last + size, unit="ms"), 0, before, "silent"))
            last = -1
        if not windows and last < 0:
            held.remove()
        else:
            held.update((list(windows), list(windows.values()), last, before))
            ends = [w + size for w in windows] + ([last + 2 * size] if last >= 0 else [])
            held.setTimeoutTimestamp(max(min(ends), now + 1))
        if out:
            yield pd.DataFrame(out, columns=["camera", "window_start", "n", "before", "alarm"])

    marked = events.withWatermark("ts", delay).select("camera", "ts")
    return marked.groupBy("camera").applyInPandasWithState(
        run, "camera string, window_start timestamp, n long, before long, alarm string", "starts array<long>, counts array<long>, last long, before long", "append", GroupStateTimeout.EventTimeTimeout
    )


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drives a stream over what is there into an in-memory table: for tests and one-off batch twins."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
