"""Packets of a live stream in sequence: a window of 32 numbers that wait for what is missing, as state of Structured Streaming.

Each camera holds which number is due, and a map of the packets that wait. A packet that is due goes out, with those that wait
behind it; one fewer than the window ahead waits; an older one is discarded; one farther ahead sends out all that wait, then
itself, and ``lost`` counts the numbers up to it. Where ``patience_ms`` is given, a timer in processing time sends out what waits that long
without anything coming, so that the last packets before a pause are not held until it ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WINDOW = 32
OUT = "camera string, arrival long, seq long, place long, lost long"


class Receiver(StatefulProcessor):
    def __init__(self, window: int = WINDOW, patience_ms: int | None = None) -> None:
        self.window, self.patience = window, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "due long, place long")
        self.waiting = handle.getMapState("waiting", "seq long", "arrival long")

    def _sent(self, key: tuple, due: int, place: int, ready: list[tuple[int, int, int]]) -> pd.DataFrame:
        """ready: (seq, arrival, lost) in order; numbers them and keeps what is due."""
        self.at.update((due, place + len(ready)))
        rows = [(key[0], arrival, seq, place + k, lost) for k, (seq, arrival, lost) in enumerate(ready, 1)]
        return pd.DataFrame(rows, columns=["camera", "arrival", "seq", "place", "lost"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        came = pd.concat(list(rows), ignore_index=True).sort_values("arrival")
        due, place = self.at.get() if self.at.exists() else (None, 0)
        held = {int(k[0]): int(v[0]) for k, v in self.waiting.iterator()}
        before, ready = dict(held), []
        for arrival, seq in came[["arrival", "seq"]].itertuples(index=False):
            arrival, seq = int(arrival), int(seq)
            due = seq if due is None else due
            ahead = (seq - due + 32768) % 65536 - 32768
            if ahead < 0:
                continue
            if 0 < ahead < self.window:
                held[seq] = arrival
                continue
            if ahead:
                ready += [(s, held[s], 0) for s in sorted(held, key=lambda s, due=due: (s - due) % 65536)]
                held = {}
            ready.append((seq, arrival, max(ahead - 1, 0)))
            due = (seq + 1) % 65536
            while due in held:
                ready.append((due, held.pop(due), 0))
                due = (due + 1) % 65536
        for s in before.keys() - held.keys():
            self.waiting.removeKey((s,))
        for s in held:
            if before.get(s) != held[s]:
                self.waiting.updateValue((s,), (held[s],))
        if self.patience is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
            if held:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)
        yield self._sent(key, due, place, ready)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due, place = self.at.get()
        held = {int(k[0]): int(v[0]) for k, v in self.waiting.iterator()}
        ready = []
        for s in sorted(held, key=lambda s: (s - due) % 65536):
            ready.append((s, held[s], (s - due) % 65536))
            due = (s + 1) % 65536
            self.waiting.removeKey((s,))
        yield self._sent(key, due, place, ready)

    def close(self) -> None:
        pass


def received(packets: DataFrame, window: int = WINDOW, patience_ms: int | None = None) -> DataFrame:
    """(camera, arrival, seq) as a stream -> camera, arrival, seq, place, lost, in the order of ``place``. Arrivals go up from batch to batch;
    inside one they are sorted. State is at most window packets a camera. Needs a state store with maps
    (``spark.sql.streaming.stateStore.providerClass`` for RocksDB)."""
    rows = packets.select("camera", "arrival", "seq")
    mode = "ProcessingTime" if patience_ms is not None else "None"
    return rows.groupBy("camera").transformWithStateInPandas(Receiver(window, patience_ms), OUT, "append", mode)
