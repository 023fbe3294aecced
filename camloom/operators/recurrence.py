"""The detector's fold over arrays: means as linear recurrences, the debounce machine over runs of equal signals.

m(t) = gain * x(t) + keep * m(t - 1) is evaluated for blocks of BLOCK values at once, as a product with the triangle of
powers of keep; from block to block only the last value is carried. What the machine does in a run of frames with a signal, or
without, follows from where it enters the run, so it takes a step for each run and each change of state. The first frames of a camera, until its
means have a value, go one by one (``detector.step``).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from camloom.operators import detector as D

BLOCK = 128


@lru_cache(maxsize=16)
def _powers(gain: float, keep: float) -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(BLOCK)
    return np.where(k[:, None] <= k, gain * keep ** (k - k[:, None]).clip(0), 0.0), keep ** (k + 1.0)


def recurrence(x: np.ndarray, gain: float, keep: float, before: float) -> np.ndarray:
    """m(t) = gain * x(t) + keep * m(t - 1) for all t, with m(-1) = before."""
    n = len(x)
    triangle, fade = _powers(gain, keep)
    parts = np.zeros((-(-n // BLOCK), BLOCK))
    parts.reshape(-1)[:n] = x
    out = parts @ triangle
    for row in out:
        row += before * fade
        before = row[-1]
    return out.reshape(-1)[:n]


@dataclass
class Rows:
    """What the detector tells of consecutive frames; the names of detector.NAMES, event and reason as the frames that have one."""

    z_score: np.ndarray
    intra_ratio: np.ndarray
    fsm_before: np.ndarray
    fsm_after: np.ndarray
    since_kf: np.ndarray
    bpf_ewma: np.ndarray
    bpf_slow: np.ndarray
    bpf_var: np.ndarray
    events: dict[int, str]
    reasons: dict[int, str]


def _since(keyframe: np.ndarray, before: int) -> np.ndarray:
    at = np.arange(len(keyframe))
    last = np.maximum.accumulate(np.where(keyframe, at, -1))
    unknown = D.UNKNOWN if before == D.UNKNOWN else before + at + 1
    return np.where(last >= 0, at - last, unknown).astype(np.int64)


def debounced(signal: np.ndarray, s: D.State, c: D.Config) -> tuple[np.ndarray, list[int]]:
    """The machine's state after each frame, and the frames at which motion begins; s goes on to the last."""
    n, states, begins = len(signal), np.empty(len(signal), np.int16), []
    edges = np.concatenate([[0], np.flatnonzero(signal[1:] != signal[:-1]) + 1, [n]]).tolist()
    for at, end in zip(edges[:-1], edges[1:], strict=True):
        on = bool(signal[at])
        while at < end:
            if s.fsm == D.COOLDOWN:
                s.fsm, s.above, s.below, last = D.IDLE, 0, 0, at + 1
                states[at:last] = D.IDLE
            elif s.fsm == D.IDLE and on:
                s.below, last = 0, at + max(1, c.on_threshold - s.above)
                states[at : min(last, end)] = D.IDLE
                if last > end:
                    s.above += end - at
                else:
                    s.fsm, s.above, states[last - 1] = D.ACTIVE, 0, D.ACTIVE
                    begins.append(last - 1)
            elif s.fsm == D.IDLE:
                s.above, last = 0, end
                states[at:end] = D.IDLE
            elif on:
                s.below, s.above, last = 0, (s.above + end - at) % 256, end
                states[at:end] = D.ACTIVE
            else:
                s.above, last = 0, at + max(1, c.off_threshold - s.below)
                states[at : min(last, end)] = D.ACTIVE
                if last > end:
                    s.below += end - at
                else:
                    s.fsm, s.below, states[last - 1] = D.COOLDOWN, 0, D.COOLDOWN
            at = min(last, end)
    return states, begins


def advanced(s: D.State, size: np.ndarray, keyframe: np.ndarray, intra: np.ndarray | None, c: D.Config) -> Rows:
    """Advances s by all frames. size: bytes as doubles; intra: explicit ratios, NaN where there is none. Equal to ``step`` on each, but for
    rounding in the last places."""
    n = len(size)
    out = Rows(*(np.zeros(n) for _ in range(2)), *(np.zeros(n, np.int16) for _ in range(2)), np.zeros(n, np.int64), *(np.zeros(n) for _ in range(3)), {}, {})
    at = 0
    while at < n and (s.slow <= 0.0 or s.ewma <= 0.0):
        _one(out, at, D.step(s, size[at].item(), bool(keyframe[at]), None if intra is None or np.isnan(intra[at]) else intra[at].item(), c))
        at += 1
    if at < n:
        _many(out, at, s, size[at:], keyframe[at:], None if intra is None else intra[at:], c)
    return out


def _one(out: Rows, k: int, row: tuple) -> None:
    event, out.z_score[k], out.intra_ratio[k], reason, out.fsm_before[k], out.fsm_after[k], out.since_kf[k], out.bpf_ewma[k], out.bpf_slow[k], out.bpf_var[k] = row
    if event is not None:
        out.events[k] = event
    if reason != "none":
        out.reasons[k] = reason


def _many(out: Rows, first: int, s: D.State, x: np.ndarray, keyframe: np.ndarray, given: np.ndarray | None, c: D.Config) -> None:
    n = len(x)
    moving = ~keyframe
    seen = np.cumsum(moving)  # how many frames but keyframes up to each
    xs = x[moving]
    means = [np.concatenate([[m], recurrence(xs, a, 1.0 - a, m)]) for a, m in ((D.ALPHA_SLOW, s.slow), (D.ALPHA_VSLOW, s.vslow))]
    if means[0].min() <= 0.0 or means[1].min() <= 0.0:  # frames of no bytes for so long that a mean is lost
        for k in range(n):
            _one(out, first + k, D.step(s, x[k].item(), bool(keyframe[k]), None if given is None or np.isnan(given[k]) else given[k].item(), c))
        return
    d = xs - means[0][1:]
    keep = 1.0 - D.ALPHA_SLOW
    var = np.concatenate([[s.var], recurrence(d * d, keep * D.ALPHA_SLOW, keep, s.var)])
    slow, vslow = (m[seen] for m in means)
    before = means[0][seen - moving]
    ratio = x / np.where(before > 0, before, 100.0)
    intra = ratio if given is None else np.where(np.isnan(given), ratio, given)
    z = np.zeros(n)
    z[moving] = d / np.maximum(np.sqrt(var[1:]), c.bpf_floor)
    ewma = recurrence(x, D.ALPHA_FAST, 1.0 - D.ALPHA_FAST, s.ewma)
    since = _since(keyframe, s.since_kf)
    enough = moving if c.min_bytes_threshold == 0 else moving & (x >= c.min_bytes_threshold)
    z_high = c.motion_z_high
    if c.extended_gates:
        if c.bpf_relative_floor > 0:
            enough = enough & (x >= c.bpf_relative_floor * slow)
        z_high = np.where(s.frames + 1 + np.arange(n) <= c.z_high_warmup_frames, max(z_high, c.z_high_warmup), z_high)
    z_signal, intra_signal = enough & (z > z_high), enough & (intra > c.intra_ratio_high)
    idr_signal = keyframe & (not c.configured_periodic_kf)
    if not c.strict_idr:
        idr_signal = idr_signal & (np.concatenate([[s.since_kf], since[:-1]]) == 0)
    signal = z_signal | intra_signal | idr_signal
    for k in np.flatnonzero(signal).tolist():
        parts = [f"z={z[k]:.2f}" if z_signal[k] else "", f"intra_ratio={intra[k]:.2f}" if intra_signal[k] else "", "unexpected_idr" if idr_signal[k] else ""]
        out.reasons[first + k] = ",".join(filter(None, parts))
    part, entered = slice(first, first + n), s.fsm
    states, begins = debounced(signal, s, c)
    out.events.update((first + k, "motion") for k in begins)
    if c.gradual_enabled:
        _gradual(out, first, s, np.abs(slow - vslow) / vslow, c)
    out.z_score[part], out.intra_ratio[part], out.fsm_after[part], out.since_kf[part] = z, intra, states, since
    out.fsm_before[part] = np.concatenate([[entered], states[:-1]])
    out.bpf_ewma[part], out.bpf_slow[part], out.bpf_var[part] = ewma, slow, var[seen]
    s.ewma, s.slow, s.vslow, s.var, s.since_kf, s.frames = float(ewma[-1]), float(slow[-1]), float(vslow[-1]), float(var[-1]), int(since[-1]), s.frames + n


def _gradual(out: Rows, first: int, s: D.State, diverge: np.ndarray, c: D.Config) -> None:
    """Counts frames in which the slow means are apart; a frame that begins motion counts neither way."""
    for k, apart in enumerate((diverge > c.gradual_threshold).tolist()):
        if first + k in out.events:
            continue
        if apart:
            s.gradual += 1
            if s.gradual >= c.gradual_window_frames:
                out.events[first + k], out.reasons[first + k], s.gradual = "scene_change", f"gradual:diverge={diverge[k]:.3f}", 0
        elif s.gradual:
            s.gradual -= 1
