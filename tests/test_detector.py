"""Traces with known outcomes for the detector's fold, and batch against fold."""

import math
import random

import numpy as np
import pytest

from camloom.operators import detector as D

P = lambda size, n=1, intra=0.5: [(size, False, intra)] * n
KF = (50_000, True, 0.5)


def events(frames, config, state=None):
    return [(i, r[0]) for i, r in enumerate(D.fold(frames, config, state)) if r[0]]


def test_static_scene():
    assert events(P(10_000, 100), D.Config()) == []


def test_burst():
    s = D.State()
    D.fold(P(10_000, 200), D.Config(), s)
    s.fsm, s.above, s.below = D.IDLE, 0, 0
    found = events(P(10_000, 15) + P(50_000, 15), D.Config(on_threshold=2), s)
    assert found == [(16, "motion")]


def test_hysteresis():
    s, c = D.State(), D.Config(off_threshold=5)
    D.fold(P(10_000, 200), c, s)
    D.fold(P(80_000, 5), c, s)
    assert s.fsm == D.ACTIVE
    D.fold(P(10_000, 5), c, s)
    assert s.fsm == D.COOLDOWN
    D.fold(P(80_000, 1), c, s)
    assert s.fsm == D.IDLE and s.above == 0


@pytest.mark.parametrize(("n", "expected"), [(1, []), (2, [(201, "motion")])])
def test_keyframes(n, expected):
    rows = D.fold(P(10_000, 200) + [KF] * n, D.Config(on_threshold=1))
    assert [(i, r[0]) for i, r in enumerate(rows) if r[0]] == expected
    if expected:
        assert rows[201][3] == "unexpected_idr"


def test_periodic_keyframes_are_no_signal_and_strict_ones_are():
    frames = P(10_000, 200) + [KF]
    assert events(frames + [KF], D.Config(on_threshold=1, configured_periodic_kf=True)) == []
    assert events(frames, D.Config(on_threshold=1, strict_idr=True)) == [(200, "motion")]


def test_intra_signal():
    rows = D.fold(P(10_000, 200) + P(10_000, 1, 3.0), D.Config(on_threshold=1))
    assert rows[-1][0] == "motion" and "intra_ratio=3.00" in rows[-1][3]


def test_byte_floor_gates_both_signals():
    frames = P(100, 200) + P(1_000, 3, 9.0)
    assert events(frames, D.Config()) and not events(frames, D.Config(min_bytes_threshold=2000))


def test_gradual_ramp():
    c = D.Config(gradual_enabled=True, gradual_window_frames=50, motion_z_high=99.0, intra_ratio_high=99.0)
    ramp = [(10_000 + 50 * i, False, 0.5) for i in range(300)]
    dawn = P(5_000, 200) + [(5_000 + 26 * i, False, 0.5) for i in range(500)]
    assert any(e == "scene_change" for _, e in events(ramp + P(25_000, 200), c))
    assert any(e == "scene_change" for _, e in events(dawn, c))
    assert events(P(10_000, 500), c) == []


def test_cold_start_counts_the_ratio_against_one_hundred():
    rows = D.fold([(300, False, None), (300, False, None)], D.Config(on_threshold=1))
    assert rows[0][2] == 3.0 and rows[0][0] == "motion"


def test_first_keyframes_wait_for_a_baseline():
    s = D.State()
    rows = D.fold([KF, KF], D.Config(on_threshold=1), s)
    assert rows[1][:4] == (None, 0.0, 0.0, "") and s.since_kf == 0


def test_variance_and_means():
    rows = D.fold(P(1_000) + P(2_000), D.Config())
    slow = 0.005 * 2_000 + 0.995 * 1_000
    d = 2_000 - slow
    first = 0.995 * (10 + 0.005 * 0.0)
    var = 0.995 * (first + 0.005 * d * d)
    assert rows[1][8] == slow and rows[1][9] == pytest.approx(var) and rows[1][1] == pytest.approx(d / max(math.sqrt(var), 100))


def test_batch_equals_fold(spark):
    rows = [(f"c{k % 3}", k, (k * 7919) % 5000, k % 50 == 0) for k in range(3000)]
    df = spark.createDataFrame(rows, "camera string, seq long, byte_count long, is_keyframe boolean").repartition(7)
    got = {(r.camera, r.seq): (r.event, r.z_score, r.fsm_after, r.since_kf) for r in D.signals(df, D.Config(off_threshold=5)).collect()}
    for c in ("c0", "c1", "c2"):
        mine = [r for r in rows if r[0] == c]
        for r, x in zip(mine, D.fold([(r[2], r[3], None) for r in mine], D.Config(off_threshold=5)), strict=True):
            event, z, *rest = got[c, r[1]]  # means are summed in another order, so the last places differ
            assert (event, rest) == (x[0], [x[5], x[6]]) and z == pytest.approx(x[1], rel=1e-9, abs=1e-9)


def test_configs_of_cameras(spark):
    frames = spark.createDataFrame([(c, k, 100 if k < 200 else 5000, False) for c in ("a", "b", "z") for k in range(203)], "camera string, seq long, byte_count long, is_keyframe boolean")
    configs = spark.createDataFrame([("a", 2, None), ("b", 2, 9000)], "camera string, on_threshold int, min_bytes_threshold long")
    found = {r.camera for r in D.signals(frames, D.Config(on_threshold=1, bpf_floor=50.0, intra_ratio_high=1e9), configs, events_only=True).collect()}
    assert found == {"a", "z"}


def test_empty(spark):
    empty = spark.createDataFrame([], "camera string, seq long, byte_count long, is_keyframe boolean")
    assert D.signals(empty).count() == 0


def advanced_rows(frames, c, cut):
    from camloom.operators.recurrence import advanced

    s, out = D.State(), []
    for at in range(0, len(frames), cut):
        part = frames[at : at + cut]
        intra = None if all(i is None for _, _, i in part) else np.array([np.nan if i is None else i for _, _, i in part])
        r = advanced(s, np.array([float(x) for x, _, _ in part]), np.array([k for _, k, _ in part]), intra, c)
        columns = (r.z_score, r.intra_ratio, r.fsm_before, r.fsm_after, r.since_kf, r.bpf_ewma, r.bpf_slow, r.bpf_var)
        out += [(r.events.get(k), z, i, r.reasons.get(k, "none"), *rest) for k, (z, i, *rest) in enumerate(zip(*(x.tolist() for x in columns), strict=True))]
    return out


@pytest.mark.parametrize("cut", [1, 7, 129, 5000])
@pytest.mark.parametrize("seed", range(6))
def test_arrays_give_what_single_steps_give(seed, cut):
    rng = random.Random(seed)
    explicit = seed % 2
    frames, level = [(0, False, None)] * rng.randrange(4) + [(500, True, None)] * rng.randrange(3) + [(0, False, None)] * rng.randrange(3), 1000
    for _ in range(1500):
        level = rng.choice([level] * 60 + [900, 4000, 40_000])
        frames += [(max(0, int(rng.gauss(level, level / 9))), rng.random() < rng.choice([0.01, 0.3]), rng.choice([None, 0.5, 3.0]) if explicit else None)] * rng.choice([1, 1, 1, 3])
    c = D.Config(
        motion_z_high=rng.choice([1.0, 3.0]), on_threshold=rng.choice([1, 2, 3]), off_threshold=rng.choice([1, 5, 45]), min_bytes_threshold=rng.choice([0, 950]), configured_periodic_kf=seed == 1, strict_idr=seed == 2,
        gradual_enabled=seed % 3 == 0, gradual_threshold=0.05, gradual_window_frames=40, extended_gates=seed > 2, bpf_relative_floor=0.8, z_high_warmup=5.0, z_high_warmup_frames=200,
    )
    got, expected = advanced_rows(frames, c, cut), D.fold(frames, c)
    assert len(got) == len(expected) and len({e[0] for e in expected}) > 1
    for g, e in zip(got, expected, strict=True):
        assert (g[0], g[3], *g[4:7]) == (e[0], e[3], *e[4:7])
        assert g[1:3] + g[7:] == pytest.approx(e[1:3] + e[7:], rel=1e-9, abs=1e-7)


def test_means_that_are_lost_in_rounding():
    frames = [(10, False, None), (0, True, None)] + [(0, False, None)] * 200_000 + [(9, False, None)] * 3
    got, expected = advanced_rows(frames, D.Config(), 70_000), D.fold(frames, D.Config())
    assert [g[5] for g in got[-5:]] == [e[5] for e in expected[-5:]] and got[-1][8] == pytest.approx(expected[-1][8])


def test_detector_takes_nulls_and_configurations(spark):
    rows = [(cam, k, None if k == 5 else 100 + 900 * (k % 50 > 47), None if k == 6 else k % 40 == 0) for cam in ("a", "b", None) for k in range(400)]
    frames = spark.createDataFrame(rows, "camera string, seq long, byte_count long, is_keyframe boolean")
    own = spark.createDataFrame([("b", 1, None)], "camera string, on_threshold int, off_threshold int")
    got = {}
    for r in D.signals(frames, D.Config(off_threshold=3), own).collect():
        got.setdefault(r.camera, []).append(r)
    for cam, c in (("a", D.Config(off_threshold=3)), ("b", D.Config(on_threshold=1, off_threshold=3)), (None, D.Config(off_threshold=3))):
        expected = D.fold([(x or 0, bool(k), None) for n, _, x, k in rows if n == cam], c)
        assert [(r.event, r.reason, r.fsm_before, r.fsm_after, r.since_kf) for r in sorted(got[cam], key=lambda r: r.seq)] == [(e[0], e[3], *e[4:7]) for e in expected]
