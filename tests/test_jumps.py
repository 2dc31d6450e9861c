"""Verified jumps, prescreened transitions and matched levels on worked cases."""

import math

import numpy as np
import pytest

from spliceflow.operators import editing as E
from spliceflow.operators import similarity as M
from spliceflow.operators import structure as S
from spliceflow.operators import transitions as Q


def wave(kind, n=80):
    return np.random.default_rng(kind).normal(size=n).tolist()


@pytest.fixture(scope="module")
def bars(spark):
    """Two segments of four bars of four beats, at beats 0 and 40."""
    return spark.createDataFrame([(0, s, b, 40 * s + 4 * b, 40 * s + 4 * b + 4) for s in (0, 1) for b in range(4)], "track long, seg long, bar long, start long, end long")


def jumps(spark, bars, kinds, offset=0):
    corr = spark.createDataFrame([(0, 0, 1, offset, 0.9)], "track long, a long, b long, offset long, corr double")
    snip = spark.createDataFrame([(0, b, wave(k)) for b, k in kinds.items()], "track long, beat long, w array<double>")
    got = S.repetition_jumps(corr, bars, snip, max_lag=4).collect()
    return {(r.from_beat, r.to_beat) for r in got}


def test_a_failed_jump_takes_its_way_back_along(spark, bars):
    # bar b of the first segment ends at 4b + 3 and leads to 40 + 4b; the way back from 43 + 4b to 4b
    same = {b: 1 for b in range(60)}
    assert jumps(spark, bars, same) == {(4 * b + 3, 40 + 4 * b) for b in range(4)} | {(43 + 4 * b, 4 * b) for b in range(4)}
    assert jumps(spark, bars, same, offset=1) == {(4 * b + 3, 44 + 4 * b) for b in range(3)} | {(47 + 4 * b, 4 * b) for b in range(3)}
    there = same | {40: 2}  # landing on 40 fails: bar 0 loses both directions
    assert jumps(spark, bars, there) == jumps(spark, bars, same) - {(3, 40), (43, 0)}
    back = same | {0: 2}  # landing on 0 fails: only the way back goes
    assert jumps(spark, bars, back) == jumps(spark, bars, same) - {(43, 0)}
    gone = {b: 1 for b in range(56)}  # no snippet at 56: the last way back has nothing to compare
    assert jumps(spark, bars, gone) == jumps(spark, bars, same) - {(55, 12)}


def test_jumps_within_a_section(spark):
    n, lag = 48, 16
    rec = spark.createDataFrame([(0, i, i + lag, 0.5) for i in range(n - lag)] + [(0, i, i + 9, 0.9) for i in range(n - 9)], "track long, i long, j long, v double")
    seg = spark.createDataFrame([(0, 0, 0, n, "verse"), (0, 1, 0, n, "Intro"), (0, 2, 0, 20, "short")], "track long, seg long, start long, end long, label string")
    count = spark.createDataFrame([(0, n)], "track long, n long")
    snip = lambda odd: spark.createDataFrame([(0, b, wave(2 if b == odd else 1)) for b in range(n)], "track long, beat long, w array<double>")
    got = [tuple(r) for r in S.within_section_jumps(rec, seg, 4, count, snip(-1), max_lag=4).collect()]
    # only lags of whole bars; from the middle of the 32 places of the diagonal
    assert [g[:6] for g in got] == [(0, 0, 16, 0.5, 16, 32)] and got[0][6] > 0.99
    assert S.within_section_jumps(rec, seg, 4, count, snip(18), max_lag=4).count() == 0  # the snippet two after the beat left
    assert S.within_section_jumps(rec, seg, 4, count, snip(17), max_lag=4).count() == 1
    assert S.within_section_jumps(rec, seg, 4, mean_least=0.6).count() == 0


def test_the_first_longest_run_of_a_diagonal(spark):
    cells = {(r, r + 20): v for r, v in ((0, 0.5), (1, 0.5), (3, 0.3), (4, 0.4), (5, 0.6), (7, 0.9), (8, 0.9), (9, 0.9))}
    cells |= {(r, r + 24): 0.2 for r in range(2, 6)} | {(r, r + 16): 0.1 for r in range(12)}
    edges = spark.createDataFrame([(0, i, j, v) for (i, j), v in cells.items()], "track long, i long, j long, v double")
    w = spark.createDataFrame([(0, 7, 0, 10, 20, 30), (0, 8, 0, 9, 20, 29), (0, 9, 5, 8, 5, 8)], "track long, key long, row_start long, row_end long, col_start long, col_end long")
    got = {(r.key, r["rank"]): (r.from_beat, r.to_beat, r.length, round(r["mean"], 6)) for r in M.window_diagonals(edges, w, ["key"], 4, 2).collect()}
    # of two runs of three the first; then the shorter product of the other offset; the run at 7 is cut in the second window
    assert got == {(7, 1): (4, 24, 3, 0.433333), (7, 2): (4, 28, 4, 0.2), (8, 1): (4, 24, 3, 0.433333), (8, 2): (3, 27, 3, 0.2)}


def test_prescreened_pairs_are_like_in_sound_and_not_repeated(spark):
    n = 40
    rec = spark.createDataFrame([(0, i, j, 0.5) for i in range(n) for j in range(n) if abs(i - j) == 20], "track long, i long, j long, v double")
    seg = spark.createDataFrame([(0, s, 10 * s, 10 * s + 10) for s in range(4)], "track long, seg long, start long, end long")
    count = spark.createDataFrame([(0, n)], "track long, n long")
    snip = lambda odd: spark.createDataFrame([(0, b, wave(2 if b in odd else 1)) for b in range(n)], "track long, beat long, w array<double>")
    how = dict(meter=2, max_lag=4)
    got = Q.prescreen_transitions(rec, seg, count, snip(()), **how).collect()
    pairs = [(r.from_beat, r.to_beat) for r in got]
    assert len(set(pairs)) == len(pairs) and all(abs(a - b) == 20 for a, b in pairs)
    assert [r["rank"] for r in sorted(got, key=lambda r: (-round(r.length * r.score * max(0.1, r.waveform), 9), r["rank"]))] == list(range(1, len(got) + 1))
    lost = Q.prescreen_transitions(rec, seg, count, snip((pairs[0][1],)), **how).collect()
    assert pairs[0] not in {(r.from_beat, r.to_beat) for r in lost} and {(r.from_beat, r.to_beat) for r in lost} < set(pairs)
    assert all(r.waveform == 0 for r in Q.prescreen_transitions(rec, seg, count, None, **how).collect())


def test_levels_are_matched_over_four_overlaps(spark):
    x = [1.0] * 50 + [0.5] * 50 + [0.0] * 50 + [0.01] * 50
    d = spark.createDataFrame([(0, i, v) for i, v in enumerate(x)], "track long, i long, x double")
    clips = spark.createDataFrame([("r", 0, k, 50 * k, 40, 36 * k, 0 if k == 0 else 4, 0 if k == 3 else 4) for k in range(4)], "run_id string, track long, clip long, first long, n long, at long, fade_in long, fade_out long")
    gain = {r.clip: r.gain for r in E.junction_gain(clips, d).collect()}
    assert gain[0] == 1.0 and abs(gain[1] - 2.0) < 1e-6 and gain[2] == 2.83 and gain[3] == 0.35
    out = {r.i: r.x for r in E.mixdown(clips, d, match=True).collect()}
    fade = lambda k: math.sin(math.pi / 2 * (k + 0.5) / 4)
    for k in range(20):
        level = 2.0 + (1 - 2.0) * k / 15 if k < 16 else 1.0
        want = 0.5 * level * (fade(k) if k < 4 else 1) + (1.0 * fade(3 - k) if k < 4 else 0)
        assert abs(out[36 + k] - want) < 1e-6, k
    plain = {r.i: r.x for r in E.mixdown(clips, d).collect()}
    assert plain.keys() == out.keys() and abs(plain[45] - 0.5) < 1e-12
