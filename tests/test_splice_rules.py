"""Rules of overlaps, windows, junctions and candidates against cases worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spliceflow.operators import editing as E
from spliceflow.operators import events, structure, transitions


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "base, preferred, vocal, label, entry, leave, want",
    [
        (0.075, 0.0, 0.10, 0.0, 0.0, 0.0, 0.075),  # little voice: the base
        (0.075, 0.0, 0.60, 0.0, 1.0, 1.0, 0.300),  # the labels differ
        (0.075, 0.0, 0.60, 1.0, 0.4, 0.9, 0.180),  # one label, weak entry
        (0.075, 0.0, 0.60, 1.0, 0.9, 0.9, 0.075),  # one label, both sides supported
        (0.075, 0.5, 0.60, 0.0, 0.0, 0.0, 0.500),  # the preferred one is longer
        (0.200, 0.1, 0.28, 1.0, 0.4, 0.4, 0.200),  # never shorter than the base
    ],
)
def test_overlap(spark, base, preferred, vocal, label, entry, leave, want):
    assert value(spark, E.overlap_seconds(*(F.lit(float(x)) for x in (base, preferred, vocal, label, entry, leave)))) == want


def test_window_onset_and_penalties(spark):
    n = 64
    click = [0.0] * 40 + [1.0] * 24
    mono = np.abs(click)
    envelope = np.convolve(mono, np.ones(8) / 8, mode="same")
    at = int(np.argmax(np.round(np.maximum(np.diff(envelope, prepend=envelope[:1]), 0), 9)))
    d = spark.createDataFrame([(click, click[::-1])], "a array<double>, b array<double>")
    got = d.select(E.window_onset("a").alias("o"), *(c.alias(k) for k, c in E.pair_penalties("a", "a", n, F.lit(4), F.lit(-4), 8).items())).first()
    assert got.o == at and got.energy == 0.0 and got.alignment == 0.0 and got.position == 0.5
    assert abs(got.centre - min(1.0, 2 * abs(at - 31.5) / (2 * 0.35 * n))) < 1e-12
    louder = d.select(E.pair_penalties(F.transform("a", lambda x: x * 2.0), F.col("a"), n, F.lit(0), F.lit(0), 0)["energy"].alias("e"), E.pair_penalties("a", "a", n, F.lit(3), F.lit(3), 0)["position"].alias("p")).first()
    assert abs(louder.e - 20 * math.log10(2) / 12) < 1e-6 and louder.p == 0.0
    assert d.select(E.window_onset(F.slice("a", 1, 12)).alias("o")).first().o == 6


def test_anchor_score_of_equal_windows(spark):
    v = [math.sin(k / 3) for k in range(64)]
    d = spark.createDataFrame([(v,)], "a array<double>")
    got = d.select(E.anchor_score("a", "a", 64, F.lit(32), F.lit(0.0), 16).alias("x"), E.anchor_score("a", "a", 64, F.lit(2), F.lit(0.0), 16).alias("edge")).first()
    assert abs(got.x - 1.0) < 1e-9 and abs(got.edge - (1 - 0.04 * (1 - 2 / (0.18 * 64)))) < 1e-9


def test_junction_penalties(spark):
    p = spark.createDataFrame([(0, 0, 9, 1.0, 12.0, 0.5, 0.5, 0.0), (0, 1, 9, 1.0, 0.0, 0.0, 1.0, 1.0)], "track long, i long, j long, successor double, energy_diff_db double, vocal_i double, vocal_j double, onset_j double")
    got = {r.i: r.score for r in E.junction_scores(p, {"successor": 1.0}).collect()}
    assert abs(got[0] - (1 - 0.15 - 0.3 * 0.1 - 0.12)) < 1e-9 and abs(got[1] - 0.9) < 1e-9
    with pytest.raises(ValueError):
        E.junction_scores(p, {"waveform": 1.0})


def test_default_weights_need_marks(spark):
    b = spark.createDataFrame([(0, k, [float(k + 1)] * 40) for k in range(5)], "track long, beat long, feat array<double>")
    db = b.select("track", "beat", F.lit(0.0).alias("db_start"), F.lit(0.0).alias("db_end"))
    with pytest.raises(ValueError):
        transitions.transition_candidates(b, b.select("track", "beat", F.col("feat").alias("w")), db)


def test_snap_nearest_of_many_events_in_one_track(spark):
    n = 200_000
    left = spark.range(n).select(F.lit(0).cast("long").alias("track"), (F.col("id") * 1.0 + 0.2).alias("t"))
    grid = spark.range(0, n, 3).select(F.lit(0).cast("long").alias("track"), F.col("id").alias("j"), (F.col("id") * 1.0).alias("t"))
    got = events.snap_nearest(left, grid)
    wrong = got.where(F.col("j") != F.round(F.col("t") / 3) * 3).where(F.col("t") < n - 3)
    assert got.count() == n and wrong.count() == 0


def test_bar_features_end_after_the_last_beat(spark):
    b = spark.createDataFrame([(0, k, 0.5 * k, [float(k)]) for k in range(7)] + [(1, 0, 0.0, [1.0])], "track long, beat long, t double, feat array<double>")
    down = spark.createDataFrame([(0, 0.1), (0, 1.9), (1, 0.0), (1, 1.0)], "track long, t double")
    got = structure.bar_features(b, down).orderBy("bar").collect()
    assert [(r.track, r.bar, r.start, r.t, r.end_t, r.feat) for r in got] == [(0, 0, 0, 0.0, 2.0, [1.5]), (0, 1, 4, 2.0, 3.5, [5.0])]
