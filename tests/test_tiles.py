"""Scores of all pairs of a track by tiles, against plain loops."""

import numpy as np
import pytest

from spliceflow.operators import similarity as M
from spliceflow.operators import transitions as Q


@pytest.fixture(scope="module")
def beats(spark):
    rng = np.random.default_rng(1)
    rows = [(t, b, None if (t, b) == (0, 5) else rng.normal(size=20).round(2).tolist()) for t, n in ((0, 40), (1, 9), (2, 1)) for b in range(n)]
    rows += [(3, b, [float(b % 3)] * 20) for b in range(25)]  # ties
    return spark.createDataFrame(rows, "track long, beat long, feat array<double>"), {(t, b): v for t, b, v in rows}


def score(x, y, kind):
    x, y = np.array(x), np.array(y)
    return float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y) + 1e-8)) if kind == "cosine" else float(np.linalg.norm(x - y))


@pytest.mark.parametrize("kind", ["cosine", "distance"])
@pytest.mark.parametrize("apart", [(0, None), (3, None), (2, 5)])
@pytest.mark.parametrize("missing", [None, 0.25])
def test_tiles_score_all_pairs(beats, kind, apart, missing):
    d, v = beats
    lo, hi = apart
    want = {}
    for (t, i), x in v.items():
        for (u, j), y in v.items():
            if t == u and lo <= abs(i - j) and (hi is None or abs(i - j) <= hi) and (missing is not None or (x and y)):
                want[t, i, j] = score(x, y, kind) if x and y else missing
    got = {(r.track, r.i, r.j): r.v for r in M.tile_scores(d, d, kind, apart, missing=missing, size=7).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    k, most = 4, 0.9 if kind == "cosine" else 5.0
    near = {}
    for (t, i, j), s in want.items():
        cost = round(1 - s if kind == "cosine" else s, 12)
        if cost <= most:
            near.setdefault((t, i), []).append((cost, j))
    near = {(*key, j) for key, found in near.items() for _, j in sorted(found)[:k]}
    got = {(r.track, r.i, r.j) for r in M.tile_scores(d, d, kind, apart, nearest=k, most=most, missing=missing, size=7).collect()}
    assert got == near


def test_nearest_chromas_are_the_top_of_all_distances(beats):
    d = beats[0].where("feat is not null")
    extra = d.sparkSession.createDataFrame([(0, 1, 2), (0, 3, 30), (9, 1, 1)], "track long, i long, j long")
    key = lambda x: sorted((r.track, r.i, r.j, round(r.d, 9)) for r in x.collect())
    for more in (None, extra):
        assert key(Q.chroma_nearest(d, 3, 2, 0.8, more)) == key(Q.candidates_topk(Q.chroma_distance(d).withColumn("d", Q.F.round("d", 12)), 3, 2, 0.8, more))


def test_a_track_of_twenty_thousand_beats(spark):
    """Four hundred million pairs: only the nearest of each beat become rows."""
    d = spark.range(20000).selectExpr("0L track", "id beat", "transform(sequence(0, 18), k -> sin(id * 0.37 + k * k) + 0.1 * (id % 7)) feat")
    got = Q.chroma_nearest(d, k=2, guard=15, most=0.45)
    assert got.count() <= 40000 and got.selectExpr("max(i) - min(i)").first()[0] > 19000


def test_mfcc_takes_the_step_into_one_and_out_of_the_other(spark):
    rows = [(0, b, [float(v)] * 13) for b, v in enumerate((0.0, 0.3, 0.1, 0.4))]
    got = {(r.i, r.j): r.v for r in Q.mfcc_continuity(spark.createDataFrame(rows, "track long, beat long, feat array<double>")).collect()}
    # from 1 to 2: static 0.2, the step into 1 is 0.3 and that out of 2 is 0.3
    assert abs(got[1, 2] - (1 - 0.7 * 0.2 / 0.6)) < 1e-12
    # ends have no step: into 0 and out of 3
    assert abs(got[0, 3] - (1 - min(1.0, 0.7 * 0.4 / 0.6))) < 1e-12


def test_the_guard_replaces_what_the_voices_do_not_bear_out(spark):
    rng = np.random.default_rng(2)
    wave, n = rng.normal(size=80).tolist(), 24
    d = spark.createDataFrame([(0, b, rng.normal(size=30).tolist()) for b in range(n)], "track long, beat long, feat array<double>")
    same = spark.createDataFrame([(0, b, wave) for b in range(n)], "track long, beat long, w array<double>")
    band = spark.createDataFrame([(0, b, rng.normal(size=80).tolist()) for b in range(n)], "track long, beat long, w array<double>")
    db = spark.createDataFrame([(0, b, 0.0, 0.0) for b in range(n)], "track long, beat long, db_start double, db_end double")
    marks = spark.createDataFrame([(0, b, "a", 0, 0.5, 0.5, 0.5, 0.9 if b % 2 else 0.1, False, False) for b in range(n)], "track long, beat long, label string, seg long, rms double, centroid double, onset double, vocal double, leads_in boolean, is_downbeat boolean")
    how = dict(k=6, guard=2, most=2.0, floor=-1.0, marks=marks)
    plain = {(r.i, r.j): r.waveform for r in Q.transition_candidates(d, same, db, **how).collect()}
    guarded = {(r.i, r.j): r.waveform for r in Q.transition_candidates(d, same, db, band_snippets=band, **how).collect()}
    assert plain.keys() == guarded.keys() and all(abs(w - 1) < 1e-9 for w in plain.values())
    both = {k for k in plain if k[0] % 2 and k[1] % 2}
    assert both and all((guarded[k] < 0.7) == (k in both) for k in plain)
