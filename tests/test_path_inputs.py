"""What the path searches read of the pairs of a track, and which jumps they look at."""

import numpy as np
import pytest

from spliceflow.operators import paths as P
from spliceflow.operators import transitions as Q


@pytest.fixture(scope="module")
def beats(spark):
    rng = np.random.default_rng(8)
    rows = [(t, b, rng.normal(size=30).tolist()) for t, n in ((0, 90), (1, 37)) for b in range(n)]
    return spark.createDataFrame(rows, "track long, beat long, feat array<double>")


def key(df, *cols):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("boundaries", [False, True])
def test_edges_of_the_nearest_are_those_of_all_pairs(beats, boundaries):
    down, bound = beats.where("beat % 4 = 0").select("track", "beat"), beats.where("beat % 16 = 0").select("track", "beat") if boundaries else None
    got = P.path_edges(Q.downbeat_nearest(beats, down, 3, 8, bound).withColumnRenamed("d", "cost"), down, meter=2, most=3, boundaries=bound)
    want = P.path_edges(Q.chroma_distance(beats).where("d < 1").withColumnRenamed("d", "cost"), down, meter=2, most=3, boundaries=bound)
    cols = ["track", "i", "j", "cost"]
    assert key(got, *cols) == key(want, *cols) and len(key(got, *cols)) > 60


def test_means_of_segments_are_those_of_all_pairs(beats):
    want = Q.chroma_distance(beats).selectExpr("track", "floor(i / 16) a", "floor(j / 16) b", "d").groupBy("track", "a", "b").agg(Q.F.avg("d").alias("d"))
    cols = ["track", "a", "b", "d"]
    assert key(Q.chroma_means(beats, 16), *cols) == key(want, *cols)


def test_edges_of_a_region_are_those_of_all_its_pairs(beats):
    runs = beats.select("track").distinct().selectExpr("concat('r', track) run_id", "track", "3L entry", "31L exit", "track = 0 extending", "1D scale")
    steps = Q.sequential_cost(beats)
    all_of = Q.region_candidates(Q.chroma_distance(beats), runs.select("run_id", "track", "entry", "exit"))
    near = Q.region_nearest(beats, runs, 3)
    cols = ["run_id", "track", "i", "j", "cost", "back", "tax"]
    got, want = (key(P.region_edges(runs, c.select("run_id", "track", "i", "j", "cost"), steps, most=3), *cols) for c in (near, all_of))
    assert got == want and len(got) > 100


@pytest.mark.parametrize("seed", range(6))
def test_jumps_left_out_could_not_win(monkeypatch, seed):
    rng = np.random.default_rng(seed)
    n = 60
    i, j = np.nonzero(rng.random((n, n)) < 0.4)
    i, j = i[j != i + 1], j[j != i + 1]
    cost = rng.random(len(i)).round(1)  # ties
    back, tax = np.where(j < i, 0.5, 0.0), rng.random(len(i)).round(1) * rng.integers(1, 9)
    every = [np.concatenate(v) for v in ((i, np.arange(n - 1)), (j, np.arange(1, n)), (cost, np.full(n - 1, 0.1)), (back, np.zeros(n - 1)), (tax, np.zeros(n - 1)))]
    run = {"n_beats": n, "least": 90, "most": 110, "cooldown": 3, "intro_beats": 4, "least_jumps": 1}
    how = dict(ends=rng.random(n), lengths=np.zeros(111), nudge=0.01, most_jumps=5, worst_weight=2.0)
    monkeypatch.setattr(P, "FULL", 10**9)  # tries all
    want = P._search(run, *every, **how)
    monkeypatch.setattr(P, "FULL", 2)
    assert P._search(run, *every, **how) == want and len(want[3]) >= 1
