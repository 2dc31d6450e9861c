"""The path search against a plain dynamic programme, and its parameters against cases worked out by hand."""

import numpy as np
import pytest

from spliceflow.operators import paths


def plain(n, most, least, cooldown, intro, outro, least_jumps, steps, edges):
    """One state per (length, beat), filled one beat and one edge at a time; edges: {i: [(j, cost, back, tax)]}."""
    inf, ratio = float("inf"), most / n
    dp = [dict() for _ in range(most + 2)]
    dp[1][0] = (0.0, 999, 0, 0.0, ())
    for t in range(1, most):
        for i in sorted(dp[t]):
            cost, since, jumps, worst, cuts = dp[t][i]
            free = t >= intro and since >= cooldown
            options = [(i + 1, steps[i], 0.0, 0.0)] if i + 1 < n else []
            options += edges.get(i, []) if free and jumps < 6 else []
            for j, w, back, tax in options:
                if j == i + 1:
                    c, state = cost + w + (0.02 * (0.5 - ratio) if free and ratio < 0.5 else 0.0), (since + 1, jumps, worst, cuts)
                else:
                    c, state = cost + w + back + tax + 8.0 * max(0.0, max(worst, w) - worst), (0, jumps + 1, max(worst, w), (*cuts, (i, j)))
                if c < dp[t + 1].get(j, (inf,))[0]:
                    dp[t + 1][j] = (c, *state)
    best, heavy = None, max(1.0, 3.0 * (1 - ratio))
    for t in range(least, most + 1):
        for i in sorted(dp[t]):
            cost, _, jumps, _, cuts = dp[t][i]
            if jumps < least_jumps:
                continue
            if i >= n - outro:
                end = -0.5 * heavy * (1 - (n - 1 - i) / outro) - (heavy if i >= n - 2 else 0.0)
            else:
                end = min((n - outro - i) * 0.2 * heavy, 8.0)
            total = cost + end + abs(t - most) / most * 3.0 * max(1.0, 2 - ratio)
            if best is None or total < best[0]:
                best = (total, t, i, cuts)
    return best


def test_paths_equal_the_plain_programme(spark):
    rng = np.random.default_rng(4)
    runs, rows, want = [], [], {}
    for k in range(12):
        n = int(rng.integers(30, 60))
        most = int(rng.integers(n // 3, 2 * n))
        conf = (n, max(2, most - 8), most, int(rng.integers(2, 9)), int(rng.integers(2, 9)), int(rng.integers(2, 6)), int(k % 3 == 0))
        steps = [float(rng.uniform(0, 0.12)) for _ in range(n - 1)]
        edges = {}
        for i in range(3, n, 4):
            edges[i] = [(int(j), float(rng.choice([0.1, 0.25, 0.5])), 4.0 if j < i and k % 2 else 0.0, float(rng.choice([0.0, 0.25]))) for j in range(0, n, 4) if abs(j - i) > 4 and rng.uniform() < 0.7]
        run = f"r{k}"
        runs.append((run, k, *conf))
        rows += [(run, k, i, i + 1, steps[i], 0.0, 0.0) for i in range(n - 1)] + [(run, k, i, *e) for i, es in edges.items() for e in es]
        want[run] = plain(n, most, conf[1], conf[3], conf[4], conf[5], conf[6], steps, edges)
    r = spark.createDataFrame(runs, "run_id string, track long, n_beats long, least long, most long, cooldown long, intro_beats long, outro_beats long, least_jumps long")
    e = spark.createDataFrame(rows, "run_id string, track long, i long, j long, cost double, back double, tax double")
    got = {x.run_id: x for x in paths.best_paths(r, e.orderBy("j")).collect()}
    assert set(got) == {k for k, v in want.items() if v} and sum(len(v[3]) for v in want.values() if v) > 10
    for k, x in got.items():
        assert abs(x.cost - want[k][0]) < 1e-9
        assert (x.length, x.end, tuple((c.i, c.j) for c in x.cuts)) == want[k][1:]


@pytest.mark.parametrize(
    "target, tolerance, want",
    [
        # 200 beats of half a second: target_beats, least, most, shortening, intro, outro, least_jumps, cooldown
        (30.0, 5.0, (60, 56, 64, True, 4, 2, 1, 8)),  # 0.3: 2 s at least, both ends at their floors, one jump, int(8 * 0.3) bars
        (70.0, 5.0, (140, 133, 147, True, 5, 2, 0, 16)),  # 0.7: 3.5 s
        (90.0, 5.0, (180, 171, 189, True, 8, 4, 0, 16)),  # 0.9: 4.5 s, ends not scaled
        (130.0, 5.0, (260, 250, 270, False, 8, 4, 0, 16)),
        (90.0, 0.0, (180, 179, 181, True, 8, 4, 0, 16)),  # a tolerance under 2 s: 0.5 s, one beat
        (1000.0, 5.0, (500, 490, 510, False, 8, 4, 0, 16)),  # clamped to 2.5 times the duration
    ],
)
def test_retarget_params(spark, target, tolerance, want):
    runs = spark.createDataFrame([("r", 0, target, 50.0)], "run_id string, track long, target double, edit_length double")
    tracks = spark.createDataFrame([(0, 200, 100.0)], "track long, n_beats long, duration double")
    r = paths.retarget_params(runs, tracks, tolerance=tolerance).first()
    assert (r.target_beats, r.least, r.most, r.shortening, r.intro_beats, r.outro_beats, r.least_jumps, r.cooldown) == want and r.scale == 1.0


def test_search_edges(spark):
    runs = spark.createDataFrame([("r", 0, 100, 50, 8, 6, 2.0, True)], "run_id string, track long, n_beats long, most long, cooldown long, intro_beats long, scale double, shortening boolean")
    edges = spark.createDataFrame([("r", 0, i, j, 0.5) for i, j in ((39, 20), (39, 30), (39, 4), (39, 44), (3, 84), (39, 80))], "run_id string, track long, i long, j long, cost double")
    steps = spark.createDataFrame([(0, i, 0.1) for i in range(100)], "track long, i long, cost double")
    seg = spark.createDataFrame([(0, b, b // 20) for b in range(100)], "track long, beat long, seg long")
    alike = spark.createDataFrame([(0, a, b, 0.25) for a in range(5) for b in range(5)], "track long, a long, b long, similarity double")
    got = {(r.i, r.j): (r.back, r.tax) for r in paths.search_edges(runs, edges, steps, seg, alike).where("j <> i + 1").collect()}
    q, section = 0.8 * 0.5 * 0.25, 1.0 * 0.75
    assert set(got) == {(39, 20), (3, 84), (39, 80)}  # under least_loop, into the intro, under the cooldown
    for key, back, tax in (((39, 20), 4.0, q * 0.1 + section), ((39, 80), 0.0, q * 0.1 + section), ((3, 84), 0.0, q + section + 3 * 0.11**2)):
        assert got[key][0] == back and abs(got[key][1] - 2 * tax) < 1e-12


def test_variations_block_one_jump_each(spark):
    rng = np.random.default_rng(11)
    n, conf = 48, (48, 120, 130, 3, 4, 3, 0)
    steps = [float(rng.uniform(0, 0.1)) for _ in range(n - 1)]
    edges = {i: [(int(j), float(rng.uniform(0.1, 0.6)), 0.0, 0.1) for j in range(0, n, 4) if abs(j - i) > 4] for i in range(3, n, 4)}
    numbers = "n_beats long, least long, most long, cooldown long, intro_beats long, outro_beats long, least_jumps long"
    runs = spark.createDataFrame([("r", 0, *conf)], f"run_id string, track long, {numbers}")
    rows = [("r", 0, i, i + 1, steps[i], 0.0, 0.0) for i in range(n - 1)] + [("r", 0, i, *e) for i, es in edges.items() for e in es]
    e = spark.createDataFrame(rows, "run_id string, track long, i long, j long, cost double, back double, tax double")
    solve = lambda blocked: plain(n, conf[2], conf[1], conf[3], conf[4], conf[5], 0, steps, {i: [x for x in es if (i, x[0]) != blocked] for i, es in edges.items()})
    base = solve(None)
    want = {base[3]: base[0]} | {p[3]: p[0] for p in map(solve, base[3])}
    got = paths.variations(paths.best_paths(runs, e), runs, e).orderBy("variation").collect()
    assert len(base[3]) >= 2 and [r.variation for r in got] == list(range(len(want)))
    assert {tuple((c.i, c.j) for c in r.cuts): round(r.cost, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    assert [r.cost for r in got] == sorted(r.cost for r in got)


def test_region_bounds_follow_downbeats_overrides_and_beats(spark):
    t = [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0]
    beats = spark.createDataFrame([(0, b, x) for b, x in enumerate(t)], "track long, beat long, t double")
    down = spark.createDataFrame([(0, 0.1), (0, 4.1), (0, 8.1)], "track long, t double")
    rows = [("flex", 3.2, 7.4, None, None), ("far", 2.5, 6.5, None, None), ("own", 3.2, 7.4, 1, 5), ("wrong", 3.2, 7.4, 5, 5), ("late", 20.0, 30.0, None, None), ("early", -9.0, -5.0, None, None), ("on", 6.0, 6.0, None, None)]
    r = spark.createDataFrame([(k, 0, *x) for k, *x in rows], "run_id string, track long, start double, end double, entry_override long, exit_override long")
    got = {x.run_id: (x.entry, x.exit) for x in paths.region_bounds(r, beats, down, 1).collect()}
    # within one beat of a downbeat its beat; else the first beat from the start and the last up to the end
    assert got == {"flex": (4, 8), "far": (3, 6), "own": (1, 5), "wrong": (4, 8), "late": (9, 10), "early": (0, 1), "on": (6, 7)}
    plain = {x.run_id: (x.entry, x.exit) for x in paths.region_bounds(r.drop("entry_override", "exit_override"), beats).collect()}
    assert plain["flex"] == (3, 7) and plain["far"] == (2, 6) and plain["own"] == plain["flex"]
