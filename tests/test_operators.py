"""Operators that SQL cannot state, by brute force and invariants, and edge cases of the others."""

import itertools
import re

import numpy as np
from pyspark.sql import functions as F

from spliceflow.operators import editing, events, paths, series, similarity, structure


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_partition_is_the_best_one(spark):
    rng = np.random.default_rng(1)
    n = 9
    sim = [(0, i, j, float(rng.uniform())) for i in range(n) for j in range(n)]
    scores = structure.block_scores(frame(spark, sim, "track long, i long, j long, v double"), frame(spark, [(0, n)], "track long, n long"))
    got = structure.optimal_partition(scores).orderBy("seg").collect()
    s = {(r.start, r.len): (r.conv, r.penalty) for r in scores.collect()}
    top = max(c for c, _ in s.values())
    worth = lambda cuts: sum(s[a, b - a][0] * (b - a) - s[a, b - a][1] * 0.1 * top for a, b in zip(cuts, cuts[1:]))
    every = ([0, *c, n] for k in range(n) for c in itertools.combinations(range(1, n), k))
    best = max((worth(c) for c in every if all(b - a >= 2 for a, b in zip(c, c[1:]))))
    assert abs(worth([0, *(r.end for r in got)]) - best) < 1e-9


def test_retarget_path_is_the_best_one(spark):
    rng = np.random.default_rng(2)
    n, edges = 12, {}
    while len(edges) < 10:
        i, j = rng.integers(0, n, 2)
        if abs(i - j) > 1:
            edges[int(i), int(j)] = float(rng.uniform(0.1, 0.9))
    step = {i: float(rng.uniform(0, 0.1)) for i in range(n - 1)}
    runs = frame(spark, [("r", 0, n, 8, 14, 2, 1.0, True)], "run_id string, track long, n_beats long, least long, most long, cooldown long, scale double, shortening boolean")
    e = frame(spark, [("r", 0, i, j, c) for (i, j), c in edges.items()], "run_id string, track long, i long, j long, cost double")
    s = frame(spark, [(0, i, c) for i, c in step.items()], "track long, i long, cost double")
    got = paths.retarget_path(runs, e, s, jumps=2).collect()
    best = np.inf

    def walk(at, length, cost, left):
        nonlocal best
        end = length + n - at
        if 8 <= end <= 14 and (n - 1 - at >= 2 or left == 2):
            best = min(best, cost + sum(step[k] for k in range(at, n - 1)))
        if left:
            for (i, j), c in edges.items():
                if i - at >= 2 and length + i - at + 1 < 14 and length + i - at + 1 + 2 <= 14:
                    walk(j, length + i - at + 1, cost + sum(step[k] for k in range(at, i)) + 0.8 * c * c + (4.0 if j < i else 0), left - 1)

    walk(0, 0, 0.0, 2)
    assert (not got and best == np.inf) or abs(got[0].cost - best) < 1e-9


def test_overlap_add_gives_the_series_back(spark):
    x = np.sin(np.arange(100) / 5)
    s = frame(spark, [(0, i, float(v)) for i, v in enumerate(x)], "track long, i long, x double")
    back = series.inverse_overlap_add(series.spectrum(series.frames(s, 16, 4), 16), 16, 4)
    got = {r.i: r.x for r in back.collect()}
    assert max(abs(got[i] - x[i]) for i in range(8, 92)) < 1e-12


def test_clusters_of_two_blocks(spark):
    rows = [(0, i, j, 1.0 if (i < 4) == (j < 4) else 0.05) for i in range(8) for j in range(8)]
    got = {r.beat: r.cluster for r in similarity.best_clusters(frame(spark, rows, "track long, i long, j long, v double")).collect()}
    assert len({got[i] for i in range(4)}) == 1 and len({got[i] for i in range(4, 8)}) == 1 and got[0] != got[5]


def test_consolidate_merges_and_caps(spark):
    rows = [(0, k, float(k * 20), float(k * 20 + 20), "abc"[k % 3]) for k in range(20)] + [(1, 0, 0.0, 30.0, "a"), (1, 1, 30.0, 33.0, "b"), (1, 2, 33.0, 60.0, "a")]
    got = structure.consolidate(frame(spark, rows, "track long, seg long, start double, end double, label string")).collect()
    assert sum(r.track == 0 for r in got) == 12
    assert [(r.start, r.end, r.label) for r in got if r.track == 1] == [(0.0, 60.0, "a")]


def test_identity_path_mixes_down_to_the_source(spark):
    s = frame(spark, [(0, i, float(i)) for i in range(20)], "track long, i long, x double")
    clips = frame(spark, [("r", 0, 0, 0, 12, 0, 0, 0), ("r", 0, 1, 12, 8, 12, 0, 0)], "run_id string, track long, clip long, first long, n long, at long, fade_in int, fade_out int")
    assert [r.x for r in editing.mixdown(clips, s).orderBy("i").collect()] == [float(i) for i in range(20)]


def test_snap_ties_go_to_the_lower_row_and_no_grid_gives_null(spark):
    left = frame(spark, [(0, 1.0), (0, 2.0), (1, 5.0)], "track long, t double")
    grid = frame(spark, [(0, 0, 0.5), (0, 1, 1.5), (0, 2, 2.0)], "track long, j long, t double").select("track", "j", "t")
    got = {(r.track, r.t): r.j for r in events.snap_nearest(left, grid).collect()}
    assert got == {(0, 1.0): 0, (0, 2.0): 2, (1, 5.0): None}


def test_empty_tables(spark):
    none = frame(spark, [], "track long, i long, x double")
    assert series.frame_rms(none, 16, 4).count() == 0
    e = none.select("track", F.col("x").alias("t"))
    assert events.estimate_tempo(e).count() == 0
    assert events.fill_gaps(e, e).count() == 0
    assert similarity.self_similarity(frame(spark, [], "track long, beat long, feat array<double>")).count() == 0


def test_queued_pairs_keep_their_distance(spark):
    rng = np.random.default_rng(6)
    n = 60
    q = {(i, j): float(rng.uniform(-0.2, 1)) for i in range(n) for j in range(n)}
    quality = frame(spark, [(0, i, j, v) for (i, j), v in q.items()], "track long, i long, j long, quality double")
    spans = {0: (0, 12), 1: (25, 35), 2: (36, 38), 3: (39, 59), 4: (45, 46)}
    blocks = frame(spark, [(0, k, a, b) for k, (a, b) in spans.items()], "track long, block long, entry long, exit long")
    order = [0, 1, 2, 3, 0, 4]
    queue = frame(spark, [("r", 0, k, b) for k, b in enumerate(order)], "run_id string, track long, pos long, block long")
    down = set(range(0, n, 2))
    downbeats = frame(spark, [(0, k) for k in down], "track long, beat long")
    count = frame(spark, [(0, n)], "track long, n long")
    got = editing.queued_compatibility(queue, blocks, quality, downbeats, window=4, drift=0.3, top=3, apart=6, separation=3, outside=5, fragment=0.2, short=3, n=count).collect()
    clip = lambda v: min(1.0, max(0.0, v))
    for a, b in zip(order, order[1:]):
        (a0, a1), (b0, b1) = spans[a], spans[b]
        la, lb, found = a1 - a0 + 1, b1 - b0 + 1, []
        brief = la <= 3 or lb <= 3
        for i in range(max(0, a0 - 5), min(a1 + 1 + 5, n - 1)):
            for j in range(max(0, b0 - 5), min(b1 + 1 + 5, n)):
                if i == j or i + 1 not in down or j not in down or (a1 + 1 != b0 and not brief and abs(j - i) < 6):
                    continue
                score = q[i, j] - 0.3 / 4 * (abs(i - a1) + abs(j - b0))
                if not brief:
                    score -= 0.2 * ((1 - clip((a1 + 1 - i) / la)) + (1 - clip((j - b0) / lb)))
                if score > 0:
                    found.append((-round(score, 9), i, j))
        want = []
        for _, i, j in sorted(found):
            if len(want) < 3 and not any(abs(i - y[0]) < 3 and abs(j - y[1]) < 3 for y in want):
                want.append((i, j))
        have = sorted((r["rank"], r.from_beat, r.to_beat) for r in got if (r.a, r.b) == (a, b))
        assert [h[1:] for h in have] == (want or [(a1, b0)]), (a, b)


def test_junctions_fall_back_to_exit_and_entry(spark):
    blocks = frame(spark, [(0, 0, 0, 9), (0, 1, 10, 19)], "track long, block long, entry long, exit long")
    quality = frame(spark, [(0, 9, 10, 0.5), (0, 8, 10, 0.55), (0, 19, 0, 0.9), (0, 10, 10, 1.0)], "track long, i long, j long, quality double")
    n = frame(spark, [(0, 20)], "track long, n long")
    got = {(r.a, r.b, r["rank"]): (r.from_beat, r.to_beat, round(r.score, 6)) for r in editing.block_compatibility(blocks, quality, window=4, drift=0.4, n=n).collect()}
    assert got == {(0, 1, 1): (9, 10, 0.5), (0, 1, 2): (8, 10, 0.45), (0, 0, 1): (9, 0, 0.0), (1, 1, 1): (19, 10, 0.0), (1, 0, 1): (19, 0, 0.0)}


def test_request_keys(spark):
    rows = [
        (0, 10.01, None, [(1, 2), (3, 4)]), (1, 9.99, {"a": 0.5, "b": 0.0}, [(3, 4), (1, 2)]), (2, 10.0, {"b": 0.0, "c": 0.0}, [(3, 4), (1, 2), (1, 2)]),
        (3, 10.06, None, [(1, 2), (3, 4)]), (4, 10.0, {"a": 0.4}, [(1, 2), (3, 4)]), (5, 10.0, {"a": 0.4 + 1e-12}, [(1, 2), (3, 4)]), (6, 10.0, {"c": 0.1}, [(1, 2), (3, 4)]), (7, 10.0, None, [(1, 2)]), (8, None, None, [(1, 2)]), (9, None, None, [(1, 2)]),
    ]
    d = frame(spark, rows, "id long, t double, w map<string,double>, blocked array<struct<i:long,j:long>>")
    keyed = editing.request_key(d, ["t"], "blocked", weights="w", defaults={"a": 0.5, "b": 0.0})
    key = {r.id: r.key for r in keyed.collect()}
    groups = [{0, 1, 2}, {3}, {4, 5}, {6}, {7}, {8, 9}]
    assert all(len({key[i] for i in g}) == 1 for g in groups) and len(set(key.values())) == len(groups)
    jobs, asked = editing.distinct_requests(keyed, "id")
    assert sorted((r.id, r.requests) for r in jobs.collect()) == [(min(g), len(g)) for g in groups]
    assert asked.join(jobs.select("key"), "key").count() == len(rows)


def test_retarget_path_with_more_than_two_jumps(spark):
    rng = np.random.default_rng(3)
    n, least, most, cool = 12, 24, 28, 2
    edges = {(i, j): float(rng.uniform(0.1, 0.9)) for i in range(n) for j in range(n) if 2 <= i - j <= 3 and rng.uniform() < 0.8}
    step = {i: float(rng.uniform(0, 0.1)) for i in range(n - 1)}
    run = lambda a, b: sum(step[k] for k in range(a, b))
    best = {}

    def walk(at, length, cost, cuts):
        if least <= length + n - at <= most and (n - 1 - at >= cool or not cuts):
            best[cuts] = min(best.get(cuts, np.inf), cost + run(at, n - 1))
        if cuts < 6:
            for (i, j), c in edges.items():
                if i - at >= cool and length + i - at + 1 + cool <= most:
                    walk(j, length + i - at + 1, cost + run(at, i) + 0.8 * c * c, cuts + 1)

    walk(0, 0, 0.0, 0)
    runs = frame(spark, [("r", 0, n, least, most, cool, 1.0, False)], "run_id string, track long, n_beats long, least long, most long, cooldown long, scale double, shortening boolean")
    e = frame(spark, [("r", 0, i, j, c) for (i, j), c in edges.items()], "run_id string, track long, i long, j long, cost double")
    s = frame(spark, [(0, i, c) for i, c in step.items()], "track long, i long, cost double")
    got = paths.retarget_path(runs, e, s).collect()
    assert min(best, key=best.get) > 2 and len(got) == 1
    assert abs(got[0].cost - min(best.values())) < 1e-9 and len(got[0].cuts) == min(best, key=best.get)


def test_clusters_cover_the_whole_track(spark, data):
    from spliceflow.queries import QUERIES
    from spliceflow.sources import tables

    want = {(r.track, r.seg) for r in tables.beats(spark, data).selectExpr("track", "floor(beat / 10) as seg").distinct().collect()}
    got = [(r.track, r.beat) for r in QUERIES["m8_cluster_segments"](spark, data).collect()]
    assert len(got) == len(want) and set(got) == want


def joins_on_the_track_alone(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if re.search(r"Join Inner, \(track#\d+L? = track#\d+L?\)$", line.strip())]


def test_find_peaks_does_not_join_whole_tracks(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(0, 12, 80).astype(float)
    s = frame(spark, [(0, i, float(v)) for i, v in enumerate(x)], "track long, i long, x double")
    found = similarity.find_peaks(s, 3.0, 1, 4.0)
    want, n = [], len(x)
    runs = [(a, b) for a in range(1, n) for b in range(a, n - 1) if len(set(x[a : b + 1])) == 1 and x[a - 1] < x[a] > x[b + 1] and x[a] >= 3]
    for i in ((a + b) // 2 for a, b in runs):
        lo = max((k for k in range(i) if x[k] > x[i]), default=-1)
        hi = min((k for k in range(i, n) if x[k] > x[i]), default=n)
        if x[i] - max(x[lo + 1 : i + 1].min(), x[i:hi].min()) >= 4:
            want.append((i, x[i]))
    assert want and sorted((r.i, r.x) for r in found.collect()) == want
    assert not joins_on_the_track_alone(found)


def test_optional_parts_of_rows(spark):
    x = frame(spark, [(t, i, 1.0 if t else 0.0) for t in range(3) for i in range(10)], "track long, i long, x double")
    b = frame(spark, [(1, 0.5), (2, 0.5), (2, 1.0)], "track long, t double")
    assert {r.track: r.reason for r in series.gate_tracks(x, 5, 0.1, b).collect()} == {0: "silent", 1: "under two beats", 2: None}
    clips = frame(spark, [("r", 0, 0, 0, 4, 0.0), ("r", 0, 1, 9, 12, 2.5), ("r", 0, 2, 2, 5, 4.0)], "run_id string, track long, clip long, start_beat long, end_beat long, timeline_start double")
    labels = frame(spark, [(0, k, "ab"[k // 6 % 2]) for k in range(13)], "track long, beat long, label string")
    q = frame(spark, [(0, 4, 9, 0.8)], "track long, i long, j long, quality double")
    got = [tuple(r) for r in editing.transition_times(clips, labels, q).orderBy("splice").collect()]
    assert got == [("r", 0, 2.5, 4, 9, "a", "b", 0.8, "great"), ("r", 1, 4.0, 12, 2, "a", "a", None, "unknown")]
    from spliceflow.sources import files

    t = frame(spark, [("r", 0, 0, 4, 9, 0.2, -3.0)], "run_id string, track long, pos long, i long, j long, cost double, energy_diff_db double")
    beats = frame(spark, [(0, k, 0.5 * k) for k in range(13)], "track long, beat long, t double")
    assert [(r.energy_diff_db, round(r.quality, 6)) for r in files.splice_rows(t, beats).collect()] == [(3.0, 0.8)]
    steps = frame(spark, [("r", 0, k, b) for k, b in enumerate((0, 1, 7, 8, 3))], "run_id string, track long, pos long, beat long")
    cand = frame(spark, [(0, 1, 7, 0.25, 441, 0.5, None)], "track long, i long, j long, cost double, lag long, waveform double, chroma double")
    got = {(r.i, r.j): (r.cost, r.lag_seconds, r.meta) for r in paths.path_transitions(steps, cand, ["waveform", "chroma"], 22050.0).collect()}
    assert got[1, 7] == (0.25, 0.02, {"waveform": 0.5}) and got[8, 3][:2] == (None, None) and got[8, 3][2] == {}


def test_beats_are_detected_in_order(spark):
    """Two tracks of beats every half second at 50 frames a second, one with downbeats every three beats, one with a single one."""
    logits = []
    for track in (0, 1):
        for i in range(1200):
            at = i % 25
            logits.append((track, i, 3.0 if at == 0 and i != 625 else -0.5 if i == 625 else -3.0 - at / 50))
    onsets = [(t, 0.5 * k + 0.01) for t in (0, 1) for k in range(48)]
    down = [(0, 1.5 * k + 0.06) for k in range(16)] + [(1, 0.0)]
    got = events.detect_beats(frame(spark, logits, "track long, i long, x double"), 50.0, frame(spark, onsets, "track long, t double"), frame(spark, down, "track long, t double")).collect()
    for track, meter in ((0, 3), (1, 4)):
        rows = sorted((r.t, r.is_downbeat) for r in got if r.track == track)
        assert len(rows) == 48 and all(abs(t - (0.5 * k + 0.01)) < 1e-9 for k, (t, _) in enumerate(rows))
        assert [k for k, (_, d) in enumerate(rows) if d] == list(range(0, 48, meter))
        assert {(round(r.tempo, 3), r.meter, r.confidence) for r in got if r.track == track} == {(120.0, meter, 1.0)}


def test_bars_without_downbeats(spark):
    beats = frame(spark, [(t, b, 0.5 * b) for t in (0, 1) for b in range(10)], "track long, beat long, t double")
    down = frame(spark, [(0, 0.6), (0, 2.6)], "track long, t double")
    rows = lambda d: sorted((r.track, r.bar, r.start, r.end) for r in d.collect())
    assert rows(structure.beats_to_bars(beats, down)) == [(0, 0, 1, 5)]
    assert rows(structure.beats_to_bars(beats, down, every=4)) == [(0, 0, 1, 5), (1, 0, 0, 4), (1, 1, 4, 8)]
