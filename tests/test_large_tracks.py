"""Tables of all pairs of long tracks: no join of such tables, none kept or sent to the driver, equal to plain loops."""

import numpy as np
import pytest

from spliceflow.operators import editing as E
from spliceflow.operators import similarity as M
from spliceflow.operators import structure as S
from spliceflow.operators import transitions as Q
from spliceflow.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def beats(spark):
    rng = np.random.default_rng(5)
    rows = [(t, b, rng.normal(size=30).tolist()) for t, n in ((0, 61), (1, 23), (2, 1)) for b in range(n)]
    return spark.createDataFrame(rows, "track long, beat long, feat array<double>"), {(t, b): np.array(v) for t, b, v in rows}


def test_continuity_of_all_pairs_joins_no_tables_of_pairs(beats):
    d, v = beats
    got = Q.mfcc_continuity(d)
    assert "Join" not in plan(got)
    m = {k: x[:13] for k, x in v.items()}
    into = lambda t, b: m[t, b] - m.get((t, b - 1), m[t, b])
    out = lambda t, b: m.get((t, b + 1), m[t, b]) - m[t, b]
    gap = lambda x, y: float(np.linalg.norm(x - y)) / 13**0.5
    want = {(t, i, j): 1 - min(1.0, (0.7 * gap(m[t, i], m[t, j]) + 0.3 * gap(into(t, i), out(t, j))) / 0.6) for t, i in v for u, j in v if u == t}
    rows = {(r.track, r.i, r.j): r.v for r in got.collect()}
    assert rows.keys() == want.keys() and all(abs(rows[k] - want[k]) < 1e-12 for k in want)


def test_blocks_of_a_queue_score_only_pairs_asked_for(spark, beats):
    assert "MapInArrow" not in plan(QUERIES["k4_queued_compatibility"](spark, "/root/testdata/sf0.001"))
    d, _ = beats
    blocks = d.selectExpr("track", "floor(beat / 10) block").distinct().selectExpr("track", "block", "block * 10 entry", "block * 10 + 9 exit")
    queue = blocks.selectExpr("track", "cast(track as string) run_id", "block pos", "block")
    down = d.where("beat % 2 = 0").select("track", "beat")
    key = lambda x: sorted((r.track, r.a, r.b, r["rank"], r.from_beat, r.to_beat, round(r.score, 9)) for r in x.collect())
    table = E.queued_compatibility(queue, blocks, Q.chroma_distance(d).selectExpr("track", "i", "j", "1 - d quality"), down, window=4)
    asked = E.queued_compatibility(queue, blocks, lambda p: Q.chroma_of_pairs(p, d).selectExpr("*", "1 - d quality"), down, window=4)
    assert key(table) == key(asked) and len(key(asked)) > 10


def test_affinity_is_made_of_products(beats):
    d, v = beats
    got = M.affinity(d)
    assert "Join" not in plan(got)
    cos = lambda x, y: float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y) + 1e-8))
    rows = {(r.track, r.i, r.j): r.v for r in got.collect()}
    assert len(rows) == 61**2 + 23**2 + 1 and all(abs(x - min(1.0, max(0.0, cos(v[t, i], v[t, j])))) < 1e-12 for (t, i, j), x in rows.items())


def test_bars_that_meet_are_averaged_where_their_cosines_arise(beats):
    d, v = beats
    got = M.bar_sequence_correlation(d.selectExpr("track", "floor(beat / 7) seg", "beat % 7 bar", "feat"), 3)
    assert "Join" not in plan(got)
    cos = lambda x, y: float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y) + 1e-8))
    want = {}
    for t, n in ((0, 61), (1, 23)):
        segs = [[b for b in range(n) if b // 7 == s] for s in range((n + 6) // 7)]
        for a in range(len(segs)):
            for b in range(a + 1, len(segs)):
                tried = []
                for f in range(-3, 4):
                    c = [cos(v[t, x], v[t, y]) for x in segs[a] for y in segs[b] if y % 7 == x % 7 + f]
                    tried += [(-round(sum(c) / len(c), 12), f)] if len(c) >= 2 else []
                if tried:
                    want[t, a, b] = (min(tried)[1], max(0.0, -min(tried)[0]))
    rows = {(r.track, r.a, r.b): (r.offset, r["corr"]) for r in got.collect()}
    assert rows.keys() == want.keys() and all(rows[k][0] == f and abs(rows[k][1] - c) < 1e-9 for k, (f, c) in want.items())


def test_silhouette_of_vectors_is_that_of_all_distances(spark, beats):
    d, _ = beats
    labels = d.selectExpr("track", "beat", "case when beat = 4 then 9 else beat % 3 end cluster")
    got = M.vector_silhouette(d, labels)
    assert plan(got).count("Join") <= 3  # labels only: to the vectors of either side, and to the sums
    want = M.silhouette(Q.F.broadcast(M.tile_scores(d, d)).withColumn("v", 1 - Q.F.col("v")), labels)
    assert {r.track: round(r.score, 9) for r in got.collect()} == {r.track: round(r.score, 9) for r in want.collect()}


def test_clusters_of_vectors_are_those_of_their_affinity(spark, beats):
    d, _ = beats
    got = M.cluster_vectors(d)
    assert "Join" not in plan(got)
    key = lambda x: sorted((r.track, r.beat, r.cluster) for r in x.collect())
    assert key(got) == key(M.best_clusters(M.affinity(d))) and len({r[0] for r in key(got)}) == 2
    assert "Join" not in plan(QUERIES["m8_cluster_segments"](spark, "/root/testdata/sf0.001"))


def test_jumps_of_sections_are_those_of_all_bars_that_meet(spark, beats):
    d, _ = beats
    bars = d.selectExpr("track", "floor(beat / 12) seg", "floor(beat % 12 / 2) bar", "beat", "feat").groupBy("track", "seg", "bar").agg(Q.F.min("beat").alias("start"), (Q.F.max("beat") + 1).alias("end"), Q.F.min_by("feat", "beat").alias("feat"))
    snippets = d.where("beat <> 20").selectExpr("track", "beat", "feat w")
    got = S.section_jumps(bars, snippets, 0.02, 4, 0.1, 3)
    assert plan(got).startswith("MapInArrow")  # nothing is joined after the strips
    want = S.repetition_jumps(M.bar_sequence_correlation(bars), bars, snippets, 0.02, 4, 0.1, 3)
    key = lambda x: sorted((r.track, r.from_beat, r.to_beat, round(r.waveform, 9), round(r["corr"], 9), r.lag, r.a, r.b, r.from_bar, r.to_bar) for r in x.select(S.JUMP).collect())
    assert key(got) == key(want) and len(key(got)) > 10


def blocks_of(d):
    return d.selectExpr("track", "floor(beat / 7) block").distinct().selectExpr("track", "block", "block * 7 entry", "block * 7 + 6 exit")


def junctions(df):
    return sorted((r.track, r.a, r.b, r["rank"], r.from_beat, r.to_beat, round(r.score, 9)) for r in df.collect())


def test_blocks_meet_in_strips_as_in_the_table_of_all_pairs(beats):
    d, _ = beats
    blocks, n = blocks_of(d), d.groupBy("track").agg(Q.F.count("*").alias("n"))
    got = E.vector_compatibility(blocks, *Q.chroma_sides(d), n, window=3, top=3)
    assert plan(got).startswith("MapInArrow")  # nothing is joined after the strips
    want = E.block_compatibility(blocks, Q.chroma_distance(d).selectExpr("track", "i", "j", "1 - d quality"), window=3, top=3, n=n)
    assert junctions(got) == junctions(want) and len(junctions(got)) > 90


def test_assembled_blocks_score_only_pairs_asked_for(spark, beats):
    assert "MapInArrow" not in plan(QUERIES["k5_assemble_blocks"](spark, "/root/testdata/sf0.001"))
    d, _ = beats
    blocks, n = blocks_of(d), d.groupBy("track").agg(Q.F.count("*").alias("n"))
    asked = blocks.selectExpr("track", "block a", "block + 2 b")
    got = E.block_compatibility(blocks, lambda p: Q.chroma_of_pairs(p, d).selectExpr("*", "1 - d quality"), window=3, top=3, n=n, asked=asked)
    every = E.block_compatibility(blocks, Q.chroma_distance(d).selectExpr("track", "i", "j", "1 - d quality"), window=3, top=3, n=n)
    assert junctions(got) == [r for r in junctions(every) if r[2] == r[1] + 2]
