"""Queries of the path operators, over the candidates of the transition queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import paths as P
from ..operators import transitions as Q
from ..sources import tables as T
from .base import BV, EV, Family, rounded
from .transitions import CD, cos

family = Family()
ED = f"""{CD}, ca AS (SELECT track, i, j, d AS cost FROM cd WHERE abs(j - i) >= 8 AND (j % 4) = 0 AND (i + 1) % 4 = 0 AND d < 1),
eg AS (SELECT track, i, j, cost FROM (SELECT *, row_number() OVER (PARTITION BY track, i ORDER BY cost, j) AS r FROM ca) WHERE r <= 4),
sq AS (SELECT track, beat AS i, least(0.3 * (1 - {cos('feat', 'nx')}), 0.12) AS cost FROM cb WHERE nx IS NOT NULL),
tk AS (SELECT track, count(*) AS n FROM bv GROUP BY 1)"""
RUNS = """rn0 AS (SELECT track || ':' || p AS run_id, track, least(greatest(n * 0.5 * f, 5), 2.5 * (n * 0.5)) AS target, n AS n_beats, n * 0.5 AS duration, e AS edit_length FROM tk, (VALUES ('a', 0.6::DOUBLE, 50.0::DOUBLE), ('b', 1.3::DOUBLE, 75.0::DOUBLE)) v(p, f, e)),
rn1 AS (SELECT *, target / greatest(1, duration) AS ratio, greatest(2, round_even(target / (duration / n_beats), 0)::BIGINT) AS target_beats, target < duration AS shortening FROM rn0),
rn2 AS (SELECT *, greatest(2, round_even(greatest(2.0::DOUBLE, 5.0::DOUBLE * greatest(0.4, least(1.0, ratio))) / (duration / n_beats), 0)::BIGINT) AS slack FROM rn1),
rn AS (SELECT *, greatest(2, target_beats - slack) AS least, least(3 * n_beats, target_beats + slack) AS most, pow(2, (edit_length - 50) / 25) AS scale, CASE WHEN target_beats / n_beats < 0.5 THEN greatest(1, floor(8 * (target_beats / n_beats))::BIGINT) ELSE 4 END * 2 AS cooldown,
 CASE WHEN ratio < 0.8 THEN greatest(4, floor(8 * greatest(0.25, ratio))::BIGINT) ELSE 8 END AS intro_beats, CASE WHEN ratio < 0.8 THEN greatest(2, floor(4 * greatest(0.3, ratio))::BIGINT) ELSE 4 END AS outro_beats, CASE WHEN target_beats / n_beats < 0.45 AND shortening THEN 1 ELSE 0 END AS least_jumps FROM rn2)"""
#: The dynamic programme itself: one iteration per length, the best state of every beat going on.
WHOLE = f"""{ED}, {RUNS}, wg AS (SELECT track, i, j, cost FROM (SELECT *, row_number() OVER (PARTITION BY track, i ORDER BY cost, j) AS r FROM ca) WHERE r <= 32 OR j % 16 = 0),
sm AS (SELECT track, i // 16 AS a, j // 16 AS b, greatest(0, 1 - avg(d)) AS similarity FROM cd GROUP BY 1, 2, 3),
ne AS (SELECT run_id, wg.i, wg.j, wg.cost AS w, CASE WHEN wg.j < wg.i AND shortening THEN 4.0 ELSE 0.0 END::DOUBLE AS back,
  (0.8::DOUBLE * greatest(0.15, least(1.0, most / n_beats)) * (wg.cost * wg.cost) * CASE WHEN (wg.i % 16 = 0 AND wg.i > 0) OR (wg.j % 16 = 0 AND wg.j > 0) THEN (1.0::DOUBLE - 0.9::DOUBLE) ELSE 1 END
   + greatest(1.0, 2.0 - most / n_beats * 2.0) * (1.0 - similarity) + CASE WHEN wg.j > wg.i + 1 AND (wg.j - wg.i) / n_beats > 0.7 THEN pow((wg.j - wg.i) / n_beats - 0.7, 2) * 3.0 ELSE 0 END) * scale AS tax, false AS plain
  FROM rn JOIN wg USING (track) LEFT JOIN sm ON sm.track = rn.track AND sm.a = wg.i // 16 AND sm.b = wg.j // 16
  WHERE wg.j <> wg.i + 1 AND wg.j < n_beats AND CASE WHEN wg.j < wg.i THEN wg.i - wg.j >= 8 AND wg.j >= intro_beats ELSE wg.j - wg.i >= cooldown END
  UNION ALL SELECT run_id, i, i + 1, cost, 0, 0, true FROM rn JOIN sq USING (track) WHERE i + 1 < n_beats),
dp(run_id, t, b, cost, since, jumps, worst, cuts) AS (SELECT run_id, 1::BIGINT, 0::BIGINT, 0.0::DOUBLE, 999::BIGINT, 0::BIGINT, 0.0::DOUBLE, []::BIGINT[] FROM rn
  UNION ALL SELECT run_id, t + 1, j, c, CASE WHEN plain THEN since + 1 ELSE 0 END, CASE WHEN plain THEN jumps ELSE jumps + 1 END, CASE WHEN plain THEN worst ELSE greatest(worst, w) END, CASE WHEN plain THEN cuts ELSE cuts || [i, j] END
  FROM (SELECT *, row_number() OVER (PARTITION BY run_id, j ORDER BY c, i) AS r FROM (
    SELECT dp.*, i, j, w, plain, CASE WHEN plain THEN cost + w + CASE WHEN t >= intro_beats AND since >= cooldown AND most / n_beats < 0.5 THEN 0.02::DOUBLE * (0.5 - most / n_beats) ELSE 0 END
      ELSE cost + w + back + tax + 8.0::DOUBLE * greatest(0, greatest(worst, w) - worst) END AS c
    FROM dp JOIN rn USING (run_id) JOIN ne ON ne.run_id = dp.run_id AND ne.i = dp.b WHERE t < most AND (plain OR (t >= intro_beats AND since >= cooldown AND jumps < 6)))) WHERE r = 1),
fin AS (SELECT dp.run_id, rn.track, t AS length, b AS "end", dp.cuts, cost + CASE WHEN b >= n_beats - outro_beats THEN -0.5::DOUBLE * hv * (1 - (n_beats - 1 - b) / outro_beats) + CASE WHEN b >= n_beats - 2 THEN -1.0 * hv ELSE 0 END ELSE least((n_beats - outro_beats - b) * 0.2::DOUBLE * hv, 8.0) END
   + abs(t - most) / most * 3.0::DOUBLE * greatest(1.0, 2 - most / n_beats) AS cost FROM dp JOIN (SELECT *, greatest(1.0, 3.0 * (1 - most / n_beats)) AS hv FROM rn) rn ON rn.run_id = dp.run_id WHERE t >= least AND jumps >= least_jumps),
bw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY cost, length, "end") AS r FROM fin) WHERE r = 1)"""
#: All paths of up to two jumps, written out.
PATHS = f"""{ED}, {RUNS}, ps AS (SELECT track, i, coalesce(sum(cost) OVER (PARTITION BY track ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM (SELECT * FROM sq UNION ALL SELECT track, n - 1, NULL FROM tk)),
el AS (SELECT e.*, x.p AS pi, y.p AS pj FROM eg e JOIN ps x ON x.track = e.track AND x.i = e.i JOIN ps y ON y.track = e.track AND y.i = e.j),
w AS (SELECT r.*, p AS pz FROM rn r JOIN ps ON ps.track = r.track AND ps.i = n_beats - 1),
c0 AS (SELECT run_id, track, pz AS cost, n_beats AS length, 0::BIGINT AS n_cuts, [0::BIGINT] AS key FROM w),
c1 AS (SELECT run_id, w.track, a.pi + 0.8::DOUBLE * scale * a.cost * a.cost + CASE WHEN a.j < a.i AND shortening THEN 4.0 ELSE 0 END + pz - a.pj AS cost, a.i + 1 + n_beats - a.j AS length, 1::BIGINT AS n_cuts, [a.i, a.j] AS key
  FROM w JOIN el a ON a.track = w.track WHERE a.i >= cooldown AND n_beats - 1 - a.j >= cooldown AND a.i + 1 < most AND a.i + 1 + cooldown <= most),
c2 AS (SELECT run_id, w.track, a.pi + 0.8::DOUBLE * scale * a.cost * a.cost + CASE WHEN a.j < a.i AND shortening THEN 4.0 ELSE 0 END + b.pi - a.pj + 0.8::DOUBLE * scale * b.cost * b.cost + CASE WHEN b.j < b.i AND shortening THEN 4.0 ELSE 0 END + pz - b.pj AS cost,
  a.i + 1 + b.i - a.j + 1 + n_beats - b.j AS length, 2::BIGINT AS n_cuts, [a.i, a.j, b.i, b.j] AS key FROM w JOIN el a ON a.track = w.track JOIN el b ON b.track = w.track
  WHERE a.i >= cooldown AND b.i - a.j >= cooldown AND n_beats - 1 - b.j >= cooldown AND a.i + 1 < most AND a.i + 1 + cooldown <= most AND a.i + 1 + b.i - a.j + 1 < most AND a.i + 1 + b.i - a.j + 1 + cooldown <= most),
al AS (SELECT c.* FROM (SELECT * FROM c0 UNION ALL SELECT * FROM c1 UNION ALL SELECT * FROM c2) c JOIN rn USING (run_id) WHERE c.length BETWEEN least AND most),
bp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY cost, length, key) AS r FROM al) WHERE r = 1)"""


def _inputs(spark, d, most=4):
    b = T.beats(spark, d)
    tracks = b.groupBy("track").agg(F.count("*").alias("n_beats")).withColumn("duration", F.col("n_beats") * 0.5)
    kinds = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(f).alias("f"), F.lit(e).alias("e")) for p, f, e in (("a", 0.6, 50.0), ("b", 1.3, 75.0))))
    asked = tracks.withColumn("k", F.explode(kinds)).select(F.concat_ws(":", "track", "k.p").alias("run_id"), "track", (F.col("duration") * F.col("k.f")).alias("target"), F.col("k.e").alias("edit_length"))
    runs = P.retarget_params(asked, tracks, meter=2)
    down = b.where("beat % 4 = 0").select("track", "beat")
    edges = P.path_edges(Q.downbeat_nearest(b, down, most, 8).withColumnRenamed("d", "cost"), down, meter=2, most=most)
    return b, runs, edges, Q.sequential_cost(b)


def _of_runs(runs, edges):
    return edges.join(runs.select("run_id", "track"), "track")


def _paths(spark, d):
    """With the limits that PATHS states: 2 jumps, 4 edges a beat."""
    _, runs, edges, steps = _inputs(spark, d)
    return P.retarget_path(runs, _of_runs(runs, edges), steps, jumps=2), runs, edges, steps


def _searched(spark, d):
    """Runs, edges and what each step adds, with the limits of the reference: 6 jumps, 32 edges a beat, and segment boundaries."""
    b, runs, _, steps = _inputs(spark, d)
    down, bound = b.where("beat % 4 = 0").select("track", "beat"), b.where("beat % 16 = 0").select("track", "beat")
    seg = lambda c: F.floor(F.col(c) / 16)
    edges = P.path_edges(Q.downbeat_nearest(b, down, 32, 8, bound).withColumnRenamed("d", "cost"), down, meter=2, boundaries=bound)
    alike = Q.chroma_means(b, 16).select("track", "a", "b", F.greatest(F.lit(0.0), 1 - F.col("d")).alias("similarity"))
    searched = P.search_edges(runs, _of_runs(runs, edges), steps, b.select("track", "beat", seg("beat").alias("seg")), alike, least_loop=8)
    return runs, edges, searched


def _whole(spark, d):
    runs, edges, searched = _searched(spark, d)
    return P.best_paths(runs, searched), runs, edges, searched


@family(f"WITH {ED} SELECT track, i, j, round(cost, 6) AS cost FROM eg")
def p1_path_edges(spark, d):
    return rounded(_inputs(spark, d)[2])


@family(f"WITH {ED}, {RUNS} SELECT run_id, target_beats, least, most, cooldown, intro_beats::BIGINT AS intro_beats, outro_beats::BIGINT AS outro_beats, least_jumps::BIGINT AS least_jumps, shortening, round(ratio, 6) AS ratio, round(scale, 6) AS scale FROM rn")
def p2_retarget_params(spark, d):
    return rounded(_inputs(spark, d)[1].select("run_id", "target_beats", "least", "most", "cooldown", "intro_beats", "outro_beats", "least_jumps", "shortening", "ratio", "scale"))


@family(f"WITH {PATHS} SELECT run_id, track, round(cost, 6) AS cost, length, n_cuts FROM bp")
def p4_retarget_path(spark, d):
    p = _paths(spark, d)[0]
    return rounded(p.select("run_id", "track", "cost", "length", F.size("cuts").cast("long").alias("n_cuts")))


@family(f"""WITH {PATHS}, f AS (SELECT run_id, track, cost, length, false AS fallback FROM bp UNION ALL SELECT run_id, track, 0, least(target_beats, n_beats), true FROM rn WHERE run_id NOT IN (SELECT run_id FROM bp))
SELECT run_id, track, round(cost, 6) AS cost, length, fallback FROM f""")
def p6_path_fallback(spark, d):
    p, runs, _, _ = _paths(spark, d)
    return rounded(P.with_fallback(p, runs).select("run_id", "track", "cost", "length", "fallback"))


@family(f"""WITH {PATHS}, k AS (SELECT run_id, track, unnest(generate_series(1, n_cuts)) AS k, key FROM bp WHERE n_cuts > 0), t AS (SELECT run_id, track, k, key[2 * k - 1] AS i, key[2 * k] AS j, CASE WHEN k = 1 THEN key[1] ELSE key[1] + 1 + key[3] - key[2] END AS pos FROM k)
SELECT t.run_id, t.track, t.pos, t.i, t.j, round(eg.cost, 6) AS cost FROM t LEFT JOIN eg ON eg.track = t.track AND eg.i = t.i AND eg.j = t.j WHERE t.j <> t.i + 1""")
def p7_path_transitions(spark, d):
    p, runs, edges, _ = _paths(spark, d)
    return rounded(P.path_transitions(P.path_steps(P.with_fallback(p, runs), runs), edges))


@family(f"WITH {ED}, {RUNS} SELECT run_id, eg.track, i, j, round(cost, 6) AS cost FROM eg JOIN rn USING (track) WHERE NOT (run_id LIKE '%a' AND j % 8 = 0)")
def p8_block_transitions(spark, d):
    _, runs, edges, _ = _inputs(spark, d)
    e = _of_runs(runs, edges)
    return rounded(P.without_blocked(e, e.where("run_id like '%a' and j % 8 = 0").select("run_id", "i", "j")).select("run_id", "track", "i", "j", "cost"))


@family(f"WITH RECURSIVE {WHOLE} SELECT run_id, track, round(cost, 6) AS cost, length, \"end\", (len(cuts) // 2)::BIGINT AS n_cuts FROM bw")
def p4_whole_path(spark, d):
    p = _whole(spark, d)[0]
    return rounded(p.select("run_id", "track", "cost", "length", "end", F.size("cuts").cast("long").alias("n_cuts")))


@family(f"""WITH RECURSIVE {WHOLE} SELECT run_id, track, round(cost, 6) AS cost, length, false AS fallback FROM bw UNION ALL SELECT run_id, track, 0, least(target_beats, n_beats), true FROM rn WHERE run_id NOT IN (SELECT run_id FROM bw)""")
def p6_whole_fallback(spark, d):
    p, runs, _, _ = _whole(spark, d)
    return rounded(P.with_fallback(p, runs).select("run_id", "track", "cost", "length", "fallback"))


@family(f"""WITH RECURSIVE {WHOLE}, k AS (SELECT run_id, track, cuts, unnest(generate_series(1, len(cuts) // 2)) AS k FROM bw WHERE len(cuts) > 0),
t AS (SELECT run_id, track, k, cuts[2 * k - 1] AS i, cuts[2 * k] AS j, sum(cuts[2 * k - 1] + 1 - CASE WHEN k = 1 THEN 0 ELSE cuts[2 * k - 2] END) OVER (PARTITION BY run_id ORDER BY k) - 1 AS pos FROM k)
SELECT t.run_id, t.track, pos::BIGINT AS pos, t.i, t.j, round(wg.cost, 6) AS cost FROM t LEFT JOIN wg ON wg.track = t.track AND wg.i = t.i AND wg.j = t.j""")
def p7_whole_transitions(spark, d):
    p, runs, edges, _ = _whole(spark, d)
    return rounded(P.path_transitions(P.path_steps(P.with_fallback(p, runs), runs), edges))


@family()
def p9_variations(spark, d):
    p, runs, _, searched = _whole(spark, d)
    return P.variations(p, runs, searched).select("run_id", "variation", F.round("cost", 6).alias("cost"), "length", F.to_json("cuts").alias("cuts"))


#: The region search: two runs a track inside [4, n - 4), longer and shorter; one iteration per length.
RGN = f"""{CD}, tk AS (SELECT track, count(*) AS n FROM bv GROUP BY 1), sq AS (SELECT track, beat AS i, least(0.3 * (1 - {cos('feat', 'nx')}), 0.12) AS cost FROM cb WHERE nx IS NOT NULL),
rr AS (SELECT track || ':' || p AS run_id, track, 4::BIGINT AS entry, n - 4 AS ex, floor((n - 8) * f)::BIGINT AS target, f > 1 AS extending, 1.0::DOUBLE AS scale FROM tk, (VALUES ('x', 1.4::DOUBLE), ('y', 0.6::DOUBLE)) v(p, f)),
rw AS (SELECT *, greatest(2, target - 4) AS least, target + 4 AS most, ex - entry AS n FROM rr),
rc AS (SELECT run_id, i - entry AS i, j - entry AS j, d + CASE WHEN j < i AND extending THEN 0.5 ELSE 0 END::DOUBLE AS w FROM rw JOIN cd USING (track) WHERE i >= entry AND i < ex AND j >= entry AND j < ex AND j <> i AND j <> i + 1 AND abs(j - i) >= 4 AND d <= 0.55),
re AS (SELECT run_id, i, j, w, 0.8::DOUBLE * least(1.0, w * 2.0) AS tax, false AS plain FROM (SELECT *, row_number() OVER (PARTITION BY run_id, i ORDER BY w, j) AS r FROM rc) WHERE r <= 8 UNION ALL SELECT run_id, i - entry, i + 1 - entry, cost, 0, true FROM rw JOIN sq USING (track) WHERE i >= entry AND i + 1 < ex),
dp(run_id, t, b, cost, since, cuts) AS (SELECT run_id, 1::BIGINT, 0::BIGINT, 0.0::DOUBLE, 999::BIGINT, []::BIGINT[] FROM rw
  UNION ALL SELECT run_id, t + 1, j, c, CASE WHEN plain THEN since + 1 ELSE 0 END, CASE WHEN plain THEN cuts ELSE cuts || [i, j] END FROM (SELECT *, row_number() OVER (PARTITION BY run_id, j ORDER BY c, i) AS r FROM (
    SELECT dp.*, i, j, plain, CASE WHEN plain THEN cost + w ELSE cost + w + tax END AS c FROM dp JOIN rw USING (run_id) JOIN re ON re.run_id = dp.run_id AND re.i = dp.b WHERE t < most AND (plain OR since >= 8))) WHERE r = 1),
rf AS (SELECT dp.run_id, track, t AS length, b + entry AS "end", cuts, entry, cost + CASE WHEN n - 1 - b > 1 THEN (n - 1 - b) * 3.0 ELSE 0 END + abs(t - target) / target * 3.0::DOUBLE AS cost FROM dp JOIN rw USING (run_id) WHERE t >= least),
rb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY cost, length, "end") AS r FROM rf) WHERE r = 1)"""


def _region(spark, d):
    b = T.beats(spark, d)
    n = b.groupBy("track").agg(F.count("*").alias("n"))
    kinds = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(f).alias("f")) for p, f in (("x", 1.4), ("y", 0.6))))
    target = F.floor((F.col("n") - 8) * F.col("k.f"))
    runs = n.withColumn("k", F.explode(kinds)).select(F.concat_ws(":", "track", "k.p").alias("run_id"), "track", F.lit(4).cast("long").alias("entry"), (F.col("n") - 4).alias("exit"), target.alias("target_beats"), F.greatest(F.lit(2).cast("long"), target - 4).alias("least"), (target + 4).alias("most"), (F.col("k.f") > 1).alias("extending"), F.lit(1.0).alias("scale"))
    cand = Q.region_nearest(b, runs.select("run_id", "track", "entry", "exit"), 8)
    searched = P.region_edges(runs, cand.select("run_id", "track", "i", "j", "cost"), Q.sequential_cost(b))
    return P.region_paths(runs, searched), runs, searched


@family(f"WITH RECURSIVE {RGN} SELECT run_id, track, round(cost, 6) AS cost, length, \"end\", (len(cuts) // 2)::BIGINT AS n_cuts, coalesce(list_sum(cuts) + entry * len(cuts), 0)::BIGINT AS cut_beats FROM rb")
def p11_region_path(spark, d):
    p = _region(spark, d)[0]
    return rounded(p.select("run_id", "track", "cost", "length", "end", F.size("cuts").cast("long").alias("n_cuts"), F.aggregate("cuts", F.lit(0).cast("long"), lambda a, c: a + c["i"] + c["j"]).alias("cut_beats")))


@family()
def p14_region_variations(spark, d):
    p, runs, searched = _region(spark, d)
    return P.variations(p, runs, searched, P.region_paths).select("run_id", "variation", F.round("cost", 6).alias("cost"), "length", F.to_json("cuts").alias("cuts"))


REG = f"""{EV}, rg AS (SELECT track, 'r' || track AS run_id, 20.3::DOUBLE AS s, 50.7::DOUBLE AS e FROM (SELECT DISTINCT track FROM ev)),
ds AS (SELECT run_id, rg.track, i, row_number() OVER (PARTITION BY run_id ORDER BY abs(t - s), i) AS rs, row_number() OVER (PARTITION BY run_id ORDER BY abs(t - e), i) AS re FROM rg JOIN ev USING (track)),
bd AS (SELECT run_id, track, max(CASE WHEN rs = 1 THEN i END) AS entry, greatest(max(CASE WHEN rs = 1 THEN i END) + 1, least(max(CASE WHEN re = 1 THEN i END), count(*) - 1)) AS "exit" FROM ds GROUP BY 1, 2)"""


def _bounds(spark, d):
    e = T.events(spark, d)
    r = e.select("track").distinct().select("track", F.concat(F.lit("r"), F.col("track").cast("string")).alias("run_id"), F.lit(20.3).alias("start"), F.lit(50.7).alias("end"))
    return P.region_bounds(r, e.select("track", F.col("i").alias("beat"), "t"))


@family(f"WITH {REG} SELECT run_id, track, entry, \"exit\" FROM bd")
def p10_region_bounds(spark, d):
    return _bounds(spark, d)


@family(f"""WITH {EV}, sz AS (SELECT track, count(*) AS n, (max(t) - min(t)) / greatest(count(*) - 1, 1) AS m FROM ev GROUP BY 1), rg AS (SELECT track, n, m, unnest([20.3, 50.7]::DOUBLE[]) AS x, unnest(['s', 'e']) AS side FROM sz),
dn AS (SELECT rg.track, side, ev.t, row_number() OVER (PARTITION BY rg.track, side ORDER BY abs(ev.t - rg.x), ev.t) AS r, abs(ev.t - rg.x) <= 2 * m AS ok FROM rg JOIN ev ON ev.track = rg.track AND label = 'view'),
bt AS (SELECT dn.track, side, ev.i, row_number() OVER (PARTITION BY dn.track, side ORDER BY abs(ev.t - dn.t), ev.i) AS r FROM dn JOIN ev ON ev.track = dn.track WHERE dn.r = 1 AND ok),
fb AS (SELECT rg.track, side, CASE side WHEN 's' THEN least(count(*) FILTER (ev.t < rg.x), any_value(n) - 1) ELSE greatest(0, count(*) FILTER (ev.t <= rg.x) - 1) END AS i FROM rg JOIN ev ON ev.track = rg.track GROUP BY 1, 2),
z AS (SELECT fb.track, max(CASE WHEN fb.side = 's' THEN coalesce(bt.i, fb.i) END) AS en, max(CASE WHEN fb.side = 'e' THEN coalesce(bt.i, fb.i) END) AS ex FROM fb LEFT JOIN bt ON bt.track = fb.track AND bt.side = fb.side AND bt.r = 1 GROUP BY 1)
SELECT 'r' || track AS run_id, track, CASE WHEN track % 7 = 0 THEN 3 ELSE en END AS entry, greatest(CASE WHEN track % 7 = 0 THEN 3 ELSE en END + 1, least(CASE WHEN track % 7 = 0 THEN 9 ELSE ex END, n - 1)) AS "exit" FROM z JOIN sz USING (track)""")
def p10_flexible_bounds(spark, d):
    """Ends at the nearest 'view' within two mean beats; every seventh track has bounds of its own."""
    e = T.events(spark, d)
    own = lambda v: F.when(F.col("track") % 7 == 0, F.lit(v).cast("long"))
    r = e.select("track").distinct().select("track", F.concat(F.lit("r"), F.col("track").cast("string")).alias("run_id"), F.lit(20.3).alias("start"), F.lit(50.7).alias("end"), own(3).alias("entry_override"), own(9).alias("exit_override"))
    return P.region_bounds(r, e.select("track", F.col("i").alias("beat"), "t"), e.where("label = 'view'").select("track", "t"), 2)


@family(f"""WITH {ED}, bd AS (SELECT 'r' || track AS run_id, track, 4::BIGINT AS entry, n - 4 AS x, n + 20 AS target FROM tk), ps AS (SELECT track, i, coalesce(sum(cost) OVER (PARTITION BY track ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM sq),
c AS (SELECT run_id, bd.track, e.i, e.j, e.cost, a.p AS pi, b.p AS pj, x - entry AS plain, target, e.i - e.j + 1 AS size, unnest([-1, 0, 1]) AS k FROM bd JOIN eg e ON e.track = bd.track AND e.j < e.i AND e.j >= entry AND e.i < x JOIN ps a ON a.track = e.track AND a.i = e.i JOIN ps b ON b.track = e.track AND b.i = e.j),
n AS (SELECT *, (round((target - plain) / size) + k)::BIGINT AS times FROM c), l AS (SELECT *, plain + times * size AS length, round(times * (cost + pi - pj) + abs(plain + times * size - target) / target, 9) AS tc FROM n WHERE times >= 1)
SELECT run_id, track, i, j, times, length, round(tc, 6) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY tc, i, j, times) AS r FROM l) WHERE r = 1""")
def p12_region_loop(spark, d):
    b, _, edges, steps = _inputs(spark, d)
    n = b.groupBy("track").agg(F.count("*").alias("n"))
    bounds = n.select(F.concat(F.lit("r"), F.col("track").cast("string")).alias("run_id"), "track", F.lit(4).cast("long").alias("entry"), (F.col("n") - 4).alias("exit"), (F.col("n") + 20).alias("target_beats"))
    return rounded(P.region_loop(bounds, edges, steps))


@family(f"WITH {REG}, t AS (SELECT *, unnest(generate_series(0, 99)) AS pos FROM bd WHERE \"exit\" > entry) SELECT run_id, track, pos, entry + pos % (\"exit\" - entry) AS beat FROM t")
def p13_tiled(spark, d):
    return P.tiled(_bounds(spark, d).where("exit > entry").withColumn("target_beats", F.lit(100).cast("long")))


@family(f"""WITH {BV}, c AS (SELECT track, count(*) AS n FROM bv GROUP BY 1), s AS (SELECT track, beat AS pos, beat FROM bv JOIN c USING (track) WHERE beat < n * 3 // 5 AND track % 2 = 0 OR beat < n // 5), m AS (SELECT track, max(pos) AS pos FROM s GROUP BY 1),
a AS (SELECT m.track, pos, unnest(generate_series(1, least(greatest(4, floor(0.2::DOUBLE * (pos + 1))::BIGINT), n - 1 - pos))) AS k FROM m JOIN c USING (track) WHERE pos >= n * 2 // 5)
SELECT 'r' || track AS run_id, track, pos, beat FROM s UNION ALL SELECT 'r' || track, track, pos + k, pos + k FROM a""")
def p5_extend_outro(spark, d):
    b = T.beats(spark, d)
    name = F.concat(F.lit("r"), F.col("track").cast("string")).alias("run_id")
    n = b.groupBy("track").agg(F.count("*").alias("n_beats"))
    steps = b.join(n, "track").where("(beat < n_beats * 3 div 5 and track % 2 = 0) or beat < n_beats div 5").select(name, "track", F.col("beat").alias("pos"), "beat")
    runs = n.select(name, "n_beats", F.expr("n_beats * 2 div 5").alias("outro_start"))
    return P.extend_outro(steps, runs)
