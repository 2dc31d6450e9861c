"""Queries of the structure operators: runs of one event type are segments, embeddings are bars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import beats as B
from ..operators import similarity as M
from ..operators import structure as S
from ..sources import tables as T
from .base import BV, EV, SG, Family, rounded
from .similarity import REC, SSM, _rec
from .transitions import cos

family = Family()
ISL = f"{EV}, nw AS (SELECT *, sum(n) OVER (PARTITION BY track ORDER BY i) - 1 AS seg FROM (SELECT *, CASE WHEN label = lag(label) OVER (PARTITION BY track ORDER BY i) THEN 0 ELSE 1 END AS n FROM ev)), sgs AS (SELECT track, seg::BIGINT AS seg, any_value(label) AS label, min(t) AS start, max(t) AS last, count(*) AS n, avg(x) AS energy FROM nw GROUP BY 1, 2)"
SEGS = f"{ISL}, sg AS (SELECT track, seg, label, start, coalesce(lead(start) OVER (PARTITION BY track ORDER BY seg), last + 1) AS stop, energy, n FROM sgs)"
SV = f"{BV}, lo AS (SELECT track, beat // 6 AS seg, unnest(generate_series(1, 64)) AS k, unnest(feat) AS v FROM bv), mv AS (SELECT track, seg, k, avg(v) AS v FROM lo GROUP BY 1, 2, 3), sv AS (SELECT track, seg, 'L' || (seg % 3) AS label, list(v ORDER BY k) AS feat FROM mv GROUP BY 1, 2)"


def _segments(spark, d):
    """(track, seg, label, start, end, energy, n) of runs of one event type."""
    e = T.events(spark, d)
    s = S.islands(e, "t", "label").withColumnRenamed("first", "start")
    w = Window.partitionBy("track").orderBy("seg")
    s = s.withColumn("end", F.coalesce(F.lead("start").over(w), F.col("last") + 1)).drop("last")
    m = S.beats_to_segments(e.select("track", F.col("i").alias("beat"), "t"), s).join(e.select("track", F.col("i").alias("beat"), "x"), ["track", "beat"])
    return s.join(m.groupBy("track", "seg").agg(F.avg("x").alias("energy")), ["track", "seg"])


def _vectors(spark, d):
    b = T.beats(spark, d).withColumn("seg", F.floor(F.col("beat") / 6))
    return B.vector_mean(b, ["track", "seg"]).withColumn("label", F.concat(F.lit("L"), (F.col("seg") % 3).cast("string")))


@family(f"WITH {SEGS} SELECT track, seg, label, n, round(start, 6) AS start, round(stop, 6) AS \"end\", round(energy, 6) AS energy FROM sg")
def t9_segment_energy(spark, d):
    return rounded(_segments(spark, d).select("track", "seg", "label", "n", "start", "end", "energy"))


@family(f"""WITH {EV}, dist AS (SELECT g.track, g.t, e.i, row_number() OVER (PARTITION BY g.track, g.t ORDER BY abs(e.t - g.t), e.i) AS r FROM ev g JOIN ev e USING (track) WHERE g.label = 'view' AND e.label <> 'view'),
q AS (SELECT DISTINCT track, i FROM dist WHERE r = 1), z AS (SELECT track, row_number() OVER (PARTITION BY track ORDER BY i) - 1 AS bar, i AS start, lead(i) OVER (PARTITION BY track ORDER BY i) AS stop FROM q)
SELECT track, bar, start, stop AS "end" FROM z WHERE stop IS NOT NULL""")
def t1_beats_to_bars(spark, d):
    e = T.events(spark, d)
    return S.beats_to_bars(e.where("label <> 'view'").select("track", F.col("i").alias("beat"), "t"), e.where("label = 'view'").select("track", "t"))


@family(f"WITH {SSM} SELECT track, i, j, round(v, 6) AS v FROM ssm")
def t3_bar_similarity(spark, d):
    return rounded(M.self_similarity(T.beats(spark, d)))


BLK = f"""{SSM}, cn AS (SELECT track, count(*) AS n FROM bv GROUP BY 1), st AS (SELECT track, n, unnest(generate_series(0, n - 1)) AS start FROM cn), bl AS (SELECT track, start, unnest(generate_series(1, least(16, n - start))) AS len FROM st),
sc AS (SELECT b.track, b.start, b.len, coalesce(sum(2 * v), 0) / (b.len * b.len) AS conv FROM bl b LEFT JOIN ssm s ON s.track = b.track AND s.i >= b.start AND s.j > s.i AND s.j - s.i <= 7 AND s.j < b.start + b.len GROUP BY 1, 2, 3)"""


def _scores(spark, d):
    b = T.beats(spark, d)
    return S.block_scores(M.self_similarity(b), b.groupBy("track").agg(F.count("*").alias("n")))


@family(f"WITH {BLK} SELECT track, start, len, round(conv, 6) AS conv, CASE WHEN len = 8 THEN 0 WHEN len % 4 = 0 THEN 0.25 WHEN len % 2 = 0 THEN 0.5 ELSE 1 END::DOUBLE AS penalty FROM sc")
def t4_block_scores(spark, d):
    return rounded(_scores(spark, d))


@family()
def t5_optimal_partition(spark, d):
    return S.optimal_partition(_scores(spark, d))


@family(f"""WITH RECURSIVE {SV}, lk AS (SELECT a.track, a.seg AS i, list(b.seg) AS js FROM sv a JOIN sv b ON a.track = b.track AND b.seg < a.seg WHERE {cos('a.feat', 'b.feat')} >= 0.2 GROUP BY 1, 2),
sj AS (SELECT sv.track, sv.seg, coalesce(js, []) AS js FROM sv LEFT JOIN lk ON lk.track = sv.track AND lk.i = sv.seg),
f(track, seg, founders, cluster) AS (SELECT track, 0::BIGINT, [0::BIGINT], 0::BIGINT FROM sv WHERE seg = 0
UNION ALL SELECT track, n, CASE WHEN g IS NULL THEN list_append(founders, n) ELSE founders END, coalesce(g, n) FROM (SELECT f.track, founders, s.seg AS n, list_filter(founders, lambda x: list_contains(js, x))[1] AS g FROM f JOIN sj s ON s.track = f.track AND s.seg = f.seg + 1))
SELECT track, seg, cluster FROM f""")
def t6_group_similar(spark, d):
    return S.group_similar(_vectors(spark, d), 0.2)


@family(f"""WITH {SEGS}, s AS (SELECT *, seg % 4 + CASE WHEN seg = 5 THEN 10 ELSE 0 END AS cluster FROM sg), c AS (SELECT track, cluster, count(*) AS m, avg(energy) AS e FROM s GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY track, m >= 2 ORDER BY round(e, 9) DESC, cluster) AS r FROM c)
SELECT track, seg, cluster, CASE WHEN m < 2 THEN 'bridge' WHEN r = 1 THEN 'chorus' WHEN r = 2 THEN 'verse' ELSE 'bridge' END AS label FROM s JOIN r USING (track, cluster)""")
def t7_label_by_repetition(spark, d):
    s = _segments(spark, d).drop("label").withColumn("cluster", F.col("seg") % 4 + F.when(F.col("seg") == 5, 10).otherwise(0))
    return S.label_by_repetition(s).select("track", "seg", "cluster", "label")


@family(f"""WITH {SEGS}, w AS (SELECT *, min(seg) OVER (PARTITION BY track) AS lo, max(seg) OVER (PARTITION BY track) AS hi, 92.0::DOUBLE AS du FROM sg)
SELECT track, seg, CASE WHEN hi - lo < 2 THEN label WHEN seg = lo AND stop <= 0.2 * du THEN 'intro' WHEN seg = hi AND start >= 0.8 * du THEN 'outro' ELSE label END AS label FROM w""")
def t8_mark_intro_outro(spark, d):
    s = _segments(spark, d)
    return S.mark_intro_outro(s, s.select("track").distinct().withColumn("duration", F.lit(92.0))).select("track", "seg", "label")


MRG = f"{SEGS}, cf AS (SELECT track, seg, start, stop, CASE WHEN label IN ('view', 'click') THEN 'a' ELSE 'b' END AS label, n / 10.0::DOUBLE AS confidence FROM sg)"


def _coarse(spark, d):
    return _segments(spark, d).select("track", "seg", "start", "end", F.when(F.col("label").isin("view", "click"), "a").otherwise("b").alias("label"), (F.col("n") / F.lit(10.0)).alias("confidence"))


@family(f"""WITH RECURSIVE {MRG}, g AS (SELECT *, sum(nw) OVER (PARTITION BY track ORDER BY seg) AS g FROM (SELECT *, CASE WHEN label = lag(label) OVER (PARTITION BY track ORDER BY seg) THEN 0 ELSE 1 END AS nw FROM cf)),
f(track, seg, g, c) AS (SELECT track, seg, g, confidence FROM g WHERE nw = 1 UNION ALL SELECT g.track, g.seg, g.g, (c + g.confidence) / 2 FROM f JOIN g ON g.track = f.track AND g.seg = f.seg + 1 AND g.g = f.g)
SELECT g.track, (g.g - 1)::BIGINT AS seg, any_value(label) AS label, round(min(start), 6) AS start, round(max(stop), 6) AS "end", round(arg_max(f.c, g.seg), 6) AS confidence FROM g JOIN f USING (track, seg) GROUP BY 1, g.g""")
def t10_merge_same_label(spark, d):
    return rounded(S.merge_same_label(_coarse(spark, d)))


@family()
def t11_consolidate(spark, d):
    s = _coarse(spark, d)
    return rounded(S.consolidate(s, s.groupBy("track").agg((F.max("end") + 0.5).alias("duration")), least=1.5, bridge=1.0).drop("cluster"))


@family(f"""WITH {SG}, s AS (SELECT track, i // 50 AS seg, i // 50 * 50 AS lo, least(i // 50 * 50 + 50, n) AS hi FROM sg JOIN nn USING (track) GROUP BY ALL),
e AS (SELECT s.track, seg, lo, hi, sqrt(avg(x * x)) AS energy FROM s JOIN sg ON sg.track = s.track AND i >= lo AND i < hi GROUP BY 1, 2, 3, 4)
SELECT e.track, seg, round(energy, 6) AS energy, round(CASE WHEN seg = 0 THEN 0.8 ELSE least(1, 0.5 + 0.5 * sg.x) END::DOUBLE, 9) AS confidence FROM e JOIN nn ON nn.track = e.track JOIN sg ON sg.track = e.track AND sg.i = least(lo // 2, n - 1)""")
def t9_segment_rms(spark, d):
    """Segments of half a second of a hundred samples; a frame of novelty every fiftieth of a second."""
    x = T.signal(spark, d)
    seg = x.groupBy("track", F.floor(F.col("i") / 50).alias("seg")).agg(F.lit(1).alias("one")).select("track", "seg", (F.col("seg") * F.lit(0.5)).alias("start"), ((F.col("seg") + 1) * F.lit(0.5)).alias("end"))
    e = S.segment_rms(x, seg, 100.0)
    c = S.boundary_confidence(e, x.select("track", "i", F.col("x").alias("novelty")), 0.02)
    return c.select("track", "seg", F.round("energy", 6).alias("energy"), F.round("confidence", 9).alias("confidence"))


@family(f"""WITH {SEGS}, c AS (SELECT track, count(*) AS n FROM sg GROUP BY 1), v AS (SELECT track, count(*) AS m FROM ev WHERE label = 'view' GROUP BY 1), g AS (SELECT track FROM c JOIN v USING (track) WHERE n >= 55 AND m >= 12)
SELECT track, seg, label, CASE WHEN track IN (SELECT track FROM g) THEN 'bars' ELSE 'novelty' END AS path FROM sg WHERE track IN (SELECT track FROM g) OR seg % 2 = 0""")
def t12_choose_structure(spark, d):
    s = _segments(spark, d).select("track", "seg", "label")
    v = T.events(spark, d).where("label = 'view'").groupBy("track").agg(F.count("*").alias("n"))
    return S.choose_structure(s, s.where("seg % 2 = 0"), v, 12, 55)


@family(f"""WITH {SEGS}, z AS (SELECT e.track, e.i AS beat, max(s.seg) AS seg FROM ev e LEFT JOIN sg s ON s.track = e.track AND s.seg % 2 = 0 AND s.start <= e.t AND e.t < s.stop GROUP BY 1, 2)
SELECT z.track, z.beat, z.seg, sg.label, coalesce(z.seg IS DISTINCT FROM lag(z.seg) OVER (PARTITION BY z.track ORDER BY beat) AND beat > 0, false) AS boundary FROM z LEFT JOIN sg USING (track, seg)""")
def t13_beats_to_segments(spark, d):
    e = T.events(spark, d).select("track", F.col("i").alias("beat"), "t")
    return S.beats_to_segments(e, _segments(spark, d).where("seg % 2 = 0"))


@family(f"WITH {SV} SELECT a.track, a.seg AS i, b.seg AS j, round(0.6 * CASE WHEN a.seg = b.seg THEN 1 WHEN a.label = b.label THEN 0.9 ELSE 0.2 END + 0.4 * greatest(0, {cos('a.feat', 'b.feat')}), 6) AS v FROM sv a JOIN sv b USING (track)")
def t14_segment_similarity(spark, d):
    return rounded(S.segment_similarity(_vectors(spark, d)))


@family("SELECT o_orderkey AS track, CASE left(o_orderpriority, 1) WHEN '1' THEN 1.0 WHEN '2' THEN 0.8 WHEN '3' THEN 0.6 ELSE 0.5 END::DOUBLE AS importance FROM orders")
def t15_importance(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("track"), F.substring("o_orderpriority", 1, 1).alias("label"))
    w = spark.createDataFrame([("1", 1.0), ("2", 0.8), ("3", 0.6)], "label string, weight double")
    return S.importance(o, w).select("track", "importance")


@family(f"WITH {ISL}, s AS (SELECT * FROM sgs WHERE label <> 'error') SELECT a.track, a.seg AS a, b.seg AS b, a.label FROM s a JOIN s b ON a.track = b.track AND a.label = b.label AND a.seg < b.seg")
def t16_repeated_sections(spark, d):
    s = S.islands(T.events(spark, d), "i", "label").withColumn("label", F.initcap("label"))
    return S.repeated_sections(s, ("error",))


_WF = "greatest(0, max(list_inner_product(wa[5:60], wb[5 + lag:60 + lag]) / sqrt(list_inner_product(wa[5:60], wa[5:60]) * list_inner_product(wb[5 + lag:60 + lag], wb[5 + lag:60 + lag]) + 1e-20)))"


@family(f"""WITH {BV}, br AS (SELECT track, beat // 16 AS seg, (beat % 16) // 2 AS bar, min(beat) AS start, max(beat) AS stop, list_transform(range(64), lambda k: list_avg(list_transform(list(feat), lambda f: f[k + 1]))) AS feat FROM bv GROUP BY 1, 2, 3),
o AS (SELECT *, unnest(generate_series(-4, 4)) AS f FROM br), m AS (SELECT a.track, a.seg AS sa, b.seg AS sb, f, avg({cos('a.feat', 'b.feat')}) AS c FROM o a JOIN br b ON a.track = b.track AND b.bar = a.bar + f AND a.seg < b.seg GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY track, sa, sb ORDER BY round(c, 12) DESC, f) AS r FROM m), cn AS (SELECT track, seg, count(*) AS n FROM br GROUP BY 1, 2),
p AS (SELECT x.track, sa, sb, x.bar AS ba, y.bar AS bb, x.start AS fa, x.stop AS la, y.start AS fb, y.stop AS lb, greatest(0, c) AS c FROM r JOIN br x ON x.track = r.track AND x.seg = sa JOIN br y ON y.track = r.track AND y.seg = sb AND y.bar = x.bar + f
  JOIN cn na ON na.track = r.track AND na.seg = sa JOIN cn nb ON nb.track = r.track AND nb.seg = sb WHERE r = 1 AND c >= 0.05 AND x.bar < least(na.n, nb.n) AND abs(y.start - x.stop) >= 8),
l1 AS (SELECT p.*, x.feat AS wa, y.feat AS wb, unnest(generate_series(-4, 4)) AS lag FROM p JOIN bv x ON x.track = p.track AND x.beat = la + 1 JOIN bv y ON y.track = p.track AND y.beat = fb),
g1 AS (SELECT track, sa, sb, ba, bb, fa, la, fb, lb, c, {_WF} AS wf FROM l1 GROUP BY ALL HAVING wf >= 0.1),
l2 AS (SELECT g1.* EXCLUDE (wf), x.feat AS wa, y.feat AS wb, unnest(generate_series(-4, 4)) AS lag FROM g1 JOIN bv x ON x.track = g1.track AND x.beat = lb + 1 JOIN bv y ON y.track = g1.track AND y.beat = fa WHERE abs(fa - lb) >= 8),
g2 AS (SELECT track, sa, sb, ba, bb, fa, la, fb, lb, c, {_WF} AS wf FROM l2 GROUP BY ALL HAVING wf >= 0.1),
j AS (SELECT track, la AS from_beat, fb AS to_beat, wf, c, sa AS a, sb AS b, ba AS from_bar, bb AS to_bar FROM g1 UNION ALL SELECT track, lb, fa, wf, c, sb, sa, bb, ba FROM g2)
SELECT track, from_beat, to_beat, round(wf, 6) AS waveform, round(c, 6) AS corr, a, b, from_bar, to_bar, row_number() OVER (PARTITION BY track ORDER BY round(wf, 9) DESC, round(c, 9) DESC, from_beat, to_beat)::INTEGER AS rank FROM j""")
def t17_repetition_jumps(spark, d):
    """Segments of sixteen beats, bars of two."""
    b = T.beats(spark, d)
    of = b.select("track", F.floor(F.col("beat") / 16).alias("seg"), F.floor(F.col("beat") % 16 / 2).alias("bar"), "beat", F.posexplode("feat").alias("k", "v"))
    of = of.groupBy("track", "seg", "bar", "k").agg(F.avg("v").alias("v"), F.min("beat").alias("start"), (F.max("beat") + 1).alias("end"))
    bars = of.groupBy("track", "seg", "bar", "start", "end").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda p: p["v"]).alias("feat"))
    j = S.section_jumps(bars, b.select("track", "beat", F.col("feat").alias("w")), 0.05, least_wave=0.1, max_lag=4)
    j = j.withColumns({"by_wave": F.round("waveform", 9), "by_corr": F.round("corr", 9)})
    return rounded(S.ranked(j, "by_wave", "by_corr").drop("by_wave", "by_corr", "lag"))


@family(f"""WITH {REC}, cn AS (SELECT track, count(*) AS n FROM bv GROUP BY 1), sm AS (SELECT track, beat // 25 AS seg, min(beat) AS st, max(beat) + 1 AS en FROM bv GROUP BY 1, 2),
x AS (SELECT rec.track, seg, st, en, j - i AS lag, sum(v) AS v FROM rec JOIN sm ON sm.track = rec.track AND i >= st AND j < en WHERE en - st >= 16 AND j - i >= 4 AND (j - i) % 2 = 0 GROUP BY 1, 2, 3, 4, 5),
m AS (SELECT *, v / (en - st - lag) AS mean FROM x WHERE en - st - lag >= 4 AND lag < (en - st) // 2 * 2), r AS (SELECT *, row_number() OVER (PARTITION BY track, seg ORDER BY lag) AS r FROM m WHERE mean >= 0.01),
f AS (SELECT r.*, st + (en - st - lag) // 2 AS fb, st + (en - st - lag) // 2 + lag AS tb, n FROM r JOIN cn USING (track) WHERE r <= 5 AND mean >= 0.02),
l AS (SELECT f.*, x.feat AS wa, y.feat AS wb, unnest(generate_series(-4, 4)) AS sh FROM f JOIN bv x ON x.track = f.track AND x.beat = least(fb + 1, n - 1) + 1 JOIN bv y ON y.track = f.track AND y.beat = tb)
SELECT track, seg, lag, round(mean, 6) AS mean, fb AS from_beat, tb AS to_beat, round({_WF.replace('lag', 'sh')}, 6) AS waveform FROM l GROUP BY track, seg, lag, mean, fb, tb HAVING {_WF.replace('lag', 'sh')} >= 0.06""")
def t18_within_section_jumps(spark, d):
    b = T.beats(spark, d)
    seg = b.groupBy("track", F.floor(F.col("beat") / 25).alias("seg")).agg(F.min("beat").alias("start"), (F.max("beat") + 1).alias("end"))
    n = b.groupBy("track").agg(F.count("*").alias("n"))
    return rounded(S.within_section_jumps(_rec(spark, d), seg, 2, n, b.select("track", "beat", F.col("feat").alias("w")), 0.01, jump_least=0.02, least_wave=0.08, max_lag=4))


@family(f"""WITH {BV}, bt AS (SELECT track, beat, beat * 0.5::DOUBLE AS t, feat FROM bv), db AS (SELECT track, beat * 0.5 + 0.1 AS t FROM bv WHERE beat % 4 = 1), ds AS (SELECT d.track, b.beat, row_number() OVER (PARTITION BY d.track, d.t ORDER BY abs(b.t - d.t), b.beat) AS r FROM db d JOIN bt b USING (track)),
st AS (SELECT DISTINCT track, beat FROM ds WHERE r = 1), cn AS (SELECT track, count(*) AS n FROM bv GROUP BY 1), bs AS (SELECT track, row_number() OVER w - 1 AS bar, beat AS start, beat * 0.5 AS t, coalesce(lead(beat) OVER w, n) AS stop FROM st JOIN cn USING (track) WINDOW w AS (PARTITION BY track ORDER BY beat))
SELECT bs.track, bar, start, t::DOUBLE AS t, (stop * 0.5)::DOUBLE AS end_t, round(avg(feat[1]), 6) AS first, round(avg(feat[64]), 6) AS last FROM bs JOIN bv ON bv.track = bs.track AND beat >= start AND beat < stop GROUP BY ALL""")
def t2_bar_features(spark, d):
    b = T.beats(spark, d).withColumn("t", F.col("beat") * 0.5)
    f = S.bar_features(b, b.where("beat % 4 = 1").select("track", (F.col("t") + 0.1).alias("t")))
    return rounded(f.select("track", "bar", "start", "t", "end_t", F.get("feat", F.lit(0)).alias("first"), F.get("feat", F.lit(63)).alias("last")))
