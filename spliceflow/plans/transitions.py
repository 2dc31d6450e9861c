"""Queries of the transition operators, over embeddings as beats."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import beats as B
from ..operators import transitions as Q
from ..sources import tables as T
from ..sources.files import component_rows
from .base import BV, EV, Family, rounded
from .similarity import REC, _rec

family = Family()
CB = f"{BV}, cb AS (SELECT track, beat, feat[46:57] AS feat, lead(feat[46:57]) OVER w AS nx, feat AS full, lead(feat) OVER w AS fnx, feat[1:13] AS mf, lag(feat[1:13]) OVER w AS mp, lead(feat[1:13]) OVER w AS mn FROM bv WINDOW w AS (PARTITION BY track ORDER BY beat))"


def cos(a: str, b: str) -> str:
    return f"(list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})) + 1e-8))"


JOIN = "FROM cb a JOIN cb b USING (track)"
CD = f"{CB}, cd AS (SELECT a.track, a.beat AS i, b.beat AS j, coalesce(1 - {cos('a.nx', 'b.feat')}, 1) AS d {JOIN})"
TOPK = f"{CD}, tk AS (SELECT track, i, j, d FROM (SELECT *, row_number() OVER (PARTITION BY track, i ORDER BY d, j) AS r FROM cd WHERE abs(j - i) > 3) WHERE r <= 6 AND d <= 0.9)"
CTX = f"""lo AS (SELECT track, beat, unnest(generate_series(1, 64)) AS k, unnest(feat) AS v FROM bv),
cx AS (SELECT track, beat, k, avg(v) OVER (PARTITION BY track, k ORDER BY beat ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS b, avg(v) OVER (PARTITION BY track, k ORDER BY beat ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS a FROM lo),
cv AS (SELECT track, beat, list(b ORDER BY k) AS before, list(a ORDER BY k) AS after FROM cx GROUP BY 1, 2)"""
EDB = "ed AS (SELECT track, beat, 20 * log10(greatest(abs(feat[1]), 1e-6)) AS db_start, 20 * log10(greatest(abs(feat[64]), 1e-6)) AS db_end FROM bv)"
GATE = f"{TOPK}, {EDB}, gt AS (SELECT tk.*, y.db_start - x.db_end AS e FROM tk JOIN ed x ON x.track = tk.track AND x.beat = i JOIN ed y ON y.track = tk.track AND y.beat = j WHERE abs(y.db_start - x.db_end) <= 8)"


def _b(spark, d):
    return T.beats(spark, d)


def _edge_db(b):
    at = lambda k: B.edge_db(F.abs(F.get("feat", F.lit(k))))
    return b.select("track", "beat", at(0).alias("db_start"), at(63).alias("db_end"))


def _snippets(b):
    return b.select("track", "beat", F.col("feat").alias("w"))


@family(f"WITH {CD} SELECT track, i, j, round(d, 6) AS d FROM cd")
def q1_chroma_distance(spark, d):
    return rounded(Q.chroma_distance(_b(spark, d)))


@family(f"WITH {CB} SELECT a.track, a.beat AS i, b.beat AS j, round(coalesce({cos('a.fnx', 'b.full')}, 0), 6) + 0 AS v {JOIN}")
def q2_successor_similarity(spark, d):
    return rounded(Q.successor_similarity(_b(spark, d)))


@family(f"WITH {CB} SELECT a.track, a.beat AS i, b.beat AS j, round({cos('a.full[33:64]', 'b.full[1:32]')}, 6) + 0 AS v {JOIN}")
def q3_edge_similarity(spark, d):
    b = _b(spark, d)
    return rounded(Q.edge_similarity(b.select("track", "beat", F.slice("feat", 1, 32).alias("edge_start"), F.slice("feat", 33, 32).alias("edge_end"))))


@family(f"WITH {BV}, {CTX} SELECT a.track, a.beat AS i, b.beat AS j, round({cos('a.before', 'b.after')}, 6) + 0 AS v FROM cv a JOIN cv b USING (track)")
def q4_context_similarity(spark, d):
    return rounded(Q.context_similarity(_b(spark, d)))


@family(f"""WITH {CB}, s AS (SELECT track, beat AS i, 1 - {cos('feat', 'nx')} AS d FROM cb WHERE nx IS NOT NULL)
SELECT track, i, round(CASE WHEN (i + 1) % 8 = 0 THEN 0.5 * d + 0.1 ELSE least(0.3 * d, 0.12) END, 6) AS cost FROM s""")
def q5_sequential_cost(spark, d):
    return rounded(Q.sequential_cost(_b(spark, d).withColumn("begins", F.col("beat") % 8 == 0), "begins"))


@family(f"WITH {TOPK} SELECT track, i, j, round(d, 6) AS d FROM tk")
def q7_candidates_topk(spark, d):
    return rounded(Q.chroma_nearest(_b(spark, d), 6, 3, 0.9))


@family(f"WITH {GATE} SELECT track, i, j, round(d, 6) AS d, round(e, 6) + 0 AS energy_diff_db FROM gt")
def q8_gate_energy(spark, d):
    b = _b(spark, d)
    return rounded(Q.gate_energy(Q.chroma_nearest(b, 6, 3, 0.9), _edge_db(b)).select("track", "i", "j", "d", "energy_diff_db"))


WAVE = f"""{GATE}, lg AS (SELECT gt.*, x.feat AS wa, y.feat AS wb, unnest(generate_series(-4, 4)) AS lag FROM gt JOIN bv x ON x.track = gt.track AND x.beat = i + 1 JOIN bv y ON y.track = gt.track AND y.beat = j),
tr AS (SELECT track, i, j, d, e, lag, list_inner_product(wa[5:60], wb[5 + lag:60 + lag]) / sqrt(list_inner_product(wa[5:60], wa[5:60]) * list_inner_product(wb[5 + lag:60 + lag], wb[5 + lag:60 + lag]) + 1e-20) AS c FROM lg),
wf AS (SELECT track, i, j, d, e, lag, greatest(0, c) AS waveform FROM (SELECT *, row_number() OVER (PARTITION BY track, i, j ORDER BY c DESC, lag) AS r FROM tr) WHERE r = 1)"""


@family(f"WITH {WAVE} SELECT track, i, j, lag, round(waveform, 6) AS waveform FROM wf")
def q9_waveform_similarity(spark, d):
    b = _b(spark, d)
    c = Q.gate_energy(Q.chroma_nearest(b, 6, 3, 0.9), _edge_db(b))
    return rounded(Q.waveform_similarity(c, _snippets(b), 4).select("track", "i", "j", "lag", "waveform"))


@family(f"""WITH {EV}, p AS (SELECT track, i, x / 100 AS w, lag(x, 1, 50) OVER o / 100 AS b, (i * 37 % 100) / 100.0::DOUBLE AS vi, (i * 53 % 100) / 100.0::DOUBLE AS vj FROM ev WINDOW o AS (PARTITION BY track ORDER BY i))
SELECT track, i, round(CASE WHEN vi > 0.35 AND vj > 0.35 AND w - b > 0.3 THEN b ELSE w END, 6) AS guarded FROM p""")
def q10_deceptive_guard(spark, d):
    e = T.events(spark, d)
    band = F.lag("x", 1, 50.0).over(Window.partitionBy("track").orderBy("i")) / 100
    e = e.withColumns({"w": F.col("x") / 100, "b": band, "vi": (F.col("i") * 37 % 100) / F.lit(100.0), "vj": (F.col("i") * 53 % 100) / F.lit(100.0)})
    return rounded(e.select("track", "i", Q.deceptive_guard(F.col("w"), F.col("b"), F.col("vi"), F.col("vj")).alias("guarded")))


#: Steps into and out of each beat, and the continuity of a pair of rows of dl.
DL = "dl AS (SELECT track, beat, mf, list_transform(list_zip(mf, coalesce(mp, mf)), lambda p: p[1] - p[2]) AS leaving, list_transform(list_zip(coalesce(mn, mf), mf), lambda p: p[1] - p[2]) AS landing FROM cb)"
MFCC = "(1 - least(1, (0.7 * list_distance({a}.mf, {b}.mf) + 0.3 * list_distance({a}.leaving, {b}.landing)) / sqrt(13.0::DOUBLE) / 0.6))"


@family(f"WITH {CB}, {DL} SELECT a.track, a.beat AS i, b.beat AS j, round({MFCC.format(a='a', b='b')}, 6) AS v FROM dl a JOIN dl b USING (track)")
def q12_mfcc_continuity(spark, d):
    return rounded(Q.mfcc_continuity(_b(spark, d)))


@family(f"WITH {CB} SELECT a.track, a.beat AS i, b.beat AS j, round(greatest(0, least(1, {cos('a.feat', 'b.feat')})), 6) AS v {JOIN}")
def q13_chroma_continuity(spark, d):
    return rounded(Q.chroma_continuity(_b(spark, d)))


@family(f"""WITH {EV}, g AS (SELECT *, lead(t) OVER w - t AS gi, t - lag(t) OVER w AS gj FROM ev WINDOW w AS (PARTITION BY track ORDER BY i)), z AS (SELECT *, abs(ln(gi / gj)) AS z FROM g)
SELECT track, i, round(CASE WHEN x / 100 < 0.1 THEN 1 ELSE 0.5 + 0.5 * greatest(0.3, least(1, x / 200)) END, 6) AS vocal,
  round(CASE WHEN z <= 0.05 THEN 1 WHEN z >= 0.15 THEN 0 ELSE (0.15 - z) / (0.15 - 0.05) END, 6) AS interval, round(greatest(0, 1 - abs(x - 50) / 25.0::DOUBLE), 6) AS energy,
  round(CASE WHEN x / 100 < 0.25 THEN 0.12 * (0.25 - x / 100) / 0.25 ELSE 0 END, 6) AS onset_penalty, round(CASE WHEN i % 3 = 0 THEN 0 WHEN abs(i - 40) >= 32 THEN 0 WHEN i % 3 = 1 THEN 0.12 ELSE 0.25 END::DOUBLE, 6) AS span_penalty,
  round(0.1 * (x / 500) + 0.3 * greatest(0, x / 100 - 0.4), 6) AS vocal_penalty, CASE WHEN x / 100 > 0.7 THEN 'great' WHEN x / 100 >= 0.5 THEN 'good' ELSE 'weak' END AS bucket FROM z WHERE gi > 0 AND gj > 0""")
def q11_scalar_signals(spark, d):
    w = Window.partitionBy("track").orderBy("i")
    e = T.events(spark, d).withColumns({"gi": F.lead("t").over(w) - F.col("t"), "gj": F.col("t") - F.lag("t").over(w)}).where("gi > 0 and gj > 0")
    x = F.col("x") / 100
    same = F.when(F.col("i") % 3 == 1, True).when(F.col("i") % 3 == 2, False)
    return rounded(e.select(
        "track", "i", Q.vocal_continuity(x, F.lit(0.3), F.least(F.lit(1.0), F.col("x") / 200)).alias("vocal"), Q.interval_continuity(F.col("gi"), F.col("gj")).alias("interval"), Q.linear_match(F.col("x"), F.lit(50.0), 25.0).alias("energy"),
        Q.onset_penalty(x).alias("onset_penalty"), Q.span_penalty(F.col("i"), F.lit(40), same).alias("span_penalty"), Q.vocal_penalty(F.col("x") / 500, x, F.lit(1.0)).alias("vocal_penalty"), Q.quality_bucket(x).alias("bucket"),
    ))


SIG = f"{EV}, sg AS (SELECT track, i, CASE WHEN i % 5 > 0 THEN least(1, x / 100) END AS waveform, CASE WHEN i % 7 > 0 THEN (i * 37 % 100) / 100.0::DOUBLE END AS sequential, (i * 53 % 100) / 100.0::DOUBLE AS energy FROM ev)"


def _signals(spark, d):
    e = T.events(spark, d)
    return e.select("track", "i", F.when(F.col("i") % 5 > 0, F.least(F.lit(1.0), F.col("x") / 100)).alias("waveform"), F.when(F.col("i") % 7 > 0, (F.col("i") * 37 % 100) / F.lit(100.0)).alias("sequential"), ((F.col("i") * 53 % 100) / F.lit(100.0)).alias("energy"))


def _hm(*w: float) -> str:
    n = ("waveform", "sequential", "energy")
    there = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {x} END" for c, x in zip(n, w))
    return f"(({there})::DOUBLE / ({' + '.join(f'CASE WHEN {c} IS NULL THEN 0 ELSE {x} / greatest({c}, 0.001) END' for c, x in zip(n, w))}))"


@family(f"""WITH {SIG} SELECT track, i, round({_hm(0.5, 0.2, 0.07)}, 6) AS harmonic,
  round(least(1, CASE WHEN waveform IS NULL OR sequential IS NULL THEN (coalesce(0.5 * waveform, 0) + coalesce(0.2 * sequential, 0) + 0.07 * energy) / ((CASE WHEN waveform IS NULL THEN 0 ELSE 0.5 END + CASE WHEN sequential IS NULL THEN 0 ELSE 0.2 END + 0.07)::DOUBLE / 0.77)
    ELSE 0.5 * waveform + 0.2 * sequential + 0.07 * energy END), 6) AS arithmetic FROM sg""")
def q16_quality_score(spark, d):
    w = {"waveform": 0.5, "sequential": 0.2, "energy": 0.07}
    return rounded(_signals(spark, d).select("track", "i", Q.quality_score(w).alias("harmonic"), Q.quality_score(w, harmonic=False).alias("arithmetic")))


@family(f"""WITH {WAVE}, {CTX}, {DL}, c AS (SELECT wf.*, greatest(0, least(1, {cos('n.feat', 'y.feat')})) AS successor, greatest(0, least(1, {cos('p.before', 'q.after')})) AS context,
  {MFCC.format(a='dx', b='dy')} AS mfcc, greatest(0, 1 - abs(e) / 8.0::DOUBLE) AS energy FROM wf JOIN bv x ON x.track = wf.track AND x.beat = i JOIN bv n ON n.track = wf.track AND n.beat = i + 1
  JOIN bv y ON y.track = wf.track AND y.beat = j JOIN cv p ON p.track = wf.track AND p.beat = i JOIN cv q ON q.track = wf.track AND q.beat = j JOIN dl dx ON dx.track = wf.track AND dx.beat = i JOIN dl dy ON dy.track = wf.track AND dy.beat = j),
s AS (SELECT *, (successor + context + mfcc) / 3 AS sequential FROM c), z AS (SELECT *, greatest(0, least(1, (0.5::DOUBLE + 0.2 + 0.07) / (0.5 / greatest(waveform, 0.001) + 0.2 / greatest(sequential, 0.001) + 0.07 / greatest(energy, 0.001)))) AS quality FROM s)
SELECT track, i, j, round(d, 6) AS d, round(waveform, 6) AS waveform, round(sequential, 6) AS sequential, round(energy, 6) AS energy, round(quality, 6) AS quality, round(1 - quality, 6) AS cost FROM z WHERE quality >= 0.2""")
def q20_transition_candidates(spark, d):
    b = _b(spark, d)
    c = Q.transition_candidates(b, _snippets(b), _edge_db(b), k=6, guard=3, most=0.9, weights={"waveform": 0.5, "sequential": 0.2, "energy": 0.07})
    return rounded(c.select("track", "i", "j", "d", "waveform", "sequential", "energy", "quality", "cost"))


def _marks(b):
    """Labels and segments of eight beats, bars of four; level, brightness, onsets and voice from single dimensions."""
    at = lambda k: F.abs(F.get("feat", F.lit(k)))
    seg = F.floor(F.col("beat") / 8)
    return b.select("track", "beat", (seg % 3).cast("string").alias("label"), seg.alias("seg"), at(1).alias("rms"), at(4).alias("centroid"), at(3).alias("onset"), (2 * at(2)).alias("vocal"), (F.col("beat") % 4 == 3).alias("leads_in"), (F.col("beat") % 4 == 0).alias("is_downbeat"), F.least(F.lit(1.0), at(6)).alias("vocal_onset"), F.least(F.lit(1.0), at(5)).alias("vocal_release"))


def _full(spark, d):
    b = _b(spark, d)
    alike = Q.chroma_distance(b).groupBy("track", F.floor(F.col("i") / 8).alias("a"), F.floor(F.col("j") / 8).alias("b")).agg((1 - F.avg("d")).alias("similarity"))
    band = b.select("track", "beat", F.slice("feat", 33, 32).alias("w"))
    weights = Q.DEFAULT_WEIGHTS | {"vocal": 0.1}
    return Q.transition_candidates(b, _snippets(b), _edge_db(b), k=6, guard=3, most=0.9, floor=0.05, weights=weights, marks=_marks(b), alike=alike, band_snippets=band)


#: The seven signals of the default weights and the vocal one, the guard by half of each snippet, then the span, vocal and onset penalties.
FULL = f"""{WAVE}, {CTX}, {DL}, lb AS (SELECT gt.*, x.feat[33:64] AS wa, y.feat[33:64] AS wb, unnest(generate_series(-4, 4)) AS lag FROM gt JOIN bv x ON x.track = gt.track AND x.beat = i + 1 JOIN bv y ON y.track = gt.track AND y.beat = j),
bd AS (SELECT track, i, j, greatest(0, max(list_inner_product(wa[5:28], wb[5 + lag:28 + lag]) / sqrt(list_inner_product(wa[5:28], wa[5:28]) * list_inner_product(wb[5 + lag:28 + lag], wb[5 + lag:28 + lag]) + 1e-20))) AS band FROM lb GROUP BY 1, 2, 3), tv AS (SELECT track, max(2 * abs(feat[3])) AS mv, max(abs(feat[4])) AS mo FROM bv GROUP BY 1), sl AS (SELECT track, i // 8 AS a, j // 8 AS b, 1 - avg(d) AS section FROM cd GROUP BY 1, 2, 3),
c AS (SELECT wf.* EXCLUDE (waveform), CASE WHEN mv >= 0.75 AND 2 * abs(x.feat[3]) > 0.35 AND 2 * abs(y.feat[3]) > 0.35 AND waveform - band > 0.3 THEN band ELSE waveform END AS waveform, greatest(0, least(1, {cos('n.feat', 'y.feat')})) AS successor, greatest(0, least(1, {cos('p.before', 'q.after')})) AS context, {MFCC.format(a='dx', b='dy')} AS mfcc,
  CASE WHEN wf.i // 8 % 3 = wf.j // 8 % 3 THEN 1.0 ELSE 0 END::DOUBLE AS label, section, CASE WHEN wf.i % 4 = 3 AND wf.j % 4 = 0 THEN 1.0 ELSE 0 END::DOUBLE AS bar_align, greatest(0, 1 - abs(abs(x.feat[2]) - abs(y.feat[2])) / 0.2::DOUBLE) AS energy, greatest(0, 1 - abs(e) / 12.0::DOUBLE) AS edge_energy,
  CASE WHEN 2 * greatest(abs(x.feat[3]), abs(y.feat[3])) < 0.1 THEN 1 ELSE 0.5 + 0.5 * least(1, greatest(abs(x.feat[6]), abs(y.feat[7]))) END::DOUBLE AS vocal, greatest(0, 1 - abs(abs(x.feat[5]) - abs(y.feat[5])) / 0.2::DOUBLE) AS centroid, 1 - abs(abs(x.feat[4]) / mo - abs(y.feat[4]) / mo) AS transient, 2 * abs(x.feat[3]) AS vi, 2 * abs(y.feat[3]) AS vj, mv, abs(y.feat[4]) AS oj
  FROM wf JOIN bv x ON x.track = wf.track AND x.beat = wf.i JOIN bv n ON n.track = wf.track AND n.beat = wf.i + 1 JOIN bv y ON y.track = wf.track AND y.beat = wf.j JOIN cv p ON p.track = wf.track AND p.beat = wf.i JOIN cv q ON q.track = wf.track AND q.beat = wf.j
  JOIN tv ON tv.track = wf.track JOIN bd ON bd.track = wf.track AND bd.i = wf.i AND bd.j = wf.j JOIN dl dx ON dx.track = wf.track AND dx.beat = wf.i JOIN dl dy ON dy.track = wf.track AND dy.beat = wf.j LEFT JOIN sl ON sl.track = wf.track AND sl.a = wf.i // 8 AND sl.b = wf.j // 8),
s AS (SELECT *, (successor + context + mfcc) / 3 AS sequential FROM c),
h AS (SELECT *, greatest(0, least(1, 1.1::DOUBLE / (0.5 / greatest(waveform, 0.001) + 0.1 / greatest(vocal, 0.001) + 0.2 / greatest(sequential, 0.001) + 0.15 / greatest(transient, 0.001) + 0.07 / greatest(energy, 0.001) + 0.04 / greatest(edge_energy, 0.001) + 0.02 / greatest(bar_align, 0.001) + 0.02 / greatest(centroid, 0.001)))) AS q0 FROM s),
h1 AS (SELECT *, greatest(0, q0 - CASE WHEN abs(j - i) >= 32 THEN 0 WHEN label >= 0.5 THEN 0.12 ELSE 0.25 END) AS q1 FROM h), h2 AS (SELECT *, greatest(0, q1 - CASE WHEN mv >= 0.75 THEN 0.1 * least(1, 2 * abs(vi - vj)) + 0.3 * greatest(0, least(vi, vj) - 0.4) ELSE 0 END) AS q2 FROM h1),
full_c AS (SELECT *, greatest(0, q2 - CASE WHEN oj < 0.25 THEN 0.12 * (0.25 - oj) / 0.25 ELSE 0 END) AS quality FROM h2)"""


@family(f"WITH {FULL} SELECT track, i, j, label, bar_align, round(section, 6) AS section, round(energy, 6) AS energy, round(edge_energy, 6) AS edge_energy, round(centroid, 6) AS centroid, round(transient, 6) AS transient, round(waveform, 6) AS waveform, round(vocal, 6) AS vocal, round(mfcc, 6) AS mfcc, round(sequential, 6) AS sequential, round(quality, 6) AS quality, round(1 - quality, 6) AS cost FROM full_c WHERE quality >= 0.05")
def q20_full_candidates(spark, d):
    return rounded(_full(spark, d).select("track", "i", "j", "label", "bar_align", "section", "energy", "edge_energy", "centroid", "transient", "waveform", "vocal", "mfcc", "sequential", "quality", "cost"))


#: The same inside [5, 40) of every track, on its own beats alone.
REGION = f"""{CB}, {DL}, {EDB}, rb AS (SELECT track, beat, feat[46:57] AS ch, lead(feat[46:57]) OVER w AS nc, feat AS f, lead(feat) OVER w AS nf FROM bv WHERE beat >= 5 AND beat < 40 WINDOW w AS (PARTITION BY track ORDER BY beat)),
rl AS (SELECT track, beat, unnest(generate_series(1, 64)) AS k, unnest(f) AS v FROM rb), rx AS (SELECT track, beat, k, avg(v) OVER (PARTITION BY track, k ORDER BY beat ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS b, avg(v) OVER (PARTITION BY track, k ORDER BY beat ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS a FROM rl),
rv AS (SELECT track, beat, list(b ORDER BY k) AS before, list(a ORDER BY k) AS after FROM rx GROUP BY 1, 2),
rp AS (SELECT a.track, a.beat AS i, b.beat AS j, 1 - {cos('a.nc', 'b.ch')} AS d, greatest(0, least(1, {cos('a.nf', 'b.f')})) AS successor, y.db_start - x.db_end AS e FROM rb a JOIN rb b ON a.track = b.track AND abs(a.beat - b.beat) >= 4 JOIN ed x ON x.track = a.track AND x.beat = a.beat JOIN ed y ON y.track = a.track AND y.beat = b.beat WHERE a.nc IS NOT NULL AND abs(y.db_start - x.db_end) <= 8),
rt AS (SELECT rp.*, x.feat AS wa, y.feat AS wb, unnest(generate_series(-4, 4)) AS lag FROM rp JOIN bv x ON x.track = rp.track AND x.beat = i + 1 JOIN bv y ON y.track = rp.track AND y.beat = j WHERE d <= 0.9),
rw AS (SELECT track, i, j, d, successor, e, greatest(0, max(list_inner_product(wa[5:60], wb[5 + lag:60 + lag]) / sqrt(list_inner_product(wa[5:60], wa[5:60]) * list_inner_product(wb[5 + lag:60 + lag], wb[5 + lag:60 + lag]) + 1e-20))) AS waveform FROM rt GROUP BY ALL),
tv AS (SELECT track, max(2 * abs(feat[3])) AS mv, max(abs(feat[4])) AS mo FROM bv GROUP BY 1),
c AS (SELECT rw.*, greatest(0, least(1, {cos('p.before', 'q.after')})) AS context, {MFCC.format(a='dx', b='dy')} AS mfcc, CASE WHEN rw.i // 8 % 3 = rw.j // 8 % 3 THEN 1.0 ELSE 0 END::DOUBLE AS label, CASE WHEN rw.i % 4 = 3 AND rw.j % 4 = 0 THEN 1.0 ELSE 0 END::DOUBLE AS bar_align,
  greatest(0, 1 - abs(abs(x.feat[2]) - abs(y.feat[2])) / 0.2::DOUBLE) AS energy, greatest(0, 1 - abs(e) / 12.0::DOUBLE) AS edge_energy, greatest(0, 1 - abs(abs(x.feat[5]) - abs(y.feat[5])) / 0.2::DOUBLE) AS centroid, 1 - abs(abs(x.feat[4]) / mo - abs(y.feat[4]) / mo) AS transient, 2 * abs(x.feat[3]) AS vi, 2 * abs(y.feat[3]) AS vj, mv, abs(y.feat[4]) AS oj
  FROM rw JOIN bv x ON x.track = rw.track AND x.beat = rw.i JOIN bv y ON y.track = rw.track AND y.beat = rw.j JOIN rv p ON p.track = rw.track AND p.beat = rw.i JOIN rv q ON q.track = rw.track AND q.beat = rw.j JOIN dl dx ON dx.track = rw.track AND dx.beat = rw.i JOIN dl dy ON dy.track = rw.track AND dy.beat = rw.j JOIN tv ON tv.track = rw.track),
s AS (SELECT *, (successor + context + mfcc) / 3 AS sequential, 0.9 * label + 0.1 AS section FROM c),
h AS (SELECT *, greatest(0, least(1, 1.1::DOUBLE / (0.5 / greatest(waveform, 0.001) + 0.1 / greatest(section, 0.001) + 0.2 / greatest(sequential, 0.001) + 0.15 / greatest(transient, 0.001) + 0.07 / greatest(energy, 0.001) + 0.04 / greatest(edge_energy, 0.001) + 0.02 / greatest(bar_align, 0.001) + 0.02 / greatest(centroid, 0.001)))) AS q0 FROM s),
h1 AS (SELECT *, greatest(0, q0 - CASE WHEN abs(j - i) < 32 AND label < 0.5 THEN 0.125 ELSE 0 END) AS q1 FROM h), h2 AS (SELECT *, greatest(0, q1 - CASE WHEN mv >= 0.75 THEN 0.1 * least(1, 2 * abs(vi - vj)) + 0.3 * greatest(0, least(vi, vj) - 0.4) ELSE 0 END) AS q2 FROM h1)
SELECT 'r' || track AS run_id, track, i, j, round(d, 6) AS d, round(waveform, 6) AS waveform, round(sequential, 6) AS sequential, round(section, 6) AS section, round(greatest(0, q2 - CASE WHEN oj < 0.25 THEN 0.12 * (0.25 - oj) / 0.25 ELSE 0 END), 6) AS quality FROM h2"""


@family(f"WITH {REGION}")
def q23_scored_region_candidates(spark, d):
    b = _b(spark, d)
    bounds = b.select("track").distinct().select(F.concat(F.lit("r"), F.col("track").cast("string")).alias("run_id"), "track", F.lit(5).alias("entry"), F.lit(40).alias("exit"))
    marks = _marks(b).drop("vocal_onset", "vocal_release")
    c = Q.region_transition_candidates(b, bounds, _snippets(b), _edge_db(b), marks, most=0.9, weights=Q.DEFAULT_WEIGHTS | {"section": 0.1})
    return rounded(c.select("run_id", "track", "i", "j", "d", "waveform", "sequential", "section", "quality"))


@family(f"""WITH {FULL} SELECT track, i AS from_beat, j AS to_beat, round(quality, 6) AS quality, round(waveform, 6) AS waveform, round(successor, 6) AS successor, 0.0::DOUBLE AS edge_splice, round(context, 6) AS context, label, round(section, 6) AS section, bar_align,
  round(energy, 6) AS energy, round(edge_energy, 6) AS edge_energy, round(centroid, 6) AS centroid, round(transient, 6) AS transient_continuity, round(mfcc, 6) AS mfcc_continuity, round(d, 6) AS chroma_distance, round(abs(e), 3) AS energy_diff_db FROM full_c WHERE quality >= 0.05""")
def s9_component_rows(spark, d):
    return rounded(component_rows(_full(spark, d)))


@family(f"""WITH {REC}, cn AS (SELECT track, count(*) AS n FROM bv GROUP BY 1), bo AS (SELECT DISTINCT track, beat // 10 AS seg, beat // 10 * 10 AS st, beat // 10 * 10 + 10 AS en FROM bv),
pr AS (SELECT a.track, a.seg AS a, b.seg AS b, greatest(0, greatest(a.st + 1, least(a.en, n)) - 8) AS rs, least(n, greatest(a.st + 1, least(a.en, n)) + 8) AS re, greatest(0, b.st - 8) AS cs, least(n, b.st + 8) AS ce FROM bo a JOIN bo b ON a.track = b.track AND a.seg <> b.seg JOIN cn ON cn.track = a.track),
wn AS (SELECT pr.*, k, cs - rs + (k - 1) * 2 AS o FROM pr, (SELECT unnest([0, 1, 2]) AS k)),
ce AS (SELECT wn.*, i, v, i - row_number() OVER (PARTITION BY wn.track, a, b, k ORDER BY i) AS g FROM wn JOIN rec r ON r.track = wn.track AND j - i = o AND i >= rs AND i < re AND j >= cs AND j < ce WHERE o <> 0 AND v > 0.1),
ru AS (SELECT track, a, b, k, o, min(i) AS f, count(*) AS len, avg(v) AS mean FROM ce GROUP BY track, a, b, k, o, g),
to1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track, a, b, k ORDER BY len DESC, f) AS r FROM ru) WHERE r = 1 AND len >= 2),
dg AS (SELECT * FROM (SELECT track, a, b, f + len // 2 AS fb, f + len // 2 + o AS tb, len, mean, row_number() OVER (PARTITION BY track, a, b ORDER BY round(len * mean, 9) DESC, k) AS rank FROM to1) WHERE rank <= 3 AND mean >= 0.05),
lg AS (SELECT dg.*, x.feat AS wa, y.feat AS wb, unnest(generate_series(-4, 4)) AS lag FROM dg JOIN bv x ON x.track = dg.track AND x.beat = fb + 1 JOIN bv y ON y.track = dg.track AND y.beat = tb),
wv AS (SELECT track, a, b, rank, fb, tb, len, mean, greatest(0, max(list_inner_product(wa[5:60], wb[5 + lag:60 + lag]) / sqrt(list_inner_product(wa[5:60], wa[5:60]) * list_inner_product(wb[5 + lag:60 + lag], wb[5 + lag:60 + lag]) + 1e-20))) AS wf FROM lg GROUP BY ALL),
gd AS (SELECT *, row_number() OVER (PARTITION BY track, fb, tb ORDER BY round(mean, 9) DESC, a, b, rank) AS r, min({{'a': a, 'b': b, 'rank': rank}}) OVER (PARTITION BY track, fb, tb) AS seen FROM wv WHERE wf >= 0.05)
SELECT track, row_number() OVER (PARTITION BY track ORDER BY round(len * mean * greatest(0.1, wf), 9) DESC, seen)::INTEGER AS rank, fb AS from_beat, tb AS to_beat, len AS length, round(mean, 6) AS score, round(wf, 6) AS waveform FROM gd WHERE r = 1""")
def q22_prescreen(spark, d):
    b = _b(spark, d)
    seg = b.select("track", F.floor(F.col("beat") / 10).alias("seg")).distinct().withColumns({"start": F.col("seg") * 10, "end": F.col("seg") * 10 + 10})
    n = b.groupBy("track").agg(F.count("*").alias("n"))
    return rounded(Q.prescreen_transitions(_rec(spark, d), seg, n, _snippets(b), meter=2, least_wave=0.05, max_lag=4))


@family(f"""WITH {SIG}, q AS (SELECT 'a' AS run_id, {_hm(0.5, 0.2, 0.07)} AS q FROM sg UNION ALL SELECT 'b', {_hm(0.1, 0.6, 0.3)} FROM sg)
SELECT run_id, count(*) AS n, round(avg(q), 6) AS mean_quality FROM q WHERE q >= 0.2 GROUP BY 1""")
def q24_weight_sweep(spark, d):
    runs = spark.createDataFrame([("a", 0.5, 0.2, 0.07), ("b", 0.1, 0.6, 0.3)], "run_id string, w_waveform double, w_sequential double, w_energy double")
    return rounded(Q.weight_sweep(_signals(spark, d), runs, ["waveform", "sequential", "energy"]))


@family(f"""WITH {SIG}, c AS (SELECT corr(waveform, sequential) AS x, corr(waveform, energy) AS y, corr(sequential, energy) AS z FROM sg)
SELECT 'waveform' AS a, 'sequential' AS b, round(x, 6) AS rho FROM c UNION ALL SELECT 'waveform', 'energy', round(y, 6) FROM c UNION ALL SELECT 'sequential', 'energy', round(z, 6) FROM c""")
def q25_component_correlation(spark, d):
    return rounded(Q.component_correlation(_signals(spark, d), ["waveform", "sequential", "energy"]))
