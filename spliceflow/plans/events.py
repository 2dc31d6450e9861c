"""Queries of the event operators; events of type view serve as marks and of type click as onsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as E
from ..sources.tables import events
from .base import EV, Family, rounded

family = Family()
GAP = f"{EV}, gp AS (SELECT *, lead(t) OVER (PARTITION BY track ORDER BY t) - t AS gap, t - lag(t) OVER (PARTITION BY track ORDER BY t) AS back, count(*) OVER (PARTITION BY track) AS n FROM ev)"
MED = f"{GAP}, md AS (SELECT track, list_sort(list(gap))[count(gap) // 2 + 1] AS med FROM gp WHERE gap IS NOT NULL GROUP BY 1)"
NEAR = """dist AS (SELECT e.track, e.i, e.t, g.t AS grid_t, g.j, row_number() OVER (PARTITION BY e.track, e.i ORDER BY abs(g.t - e.t), g.j) AS r FROM ev e JOIN grid g USING (track)),
near AS (SELECT track, i, t, grid_t, j FROM dist WHERE r = 1)"""


def _grid(label: str) -> str:
    return f"grid AS (SELECT track, row_number() OVER (PARTITION BY track ORDER BY t) AS j, t FROM ev WHERE label = '{label}')"


def _ev(spark, d):
    return events(spark, d)


def _of(e, label):
    return e.where(F.col("label") == label).select("track", "t")


@family(f"WITH {EV}, m AS (SELECT track, i, x, max(x) OVER (PARTITION BY track ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m FROM ev) SELECT track, i, x FROM m WHERE x = m AND x > 0")
def b1_local_peaks(spark, d):
    return E.local_peaks(_ev(spark, d).select("track", "i", "x"))


@family(f"""WITH RECURSIVE {EV}, p AS (SELECT track, i, row_number() OVER (PARTITION BY track ORDER BY i) AS r FROM ev WHERE x > 30),
f(track, r, mean, n, run) AS (SELECT track, r, i::DOUBLE, 1::DOUBLE, 1::BIGINT FROM p WHERE r = 1
UNION ALL SELECT p.track, p.r, CASE WHEN p.i - mean <= 1 THEN mean + (p.i - mean) / (n + 1) ELSE p.i END, CASE WHEN p.i - mean <= 1 THEN n + 1 ELSE 1 END, CASE WHEN p.i - mean <= 1 THEN run ELSE run + 1 END
  FROM f JOIN p ON p.track = f.track AND p.r = f.r + 1)
SELECT track, round(arg_max(mean, r))::BIGINT AS i FROM f GROUP BY track, run""")
def b2_dedup_peaks(spark, d):
    return E.dedup_peaks(_ev(spark, d).where("x > 30"))


@family(f"WITH {EV}, {_grid('view')}, {NEAR} SELECT track, i, j, round(grid_t, 6) AS grid_t FROM near")
def b3_snap_nearest(spark, d):
    e = _ev(spark, d)
    grid = _of(e, "view").withColumn("j", F.row_number().over(E._w()).cast("long"))
    return rounded(E.snap_nearest(e.select("track", "i", "t"), grid).where("j is not null").select("track", "i", "j", "grid_t"))


@family(f"""WITH {EV}, b AS (SELECT track, t FROM ev WHERE label IN ('error', 'click', 'purchase')), h AS (SELECT track, t FROM ev WHERE label IN ('view', 'signup')),
gp AS (SELECT *, lead(t) OVER (PARTITION BY track ORDER BY t) - t AS gap FROM b), md AS (SELECT track, list_sort(list(gap))[count(gap) // 2 + 1] AS med FROM gp WHERE gap IS NOT NULL GROUP BY 1),
g AS (SELECT track, t AS t0, gap, round(gap / med)::BIGINT AS n FROM gp JOIN md USING (track) WHERE gap > 1.35::DOUBLE * med AND round(gap / med) > 1),
s AS (SELECT track, t0, gap, n, k, t0 + gap * k / n AS slot FROM (SELECT *, unnest(generate_series(1, n - 1)) AS k FROM g)),
q AS (SELECT s.track, t0, k, min(h.t) AS hint FROM s JOIN h ON h.track = s.track AND h.t >= t0 AND h.t < t0 + gap AND abs(h.t - slot) <= 0.2::DOUBLE * gap / n GROUP BY 1, 2, 3),
c AS (SELECT track, t0, count(*) AS m FROM q GROUP BY 1, 2)
SELECT track, round(t, 6) AS t, false AS added FROM b UNION ALL
SELECT s.track, round(CASE WHEN m = n - 1 THEN hint ELSE slot END, 6), true FROM s LEFT JOIN q USING (track, t0, k) LEFT JOIN c USING (track, t0)""")
def b4_fill_gaps(spark, d):
    e = _ev(spark, d)
    return rounded(E.fill_gaps(e.where("label in ('error', 'click', 'purchase')"), e.where("label in ('view', 'signup')").select("track", "t")))


@family(f"""WITH {MED} SELECT track, i, x FROM gp JOIN md USING (track)
WHERE NOT coalesce(n >= 5 AND abs(back - med) > 0.25 * med AND abs(gap - med) > 0.25 * med, false)""")
def b5_drop_inconsistent(spark, d):
    return E.drop_inconsistent(_ev(spark, d)).select("track", "i", "x")


@family(f"WITH {EV}, {_grid('click')}, {NEAR} SELECT ev.track, ev.i, round(CASE WHEN abs(grid_t - ev.t) <= 0.5 THEN grid_t ELSE ev.t END, 6) AS refined FROM ev LEFT JOIN near USING (track, i)")
def b6_refine_to_onset(spark, d):
    e = _ev(spark, d)
    return rounded(E.refine_to_onset(e.select("track", "i", "t"), _of(e, "click"), 0.5).select("track", "i", "refined"))


TEMPO = f"""{EV}, r AS (SELECT track, t, row_number() OVER (PARTITION BY track ORDER BY t) - 1 AS r, count(*) OVER (PARTITION BY track) AS n FROM ev),
tr AS (SELECT * FROM r WHERE r >= floor(n * 0.15) AND r < n - floor(n * 0.15)),
g AS (SELECT * FROM (SELECT track, lead(t) OVER (PARTITION BY track ORDER BY t) - t AS gap FROM tr) WHERE gap > 0.2 AND gap < 2),
m AS (SELECT track, list_sort(list(gap))[count(gap) // 2 + 1] AS med FROM g GROUP BY 1),
p AS (SELECT track, avg(gap) AS period FROM g JOIN m USING (track) WHERE abs(gap - med) <= 0.15 * med GROUP BY 1),
a AS (SELECT track, atan2(sum(sin(2 * pi() * t / period)), sum(cos(2 * pi() * t / period))) AS angle FROM tr JOIN p USING (track) GROUP BY 1),
k AS (SELECT track, t, period, round((t - angle / (2 * pi()) * period) / period) AS k FROM tr JOIN p USING (track) JOIN a USING (track)),
f AS (SELECT track, period, regr_slope(t, k) AS slope, regr_r2(t, k) AS r2 FROM k GROUP BY 1, 2),
u AS (SELECT track, 60 / CASE WHEN r2 > 0.99 AND slope > 0 THEN slope ELSE period END AS bpm FROM f),
tempo AS (SELECT track, coalesce(CASE WHEN bpm < 78 THEN bpm * pow(2, ceil(log2(78 / bpm))) WHEN bpm > 185 THEN bpm / pow(2, ceil(log2(bpm / 185))) ELSE bpm END, 120) AS tempo
  FROM (SELECT DISTINCT track FROM ev) LEFT JOIN u USING (track))"""


@family(f"WITH {TEMPO} SELECT track, round(tempo, 4) AS tempo FROM tempo")
def b7_estimate_tempo(spark, d):
    return rounded(E.estimate_tempo(_ev(spark, d)), 4)


METER = f"""bars AS (SELECT track, t, lead(t) OVER (PARTITION BY track ORDER BY t) AS nx FROM ev WHERE label = 'view'),
cn AS (SELECT b.track, b.t, count(*) AS k FROM bars b JOIN ev e ON e.track = b.track AND e.t >= b.t - 0.03 AND e.t < nx - 0.03 WHERE nx IS NOT NULL GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 7),
mc AS (SELECT track, k, count(*) AS m FROM cn GROUP BY 1, 2), mt AS (SELECT track, arg_max(k, m * 100 - k) AS k FROM mc GROUP BY 1),
meter AS (SELECT track, coalesce(k, 4)::BIGINT AS meter FROM (SELECT DISTINCT track FROM ev) LEFT JOIN mt USING (track))"""


@family(f"WITH {EV}, {METER} SELECT track, meter FROM meter")
def b8_detect_meter(spark, d):
    e = _ev(spark, d)
    return E.detect_meter(e.select("track", "t"), _of(e, "view"))


@family(f"""WITH RECURSIVE {EV}, v AS (SELECT track, t, row_number() OVER (PARTITION BY track ORDER BY t) AS r, lead(t) OVER (PARTITION BY track ORDER BY t) - t AS gap FROM ev WHERE label = 'view'),
rf AS (SELECT track, list_sort(list(gap))[count(gap) // 2 + 1] AS ref FROM v WHERE gap IS NOT NULL GROUP BY 1),
f(track, r, last, kept, prev) AS (SELECT track, r, t, true, NULL::DOUBLE FROM v WHERE r = 1
UNION ALL SELECT v.track, v.r, CASE WHEN (v.t - last) / ref < 0.6 THEN last ELSE v.t END, NOT ((v.t - last) / ref < 0.6), last FROM f JOIN v ON v.track = f.track AND v.r = f.r + 1 JOIN rf ON rf.track = v.track),
k AS (SELECT f.track, last AS t, prev, round((last - prev) / ref) AS n, (last - prev) / ref AS ratio FROM f LEFT JOIN rf USING (track) WHERE kept)
SELECT track, round(t, 6) AS t FROM k UNION ALL
SELECT track, round(prev + (t - prev) * j / n, 6) FROM (SELECT *, unnest(generate_series(1, n::BIGINT - 1)) AS j FROM k WHERE ratio > 1.35 AND n > 1)""")
def b9_clean_downbeats(spark, d):
    e = _ev(spark, d)
    v = _of(e, "view")
    none = v.select("track", F.lit(None).cast("double").alias("bar")).distinct()
    return rounded(E.clean_downbeats(v, none))


@family(f"WITH {EV} SELECT track, i, x FROM ev WHERE i % 4 = 0")
def b10_every_nth(spark, d):
    return E.every_nth(_ev(spark, d), 4).select("track", "i", "x")


@family(f"""WITH {TEMPO}, gp AS (SELECT track, lead(t) OVER (PARTITION BY track ORDER BY t) - t AS gap FROM ev)
SELECT track, round(CASE WHEN count(*) < 4 THEN 0.5 ELSE avg(CASE WHEN gap IS NOT NULL THEN (abs(gap - 60 / tempo) <= 0.1 * 60 / tempo)::INT END) END, 6) AS regularity FROM gp JOIN tempo USING (track) GROUP BY 1""")
def b11_regularity(spark, d):
    e = _ev(spark, d)
    return rounded(E.regularity(e, E.estimate_tempo(e)))


@family(f"""WITH {EV}, {_grid('view')}, {NEAR}, mean AS (SELECT track, avg(gap) AS mean FROM (SELECT track, lead(t) OVER (PARTITION BY track ORDER BY t) - t AS gap FROM ev) GROUP BY 1)
SELECT ev.track, ev.i, coalesce(abs(grid_t - ev.t) <= 0.25 * mean, false) AS marked FROM ev LEFT JOIN near USING (track, i) LEFT JOIN mean USING (track)""")
def b12_mark_within(spark, d):
    e = _ev(spark, d)
    return E.mark_within(e.select("track", "i", "t"), _of(e, "view")).select("track", "i", "marked")


@family()
def b13_detect_beats(spark, d):
    e = _ev(spark, d)
    logits = e.select("track", "i", (F.col("x") / 50 - 1).alias("x"))
    marks = e.where("label = 'view'").select("track", (F.col("i") / F.lit(2.0)).alias("t"))
    onsets = e.where("x > 40").select("track", (F.col("i") / F.lit(2.0) + 0.01).alias("t"))
    return E.detect_beats(logits, 2.0, onsets, marks)
