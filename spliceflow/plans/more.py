"""Queries of further transition, path and edit operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import editing as E
from ..operators import paths as P
from ..operators import transitions as Q
from ..sources import tables as T
from .base import EV, Family, rounded
from .editing import TL, _queue, _timeline
from .transitions import CD

family = Family()


@family(f"""WITH {EV}, ds AS (SELECT g.track, e.i, row_number() OVER (PARTITION BY g.track, g.t ORDER BY abs(e.t - g.t), e.i) AS r FROM ev g JOIN ev e USING (track) WHERE g.label = 'view' AND e.label <> 'view'),
d AS (SELECT DISTINCT track, i FROM ds WHERE r = 1), b AS (SELECT ev.track, ev.i AS beat, d.i IS NOT NULL AS is_downbeat FROM ev LEFT JOIN d USING (track, i) WHERE label <> 'view')
SELECT track, beat, is_downbeat, coalesce(lead(is_downbeat) OVER (PARTITION BY track ORDER BY beat), false) AS leads_in FROM b""")
def q6_downbeat_sets(spark, d):
    e = T.events(spark, d)
    beats = e.where("label <> 'view'").select("track", F.col("i").alias("beat"), "t")
    return Q.downbeat_sets(beats, e.where("label = 'view'").select("track", "t")).select("track", "beat", "is_downbeat", "leads_in")


@family(f"""WITH {CD} SELECT 'r' || track AS run_id, track, i, j, round(d, 6) AS d, round(d + CASE WHEN i // 8 <> j // 8 AND abs(j - i) < 32 THEN 0.125 ELSE 0 END, 6) AS cost
FROM cd WHERE abs(j - i) >= 4 AND d <= 0.55 AND least(i, j) >= 5 AND greatest(i, j) < 40""")
def q23_region_candidates(spark, d):
    b = T.beats(spark, d)
    bounds = b.select("track").distinct().select(F.concat(F.lit("r"), F.col("track").cast("string")).alias("run_id"), "track", F.lit(5).alias("entry"), F.lit(40).alias("exit"))
    labels = b.select("track", "beat", F.floor(F.col("beat") / 8).alias("label"))
    return rounded(Q.region_candidates(Q.chroma_distance(b), bounds, labels))


LAB = f"{EV}, lb AS (SELECT track, i AS beat, CASE WHEN i < track % 20 THEN 'intro' WHEN i > 40 + track % 15 THEN 'outro' ELSE label END AS label FROM ev)"


@family(f"""WITH {LAB}, o AS (SELECT track, coalesce(min(beat) FILTER (label <> 'intro'), 1000000) AS f, coalesce(max(beat) FILTER (label <> 'outro'), -1) AS l FROM lb GROUP BY 1),
g AS (SELECT track, count(*) FILTER (label = 'intro' AND beat < f) AS a, count(*) FILTER (label = 'outro' AND beat > l) AS z FROM lb JOIN o USING (track) GROUP BY 1)
SELECT track, CASE WHEN a > 0 THEN a ELSE 8 END AS intro_beats, least(CASE WHEN z > 0 THEN z ELSE 4 END, 12) AS outro_beats FROM g""")
def p3_intro_outro_beats(spark, d):
    e = T.events(spark, d)
    label = F.when(F.col("i") < F.col("track") % 20, "intro").when(F.col("i") > 40 + F.col("track") % 15, "outro").otherwise(F.col("label"))
    return P.intro_outro_beats(e.select("track", F.col("i").alias("beat"), label.alias("label")))


@family(f"""WITH {TL}, p AS (SELECT *, lag(end_beat) OVER (PARTITION BY run_id ORDER BY clip) AS fb FROM tl)
SELECT run_id, clip - 1 AS splice, round(ts, 6) AS at, fb AS from_beat, start_beat AS to_beat, a.label AS from_label, b.label AS to_label FROM p JOIN ev a ON a.track = p.track AND a.i = fb JOIN ev b ON b.track = p.track AND b.i = start_beat""".replace(" AS at,", ' AS "at",'))
def e14_transition_times(spark, d):
    labels = T.events(spark, d).select("track", F.col("i").alias("beat"), "label")
    return rounded(E.transition_times(_timeline(spark, d), labels))


@family()
def k4_queued_compatibility(spark, d):
    b = T.beats(spark, d)
    blocks = b.select("track", F.floor(F.col("beat") / 10).alias("block")).distinct().withColumns({"entry": F.col("block") * 10, "exit": F.col("block") * 10 + 9})
    queue = _queue(blocks)
    quality = lambda pairs: Q.chroma_of_pairs(pairs, b).withColumn("quality", 1 - F.col("d"))
    return rounded(E.queued_compatibility(queue, blocks, quality, b.where("beat % 2 = 0").select("track", "beat"), window=4, top=3, separation=3, n=b.groupBy("track").agg(F.count("*").alias("n"))))
