"""Queries of the beat-level operators: embeddings as frames, four of them to a beat."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import beats as B
from ..sources import tables as T
from .base import BV, EV, SG, Family, rounded

family = Family()
VEC = f"{BV}, fr AS (SELECT track, beat AS frame, feat FROM bv), lng AS (SELECT track, frame, unnest(generate_series(1, 64)) AS k, unnest(feat) AS v FROM fr)"
IV = f"{VEC}, cn AS (SELECT track, count(*) AS n FROM fr GROUP BY 1), iv AS (SELECT track, unnest(generate_series(0, (n - 1) // 6)) AS beat, n FROM cn), ivs AS (SELECT track, beat, beat * 6 AS start, least(n, beat * 6 + 6) AS stop FROM iv)"


def _frames(spark, d):
    return T.beats(spark, d).withColumnRenamed("beat", "frame")


def _n(frames):
    return frames.groupBy("track").agg(F.count("*").alias("n"))


def _intervals(frames):
    bounds = frames.where("frame % 6 = 0").select("track", "frame")
    return B.bounds_to_intervals(bounds, _n(frames))


def _digest(v):
    return V.total(F.transform(F.col(v), lambda x, k: x * (k + 1)))


@family(f"WITH {IV}, m AS (SELECT f.track, i.beat, k, avg(v) AS v FROM lng f JOIN ivs i ON i.track = f.track AND frame >= start AND frame < stop GROUP BY 1, 2, 3) SELECT track, beat, round(sum(v * k), 6) AS digest, round(sum(v), 6) AS total FROM m GROUP BY 1, 2")
def a1_sync_mean(spark, d):
    f = _frames(spark, d)
    m = B.sync_mean(f, _intervals(f))
    return rounded(m.select("track", "beat", _digest("feat").alias("digest"), V.total("feat").alias("total")))


@family(f"""WITH {IV}, v AS (SELECT track, frame AS beat, feat[1] AS v FROM fr JOIN cn USING (track) WHERE frame < n * 2 // 3), s AS (SELECT track, unnest(generate_series(0, n - 1)) AS beat FROM cn)
SELECT s.track, s.beat, round(coalesce(v.v, last_value(v.v IGNORE NULLS) OVER (PARTITION BY s.track ORDER BY s.beat)), 6) AS v FROM s LEFT JOIN v USING (track, beat)""")
def a2_conform_length(spark, d):
    f = _frames(spark, d)
    b = f.join(_n(f), "track").where(F.col("frame") < F.floor(F.col("n") * 2 / 3)).select("track", F.col("frame").alias("beat"), F.get("feat", F.lit(0)).alias("v"))
    return rounded(B.conform_length(b, _n(f), "v"))


@family(f"WITH {EV} SELECT track, i, trunc(trunc(t * 22050.0::DOUBLE)::BIGINT / 512.0::DOUBLE)::BIGINT AS frame FROM ev")
def a3_time_to_frame(spark, d):
    return T.events(spark, d).select("track", "i", B.time_to_frame(F.col("t"), 22050.0, 512).alias("frame"))


@family(f"WITH {VEC}, n AS (SELECT track, frame, sqrt(sum(v * v)) AS n FROM lng GROUP BY 1, 2) SELECT track, frame AS beat, round(sum(v * k) / max(n), 6) + 0 AS digest FROM lng JOIN n USING (track, frame) GROUP BY 1, 2")
def a4_l2_normalized(spark, d):
    f = _frames(spark, d).withColumn("u", V.l2_normalized("feat"))
    return rounded(f.select("track", F.col("frame").alias("beat"), _digest("u").alias("digest")))


@family(f"WITH {EV} SELECT track, i, round(x / greatest(max(x) OVER (PARTITION BY track), 1e-10), 6) AS x FROM ev")
def a5_max_normalized(spark, d):
    return rounded(B.max_normalized(T.events(spark, d).select("track", "i", "x"), "x"))


@family(f"""WITH {VEC}, s AS (SELECT track, k, avg(v) AS m, stddev_pop(v) AS s FROM lng GROUP BY 1, 2)
SELECT track, frame AS beat, round(sum((v - m) / (s + 1e-8) * 1.5 * k), 5) + 0 AS digest FROM lng JOIN s USING (track, k) GROUP BY 1, 2""")
def a6_zscored(spark, d):
    z = B.zscored(_frames(spark, d), weight=1.5)
    return rounded(z.select("track", F.col("frame").alias("beat"), _digest("feat").alias("digest")), 5)


@family(f"WITH {BV} SELECT track, beat, len(feat) * 2 AS n, round(list_sum(feat) * 2, 6) + 0 AS total FROM bv")
def a7_stacked(spark, d):
    s = B.stacked(T.beats(spark, d), "feat", "feat")
    return rounded(s.select("track", "beat", F.size("feat").cast("long").alias("n"), V.total("feat").alias("total")))


EDGE = f"""{IV}, e AS (SELECT i.track, i.beat, l.k, l.v, frame < start + least(4, greatest(1, (stop - start) // 2)) AS f, frame >= stop - least(4, greatest(1, (stop - start) // 2)) AS l
FROM lng l JOIN ivs i ON i.track = l.track AND frame >= start AND frame < stop)"""


@family(f"""WITH {EDGE}, m AS (SELECT track, beat, k, avg(v) FILTER (f) AS a, avg(v) FILTER (l) AS b FROM e GROUP BY 1, 2, 3)
SELECT track, beat, round(sum(a * k) / sqrt(sum(a * a)), 6) + 0 AS edge_start, round(sum(b * k) / sqrt(sum(b * b)), 6) + 0 AS edge_end FROM m GROUP BY 1, 2""")
def a8_edge_means(spark, d):
    f = _frames(spark, d)
    e = B.edges(f, _intervals(f))
    return rounded(e.select("track", "beat", _digest("edge_start").alias("edge_start"), _digest("edge_end").alias("edge_end")))


@family(f"WITH {EDGE} SELECT track, beat, round(max(v) FILTER (f), 6) AS edge_start, round(max(v) FILTER (l), 6) AS edge_end FROM e WHERE k = 1 GROUP BY 1, 2")
def a9_edge_peaks(spark, d):
    f = _frames(spark, d)
    x = f.select("track", "frame", F.get("feat", F.lit(0)).alias("x"))
    return rounded(B.edges(x, _intervals(f), how="scalar_max"))


@family(f"""WITH {SG}, iv AS (SELECT track, beat, beat * 25 AS start, least(n, beat * 25 + 25) AS stop FROM (SELECT track, n, unnest(generate_series(0, (n - 1) // 25)) AS beat FROM nn)),
r AS (SELECT s.track, beat, sqrt(avg(x * x) FILTER (i < start + 5) + 1e-10) AS a, sqrt(avg(x * x) FILTER (i >= stop - 5) + 1e-10) AS b FROM sg s JOIN iv ON iv.track = s.track AND i >= start AND i < stop GROUP BY 1, 2),
m AS (SELECT track, greatest(max(a), max(b)) AS m FROM r GROUP BY 1) SELECT track, beat, round(a / m, 6) AS rms_start, round(b / m, 6) AS rms_end FROM r JOIN m USING (track)""")
def a10_edge_rms(spark, d):
    s = T.signal(spark, d).withColumnRenamed("i", "frame")
    iv = B.bounds_to_intervals(s.where("frame % 25 = 0").select("track", "frame"), _n(s))
    return rounded(B.edge_rms(s, iv, 5))


@family(f"""WITH {SG}, mk AS (SELECT track, i // 20 AS mark, i FROM sg WHERE i % 20 = 0), q AS (SELECT mk.track, mark, k, coalesce(s.x, 0) AS x FROM (SELECT *, unnest(generate_series(0, 15)) AS k FROM mk) mk LEFT JOIN sg s ON s.track = mk.track AND s.i = mk.i - 4 + k),
z AS (SELECT track, mark, k, (x - avg(x) OVER (PARTITION BY track, mark)) * (0.5 - 0.5 * cos(2 * pi() * k / 16)) AS y FROM q)
SELECT track, mark, round(sum(y * (k + 1)) / sqrt(avg(y * y)), 6) + 0 AS digest FROM z GROUP BY 1, 2""")
def a11_event_snippets(spark, d):
    s = T.signal(spark, d)
    marks = s.where("i % 20 = 0").select("track", F.floor(F.col("i") / 20).alias("mark"), "i")
    return rounded(B.event_snippets(s, marks, 4, 12).select("track", "mark", _digest("w").alias("digest")))


@family(f"WITH {EV} SELECT track, i, round((x - min(x) OVER w) / greatest(1e-9, max(x) OVER w - min(x) OVER w), 6) AS x FROM ev WINDOW w AS (PARTITION BY track)")
def a12_minmax_scaled(spark, d):
    return rounded(B.minmax_scaled(T.events(spark, d).select("track", "i", "x"), "x"))


@family(f"WITH {EV} SELECT track, i, round(20 * log10(greatest(x / 500, 1e-6)), 6) AS db FROM ev")
def a13_edge_db(spark, d):
    return rounded(T.events(spark, d).select("track", "i", B.edge_db(F.col("x") / 500).alias("db")))
