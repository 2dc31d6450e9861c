"""Queries of the block, edit-plan and mixdown operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import editing as E
from ..operators import splices as X
from ..operators import structure as S
from ..operators import transitions as Q
from ..operators.similarity import pairs
from ..sources import tables as T
from .base import EV, SG, Family, rounded
from .structure import ISL
from .transitions import CD

family = Family()


@family(f"""WITH {ISL}, s AS (SELECT track, seg, label, count(*) OVER (PARTITION BY track, label) AS m, row_number() OVER (PARTITION BY track, label ORDER BY seg) AS r FROM sgs)
SELECT track, seg, upper(label[1]) || label[2:] || CASE WHEN m > 1 THEN ' ' || r ELSE '' END AS name FROM s""")
def k1_build_blocks(spark, d):
    return E.build_blocks(S.islands(T.events(spark, d), "i", "label")).select("track", "seg", "name")


COMP = f"""{CD}, bl AS (SELECT track, b AS block, b * 10 AS entry, b * 10 + 9 AS "exit" FROM (SELECT DISTINCT track, beat // 10 AS b FROM cb)), cn AS (SELECT track, count(*) AS n FROM cb GROUP BY 1),
x AS (SELECT cd.track, a.block AS a, b.block AS b, i, j, 1 - d - 0.1::DOUBLE / 3 * (abs(i - a."exit") + abs(j - b.entry)) AS score FROM cd JOIN cn ON cn.track = cd.track JOIN bl a ON a.track = cd.track AND abs(i - a."exit") <= 3 AND i >= a.entry JOIN bl b ON b.track = cd.track AND abs(j - b.entry) <= 3 AND j <= b."exit" WHERE i <> j AND i <= n - 2),
cf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track, a, b ORDER BY round(score, 9) DESC, i, j) AS rank FROM x WHERE score > 0) WHERE rank <= 3),
cm AS (SELECT track, a, b, i, j, score, rank FROM cf UNION ALL SELECT a.track, a.block, b.block, a."exit", b.entry, 0, 1 FROM bl a JOIN bl b ON a.track = b.track WHERE NOT EXISTS (SELECT 1 FROM cf WHERE cf.track = a.track AND cf.a = a.block AND cf.b = b.block))"""


def _blocks(spark, d):
    b = T.beats(spark, d)
    n = F.col("block") * 10
    blocks = b.select("track", F.floor(F.col("beat") / 10).alias("block")).distinct().withColumns({"entry": n, "exit": n + 9})
    return b, blocks, b.groupBy("track").agg(F.count("*").alias("n"))


def _queue(blocks):
    """Every block of a track: the even ones in order, then the odd ones."""
    pos = F.row_number().over(Window.partitionBy("track").orderBy(F.col("block") % 2, "block")).cast("long") - 1
    return blocks.select("track", F.concat(F.lit("r"), F.col("track").cast("string")).alias("run_id"), pos.alias("pos"), "block")


@family(f"WITH {COMP} SELECT track, a, b, rank::INTEGER AS rank, i AS from_beat, j AS to_beat, round(score, 6) + 0 AS score FROM cm")
def k3_block_compatibility(spark, d):
    b, blocks, n = _blocks(spark, d)
    return rounded(E.vector_compatibility(blocks, *Q.chroma_sides(b), n, window=3, top=3))


@family(f"""WITH {COMP}, q AS (SELECT track, 'r' || track AS run_id, row_number() OVER (PARTITION BY track ORDER BY block % 2, block) - 1 AS pos, block FROM bl),
n AS (SELECT *, lag(block) OVER (PARTITION BY run_id ORDER BY pos) AS p, lead(block) OVER (PARTITION BY run_id ORDER BY pos) AS f FROM q), b1 AS (SELECT * FROM cm WHERE rank = 1 AND score > 0)
SELECT run_id, pos, n.block, coalesce(x.j, bl.entry) AS entry, coalesce(y.i, bl."exit") AS "exit", round(CASE WHEN f IS NULL THEN 0 ELSE 1 - coalesce(y.score, 0) END, 6) AS cost
FROM n JOIN bl ON bl.track = n.track AND bl.block = n.block LEFT JOIN b1 x ON x.track = n.track AND x.a = p AND x.b = n.block LEFT JOIN b1 y ON y.track = n.track AND y.a = n.block AND y.b = f""")
def k5_assemble_blocks(spark, d):
    b, blocks, n = _blocks(spark, d)
    queue = _queue(blocks)
    asked = queue.withColumn("b", F.lead("block").over(Window.partitionBy("run_id").orderBy("pos"))).where("b is not null").select("track", F.col("block").alias("a"), "b")
    quality = lambda pairs: Q.chroma_of_pairs(pairs, b).withColumn("quality", 1 - F.col("d"))
    return rounded(E.assemble_blocks(queue, blocks, E.block_compatibility(blocks, quality, window=3, top=3, n=n, asked=asked)))


@family(f"""WITH {EV} SELECT track, i, CASE WHEN x / 100 >= 0.65 THEN 0.075 WHEN x / 100 >= 0.4 THEN 0.15 ELSE 0.3 END::DOUBLE AS fade, round(least(0.3, greatest(0, abs(x - 50) - 6) * 0.025), 6) AS penalty,
  round(CASE WHEN x / 100 < 0.28 THEN wo WHEN i % 4 < 2 THEN greatest(wo, 0.30) WHEN least(x / 100, (i % 10) / 10.0) < 0.85 THEN greatest(wo, 0.18) ELSE wo END::DOUBLE, 6) AS overlap,
  round(x / 100 - 0.1 * 0.3 - 0.15 * (i % 10) / 10.0::DOUBLE - 0.14 * 0.2 - 0.1 * 0.1, 6) AS pair_score, (x / 100 >= 0.52) OR (x / 200 >= 0.28 AND (i % 10) / 10.0 >= 0.51) AS accepted FROM (SELECT *, greatest(0.1, CASE WHEN i % 3 > 0 THEN x / 300 ELSE 0.1 END)::DOUBLE AS wo FROM ev)""")
def e3_splice_rules(spark, d):
    x, y = F.col("x") / 100, (F.col("i") % 10) / F.lit(10.0)
    return rounded(T.events(spark, d).select(
        "track", "i", E.crossfade_for_quality(x).alias("fade"), E.junction_penalty(F.col("x") - 50).alias("penalty"), E.overlap_seconds(F.lit(0.1), F.when(F.col("i") % 3 > 0, F.col("x") / 300), x, F.when(F.col("i") % 4 < 2, 0.0).otherwise(1.0), x, y).alias("overlap"),
        E.splice_pair_score(x, F.lit(0.3), y, F.lit(0.2), F.lit(0.1)).alias("pair_score"), E.accept_anchor(x, F.lit(0.5), y, F.lit(0.5), F.col("x") / 200).alias("accepted"),
    ))


PTH = f"{EV}, st AS (SELECT 'r' || track AS run_id, track, i AS pos, CASE WHEN i % 20 < 12 THEN i ELSE i - 8 END AS beat FROM ev)"
CLP = f"""{PTH}, nw AS (SELECT *, sum(n) OVER (PARTITION BY run_id ORDER BY pos) - 1 AS clip FROM (SELECT *, CASE WHEN beat = lag(beat) OVER (PARTITION BY run_id ORDER BY pos) + 1 THEN 0 ELSE 1 END AS n FROM st)),
cl AS (SELECT run_id, track, clip::BIGINT AS clip, min(beat) AS start_beat, max(beat) AS end_beat FROM nw GROUP BY 1, 2, 3),
tm AS (SELECT track, i, t, coalesce(lead(t) OVER (PARTITION BY track ORDER BY i), t + 1) AS e, count(*) OVER (PARTITION BY track) AS n FROM ev),
ct AS (SELECT cl.*, a.t AS source_start, b.e AS source_end, a.n FROM cl JOIN tm a ON a.track = cl.track AND a.i = start_beat JOIN tm b ON b.track = cl.track AND b.i = end_beat)"""


def _clips(spark, d):
    e = T.events(spark, d)
    name = F.concat(F.lit("r"), F.col("track").cast("string"))
    steps = e.select(name.alias("run_id"), "track", F.col("i").alias("pos"), F.when(F.col("i") % 20 < 12, F.col("i")).otherwise(F.col("i") - 8).alias("beat"))
    clips = E.path_to_runs(steps).drop("pos").join(steps.select("run_id", "track").distinct(), "run_id")
    return e, clips, E.clip_times(clips, e.select("track", F.col("i").alias("beat"), "t"), 1.0)


@family(f"WITH {CLP} SELECT run_id, clip, start_beat, end_beat FROM cl")
def e1_path_to_runs(spark, d):
    return _clips(spark, d)[1].select("run_id", "clip", "start_beat", "end_beat")


@family(f"""WITH {CLP}, m AS (SELECT *, min(clip) OVER w AS lo, max(clip) OVER w AS hi FROM ct WINDOW w AS (PARTITION BY run_id))
SELECT run_id, clip, round(CASE WHEN clip = lo AND start_beat <= 2 THEN 0 ELSE source_start END, 6) AS source_start, round(CASE WHEN clip = hi AND end_beat >= n - 3 THEN 95 ELSE source_end END, 6) AS source_end FROM m""")
def e2_extend_full_track(spark, d):
    e, _, clips = _clips(spark, d)
    n = e.groupBy("track").agg(F.count("*").alias("n"), F.lit(95.0).alias("duration"))
    return rounded(E.extend_full_track(clips, n).select("run_id", "clip", "source_start", "source_end"))


TL = f"""{CLP}, dv AS (SELECT *, source_end - source_start AS du, CASE WHEN clip = 0 THEN 0 ELSE 0.1 * (clip % 3) END AS ov, 0.05 * (clip % 2) AS gap FROM ct), sp AS (SELECT *, du - coalesce(lead(ov) OVER (PARTITION BY run_id ORDER BY clip), 0) + gap AS st FROM dv),
tl AS (SELECT *, coalesce(sum(st) OVER (PARTITION BY run_id ORDER BY clip ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ts FROM sp)"""


def _timeline(spark, d):
    c = _clips(spark, d)[2]
    c = c.withColumns({"duration": F.col("source_end") - F.col("source_start"), "overlap_before": F.when(F.col("clip") == 0, 0.0).otherwise(0.1 * (F.col("clip") % 3)), "gap_after": 0.05 * (F.col("clip") % 2)})
    return E.timeline(c)


@family(f"WITH {TL} SELECT run_id, clip, round(ts, 6) AS timeline_start, round(ts + du, 6) AS timeline_end FROM tl")
def e5_timeline(spark, d):
    return rounded(_timeline(spark, d).select("run_id", "clip", "timeline_start", "timeline_end"))


@family(f"""WITH {TL}, g AS (SELECT *, min(clip) OVER w AS lo, max(clip) OVER w AS hi, CASE WHEN track % 2 = 0 THEN first_value(source_start) OVER (PARTITION BY run_id ORDER BY clip) - 0.004 ELSE 0 END AS rs FROM tl WINDOW w AS (PARTITION BY run_id)),
m AS (SELECT *, clip = lo AND abs(source_start - rs) <= 0.005 AS f, sum(CASE WHEN clip = lo AND abs(source_start - rs) <= 0.005 THEN source_start - rs ELSE 0 END) OVER (PARTITION BY run_id) AS sh FROM g)
SELECT run_id, clip, round(CASE WHEN f THEN rs ELSE source_start END, 6) AS source_start, round(CASE WHEN f THEN ts ELSE ts + sh END, 6) AS timeline_start FROM m""")
def e6_region_trim(spark, d):
    c = _timeline(spark, d)
    lo = F.first("source_start").over(Window.partitionBy("run_id").orderBy("clip"))
    c = c.withColumns({"region_start": F.when(F.col("track") % 2 == 0, lo - 0.004).otherwise(0.0), "region_end": F.lit(1e9)})
    return rounded(E.region_trim(c).select("run_id", "clip", "source_start", "timeline_start"))


@family(f"""WITH {SG}, b AS (SELECT track, i, avg(x) OVER w AS s FROM sg WINDOW w AS (PARTITION BY track ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
r AS (SELECT track, i, coalesce(s - lag(s) OVER (PARTITION BY track ORDER BY i), 0) AS r FROM b), q AS (SELECT track, i, avg(r) OVER (PARTITION BY track ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS r FROM r),
c AS (SELECT m.track, m.i // 40 AS mark, q.i, row_number() OVER (PARTITION BY m.track, m.i ORDER BY round(r, 9) DESC, q.i) AS n FROM sg m JOIN q ON q.track = m.track AND q.i BETWEEN m.i - 10 AND m.i + 4 WHERE m.i % 40 = 0)
SELECT track, mark, i AS onset FROM c WHERE n = 1""")
def e7_onset_in_window(spark, d):
    s = T.signal(spark, d)
    return E.onset_in_window(s, s.where("i % 40 = 0").select("track", F.floor(F.col("i") / 40).alias("mark"), "i"), 10, 4)


@family(f"""WITH bv AS (SELECT label::BIGINT AS track, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS beat, list_transform(embedding, lambda v: v::DOUBLE) AS feat FROM embeddings),
tp AS (SELECT track, beat, list_transform(range(64), lambda k: (feat[k + 1] - list_sum(feat) / 64) * (0.5 - 0.5 * cos(2 * pi() * k / 63))) AS w FROM bv), df AS (SELECT *, list_transform(range(63), lambda k: w[k + 2] - w[k + 1]) AS g FROM tp)
SELECT a.track, a.beat AS i, b.beat AS j, round(0.8 * list_cosine_similarity(a.w, b.w) + 0.2 * list_cosine_similarity(a.g, b.g), 6) AS v FROM df a JOIN df b ON a.track = b.track AND b.beat BETWEEN a.beat + 1 AND a.beat + 3""")
def e8_window_similarity(spark, d):
    b = T.beats(spark, d)
    p = pairs(b, b, (F.col("j") > F.col("i")) & (F.col("j") <= F.col("i") + 3))
    return rounded(p.select("track", "i", "j", E.window_similarity("fi", "fj").alias("v")))


#: Pairs of windows of 64 samples, one to three beats apart: tapered similarity, level, onsets.
WIN = """bv AS (SELECT label::BIGINT AS track, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS beat, list_transform(embedding, lambda v: v::DOUBLE) AS feat FROM embeddings),
tp AS (SELECT track, beat, feat, list_transform(range(64), lambda k: (feat[k + 1] - list_sum(feat) / 64) * (0.5 - 0.5 * cos(2 * pi() * k / 63))) AS w FROM bv), df AS (SELECT *, list_transform(range(63), lambda k: w[k + 2] - w[k + 1]) AS g, sqrt(list_inner_product(feat, feat) / 64 + 1e-10) AS rms,
  list_transform(range(64), lambda k: CASE WHEN k = 0 THEN 0 ELSE greatest(0, round((CASE WHEN k + 3 < 64 THEN abs(feat[k + 4]) ELSE 0 END - CASE WHEN k >= 5 THEN abs(feat[k - 4]) ELSE 0 END) / 8, 9)) END) AS rise FROM tp),
wn AS (SELECT *, list_position(rise, list_max(rise)) - 1 AS o FROM df),
wp AS (SELECT a.track, a.beat AS i, b.beat AS j, a.feat AS fa, b.feat AS fb, 0.8 * list_cosine_similarity(a.w, b.w) + 0.2 * list_cosine_similarity(a.g, b.g) AS sim, least(1, abs(20 * log10(a.rms / b.rms)) / 12) AS energy,
  a.o AS oa, b.o AS ob FROM wn a JOIN wn b ON a.track = b.track AND b.beat BETWEEN a.beat + 1 AND a.beat + 3)"""


def _windows(spark, d):
    b = T.beats(spark, d)
    return pairs(b, b, (F.col("j") > F.col("i")) & (F.col("j") <= F.col("i") + 3))


@family(f"""WITH {WIN} SELECT track, i, j, oa AS onset_i, round(sim - 0.1 * energy - 0.15 * least(1, (i % 5 + j % 3) / 16.0::DOUBLE) - 0.14 * least(1, (abs(oa - 31.5) + abs(ob - 31.5)) / 44.8::DOUBLE) - 0.1 * least(1, abs(oa - ob) / 16.0::DOUBLE), 6) AS score FROM wp""")
def e9_scored_pair(spark, d):
    p = _windows(spark, d)
    return rounded(p.select("track", "i", "j", E.window_onset("fi").cast("long").alias("onset_i"), E.scored_pair("fi", "fj", 64, F.col("i") % 5, -(F.col("j") % 3), 8).alias("score")))


def _near(a: str, b: str) -> str:
    """Similarity of the samples 8 to 39 of two windows, which an anchor at 24 with 16 to either side looks at."""
    t = lambda x: f"list_transform(range(32), lambda k: ({x}[k + 9] - list_sum({x}[9:40]) / 32) * (0.5 - 0.5 * cos(2 * pi() * k / 31)))"
    g = lambda x: f"list_transform(range(31), lambda q: {x}[q + 2] - {x}[q + 1])"
    return f"(SELECT 0.8 * list_cosine_similarity(ta, tb) + 0.2 * list_cosine_similarity({g('ta')}, {g('tb')}) FROM (SELECT {t(a)} AS ta, {t(b)} AS tb))"


@family(f"""WITH {WIN}, nr AS (SELECT *, {_near("fa", "fb")} AS near, least(0.7, 0.4 + 0.25 * ((i % 10) / 10.0::DOUBLE)) AS w FROM wp)
SELECT track, i, j, round(greatest(0, least(1, (1 - w) * greatest(0, least(1, (sim + 1) / 2)) + w * greatest(0, least(1, (near + 1) / 2)) - 0.08 * energy)), 6) AS score FROM nr""")
def e10_anchor_score(spark, d):
    return rounded(_windows(spark, d).select("track", "i", "j", E.anchor_score("fi", "fj", 64, F.lit(24), (F.col("i") % 10) / 10.0, 16).alias("score")))


@family(f"""WITH {CD}, p AS (SELECT cd.track, cd.i, cd.j, greatest(0, 1 - d) AS successor, 20 * log10(greatest(abs(y.full[1]), 1e-6)) - 20 * log10(greatest(abs(x.full[64]), 1e-6)) AS e, abs(x.full[2]) AS ri, abs(y.full[2]) AS rj, abs(x.full[3]) AS vi, abs(y.full[3]) AS vj, abs(y.full[4]) AS oj
  FROM cd JOIN cb x ON x.track = cd.track AND x.beat = cd.i JOIN cb y ON y.track = cd.track AND y.beat = cd.j WHERE abs(cd.j - cd.i) BETWEEN 4 AND 9),
s AS (SELECT *, CASE WHEN i // 8 % 3 = j // 8 % 3 THEN 1.0 ELSE 0 END AS label, greatest(0, 1 - abs(ri - rj) / 0.2::DOUBLE) AS energy, greatest(0, 1 - abs(e) / 8.0::DOUBLE) AS edge FROM p),
q AS (SELECT *, greatest(0, least(1, 1.0::DOUBLE / (0.4 / greatest(successor, 0.001) + 0.2 / greatest(0.9 * label + 0.1, 0.001) + 0.2 / greatest(energy, 0.001) + 0.2 / greatest(edge, 0.001)))) AS q FROM s)
SELECT track, i, j, round(greatest(0, q - (least(0.3, greatest(0, abs(e) - 6) * 0.025) + 0.1 * least(1, 2 * abs(vi - vj)) + 0.3 * greatest(0, least(vi, vj) - 0.4) + CASE WHEN oj < 0.25 THEN 0.12 * (0.25 - oj) / 0.25 ELSE 0 END)), 6) AS score FROM q""")
def k2_junction_scores(spark, d):
    b = T.beats(spark, d)
    at = lambda k: F.abs(F.get("feat", F.lit(k)))
    db = lambda k: 20 * F.log10(F.greatest(at(k), F.lit(1e-6)))
    p = Q.chroma_distance(b, (4, 9)).withColumn("successor", F.greatest(F.lit(0.0), 1 - F.col("d")))
    of = lambda c, *more: b.select("track", F.col("beat").alias(c), at(1).alias(f"rms_{c}"), at(2).alias(f"vocal_{c}"), (F.floor(F.col("beat") / 8) % 3).cast("string").alias(f"label_{c}"), *more)
    p = p.join(of("i", db(63).alias("end")), ["track", "i"]).join(of("j", db(0).alias("begin"), at(3).alias("onset_j")), ["track", "j"]).withColumn("energy_diff_db", F.col("begin") - F.col("end"))
    return rounded(E.junction_scores(p, {"successor": 0.4, "section": 0.2, "energy": 0.2, "edge_energy": 0.2}).select("track", "i", "j", "score"))


#: Splices between the clips of the paths, in samples of a hundredth: some refined, some anchored, every ninth a teaser.
SPL = f"""{CLP}, sc AS (SELECT run_id, track, clip, start_beat, end_beat, round(source_start * 100)::BIGINT AS f, round(source_end * 100)::BIGINT AS l, lead(round(source_start * 100)::BIGINT) OVER w AS bs, lead(start_beat) OVER w AS nb, (clip + track) % 9 AS m FROM ct WINDOW w AS (PARTITION BY run_id ORDER BY clip)),
sx AS (SELECT *, l AS successor, bs + 90 AS be, 31 AS x, 9000 AS ns, m = 8 AS teaser, CASE WHEN m IN (1, 2) THEN l + 7 END AS ro, CASE WHEN m IN (1, 2) THEN bs - 9 END AS ri, CASE WHEN m IN (2, 3) THEN l + 40 END AS ao, CASE WHEN m IN (2, 3) THEN bs - 60 END AS ai, CASE WHEN m IN (2, 3) THEN bs + 20 END AS ae, CASE WHEN m IN (2, 3) THEN 100 END AS ax FROM sc WHERE bs IS NOT NULL),
sr AS (SELECT *, greatest(x, least(coalesce(ao, ro, successor + 15), ns)) AS oc, greatest(0, least(coalesce(ai, ri, bs - 15), be)) AS ist FROM sx),
so AS (SELECT run_id, clip, teaser, CASE WHEN teaser THEN 32 END AS fo, CASE WHEN teaser THEN 18 END AS fi, CASE WHEN teaser THEN 6 END AS gap, CASE WHEN NOT teaser THEN oc END AS oc, CASE WHEN NOT teaser THEN ist END AS ist, CASE WHEN NOT teaser THEN least(coalesce(ax, x), oc, greatest(0, coalesce(ae, be) - ist)) END AS ov FROM sr)"""


def _resolved(spark, d):
    c = _clips(spark, d)[2]
    w = Window.partitionBy("run_id").orderBy("clip")
    at = lambda x: F.round(F.col(x) * 100).cast("long")
    c = c.select("run_id", "track", "clip", at("source_start").alias("first"), at("source_end").alias("last")).withColumn("beat_start", F.lead("first").over(w))
    m = (F.col("clip") + F.col("track")) % 9
    s = c.where("beat_start is not null").withColumns({
        "successor": F.col("last"), "beat_end": F.col("beat_start") + 90, "crossfade": F.lit(31).cast("long"), "n_samples": F.lit(9000).cast("long"), "teaser": m == 8,
        "refined_out": F.when(m.isin(1, 2), F.col("last") + 7), "refined_in": F.when(m.isin(1, 2), F.col("beat_start") - 9), "anchor_out": F.when(m.isin(2, 3), F.col("last") + 40),
        "anchor_in": F.when(m.isin(2, 3), F.col("beat_start") - 60), "anchor_end": F.when(m.isin(2, 3), F.col("beat_start") + 20), "anchor_overlap": F.when(m.isin(2, 3), F.lit(100).cast("long")),
    })
    return c, E.resolve_splices(s, 100)


@family(f"WITH {SPL} SELECT run_id, clip, teaser, fo::BIGINT AS fade_out, fi::BIGINT AS fade_in, gap::BIGINT AS gap, oc::BIGINT AS out_cut, ist::BIGINT AS in_start, ov::BIGINT AS overlap FROM so")
def e4_resolve_splices(spark, d):
    return _resolved(spark, d)[1].select("run_id", "clip", "teaser", "fade_out", "fade_in", "gap", "out_cut", "in_start", "overlap")


@family(f"""WITH {SPL}, j AS (SELECT sc.run_id, sc.clip, f, l, so.* EXCLUDE (run_id, clip) FROM sc LEFT JOIN so ON so.run_id = sc.run_id AND so.clip = sc.clip)
SELECT run_id, clip, coalesce(lag(ist) OVER w, f)::BIGINT AS source_start, coalesce(oc, l)::BIGINT AS source_end, coalesce(lag(coalesce(ov, fi)) OVER w, 0)::BIGINT AS fade_in, coalesce(ov, fo, 0)::BIGINT AS fade_out, coalesce(lag(ov) OVER w, 0)::BIGINT AS overlap_before, coalesce(gap, 0)::BIGINT AS gap_after
FROM j WINDOW w AS (PARTITION BY run_id ORDER BY clip)""")
def e4_spliced_clips(spark, d):
    c, s = _resolved(spark, d)
    return E.spliced_clips(c, s)


def _splices(s):
    """A splice at every 120th sample of every track: from there to 90 samples on, beats of 60 samples."""
    beats = s.where("i % 60 = 0").select("track", F.floor(F.col("i") / 60).alias("beat"), "i")
    return beats, beats.where("beat % 2 = 0").select("track", F.floor(F.col("beat") / 2).alias("splice"), "beat", "i", ((F.col("beat") % 10) / 10.0).alias("vocal"))


@family()
def e10_anchor_search(spark, d):
    s = T.signal(spark, d)
    beats, at = _splices(s)
    asked = at.select("track", "splice", F.col("beat").alias("prev_beat"), (F.col("beat") + 3).alias("curr_beat"), "vocal")
    return rounded(X.anchor_search(asked, beats, s, rate=1000, least_ms=40.0, local_ms=60.0, back_ms=90.0, ahead_ms=60.0))


@family()
def e11_refine_splice(spark, d):
    s = T.signal(spark, d)
    _, at = _splices(s)
    asked = at.select("track", "splice", F.col("i").alias("successor"), (F.col("i") + 90).alias("target"), (F.col("i") + 150).alias("beat_end"), F.lit(48).cast("long").alias("overlap"))
    return rounded(X.refine_splice(asked, s, rate=1000, coarse=4, back_ms=90.0, ahead_ms=60.0))


@family(f"""WITH {SG}, cl AS (SELECT track, 'r' || track AS run_id, c, c * 40 AS f, 30 AS n, c * 25 AS pos FROM (SELECT DISTINCT track, i // 40 AS c FROM sg)),
k AS (SELECT *, unnest(generate_series(0, 29)) AS k FROM cl), s AS (SELECT run_id, pos + k AS i, x * CASE WHEN k < 5 THEN sin(pi() / 2 * (k + 0.5) / 5) ELSE 1 END * CASE WHEN n - k <= 5 THEN sin(pi() / 2 * (n - k - 0.5) / 5) ELSE 1 END AS x FROM k JOIN sg ON sg.track = k.track AND sg.i = f + k)
SELECT run_id, i, round(sum(x), 9) AS x FROM s GROUP BY 1, 2""")
def e13_mixdown(spark, d):
    s = T.signal(spark, d)
    return rounded(E.mixdown(_mix_clips(s), s), 9)


@family(f"""WITH {SG}, cl AS (SELECT track, 'r' || track AS run_id, c, c * 40 AS f, 30 AS n, c * 25 AS pos FROM (SELECT DISTINCT track, i // 40 AS c FROM sg)),
lv AS (SELECT cl.track, cl.c, sqrt(coalesce(sum(CASE WHEN i < f + 5 THEN x * x END), 0) / 5 + 1e-10) AS b, sqrt(coalesce(sum(CASE WHEN i >= f + 25 THEN x * x END), 0) / 5 + 1e-10) AS e FROM cl LEFT JOIN sg ON sg.track = cl.track AND i >= f AND i < f + 30 GROUP BY 1, 2),
g AS (SELECT track, c, CASE WHEN lag(e) OVER w > 1e-6 AND b > 1e-6 THEN greatest(0.35, least(2.83, lag(e) OVER w / b)) ELSE 1 END AS gain FROM lv WINDOW w AS (PARTITION BY track ORDER BY c)),
k AS (SELECT *, unnest(generate_series(0, 29)) AS k FROM cl JOIN g USING (track, c)), s AS (SELECT run_id, pos + k AS i, x * CASE WHEN k < 5 THEN sin(pi() / 2 * (k + 0.5) / 5) ELSE 1 END * CASE WHEN n - k <= 5 THEN sin(pi() / 2 * (n - k - 0.5) / 5) ELSE 1 END * CASE WHEN k < 20 THEN gain + (1 - gain) * k / 19 ELSE 1 END AS x FROM k JOIN sg ON sg.track = k.track AND sg.i = f + k)
SELECT run_id, i, round(sum(x), 9) AS x FROM s GROUP BY 1, 2""")
def e13_matched_mixdown(spark, d):
    s = T.signal(spark, d)
    return rounded(E.mixdown(_mix_clips(s), s, match=True), 9)


def _mix_clips(s):
    """Clips of 30 samples at every 40th of a track, five samples over one another."""
    long = lambda v: F.lit(v).cast("long")
    clips = s.select("track", F.floor(F.col("i") / 40).alias("clip")).distinct()
    return clips.select("track", "clip", F.concat(F.lit("r"), F.col("track").cast("string")).alias("run_id"), (F.col("clip") * 40).alias("first"), long(30).alias("n"), (F.col("clip") * 25).alias("at"), F.lit(5).alias("fade_in"), F.lit(5).alias("fade_out"))


@family(f"WITH {EV}, q AS (SELECT track, i, round(t / 0.05::DOUBLE)::BIGINT AS q, label FROM ev) SELECT track, q, label, min(i) AS first_i, count(*) AS n FROM q GROUP BY 1, 2, 3")
def e15_request_key(spark, d):
    e = T.events(spark, d).withColumn("blocked", F.array("label"))
    k = E.request_key(e, ["t"], "blocked")
    return k.groupBy("track", "key").agg(F.first(F.round(F.col("t") / F.lit(0.05)).cast("long")).alias("q"), F.first("label").alias("label"), F.min("i").alias("first_i"), F.count("*").alias("n")).drop("key")


@family(f"""WITH {EV}, q AS (SELECT *, round(t / 0.05::DOUBLE)::BIGINT AS q, CASE WHEN i % 4 = 1 THEN 0.3 ELSE 0.5 END AS w, i % 5 = 2 AS own FROM ev)
SELECT track, q, label, min(i) AS i, count(*) AS requests FROM q GROUP BY track, q, label, w, own""")
def e15_distinct_requests(spark, d):
    """One job for requests that agree in time, blocked pairs and weights; defaults written out, left out, and in another order are equal."""
    e = T.events(spark, d).withColumn("blocked", F.when(F.col("i") % 2 == 0, F.array("label")).otherwise(F.array("label", "label")))
    num = lambda v: F.lit(float(v))
    weights = (
        F.when(F.col("i") % 4 == 1, F.create_map(F.lit("waveform"), num(0.3), F.lit("energy"), num(0.07))).when(F.col("i") % 4 == 2, F.create_map(F.lit("energy"), num(0.07), F.lit("waveform"), num(0.5)))
        .when(F.col("i") % 4 == 3, F.create_map(F.lit("unused"), num(0)))
    )
    weights = F.when(F.col("i") % 5 == 2, F.map_concat(F.coalesce(weights, F.create_map(F.lit("energy"), num(0.07))), F.create_map(F.lit("own"), num(0.2)))).otherwise(weights)
    k = E.request_key(e.withColumn("weights", weights), ["t"], "blocked", others=["track"], weights="weights", defaults={"waveform": 0.5, "energy": 0.07})
    jobs, _ = E.distinct_requests(k.withColumn("id", F.col("track") * 1000000 + F.col("i")), "id")
    return jobs.select("track", F.round(F.col("t") / F.lit(0.05)).cast("long").alias("q"), "label", "i", "requests")


@family(f"WITH {EV} SELECT track, i, label FROM (SELECT *, row_number() OVER (PARTITION BY track, label ORDER BY t DESC) AS r FROM ev) WHERE r <= 3")
def e16_keep_latest(spark, d):
    e = T.events(spark, d).withColumn("source", F.concat_ws(":", "track", "label"))
    return E.keep_latest(e, "source", "t", 3).select("track", "i", "label")


@family(f"""WITH {EV}, c AS (SELECT track, i, greatest(t - x / 10, 30) - 30 AS s, least(t + x / 10, 60) - 30 AS e FROM ev)
SELECT track, i, round(CASE WHEN e - s >= 6 AND NOT (s <= 0.1 AND e >= 30 - 0.1) THEN s END, 6) AS start, round(CASE WHEN e - s >= 6 AND NOT (s <= 0.1 AND e >= 30 - 0.1) THEN e END, 6) AS "end" FROM c""")
def e17_clip_region(spark, d):
    e = T.events(spark, d)
    r = E.clip_region(F.col("t") - F.col("x") / 10, F.col("t") + F.col("x") / 10, F.lit(30.0), F.lit(60.0))
    return rounded(e.select("track", "i", r.alias("r")).select("track", "i", "r.start", "r.end"))


@family(f"""WITH RECURSIVE {EV}, u AS (SELECT track, t FROM ev UNION ALL SELECT DISTINCT track, 0 FROM ev UNION ALL SELECT DISTINCT track, 95 FROM ev), o AS (SELECT track, t, row_number() OVER (PARTITION BY track ORDER BY t) AS r FROM u),
f(track, r, last, kept) AS (SELECT track, r, t, true FROM o WHERE r = 1 UNION ALL SELECT o.track, o.r, CASE WHEN o.t - last < 0.5 THEN last ELSE o.t END, NOT (o.t - last < 0.5) FROM f JOIN o ON o.track = f.track AND o.r = f.r + 1),
k AS (SELECT track, last AS start, lead(last) OVER (PARTITION BY track ORDER BY r) AS stop, row_number() OVER (PARTITION BY track ORDER BY r) - 1 AS cell FROM f WHERE kept)
SELECT track, cell, round(start, 6) AS start, round(stop, 6) AS "end" FROM k WHERE stop IS NOT NULL""")
def e18_cells_from_delimiters(spark, d):
    e = T.events(spark, d)
    return rounded(E.cells_from_delimiters(e.select("track", "t"), e.select("track").distinct().withColumn("end", F.lit(95.0)), 0.5))
