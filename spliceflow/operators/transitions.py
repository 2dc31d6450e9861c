"""Transition candidates between the beats of a track and their quality.

Candidates come in the order cheap filter, gate, expensive signal, score, so that vector correlations only see pairs that survive.
A quality is one expression over nullable signal columns; weights are a dict, or a table of runs for sweeps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from .events import snap_nearest
from .similarity import cosines, distances, lag_correlation, snippet_similarity, strips, tile_scores, window_diagonals

#: Default weights of the signals; combined by a harmonic mean (fixed values).
DEFAULT_WEIGHTS = {"waveform": 0.50, "sequential": 0.20, "transient": 0.15, "energy": 0.07, "edge_energy": 0.04, "bar_align": 0.02, "centroid": 0.02}
#: Level step at which nothing of the edge energy is left, in dB (a fixed value; steps over 8 dB are dropped before).
EDGE_SPAN_DB = 12.0
SIGNALS = ["waveform", "successor", "edge_splice", "context", "label", "section", "bar_align", "energy", "edge_energy", "centroid", "transient", "sequential", "mfcc", "chroma", "vocal", "extra1"]


def _w():
    return Window.partitionBy("track").orderBy("beat")


def _next(beats: DataFrame, vector: str = "feat") -> DataFrame:
    """beats with the vector of the beat after each (null for the last)."""
    return beats.withColumn(vector, F.lead(vector).over(_w()))


def chroma_of(feat: Column | str) -> Column:
    """Columns [n - 19, n - 7) of a feature vector of length n."""
    f = F.col(feat) if isinstance(feat, str) else feat
    return F.slice(f, F.size(f) - 18, 12)


def chroma_distance(beats: DataFrame, apart: tuple[int, int | None] = (0, None)) -> DataFrame:
    """(track, i, j, d): 1 - cosine of the chroma after i with that of j; 1 for the last i. All pairs `apart` beats from each other."""
    c = beats.select("track", "beat", chroma_of("feat").alias("feat"))
    return tile_scores(_next(c), c, apart=apart, missing=0.0).select("track", "i", "j", (1 - F.col("v")).alias("d"))


def chroma_nearest(beats: DataFrame, k: int = 16, guard: int = 15, most: float = 0.45, extra: DataFrame | None = None) -> DataFrame:
    """candidates_topk(chroma_distance(beats), ...) without a row for every pair: tiles of a track keep the k nearest of each beat."""
    c = beats.select("track", "beat", chroma_of("feat").alias("feat"))
    top = tile_scores(_next(c), c, apart=(guard + 1, None), nearest=k, most=most, missing=0.0).select("track", "i", "j", (1 - F.col("v")).alias("d"))
    if extra is None:
        return top
    more = chroma_of_pairs(extra.select("track", "i", "j"), beats).select("track", "i", "j", "d")
    return top.union(more).groupBy("track", "i", "j").agg(F.min("d").alias("d"))


def chroma_of_pairs(pairs: DataFrame, beats: DataFrame) -> DataFrame:
    """pairs (track, i, j, ...) with d, their chroma_distance, without that of any other pair."""
    c = beats.select("track", "beat", chroma_of("feat").alias("feat"))
    a, b = _next(c).select("track", F.col("beat").alias("i"), F.col("feat").alias("fi")), c.select("track", F.col("beat").alias("j"), F.col("feat").alias("fj"))
    return pairs.join(a, ["track", "i"]).join(b, ["track", "j"]).withColumn("d", F.coalesce(1 - V.cosine("fi", "fj"), F.lit(1.0))).drop("fi", "fj")


def chroma_sides(beats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(track, beat, feat) twice: the chroma after each beat, null for the last, and its own; their cosine is 1 - chroma_distance."""
    c = beats.select("track", "beat", chroma_of("feat").alias("feat"))
    return _next(c), c


def downbeat_nearest(beats: DataFrame, downbeats: DataFrame, k: int, apart: int, boundaries: DataFrame | None = None) -> DataFrame:
    """(track, i, j, d) under 1 of chroma_distance(beats) from beats that lead to a downbeat (track, beat) to a downbeat, `apart` beats away: the k
    nearest of each i, and all to boundaries (track, beat). All that path_edges takes of the table of all pairs."""
    c = beats.select("track", "beat", chroma_of("feat").alias("feat"))
    key = ["track", "beat"]
    leave = _next(c).join(downbeats.select("track", (F.col("beat") - 1).alias("beat")), key, "left_semi").where("feat is not null")
    land = c.join(downbeats.select(*key), key, "left_semi")
    d = lambda v: v.select("track", "i", "j", (1 - F.col("v")).alias("d")).where("d < 1")
    top = d(tile_scores(leave, land, apart=(apart, None), nearest=k, most=1.0))
    if boundaries is None:
        return top
    more = d(tile_scores(leave, land.join(boundaries.select(*key), key, "left_semi"), apart=(apart, None), most=1.0))
    # products of matrices of other sizes may differ in the last bit, so a pair is one by its beats
    return top.unionByName(more).groupBy("track", "i", "j").agg(F.min("d").alias("d"))


def chroma_means(beats: DataFrame, seg: int) -> DataFrame:
    """(track, a, b, d): the mean of chroma_distance from each segment of `seg` beats to each, added up in the strips where the distances arise."""
    c = beats.select("track", "beat", chroma_of("feat").alias("feat"))

    def kernel(i: np.ndarray, x: np.ndarray) -> Callable:
        a, first = np.unique(i // seg, return_index=True)
        x = np.where(np.isnan(x), 0.0, x)  # the last beat leads nowhere: its distances are 1

        def feed(j: np.ndarray | None, y: np.ndarray | None) -> Iterator[dict]:
            if j is not None:
                b, start = np.unique(j // seg, return_index=True)
                near = 1 - cosines(x, np.where(np.isnan(y), 0.0, y))
                total = np.add.reduceat(np.add.reduceat(near, start, axis=1), first, axis=0)
                n = np.diff(np.append(first, len(i)))[:, None] * np.diff(np.append(start, len(j)))[None]
                yield {"a": np.repeat(a, len(b)), "b": np.tile(b, len(a)), "s": total.ravel(), "n": n.ravel()}

        return feed

    return strips(_next(c), c, kernel, "a long, b long, s double, n long").groupBy("track", "a", "b").agg((F.sum("s") / F.sum("n")).alias("d"))


def successor_similarity(beats: DataFrame, apart: tuple[int, int | None] = (0, None)) -> DataFrame:
    """(track, i, j, v): cosine of the vector after i with that of j; 0 for the last i."""
    return tile_scores(_next(beats), beats, apart=apart, missing=0.0)


def edge_similarity(edges: DataFrame, apart: tuple[int, int | None] = (0, None)) -> DataFrame:
    """(track, i, j, v): cosine of edge_end of i with edge_start of j."""
    side = lambda c: edges.select("track", "beat", F.col(c).alias("feat"))
    return tile_scores(side("edge_end"), side("edge_start"), apart=apart)


def context_vectors(beats: DataFrame, back: int = 3, ahead: int = 3) -> DataFrame:
    """(track, beat, before, after): mean vectors of the beats i - back .. i and i .. i + ahead, once per beat."""
    long = beats.select("track", "beat", F.posexplode("feat").alias("d", "v"))
    w = Window.partitionBy("track", "d").orderBy("beat")
    long = long.withColumns({"b": F.avg("v").over(w.rowsBetween(-back, 0)), "a": F.avg("v").over(w.rowsBetween(0, ahead))})
    g = long.groupBy("track", "beat").agg(F.array_sort(F.collect_list(F.struct("d", "b", "a"))).alias("p"))
    return g.select("track", "beat", F.transform("p", lambda p: p["b"]).alias("before"), F.transform("p", lambda p: p["a"]).alias("after"))


def context_similarity(beats: DataFrame, apart: tuple[int, int | None] = (0, None), back: int = 3, ahead: int = 3) -> DataFrame:
    """(track, i, j, v): cosine of the context before i with that after j."""
    c = context_vectors(beats, back, ahead)
    side = lambda x: c.select("track", "beat", F.col(x).alias("feat"))
    return tile_scores(side("before"), side("after"), apart=apart)


def sequential_cost(beats: DataFrame, boundary: str | None = None) -> DataFrame:
    """(track, i, cost) of i -> i + 1: min(0.3 d, 0.12) of the chroma distance, or 0.5 d + 0.1 where a segment begins."""
    c = beats.withColumn("ch", chroma_of("feat"))
    d = c.withColumn("d", 1 - V.cosine("ch", F.lead("ch").over(_w())))
    plain = F.least(0.3 * F.col("d"), F.lit(0.12))
    cost = plain if boundary is None else F.when(F.lead(boundary).over(_w()), 0.5 * F.col("d") + 0.1).otherwise(plain)
    return d.withColumn("cost", cost).where(F.col("d").isNotNull()).select("track", F.col("beat").alias("i"), "cost")


def candidates_topk(distance: DataFrame, k: int = 16, guard: int = 15, most: float = 0.45, extra: DataFrame | None = None) -> DataFrame:
    """(track, i, j, d): per i the k nearest j outside i +- guard, not over `most`; pairs of `extra` (track, i, j) come along."""
    far = distance.where(F.abs(F.col("j") - F.col("i")) > guard)
    top = far.withColumn("r", F.row_number().over(Window.partitionBy("track", "i").orderBy("d", "j"))).where((F.col("r") <= k) & (F.col("d") <= most)).drop("r")
    if extra is not None:
        top = top.union(distance.join(extra.select("track", "i", "j"), ["track", "i", "j"]).select(top.columns)).dropDuplicates(["track", "i", "j"])
    return top


def gate_energy(candidates: DataFrame, edge_db: DataFrame, most: float = 8.0) -> DataFrame:
    """candidates with energy_diff_db = start level of j less end level of i, dropped beyond `most` either way."""
    a = edge_db.select("track", F.col("beat").alias("i"), F.col("db_end"))
    b = edge_db.select("track", F.col("beat").alias("j"), F.col("db_start"))
    c = candidates.join(a, ["track", "i"]).join(b, ["track", "j"]).withColumn("energy_diff_db", F.col("db_start") - F.col("db_end"))
    return c.where(F.abs("energy_diff_db") <= most).drop("db_start", "db_end")


def waveform_similarity(candidates: DataFrame, snippets: DataFrame, max_lag: int) -> DataFrame:
    """candidates with waveform and lag: snippet after i (track, beat, w) against that of j."""
    a = snippets.select("track", (F.col("beat") - 1).alias("i"), F.col("w").alias("wa"))
    b = snippets.select("track", F.col("beat").alias("j"), F.col("w").alias("wb"))
    return lag_correlation(candidates.join(a, ["track", "i"]).join(b, ["track", "j"]), max_lag).withColumnRenamed("xcorr", "waveform").drop("wa", "wb")


def deceptive_guard(waveform: Column, band: Column, vocal_i: Column, vocal_j: Column) -> Column:
    """The band-limited similarity where both sides are vocal (over 0.35) and it is more than 0.3 under the full one."""
    return F.when((vocal_i > 0.35) & (vocal_j > 0.35) & (waveform - band > 0.3), band).otherwise(waveform)


#: Share of the static distance, and the distance from which nothing is left (fixed values).
MFCC_STATIC, MFCC_SPAN, MFCC_N = 0.7, 0.6, 13


def mfcc_vectors(beats: DataFrame) -> DataFrame:
    """(track, beat, m, leaving, landing): the first 13 dimensions, their step from the beat before, and that to the beat after (0 at the ends)."""
    m = beats.select("track", "beat", F.slice("feat", 1, MFCC_N).alias("m"))
    step = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    return m.withColumns({"leaving": step("m", F.coalesce(F.lag("m").over(_w()), "m")), "landing": step(F.coalesce(F.lead("m").over(_w()), "m"), "m")})


def mfcc_of_pair(m_i: Column | str, leaving: Column | str, m_j: Column | str, landing: Column | str) -> Column:
    """1 - min(1, (0.7 static + 0.3 dynamic) / 0.6): distances per root dimension of the vectors, and of the step into i and that out of j."""
    gap = lambda a, b: V.distance(a, b) / F.sqrt(F.lit(float(MFCC_N)))
    return 1 - F.least(F.lit(1.0), (MFCC_STATIC * gap(m_i, m_j) + (1 - MFCC_STATIC) * gap(leaving, landing)) / MFCC_SPAN)


def mfcc_continuity(beats: DataFrame, apart: tuple[int, int | None] = (0, None)) -> DataFrame:
    """(track, i, j, v): mfcc_of_pair for all pairs of a track; the two distances of a pair are taken side by side, on vectors with their steps."""
    m = mfcc_vectors(beats)
    side = lambda c: m.select("track", "beat", F.concat("m", c).alias("feat"))

    def score(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        half = x.shape[1] // 2
        far = MFCC_STATIC * distances(x[:, :half], y[:, :half]) + (1 - MFCC_STATIC) * distances(x[:, half:], y[:, half:])
        return 1 - np.minimum(1.0, far / np.sqrt(float(MFCC_N)) / MFCC_SPAN)

    return tile_scores(side("leaving"), side("landing"), score, apart)


def chroma_continuity(beats: DataFrame, apart: tuple[int, int | None] = (0, None)) -> DataFrame:
    c = beats.select("track", "beat", chroma_of("feat").alias("feat"))
    return tile_scores(c, c, apart=apart).withColumn("v", V.clip(F.col("v"), 0.0, 1.0))


def vocal_continuity(density: Column, release_i: Column, onset_j: Column) -> Column:
    return F.when(density < 0.1, 1.0).otherwise(0.5 + 0.5 * F.greatest(release_i, onset_j))


def interval_continuity(gap_i: Column, gap_j: Column, jnd: float = 0.05, saturation: float = 0.15) -> Column:
    """1 while the log ratio of the intervals is under the just noticeable one, 0 from saturation on, linear between."""
    d = F.abs(F.log(gap_i / gap_j))
    return F.when(d <= jnd, 1.0).when(d >= saturation, 0.0).otherwise((saturation - d) / (saturation - jnd))


def linear_match(a: Column, b: Column, span: float) -> Column:
    """1 at equal values, 0 from `span` apart."""
    return F.greatest(F.lit(0.0), 1 - F.abs(a - b) / F.lit(span))


def sequential_signal(successor: Column, context: Column, mfcc: Column) -> Column:
    """Mean of those of the three that are there."""
    parts = [successor, context, mfcc]
    n = reduce(lambda a, b: a + b, (F.when(p.isNotNull(), 1).otherwise(0) for p in parts))
    return F.when(n > 0, reduce(lambda a, b: a + b, (F.coalesce(p, F.lit(0.0)) for p in parts)) / n)


def quality_score(weights: dict[str, float | Column], harmonic: bool = True, eps: float = 1e-3) -> Column:
    """Weighted mean of the signal columns that are not null: harmonic with floor eps, or arithmetic with the missing weight shared
    out over the rest (not normalised when none is missing). Clipped to [0, 1]; null if no weighted signal is there."""
    lit = {k: F.lit(float(v)) if isinstance(v, (int, float)) else v for k, v in weights.items()}
    zero = F.lit(0.0)
    total = reduce(lambda a, b: a + b, lit.values())
    add = lambda f: reduce(lambda a, b: a + b, (F.when(F.col(k).isNotNull() & (w > 0), f(F.col(k), w)).otherwise(zero) for k, w in lit.items()))
    there = add(lambda x, w: w)
    if harmonic:
        q = there / add(lambda x, w: w / F.greatest(x, F.lit(eps)))
    else:
        s = add(lambda x, w: w * x)
        q = F.when(there < total - 1e-12, s / (there / total)).otherwise(s)
    return F.when(there > 0, V.clip(q, 0.0, 1.0))


def tone_blend(timbre: Column, chroma: Column, tone: float) -> Column:
    return V.clip((1 - 0.7 * tone) * timbre + F.sqrt(F.lit(float(tone))) * chroma, 0.0, 1.0)


def vocal_penalty(discontinuity: Column, least_edge: Column, track_max: Column) -> Column:
    return F.when(track_max >= 0.75, 0.10 * discontinuity + 0.30 * F.greatest(F.lit(0.0), least_edge - 0.40)).otherwise(0.0)


def vocal_discontinuity(vocal_i: Column, vocal_j: Column, edge_i: Column | None = None, edge_j: Column | None = None) -> Column:
    """0.10 of the step in vocal activity (twice the difference, 1 at most) and 0.30 of what the quieter side of the cut is over 0.40."""
    least = F.least(vocal_i if edge_i is None else edge_i, vocal_j if edge_j is None else edge_j)
    return 0.10 * F.least(F.lit(1.0), 2.0 * F.abs(vocal_i - vocal_j)) + 0.30 * F.greatest(F.lit(0.0), least - 0.40)


def onset_penalty(onset: Column, below: float = 0.25, most: float = 0.12) -> Column:
    return F.when(onset < below, most * (below - onset) / below).otherwise(0.0)


def span_penalty(i: Column, j: Column, same_label: Column, across: float = 0.25, within: float = 0.12) -> Column:
    """For jumps of under 32 beats: 0.25 across labels, 0.12 within one; 0 without labels."""
    return F.when(same_label.isNull() | (F.abs(j - i) >= 32), 0.0).when(same_label, within).otherwise(across)


def quality_bucket(q: Column) -> Column:
    return F.when(q.isNull(), "unknown").when(q > 0.7, "great").when(q >= 0.5, "good").otherwise("weak")


def transition_candidates(
    beats: DataFrame, snippets: DataFrame, edge_db: DataFrame, k: int = 16, guard: int = 15, most: float = 0.45, floor: float = 0.20, max_lag: int = 4, weights: dict | None = None,
    marks: DataFrame | None = None, alike: DataFrame | None = None, band_snippets: DataFrame | None = None, extra: DataFrame | None = None, harmonic: bool = True, tone: float = 0.0,
) -> DataFrame:
    """(track, i, j, d, energy_diff_db, waveform, lag, successor, context, mfcc, chroma, sequential, energy, quality, cost) of the pairs that
    pass distance, energy and quality.

    Pairs of `extra` (track, i, j) pass the distance in any case. With marks of the beats (see marked_signals) also label, section, bar_align,
    edge_energy, centroid, transient and vocal (where marks have vocal_onset and vocal_release), which the default weights need, and the quality less
    its penalties. With band_snippets (track, beat, w: the snippets in the band of voices), where both sides are vocal in a track with voices,
    a waveform similarity that the band does not bear out is replaced by that of the band. tone blends in the chroma."""
    c = chroma_nearest(beats, k, guard, most, extra)
    c = waveform_similarity(gate_energy(c, edge_db), snippets, max_lag)
    v = beats.withColumns({"next": F.lead("feat").over(_w())}).join(context_vectors(beats), ["track", "beat"]).join(mfcc_vectors(beats), ["track", "beat"])
    a = v.select("track", F.col("beat").alias("i"), F.col("next"), F.col("before"), F.col("m").alias("mi"), "leaving", chroma_of("feat").alias("ci"))
    b = v.select("track", F.col("beat").alias("j"), F.col("feat").alias("fj"), F.col("after"), F.col("m").alias("mj"), "landing", chroma_of("feat").alias("cj"))
    c = c.join(a, ["track", "i"]).join(b, ["track", "j"])
    c = c.withColumns({
        "successor": V.clip(V.cosine("next", "fj"), 0.0, 1.0), "context": V.clip(V.cosine("before", "after"), 0.0, 1.0), "mfcc": mfcc_of_pair("mi", "leaving", "mj", "landing"),
        "chroma": V.clip(V.cosine("ci", "cj"), 0.0, 1.0), "energy": linear_match(F.col("energy_diff_db"), F.lit(0.0), 8.0),
    }).drop("next", "before", "mi", "leaving", "ci", "fj", "after", "mj", "landing", "cj")
    c = c.withColumn("sequential", sequential_signal(F.col("successor"), F.col("context"), F.col("mfcc")))
    use = weights or DEFAULT_WEIGHTS
    if marks is not None:
        c = marked_signals(c, marks, alike)
    if band_snippets is not None:
        if marks is None:
            raise ValueError("the guard against deceptive splices needs marks of the beats")
        band = waveform_similarity(c.select("track", "i", "j"), band_snippets, max_lag).select("track", "i", "j", F.col("waveform").alias("band"))
        c = c.join(band, ["track", "i", "j"], "left")
        guarded = deceptive_guard(F.col("waveform"), F.col("band"), F.col("vocal_i"), F.col("vocal_j"))
        c = c.withColumn("waveform", F.when((F.col("most_vocal") >= 0.75) & F.col("band").isNotNull(), guarded).otherwise(F.col("waveform"))).drop("band")
    missing = sorted(set(use) - set(c.columns))
    if missing:
        raise ValueError(f"the weighted signals {missing} need marks of the beats")
    q = quality_score(use, harmonic)
    c = c.withColumn("quality", q if tone <= 0 else tone_blend(q, F.col("chroma"), tone))
    if marks is not None:
        c = penalised(c)
    return c.where(F.col("quality") >= floor).withColumn("cost", 1 - F.col("quality"))


def marked_signals(candidates: DataFrame, marks: DataFrame, alike: DataFrame | None = None) -> DataFrame:
    """candidates with the signals that need marks (track, beat, label, seg, rms, centroid, onset, vocal, leads_in, is_downbeat[, vocal_onset,
    vocal_release]) of both beats: label, section (similarity of their segments: track, a, b, similarity), bar_align, energy, edge_energy, centroid, transient (onset
    strength as share of the track's largest); and the marks that penalties read."""
    w = Window.partitionBy("track")
    top = F.max("onset").over(w)
    m = marks.withColumns({"onset_share": F.when(top > 0, F.col("onset") / top).otherwise(0.0), "most_vocal": F.max("vocal").over(w)})
    of = lambda beat, s, more: m.select("track", F.col("beat").alias(beat), *(F.col(x).alias(f"{x}_{s}") for x in ("label", "seg", "rms", "centroid", "onset_share", "vocal")), *more)
    c = candidates.drop("energy").join(of("i", "i", [F.col("leads_in"), F.col("most_vocal")]), ["track", "i"]).join(of("j", "j", [F.col("is_downbeat"), F.col("onset").alias("onset_j")]), ["track", "j"])
    col = F.col
    vocal = F.lit(None).cast("double")
    if {"vocal_onset", "vocal_release"} <= set(marks.columns):
        c = c.join(m.select("track", col("beat").alias("i"), col("vocal_release").alias("release_i")), ["track", "i"]).join(m.select("track", col("beat").alias("j"), col("vocal_onset").alias("starts_j")), ["track", "j"])
        vocal = vocal_continuity(F.greatest("vocal_i", "vocal_j"), col("release_i"), col("starts_j"))
    section = F.lit(None).cast("double")
    if alike is not None:
        c = c.join(alike.select("track", col("a").alias("seg_i"), col("b").alias("seg_j"), col("similarity").alias("alike")), ["track", "seg_i", "seg_j"], "left")
        section = col("alike")
    return c.withColumns({
        "label": F.when((col("label_i") == col("label_j")) & (col("label_i") != "unknown"), 1.0).otherwise(0.0), "section": section,
        "bar_align": F.when(col("leads_in") & col("is_downbeat"), 1.0).otherwise(0.0), "energy": linear_match(col("rms_i"), col("rms_j"), 0.2),
        "edge_energy": linear_match(col("energy_diff_db"), F.lit(0.0), EDGE_SPAN_DB), "vocal": vocal, "centroid": linear_match(col("centroid_i"), col("centroid_j"), 0.2),
        "transient": 1 - F.abs(col("onset_share_i") - col("onset_share_j")),
    }).drop("label_i", "label_j", "seg_i", "seg_j", "rms_i", "rms_j", "centroid_i", "centroid_j", "onset_share_i", "onset_share_j", "leads_in", "is_downbeat", "alike", "release_i", "starts_j")


def penalised(scored: DataFrame, across: float = 0.25, within: float = 0.12) -> DataFrame:
    """scored with the quality less the span penalty, then the vocal one in tracks with vocals (0.75 anywhere), then the onset one, never
    under 0."""
    less = lambda q, p: F.greatest(F.lit(0.0), q - p)
    q = less(F.col("quality"), span_penalty(F.col("i"), F.col("j"), F.col("label") >= 0.5, across, within))
    q = less(q, F.when(F.col("most_vocal") >= 0.75, vocal_discontinuity(F.col("vocal_i"), F.col("vocal_j"))).otherwise(0.0))
    return scored.withColumn("quality", less(q, F.coalesce(onset_penalty(F.col("onset_j")), F.lit(0.0)))).drop("vocal_i", "vocal_j", "most_vocal", "onset_j")


def weight_sweep(components: DataFrame, runs: DataFrame, signals: list[str], floor: float = 0.2, most_runs: int = 1000) -> DataFrame:
    """(run_id, n, mean_quality) of a table of components under every row of weights (run_id, w_<signal>). The components are read once:
    each row is scored under all runs, which travel as a literal and are therefore at most most_runs; more are an error (sweep them in
    parts)."""
    rows = runs.select("run_id", *(f"w_{s}" for s in signals)).limit(most_runs + 1).collect()
    if len(rows) > most_runs:
        raise ValueError(f"more than {most_runs} runs")
    if not rows:
        return components.select(F.lit(None).cast(dict(runs.dtypes)["run_id"]).alias("run_id"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean_quality")).limit(0)
    every = F.array(*(F.struct(F.lit(r.run_id).alias("run_id"), *(F.lit(float(r[f"w_{s}"])).alias(f"w_{s}") for s in signals)) for r in rows))
    c = components.withColumn("__run", F.explode(every)).select("*", "__run.*")
    q = quality_score({s: F.col(f"w_{s}") for s in signals})
    return c.withColumn("q", q).where(F.col("q") >= floor).groupBy("run_id").agg(F.count("*").alias("n"), F.avg("q").alias("mean_quality"))


def component_correlation(components: DataFrame, signals: list[str]) -> DataFrame:
    """(a, b, rho): Pearson correlation of each pair of signals over all rows, in one pass."""
    todo = [(x, y) for n, x in enumerate(signals) for y in signals[n + 1 :]]
    row = components.agg(*(F.corr(x, y).alias(f"{x}|{y}") for x, y in todo))
    stack = ", ".join(f"'{x}', '{y}', `{x}|{y}`" for x, y in todo)
    return row.selectExpr(f"stack({len(todo)}, {stack}) as (a, b, rho)")


def prescreen_transitions(recurrence: DataFrame, segments: DataFrame, n: DataFrame, snippets: DataFrame | None, meter: int = 4, bars: int = 4, keep: int = 3, least: float = 0.05, least_wave: float = 0.30, max_lag: int = 1) -> DataFrame:
    """(track, rank, from_beat, to_beat, length, score, waveform): for every ordered pair of segments (track, seg, start, end in beats) of a track
    (track, n), the `keep` best diagonals from `bars` bars around the end of one to as many around the start of the other (window_diagonals)
    of a mean recurrence of `least`, if the snippet after the first beat is like that of the second by `least_wave` (not asked without
    snippets). Of equal pairs of beats the one of the best mean stays; ranked by length * mean * max(0.1, waveform), then as found."""
    reach, zero, c = bars * meter, F.lit(0).cast("long"), F.col
    a = segments.join(n, "track").select("track", "n", c("seg").alias("a"), F.greatest(c("start") + 1, F.least("end", "n")).alias("out"))
    b = segments.select("track", c("seg").alias("b"), c("start").alias("into"))
    w = a.join(b, "track").where("a <> b")
    w = w.select("track", "a", "b", F.greatest(zero, c("out") - reach).alias("row_start"), F.least("n", c("out") + reach).alias("row_end"), F.greatest(zero, c("into") - reach).alias("col_start"), F.least("n", c("into") + reach).alias("col_end"))
    d = window_diagonals(recurrence, w, ["a", "b"], meter, meter).where((c("rank") <= keep) & (c("mean") >= least)).withColumn("source", c("from_beat") + 1)
    if snippets is None:
        d = d.withColumn("waveform", F.lit(0.0))
    else:
        d = snippet_similarity(d, snippets, max_lag).where(c("waveform") >= least_wave)
    found = F.struct("a", "b", "rank")
    best = d.groupBy("track", "from_beat", "to_beat").agg(F.min(found).alias("seen"), F.min_by(F.struct("length", c("mean").alias("score"), "waveform"), F.struct(-F.round("mean", 9), found)).alias("x"))
    weight = F.round(c("x.length") * c("x.score") * F.greatest(F.lit(0.1), c("x.waveform")), 9)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("track").orderBy(F.desc(weight), "seen")))
    return best.select("track", "rank", "from_beat", "to_beat", "x.length", "x.score", "x.waveform")


def downbeat_sets(beats: DataFrame, downbeats: DataFrame) -> DataFrame:
    """beats (track, beat, t) with is_downbeat, for the beats nearest to downbeats (track, t), and leads_in for those before them."""
    grid = beats.select("track", F.col("beat").alias("j"), "t")
    d = snap_nearest(downbeats.select("track", "t"), grid).where("j is not null").select("track", F.col("j").alias("beat")).distinct()
    b = beats.join(d.withColumn("d", F.lit(True)), ["track", "beat"], "left").withColumn("is_downbeat", F.col("d").isNotNull()).drop("d")
    return b.withColumn("leads_in", F.coalesce(F.lead("is_downbeat").over(_w()), F.lit(False)))


def region_candidates(distance: DataFrame, bounds: DataFrame, labels: DataFrame | None = None, apart: int = 4, most: float = 0.55) -> DataFrame:
    """(run_id, track, i, j, d, cost) of all pairs inside [entry, exit) of runs (run_id, track, entry, exit), at least `apart` beats
    apart and not over `most`: no top-k and no floor; half the span penalty across labels (track, beat, label), none within one."""
    x = distance.where((F.abs(F.col("j") - F.col("i")) >= apart) & (F.col("d") <= most)).join(bounds, "track")
    x = x.where((F.col("i") >= F.col("entry")) & (F.col("i") < F.col("exit")) & (F.col("j") >= F.col("entry")) & (F.col("j") < F.col("exit")))
    cost = F.col("d")
    if labels is not None:
        of = lambda c: labels.select("track", F.col("beat").alias(c), F.col("label").alias(f"l{c}"))
        x = x.join(of("i"), ["track", "i"], "left").join(of("j"), ["track", "j"], "left")
        cost = cost + F.when((F.col("li") != F.col("lj")) & (F.abs(F.col("j") - F.col("i")) < 32), 0.125).otherwise(0.0)
    return x.select("run_id", "track", "i", "j", "d", cost.alias("cost"))


def region_nearest(beats: DataFrame, bounds: DataFrame, k: int, apart: int = 4, most: float = 0.55) -> DataFrame:
    """Of region_candidates(chroma_distance(beats), bounds) the k nearest j after each i, and the k nearest before it: all that region_edges can
    take, which ranks by the distance and what going back costs. A run's region is searched in strips like a track of its own."""
    c = beats.select("track", "beat", chroma_of("feat").alias("feat"))
    r = lambda d: d.where("feat is not null").join(bounds.select("run_id", "track", "entry", "exit"), "track").where((F.col("beat") >= F.col("entry")) & (F.col("beat") < F.col("exit"))).select(F.col("run_id").alias("track"), "beat", "feat")
    a, b = r(_next(c)), r(c)
    got = [tile_scores(a, b, apart=(apart, None), nearest=k, most=most, way=way) for way in (1, -1)]
    d = (1 - F.col("v")).alias("d")
    return got[0].unionByName(got[1]).select(F.col("track").alias("run_id"), "i", "j", d).join(F.broadcast(bounds.select("run_id", "track")), "run_id").select("run_id", "track", "i", "j", "d", F.col("d").alias("cost"))


def region_transition_candidates(
    beats: DataFrame, bounds: DataFrame, snippets: DataFrame, edge_db: DataFrame, marks: DataFrame | None = None, apart: int = 4, most: float = 0.55, max_lag: int = 4, weights: dict | None = None, harmonic: bool = True, tone: float = 0.0, back: int = 2, ahead: int = 2,
) -> DataFrame:
    """(run_id, track, i, j, d, energy_diff_db, waveform, lag, signals as in transition_candidates, quality, cost) of all pairs inside [entry, exit)
    of runs (run_id, track, entry, exit) that are `apart` beats from each other and not over `most`: no top-k, no floor, no guard.

    A region stands for itself: its last beat leads nowhere, and contexts, of `back` beats before i and `ahead` after j, end at its bounds. With marks the
    section is 0.9 * label + 0.1, and jumps of under 32 beats across labels lose half of what they do elsewhere, those within one nothing. Steps of
    the timbre and the track's largest values look at the whole track. A run's region is searched in tiles like a track of its own."""
    r = beats.join(bounds.select("run_id", "track", "entry", "exit"), "track").where((F.col("beat") >= F.col("entry")) & (F.col("beat") < F.col("exit")))
    own = r.select(F.col("run_id").alias("track"), "beat", "feat")
    tones = own.select("track", "beat", chroma_of("feat").alias("feat"))
    c = tile_scores(_next(tones).where("feat is not null"), tones, apart=(apart, None), most=most)
    c = c.select(F.col("track").alias("run_id"), "i", "j", (1 - F.col("v")).alias("d")).join(bounds.select("run_id", "track"), "run_id")
    c = waveform_similarity(gate_energy(c, edge_db), snippets, max_lag)
    v = own.withColumn("next", F.lead("feat").over(_w())).join(context_vectors(own, back, ahead), ["track", "beat"]).withColumnRenamed("track", "run_id")
    m = beats.join(mfcc_vectors(beats), ["track", "beat"])
    c = c.join(v.select("run_id", F.col("beat").alias("i"), "next", "before"), ["run_id", "i"]).join(v.select("run_id", F.col("beat").alias("j"), F.col("feat").alias("fj"), "after"), ["run_id", "j"])
    c = c.join(m.select("track", F.col("beat").alias("i"), F.col("m").alias("mi"), "leaving", chroma_of("feat").alias("ci")), ["track", "i"])
    c = c.join(m.select("track", F.col("beat").alias("j"), F.col("m").alias("mj"), "landing", chroma_of("feat").alias("cj")), ["track", "j"])
    c = c.withColumns({
        "successor": V.clip(V.cosine("next", "fj"), 0.0, 1.0), "context": V.clip(V.cosine("before", "after"), 0.0, 1.0), "mfcc": mfcc_of_pair("mi", "leaving", "mj", "landing"),
        "chroma": V.clip(V.cosine("ci", "cj"), 0.0, 1.0), "energy": linear_match(F.col("energy_diff_db"), F.lit(0.0), 8.0),
    }).drop("next", "before", "mi", "leaving", "ci", "fj", "after", "mj", "landing", "cj")
    c = c.withColumn("sequential", sequential_signal(F.col("successor"), F.col("context"), F.col("mfcc")))
    use = weights or DEFAULT_WEIGHTS
    if marks is not None:
        c = marked_signals(c, marks).withColumn("section", 0.9 * F.col("label") + 0.1)
    missing = sorted(set(use) - set(c.columns))
    if missing:
        raise ValueError(f"the weighted signals {missing} need marks of the beats")
    q = quality_score(use, harmonic)
    c = c.withColumn("quality", q if tone <= 0 else tone_blend(q, F.col("chroma"), tone))
    if marks is not None:
        c = penalised(c, 0.125, 0.0)
    return c.withColumn("cost", 1 - F.col("quality"))
