"""Blocks, edit plans and mixdown: from beat paths to clips on a timeline and samples."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from ..functions import windows as W
from .similarity import cosines, strips


def build_blocks(segments: DataFrame) -> DataFrame:
    """segments (track, seg, label, ...) with name: the label with a capital, numbered where it repeats in the track."""
    w = Window.partitionBy("track", "label")
    s = segments.withColumns({"__n": F.row_number().over(w.orderBy("seg")), "__m": F.count("*").over(w)})
    return s.withColumn("name", F.when(F.col("__m") > 1, F.concat_ws(" ", F.initcap("label"), F.col("__n").cast("string"))).otherwise(F.initcap("label"))).drop("__n", "__m")


def junction_penalty(energy_diff_db: Column, over: float = 6.0, per_db: float = 0.025, most: float = 0.30) -> Column:
    """Graduated penalty of a level step beyond `over` dB."""
    return F.least(F.lit(most), F.greatest(F.lit(0.0), F.abs(energy_diff_db) - over) * per_db)


def scored(pairs: DataFrame, quality: DataFrame | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """pairs (track, i, j, ...) with their quality, of a table (track, i, j, quality) or by a function. A table of all pairs of a track looks small
    to the planner, which takes its size from the beats it is made of; it is not to be broadcast."""
    if callable(quality):
        return quality(pairs)
    return pairs.join(quality.select("track", "i", "j", "quality").hint("merge"), ["track", "i", "j"])


def block_compatibility(blocks: DataFrame, quality: DataFrame | Callable[[DataFrame], DataFrame], window: int = 8, drift: float = 0.10, top: int = 5, n: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """(track, a, b, rank, from_beat, to_beat, score): for every ordered pair of blocks (track, block, entry, exit: their first and last beat), the
    best pairs of beats (track, i, j, quality; junction_scores gives it as score) within the window of the exit of a, but not before a's
    entry, and of the entry of b, but not after b's exit, less drift per beat moved over the window, as far as that is over 0; the last beat
    of a track (track, n) leads nowhere. Pairs without any get their natural junction, exit to entry, with score 0. With `asked` (track, a, b) only those
    pairs of blocks; quality may then be a function that adds it to the pairs of beats that these need."""
    zero, c = F.lit(0).cast("long"), F.col
    leave = blocks.select("track", c("block").alias("a"), c("exit").alias("a_at"), F.explode(F.sequence(F.greatest("entry", c("exit") - window), c("exit") + window)).alias("i"))
    land = blocks.select("track", c("block").alias("b"), c("entry").alias("b_at"), F.explode(F.sequence(F.greatest(zero, c("entry") - window), F.least(c("entry") + window, "exit"))).alias("j"))
    if asked is not None:
        x = scored(asked.select("track", "a", "b").distinct().join(leave, ["track", "a"]).join(land, ["track", "b"]).where("i <> j"), quality)
    else:
        x = quality.select("track", "i", "j", "quality").where("i <> j").join(leave, ["track", "i"]).join(land, ["track", "j"])
    if n is not None:
        x = x.join(n, "track").where(c("i") <= c("n") - 2)
    moved = F.abs(c("i") - c("a_at")) + F.abs(c("j") - c("b_at"))
    x = x.withColumn("score", c("quality") - F.lit(drift / window) * moved).where("score > 0")
    w = Window.partitionBy("track", "a", "b").orderBy(F.desc(F.round("score", 9)), "i", "j")
    found = x.withColumn("rank", F.row_number().over(w)).where(c("rank") <= top).select("track", "a", "b", "rank", c("i").alias("from_beat"), c("j").alias("to_beat"), "score")
    pairs = blocks.select("track", c("block").alias("a"), c("exit").alias("from_beat")).join(blocks.select("track", c("block").alias("b"), c("entry").alias("to_beat")), "track")
    if asked is not None:
        pairs = pairs.join(asked.select("track", "a", "b").distinct(), ["track", "a", "b"], "left_semi")
    return found.unionByName(_natural(pairs, found))


def vector_compatibility(blocks: DataFrame, leaving: DataFrame, landing: DataFrame, n: DataFrame, window: int = 8, drift: float = 0.10, top: int = 5) -> DataFrame:
    """block_compatibility by the cosine of the vectors (track, beat, feat) of i in `leaving` with those of j in `landing`; a null one has none of it.
    Pairs of beats are scored, and the best of each pair of blocks taken, in strips of the track's blocks: only what is found becomes rows."""
    zero, c = F.lit(0).cast("long"), F.col
    size = F.broadcast(landing.agg(F.max(F.size("feat")).alias("size")))

    def side(at: str, lo: Column, hi: Column, vectors: DataFrame, last: Column) -> DataFrame:
        p = blocks.select("track", "block", c(at).alias("at"), F.explode(F.sequence(lo, hi)).alias("beat")).join(n, "track").where(c("beat") <= last)
        p = p.join(vectors.select("track", "beat", "feat"), ["track", "beat"]).crossJoin(size)
        nan = lambda k: F.array_repeat(F.lit(float("nan")), k)
        p = p.select("track", "block", F.concat(F.array(c("at").cast("double"), c("beat").cast("double")), F.coalesce(c("feat").cast("array<double>"), nan(c("size")))).alias("feat"), "size")
        # every block has a row, for its natural junction
        own = blocks.select("track", "block", c(at).alias("at")).crossJoin(size)
        own = own.select("track", "block", F.concat(F.array(c("at").cast("double"), F.lit(float("nan"))), nan(c("size"))).alias("feat"))
        return p.drop("size").unionByName(own).withColumnRenamed("block", "beat")

    a = side("exit", F.greatest("entry", c("exit") - window), c("exit") + window, leaving, c("n") - 2)
    b = side("entry", F.greatest(zero, c("entry") - window), F.least(c("entry") + window, "exit"), landing, c("n") - 1)

    def kernel(i: np.ndarray, x: np.ndarray) -> Callable:
        def dealt(k: np.ndarray, v: np.ndarray) -> tuple:
            """Blocks, their natural beat, and the rows of each by place, padded with a row of NaN."""
            v, k = (z[np.lexsort((v[:, 1], k))] for z in (v, k))
            names, first, many = np.unique(k, return_index=True, return_counts=True)
            rows = first[:, None] + np.arange(many.max())[None]
            rows = np.where(np.arange(many.max())[None] < many[:, None], rows, len(v))
            v = np.vstack([v, np.full((1, v.shape[1]), np.nan)])
            return names, v[first, 0], v[rows, 1], v[rows, 2:]

        names, exits, places, vectors = dealt(i, x)
        moved = np.abs(places - exits[:, None])

        def feed(j: np.ndarray | None, y: np.ndarray | None) -> Iterator[dict]:
            if j is None:
                return
            into, entries, lands, others = dealt(j, y)
            flat = lambda z: z.reshape(-1, z.shape[-1])
            v = cosines(np.nan_to_num(flat(vectors)), np.nan_to_num(flat(others))).reshape(*places.shape, *lands.shape)
            v = v - drift / window * (moved[:, :, None, None] + np.abs(lands - entries[:, None])[None, None])
            v = np.where((v > 0) & (places[:, :, None, None] != lands[None, None]), np.round(v, 12), -np.inf)
            v = v.transpose(0, 2, 1, 3).reshape(len(names), len(into), -1)  # by i, then j
            key, raw = np.round(v, 9), v
            p, q = (z.ravel() for z in np.indices(key.shape[:2]))
            for rank in range(top):
                k = key.argmax(2).ravel()
                score = raw[p, q, k]
                ok = np.isfinite(score)
                s, t, k = p[ok], q[ok], k[ok]
                here, there = places[s, k // lands.shape[1]], lands[t, k % lands.shape[1]]
                yield {"a": names[s], "b": into[t], "rank": np.full(len(s), rank + 1, np.int32), "from_beat": here.astype(np.int64), "to_beat": there.astype(np.int64), "score": score[ok]}
                if not rank:
                    s, t = p[~ok], q[~ok]
                    yield {"a": names[s], "b": into[t], "rank": np.ones(len(s), np.int32), "from_beat": exits[s].astype(np.int64), "to_beat": entries[t].astype(np.int64), "score": np.zeros(len(s))}
                key[p[ok], q[ok], k] = -np.inf
                raw[p[ok], q[ok], k] = -np.inf

        return feed

    return strips(a, b, kernel, "a long, b long, rank int, from_beat long, to_beat long, score double", size=128)


def _natural(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (track, a, b, from_beat, to_beat) that are not among those found, as their only junction."""
    none = pairs.join(found.where("rank = 1").select("track", "a", "b"), ["track", "a", "b"], "left_anti")
    return none.select("track", "a", "b", F.lit(1).alias("rank"), "from_beat", "to_beat", F.lit(0.0).alias("score"))


def assemble_blocks(queue: DataFrame, blocks: DataFrame, junctions: DataFrame, rank: int = 1) -> DataFrame:
    """(run_id, pos, block, entry, exit, cost): the queue (run_id, track, pos, block), each block entered and left where its junctions
    with its neighbours say (the alternative `rank`, or the last there is below it), else at its own bounds."""
    w = Window.partitionBy("run_id").orderBy("pos")
    q = queue.withColumns({"before": F.lag("block").over(w), "after": F.lead("block").over(w)}).join(blocks.select("track", "block", "entry", "exit"), ["track", "block"])
    j = junctions.where((F.col("rank") <= rank) & (F.col("score") > 0)).groupBy("track", "a", "b").agg(F.max(F.struct("rank", "from_beat", "to_beat", "score")).alias("j"))
    into = j.select("track", F.col("a").alias("before"), F.col("b").alias("block"), F.col("j.to_beat").alias("to_beat"))
    out = j.select("track", F.col("a").alias("block"), F.col("b").alias("after"), F.col("j.from_beat").alias("from_beat"), F.col("j.score").alias("score"))
    q = q.join(into, ["track", "before", "block"], "left").join(out, ["track", "block", "after"], "left")
    return q.select("run_id", "pos", "block", F.coalesce("to_beat", "entry").alias("entry"), F.coalesce("from_beat", "exit").alias("exit"), F.when(F.col("after").isNotNull(), 1 - F.coalesce("score", F.lit(0.0))).otherwise(0.0).alias("cost"))


def crossfade_for_quality(q: Column) -> Column:
    return F.when(q >= 0.65, 0.075).when(q >= 0.40, 0.15).otherwise(0.3)


def path_to_runs(steps: DataFrame) -> DataFrame:
    """(run_id, clip, start_beat, end_beat, pos): maximal runs of consecutive beats of (run_id, pos, beat); islands of beat - pos."""
    w = Window.partitionBy("run_id").orderBy("pos")
    s = steps.withColumn("new", F.coalesce((F.col("beat") != F.lag("beat").over(w) + 1).cast("int"), F.lit(1)))
    s = s.withColumn("clip", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return s.groupBy("run_id", "clip").agg(F.min("beat").alias("start_beat"), F.max("beat").alias("end_beat"), F.min("pos").alias("pos"))


def clip_times(clips: DataFrame, beats: DataFrame, tail: float) -> DataFrame:
    """clips (run_id, track, ...) with source_start and source_end: the time (track, beat, t) of the first beat, and of the one after
    the last beat (`tail` after the last beat of a track)."""
    w = Window.partitionBy("track").orderBy("beat")
    b = beats.withColumn("end", F.coalesce(F.lead("t").over(w), F.col("t") + tail))
    c = clips.join(b.select("track", F.col("beat").alias("start_beat"), F.col("t").alias("source_start")), ["track", "start_beat"])
    return c.join(b.select("track", F.col("beat").alias("end_beat"), F.col("end").alias("source_end")), ["track", "end_beat"])


def extend_full_track(clips: DataFrame, duration: DataFrame) -> DataFrame:
    """clips with the first one from 0 and the last one to the track's duration (track, duration, n), unless the path starts after
    beat 2 or ends before the last three."""
    w = Window.partitionBy("run_id")
    c = clips.join(duration, "track").withColumns({"lo": F.min("clip").over(w), "hi": F.max("clip").over(w)})
    start = F.when((F.col("clip") == F.col("lo")) & (F.col("start_beat") <= 2), 0.0).otherwise(F.col("source_start"))
    end = F.when((F.col("clip") == F.col("hi")) & (F.col("end_beat") >= F.col("n") - 3), F.col("duration")).otherwise(F.col("source_end"))
    return c.withColumns({"source_start": start, "source_end": end}).select(clips.columns)


def overlap_seconds(base: Column, preferred: Column, vocal: Column, label_match: Column, entry_support: Column, exit_support: Column, threshold: float = 0.28, across: float = 0.30, within: float = 0.18, supported: float = 0.85) -> Column:
    """The longer of base and preferred overlap (none or 0: base). Where vocals are present it is raised: to `across` seconds if the labels
    differ, to `within` if they agree but the weaker of entry and exit is not supported."""
    want = F.greatest(base, F.coalesce(F.when(preferred > 0, preferred), base))
    raised = F.when(label_match < 0.5, F.greatest(want, F.lit(across))).when(F.least(entry_support, exit_support) < supported, F.greatest(want, F.lit(within)))
    return F.when(vocal >= threshold, F.coalesce(raised, want)).otherwise(want)


def timeline(clips: DataFrame) -> DataFrame:
    """clips (run_id, clip, duration, overlap_before, gap_after) with timeline_start and timeline_end: durations added up less
    overlaps and with gaps."""
    w = Window.partitionBy("run_id").orderBy("clip")
    step = F.col("duration") - F.coalesce(F.lead("overlap_before").over(w), F.lit(0.0)) + F.col("gap_after")
    c = clips.withColumn("__s", step)
    start = F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return c.withColumn("timeline_start", F.coalesce(start, F.lit(0.0))).withColumn("timeline_end", F.col("timeline_start") + F.col("duration")).drop("__s")


def region_trim(clips: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """clips with the first start and the last end moved to the region's (columns region_start, region_end) where they are within
    the tolerance; the timeline moves along with the first."""
    w = Window.partitionBy("run_id")
    c = clips.withColumns({"lo": F.min("clip").over(w), "hi": F.max("clip").over(w)})
    first = (F.col("clip") == F.col("lo")) & (F.abs(F.col("source_start") - F.col("region_start")) <= tolerance)
    last = (F.col("clip") == F.col("hi")) & (F.abs(F.col("source_end") - F.col("region_end")) <= tolerance)
    c = c.withColumn("moved", F.when(first, F.col("source_start") - F.col("region_start")).otherwise(0.0)).withColumn("shift", F.sum("moved").over(w))
    c = c.withColumns({"source_start": F.when(first, F.col("region_start")).otherwise(F.col("source_start")), "source_end": F.when(last, F.col("region_end")).otherwise(F.col("source_end"))})
    return c.withColumn("timeline_start", F.when(first, F.col("timeline_start")).otherwise(F.col("timeline_start") + F.col("shift"))).select(clips.columns)


def onset_in_window(energy: DataFrame, marks: DataFrame, before: int, after: int, smooth: int = 3) -> DataFrame:
    """(track, mark, onset): the place in [i - before, i + after] of each mark (track, mark, i) with the largest rise of the box-smoothed
    energy (track, i, x), the rise smoothed again; the lowest of equals; the mark's own place where nothing is there."""
    w = Window.partitionBy("track").orderBy("i")
    box = w.rowsBetween(-(smooth // 2), smooth // 2)
    e = energy.withColumn("s", F.avg("x").over(box)).withColumn("r", F.col("s") - F.lag("s").over(w)).withColumn("r", F.avg(F.coalesce("r", F.lit(0.0))).over(box))
    ask = marks.select("track", "mark", F.col("i").alias("own"), F.explode(F.sequence(F.col("i") - before, F.col("i") + after)).alias("i"))
    best = ask.join(e.select("track", "i", "r"), ["track", "i"]).groupBy("track", "mark").agg(F.max(F.struct(F.round("r", 9), -F.col("i"), F.col("i"))).alias("b"))
    return marks.join(best, ["track", "mark"], "left").select("track", "mark", F.coalesce("b.i", "i").alias("onset"))


def _stacks(*columns: pd.Series) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Rows whose arrays are there and of one length: (their numbers, an array (rows, 1, length) for each column)."""
    rows: dict[int, list[int]] = {}
    for k, v in enumerate(zip(*columns)):
        if all(x is not None for x in v) and len({len(x) for x in v}) == 1:
            rows.setdefault(len(v[0]), []).append(k)
    for n, at in rows.items():
        for lo in range(0, len(at), max(1, (1 << 20) // max(n, 1))):
            part = at[lo : lo + max(1, (1 << 20) // max(n, 1))]
            yield part, [np.array([c.iloc[k] for k in part], dtype=float).reshape(len(part), 1, n) for c in columns]


@F.pandas_udf(T.DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    out = np.full(len(a), W.NONE)
    for at, (x, y) in _stacks(a, b):
        out[at] = W.similarity(x, y)
    return pd.Series(out)


@F.pandas_udf(T.IntegerType())
def _onset(v: pd.Series) -> pd.Series:
    out = np.zeros(len(v), dtype=np.int32)
    for at, (x,) in _stacks(v):
        out[at] = W.onset(x)
    return pd.Series(out)


def window_similarity(a: Column | str, b: Column | str) -> Column:
    """0.8 * correlation + 0.2 * correlation of the differences of two windows of equal length, less their means, Hann tapered; -1 if
    either is silent, missing or under 16 samples. Batches of rows at a time, linear in the samples."""
    return _similarity(a, b)


def splice_pair_score(similarity: Column, energy: Column, position: Column, centre: Column, alignment: Column) -> Column:
    return similarity - 0.10 * energy - 0.15 * position - 0.14 * centre - 0.10 * alignment


def window_onset(v: Column | str) -> Column:
    """Place of the steepest rise of the box-smoothed absolute samples of a window; the first of equals; the middle under 16 samples."""
    return _onset(v)


def pair_penalties(a: Column | str, b: Column | str, n: int, out_shift: Column, in_shift: Column, max_shift: int) -> dict[str, Column]:
    """The four penalties of a pair of windows of n samples, each from 0 to 1: level step in 12 dB, shifts, onsets away from the centre,
    onsets away from each other."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    rms = lambda v: F.sqrt(V.dot(v, v) / n + F.lit(1e-10))
    one = F.lit(1.0)
    oa, ob, centre = window_onset(a), window_onset(b), F.lit(0.5 * max(n - 1, 0))
    return {
        "energy": F.least(one, F.abs(20.0 * F.log10(rms(a) / rms(b))) / 12.0),
        "position": F.least(one, (F.abs(out_shift) + F.abs(in_shift)) / (2.0 * max_shift)) if max_shift > 0 else F.lit(0.0),
        "centre": F.least(one, (F.abs(oa - centre) + F.abs(ob - centre)) / (2.0 * max(1.0, 0.35 * n))),
        "alignment": F.least(one, F.abs(oa - ob) / max(1.0, 0.25 * n)),
    }


def scored_pair(a: Column | str, b: Column | str, n: int, out_shift: Column, in_shift: Column, max_shift: int) -> Column:
    """Similarity of two windows less their penalties; -1 where either is silent."""
    sim = window_similarity(a, b)
    return F.when(sim <= -0.99, -1.0).otherwise(splice_pair_score(sim, **pair_penalties(a, b, n, out_shift, in_shift, max_shift)))


def anchor_score(a: Column | str, b: Column | str, n: int, anchor: Column, vocal: Column, radius: int) -> Column:
    """Quality of two windows of n samples aligned at `anchor`: similarity of the whole and of `radius` samples to either side, the latter
    weighing 0.40 + 0.25 * vocal, less a level step and an anchor near the edge; from 0 to 1. A neighbourhood of under 16 samples
    counts as the whole."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    sim = window_similarity(a, b)
    lo, hi = F.greatest(F.lit(0), anchor - radius), F.least(F.lit(n), anchor + radius)
    cut = lambda v: F.slice(v, (lo + 1).cast("int"), (hi - lo).cast("int"))
    near = F.when(hi - lo >= 16, window_similarity(cut(a), cut(b))).otherwise(sim)
    rms = lambda v: F.sqrt(V.dot(v, v) / n + F.lit(1e-10))
    energy = F.least(F.lit(1.0), F.abs(20.0 * F.log10(rms(a) / rms(b))) / 12.0)
    edge = F.greatest(F.lit(0.0), 1.0 - F.least(anchor, n - anchor) / max(1.0, 0.18 * n))
    w = F.least(F.lit(0.70), 0.40 + 0.25 * V.clip(vocal, 0.0, 1.0))
    unit = lambda x: V.clip((x + 1.0) * 0.5, 0.0, 1.0)
    return F.when(sim <= -0.99, 0.0).otherwise(V.clip((1.0 - w) * unit(sim) + w * unit(near) - 0.08 * energy - 0.04 * edge, 0.0, 1.0))


def junction_scores(pairs: DataFrame, weights: dict[str, float], harmonic: bool = True) -> DataFrame:
    """pairs (track, i, j, ...) with score: the quality of the signals, less the graduated level step, the vocal and the onset penalty,
    0 at least. Signals made here from raw columns where those are there: label (label_i, label_j), section (0.9 * label + 0.1), bar_align
    (leads_i, down_j), energy (rms_i, rms_j), edge_energy (energy_diff_db), centroid (centroid_i, centroid_j); other weighted signals
    must be columns. Penalties need energy_diff_db, vocal_i and vocal_j, onset_j; a missing column means no penalty."""
    from .transitions import linear_match, onset_penalty, quality_score, vocal_discontinuity

    c, have = F.col, set(pairs.columns)
    made = {}
    if {"label_i", "label_j"} <= have:
        made["label"] = F.when((c("label_i") == c("label_j")) & (c("label_i") != "unknown"), 1.0).otherwise(0.0)
        made["section"] = 0.9 * made["label"] + 0.1
    if {"leads_i", "down_j"} <= have:
        made["bar_align"] = F.when(c("leads_i") & c("down_j"), 1.0).otherwise(0.0)
    for name, span in (("rms", 0.2), ("centroid", 0.2)):
        if {f"{name}_i", f"{name}_j"} <= have:
            made["energy" if name == "rms" else name] = linear_match(c(f"{name}_i"), c(f"{name}_j"), span)
    if "energy_diff_db" in have:
        made["edge_energy"] = linear_match(c("energy_diff_db"), F.lit(0.0), 8.0)
    missing = set(weights) - have - set(made)
    if missing:
        raise ValueError(f"no column for the weighted signals {sorted(missing)}")
    p = pairs.withColumns(made)
    less = junction_penalty(c("energy_diff_db")) if "energy_diff_db" in have else F.lit(0.0)
    if {"vocal_i", "vocal_j"} <= have:
        less = less + vocal_discontinuity(c("vocal_i"), c("vocal_j"))
    if "onset_j" in have:
        less = less + F.coalesce(onset_penalty(c("onset_j")), F.lit(0.0))
    return p.withColumn("score", F.greatest(F.lit(0.0), quality_score(weights, harmonic) - less))


def accept_anchor(score: Column, baseline: Column, local: Column, local_baseline: Column, vocal: Column) -> Column:
    return (score >= baseline + 0.02) | ((vocal >= 0.28) & (local >= local_baseline + 0.01))


def resolve_splices(splices: DataFrame, rate: int, teaser_out: float = 0.320, teaser_in: float = 0.180, teaser_gap: float = 0.060) -> DataFrame:
    """splices with fade_out, fade_in, gap (teaser fades) or out_cut, in_start, overlap, all in samples, null where they do not apply.

    splices: successor (sample after the outgoing beat), beat_start and beat_end of the incoming one, crossfade (samples), n_samples of the
    track; teaser (boolean); refined_out and refined_in, anchor_out, anchor_in, anchor_end and anchor_overlap, null where nothing was found. A
    teaser fades out and in around a gap. An anchor takes precedence over a refined cut, and that over the cut half a crossfade after
    the successor and before the beat. The outgoing cut leaves room for the crossfade, the incoming start stays before the beat's end, and
    the overlap is at most what either side has."""
    c, half = F.col, F.floor(F.col("crossfade") / 2)
    samples = lambda sec: F.lit(max(0, round(sec * rate))).cast("long")
    out = F.coalesce(c("anchor_out"), c("refined_out"), c("successor") + half)
    out = F.greatest(c("crossfade"), F.least(out, c("n_samples")))
    start = F.greatest(F.lit(0).cast("long"), F.least(F.coalesce(c("anchor_in"), c("refined_in"), c("beat_start") - half), c("beat_end")))
    room = F.greatest(F.lit(0).cast("long"), F.coalesce(c("anchor_end"), c("beat_end")) - start)
    overlap = F.least(F.coalesce(c("anchor_overlap"), c("crossfade")), out, room)
    cut = lambda x: F.when(~c("teaser"), x).cast("long")
    return splices.withColumns({
        "fade_out": F.when(c("teaser"), samples(teaser_out)), "fade_in": F.when(c("teaser"), samples(teaser_in)), "gap": F.when(c("teaser"), samples(teaser_gap)),
        "out_cut": cut(out), "in_start": cut(start), "overlap": cut(overlap),
    })


def spliced_clips(runs: DataFrame, resolved: DataFrame) -> DataFrame:
    """(run_id, clip, source_start, source_end, fade_in, fade_out, overlap_before, gap_after) in samples, of runs (run_id, clip, first, last:
    samples of the clip as it stands) and the splice after each of them (run_id, clip, ...). A cut replaces the end of the clip before it and the
    start of the one after, whose fades are the overlap; a teaser leaves both and fades them around the gap."""
    w = Window.partitionBy("run_id").orderBy("clip")
    r = runs.select("run_id", "clip", "first", "last").join(resolved.select("run_id", "clip", "teaser", "fade_out", "fade_in", "gap", "out_cut", "in_start", "overlap"), ["run_id", "clip"], "left")
    before = lambda x: F.lag(x).over(w)
    none = F.lit(0).cast("long")
    return r.select(
        "run_id", "clip", F.coalesce(before("in_start"), "first").alias("source_start"), F.coalesce("out_cut", "last").alias("source_end"),
        F.coalesce(before(F.coalesce("overlap", "fade_in")), none).alias("fade_in"), F.coalesce("overlap", "fade_out", none).alias("fade_out"), F.coalesce(before("overlap"), none).alias("overlap_before"), F.coalesce("gap", none).alias("gap_after"),
    )


def junction_gain(clips: DataFrame, samples: DataFrame, least: float = 0.35, most: float = 2.83, silent: float = 1e-6) -> DataFrame:
    """clips (run_id, track, clip, first, n, fade_in, ...) with gain: the level of the samples that the clip before it in the run has in their
    overlap (as many as the clip's fade_in, its last ones) over that of the clip's own, within [least, most]; 1 without an overlap or where
    either is silent. Levels are of the clips as they stand. Every side of an overlap asks for its own places."""
    w, c = Window.partitionBy("run_id").orderBy("clip"), F.col
    before = [F.lag(x).over(w).alias(f"__{x}") for x in ("track", "first", "n")]
    j = clips.select("*", *before).withColumn("__ov", F.when(c("__n").isNotNull(), F.least("fade_in", "n", c("__n"))).cast("long"))
    side = lambda t, first, s: j.where("__ov > 0").select("run_id", "clip", c(t).alias("track"), F.lit(s).alias("s"), "__ov", F.explode(F.sequence(first, first + c("__ov") - 1)).alias("i"))
    ask = side("__track", c("__first") + c("__n") - c("__ov"), "out").unionByName(side("track", c("first"), "in"))
    total = lambda s: F.sum(F.when(c("s") == s, c("x") * c("x")))
    got = ask.join(samples.select("track", "i", "x"), ["track", "i"]).groupBy("run_id", "clip", "__ov").agg(total("out").alias("o"), total("in").alias("n"))
    rms = lambda x: F.sqrt(F.coalesce(x, F.lit(0.0)) / c("__ov") + F.lit(1e-10))
    got = got.select("run_id", "clip", rms(c("o")).alias("o"), rms(c("n")).alias("i"))
    gain = F.when((c("o") > silent) & (c("i") > silent), F.greatest(F.lit(least), F.least(F.lit(most), c("o") / c("i")))).otherwise(F.lit(1.0))
    return clips.join(got.select("run_id", "clip", gain.alias("gain")), ["run_id", "clip"], "left").withColumn("gain", F.coalesce("gain", F.lit(1.0)))


def mixdown(clips: DataFrame, samples: DataFrame, match: bool = False, ramp: int = 4) -> DataFrame:
    """(run_id, i, x): samples (track, i, x) of clips (run_id, track, clip, first, n, at, fade_in, fade_out in samples) at their place on
    the timeline, with equal-power fades, added up. Every clip asks for its own places, so the join is on equality.

    With match the level of each clip is that of the one before in their overlap (junction_gain) at its start, and its own `ramp` overlaps on,
    linear between."""
    c = junction_gain(clips, samples) if match else clips
    c = c.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("i", F.col("first") + F.col("k"))
    up = F.when(F.col("k") < F.col("fade_in"), F.sin(F.lit(math.pi / 2) * (F.col("k") + 0.5) / F.col("fade_in"))).otherwise(1.0)
    left = F.col("n") - F.col("k")
    down = F.when(left <= F.col("fade_out"), F.sin(F.lit(math.pi / 2) * (left - 0.5) / F.col("fade_out"))).otherwise(1.0)
    level = F.lit(1.0)
    if match:
        size = F.least(F.col("fade_in") * ramp, F.col("n"))
        level = F.when(F.col("k") < size, F.col("gain") + (1 - F.col("gain")) * F.col("k") / F.greatest(size - 1, F.lit(1))).otherwise(1.0)
    x = c.join(samples, ["track", "i"]).select("run_id", (F.col("at") + F.col("k")).alias("i"), (F.col("x") * up * down * level).alias("x"))
    return x.groupBy("run_id", "i").agg(F.sum("x").alias("x"))


def weights_hash(weights: Column | str, defaults: dict[str, float], quantum: float = 1e-9) -> Column:
    """Hash of a map of weights in steps of the quantum: names that are not there have their default, names that defaults do not know count if they
    are not 0; the order of names does not matter. 0 for the defaults, and for a null map."""
    w = F.col(weights) if isinstance(weights, str) else weights
    steps = lambda v: F.round(v / F.lit(quantum)).cast("long")
    names = sorted(defaults)
    known = [F.coalesce(steps(F.coalesce(w[k], F.lit(float(defaults[k])))), F.lit(0).cast("long")) for k in names]
    other = F.filter(F.transform(F.map_entries(w), lambda e: F.struct(e["key"].alias("k"), steps(e["value"]).alias("v"))), lambda e: ~e["k"].isin(*names) & (F.coalesce(e["v"], F.lit(0).cast("long")) != 0))
    plain = F.size(other) <= 0
    for k, v in zip(names, known):
        plain = plain & (v == steps(F.lit(float(defaults[k]))))
    return F.when(w.isNull() | plain, F.lit(0).cast("long")).otherwise(F.xxhash64(*known, F.to_json(F.array_sort(other))))


def request_key(runs: DataFrame, times: list[str], blocked: str, quantum: float = 0.05, others: list[str] = [], weights: str | None = None, defaults: dict[str, float] | None = None) -> DataFrame:
    """runs with key: hash of the times in steps of the quantum (null counts as none), of the set of blocked pairs, of other columns as they are,
    and of the weights (a map column) against the defaults."""
    q = [F.round(F.col(t) / F.lit(quantum)).cast("long") for t in times]
    more = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in others] + ([weights_hash(weights, defaults or {})] if weights else [])
    return runs.withColumn("key", F.xxhash64(*(F.coalesce(x, F.lit(-(2**62))) for x in q), F.to_json(F.array_sort(F.array_distinct(blocked))), *more))


def distinct_requests(keyed: DataFrame, id: str) -> tuple[DataFrame, DataFrame]:
    """(jobs, asked): one row of keyed for each key, that of the smallest id, with `requests`, how many asked for it; and (id, key) of every
    request, to which a job's result goes by its key."""
    w = Window.partitionBy("key")
    first = keyed.groupBy("key").agg(F.min(id).alias("__id"), F.count("*").alias("requests"))
    jobs = keyed.join(first, "key").where(F.col(id) == F.col("__id")).withColumn("__r", F.row_number().over(w.orderBy(id))).where("__r = 1").drop("__r", "__id")
    return jobs, keyed.select(id, "key")


def keep_latest(results: DataFrame, source: str, order: str, n: int) -> DataFrame:
    w = Window.partitionBy(source).orderBy(F.desc(order))
    return results.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def clip_region(start: Column, end: Column, item_start: Column, item_end: Column, least: float = 6.0, slack: float = 0.1) -> Column:
    """struct(start, end) of the selection inside the item, from the item's start; null if under `least` or all of the item."""
    a, b = F.greatest(start, item_start) - item_start, F.least(end, item_end) - item_start
    whole = (a <= slack) & (b >= item_end - item_start - slack)
    return F.when((b - a >= least) & ~whole, F.struct(a.alias("start"), b.alias("end")))


def cells_from_delimiters(cuts: DataFrame, ends: DataFrame, apart: float = 1e-3) -> DataFrame:
    """(track, cell, start, end): consecutive pairs of the cut times (track, t) with 0 and the end (track, end), those merged that are
    closer than `apart` to the last one kept."""
    u = cuts.select("track", "t").union(ends.select("track", F.lit(0.0))).union(ends.select("track", "end"))
    arr = u.groupBy("track").agg(F.array_sort(F.collect_list("t")).alias("p"))
    kept = F.aggregate(F.slice("p", 2, F.greatest(F.size("p"), F.lit(1))), F.slice("p", 1, 1), lambda a, x: F.when(x - F.element_at(a, -1) < apart, a).otherwise(F.concat(a, F.array(x))))
    k = arr.withColumn("k", kept)
    pairs = F.zip_with(F.slice("k", 1, F.greatest(F.size("k") - 1, F.lit(0))), F.slice("k", 2, F.greatest(F.size("k") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    return k.select("track", F.posexplode(pairs).alias("cell", "c")).select("track", F.col("cell").cast("long").alias("cell"), "c.start", "c.end")


def transition_times(clips: DataFrame, labels: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """(run_id, splice, at, from_beat, to_beat, from_label, to_label[, quality, bucket]): where each clip but the first of a run (run_id, track, clip,
    start_beat, end_beat, timeline_start) begins on the timeline, with the labels (track, beat, label) on both sides, and with the quality of
    its pair of beats (track, i, j, quality) and what that is called, null and unknown where there is none."""
    w = Window.partitionBy("run_id").orderBy("clip")
    c = clips.withColumn("from_beat", F.lag("end_beat").over(w)).where("from_beat is not null")
    of = lambda beat, out: labels.select("track", F.col("beat").alias(beat), F.col("label").alias(out))
    c = c.join(of("from_beat", "from_label"), ["track", "from_beat"], "left").join(of("start_beat", "to_label"), ["track", "start_beat"], "left")
    more = []
    if quality is not None:
        from .transitions import quality_bucket

        c = c.join(quality.select("track", F.col("i").alias("from_beat"), F.col("j").alias("start_beat"), "quality"), ["track", "from_beat", "start_beat"], "left")
        more = ["quality", quality_bucket(F.col("quality")).alias("bucket")]
    return c.select("run_id", (F.col("clip") - 1).alias("splice"), F.col("timeline_start").alias("at"), "from_beat", F.col("start_beat").alias("to_beat"), "from_label", "to_label", *more)


def queued_compatibility(
    queue: DataFrame, blocks: DataFrame, quality: DataFrame | Callable[[DataFrame], DataFrame], downbeats: DataFrame, window: int = 8, drift: float = 0.10, top: int = 5, apart: int = 4, separation: int = 4, outside: int = 8, fragment: float = 0.03, short: int = 4, n: DataFrame | None = None,
) -> DataFrame:
    """(track, a, b, rank, from_beat, to_beat, score) for blocks that follow each other in a queue (run_id, track, pos, block): pairs of beats (track, i, j,
    quality) anywhere in the two blocks (track, block, entry, exit) or up to `outside` beats around them that leave before a downbeat (track,
    beat) and land on one. Instead of a table, quality may be a function that adds it to the pairs asked for, so that no others are scored.

    The quality loses drift per beat moved from exit and entry, over the window, and `fragment` for the share of either block that is not
    played; only what stays over 0 counts. Pairs are `apart` beats from each other unless the blocks are neighbours; blocks of up to `short`
    beats know neither that nor fragments. Best first, each at least `separation` beats from those taken on one side; the fold runs over
    one pair's candidates. Pairs without any get their natural junction with score 0."""
    w, c, zero = Window.partitionBy("run_id").orderBy("pos"), F.col, F.lit(0).cast("long")
    asked = queue.withColumn("b", F.lead("block").over(w)).where("b is not null").select("track", c("block").alias("a"), "b").distinct()
    of = lambda s: blocks.select("track", c("block").alias(s), c("entry").alias(f"{s}_in"), c("exit").alias(f"{s}_out"))
    asked = asked.join(of("a"), ["track", "a"]).join(of("b"), ["track", "b"])
    place = lambda s, beat: of(s).select("track", s, F.explode(F.sequence(F.greatest(zero, c(f"{s}_in") - outside), c(f"{s}_out") + outside)).alias(beat))
    leave = place("a", "i").join(downbeats.select("track", (c("beat") - 1).alias("i")), ["track", "i"], "left_semi")
    land = place("b", "j").join(downbeats.select("track", c("beat").alias("j")), ["track", "j"], "left_semi")
    x = scored(asked.join(leave, ["track", "a"]).join(land, ["track", "b"]).where("i <> j"), quality)
    if n is not None:
        x = x.join(n, "track").where(c("i") <= c("n") - 2)
    size_a, size_b = c("a_out") - c("a_in") + 1, c("b_out") - c("b_in") + 1
    brief, follows = (size_a <= short) | (size_b <= short), c("a_out") + 1 == c("b_in")
    x = x.where(brief | follows | (F.abs(c("j") - c("i")) >= apart))
    kept = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    lost = (1 - kept((c("a_out") + 1 - c("i")) / size_a)) + (1 - kept((c("j") - c("b_in")) / size_b))
    score = c("quality") - F.lit(drift / max(1, window)) * (F.abs(c("i") - c("a_out")) + F.abs(c("j") - c("b_in"))) - F.when(brief, 0.0).otherwise(F.lit(fragment) * lost)
    x = x.withColumn("score", score).where("score > 0")
    p = x.groupBy("track", "a", "b").agg(F.array_sort(F.collect_list(F.struct((-F.round("score", 9)).alias("o"), "i", "j", "score"))).alias("p"))
    none = F.expr("cast(array() as array<struct<o:double,i:bigint,j:bigint,score:double>>)")
    near = lambda y, z: (F.abs(y["i"] - z["i"]) < separation) & (F.abs(y["j"] - z["j"]) < separation)
    taken = F.aggregate("p", none, lambda a, z: F.when((F.size(a) >= top) | F.exists(a, lambda y: near(y, z)), a).otherwise(F.concat(a, F.array(z))))
    found = p.select("track", "a", "b", F.posexplode(taken).alias("rank", "z")).select("track", "a", "b", (c("rank") + 1).alias("rank"), c("z.i").alias("from_beat"), c("z.j").alias("to_beat"), "z.score")
    return found.unionByName(_natural(asked.select("track", "a", "b", c("a_out").alias("from_beat"), c("b_in").alias("to_beat")), found))
