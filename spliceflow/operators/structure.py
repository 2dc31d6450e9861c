"""Bars, segments and labels. Segments are (track, seg, start, end, label, ...); times and beats are half open."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from .events import snap_nearest
from .beats import assign_interval
from .similarity import best_lags, met_bars, pairs, snippet_similarity, strips


def _w(*order: str):
    return Window.partitionBy("track").orderBy(*order)


def islands(rows: DataFrame, order: str, label: str) -> DataFrame:
    """(track, seg, label, first, last, n): runs of equal labels in order."""
    w = _w(order)
    r = rows.withColumn("__new", F.coalesce((F.col(label) != F.lag(label).over(w)).cast("int"), F.lit(1)))
    r = r.withColumn("seg", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return r.groupBy("track", "seg").agg(F.first(label).alias("label"), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def beats_to_bars(beats: DataFrame, downbeats: DataFrame, every: int | None = None) -> DataFrame:
    """(track, bar, start, end) in beats: the beats (track, beat, t) nearest to the downbeats (track, t), equal neighbours dropped; with `every`, tracks
    without downbeats have a bar at every so many beats."""
    near = snap_nearest(downbeats.select("track", "t"), beats.select("track", F.col("beat").alias("j"), "t")).where("j is not null")
    b = near.select("track", "j").distinct()
    if every:
        plain = beats.join(downbeats.select("track").distinct(), "track", "left_anti").withColumn("__r", F.row_number().over(_w("beat")) - 1)
        b = b.unionByName(plain.where(F.col("__r") % every == 0).select("track", F.col("beat").alias("j")))
    b = b.withColumns({"end": F.lead("j").over(_w("j")), "bar": F.row_number().over(_w("j")).cast("long") - 1})
    return b.where(F.col("end").isNotNull()).select("track", "bar", F.col("j").alias("start"), "end")


def bar_features(beats: DataFrame, downbeats: DataFrame) -> DataFrame:
    """(track, bar, start, t, end_t, feat): mean vector of the beats (track, beat, t, feat) of each bar, from one beat nearest to a downbeat
    (track, t) to the next; the last bar goes on to the track's last beat, and ends a beat's gap after it (0.5 for a single beat). Tracks of
    under two beats or downbeats have none."""
    near = snap_nearest(downbeats.select("track", "t"), beats.select("track", F.col("beat").alias("j"), "t")).where("j is not null")
    w = _w("beat")
    n = beats.groupBy("track").agg(F.count("*").alias("n"), F.max_by("t", "beat").alias("last_t"))
    gap = beats.withColumn("gap", F.col("t") - F.lag("t").over(w)).groupBy("track").agg(F.max_by("gap", "beat").alias("gap"))
    enough = downbeats.groupBy("track").agg(F.count("*").alias("m")).where("m >= 2").join(n.where("n >= 2"), "track").join(gap, "track")
    starts = near.select("track", F.col("j").alias("beat")).distinct().join(enough.select("track", "n", "last_t", "gap"), "track")
    starts = starts.join(beats.select("track", "beat", "t"), ["track", "beat"])
    b = starts.withColumns({"bar": F.row_number().over(w).cast("long") - 1, "to": F.coalesce(F.lead("beat").over(w), F.col("n")), "end_t": F.coalesce(F.lead("t").over(w), F.col("last_t") + F.coalesce("gap", F.lit(0.5)))})
    asked = b.select("track", "bar", F.col("beat").alias("start"), "t", "end_t", F.explode(F.sequence(F.col("beat"), F.col("to") - 1)).alias("beat"))
    x = asked.join(beats.select("track", "beat", F.posexplode("feat").alias("d", "v")), ["track", "beat"])
    m = x.groupBy("track", "bar", "start", "t", "end_t", "d").agg(F.avg("v").alias("v"))
    return m.groupBy("track", "bar", "start", "t", "end_t").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda p: p["v"]).alias("feat"))


def block_scores(sim: DataFrame, n: DataFrame, band: int = 7, longest: int = 16) -> DataFrame:
    """(track, start, len, score) of every block of up to `longest` bars: the sum of similarities at distance 1..band inside it over
    len^2, less a penalty for lengths that are not 8, 4k or 2k bars (0, .25, .5, 1)."""
    starts = n.select("track", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("start"))
    b = starts.withColumn("len", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(longest).cast("long"), F.col("n") - F.col("start")))))
    e = sim.where((F.col("j") > F.col("i")) & (F.col("j") - F.col("i") <= band))
    # an edge lies in the blocks that start up to `longest` before it, so it is spread to those starts and met by equality
    e = e.withColumn("start", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.col("j") - longest + 1), F.col("i"))))
    e = e.groupBy("track", "start", (F.col("j") - F.col("start") + 1).alias("need")).agg(F.sum("v").alias("v"))
    s = b.join(e, ["track", "start"], "left").groupBy("track", "start", "len").agg(F.coalesce(F.sum(F.when(F.col("need") <= F.col("len"), 2 * F.col("v"))), F.lit(0.0)).alias("v"))
    penalty = F.when(F.col("len") == 8, 0.0).when(F.col("len") % 4 == 0, 0.25).when(F.col("len") % 2 == 0, 0.5).otherwise(1.0)
    return s.select("track", "start", "len", (F.col("v") / (F.col("len") * F.col("len"))).alias("conv"), penalty.alias("penalty"))


def optimal_partition(scores: DataFrame, weight: float = 0.1, least: int = 2) -> DataFrame:
    """(track, seg, start, end): the cut of each track's bars into blocks with the largest sum of conv * len - penalty * weight * max
    conv. A short recursion over one track's bars; tracks run in parallel."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int((pdf["start"] + pdf["len"]).max())
        gain = pdf["conv"] * pdf["len"] - pdf["penalty"] * weight * pdf["conv"].max()
        best, back = np.full(n + 1, -np.inf), np.zeros(n + 1, dtype=int)
        best[0] = 0
        by_end: dict[int, list] = {}
        for s, ln, g in zip(pdf["start"], pdf["len"], gain):
            by_end.setdefault(int(s + ln), []).append((int(s), g, int(ln)))
        for e in range(1, n + 1):
            for s, g, ln in sorted(by_end.get(e, [])):
                if (ln >= least or n < least) and best[s] + g > best[e]:
                    best[e], back[e] = best[s] + g, s
        cuts, e = [n], n
        while e > 0:
            e = back[e]
            cuts.append(e)
        cuts = cuts[::-1]
        return pd.DataFrame({"track": pdf["track"].iloc[0], "seg": range(len(cuts) - 1), "start": cuts[:-1], "end": cuts[1:]})

    return scores.groupBy("track").applyInPandas(solve, "track long, seg long, start long, end long")


def group_similar(segments: DataFrame, least: float = 0.80) -> DataFrame:
    """(track, seg, cluster): in order, each segment (track, seg, feat) joins the first group whose founder it resembles, or founds one."""
    s = segments.select("track", F.col("seg").alias("beat"), "feat")
    e = pairs(s, s, F.col("j") < F.col("i")).where(V.cosine("fi", "fj") >= least).groupBy("track", F.col("i").alias("seg")).agg(F.array_sort(F.collect_list("j")).alias("like"))
    arr = segments.select("track", "seg").join(e, ["track", "seg"], "left").groupBy("track").agg(F.array_sort(F.collect_list(F.struct("seg", F.coalesce("like", F.expr("cast(array() as array<bigint>)")).alias("like")))).alias("p"))
    start = F.struct(F.expr("cast(array() as array<bigint>)").alias("founders"), F.expr("cast(array() as array<struct<seg:bigint,cluster:bigint>>)").alias("out"))

    def step(a: Column, x: Column) -> Column:
        found = F.get(F.filter(a["founders"], lambda f: F.array_contains(x["like"], f)), F.lit(0))
        cluster = F.coalesce(found, x["seg"])
        return F.struct(F.when(found.isNull(), F.concat(a["founders"], F.array(x["seg"]))).otherwise(a["founders"]).alias("founders"), F.concat(a["out"], F.array(F.struct(x["seg"].alias("seg"), cluster.alias("cluster")))).alias("out"))

    return arr.select("track", F.explode(F.aggregate("p", start, step, lambda a: a["out"])).alias("s")).select("track", "s.seg", "s.cluster")


def label_by_repetition(segments: DataFrame, names: tuple = ("chorus", "verse", "bridge")) -> DataFrame:
    """segments (track, seg, cluster, energy) with label: clusters of two or more ranked by mean energy get the names in turn, the
    last name going to all further ones; clusters of one are bridges."""
    c = segments.groupBy("track", "cluster").agg(F.count("*").alias("m"), F.avg("energy").alias("e"))
    c = c.withColumn("r", F.row_number().over(Window.partitionBy("track", F.col("m") >= 2).orderBy(F.desc(F.round("e", 9)), "cluster")))
    name = F.when(F.col("m") < 2, "bridge").otherwise(F.get(F.array(*map(F.lit, names)), F.least(F.col("r") - 1, F.lit(len(names) - 1))))
    return segments.join(c.select("track", "cluster", name.alias("label")), ["track", "cluster"])


def mark_intro_outro(segments: DataFrame, duration: DataFrame, early: float = 0.2, late: float = 0.8) -> DataFrame:
    """segments with the first one intro if it ends by `early` of the duration, the last one outro if it starts from `late` on."""
    w = Window.partitionBy("track")
    s = segments.join(duration, "track").withColumns({"lo": F.min("seg").over(w), "hi": F.max("seg").over(w)})
    label = F.when((F.col("hi") - F.col("lo") < 2), F.col("label")).when((F.col("seg") == F.col("lo")) & (F.col("end") <= early * F.col("duration")), "intro").when((F.col("seg") == F.col("hi")) & (F.col("start") >= late * F.col("duration")), "outro").otherwise(F.col("label"))
    return s.withColumn("label", label).select(segments.columns)


def merge_same_label(segments: DataFrame) -> DataFrame:
    """(track, seg, start, end, label, confidence): neighbours of one label merged; confidences averaged pairwise from left to right."""
    w = _w("seg")
    s = segments.withColumn("new", F.coalesce((F.col("label") != F.lag("label").over(w)).cast("int"), F.lit(1))).withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    m = s.groupBy("track", "g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("label").alias("label"), F.array_sort(F.collect_list(F.struct("seg", "confidence"))).alias("c"))
    conf = F.aggregate(F.slice("c", 2, F.greatest(F.size("c"), F.lit(1))), F.get("c", F.lit(0))["confidence"], lambda a, x: (a + x["confidence"]) / 2)
    return m.select("track", (F.col("g") - 1).cast("long").alias("seg"), "start", "end", "label", conf.alias("confidence"))


#: Labels of the ends of a track, and those that a short segment passes on to the one before it (fixed values).
ENDS, SECTIONS = ("intro", "outro"), ("bridge", "verse", "chorus")


def _joined(parts: list[dict], like: dict) -> dict:
    """One segment from the first start to the last end, labelled as one of the parts, with the mean confidence of all."""
    return {"start": parts[0]["start"], "end": parts[-1]["end"], "label": like["label"], "cluster": like["cluster"], "confidence": sum(p["confidence"] for p in parts) / len(parts)}


def _neighbours_joined(segments: list[dict]) -> list[dict]:
    """Neighbours of one label as one segment, confidences averaged pairwise from left to right, of the first one's cluster."""
    out: list[dict] = []
    for s in segments:
        if out and out[-1]["label"] == s["label"]:
            out[-1] = _joined([out[-1], s], out[-1])
        else:
            out.append(s)
    return out


def _short_ones_joined(segments: list[dict], least: float, bridge: float) -> list[dict]:
    """One pass from left to right: a short segment goes to the two around it where these agree, or to one of its own label before it."""
    out: list[dict] = []
    ahead = segments[::-1]
    while ahead:
        s = ahead.pop()
        size, before, after = s["end"] - s["start"], out[-1] if out else None, ahead[-1] if ahead else None
        if before and after and before["label"] == after["label"] and (size < 0.75 * least or (size <= bridge and s["label"] == "bridge" and before["label"] not in ENDS)):
            out[-1] = _joined([before, s, ahead.pop()], before)
        elif before and before["label"] == s["label"] and s["label"] in SECTIONS and size < 0.6 * least:
            out[-1] = _joined([before, s], s)
        else:
            out.append(s)
    return out


def _shortest_joined(s: list[dict]) -> list[dict]:
    """The first of the shortest inner segments goes to both sides where they agree, else to the longer one, of equals the right."""
    k = min(range(1, len(s) - 1), key=lambda k: s[k]["end"] - s[k]["start"])
    left, right = s[k - 1], s[k + 1]
    if left["label"] == right["label"]:
        return [*s[: k - 1], _joined(s[k - 1 : k + 2], left), *s[k + 2 :]]
    if right["end"] - right["start"] >= left["end"] - left["start"]:
        return [*s[:k], _joined([s[k], right], right), *s[k + 2 :]]
    return [*s[: k - 1], _joined([left, s[k]], left), *s[k + 1 :]]


def consolidate(segments: DataFrame, duration: DataFrame | None = None, least: float = 10.0, bridge: float = 8.0, most: int = 12) -> DataFrame:
    """(track, seg, start, end, label, cluster, confidence) of segments (track, seg, start, end, label[, cluster, confidence]): neighbours of one label
    are joined; then, until nothing changes, short ones between equal labels or after their own; then the shortest inner ones until `most`
    are left. With the tracks' duration (track, duration) the first begins at 0 and is the intro if it began in the first 15 %, and the last
    ends with the track and is the outro if it ended in the last 15 %. State runs along one track's segments; tracks run in parallel."""
    cols = set(segments.columns)
    s = segments.withColumns({"cluster": F.col("cluster").cast("long") if "cluster" in cols else F.lit(None).cast("long"), "confidence": F.col("confidence").cast("double") if "confidence" in cols else F.lit(None).cast("double")})
    s = s.join(duration.select("track", "duration"), "track", "left") if duration is not None else s.withColumn("duration", F.lit(None).cast("double"))
    kind = dict(segments.dtypes)["track"]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seg")
        rows = [{"start": a, "end": b, "label": lab, "cluster": c, "confidence": f} for a, b, lab, c, f in pdf[["start", "end", "label", "cluster", "confidence"]].itertuples(index=False)]
        now, last = _neighbours_joined(rows), None
        while now != last and len(now) != (len(last) if last else -1):
            last = now
            now = _neighbours_joined(_short_ones_joined(last, least, bridge))
        while len(now) > max(2, most):
            now = _neighbours_joined(_shortest_joined(now))
        whole = pdf["duration"].iloc[0]
        if now and not pd.isna(whole):
            now[0] = now[0] | {"start": 0.0, "label": "intro" if now[0]["start"] < 0.15 * whole else now[0]["label"]}
            now[-1] = now[-1] | {"end": whole, "label": "outro" if now[-1]["end"] > 0.85 * whole else now[-1]["label"]}
        out = pd.DataFrame(now).assign(track=pdf["track"].iloc[0], seg=range(len(now)))[["track", "seg", "start", "end", "label", "cluster", "confidence"]]
        return out.astype({"cluster": "Int64", "confidence": "Float64" if out["confidence"].isna().any() else float})

    return s.select("track", "seg", "start", "end", "label", "cluster", "confidence", "duration").groupBy("track").applyInPandas(solve, f"track {kind}, seg long, start double, end double, label string, cluster long, confidence double")


def segment_rms(samples: DataFrame, segments: DataFrame, rate: float) -> DataFrame:
    """segments (track, seg, start, end in seconds) with energy: the RMS of their samples (track, i, x), of at least one."""
    n = samples.groupBy("track").agg((F.max("i") + 1).alias("n"))
    last, c = F.col("n") - 1, F.col
    at = segments.join(n, "track").withColumn("lo", F.greatest(F.lit(0).cast("long"), F.least((c("start") * F.lit(rate)).cast("long"), last)))
    at = at.withColumn("hi", F.greatest(c("lo") + 1, F.least((c("end") * F.lit(rate)).cast("long"), c("n"))))
    s = assign_interval(samples.select("track", c("i").alias("frame"), "x"), at.select("track", c("seg").alias("beat"), c("lo").alias("start"), c("hi").alias("end")))
    e = s.groupBy("track", c("beat").alias("seg")).agg(F.sqrt(F.avg(c("x") * c("x"))).alias("energy"))
    return segments.join(e, ["track", "seg"], "left")


def boundary_confidence(segments: DataFrame, novelty: DataFrame, frame_seconds: float, first: float = 0.8) -> DataFrame:
    """segments with confidence: half, and half of the novelty (track, i, novelty) in the frame of their start (the last one beyond the end), 1
    at most; `first` for the first of a track and where there is no novelty. A lookup of single frames, joined on equality."""
    w, c = Window.partitionBy("track"), F.col
    n = novelty.groupBy("track").agg(F.max("i").alias("n"))
    s = segments.withColumn("__first", F.min("seg").over(w)).join(n, "track", "left").withColumn("i", F.least((c("start") / F.lit(frame_seconds)).cast("long"), c("n")))
    s = s.join(novelty.select("track", "i", "novelty"), ["track", "i"], "left")
    value = F.when((c("seg") == c("__first")) | c("novelty").isNull(), F.lit(first)).otherwise(F.least(F.lit(1.0), 0.5 + 0.5 * c("novelty")))
    return s.withColumn("confidence", value).select(*segments.columns, "confidence")


def choose_structure(bar_path: DataFrame, novelty_path: DataFrame, downbeats: DataFrame, least_downbeats: int = 4, least_segments: int = 5) -> DataFrame:
    """The segments of the bar path for tracks with enough downbeats (track, n) and segments, else those of the novelty path; tagged."""
    good = bar_path.groupBy("track").count().where(F.col("count") >= least_segments).join(downbeats.where(F.col("n") >= least_downbeats), "track").select("track")
    return bar_path.join(good, "track", "left_semi").withColumn("path", F.lit("bars")).unionByName(novelty_path.join(good, "track", "left_anti").withColumn("path", F.lit("novelty")))


def beats_to_segments(beats: DataFrame, segments: DataFrame) -> DataFrame:
    """(track, beat, seg, label, boundary): the segment whose start is the last at or before the beat's time and that has not ended;
    boundary where it differs from that of the beat before. Segments of a track do not overlap, but a later one wins at equal starts."""
    marks = segments.select("track", F.col("start").alias("t"), F.struct("seg", "end", "label").alias("s"))
    u = beats.select("track", "beat", "t").unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy("track").orderBy("t", F.col("s").isNull(), "s.seg").rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("s", F.last("s", ignorenulls=True).over(w)).where("beat is not null")
    u = u.withColumn("s", F.when(F.col("t") < F.col("s.end"), F.col("s"))).select("track", "beat", F.col("s.seg").alias("seg"), F.col("s.label").alias("label"))
    before = F.lag("seg").over(_w("beat"))
    return u.withColumn("boundary", F.coalesce(~F.col("seg").eqNullSafe(before) & (F.col("beat") > F.min("beat").over(Window.partitionBy("track"))), F.lit(False)))


def segment_similarity(segments: DataFrame) -> DataFrame:
    """(track, i, j, v): 0.6 * (1 same, 0.9 same label, 0.2 other) + 0.4 * cosine of the mean vectors (track, seg, label, feat)."""
    s = segments.select("track", F.col("seg").alias("beat"), F.struct("label", "feat").alias("feat"))
    x = pairs(s, s)
    base = F.when(F.col("i") == F.col("j"), 1.0).when(F.col("fi.label") == F.col("fj.label"), 0.9).otherwise(0.2)
    return x.select("track", "i", "j", (0.6 * base + 0.4 * F.greatest(F.lit(0.0), V.cosine("fi.feat", "fj.feat"))).alias("v"))


def importance(segments: DataFrame, weights: DataFrame, default: float = 0.5) -> DataFrame:
    """segments with importance, looked up by label (label, weight)."""
    return segments.join(weights, "label", "left").withColumn("importance", F.coalesce("weight", F.lit(default))).drop("weight")


def repeated_sections(segments: DataFrame, not_these: tuple = ("intro", "outro", "unknown")) -> DataFrame:
    """(track, a, b, label): pairs a < b of segments with one lower-cased label that is not among `not_these`."""
    s = segments.withColumn("low", F.lower("label")).where(~F.col("low").isin(*not_these))
    a, b = s.select("track", "low", F.col("seg").alias("a")), s.select("track", "low", F.col("seg").alias("b"))
    return a.join(b, ["track", "low"]).where("a < b").select("track", "a", "b", F.col("low").alias("label"))


JUMP = ["track", "from_beat", "to_beat", "waveform", "corr", "lag", "a", "b", "from_bar", "to_bar"]


def repetition_jumps(corr: DataFrame, bars: DataFrame, snippets: DataFrame | None = None, least: float = 0.80, apart: int = 8, least_wave: float = 0.40, max_lag: int = 1) -> DataFrame:
    """(track, from_beat, to_beat, waveform, corr, lag, a, b, from_bar, to_bar): where two segments correlate (track, a, b, offset, corr), from the last
    beat of each bar (track, seg, bar, start, end) of one to the start of the bar that it meets in the other, at least `apart` beats off,
    and back from the last beat of that to the start of the first.

    With snippets (track, beat, w) the one after the beat left has to be like that of the beat landed on: a jump that fails takes its way
    back along, a way back that fails only goes itself."""
    c = F.col
    size = bars.groupBy("track", "seg").agg(F.count("*").alias("n"))
    m = corr.where(c("corr") >= least).join(size.select("track", c("seg").alias("a"), c("n").alias("na")), ["track", "a"]).join(size.select("track", c("seg").alias("b"), c("n").alias("nb")), ["track", "b"])
    of = lambda s, bar: bars.select("track", c("seg").alias(s), c("bar").alias(bar), c("start").alias(f"start_{s}"), (c("end") - 1).alias(f"last_{s}"))
    m = m.join(of("a", "bar_a"), ["track", "a"]).where(c("bar_a") < F.least("na", "nb")).withColumn("bar_b", c("bar_a") + c("offset")).join(of("b", "bar_b"), ["track", "b", "bar_b"])
    m = m.where(F.abs(c("start_b") - c("last_a")) >= apart)

    def checked(d: DataFrame, left: str, landed: str, out: str) -> DataFrame:
        if snippets is None:
            return d.withColumns({f"{out}_wave": F.lit(0.0), f"{out}_lag": F.lit(0).cast("long")})
        got = snippet_similarity(d.withColumn("__s", c(left) + 1), snippets, max_lag, "__s", landed).drop("__s")
        return got.withColumnsRenamed({"waveform": f"{out}_wave", "lag": f"{out}_lag"})

    m = checked(m, "last_a", "start_b", "go")
    if snippets is not None:
        m = m.where(c("go_wave") >= least_wave)
    m = checked(m, "last_b", "start_a", "back")
    there = m.select("track", c("last_a").alias("from_beat"), c("start_b").alias("to_beat"), c("go_wave").alias("waveform"), "corr", c("go_lag").alias("lag"), "a", "b", c("bar_a").alias("from_bar"), c("bar_b").alias("to_bar"))
    back = m.where(F.abs(c("start_a") - c("last_b")) >= apart)
    if snippets is not None:
        back = back.where(c("back_wave") >= least_wave)
    back = back.select("track", c("last_b").alias("from_beat"), c("start_a").alias("to_beat"), c("back_wave").alias("waveform"), "corr", c("back_lag").alias("lag"), c("b").alias("a"), c("a").alias("b"), c("bar_b").alias("from_bar"), c("bar_a").alias("to_bar"))
    return there.unionByName(back)


def section_jumps(bars: DataFrame, snippets: DataFrame, least: float = 0.80, apart: int = 8, least_wave: float = 0.40, max_lag: int = 1, reach: int = 4) -> DataFrame:
    """repetition_jumps between segments of bars (track, seg, bar, start, end, feat: a bar once) that correlate as bar_sequence_correlation has it, in
    one pass: bars bring the snippets (track, beat, w, of one length) after their last beat and at their first, and a strip of the track
    finds what correlates, and checks it, where the bars meet. No pair of bars becomes a row that does not jump."""
    c = F.col
    size = snippets.agg(F.max(F.size("w")).alias("__w"))
    of = lambda beat, name: snippets.select("track", c("beat").alias(beat), c("w").cast("array<double>").alias(name))
    x = bars.withColumn("last", c("end") - 1).withColumn("__s", c("end")).join(of("__s", "wa"), ["track", "__s"], "left").join(of("start", "wb"), ["track", "start"], "left").crossJoin(F.broadcast(size))
    wave = lambda w: F.coalesce(c(w), F.array_repeat(F.lit(float("nan")), F.coalesce("__w", F.lit(0))))
    head = F.array(*(v.cast("double") for v in (F.size("feat"), c("bar"), c("start"), c("last"))))
    rows = x.select("track", c("seg").alias("beat"), F.concat(head, c("feat").cast("array<double>"), wave("wa"), wave("wb")).alias("feat"))

    def kernel(i: np.ndarray, x: np.ndarray) -> Callable:
        parts = lambda k, x: (k, *x[:, 1:4].astype(np.int64).T, x[:, 4 : 4 + int(x[0, 0])], *np.split(x[:, 4 + int(x[0, 0]) :], 2, axis=1))
        seg, bar, start, last, feat, after, first = parts(i, x)

        def feed(j: np.ndarray | None, y: np.ndarray | None) -> Iterator[dict]:
            if j is None or j[-1] <= i[0]:
                return
            segs, bars, starts, lasts, feats, afters, firsts = parts(j, y)
            a, b, offset, corr = met_bars(seg, bar, feat, segs, bars, feats, reach)
            k = np.flatnonzero(corr >= least)
            a, b, offset, corr = a[k], b[k], offset[k], corr[k]
            # the bars of a, each with the one of b that it meets
            lo, up = np.searchsorted(seg, a), np.searchsorted(seg, a, "right")
            many = up - lo
            pair = np.repeat(np.arange(len(a)), many)
            p = np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
            fewest = np.minimum(many, np.searchsorted(segs, b, "right") - np.searchsorted(segs, b))
            by = np.lexsort((bars, segs))
            low, span = bars.min(), int(bars.max() - bars.min()) + 1
            want = bar[p] + offset[pair] - low
            wanted = np.searchsorted(segs, b)[pair] * span + np.where((want >= 0) & (want < span), want, -1)
            have = np.searchsorted(segs, segs)[by] * span + bars[by] - low
            q = np.minimum(np.searchsorted(have, wanted), len(by) - 1)
            ok = (want >= 0) & (want < span) & (have[q] == wanted) & (bar[p] < fewest[pair])
            pair, p, q = pair[ok], p[ok], by[q[ok]]
            ok = np.abs(starts[q] - last[p]) >= apart
            for at in np.array_split(np.flatnonzero(ok), max(1, int(ok.sum()) >> 16)):
                m, s, t = pair[at], p[at], q[at]
                wave, lag = best_lags(after[s], firsts[t], max_lag)
                k = wave >= least_wave
                m, s, t, wave, lag = m[k], s[k], t[k], wave[k], lag[k]
                yield {"from_beat": last[s], "to_beat": starts[t], "waveform": wave, "corr": corr[m], "lag": lag, "a": a[m], "b": b[m], "from_bar": bar[s], "to_bar": bars[t]}
                k = np.abs(start[s] - lasts[t]) >= apart
                m, s, t = m[k], s[k], t[k]
                wave, lag = best_lags(afters[t], first[s], max_lag)
                k = wave >= least_wave
                m, s, t, wave, lag = m[k], s[k], t[k], wave[k], lag[k]
                yield {"from_beat": lasts[t], "to_beat": start[s], "waveform": wave, "corr": corr[m], "lag": lag, "a": b[m], "b": a[m], "from_bar": bars[t], "to_bar": bar[s]}

        return feed

    return strips(rows, rows, kernel, "from_beat long, to_beat long, waveform double, corr double, lag long, a long, b long, from_bar long, to_bar long", size=256)


def within_section_jumps(rec: DataFrame, segments: DataFrame, meter: int, n: DataFrame | None = None, snippets: DataFrame | None = None, mean_least: float = 0.08, first: int = 5, jump_least: float = 0.10, least_wave: float = 0.40, max_lag: int = 1, not_these: tuple = ("intro", "outro")) -> DataFrame:
    """(track, seg, lag, mean, from_beat, to_beat, waveform): in segments (track, seg, start, end in beats[, label]) of at least eight bars, of the lags of
    whole bars, from two on, that leave two bars, the first few, in lag order, whose mean recurrence (missing edges count 0) reaches
    mean_least; of these the ones that reach jump_least, from the middle of the segment less the lag.

    With snippets (track, beat, w) of tracks (track, n) the snippet two after the beat left (by the rule's own count) has to be like that of the beat
    landed on, by three quarters of least_wave; beats beyond the last have none."""
    c, phrase = F.col, 2 * meter
    s = segments.where(c("end") - c("start") >= 4 * phrase)
    if "label" in segments.columns:
        s = s.where(~F.lower("label").isin(*not_these))
    x = rec.where((c("j") - c("i") >= phrase) & ((c("j") - c("i")) % meter == 0)).join(s.select("track", "seg", "start", "end", F.explode(F.sequence(c("start"), c("end") - 1)).alias("i")), ["track", "i"])
    m = x.where(c("j") < c("end")).groupBy("track", "seg", "start", "end", (c("j") - c("i")).alias("lag")).agg(F.sum("v").alias("v"))
    cells = c("end") - c("start") - c("lag")
    m = m.where(cells >= phrase).where(c("lag") < F.floor((c("end") - c("start")) / meter) * meter).withColumn("mean", c("v") / cells).where(c("mean") >= mean_least)
    m = m.withColumn("r", F.row_number().over(Window.partitionBy("track", "seg").orderBy("lag"))).where((c("r") <= first) & (c("mean") >= jump_least))
    m = m.withColumn("from_beat", c("start") + F.floor((c("end") - c("start") - c("lag")) / 2)).withColumn("to_beat", c("from_beat") + c("lag"))
    if snippets is None:
        m = m.withColumn("waveform", F.lit(0.0))
    else:
        m = m.join(n, "track").withColumnRenamed("lag", "__lag").withColumn("__s", F.least(c("from_beat") + 1, c("n") - 1) + 1)
        m = snippet_similarity(m, snippets, max_lag, "__s", "to_beat").where((c("from_beat") + 1 >= c("n")) | (c("waveform") >= 0.75 * least_wave)).drop("lag").withColumnRenamed("__lag", "lag")
    return m.select("track", "seg", "lag", "mean", "from_beat", "to_beat", "waveform")


def ranked(jumps: DataFrame, *by: str) -> DataFrame:
    return jumps.withColumn("rank", F.row_number().over(Window.partitionBy("track").orderBy(*(F.desc(b) for b in by), "from_beat", "to_beat")))
