"""Extraction and cleaning of events (beats) in irregular series (track, i, t): peaks, snapping, gaps, tempo, meter.

Order-dependent rules that only look at neighbours are windows; rules that carry a state from event to event are folds over the
sorted array of one track's events.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(*order: str):
    return Window.partitionBy("track").orderBy(*(order or ("t",)))


def _median_upper(df: DataFrame, value: str, out: str) -> DataFrame:
    """(track, out): the value of rank n // 2 of each track's sorted values (not interpolated)."""
    w = Window.partitionBy("track")
    r = df.where(F.col(value).isNotNull()).withColumn("r", F.row_number().over(w.orderBy(value)) - 1).withColumn("n", F.count("*").over(w))
    return r.where(F.col("r") == F.floor(F.col("n") / 2)).select("track", F.col(value).alias(out))


def intervals(events: DataFrame) -> DataFrame:
    """events with gap: time to the next event of the track."""
    return events.withColumn("gap", F.lead("t").over(_w()) - F.col("t"))


def local_peaks(series: DataFrame, k: int = 7, above: float = 0.0) -> DataFrame:
    """Rows (track, i, x) that equal the largest of the k around them and exceed `above`."""
    near = Window.partitionBy("track").orderBy("i").rowsBetween(-(k // 2), k // 2)
    return series.withColumn("m", F.max("x").over(near)).where((F.col("x") == F.col("m")) & (F.col("x") > above)).drop("m")


def dedup_peaks(peaks: DataFrame, width: int = 1) -> DataFrame:
    """(track, i): runs of peaks whose next place is within `width` of the run's mean so far become their rounded mean."""
    arr = peaks.groupBy("track").agg(F.array_sort(F.collect_list(F.col("i").cast("double"))).alias("p"))
    state = F.struct(F.lit(None).cast("double").alias("mean"), F.lit(0.0).alias("n"), F.expr("cast(array() as array<double>)").alias("out"))

    def step(a: Column, x: Column) -> Column:
        joins = a["mean"].isNotNull() & (x - a["mean"] <= width)
        n = F.when(joins, a["n"] + 1).otherwise(1.0)
        mean = F.when(joins, a["mean"] + (x - a["mean"]) / n).otherwise(x)
        out = F.when(a["mean"].isNotNull() & ~joins, F.concat(a["out"], F.array(a["mean"]))).otherwise(a["out"])
        return F.struct(mean.alias("mean"), n.alias("n"), out.alias("out"))

    folded = arr.select("track", F.aggregate("p", state, step, lambda a: F.concat(a["out"], F.array(a["mean"]))).alias("p"))
    return folded.select("track", F.explode("p").alias("p")).select("track", F.round("p").cast("long").alias("i"))


def snap_nearest(left: DataFrame, grid: DataFrame) -> DataFrame:
    """left (track, t, ...) with j and grid_t of the nearest grid row (track, j, t); ties go to the lower j; null without a grid.
    An as-of join in both directions by one union and two running windows; no range join."""
    mine = left.select("*", F.lit(None).cast("struct<t:double,j:bigint>").alias("g"))
    theirs = grid.select("track", "t", F.struct(F.col("t"), F.col("j").cast("long").alias("j")).alias("g"))
    u = mine.unionByName(theirs, allowMissingColumns=True).withColumn("__grid", F.col("g").isNotNull())
    w = Window.partitionBy("track")
    # at equal times the grid row comes first, and the lowest j last, so that last() finds it
    before = F.last("g", ignorenulls=True).over(w.orderBy("t", F.desc("__grid"), F.desc("g.j")).rowsBetween(Window.unboundedPreceding, 0))
    # the next grid row as well is a last() over a growing frame, in descending order: Spark evaluates a shrinking frame anew for every row
    after = F.last("g", ignorenulls=True).over(w.orderBy(F.desc("t"), F.desc("__grid"), F.desc("g.j")).rowsBetween(Window.unboundedPreceding, 0))
    u = u.withColumns({"b": before, "a": after}).where(~F.col("__grid"))
    db, da = F.abs(F.col("t") - F.col("b.t")), F.abs(F.col("a.t") - F.col("t"))
    pick = F.when(F.col("b").isNull(), F.col("a")).when(F.col("a").isNull(), F.col("b")).when(db < da, F.col("b")).when(da < db, F.col("a")).when(F.col("b.j") <= F.col("a.j"), F.col("b")).otherwise(F.col("a"))
    return u.withColumn("p", pick).select(*left.columns, F.col("p.j").alias("j"), F.col("p.t").alias("grid_t"))


def snapped_events(left: DataFrame, grid: DataFrame) -> DataFrame:
    """(track, j, t): the distinct grid rows nearest to the events."""
    return snap_nearest(left, grid).where(F.col("j").isNotNull()).select("track", "j", F.col("grid_t").alias("t")).distinct()


def fill_gaps(events: DataFrame, hints: DataFrame, ratio: float = 1.35, reach: float = 0.2) -> DataFrame:
    """(track, t, added): events, and in gaps over ratio * median new ones: the first hint (track, t) near each of the gap's even
    slots if every slot has one, else the slots themselves."""
    e = intervals(events.select("track", "t"))
    e = e.join(_median_upper(e, "gap", "med"), "track")
    g = e.where(F.col("gap") > F.lit(ratio) * F.col("med")).withColumn("n", F.round(F.col("gap") / F.col("med")).cast("long"))
    slots = g.where("n > 1").select("track", F.col("t").alias("t0"), "gap", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") - 1)).alias("k"))
    slots = slots.withColumn("slot", F.col("t0") + F.col("gap") * F.col("k") / F.col("n"))
    # hints carry the gap they lie in, by a running last event, so the join is on equality
    h = hints.select("track", "t", F.lit(None).cast("double").alias("e")).union(events.select("track", "t", F.col("t").alias("e")))
    h = h.withColumn("t0", F.last("e", ignorenulls=True).over(_w("t", F.col("e").isNull()).rowsBetween(Window.unboundedPreceding, 0))).where("e is null and t0 is not null")
    near = slots.join(h.select("track", "t0", F.col("t").alias("hint")), ["track", "t0"]).where(F.abs(F.col("hint") - F.col("slot")) <= F.lit(reach) * F.col("gap") / F.col("n"))
    near = near.groupBy("track", "t0", "k").agg(F.min("hint").alias("hint"))
    covered = near.groupBy("track", "t0").agg(F.count("*").alias("m"))
    new = slots.join(near, ["track", "t0", "k"], "left").join(covered, ["track", "t0"], "left")
    new = new.select("track", F.when(F.col("m") == F.col("n") - 1, F.col("hint")).otherwise(F.col("slot")).alias("t"))
    return events.select("track", "t", F.lit(False).alias("added")).union(new.select("track", "t", F.lit(True).alias("added")))


def drop_inconsistent(events: DataFrame, tolerance: float = 0.25, least: int = 5) -> DataFrame:
    """events without interior ones whose gaps on both sides deviate from the track's median by more than the tolerance."""
    e = events.withColumns({"before": F.col("t") - F.lag("t").over(_w()), "after": F.lead("t").over(_w()) - F.col("t"), "n": F.count("*").over(Window.partitionBy("track"))})
    med = _median_upper(e, "after", "med")
    e = e.join(med, "track", "left")
    off = lambda c: F.abs(F.col(c) - F.col("med")) > F.lit(tolerance) * F.col("med")
    return e.where(~F.coalesce((F.col("n") >= least) & off("before") & off("after"), F.lit(False))).select(events.columns)


def refine_to_onset(events: DataFrame, onsets: DataFrame, reach: float) -> DataFrame:
    """events with refined: the nearest onset (track, t) within reach, the earlier of two as near; else the event's own time."""
    grid = onsets.withColumn("j", F.row_number().over(_w()).cast("long"))
    near = snap_nearest(events, grid.select("track", "j", "t"))
    close = F.abs(F.col("grid_t") - F.col("t")) <= reach
    return near.withColumn("refined", F.when(close, F.col("grid_t")).otherwise(F.col("t"))).drop("j", "grid_t")


def estimate_tempo(events: DataFrame, lo: float = 78.0, hi: float = 185.0, fallback: float = 120.0) -> DataFrame:
    """(track, tempo): inner intervals in (0.2, 2) near their median give a period; the circular mean of the phases gives an origin;
    time is regressed on the rounded index, and the slope is taken if R2 > 0.99; octaves are folded into [lo, hi]."""
    w = Window.partitionBy("track")
    e = events.select("track", "t").withColumns({"r": F.row_number().over(_w()) - 1, "n": F.count("*").over(w)})
    trim = F.floor(F.col("n") * 0.15)
    e = e.where((F.col("r") >= trim) & (F.col("r") < F.col("n") - trim))
    g = intervals(e).where("gap > 0.2 and gap < 2")
    med = _median_upper(g, "gap", "med")
    period = g.join(med, "track").where(F.abs(F.col("gap") - F.col("med")) <= 0.15 * F.col("med")).groupBy("track").agg(F.avg("gap").alias("period"))
    e = e.join(period, "track")
    turn = 2 * math.pi * F.col("t") / F.col("period")
    phase = e.groupBy("track").agg(F.atan2(F.sum(F.sin(turn)), F.sum(F.cos(turn))).alias("angle"))
    e = e.join(phase, "track").withColumn("k", F.round((F.col("t") - F.col("angle") / (2 * math.pi) * F.col("period")) / F.col("period")))
    fit = e.groupBy("track", "period").agg(F.regr_slope("t", "k").alias("slope"), F.regr_r2("t", "k").alias("r2"))
    used = F.when((F.col("r2") > 0.99) & (F.col("slope") > 0), F.col("slope")).otherwise(F.col("period"))
    bpm = 60 / used
    folded = F.when(bpm < lo, bpm * F.pow(F.lit(2.0), F.ceil(F.log2(F.lit(lo) / bpm)))).when(bpm > hi, bpm / F.pow(F.lit(2.0), F.ceil(F.log2(bpm / F.lit(hi))))).otherwise(bpm)
    tempo = fit.select("track", folded.alias("tempo"))
    return events.select("track").distinct().join(tempo, "track", "left").select("track", F.coalesce("tempo", F.lit(fallback)).alias("tempo"))


def detect_meter(beats: DataFrame, downbeats: DataFrame, tolerance: float = 0.03, default: int = 4) -> DataFrame:
    """(track, meter): the most frequent number, from 2 to 7, of beats from one downbeat to the next; the lowest of equals."""
    bars = downbeats.select("track", "t").withColumn("next", F.lead("t").over(_w())).where("next is not null")
    b = bars.withColumns({"a": F.col("t") - tolerance, "z": F.col("next") - tolerance})
    u = b.select("track", F.col("a").alias("t"), F.col("t").alias("bar"), "z").unionByName(beats.select("track", "t"), allowMissingColumns=True)
    w = _w("t", F.col("bar").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumns({"in": F.last("bar", ignorenulls=True).over(w), "until": F.last("z", ignorenulls=True).over(w)})
    n = u.where("bar is null and `in` is not null and t < until").groupBy("track", "in").agg(F.count("*").alias("k")).where("k between 2 and 7")
    top = n.groupBy("track", "k").agg(F.count("*").alias("m")).groupBy("track").agg(F.max_by("k", F.struct("m", -F.col("k"))).alias("k"))
    return beats.select("track").distinct().join(top, "track", "left").select("track", F.coalesce("k", F.lit(default)).cast("long").alias("meter"))


def clean_downbeats(downbeats: DataFrame, bar: DataFrame, low: float = 0.6, high: float = 1.35) -> DataFrame:
    """(track, t): against the last one kept, downbeats nearer than low * reference go, and gaps over high * reference get
    round(ratio) - 1 even ones. Reference: the expected bar (track, bar) if the median is within 15 % of it, else the median."""
    g = intervals(downbeats.select("track", "t"))
    ref = _median_upper(g, "gap", "med").join(bar, "track", "left")
    ref = ref.select("track", F.when(F.abs(F.col("med") - F.col("bar")) <= 0.15 * F.col("bar"), F.col("bar")).otherwise(F.col("med")).alias("ref"))
    arr = downbeats.groupBy("track").agg(F.array_sort(F.collect_list("t")).alias("p")).join(ref, "track", "left")
    start = F.struct(F.get("p", F.lit(0)).alias("last"), F.slice("p", 1, 1).alias("out"))

    def step(a: Column, x: Column) -> Column:
        ratio = (x - a["last"]) / F.col("ref")
        n = F.round(ratio)
        even = F.when((ratio > high) & (n > 1), F.transform(F.sequence(F.lit(1), n.cast("int") - 1), lambda k: a["last"] + (x - a["last"]) * k / n)).otherwise(F.expr("cast(array() as array<double>)"))
        return F.when(ratio < low, a).otherwise(F.struct(x.alias("last"), F.concat(a["out"], even, F.array(x)).alias("out")))

    whole = F.when(F.col("ref").isNull(), F.col("p")).otherwise(F.aggregate(F.slice("p", 2, F.greatest(F.size("p"), F.lit(1))), start, step, lambda a: a["out"]))
    return arr.select("track", F.explode(whole).alias("t"))


def every_nth(events: DataFrame, n: int) -> DataFrame:
    return events.withColumn("r", F.row_number().over(_w()) - 1).where(F.col("r") % n == 0).drop("r")


def regularity(events: DataFrame, tempo: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """(track, regularity): share of intervals within the tolerance of 60 / tempo; 0.5 for fewer than 4 events."""
    g = intervals(events).join(tempo, "track")
    near = F.avg(F.when(F.col("gap").isNotNull(), (F.abs(F.col("gap") - 60 / F.col("tempo")) <= F.lit(tolerance) * 60 / F.col("tempo")).cast("double")))
    return g.groupBy("track").agg(F.when(F.count("*") < 4, 0.5).otherwise(near).alias("regularity"))


def mark_within(events: DataFrame, marks: DataFrame, share: float = 0.25) -> DataFrame:
    """events with marked: whether a mark (track, t) lies within `share` of the track's mean interval."""
    mean = intervals(events).groupBy("track").agg(F.avg("gap").alias("mean"))
    grid = marks.withColumn("j", F.row_number().over(_w()).cast("long")).select("track", "j", "t")
    near = snap_nearest(events, grid).join(mean, "track", "left")
    return near.withColumn("marked", F.coalesce(F.abs(F.col("grid_t") - F.col("t")) <= F.lit(share) * F.col("mean"), F.lit(False))).drop("j", "grid_t", "mean")


def detect_beats(logits: DataFrame, frame_rate: float, onsets: DataFrame, downbeats: DataFrame) -> DataFrame:
    """(track, t, is_downbeat, tempo, meter, confidence), in this order: peaks of (track, i, x) with plateaus merged; downbeats (track, t) to their
    nearest peaks; gaps filled, inconsistent beats dropped; beats and downbeats moved to onsets; tempo; for tracks of two downbeats or more
    the meter and downbeats cleaned against its bar, for others four and every fourth beat; the share of regular intervals. A beat is a
    downbeat if one lies within a quarter of the mean interval."""
    seconds = (F.col("i") / F.lit(frame_rate)).alias("t")
    peaks = dedup_peaks(local_peaks(logits)).select("track", seconds)
    weak = local_peaks(logits.where("x < 0"), above=-2.0).select("track", seconds)
    grid = peaks.withColumn("j", F.row_number().over(_w()).cast("long") - 1)
    moved = lambda d: refine_to_onset(d, onsets, 0.03).select("track", F.col("refined").alias("t")).distinct()
    down = moved(snapped_events(downbeats.select("track", "t"), grid.select("track", "j", "t")).select("track", "t"))
    beats = moved(drop_inconsistent(fill_gaps(peaks, weak).select("track", "t")))
    enough = down.groupBy("track").agg(F.count("*").alias("n")).where("n >= 2").select("track")
    down = down.join(enough, "track", "left_semi")
    tempo, meter = estimate_tempo(beats), detect_meter(beats, down)
    bar = tempo.join(meter, "track").select("track", (60 / F.col("tempo") * F.col("meter")).alias("bar"))
    none = beats.join(enough, "track", "left_anti")
    marks = clean_downbeats(down, bar).select("track", "t").unionByName(every_nth(none, 4).select("track", "t"))
    meter = meter.join(enough.withColumn("own", F.lit(True)), "track", "left").select("track", F.when(F.col("own"), F.col("meter")).otherwise(F.lit(4).cast("long")).alias("meter"))
    whole = tempo.select("track", "tempo").join(meter, "track").join(regularity(beats, tempo.select("track", "tempo")).withColumnRenamed("regularity", "confidence"), "track", "left")
    return mark_within(beats, marks).withColumnRenamed("marked", "is_downbeat").select("track", "t", "is_downbeat").join(whole, "track", "left")
