"""Aggregation of frames to beats, normalisation per track, and edges of intervals.

Vectors are (track, frame, feat array<double>); intervals are (track, beat, start, end) in frames, half open.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V


def _w(*order: str):
    return Window.partitionBy("track").orderBy(*order)


def time_to_frame(t: Column, sr: float, hop: int) -> Column:
    """Frame of a time, by two truncations: to a sample, then to a frame."""
    return (((t * F.lit(sr)).cast("long") / F.lit(hop)).cast("long"))


def bounds_to_intervals(bounds: DataFrame, n: DataFrame) -> DataFrame:
    """(track, beat, start, end) from bounds (track, frame), with 0 and n added, clamped, distinct, negatives dropped."""
    b = bounds.where("frame >= 0").join(n, "track").select("track", F.least("frame", "n").alias("start"))
    b = b.union(n.select("track", F.lit(0).cast("long"))).union(n.select("track", "n")).distinct()
    b = b.withColumns({"end": F.lead("start").over(_w("start")), "beat": F.row_number().over(_w("start")).cast("long") - 1})
    return b.where(F.col("end").isNotNull()).select("track", "beat", "start", "end")


def assign_interval(frames: DataFrame, intervals: DataFrame) -> DataFrame:
    """frames with the beat, start and end of the interval that holds them: a running last start, no range join."""
    marks = intervals.select("track", F.col("start").alias("frame"), F.struct("beat", "start", "end").alias("iv"))
    u = frames.withColumn("__row", F.lit(True)).unionByName(marks.withColumn("__row", F.lit(False)), allowMissingColumns=True)
    u = u.withColumn("iv", F.last("iv", ignorenulls=True).over(_w("frame", "__row").rowsBetween(Window.unboundedPreceding, 0)))
    u = u.where(F.col("__row") & (F.col("frame") < F.col("iv.end")))
    return u.select(*frames.columns, "iv.beat", "iv.start", "iv.end")


def vector_mean(df: DataFrame, keys: list[str], vector: str = "feat", out: str = "feat") -> DataFrame:
    """Mean of the vectors of each group, per dimension."""
    long = df.select(*keys, F.posexplode(vector).alias("__d", "__v")).groupBy(*keys, "__d").agg(F.avg("__v").alias("__v"))
    pairs = F.array_sort(F.collect_list(F.struct("__d", "__v")))
    return long.groupBy(*keys).agg(F.transform(pairs, lambda p: p["__v"]).alias(out))


def sync_mean(frames: DataFrame, intervals: DataFrame) -> DataFrame:
    """(track, beat, feat): mean vector of the frames of each interval."""
    return vector_mean(assign_interval(frames, intervals), ["track", "beat"])


def conform_length(beats: DataFrame, n: DataFrame, value: str, pad: str = "repeat") -> DataFrame:
    """(track, beat, value) for beats 0..n-1 of (track, n): further ones dropped, missing ones repeat the last value or are 0."""
    spine = n.select("track", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("beat"))
    b = spine.join(beats.select("track", "beat", value), ["track", "beat"], "left")
    last = F.last(value, ignorenulls=True).over(_w("beat").rowsBetween(Window.unboundedPreceding, 0))
    return b.withColumn(value, last if pad == "repeat" else F.coalesce(value, F.lit(0.0)))


def max_normalized(df: DataFrame, value: str, eps: float = 1e-10) -> DataFrame:
    return df.withColumn(value, F.col(value) / F.greatest(F.max(value).over(Window.partitionBy("track")), F.lit(eps)))


def minmax_scaled(df: DataFrame, value: str, eps: float = 1e-9) -> DataFrame:
    w = Window.partitionBy("track")
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(value, (F.col(value) - lo) / F.greatest(F.lit(eps), hi - lo))


def zscored(df: DataFrame, vector: str = "feat", weight: float = 1.0, eps: float = 1e-8) -> DataFrame:
    """df with the vector's columns less their mean over their deviation (population) in the track, times the weight."""
    dims = df.select("track", F.posexplode(vector).alias("d", "v")).groupBy("track", "d").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    stats = dims.groupBy("track").agg(F.array_sort(F.collect_list(F.struct("d", "m", "s"))).alias("__z"))
    z = F.zip_with(vector, "__z", lambda x, s: (x - s["m"]) / (s["s"] + eps) * weight)
    return df.join(stats, "track").withColumn(vector, z).drop("__z")


def stacked(df: DataFrame, *vectors: str, out: str = "feat") -> DataFrame:
    return df.withColumn(out, F.concat(*vectors))


def edges(frames: DataFrame, intervals: DataFrame, n: int = 4, how: str = "mean") -> DataFrame:
    """(track, beat, edge_start, edge_end): over the first and last min(n, max(1, length / 2)) frames of each interval, the mean of
    the vectors at length 1 (how mean), or of scalars x their mean or largest (how scalar_mean, scalar_max)."""
    a = assign_interval(frames, intervals)
    m = F.least(F.lit(n), F.greatest(F.lit(1), F.floor((F.col("end") - F.col("start")) / 2)))
    a = a.withColumns({"first": F.col("frame") < F.col("start") + m, "last": F.col("frame") >= F.col("end") - m})
    if how == "mean":
        one = lambda flag, out: vector_mean(a.where(flag), ["track", "beat"], out=out).withColumn(out, V.l2_normalized(out))
        return one("first", "edge_start").join(one("last", "edge_end"), ["track", "beat"])
    f = F.avg if how == "scalar_mean" else F.max
    return a.groupBy("track", "beat").agg(f(F.when(F.col("first"), F.col("x"))).alias("edge_start"), f(F.when(F.col("last"), F.col("x"))).alias("edge_end"))


def edge_rms(samples: DataFrame, intervals: DataFrame, n: int) -> DataFrame:
    """(track, beat, rms_start, rms_end): RMS of the first and last n samples (track, frame, x) of each interval, over the largest
    of both in the track."""
    a = assign_interval(samples, intervals)
    part = lambda c: F.sqrt(F.avg(F.when(c, F.col("x") * F.col("x"))) + F.lit(1e-10))
    r = a.groupBy("track", "beat").agg(part(F.col("frame") < F.col("start") + n).alias("rms_start"), part(F.col("frame") >= F.col("end") - n).alias("rms_end"))
    top = F.greatest(F.max("rms_start").over(Window.partitionBy("track")), F.max("rms_end").over(Window.partitionBy("track")))
    return r.withColumn("top", top).select("track", "beat", (F.col("rms_start") / F.col("top")).alias("rms_start"), (F.col("rms_end") / F.col("top")).alias("rms_end"))


def event_snippets(samples: DataFrame, marks: DataFrame, before: int, after: int) -> DataFrame:
    """(track, mark, w): samples (track, i, x) from before to after each mark (track, mark, i), zero padded, less their mean, Hann
    weighted, at RMS 1. Every mark asks for its own places, so the join is on equality."""
    size = before + after
    ask = marks.select("track", "mark", F.col("i").alias("at"), F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("k"))
    ask = ask.withColumn("i", F.col("at") - before + F.col("k"))
    got = ask.join(samples.select("track", "i", "x"), ["track", "i"], "left").withColumn("x", F.coalesce("x", F.lit(0.0)))
    arr = got.groupBy("track", "mark").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda p: p["x"]).alias("w"))
    return arr.withColumn("w", _snippet("w"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _snippet(w: pd.Series) -> pd.Series:
    x = np.array(w.tolist(), dtype=float)
    x = (x - x.mean(-1, keepdims=True)) * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(x.shape[1]) / x.shape[1]))
    rms = np.sqrt((x**2).mean(-1, keepdims=True))
    return pd.Series(list(x / np.where(rms > 1e-12, rms, 1.0)))


def edge_db(rms: Column) -> Column:
    return 20 * F.log10(F.greatest(rms, F.lit(1e-6)))
