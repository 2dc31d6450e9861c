"""Framing, resampling and per-frame features of regular series.

A series is (track, i, x) with i from 0; a spectrum is (track, frame, bin, v) in long form. Windows are per track; frames, bins and
tracks spread over the cluster. Fixed bases (window, Fourier, mel, cosine) are small tables whose size depends on parameters only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _track():
    return Window.partitionBy("track")


def _series():
    return _track().orderBy("i")


def lengths(series: DataFrame) -> DataFrame:
    return series.groupBy("track").agg(F.count("*").alias("n"))


def downmix(samples: DataFrame) -> DataFrame:
    """(track, i, x): mean over the channels of (track, channel, i, x)."""
    return samples.groupBy("track", "i").agg(F.avg("x").alias("x"))


def resample_linear(series: DataFrame, ratio: float) -> DataFrame:
    """The series on a grid of ratio times as many points: ceil(n * ratio) points, linear in between, the last value held."""
    nxt = series.withColumns({"x1": F.coalesce(F.lead("x").over(_series()), F.col("x"))})
    grid = lengths(series).select("track", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") * F.lit(ratio)) - 1)).alias("j"))
    grid = grid.withColumn("at", F.col("j") / F.lit(float(ratio))).withColumn("i", F.floor("at"))
    return grid.join(nxt, ["track", "i"]).select("track", F.col("j").alias("i"), (F.col("x") + (F.col("x1") - F.col("x")) * (F.col("at") - F.col("i"))).alias("x"))


def frames(series: DataFrame, n_fft: int, hop: int) -> DataFrame:
    """(track, frame, k, x): centred frames with zero padding, 1 + n // hop of them; k is the place in the frame. Each sample goes to
    its n_fft / hop frames, so there is no join on ranges; padding is left out, as zeros add nothing."""
    half = n_fft // 2
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col("i") - half) / hop) + 1)
    last = F.least(F.floor((F.col("i") + half) / hop), F.floor(F.col("n") / hop))
    s = series.join(lengths(series), "track")
    s = s.where(last >= first).select("track", "i", "x", F.explode(F.sequence(first, last)).alias("frame"))
    return s.select("track", "frame", (F.col("i") - F.col("frame") * hop + half).alias("k"), "x")


def frame_rms(series: DataFrame, n_fft: int, hop: int) -> DataFrame:
    return frames(series, n_fft, hop).groupBy("track", "frame").agg(F.sqrt(F.sum(F.col("x") * F.col("x")) / F.lit(float(n_fft))).alias("rms"))


def envelope(series: DataFrame, hop: int, share: float = 0.98) -> DataFrame:
    """RMS per hop samples, over the value at place int(share * buckets) of the track's sorted values, at most 1."""
    e = series.groupBy("track", F.floor(F.col("i") / hop).alias("bucket")).agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))
    ranked = e.withColumn("r", F.row_number().over(_track().orderBy("rms")) - 1).withColumn("n", F.count("*").over(_track()))
    top = F.max(F.when(F.col("r") == F.floor(F.col("n") * F.lit(share)), F.col("rms"))).over(_track())
    return ranked.withColumn("top", top).select("track", "bucket", F.when(F.col("top") > 0, F.least(F.lit(1.0), F.col("rms") / F.col("top"))).otherwise(0.0).alias("level"))


def minmax_bins(series: DataFrame, bins: int) -> DataFrame:
    """Least and largest value of each of `bins` bins of a track; bin b holds i from b * n / bins up to the next."""
    s = series.join(lengths(series), "track")
    at = F.floor(((F.col("i") + 1) * bins - 1) / F.col("n"))
    return s.groupBy("track", at.alias("bin")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))


def roll_up_bins(peaks: DataFrame, factor: int) -> DataFrame:
    return peaks.groupBy("track", F.floor(F.col("bin") / factor).alias("bin")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def _dense(rows: pa.ListArray, n: int) -> np.ndarray:
    """(frames, n) of lists of (k, x); places that a frame does not have are 0."""
    out = np.zeros((len(rows), n))
    pairs = rows.flatten()
    out[np.repeat(np.arange(len(rows)), rows.value_lengths().to_numpy()), pairs.field("k").to_numpy()] = pairs.field("x").to_numpy(zero_copy_only=False)
    return out


def spectrum(framed: DataFrame, n_fft: int) -> DataFrame:
    """(track, frame, re array, im array) of windowed frames: FFTs in batches of frames, over Arrow buffers."""
    arrays = framed.groupBy("track", "frame").agg(F.collect_list(F.struct(F.col("k").cast("long").alias("k"), F.col("x").cast("double").alias("x"))).alias("s"))  # n_fft values at most

    def lists(v: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(v).ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z = np.fft.rfft(_dense(batch.column("s"), n_fft) * hann(n_fft), axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("track"), batch.column("frame"), lists(z.real), lists(z.imag)], ["track", "frame", "re", "im"])

    kinds = dict(arrays.dtypes)
    return arrays.mapInArrow(run, f"track {kinds['track']}, frame {kinds['frame']}, re array<double>, im array<double>")


def inverse_overlap_add(spec: DataFrame, n_fft: int, hop: int) -> DataFrame:
    """(track, i, x): windowed inverse FFTs added up, over the sum of squared windows where that is not tiny."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = hann(n_fft)
        for pdf in batches:
            z = np.array(pdf["re"].tolist()) + 1j * np.array(pdf["im"].tolist())
            y = np.fft.irfft(z, n_fft, axis=1) * w if len(pdf) else np.zeros((0, n_fft))
            yield pd.DataFrame({"track": pdf["track"], "frame": pdf["frame"], "y": list(y)})

    y = spec.mapInPandas(run, "track long, frame long, y array<double>")
    w = F.broadcast(spec.sparkSession.createDataFrame([(k, float(v * v)) for k, v in enumerate(hann(n_fft))], "k long, w2 double"))
    s = y.select("track", "frame", F.posexplode("y").alias("k", "y")).join(w, "k").withColumn("i", F.col("frame") * hop + F.col("k") - n_fft // 2)
    s = s.where("i >= 0").groupBy("track", "i").agg(F.sum("y").alias("y"), F.sum("w2").alias("w2"))
    return s.where(F.col("w2") > 2.0**-126).select("track", "i", (F.col("y") / F.col("w2")).alias("x"))


def mel_basis(n_fft: int, sr: float, n_mels: int, lo: float = 0.0, hi: float | None = None, norm: bool = True) -> list[tuple[int, int, float]]:
    """(bin, mel, weight) of triangles that are even on the Slaney mel scale (linear to 1000 Hz, 200/3 Hz a mel; then logarithmic)."""
    step = math.log(6.4) / 27
    to_mel = lambda f: f * 3 / 200 if f < 1000 else 15 + math.log(f / 1000) / step
    to_hz = lambda m: m * 200 / 3 if m < 15 else 1000 * math.exp(step * (m - 15))
    top = hi if hi is not None else sr / 2
    edge = [to_hz(to_mel(lo) + (to_mel(top) - to_mel(lo)) * k / (n_mels + 1)) for k in range(n_mels + 2)]
    out = []
    for m in range(n_mels):
        a, c, b = edge[m : m + 3]
        for k in range(n_fft // 2 + 1):
            f = k * sr / n_fft
            w = max(0.0, min((f - a) / (c - a), (b - f) / (b - c)))
            if w > 0:
                out.append((k, m, w * (2 / (b - a) if norm else 1.0)))
    return out


def _reflected(series: DataFrame, reach: int, mirror: bool) -> DataFrame:
    """The series with `reach` rows added at each end by symmetric reflection, numbered on."""
    n = lengths(series)
    s = series.select("track", "i", "x").join(n, "track")
    if not mirror:
        return s
    head = s.where(F.col("i") < reach).withColumn("i", -F.col("i") - 1)
    tail = s.where(F.col("i") >= F.col("n") - reach).withColumn("i", 2 * F.col("n") - 1 - F.col("i"))
    return s.union(head).union(tail)


def rolling_median(series: DataFrame, k: int) -> DataFrame:
    """(track, i, x): the value of rank k // 2 of the k around each, with symmetric reflection at the ends."""
    r = _reflected(series, k // 2, True)
    near = F.sort_array(F.collect_list("x").over(_series().rowsBetween(-(k // 2), k // 2)))
    return r.withColumn("m", F.get(near, F.lit(k // 2))).where((F.col("i") >= 0) & (F.col("i") < F.col("n"))).select("track", "i", F.col("m").alias("x"))


def uniform_filter(series: DataFrame, k: int) -> DataFrame:
    """(track, i, x): moving mean over k values, with symmetric reflection at the ends."""
    r = _reflected(series, k // 2, True)
    near = _series().rowsBetween(-(k // 2), k - 1 - k // 2)
    return r.withColumn("m", F.avg("x").over(near)).where((F.col("i") >= 0) & (F.col("i") < F.col("n"))).select("track", "i", F.col("m").alias("x"))


def hpss_harmonic(spec: DataFrame, k: int = 31) -> DataFrame:
    """spec with mask: share of the harmonic part, from the median along time against that along frequency; 0.5 where both vanish."""
    along = lambda key, order: Window.partitionBy("track", key).orderBy(order).rowsBetween(-(k // 2), k // 2)
    med = lambda w: F.element_at(F.sort_array(F.collect_list("v").over(w)), (F.size(F.collect_list("v").over(w)) / 2).cast("int") + 1)
    s = spec.withColumns({"h": med(along("bin", "frame")), "p": med(along("frame", "bin"))})
    h2, p2 = F.col("h") * F.col("h"), F.col("p") * F.col("p")
    return s.withColumn("mask", F.when(h2 + p2 < 1e-30, 0.5).otherwise(h2 / (h2 + p2))).drop("h", "p")


def percentile_scaled(series: DataFrame, q: float = 0.95) -> DataFrame:
    """(track, i, x): x over the track's q-quantile (linear between ranks), clipped to 0..1."""
    p = series.groupBy("track").agg(F.percentile("x", F.lit(q)).alias("p"))
    return series.join(p, "track").select("track", "i", F.when(F.col("p") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("x") / F.col("p")))).otherwise(0.0).alias("x"))


def gate_tracks(series: DataFrame, least_n: int, least_rms: float, beats: DataFrame | None = None) -> DataFrame:
    """(track, n, reason): why a track is rejected, or null: short, not finite, silent, or, with beats (track, t), of under two beats."""
    bad = F.max((F.col("x").isNull() | F.isnan("x") | (F.abs("x") == F.lit(float("inf")))).cast("int"))
    g = series.groupBy("track").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), bad.alias("bad"))
    reason = F.when(F.col("n") < least_n, "short").when(F.col("bad") == 1, "not finite").when(F.col("rms") < least_rms, "silent")
    if beats is not None:
        g = g.join(beats.groupBy("track").agg(F.count("*").alias("beats")), "track", "left")
        reason = reason.when(F.coalesce("beats", F.lit(0)) < 2, "under two beats")
    return g.select("track", "n", reason.alias("reason"))


def chunks_with_border(n: DataFrame, size: int, border: int) -> DataFrame:
    """(track, chunk, start): starts of overlapping chunks over n frames: size less two borders apart, the last aligned to the end."""
    step = size - 2 * border
    starts = F.sequence(F.lit(-border).cast("long"), F.greatest(F.lit(-border).cast("long"), F.col("n") - border - 1), F.lit(step).cast("long"))
    c = n.select("track", "n", F.posexplode(starts).alias("chunk", "start"))
    last = F.col("chunk") == F.max("chunk").over(_track())
    return c.select("track", F.col("chunk").cast("long"), F.when(last & (F.col("n") > step), F.col("n") - (size - border)).otherwise(F.col("start")).alias("start"))


def stitch(scored: DataFrame, n: DataFrame, size: int, border: int, missing: float = -1000.0) -> DataFrame:
    """(track, frame, score) of every frame from (track, chunk, start, k, score): inner frames of the earliest chunk; else missing."""
    inner = scored.where((F.col("k") >= border) & (F.col("k") < size - border)).withColumn("frame", F.col("start") + F.col("k"))
    inner = inner.groupBy("track", "frame").agg(F.min_by("score", "chunk").alias("score"))
    spine = n.select("track", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("frame"))
    return spine.join(inner, ["track", "frame"], "left").withColumn("score", F.coalesce("score", F.lit(missing)))


def vocal_activity(frame_features: DataFrame, weights: tuple[float, float, float] = (0.40, 0.33, 0.27)) -> DataFrame:
    """(track, frame, activity, entry, exit) from harmonic, band and flatness columns: each over the track's 95 % quantile and
    clipped, flatness inverted; entry and exit are the rises and falls, scaled likewise."""
    scaled = lambda d, c: d.withColumn(c, _over_quantile(c))
    d = frame_features.withColumn("inverse", 1 - F.col("flatness"))
    for c in ("harmonic", "band", "inverse"):
        d = scaled(d, c)
    a, b, c = weights
    d = d.withColumn("activity", a * F.col("harmonic") + b * F.col("band") + c * F.col("inverse"))
    step = F.col("activity") - F.lag("activity").over(_track().orderBy("frame"))
    d = d.withColumns({"entry": F.coalesce(F.greatest(step, F.lit(0.0)), F.lit(0.0)), "exit": F.coalesce(F.greatest(-step, F.lit(0.0)), F.lit(0.0))})
    return scaled(scaled(d, "entry"), "exit").select("track", "frame", "activity", "entry", "exit")


def _over_quantile(c: str, q: float = 0.95) -> Column:
    p = F.percentile(c, F.lit(q)).over(_track())
    return F.when(p > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c) / p))).otherwise(0.0)


def chroma_basis(n_fft: int, sr: float, tuning: float = 0.0, centre_octave: float = 5.0, octave_width: float = 2.0) -> list[tuple[int, int, float]]:
    """(bin, pitch class, weight): bumps one bin wide around each pitch class, C first, of length 1 per bin, weighted towards the
    centre octave."""
    place = lambda k: 12 * math.log2(k * sr / n_fft / (440.0 * 2 ** (tuning / 12) / 16))  # noqa: E731  semitones above the A five octaves down
    q = [place(1) - 18, *(place(k) for k in range(1, n_fft // 2 + 1))]
    width = [*(max(1.0, b - a) for a, b in zip(q, q[1:])), 1.0]
    out = []
    for k, (x, w) in enumerate(zip(q, width)):
        bump = [math.exp(-0.5 * (2 * ((x - c + 6) % 12 - 6) / w) ** 2) for c in range(12)]
        size = math.sqrt(sum(b * b for b in bump)) or 1.0
        octave = math.exp(-0.5 * ((x / 12 - centre_octave) / octave_width) ** 2)
        out += [(k, (c - 3) % 12, b / size * octave) for c, b in enumerate(bump)]
    return out


def estimate_tuning(spec: DataFrame, n_fft: int, sr: float, lo: float = 150.0, hi: float = 4000.0, share: float = 0.1) -> DataFrame:
    """(track, tuning) in semitones from -0.5: the fullest hundredth of the offsets from equal temperament of spectral peaks, placed by a
    parabola, in [lo, hi), over `share` of their frame's largest and not under the track's median peak; the lowest of equals."""
    w = Window.partitionBy("track", "frame")
    s = spec.withColumns({"a": F.lag("v").over(w.orderBy("bin")), "b": F.lead("v").over(w.orderBy("bin")), "top": F.max("v").over(w)})
    s = s.where((F.col("v") > F.col("a")) & (F.col("v") >= F.col("b")) & (F.col("v") > share * F.col("top")))
    bend = F.col("a") - 2 * F.col("v") + F.col("b")
    shift = F.when(F.abs(bend) > 1e-30, 0.5 * (F.col("a") - F.col("b")) / bend).otherwise(0.0)
    s = s.select("track", ((F.col("bin") + shift) * F.lit(sr / n_fft)).alias("f"), F.col("v").alias("m")).where((F.col("f") >= lo) & (F.col("f") < hi))
    s = s.join(s.groupBy("track").agg(F.median("m").alias("med")), "track").where(F.col("m") >= F.col("med"))
    semis = 12 * F.log2(F.col("f") / 440.0)
    off = semis - F.floor(semis)
    bucket = F.floor(F.round((F.when(off >= 0.5, off - 1).otherwise(off) + 0.5) * 100, 9))
    n = s.groupBy("track", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return n.groupBy("track").agg(F.max_by("bucket", F.struct("n", -F.col("bucket"))).alias("bucket")).select("track", (F.col("bucket") / F.lit(100.0) - 0.5).alias("tuning"))
