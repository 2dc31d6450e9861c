"""Frame features of regular series at any frame size: spectra stay arrays, filter banks are matrices.

A series is cut into stretches of frames with the samples that they reach; one Arrow kernel takes a stretch's frames as views of its
samples, their FFTs, and all wanted features as products with small matrices. Nothing but the wanted columns leaves it, one row a
frame; a row for each bin exists only where a caller unfolds a column. A long track is spread over its stretches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import chroma_basis, hann, lengths, mel_basis

#: Frames of a stretch.
STRETCH = 128
#: What frame_features can give: its type, and whether it needs the spectrum.
SCALARS = {"rms": False, "centroid": True, "flatness": True, "flux": True, "total": True}
ARRAYS = {"re": True, "im": True, "magnitude": True, "mel": True, "amplitude_mel": True, "chroma": True, "contrast_low": True, "contrast_high": True}


def _matrix(rows: list[tuple[int, int, float]], n_bins: int, n: int) -> np.ndarray:
    out = np.zeros((n_bins, n))
    for k, m, w in rows:
        out[k, m] = w
    return out


def octave_bands(n_fft: int, sr: float, bands: int, fmin: float = 200.0) -> np.ndarray:
    """Band of each bin: 0 under fmin, then octaves, the last open."""
    f = np.arange(n_fft // 2 + 1) * (sr / n_fft)
    up = np.floor(np.log2(np.maximum(f, 1e-30) / fmin)) + 1
    return np.where(f < fmin, 0, np.minimum(bands - 1, up)).astype(int)


def _kernels(n_fft: int, sr: float, want: list[str], n_mels: int, mel_lo: float, mel_hi: float | None, mel_norm: bool, tuning: float, bands: int, quantile: float) -> Callable:
    """want -> function of (frames, spectra, magnitudes with the frame before them) giving all columns of a stretch."""
    n_bins = n_fft // 2 + 1
    mel = _matrix(mel_basis(n_fft, sr, n_mels, mel_lo, mel_hi, mel_norm), n_bins, n_mels) if {"mel", "amplitude_mel"} & set(want) else None
    tone = _matrix(chroma_basis(n_fft, sr, tuning), n_bins, 12) if "chroma" in want else None
    band = octave_bands(n_fft, sr, bands)
    hz = np.arange(n_bins) * (sr / n_fft)

    def contrast(v: np.ndarray, high: bool) -> np.ndarray:
        out = np.full((len(v), bands), np.nan)
        for b in range(bands):
            part = np.sort(v[:, band == b], axis=1)
            n = part.shape[1]
            if n:
                m = max(1, int(np.rint(n * quantile)))
                out[:, b] = (part[:, n - m :] if high else part[:, :m]).mean(1)
        return out

    def chroma(v: np.ndarray) -> np.ndarray:
        c = v**2 @ tone
        top = c.max(1, keepdims=True)
        return np.where(top > 1e-30, c / np.where(top > 1e-30, top, 1.0), 0.0)

    def flatness(v: np.ndarray) -> np.ndarray:
        p = np.maximum(v**2, 1e-10)
        return np.exp(np.log(p).mean(1)) / p.mean(1)

    def run(x: np.ndarray, z: np.ndarray, v: np.ndarray, before: np.ndarray) -> dict[str, np.ndarray]:
        """before: the magnitudes of the frame before the first, or its own."""
        made = {
            "rms": lambda: np.sqrt((x**2).sum(1) / n_fft), "re": lambda: z.real, "im": lambda: z.imag, "magnitude": lambda: v, "total": lambda: v.sum(1),
            "mel": lambda: v**2 @ mel, "amplitude_mel": lambda: v @ mel, "chroma": lambda: chroma(v), "flatness": lambda: flatness(v),
            "centroid": lambda: (v @ hz) / np.where(v.sum(1) < 1.1754944e-38, 1.0, v.sum(1)), "flux": lambda: np.maximum(0.0, np.diff(np.vstack([before, v]), axis=0)).sum(1),
            "contrast_low": lambda: contrast(v, False), "contrast_high": lambda: contrast(v, True),
        }
        return {w: made[w]() for w in want}

    return run


def frame_features(
    series: DataFrame, n_fft: int, hop: int, sr: float, want: list[str], pad: str = "zero", n_mels: int = 128, mel_lo: float = 0.0, mel_hi: float | None = None, mel_norm: bool = True,
    tuning: float = 0.0, bands: int = 7, quantile: float = 0.02, stretch: int = STRETCH,
) -> DataFrame:
    """(track, frame, wanted columns) of a series (track, i, x), i from 0 without gaps: centred Hann frames, 1 + n // hop of them, padded with zeros
    or by reflection (then of tracks longer than half a frame only).

    rms of the plain frame; re, im, magnitude by bin; total of the magnitudes; mel and amplitude_mel (weighted sums of power and of magnitudes);
    chroma (power by pitch class over the frame's largest); contrast_low and contrast_high (mean of the weakest and strongest bins
    of each octave); centroid in Hz; flatness; flux (sum of rises of magnitudes since the frame before, 0 for the first)."""
    unknown = set(want) - set(SCALARS) - set(ARRAYS)
    if unknown or pad not in ("zero", "reflect"):
        raise ValueError(f"no such feature or padding: {sorted(unknown) or pad}")
    half, span = n_fft // 2, stretch * hop
    s = series.select("track", F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x")).join(lengths(series), "track")
    if pad == "reflect":
        s = s.where(F.col("n") > half)
    # a stretch reaches from half a frame and one hop before its first frame (for the flux) to half a frame after its last; reflection
    # looks at two samples more
    first = F.floor((F.col("i") - half + hop - 2) / span)
    last = F.floor((F.col("i") + half + hop + 2) / span)
    some = F.sequence(F.greatest(F.lit(0).cast("long"), first), F.least(last, F.floor(F.floor(F.col("n") / hop) / stretch)))
    s = s.withColumn("c", F.explode(some)).groupBy("track", "n", "c").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("p"))
    kind = dict(series.dtypes)["track"]
    names = ["track", "frame", *want]

    def lists(v: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(v).ravel(), from_pandas=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = _kernels(n_fft, sr, want, n_mels, mel_lo, mel_hi, mel_norm, tuning, bands, quantile)
        window = hann(n_fft)
        for batch in batches:
            for r in range(batch.num_rows):
                n, c, p = batch.column("n")[r].as_py(), batch.column("c")[r].as_py(), batch.column("p")[r].values
                f0, f1 = c * stretch, min((c + 1) * stretch, n // hop + 1)
                if f1 <= f0:
                    continue
                lo = (f0 - 1) * hop - half
                at = np.arange(lo, (f1 - 1) * hop + half)
                i, x = p.field("i").to_numpy(), p.field("x").to_numpy(zero_copy_only=False)
                src = at if pad == "zero" else np.where(at < 0, -at, np.where(at >= n, 2 * (n - 1) - at, at))
                place = src - i[0]
                there = (place >= 0) & (place < len(x)) & (src >= 0) & (src < n)
                y = np.where(there, x[np.clip(place, 0, len(x) - 1)], 0.0)
                frames = np.lib.stride_tricks.sliding_window_view(y, n_fft)[::hop]
                z = np.fft.rfft(frames * window, axis=1)
                v = np.abs(z)
                got = kernel(frames[1:], z[1:], v[1:], v[:1] if f0 else v[1:2])
                cols = [pa.array([batch.column("track")[r].as_py()] * (f1 - f0), batch.schema.field("track").type), pa.array(np.arange(f0, f1))]
                yield pa.RecordBatch.from_arrays([*cols, *(lists(got[w]) if w in ARRAYS else pa.array(got[w]) for w in want)], names)

    ddl = ", ".join([f"track {kind}, frame long", *(f"{w} {'array<double>' if w in ARRAYS else 'double'}" for w in want)])
    return s.mapInArrow(run, ddl)


def unfolded(df: DataFrame, column: str, number: str, value: str = "v") -> DataFrame:
    """(track, frame, number, value): a row for each element that is there."""
    return df.select("track", "frame", F.posexplode(column).alias("__k", value)).where(F.col(value).isNotNull()).select("track", "frame", F.col("__k").cast("long").alias(number), value)


def in_db(df: DataFrame, column: str, out: str = "db", amin: float = 1e-10, top_db: float = 80.0, ref: float = 1.0) -> DataFrame:
    """df with `out`: the array in db over ref (0 or less: the track's largest value), not under the track's largest less top_db."""
    top = df.groupBy("track").agg(F.greatest(F.lit(amin), F.max(F.array_max(column))).alias("__top"))
    log = lambda v: 10 * F.log10(v)
    d = df.join(top, "track").withColumn("__ref", log(F.lit(ref)) if ref > 0 else log(F.col("__top"))).withColumn("__least", log(F.col("__top")) - F.col("__ref") - F.lit(top_db))
    return d.withColumn(out, F.transform(column, lambda v: F.greatest(log(F.greatest(F.lit(amin), v)) - F.col("__ref"), F.col("__least")))).drop("__top", "__ref", "__least")


def projected(df: DataFrame, column: str, matrix: np.ndarray, out: str) -> DataFrame:
    """df with `out`: the array times the matrix, batches of rows at a time."""
    names, fields = df.columns, df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(matrix)) @ matrix
                made = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32)), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, made], [*names, out])

    from pyspark.sql import types as T

    return df.mapInArrow(run, T.StructType([*fields.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))


def cosine_basis(n_mels: int, n: int) -> np.ndarray:
    """Orthonormal cosine transform: (mels, coefficients)."""
    m, c = np.arange(n_mels)[:, None], np.arange(n)[None]
    return np.sqrt(np.where(c == 0, 1.0, 2.0) / n_mels) * np.cos(np.pi * c * (2 * m + 1) / (2 * n_mels))


def mfcc(df: DataFrame, n_mels: int, n: int, column: str = "db") -> DataFrame:
    """df with mfcc: n coefficients of the mel array in db."""
    return projected(df, column, cosine_basis(n_mels, n), "mfcc")


def log1p_mel(series: DataFrame, n_fft: int = 1024, hop: int = 441, sr: float = 22050.0, n_mels: int = 128, lo: float = 30.0, hi: float = 11000.0, gain: float = 1000.0) -> DataFrame:
    """(track, frame, mel): log(1 + gain * energy) of the magnitudes over the root of the frame size, by triangles that are not normalised;
    frames padded by reflection."""
    f = frame_features(series, n_fft, hop, sr, ["amplitude_mel"], "reflect", n_mels, lo, hi, False)
    return f.select("track", "frame", F.transform("amplitude_mel", lambda v: F.log1p(F.lit(gain) * F.greatest(v / F.lit(float(n_fft) ** 0.5), F.lit(1e-10)))).alias("mel"))


def onset_strength(df: DataFrame, column: str = "db", shift: int = 3) -> DataFrame:
    """(track, frame, onset): mean over the array of the rises since the frame before, moved by shift - 1 frames, zero before."""
    d = df.select("track", "frame", F.col(column).alias("a"))
    before = d.select("track", (F.col("frame") + 1).alias("frame"), F.col("a").alias("b"))
    up = F.aggregate(F.zip_with("a", "b", lambda x, y: F.greatest(F.lit(0.0), x - y)), F.lit(0.0), lambda s, x: s + x) / F.size("a")
    o = d.join(before, ["track", "frame"], "left").select("track", "frame", F.coalesce(up, F.lit(0.0)).alias("o"))
    moved = o.select("track", (F.col("frame") + shift - 1).alias("frame"), F.col("o").alias("onset")) if shift > 1 else o.withColumnRenamed("o", "onset")
    return o.select("track", "frame").join(moved, ["track", "frame"], "left").withColumn("onset", F.coalesce("onset", F.lit(0.0)))


def contrast(df: DataFrame) -> DataFrame:
    """(track, frame, contrast array): db of the strongest bins less that of the weakest, of frame_features' contrast columns."""
    d = in_db(in_db(df, "contrast_high", "hi"), "contrast_low", "lo")
    return d.select("track", "frame", F.zip_with("hi", "lo", lambda a, b: a - b).alias("contrast"))


def flux_peaks(df: DataFrame, reach: int = 3, factor: float = 0.3) -> DataFrame:
    """(track, frame, flux) of local maxima of the flux that exceed mean + factor * deviation of the frames around."""
    from pyspark.sql import Window

    w = Window.partitionBy("track").orderBy("frame")
    near = w.rowsBetween(-reach, reach)
    f = df.select("track", "frame", "flux").withColumns({"before": F.lag("flux").over(w), "after": F.lead("flux").over(w), "mean": F.avg("flux").over(near), "dev": F.stddev_pop("flux").over(near)})
    return f.where((F.col("flux") > F.col("before")) & (F.col("flux") >= F.col("after")) & (F.col("flux") > F.col("mean") + F.lit(factor) * F.col("dev"))).select("track", "frame", "flux")


def bins(df: DataFrame) -> DataFrame:
    """(track, frame, bin, re, im, v) of frame_features' re and im."""
    s = df.select("track", "frame", F.posexplode(F.arrays_zip("re", "im")).alias("bin", "z")).select("track", "frame", F.col("bin").cast("long").alias("bin"), "z.re", "z.im")
    size: Column = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    return s.withColumn("v", size)
