"""Queries of the framing, resampling and frame-feature operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series as S
from ..operators import spectra as P
from ..sources.tables import events, signal
from .base import EV, SG, Family, rounded

family = Family()
N_FFT, HOP, SR, MELS = 16, 4, 2000.0, 5

FR = f"""{SG}, fr AS (SELECT s.track, f.frame, s.i - f.frame * 4 + 8 AS k, s.x FROM sg s JOIN nn USING (track),
  LATERAL (SELECT unnest(generate_series(greatest(0, floor((s.i - 8) / 4.0)::BIGINT + 1), least(floor((s.i + 8) / 4.0)::BIGINT, n // 4))) AS frame) f)"""
SP = f"""{FR}, sp0 AS (SELECT track, frame, b.bin,
  sum(x * (0.5 - 0.5 * cos(2 * pi() * k / 16)) * cos(2 * pi() * b.bin * k / 16)) AS re,
  -sum(x * (0.5 - 0.5 * cos(2 * pi() * k / 16)) * sin(2 * pi() * b.bin * k / 16)) AS im
  FROM fr, (SELECT unnest(generate_series(0, 8)) AS bin) b GROUP BY 1, 2, 3), sp AS (SELECT *, sqrt(re * re + im * im) AS v FROM sp0)"""
_EDGES = [0.0]


def _mel_sql() -> str:
    rows = ", ".join(f"({b}, {m}, {w!r}::DOUBLE)" for b, m, w in S.mel_basis(N_FFT, SR, MELS))
    return f"{SP}, mb(bin, mel, w) AS (VALUES {rows}), ml AS (SELECT track, frame, mel::BIGINT AS mel, sum(w * v * v) AS v FROM sp JOIN mb USING (bin) GROUP BY 1, 2, 3)"


def _db(source: str, value: str = "v", out: str = "db") -> str:
    return f"(SELECT *, greatest({out}0, max({out}0) OVER (PARTITION BY track) - 80) AS {out} FROM (SELECT *, 10 * log10(greatest(1e-10, {value})) AS {out}0 FROM {source}))"


ML = _mel_sql()
MD = f"{ML}, md AS {_db('ml')}"


def _features(spark, d, *want, **how):
    return P.frame_features(signal(spark, d), N_FFT, HOP, SR, list(want), n_mels=MELS, bands=4, **how)


def _spec(spark, d):
    return P.bins(_features(spark, d, "re", "im"))


def _mel_db(spark, d):
    return P.in_db(_features(spark, d, "mel"), "mel")


@family("""SELECT o_custkey AS track, (o_orderkey % 8) AS i, round(avg(o_totalprice / 1e5), 9) AS x FROM orders GROUP BY 1, 2""")
def s2_downmix(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    o = o.select(F.col("o_custkey").alias("track"), (F.col("o_orderkey") % 8).alias("i"), F.col("o_orderkey").alias("channel"), (F.col("o_totalprice") / F.lit(1e5)).alias("x"))
    return rounded(S.downmix(o), 9)


@family(f"""WITH {SG}, g AS (SELECT track, n, unnest(generate_series(0, ceil(n * 1.5)::BIGINT - 1)) AS j FROM nn),
a AS (SELECT track, n, j, j / 1.5::DOUBLE AS pos, floor(j / 1.5::DOUBLE)::BIGINT AS lo FROM g)
SELECT a.track, j AS i, round(p.x + (coalesce(q.x, p.x) - p.x) * (pos - lo), 9) AS x
FROM a JOIN sg p ON p.track = a.track AND p.i = lo LEFT JOIN sg q ON q.track = a.track AND q.i = lo + 1""")
def s3_resample(spark, d):
    return rounded(S.resample_linear(signal(spark, d), 1.5), 9)


@family(f"WITH {FR} SELECT track, frame, count(*) AS filled, round(sum(x * k), 9) AS moment FROM fr GROUP BY 1, 2")
def f1_frames(spark, d):
    return rounded(S.frames(signal(spark, d), N_FFT, HOP).groupBy("track", "frame").agg(F.count("*").alias("filled"), F.sum(F.col("x") * F.col("k")).alias("moment")), 9)


@family(f"WITH {SP} SELECT track, frame, bin, round(re, 6) + 0 AS re, round(im, 6) + 0 AS im, round(v, 6) AS v FROM sp")
def f2_dft_bins(spark, d):
    return rounded(_spec(spark, d))


@family(f"WITH {SP}, e AS (SELECT track, frame, sum(CASE WHEN bin IN (0, 8) THEN 1 ELSE 2 END * v * v) / 16 AS energy FROM sp GROUP BY 1, 2) SELECT track, frame, round(energy, 6) AS energy FROM e")
def f2_spectrum_energy(spark, d):
    sp = _features(spark, d, "re", "im")
    both = F.zip_with("re", "im", lambda a, b: a * a + b * b)
    e = (2 * F.aggregate(both, F.lit(0.0), lambda s, x: s + x) - F.get(both, F.lit(0)) - F.get(both, F.lit(N_FFT // 2))) / F.lit(float(N_FFT))
    return rounded(sp.select("track", "frame", e.alias("energy")))


@family(f"WITH {SG} SELECT track, i, round(x, 9) AS x FROM sg JOIN nn USING (track) WHERE i >= 8 AND i + 8 < n")
def f3_inverse_overlap_add(spark, d):
    s = signal(spark, d)
    back = S.inverse_overlap_add(S.spectrum(S.frames(s, N_FFT, HOP), N_FFT), N_FFT, HOP)
    return rounded(back.join(S.lengths(s), "track").where((F.col("i") >= 8) & (F.col("i") + 8 < F.col("n"))).select("track", "i", "x"), 9)


@family(f"WITH {FR} SELECT track, frame, round(sqrt(sum(x * x) / 16.0), 6) AS rms FROM fr GROUP BY 1, 2")
def f4_frame_rms(spark, d):
    return rounded(_features(spark, d, "rms"))


@family(f"""WITH {SG}, e AS (SELECT track, i // 8 AS bucket, sqrt(avg(x * x)) AS rms FROM sg GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY rms) - 1 AS r, count(*) OVER (PARTITION BY track) AS n FROM e),
p AS (SELECT *, max(CASE WHEN r = floor(n * 0.98::DOUBLE) THEN rms END) OVER (PARTITION BY track) AS top FROM r)
SELECT track, bucket, round(CASE WHEN top > 0 THEN least(1, rms / top) ELSE 0 END, 6) AS level FROM p""")
def f5_envelope(spark, d):
    return rounded(S.envelope(signal(spark, d), 8))


@family(f"WITH {SG} SELECT track, ((i + 1) * 32 - 1) // n AS bin, min(x) AS lo, max(x) AS hi FROM sg JOIN nn USING (track) GROUP BY 1, 2")
def f6_minmax_bins(spark, d):
    return S.minmax_bins(signal(spark, d), 32)


@family(f"WITH {SG}, b AS (SELECT track, ((i + 1) * 32 - 1) // n AS bin, min(x) AS lo, max(x) AS hi FROM sg JOIN nn USING (track) GROUP BY 1, 2) SELECT track, bin // 4 AS bin, min(lo) AS lo, max(hi) AS hi FROM b GROUP BY 1, 2")
def f6_roll_up(spark, d):
    return S.roll_up_bins(S.minmax_bins(signal(spark, d), 32), 4)


@family(f"WITH {ML} SELECT track, frame, mel, round(v, 9) AS v FROM ml")
def f7_mel_power(spark, d):
    return rounded(P.unfolded(_features(spark, d, "mel"), "mel", "mel"), 9)


def _log1p(spark, d):
    return P.log1p_mel(signal(spark, d), N_FFT, HOP, SR, MELS, 30.0, 900.0)


#: Frames padded by reflection, their magnitudes, triangles that are not normalised.
RF = f"""{SG}, rp AS (SELECT track, i, x, n FROM sg JOIN nn USING (track) UNION ALL SELECT track, -i, x, n FROM sg JOIN nn USING (track) WHERE i BETWEEN 1 AND 8 UNION ALL SELECT track, 2 * (n - 1) - i, x, n FROM sg JOIN nn USING (track) WHERE i < n - 1 AND i >= n - 9),
rf AS (SELECT s.track, f.frame, s.i - f.frame * 4 + 8 AS k, s.x FROM rp s, LATERAL (SELECT unnest(generate_series(greatest(0, floor((s.i - 8) / 4.0)::BIGINT + 1), least(floor((s.i + 8) / 4.0)::BIGINT, n // 4))) AS frame) f WHERE n > 8),
rs AS (SELECT track, frame, bin, sqrt(re * re + im * im) AS v FROM (SELECT track, frame, b.bin, sum(x * (0.5 - 0.5 * cos(2 * pi() * k / 16)) * cos(2 * pi() * b.bin * k / 16)) AS re, sum(x * (0.5 - 0.5 * cos(2 * pi() * k / 16)) * sin(2 * pi() * b.bin * k / 16)) AS im
  FROM rf, (SELECT unnest(generate_series(0, 8)) AS bin) b GROUP BY 1, 2, 3))"""
_PLAIN = ", ".join(f"({b}, {m}, {w!r}::DOUBLE)" for b, m, w in S.mel_basis(N_FFT, SR, MELS, 30.0, 900.0, False))


@family(f"""WITH {RF}, pb(bin, mel, w) AS (VALUES {_PLAIN}), z AS (SELECT track, frame, m.mel::BIGINT AS mel, coalesce(sum(w * v), 0) / 4 AS v FROM rs CROSS JOIN (SELECT unnest(generate_series(0, {MELS - 1})) AS mel) m LEFT JOIN pb ON pb.bin = rs.bin AND pb.mel = m.mel GROUP BY 1, 2, 3)
SELECT track, frame, mel, round(ln(1 + 1000 * greatest(v, 1e-10)), 6) AS v FROM z""")
def f8_log1p_mel(spark, d):
    return rounded(P.unfolded(_log1p(spark, d), "mel", "mel"))


@family(f"WITH {MD} SELECT track, frame, mel, round(db, 6) AS db FROM md")
def f9_power_to_db(spark, d):
    return rounded(P.unfolded(_mel_db(spark, d), "db", "mel", "db"))


@family(f"""WITH {MD} SELECT track, frame, coef, round(sum(sqrt(CASE coef WHEN 0 THEN 0.2 ELSE 0.4 END::DOUBLE) * cos(pi() * coef * (2 * mel + 1) / 10) * db), 6) + 0 AS v
FROM md, (SELECT unnest(generate_series(0, 3)) AS coef) GROUP BY 1, 2, 3""")
def f10_mfcc(spark, d):
    return rounded(P.unfolded(P.mfcc(_mel_db(spark, d), MELS, 4), "mfcc", "coef"))


@family(f"""WITH {SP}, b AS (SELECT *, CASE WHEN bin * 125 < 200 THEN 0 ELSE least(3, floor(log2(bin * 125 / 200.0)) + 1) END::BIGINT AS band FROM sp),
c AS (SELECT *, row_number() OVER (PARTITION BY track, frame, band ORDER BY v, bin) AS up, row_number() OVER (PARTITION BY track, frame, band ORDER BY v DESC, bin) AS down,
  greatest(1, round_even(count(*) OVER (PARTITION BY track, frame, band) * 0.02, 0)) AS m FROM b),
e AS (SELECT track, frame, band, avg(v) FILTER (up <= m) AS low, avg(v) FILTER (down <= m) AS high FROM c GROUP BY 1, 2, 3),
h AS {_db('e', 'high', 'hi')}, l AS {_db('h', 'low', 'lo')}
SELECT track, frame, band, round(hi - lo, 6) + 0 AS contrast FROM l""")
def f12_spectral_contrast(spark, d):
    return rounded(P.unfolded(P.contrast(_features(spark, d, "contrast_low", "contrast_high")), "contrast", "band", "contrast"))


@family(f"WITH {SP} SELECT track, frame, round(sum(bin * 125.0::DOUBLE * v) / sum(v), 6) AS centroid FROM sp GROUP BY 1, 2")
def f13_centroid(spark, d):
    return rounded(_features(spark, d, "centroid"))


@family(f"WITH {SP} SELECT track, frame, round(exp(avg(ln(greatest(v * v, 1e-10)))) / avg(greatest(v * v, 1e-10)), 6) AS flatness FROM sp GROUP BY 1, 2")
def f14_flatness(spark, d):
    return rounded(_features(spark, d, "flatness"))


@family(f"""WITH {MD}, r AS (SELECT track, frame, greatest(0, db - lag(db) OVER (PARTITION BY track, mel ORDER BY frame)) AS rise FROM md),
o AS (SELECT track, frame, avg(coalesce(rise, 0)) AS o FROM r GROUP BY 1, 2)
SELECT track, frame, round(coalesce(lag(o, 2) OVER (PARTITION BY track ORDER BY frame), 0), 6) AS onset FROM o""")
def f15_onset_strength(spark, d):
    return rounded(P.onset_strength(_mel_db(spark, d)))


@family(f"""WITH {SP}, r AS (SELECT track, frame, greatest(0, v - lag(v) OVER (PARTITION BY track, bin ORDER BY frame)) AS rise FROM sp),
f AS (SELECT track, frame, sum(coalesce(rise, 0)) AS flux FROM r GROUP BY 1, 2),
g AS (SELECT *, lag(flux) OVER w AS b, lead(flux) OVER w AS a, avg(flux) OVER n AS m, stddev_pop(flux) OVER n AS s FROM f
  WINDOW w AS (PARTITION BY track ORDER BY frame), n AS (PARTITION BY track ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
SELECT track, frame, round(flux, 6) AS flux FROM g WHERE flux > b AND flux >= a AND flux > m + 0.3 * s""")
def f16_flux_onsets(spark, d):
    return rounded(P.flux_peaks(_features(spark, d, "flux")))


def _mirror(k: int) -> str:
    return f"""m AS (SELECT track, i, x, n FROM sg JOIN nn USING (track) UNION ALL SELECT track, -i - 1, x, n FROM sg JOIN nn USING (track) WHERE i < {k}
UNION ALL SELECT track, 2 * n - 1 - i, x, n FROM sg JOIN nn USING (track) WHERE i >= n - {k})"""


@family(f"""WITH {SG}, {_mirror(2)}, o AS (SELECT track, i, n, list_sort(list(x) OVER (PARTITION BY track ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))[3] AS x FROM m)
SELECT track, i, x FROM o WHERE i >= 0 AND i < n""")
def f17_rolling_median(spark, d):
    return S.rolling_median(signal(spark, d), 5)


@family(f"""WITH {SG}, {_mirror(2)}, o AS (SELECT track, i, n, avg(x) OVER (PARTITION BY track ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS x FROM m)
SELECT track, i, round(x, 9) AS x FROM o WHERE i >= 0 AND i < n""")
def m3_uniform_filter(spark, d):
    return rounded(S.uniform_filter(signal(spark, d), 5), 9)


@family(f"""WITH {SP}, w AS (SELECT *, list_sort(list(v) OVER (PARTITION BY track, bin ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS a,
  list_sort(list(v) OVER (PARTITION BY track, frame ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS b FROM sp),
m AS (SELECT track, frame, bin, a[len(a) // 2 + 1] AS h, b[len(b) // 2 + 1] AS p FROM w)
SELECT track, frame, bin, round(CASE WHEN h * h + p * p < 1e-30 THEN 0.5 ELSE h * h / (h * h + p * p) END, 6) AS mask FROM m""")
def f18_hpss_mask(spark, d):
    return rounded(S.hpss_harmonic(_spec(spark, d), 5).select("track", "frame", "bin", "mask"))


@family(f"""WITH {SP}, f AS (SELECT track, frame, sum(CASE WHEN bin <= 2 THEN v END) / sum(v) AS harmonic, sum(CASE WHEN bin BETWEEN 2 AND 5 THEN v END) / sum(v) AS band,
  1 - exp(avg(ln(greatest(v * v, 1e-10)))) / avg(greatest(v * v, 1e-10)) AS inverse FROM sp GROUP BY 1, 2),
q AS (SELECT track, quantile_cont(harmonic, 0.95) AS qh, quantile_cont(band, 0.95) AS qb, quantile_cont(inverse, 0.95) AS qi FROM f GROUP BY 1),
a AS (SELECT track, frame, 0.4 * least(1, greatest(0, harmonic / qh)) + 0.33 * least(1, greatest(0, band / qb)) + 0.27 * least(1, greatest(0, inverse / qi)) AS activity FROM f JOIN q USING (track)),
s AS (SELECT *, coalesce(activity - lag(activity) OVER (PARTITION BY track ORDER BY frame), 0) AS step FROM a),
z AS (SELECT track, quantile_cont(greatest(step, 0), 0.95) AS qe, quantile_cont(greatest(-step, 0), 0.95) AS qx FROM s GROUP BY 1)
SELECT track, frame, round(activity, 6) AS activity, round(CASE WHEN qe > 0 THEN least(1, greatest(step, 0) / qe) ELSE 0 END, 6) + 0 AS entry,
  round(CASE WHEN qx > 0 THEN least(1, greatest(-step, 0) / qx) ELSE 0 END, 6) + 0 AS exit FROM s JOIN z USING (track)""")
def f20_vocal_activity(spark, d):
    f = _features(spark, d, "magnitude", "total", "flatness")
    share = lambda first, n: F.aggregate(F.slice("magnitude", first + 1, n), F.lit(0.0), lambda s, x: s + x) / F.col("total")
    return rounded(S.vocal_activity(f.select("track", "frame", share(0, 3).alias("harmonic"), share(2, 4).alias("band"), "flatness")))


@family(f"""WITH {EV}, p AS (SELECT track, quantile_cont(x, 0.95) AS p FROM ev GROUP BY 1) SELECT track, i, round(CASE WHEN p > 0 THEN least(1, greatest(0, x / p)) ELSE 0 END, 6) AS x FROM ev JOIN p USING (track)""")
def f21_percentile_scaled(spark, d):
    return rounded(S.percentile_scaled(events(spark, d).select("track", "i", "x")))


@family(f"""WITH {EV}, g AS (SELECT track, count(*) AS n, sqrt(avg(x * x)) AS rms FROM ev GROUP BY 1)
SELECT track, n, CASE WHEN n < 60 THEN 'short' WHEN rms < 60 THEN 'silent' END AS reason FROM g""")
def f22_gate_tracks(spark, d):
    return S.gate_tracks(events(spark, d), 60, 60.0)


@family(f"""WITH {SG}, c AS (SELECT track, n, unnest(generate_series(-6, greatest(-6, n - 7), 88)) AS s FROM nn), k AS (SELECT track, n, row_number() OVER (PARTITION BY track ORDER BY s) - 1 AS chunk, s FROM c),
l AS (SELECT *, CASE WHEN chunk = max(chunk) OVER (PARTITION BY track) AND n > 88 THEN n - 94 ELSE s END AS start FROM k),
v AS (SELECT l.track, l.chunk, sg.i AS frame, sg.x + l.chunk AS score FROM l JOIN sg ON sg.track = l.track AND sg.i >= start + 6 AND sg.i < start + 94)
SELECT track, frame, round(min_by(score, chunk), 9) AS score FROM v GROUP BY 1, 2""")
def f23_chunk_and_stitch(spark, d):
    s = signal(spark, d)
    n = S.lengths(s)
    size, border = 100, 6
    c = S.chunks_with_border(n, size, border).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("i", F.col("start") + F.col("k"))
    scored = c.join(s, ["track", "i"]).select("track", "chunk", "start", "k", (F.col("x") + F.col("chunk")).alias("score"))  # the scorer
    return rounded(S.stitch(scored, n, size, border), 9)


_CHROMA = ", ".join(f"({b}, {c}, {w!r}::DOUBLE)" for b, c, w in S.chroma_basis(N_FFT, SR))


@family(f"""WITH {SP}, cb(bin, pitch, w) AS (VALUES {_CHROMA}), c AS (SELECT track, frame, pitch::BIGINT AS pitch, sum(w * v * v) AS v FROM sp JOIN cb USING (bin) GROUP BY 1, 2, 3)
SELECT track, frame, pitch, round(v / max(v) OVER (PARTITION BY track, frame), 6) AS v FROM c""")
def f11_chroma(spark, d):
    return rounded(P.unfolded(_features(spark, d, "chroma"), "chroma", "pitch"))


@family(f"""WITH {SP}, n AS (SELECT track, frame, bin, v, lag(v) OVER w AS a, lead(v) OVER w AS b, max(v) OVER (PARTITION BY track, frame) AS top FROM sp WINDOW w AS (PARTITION BY track, frame ORDER BY bin)),
p AS (SELECT track, v AS m, (bin + CASE WHEN abs(a - 2 * v + b) > 1e-30 THEN 0.5 * (a - b) / (a - 2 * v + b) ELSE 0 END) * 125.0::DOUBLE AS f FROM n WHERE v > a AND v >= b AND v > 0.1 * top),
q AS (SELECT * FROM p WHERE f >= 150 AND f < 4000), md AS (SELECT track, median(m) AS med FROM q GROUP BY 1), o AS (SELECT track, 12 * log2(f / 440) - floor(12 * log2(f / 440)) AS o FROM q JOIN md USING (track) WHERE m >= med),
h AS (SELECT track, floor(round((CASE WHEN o >= 0.5 THEN o - 1 ELSE o END + 0.5) * 100, 9)) AS bucket, count(*) AS n FROM o GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY n DESC, bucket) AS r FROM h) SELECT track, round(bucket / 100 - 0.5, 6) + 0 AS tuning FROM r WHERE r = 1""")
def f19_estimate_tuning(spark, d):
    return rounded(S.estimate_tuning(_spec(spark, d), N_FFT, SR))


@family(f"""WITH {SG}, fr AS (SELECT s.track, f.frame, s.i - f.frame * 512 + 1024 AS k, s.x FROM sg s JOIN nn USING (track), LATERAL (SELECT unnest(generate_series(greatest(0, floor((s.i - 1024) / 512.0)::BIGINT + 1), least(floor((s.i + 1024) / 512.0)::BIGINT, n // 512))) AS frame) f)
SELECT track, frame, round(sqrt(sum(x * x) / 2048), 6) AS rms, round(sum((x * (0.5 - 0.5 * cos(2 * pi() * k / 2048))) ** 2), 6) AS energy, round(abs(sum(x * (0.5 - 0.5 * cos(2 * pi() * k / 2048)))), 6) AS dc FROM fr GROUP BY 1, 2""")
def f2_spectrum_2048(spark, d):
    """Frames of 2048 samples: level, energy by the spectrum, and its first bin."""
    f = P.frame_features(signal(spark, d), 2048, 512, 22050.0, ["rms", "magnitude"])
    whole = F.aggregate("magnitude", F.lit(0.0), lambda s, x: s + x * x)
    edge = lambda k: F.pow(F.get("magnitude", F.lit(k)), F.lit(2.0))
    return rounded(f.select("track", "frame", "rms", ((2 * whole - edge(0) - edge(1024)) / 2048).alias("energy"), F.get("magnitude", F.lit(0)).alias("dc")))


@family()
def f14_features_2048(spark, d):
    """All frame features at frames of 2048 samples."""
    f = P.frame_features(signal(spark, d), 2048, 512, 22050.0, ["rms", "centroid", "flatness", "flux", "mel", "chroma", "contrast_low", "contrast_high"])
    m = P.mfcc(P.in_db(f, "mel"), 128, 40)
    return rounded(m.join(P.contrast(f), ["track", "frame"]).select("track", "frame", "rms", "centroid", "flatness", "flux", "mfcc", "chroma", "contrast"))
