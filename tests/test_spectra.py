"""Frame features of array spectra against whole-track numpy, and the published mel values of a sine."""

import numpy as np
import pytest

from spliceflow.operators import series as S
from spliceflow.operators import spectra as P

#: log(1 + 1000 mel) of the first frame of two seconds of a 440 Hz sine of amplitude 0.5 at 22050 Hz (published values).
SINE = (5.684086800, 5.701706886, 5.824301720, 5.799798965, 5.808798790, 5.860399246, 5.923037529, 6.051318645, 6.187708855, 6.231110096, 6.378122330, 6.569626331, 6.819249630, 7.477107048, 7.866183758, 7.565844536, 7.769135475, 7.391470909, 6.825944901, 6.410817623)


def signal(spark, tracks):
    return spark.createDataFrame([(t, i, float(v)) for t, x in tracks.items() for i, v in enumerate(x)], "track long, i long, x double")


def test_mel_of_a_sine_is_the_published_one(spark):
    x = (0.5 * np.sin(2 * np.pi * 440 * np.arange(44100) / 22050)).astype(np.float32)
    got = {r.frame: r.mel for r in P.log1p_mel(signal(spark, {0: x})).collect()}
    assert len(got) == 44100 // 441 + 1 and all(len(v) == 128 for v in got.values())
    assert np.abs(np.array(got[0][: len(SINE)]) - SINE).max() < 1e-4


@pytest.mark.parametrize("pad", ["zero", "reflect"])
@pytest.mark.parametrize("n_fft,hop,stretch", [(64, 16, 5), (48, 7, 3), (32, 40, 4)])
def test_features_equal_those_of_whole_tracks(spark, pad, n_fft, hop, stretch):
    rng = np.random.default_rng(n_fft)
    tracks = {0: rng.normal(size=1003), 1: rng.normal(size=n_fft // 2 + 3), 2: np.zeros(300), 3: rng.normal(size=320)}
    want = ["rms", "centroid", "flatness", "flux", "total", "re", "im", "magnitude", "mel", "amplitude_mel", "chroma", "contrast_low", "contrast_high"]
    got = {(r.track, r.frame): r for r in P.frame_features(signal(spark, tracks), n_fft, hop, 8000.0, want, pad, n_mels=9, bands=4, stretch=stretch).collect()}
    assert len(got) == sum(1 + len(x) // hop for x in tracks.values())
    mel, tone = np.zeros((n_fft // 2 + 1, 9)), np.zeros((n_fft // 2 + 1, 12))
    for k, m, w in S.mel_basis(n_fft, 8000.0, 9):
        mel[k, m] = w
    for k, c, w in S.chroma_basis(n_fft, 8000.0):
        tone[k, c] = w
    f = np.arange(n_fft // 2 + 1) * 8000.0 / n_fft
    band = np.where(f < 200, 0, np.minimum(3, np.floor(np.log2(np.maximum(f, 1e-9) / 200)) + 1))
    for t, x in tracks.items():
        y, before = np.pad(x, n_fft // 2, mode="constant" if pad == "zero" else "reflect"), None
        for k in range(1 + len(x) // hop):
            part = np.concatenate([y[k * hop : k * hop + n_fft], np.zeros(n_fft)])[:n_fft]
            z = np.fft.rfft(part * S.hann(n_fft))
            v, p = np.abs(z), np.maximum(np.abs(z) ** 2, 1e-10)
            c, r = v**2 @ tone, got[t, k]
            size = [max(1, int(np.rint((band == b).sum() * 0.02))) for b in range(4)]
            plain = {
                "rms": np.sqrt((part**2).mean()), "centroid": v @ f / (v.sum() if v.sum() > 1e-37 else 1.0), "flatness": np.exp(np.log(p).mean()) / p.mean(), "flux": 0.0 if before is None else np.maximum(v - before, 0).sum(), "total": v.sum(),
                "re": z.real, "im": z.imag, "magnitude": v, "mel": v**2 @ mel, "amplitude_mel": v @ mel, "chroma": c / c.max() if c.max() > 1e-30 else np.zeros(12),
            }
            for name, value in plain.items():
                assert np.abs(np.array(r[name]) - value).max() < 1e-8, (t, k, name)
            for b in range(4):
                s = np.sort(v[band == b])
                assert r.contrast_low[b] is None if not len(s) else abs(r.contrast_low[b] - s[: size[b]].mean()) < 1e-9 and abs(r.contrast_high[b] - s[-size[b] :].mean()) < 1e-9
            before = v


def test_db_cosines_and_onsets_over_arrays(spark):
    rng = np.random.default_rng(4)
    v = rng.uniform(0, 1, (30, 6)) ** 8
    d = spark.createDataFrame([(0, k, x.tolist()) for k, x in enumerate(v)], "track long, frame long, mel array<double>")
    db = np.maximum(10 * np.log10(np.maximum(1e-10, v)), 10 * np.log10(v.max()) - 30)
    out = P.mfcc(P.in_db(d, "mel", top_db=30.0), 6, 4)
    for r in out.collect():
        assert np.abs(np.array(r.db) - db[r.frame]).max() < 1e-9
        want = [np.sqrt((1 if c == 0 else 2) / 6) * sum(db[r.frame, m] * np.cos(np.pi * c * (2 * m + 1) / 12) for m in range(6)) for c in range(4)]
        assert np.abs(np.array(r.mfcc) - want).max() < 1e-9
    rise = np.concatenate([[0.0], np.maximum(0, np.diff(db, axis=0)).mean(1)])
    got = {r.frame: r.onset for r in P.onset_strength(out).collect()}
    assert len(got) == 30 and all(abs(got[k] - (rise[k - 2] if k >= 2 else 0.0)) < 1e-9 for k in range(30))
    top = {r.frame: r.db for r in P.in_db(d, "mel", ref=0.0).collect()}
    assert abs(max(max(x) for x in top.values())) < 1e-12


def test_unknown_features_and_empty_tables(spark):
    none = spark.createDataFrame([], "track long, i long, x double")
    assert P.frame_features(none, 16, 4, 100.0, ["rms"]).count() == 0
    with pytest.raises(ValueError):
        P.frame_features(none, 16, 4, 100.0, ["pitch"])
