"""Splice searches against plain loops over all combinations, on signals of one and two channels."""

import math

import numpy as np
import pytest

from spliceflow.functions import windows as W
from spliceflow.operators import splices as X


# ---- the rules once more, one window and one sample at a time


def hann(n):
    return [0.5 - 0.5 * math.cos(2 * math.pi * k / (n - 1)) for k in range(n)]


def cos(x, y):
    nx, ny = math.sqrt(sum(v * v for v in x)), math.sqrt(sum(v * v for v in y))
    return None if nx <= 1e-8 or ny <= 1e-8 else sum(a * b for a, b in zip(x, y)) / (nx * ny)


def taper(x):
    m = sum(x) / len(x)
    return [(v - m) * h for v, h in zip(x, hann(len(x)))]


def similarity(a, b):
    if len(a[0]) < 16:
        return -1.0
    same, rise = [], []
    for x, y in zip(a, b):
        x, y = taper(x), taper(y)
        if (c := cos(x, y)) is not None:
            same.append(c)
            if (r := cos(np.diff(x), np.diff(y))) is not None:
                rise.append(r)
    if not same:
        return -1.0
    s = sum(same) / len(same)
    return max(-1.0, min(1.0, 0.8 * s + 0.2 * (sum(rise) / len(rise) if rise else s)))


def box(x, k):
    ahead = (k - 1) // 2
    return [sum(x[m] for m in range(max(0, i + ahead - k + 1), min(len(x) - 1, i + ahead) + 1)) / k for i in range(len(x))]


def first_max(v):
    v = [round(x, 9) for x in v]
    return v.index(max(v))


def onset(w):
    n = len(w[0])
    if n < 16:
        return n // 2
    e = box([math.sqrt(sum(c[i] ** 2 for c in w) / len(w)) for i in range(n)], min(64, max(4, n // 8)))
    return first_max([0.0] + [max(0.0, e[i] - e[i - 1]) for i in range(1, n)])


def onset_near(x, at, back, ahead):
    e = [math.sqrt(sum(c[i] ** 2 for c in x) / len(x)) for i in range(len(x[0]))]
    lo, hi = max(0, at - back), min(len(e), at + ahead)
    if hi - lo < 128:
        return at
    d = np.diff(box(e[lo:hi], min(64, (hi - lo) // 2))).tolist()
    return lo + first_max(box(d, min(32, len(d) // 2)))


def db(a, b):
    rms = lambda w: math.sqrt(sum(v * v for c in w for v in c) / (len(w) * len(w[0])) + 1e-10)
    return min(1.0, abs(20 * math.log10(rms(a) / rms(b))) / 12)


def cut(x, lo, hi):
    return [c[lo:hi] for c in x]


def search(x, beats, prev, curr, vocal, rate, s, e, least_ms, local_ms, back, ahead):
    least, radius, n = round(least_ms * rate / 1000), max(16, round(local_ms * rate / 2000)), len(x[0])
    best, won = -1.0, None
    last = len(beats) - 1
    for a in range(max(0, prev - s), min(last, prev) + 1):
        ao = onset_near(x, beats[a], back, ahead)
        for b in range(max(0, curr), min(last, curr + s) + 1):
            ai = onset_near(x, beats[b], back, ahead)
            for c in range(max(0, curr - s), min(last, curr) + 1):
                for d in range(max(1, prev + 1), min(last, prev + e) + 1):
                    pre, post = ai - beats[c], beats[d] - ao
                    if pre < least or post < least or pre + post < 2 * least or ao - pre < 0 or ai + post > n:
                        continue
                    wo, wi = cut(x, ao - pre, beats[d]), cut(x, beats[c], ai + post)
                    sim, size = similarity(wo, wi), pre + post
                    q = u = v = 0.0
                    if sim > -0.99:
                        lo, hi = max(0, pre - radius), min(size, pre + radius)
                        near = similarity(cut(wo, lo, hi), cut(wi, lo, hi)) if hi - lo >= 16 else sim
                        w = min(0.7, 0.4 + 0.25 * min(1, max(0, vocal)))
                        u, v = (min(1, max(0, (y + 1) / 2)) for y in (sim, near))
                        q = (1 - w) * u + w * v - 0.08 * db(wo, wi) - 0.04 * max(0, 1 - min(pre, size - pre) / max(1, size * 0.18))
                        q = min(1, max(0, q))
                    if round(q, 9) > best:
                        best, won = round(q, 9), (a, b, c, d, ao, ai, ao - pre, beats[d], beats[c], ai + post, size, q, u, v)
    return won


def refine(x, succ, target, end, n, rate, most_ms, coarse, keep, back, ahead):
    total, half = len(x[0]), n // 2
    most = min(int(most_ms * rate / 1000), max(half - 1, 0))
    if n <= 16 or most <= 0:
        return None
    no, ni = onset_near(x, succ, back, ahead) + half, onset_near(x, min(total - 1, max(0, target)), back, ahead) - half
    o0, o1 = max(n, no - most), min(total, succ + n, no + most)
    i0, i1 = max(0, ni - most), min(total - n, end - n, ni + most)
    if o0 >= o1 or i0 >= i1:
        return None
    step = max(1, min(max(4, coarse), most))
    best = [-1.0, -1.0, min(max(no, o0), o1), min(max(ni, i0), i1)]

    def full(o, i):
        a, b = cut(x, o - n, o), cut(x, i, i + n)
        sim = similarity(a, b)
        if sim <= -0.99:
            return
        oa, ob, mid = onset(a), onset(b), 0.5 * (n - 1)
        score = sim - 0.1 * db(a, b) - 0.15 * min(1, (abs(o - no) + abs(i - ni)) / (2 * most))
        score -= 0.14 * min(1, (abs(oa - mid) + abs(ob - mid)) / (2 * max(1, 0.35 * n))) + 0.10 * min(1, abs(oa - ob) / max(1, 0.25 * n))
        if round(score, 9) > best[0]:
            best[:] = [round(score, 9), sim, o, i]

    rough = []
    for o in range(o0, o1 + 1, step):
        for i in range(i0, i1 + 1, step):
            a, b = ([sum(c) for c in zip(*w)] for w in (cut(x, o - n, o), cut(x, i, i + n)))
            v = cos(taper(a), taper(b))
            if v is not None and round(v, 9) > -0.5:
                rough.append((round(v, 9), o, i))
    rough.sort(key=lambda r: -r[0])
    for _, o, i in rough[:keep]:
        full(o, i)
    f, (_, _, bo, bi) = max(1, step // 8), best
    for o in range(max(o0, bo - f), min(o1, bo + f) + 1):
        for i in range(max(i0, bi - f), min(i1, bi + f) + 1):
            full(o, i)
    return None if best[0] < -0.5 else (best[2], best[3], best[2] - no, best[3] - ni, min(1, max(0, (best[1] + 1) / 2)), best[0])


def signal(rng, n, channels):
    t = np.arange(n)
    beat = np.exp(-(t % 97) / 12.0)
    return [(np.sin(t / 5.0 + c) * beat + 0.2 * rng.normal(size=n)).round(4).tolist() for c in range(channels)]


def rows(track, x):
    return [(track, c, i, v) for c, xs in enumerate(x) for i, v in enumerate(xs)]


def same(got, want):
    assert (got[0] is None) == (want is None), (got, want)
    if want:
        assert all(abs(a - b) < 1e-7 for a, b in zip(got, want)), (got, want)


@pytest.mark.parametrize("channels", [1, 2])
def test_anchor_search_is_the_best_of_all_combinations(spark, channels):
    rng = np.random.default_rng(channels)
    signals = {0: signal(rng, 1500, channels), 1: signal(rng, 420, channels), 2: [[0.0] * 900] * channels}
    at = {k: list(range(20, len(x[0]) - 10, 97)) for k, x in signals.items()}
    d = spark.createDataFrame([r for k, x in signals.items() for r in rows(k, x)], "track long, channel int, i long, x double")
    d = d.drop("channel") if channels == 1 else d
    beats = spark.createDataFrame([(k, b, i) for k, v in at.items() for b, i in enumerate(v)], "track long, beat long, i long")
    asked = [(k, 100 * k + n, int(p), int(c), float(v)) for k, v in at.items() for n, (p, c, v) in enumerate(zip(rng.integers(0, len(v), 12), rng.integers(0, len(v), 12), rng.uniform(-0.2, 1.2, 12)))]
    s = spark.createDataFrame(asked, "track long, splice long, prev_beat long, curr_beat long, vocal double")
    how = dict(search=1, extension=2, least_ms=60.0, local_ms=50.0)
    out = X.anchor_search(s, beats, d, rate=1000, back_ms=90.0, ahead_ms=60.0, **how)
    got = {r.splice: r for r in out.collect()}
    assert len(got) == len(asked)
    some = 0
    for k, n, p, c, v in asked:
        want = search(signals[k], at[k], p, c, v, 1000, 1, 2, 60.0, 50.0, 90, 60)
        same(tuple(got[n])[5:], want)
        some += want is not None
    assert some >= 8


@pytest.mark.parametrize("channels", [1, 2])
def test_refine_splice_is_the_best_of_its_grids(spark, channels):
    rng = np.random.default_rng(10 + channels)
    signals = {0: signal(rng, 1200, channels), 1: signal(rng, 150, channels), 2: [[0.0] * 600] * channels}
    d = spark.createDataFrame([r for k, x in signals.items() for r in rows(k, x)], "track long, channel int, i long, x double")
    d = d.drop("channel") if channels == 1 else d
    asked = []
    for k, x in signals.items():
        for n in range(8):
            succ, target, overlap = int(rng.integers(0, len(x[0]))), int(rng.integers(-30, len(x[0]) + 30)), int(rng.choice([10, 40, 64]))
            asked.append((k, 100 * k + n, succ, target, target + int(rng.integers(20, 200)), overlap))
    s = spark.createDataFrame(asked, "track long, splice long, successor long, target long, beat_end long, overlap long")
    got = {r.splice: r for r in X.refine_splice(s, d, rate=1000, most_ms=20.0, coarse=9, keep=8, back_ms=90.0, ahead_ms=60.0).collect()}
    some = 0
    for k, n, succ, target, end, overlap in asked:
        want = refine(signals[k], succ, target, end, overlap, 1000, 20.0, 9, 8, 90, 60)
        same(tuple(got[n])[6:], want)
        some += want is not None
    assert some >= 4


def test_kernels_agree_on_grids_and_pairs():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(5, 2, 80)), rng.normal(size=(7, 2, 80))
    b[3, 1] = 0.0
    a[2] = 0.0
    o, i = np.arange(5) - 2, np.arange(7)
    grid, sims = W.score_grid(a, b, o, i, 9)
    for p in range(5):
        for q in range(7):
            want, sim = W.pair_score(a[p : p + 1], b[q : q + 1], o[p : p + 1], i[q : q + 1], 9)
            assert abs(grid[p, q] - want[0]) < 1e-12 and abs(sims[p, q] - sim[0]) < 1e-12
            assert abs(sim[0] - similarity(a[p].tolist(), b[q].tolist())) < 1e-9
    assert (W.score_grid(a[..., :12], b[..., :12], o, i, 9)[0] == -1).all()


def test_buffers_of_long_tracks_and_empty_tables(spark):
    n = 3 * X.CHUNK + 5
    d = spark.range(n).selectExpr("0L track", "id i", "double(id) x")
    s = spark.createDataFrame([(0, 1, -4, 9), (0, 2, X.CHUNK - 2, X.CHUNK + 3), (0, 3, 10, n + 50), (0, 4, n + 1, n + 9), (7, 5, 0, 4)], "track long, splice long, lo long, hi long")
    from pyspark.sql import functions as F

    got = {r.splice: r for r in X.buffers(s, d, ["splice"], {"b": (F.col("lo"), F.col("hi"))}).collect()}
    assert got[1].b == [[float(k) for k in range(9)]] and got[1].b_at == 0
    assert got[2].b == [[float(k) for k in range(X.CHUNK - 2, X.CHUNK + 3)]]
    assert len(got[3].b[0]) == n - 10 and got[3].b[0][-1] == n - 1 and not (got[4].b and got[4].b[0]) and got[5].b is None
    none = spark.createDataFrame([], "track long, splice long, successor long, target long, beat_end long, overlap long")
    assert X.refine_splice(none, d, 1000).count() == 0
