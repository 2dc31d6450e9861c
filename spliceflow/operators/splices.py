"""Search for the best cuts around a splice. Each splice asks for its own samples, as chunks joined on equality; a kernel scores its choices.

Samples are (track, [channel,] i, x) with i from 0 without gaps. A splice's buffers are of a size that parameters and the
distance of beats set, whatever the track's length; all splices of a corpus are one job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows as W

CHUNK = 4096


def chunks(samples: DataFrame, size: int = CHUNK) -> DataFrame:
    """(track, c, xs): runs of `size` samples, an array for each channel."""
    one = "channel" not in samples.columns
    s = samples.withColumns({"c": F.floor(F.col("i") / size), "channel": F.lit(0) if one else F.col("channel")})
    s = s.groupBy("track", "c", "channel").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("p"))
    s = s.select("track", "c", F.struct("channel", F.transform("p", lambda p: p["x"].cast("double")).alias("xs")).alias("p"))
    return s.groupBy("track", "c").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["xs"]).alias("xs"))


def buffers(asks: DataFrame, samples: DataFrame, key: list[str], spans: dict[str, tuple[Column, Column]], size: int = CHUNK) -> DataFrame:
    """asks (track, key, ...) with, for each span, the samples in [lo, hi) that are there (an array for each channel; null if none) and
    `<name>_at`, the place of the first of them. One join for all spans."""
    zero = F.lit(0).cast("long")
    from_to = [F.struct(F.lit(n).alias("span"), F.greatest(zero, lo.cast("long")).alias("lo"), F.greatest(zero, hi.cast("long")).alias("hi")) for n, (lo, hi) in spans.items()]
    a = asks.select("track", *key, F.explode(F.array(*from_to)).alias("s")).select("track", *key, "s.*").where("hi > lo")
    a = a.withColumn("c", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor((F.col("hi") - 1) / size))))
    got = a.join(chunks(samples, size), ["track", "c"]).groupBy("track", *key, "span", "lo", "hi").agg(F.array_sort(F.collect_list(F.struct("c", "xs"))).alias("p"))
    whole = F.transform(F.sequence(F.lit(0), F.size(F.get("p", F.lit(0))["xs"]) - 1), lambda k: F.flatten(F.transform("p", lambda p: F.get(p["xs"], k))))
    skip = (F.col("lo") - F.get("p", F.lit(0))["c"] * size).cast("int")
    cut = F.transform(whole, lambda x: F.slice(x, skip + 1, (F.col("hi") - F.col("lo")).cast("int")))
    got = got.select("track", *key, "span", "lo", cut.alias("b"))
    of = lambda n, c: F.first(F.when(F.col("span") == n, F.col(c)), ignorenulls=True)
    got = got.groupBy("track", *key).agg(*(x for n in spans for x in (of(n, "b").alias(n), of(n, "lo").alias(f"{n}_at"))))
    return asks.join(got, ["track", *key], "left")


def _lengths(samples: DataFrame) -> DataFrame:
    return samples.groupBy("track").agg((F.max("i") + 1).alias("n_samples"))


def _places(beats: DataFrame, before: int, after: int) -> DataFrame:
    """(track, beat, at): places (track, beat, i) of the beats from `before` ones earlier to `after` ones later, null beyond the ends."""
    w = Window.partitionBy("track").orderBy("beat")
    near = [F.lag("i", -k).over(w) if k < 0 else F.lead("i", k).over(w) for k in range(-before, after + 1)]
    return beats.select("track", "beat", F.array(*(F.col("i") if k == before else x for k, x in enumerate(near))).alias("at"))


def _whole(samples: list | None) -> np.ndarray:
    return np.array([np.asarray(c, dtype=float) for c in samples]) if samples is not None else np.zeros((1, 0))


ANCHOR = "out_anchor_beat long, in_anchor_beat long, in_start_beat long, out_boundary_beat long, anchor_out long, anchor_in long, out_start long, out_cut long, in_start long, in_end long, overlap long, score double, similarity double, near double"


def anchor_search(splices: DataFrame, beats: DataFrame, samples: DataFrame, rate: int, search: int = 1, extension: int = 2, least_ms: float = 120.0, local_ms: float = 120.0, back_ms: float = 70.0, ahead_ms: float = 18.0) -> DataFrame:
    """splices (track, splice, prev_beat, curr_beat, vocal) with the best anchored overlap, null where there is none.

    An anchor is an onset near one of `search` beats before the outgoing beat (or itself), matched with one near the incoming beat or up to `search`
    after it. The overlap reaches from an incoming start of up to `search` beats before the incoming beat to an outgoing boundary of up to
    `extension` beats after the outgoing one, so that windows differ in length; either side of the anchor has `least_ms` at least. The first
    of the best by anchor_quality wins, in the order of outgoing anchor, incoming anchor, start, boundary."""
    extension = max(1, extension)
    to = lambda ms: int(ms * rate / 1000.0)
    back, ahead, least, radius = to(back_ms), to(ahead_ms), round(least_ms * rate / 1000.0), max(16, round(local_ms * rate / 2000.0))
    near = _places(beats, search, max(search, extension))
    # only what an overlap can touch is asked for
    s = splices.join(near.select("track", F.col("beat").alias("prev_beat"), F.col("at").alias("p_at")), ["track", "prev_beat"]).join(near.select("track", F.col("beat").alias("curr_beat"), F.col("at").alias("c_at")), ["track", "curr_beat"])
    s = s.join(_lengths(samples), "track")
    least_of, most_of = lambda c, lo, hi: F.array_min(F.slice(c, lo + 1, hi - lo + 1)), lambda c, lo, hi: F.array_max(F.slice(c, lo + 1, hi - lo + 1))
    start = F.array_min(F.slice("c_at", 1, search + 1))
    pre = most_of("c_at", search, 2 * search) + ahead - start
    post = most_of("p_at", search + 1, search + extension) - least_of("p_at", 0, search) + back
    spans = {"out": (least_of("p_at", 0, search) - back - pre, most_of("p_at", search, search + extension) + ahead), "inc": (F.least(start, F.get("c_at", F.lit(search)) - back), most_of("c_at", search, 2 * search) + ahead + F.coalesce(post, F.lit(0)))}
    asked = buffers(s, samples, ["splice"], spans)
    kept = [f for f in splices.schema.fields if f.name not in ("track", "splice")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                xo, xi = _whole(r.out), _whole(r.inc)
                eo, ei = (np.sqrt((x**2).mean(0)) for x in (xo, xi))
                n, best, won = int(r.n_samples), -1.0, None
                place = lambda at, k: None if at[k] is None or pd.isna(at[k]) else int(at[k])
                for a in range(search + 1):
                    if xo.shape[1] == 0 or xi.shape[1] == 0 or (bo := place(r.p_at, a)) is None:
                        continue
                    ao = W.onset_near(eo, bo, int(r.out_at), back, ahead, n)
                    for b in range(search, 2 * search + 1):
                        if (bi := place(r.c_at, b)) is None:
                            continue
                        ai = W.onset_near(ei, bi, int(r.inc_at), back, ahead, n)
                        for c in range(search + 1):
                            st = place(r.c_at, c)
                            if st is None or ai - st < least:
                                continue
                            for e in range(search + 1, search + extension + 1):
                                cut = place(r.p_at, e)
                                if cut is None or cut - ao < least:
                                    continue
                                before, after = ai - st, cut - ao
                                lo, hi = ao - before, ai + after
                                if before + after < 2 * least or lo < 0 or hi > n:
                                    continue
                                wo, wi = xo[:, lo - int(r.out_at) : cut - int(r.out_at)], xi[:, st - int(r.inc_at) : hi - int(r.inc_at)]
                                q, sim, close = W.anchor_quality(wo, wi, before, float(r.vocal), radius)
                                if round(q, W.DIGITS) > best:
                                    best = round(q, W.DIGITS)
                                    p, k = int(r.prev_beat) - search, int(r.curr_beat) - search
                                    won = (p + a, k + b, k + c, p + e, ao, ai, lo, cut, st, hi, before + after, q, sim, close)
                out.append((r.track, r.splice, *(getattr(r, f.name) for f in kept), *(won or (None,) * 14)))
            yield pd.DataFrame(out, columns=names)

    names = ["track", "splice", *(f.name for f in kept), *(f.split()[0] for f in ANCHOR.split(", "))]
    ddl = ", ".join([f"{n} {t}" for n, t in splices.select("track", "splice", *(f.name for f in kept)).dtypes] + [ANCHOR])
    typed = asked.select("track", "splice", *(f.name for f in kept), "p_at", "c_at", "n_samples", "out", "out_at", "inc", "inc_at")
    return typed.mapInPandas(lambda b: (_nullable(x, ddl) for x in run(b)), ddl)


def _nullable(pdf: pd.DataFrame, ddl: str) -> pd.DataFrame:
    """Long columns with missing values as nullable integers."""
    for part in ddl.split(", "):
        name, kind = part.split(" ", 1)
        if kind in ("long", "bigint"):
            pdf[name] = pdf[name].astype("Int64")
        elif kind == "double":
            pdf[name] = pdf[name].astype("Float64" if pdf[name].isna().any() else float)
    return pdf


REFINED = "out_cut long, in_start long, out_shift long, in_shift long, similarity double, score double"


def refine_splice(splices: DataFrame, samples: DataFrame, rate: int, most_ms: float = 12.0, coarse: int = 64, keep: int = 8, back_ms: float = 70.0, ahead_ms: float = 18.0) -> DataFrame:
    """splices (track, splice, successor, target, beat_end, overlap, in samples) with the best cut of both sides, null where there is none.

    The nominal cut is half an overlap after the onset near the successor, the nominal start half an overlap before the one near the target; both move
    by up to `most_ms`, the cut at most an overlap after the successor, the start so that the overlap ends before beat_end. On a coarse grid all
    pairs are compared by the correlation of the tapered sum of channels; the `keep` best of those above -0.5 get the full score, then all
    pairs around the best of them. The first of the best wins, in the order of correlation, then of cut and start."""
    to = lambda ms: int(ms * rate / 1000.0)
    back, ahead, most = to(back_ms), to(ahead_ms), to(most_ms)
    n = F.col("overlap")
    s = splices.join(_lengths(samples), "track")
    reach, half = F.lit(most), F.floor(n / 2)
    near = F.greatest(F.lit(0).cast("long"), F.least(F.col("target"), F.col("n_samples") - 1))
    spans = {
        "out": (F.col("successor") - back - most - n, F.col("successor") + F.greatest(F.lit(ahead), ahead + half + reach)),
        "inc": (near - back - half - reach, near + ahead + reach + n),
    }
    asked = buffers(s, samples, ["splice"], spans)
    kept = [f.name for f in splices.schema.fields if f.name not in ("track", "splice")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                out.append((r.track, r.splice, *(getattr(r, k) for k in kept), *(_refined(_whole(r.out), _whole(r.inc), r, rate, back, ahead, most, coarse, keep) or (None,) * 6)))
            yield _nullable(pd.DataFrame(out, columns=names), ddl)

    names = ["track", "splice", *kept, *(f.split()[0] for f in REFINED.split(", "))]
    ddl = ", ".join([f"{c} {t}" for c, t in splices.select("track", "splice", *kept).dtypes] + [REFINED])
    return asked.select("track", "splice", *kept, "n_samples", "out", "out_at", "inc", "inc_at").mapInPandas(run, ddl)


def _refined(xo: np.ndarray, xi: np.ndarray, r, rate: int, back: int, ahead: int, most: int, coarse: int, keep: int) -> tuple | None:
    n, total = int(r.overlap), int(r.n_samples)
    half = n // 2
    most = min(most, max(half - 1, 0))
    if n <= 16 or most <= 0 or xo.shape[1] == 0 or xi.shape[1] == 0:
        return None
    at_o, at_i = int(r.out_at), int(r.inc_at)
    target = min(total - 1, max(0, int(r.target)))
    cut = W.onset_near(np.sqrt((xo**2).mean(0)), int(r.successor), at_o, back, ahead, total) + half
    start = W.onset_near(np.sqrt((xi**2).mean(0)), target, at_i, back, ahead, total) - half
    outs = max(n, cut - most), min(total, int(r.successor) + n, cut + most)
    ins = max(0, start - most), min(total - n, int(r.beat_end) - n, start + most)
    if outs[0] >= outs[1] or ins[0] >= ins[1]:
        return None
    step = max(1, min(max(4, coarse), most))
    # windows of all cuts and starts are views of the two buffers
    view = lambda x: np.lib.stride_tricks.sliding_window_view(x, n, axis=-1)
    vo, vi = view(xo).swapaxes(0, 1), view(xi).swapaxes(0, 1)
    windows = lambda c, b: (vo[c - n - at_o], vi[b - at_i])
    cuts, starts = np.arange(outs[0], outs[1] + 1, step), np.arange(ins[0], ins[1] + 1, step)
    a, b = windows(cuts, starts)
    rough = np.round(W.correlation_grid(a.sum(1), b.sum(1)), W.DIGITS)
    order = np.argsort(-rough, axis=None, kind="stable")
    order = order[rough.ravel()[order] > -0.5][:keep]
    best, sim, won = -1.0, -1.0, (min(max(cut, outs[0]), outs[1]), min(max(start, ins[0]), ins[1]))
    if len(order):
        p, q = np.unravel_index(order, rough.shape)
        a, b = windows(cuts[p], starts[q])
        score, sims = W.pair_score(a, b, cuts[p] - cut, starts[q] - start, most)
        score = np.round(score, W.DIGITS)
        k = int(score.argmax())
        if score[k] > best:
            best, sim, won = score[k], sims[k], (int(cuts[p[k]]), int(starts[q[k]]))
    fine = max(1, step // 8)
    cuts = np.arange(max(outs[0], won[0] - fine), min(outs[1], won[0] + fine) + 1)
    starts = np.arange(max(ins[0], won[1] - fine), min(ins[1], won[1] + fine) + 1)
    a, b = windows(cuts, starts)
    score, sims = W.score_grid(a, b, cuts - cut, starts - start, most)
    score = np.round(score, W.DIGITS)
    k = int(score.argmax())
    p, q = divmod(k, len(starts))
    if score.flat[k] > best:
        best, sim, won = score.flat[k], sims.flat[k], (int(cuts[p]), int(starts[q]))
    if best < -0.5:
        return None
    return won[0], won[1], won[0] - cut, won[1] - start, min(1.0, max(0.0, (float(sim) + 1.0) * 0.5)), float(best)
