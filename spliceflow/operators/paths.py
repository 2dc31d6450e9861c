"""Retargeting: cheapest re-orderings of a track's beats that reach a wanted length.

A path is a few runs of consecutive beats joined by jumps, so the search iterates over jumps, for all runs of the batch (track, run_id)
at once: every round joins the landing states with the jump edges and keeps the cheapest state per (run, landing, length).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut


def path_edges(candidates: DataFrame, downbeats: DataFrame, meter: int = 4, most: int = 32, jumps: DataFrame | None = None, boundaries: DataFrame | None = None) -> DataFrame:
    """(track, i, j, cost): candidates (track, i, j, cost) that leave before a downbeat and land on one (track, beat), at least
    4 * meter beats away, the `most` cheapest per i; besides these, whatever their rank, the candidates for repetition jumps (track, i, j)
    and for landings on segment boundaries (track, beat)."""
    land = downbeats.select("track", F.col("beat").alias("j"))
    leave = downbeats.select("track", (F.col("beat") - 1).alias("i"))
    aligned = candidates.join(land, ["track", "j"], "left_semi").join(leave, ["track", "i"], "left_semi").select("track", "i", "j", "cost")
    far = aligned.where(F.abs(F.col("j") - F.col("i")) >= 4 * meter)
    w = Window.partitionBy("track", "i").orderBy("cost", "j")
    e = far.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r")
    more = [] if jumps is None else [aligned.join(jumps.select("track", "i", "j"), ["track", "i", "j"], "left_semi")]
    more += [] if boundaries is None else [far.join(boundaries.select("track", F.col("beat").alias("j")), ["track", "j"], "left_semi").select("track", "i", "j", "cost")]
    for x in more:
        e = e.unionByName(x)
    return e.distinct() if more else e


def retarget_params(runs: DataFrame, tracks: DataFrame, tolerance: float = 5.0, meter: int = 4, intro: int = 8, outro: int = 4) -> DataFrame:
    """runs (run_id, track, target, edit_length) with the numbers the search needs, from tracks (track, n_beats, duration): target
    clamped to [5, 2.5 * duration]; target_beats (half to even, 2 at least); least and most beats, around it by the tolerance in seconds,
    which shrinks with the target down to 0.4 of it and is 2 s at least (0.5 s where the tolerance asked for is under 2 s); shortening;
    intro and outro beats, scaled down under 0.8 of the duration; least_jumps; cooldown, four bars or less under half the length; jump
    scale 2^((s - 50) / 25)."""
    r = runs.join(tracks, "track").withColumn("target", F.least(F.greatest("target", F.lit(5.0)), 2.5 * F.col("duration")))
    long = lambda c: c.cast("long")
    avg, n = F.col("duration") / F.col("n_beats"), F.col("n_beats")
    r = r.withColumns({"ratio": F.col("target") / F.greatest(F.lit(1.0), "duration"), "target_beats": F.greatest(F.lit(2).cast("long"), long(F.bround(F.col("target") / avg))), "shortening": F.col("target") < F.col("duration")})
    seconds = F.greatest(F.lit(2.0 if tolerance >= 2 else max(0.5, tolerance)), F.lit(tolerance) * F.greatest(F.lit(0.4), F.least(F.lit(1.0), "ratio")))
    slack = F.greatest(F.lit(2 if tolerance >= 2 else 1).cast("long"), long(F.bround(seconds / avg)))
    share = F.col("target_beats") / n
    scaled = lambda beats, floor, least: F.when(F.col("ratio") < 0.8, F.greatest(F.lit(least).cast("long"), long(F.floor(F.lit(float(beats)) * F.greatest(F.lit(floor), F.col("ratio")))))).otherwise(F.lit(beats).cast("long"))
    return r.withColumns({
        "least": F.greatest(F.lit(2).cast("long"), F.col("target_beats") - slack), "most": F.least(3 * n, F.col("target_beats") + slack),
        "intro_beats": scaled(intro, 0.25, 4), "outro_beats": scaled(outro, 0.3, 2), "least_jumps": F.when((share < 0.45) & F.col("shortening"), 1).otherwise(0).cast("long"),
        "cooldown": F.when(share < 0.5, F.greatest(F.lit(1).cast("long"), long(F.floor(8 * share)))).otherwise(F.lit(4).cast("long")) * meter, "scale": F.pow(F.lit(2.0), (F.col("edit_length") - 50) / 25),
    })


def without_blocked(edges: DataFrame, blocked: DataFrame) -> DataFrame:
    """edges of runs (run_id, track, i, j, cost) without the pairs blocked for a run (run_id, i, j)."""
    return edges.join(blocked, ["run_id", "i", "j"], "left_anti")


def retarget_path(runs: DataFrame, edges: DataFrame, steps: DataFrame, jumps: int = 6, base: float = 0.8, backward: float = 4.0) -> DataFrame:
    """(run_id, track, cost, length, cuts: array of (i, j)) of the cheapest path of each run with at most `jumps` jumps.

    runs: run_id, track, n_beats, least, most, cooldown, scale, shortening. edges: run_id, track, i, j, cost. steps: track, i, cost of i to i + 1.
    A path starts at beat 0 and ends at the last beat; a run of beats between jumps is at least `cooldown` long; a jump costs
    base * scale * cost^2, and `backward` more against the order when shortening. The cost of a run is a difference of running sums.

    Between two jumps length - beat does not change: a round takes the cheapest landing so far for every such offset as a running
    minimum over the leaving beats, then joins the edges to these. After the last jump only lengths from least to most count, so of the edges of that
    round each offset takes those that lead there, by ranges of what an edge adds to it. Rounds end early when no state is left. Costs that agree to
    nine digits are equal, whatever the order of their sums; of equals the shorter path is taken, then the one with the first cuts."""
    w = Window.partitionBy("track").orderBy("i")
    sums = steps.select("track", F.col("i"), (F.sum("cost").over(w) - F.col("cost")).alias("p"))
    last = steps.groupBy("track").agg((F.max("i") + 1).alias("i"), F.sum("cost").alias("p"))
    sums = cut(sums.union(last.select("track", "i", "p")))
    none = F.expr("cast(array() as array<struct<i:bigint,j:bigint>>)")
    state = runs.select("run_id", "track", F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("length"), F.lit(0.0).alias("cost"), none.alias("cuts"))
    at = lambda c, p: sums.select("track", F.col("i").alias(c), F.col("p").alias(p))
    e = cut(edges.select("run_id", "track", "i", "j", F.col("cost").alias("e_cost")))
    conf = cut(runs.select("run_id", "n_beats", "least", "most", "cooldown", "scale", "shortening"))
    leave = e.select("run_id", "track", "i").distinct().join(at("i", "pi"), ["track", "i"])
    ranked = lambda cost, *by: F.struct(F.round(cost, 9).alias("k"), *by, cost.alias("cost"))
    done = None
    for k in range(jumps + 1):
        s = state.join(conf, "run_id").join(at("at", "pa"), ["track", "at"])
        tail = s.join(sums.select("track", F.col("i").alias("end"), F.col("p").alias("pe")), "track").where(F.col("end") == F.col("n_beats") - 1)
        tail = tail.withColumns({"total": F.col("length") + F.col("end") - F.col("at") + 1, "cost": F.col("cost") + F.col("pe") - F.col("pa")})
        tail = tail.where((F.col("total") >= F.col("least")) & (F.col("total") <= F.col("most")) & ((F.col("end") - F.col("at") >= F.col("cooldown")) | (F.size("cuts") == 0)))
        tail = tail.select("run_id", "track", "cost", F.col("total").alias("length"), "cuts")
        done = tail if done is None else done.union(tail)
        if k == jumps:
            break
        key, there = ["run_id", "track", "offset"], F.col("offset") + F.col("i") + 1
        land = s.select("run_id", "track", (F.col("length") - F.col("at")).alias("offset"), (F.col("at") + F.col("cooldown")).alias("i"), ranked(F.col("cost") - F.col("pa"), "cuts").alias("b"))
        asked = land.groupBy(key).agg(F.min("i").alias("from")).join(conf, "run_id")
        if k == jumps - 1:
            # offset + n_beats + what the edge adds (i + 1 - j) is the length at the end: ranges as wide as what is allowed, of which two are met
            wide = F.col("most") - F.col("least") + 1
            lowest = F.col("least") - F.col("n_beats") - F.col("offset")
            asked = asked.withColumn("range", F.explode(F.array(F.floor(lowest / wide), F.floor(lowest / wide) + 1)))
            ranges = e.join(conf.select("run_id", "most", "least"), "run_id").select("run_id", "track", "i", "j", "e_cost", F.floor((F.col("i") + 1 - F.col("j")) / wide).alias("range"))
            asked = asked.join(ranges.hint("merge"), ["run_id", "track", "range"]).where((F.col("i") + 1 - F.col("j") >= lowest) & (F.col("i") + 1 - F.col("j") < lowest + wide)).join(at("i", "pi"), ["track", "i"])
            more, on = ["j", "e_cost"], None
        else:
            asked = asked.join(leave, ["run_id", "track"])
            more, on = [], ["run_id", "track", "i"]
        # what is still to come is at least one run of cooldown beats
        asked = asked.where((F.col("i") >= F.col("from")) & (there < F.col("most")) & (there + F.col("cooldown") <= F.col("most")))
        n = land.withColumn("pi", F.lit(None).cast("double")).unionByName(asked.select(*key, "i", "pi", *more), allowMissingColumns=True)
        n = n.withColumn("b", F.min("b").over(Window.partitionBy(key).orderBy("i"))).where("pi is not null")
        n = n.select("run_id", "track", "i", there.alias("length"), (F.col("b.cost") + F.col("pi")).alias("cost"), "b.cuts", *more)
        n = (n.join(e, on) if on else n).join(conf.select("run_id", "n_beats", "scale", "shortening"), "run_id").where(F.col("j") < F.col("n_beats"))
        jump = F.lit(base) * F.col("scale") * F.col("e_cost") * F.col("e_cost") + F.when((F.col("j") < F.col("i")) & F.col("shortening"), F.lit(backward)).otherwise(0.0)
        n = n.withColumn("cost", F.col("cost") + jump).withColumn("cuts", F.concat("cuts", F.array(F.struct("i", "j"))))
        n = n.groupBy("run_id", "track", F.col("j").alias("at"), "length").agg(F.min(ranked(F.col("cost"), "cuts")).alias("b"))
        state = cut(n.select("run_id", "track", "at", "length", "b.cost", "b.cuts"))
        if state.isEmpty():
            break
    best = done.groupBy("run_id", "track").agg(F.min(ranked(F.col("cost"), "length", "cuts")).alias("b"))
    return best.select("run_id", "track", "b.cost", "b.length", "b.cuts")


def search_edges(runs: DataFrame, edges: DataFrame, steps: DataFrame, segments: DataFrame | None = None, alike: DataFrame | None = None, base: float = 0.8, backward: float = 4.0, least_loop: int = 16) -> DataFrame:
    """(run_id, track, i, j, cost, back, tax): what a step from i to j adds in a run, for best_paths.

    edges: run_id, track, i, j, cost. steps: track, i, cost of i to i + 1. segments: track, beat, seg. alike: track, a, b, similarity of
    segments. `back` is the penalty against the order when shortening. The tax of a jump is scale * (base * clip(most / n_beats, 0.15, 1) * cost^2,
    of which a jump at a segment boundary pays a tenth, + max(1, 2 - 2 * most / n_beats) * (1 - similarity) + 3 * (span - 0.7)^2 for
    spans over 0.7 of the track). Jumps against the order span least_loop beats and do not land in the intro; others span the cooldown."""
    r = runs.select("run_id", "n_beats", "most", "cooldown", "intro_beats", "scale", "shortening")
    e = edges.join(r, "run_id")
    i, j, n = F.col("i"), F.col("j"), F.col("n_beats")
    e = e.where((j < n) & (j != i + 1) & F.when(j < i, (i - j >= least_loop) & (j >= F.col("intro_beats"))).otherwise(j - i >= F.col("cooldown")))
    ratio, at_boundary, sim = F.col("most") / n, F.lit(False), F.lit(None).cast("double")
    if segments is not None:
        w = Window.partitionBy("track").orderBy("beat")
        b = segments.select("track", "beat", "seg", F.coalesce(F.col("seg") != F.lag("seg").over(w), F.lit(False)).alias("new"))
        for c in ("i", "j"):
            e = e.join(b.select("track", F.col("beat").alias(c), F.col("seg").alias(f"seg_{c}"), F.col("new").alias(f"new_{c}")), ["track", c], "left")
        at_boundary = F.coalesce(F.col("new_i"), F.lit(False)) | F.coalesce(F.col("new_j"), F.lit(False))
        if alike is not None:
            e = e.join(alike.select("track", F.col("a").alias("seg_i"), F.col("b").alias("seg_j"), F.col("similarity").alias("alike")), ["track", "seg_i", "seg_j"], "left")
            sim = F.col("alike")
    quality = F.lit(base) * F.greatest(F.lit(0.15), F.least(F.lit(1.0), ratio)) * (F.col("cost") * F.col("cost"))
    quality = F.when(at_boundary, quality * F.lit(1.0 - 0.9)).otherwise(quality)
    section = F.when(sim.isNotNull(), F.greatest(F.lit(1.0), 2.0 - ratio * 2.0) * (1.0 - sim)).otherwise(0.0)
    over = (j - i) / n - 0.7
    span = F.when((j > i + 1) & (over > 0), over * over * 3.0).otherwise(0.0)
    back = F.when((j < i) & F.col("shortening"), F.lit(backward)).otherwise(0.0)
    e = e.select("run_id", "track", "i", "j", "cost", back.alias("back"), ((quality + section + span) * F.col("scale")).alias("tax"))
    s = steps.join(r.join(runs.select("run_id", "track"), "run_id").select("run_id", "track", "n_beats"), "track").where(i + 1 < n)
    return e.unionByName(s.select("run_id", "track", "i", (i + 1).alias("j"), "cost", F.lit(0.0).alias("back"), F.lit(0.0).alias("tax")))


def best_paths(runs: DataFrame, searched: DataFrame, most_jumps: int = 6, worst_weight: float = 8.0, nudge: float = 0.02, duration_weight: float = 3.0) -> DataFrame:
    """(run_id, track, cost, length, end, cuts): the path of each run over the edges of search_edges, by dynamic programming over length
    and beat.

    A path starts at beat 0. The first intro_beats are played in order; after a jump, cooldown beats are; at most most_jumps. A jump pays
    worst_weight for each unit by which its cost is over the worst so far; under half the length a step in order pays nudge * (0.5 - most /
    n_beats). Of the paths to one beat at one length the cheapest goes on, the one from the lowest beat of equals, with its number of
    jumps, its worst jump and its beats since the last one. The end pays by its distance from the outro (or gains inside it) and by its
    length's distance from `most`. A run is one group: its track's beats and edges; runs spread over the cluster."""
    def of(run: dict) -> dict:
        n, most = run["n_beats"], run["most"]
        ratio, beats, outro = most / max(1, n), np.arange(n), run["outro_beats"]
        heavy, ends = max(1.0, 3.0 * (1 - ratio)), np.zeros(n)
        if outro:
            inside = -0.5 * heavy * (1 - (n - 1 - beats) / max(1, outro)) + np.where(beats >= n - 2, -1.0 * heavy, 0.0)
            first = max(0, n - outro)
            ends = np.where(beats >= first, inside, np.minimum((first - beats) * 0.2 * heavy, 8.0))
        lengths = np.abs(np.arange(most + 1) - most) / max(1, most) * duration_weight * max(1.0, 2 - ratio)
        return {"ends": ends, "lengths": lengths, "nudge": nudge * (0.5 - ratio) if ratio < 0.5 else 0.0, "most_jumps": most_jumps, "worst_weight": worst_weight}

    return _solved(runs, searched, ["n_beats", "least", "most", "cooldown", "intro_beats", "outro_beats", "least_jumps"], of)


#: Partitions over which runs are dealt.
SPREAD = 200


def _solved(runs: DataFrame, searched: DataFrame, numbers: list[str], of: Callable[[dict], dict]) -> DataFrame:
    """(run_id, track, cost, length, end, cuts) of the runs that have a path; of: the terms of _search for the numbers of a run."""
    x = searched.join(runs.select("run_id", *numbers), "run_id")
    pair = pa.list_(pa.struct([("i", pa.int64()), ("j", pa.int64())]))

    def solve(key: tuple, t: pa.Table) -> pa.Table:
        run = {c: int(t[c][0].as_py()) for c in numbers}
        got = _search(run, *(t[c].to_numpy() for c in ("i", "j", "cost", "back", "tax")), **of(run))
        n = 0 if got is None else 1
        cost, length, end, cuts = got or (0.0, 0, 0, [])
        made = pa.array([[{"i": a, "j": b} for a, b in cuts]][:n], pair)
        return pa.table({"run_id": t["run_id"][:n], "track": t["track"][:n], "cost": pa.array([cost][:n], pa.float64()), "length": pa.array([length][:n], pa.int64()), "end": pa.array([end][:n], pa.int64()), "cuts": made})

    kinds = dict(searched.dtypes)
    # a run takes much time for few bytes, by which partitions would be put together
    x = x.repartition(SPREAD, "run_id")
    got = x.groupBy("run_id").applyInArrow(solve, f"run_id {kinds['run_id']}, track {kinds['track']}, cost double, length bigint, end bigint, cuts array<struct<i:bigint,j:bigint>>")
    return cut(got)  # few rows that took long, which callers read more than once


def region_edges(runs: DataFrame, candidates: DataFrame, steps: DataFrame, most: int = 8, base: float = 0.8, cap: float = 1.0, backward: float = 0.5) -> DataFrame:
    """(run_id, track, i, j, cost, back, tax), beats counted from the region's entry: what a step adds inside the region of a run (run_id,
    track, entry, exit, extending, scale), for region_paths. candidates: run_id, track, i, j, cost, of the whole track; steps: track, i, cost.
    When extending, a jump against the order costs `backward` more, and so does its rank: the `most` cheapest per beat are tried. The
    tax of a jump is scale * base * min(cap, 2 * cost)."""
    r = runs.select("run_id", "entry", "exit", "extending", "scale")
    inside = lambda c: (F.col(c) >= F.col("entry")) & (F.col(c) < F.col("exit"))
    e = candidates.join(r, "run_id").where(inside("i") & inside("j") & (F.col("j") != F.col("i")) & (F.col("j") != F.col("i") + 1))
    e = e.withColumn("cost", F.col("cost") + F.when((F.col("j") < F.col("i")) & F.col("extending"), F.lit(backward)).otherwise(0.0))
    w = Window.partitionBy("run_id", "i").orderBy("cost", "j")
    e = e.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    zero = F.lit(0.0)
    e = e.select("run_id", "track", (F.col("i") - F.col("entry")).alias("i"), (F.col("j") - F.col("entry")).alias("j"), "cost", zero.alias("back"), (F.col("scale") * F.lit(base) * F.least(F.lit(cap), F.col("cost") * 2.0)).alias("tax"))
    s = steps.join(runs.select("run_id", "track", "entry", "exit"), "track").where(inside("i") & (F.col("i") + 1 < F.col("exit")))
    return e.unionByName(s.select("run_id", "track", (F.col("i") - F.col("entry")).alias("i"), (F.col("i") + 1 - F.col("entry")).alias("j"), "cost", zero.alias("back"), zero.alias("tax")))


def region_paths(runs: DataFrame, searched: DataFrame, cooldown: int = 8, terminal: float = 3.0, duration_weight: float = 3.0) -> DataFrame:
    """(run_id, track, cost, length, end, cuts): the path of each run (run_id, track, entry, exit, least, most, target_beats) inside its region,
    from the entry to near the last beat before the exit. As best_paths, with any number of jumps and no intro lock, worst jump or nudge; an
    end more than one beat before the last pays `terminal` a beat, a length its share of the target beats off."""
    r = runs.select("run_id", "entry", (F.col("exit") - F.col("entry")).alias("n_beats"), "least", "most", "target_beats", F.lit(cooldown).alias("cooldown"), F.lit(0).alias("intro_beats"), F.lit(0).alias("least_jumps"))

    def of(run: dict) -> dict:
        off = run["n_beats"] - 1 - np.arange(run["n_beats"])
        target = run["target_beats"]
        return {"ends": np.where(off > 1, off * terminal, 0.0), "lengths": np.abs(np.arange(run["most"] + 1) - target) / max(1, target) * duration_weight, "nudge": 0.0, "most_jumps": 2**62, "worst_weight": 0.0}

    p = _solved(r, searched, ["n_beats", "least", "most", "target_beats", "cooldown", "intro_beats", "least_jumps"], of).join(r.select("run_id", "entry"), "run_id")
    moved = F.transform("cuts", lambda c: F.struct((c["i"] + F.col("entry")).alias("i"), (c["j"] + F.col("entry")).alias("j")))
    return p.select("run_id", "track", "cost", "length", (F.col("end") + F.col("entry")).alias("end"), moved.alias("cuts"))


#: Ranks of the cheapest jumps to a landing at which _search looks up how many can matter, and sources that it tries in full.
LEVELS, FULL = 2, 8


def _search(run: dict, i: np.ndarray, j: np.ndarray, cost: np.ndarray, back: np.ndarray, tax: np.ndarray, ends: np.ndarray, lengths: np.ndarray, nudge: float, most_jumps: int, worst_weight: float):
    """(cost, length, end, cuts) of one run, or None where there is no path; a step per length, over all beats at once. ends: what ending
    at a beat adds; lengths: what a length adds; nudge: what a step in order adds where a jump is possible.

    Jumps that cannot win are not looked at: those to one landing are sorted by what they add at least, and one from a beat that costs m now can only
    win where that is no more than the step in order costs less m. The few cheapest beats are tried in full, so that m is that of the others.
    Of a length only the landings are kept that a jump won."""
    n, most = run["n_beats"], run["most"]
    step = np.full(n, np.inf)
    plain = j == i + 1
    step[i[plain]] = cost[plain]
    i, j, cost, back, tax = (v[~plain] for v in (i, j, cost, back, tax))
    order = np.lexsort((i, j))
    i, j, cost, back, tax = (v[order] for v in (i, j, cost, back, tax))
    least = cost + back + tax
    cheapest = np.lexsort((least, j))
    least = least[cheapest]
    lands, first = np.unique(j, return_index=True)
    many = np.diff(np.append(first, len(j)))
    group = np.repeat(np.arange(len(lands)), many)
    ranks = LEVELS ** np.arange(1 + int(np.ceil(np.log2(max(1, many.max(initial=1))))))
    levels = np.full((len(lands), len(ranks)), np.inf)  # what the jumps of these ranks (from 0) add at least
    for k, rank in enumerate(ranks):
        there = many > rank
        levels[there, k] = least[first[there] + rank]
    sources, of_source = np.unique(i, return_inverse=True)
    by_source = np.argsort(of_source, kind="stable")
    starts = np.append(0, np.cumsum(np.bincount(of_source, minlength=len(sources))))
    at, since, jumps, worst = np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    at[0], since[0] = 0.0, 999
    whole, dense = np.arange(len(j)), 0  # for how many steps more all jumps are looked at, since most of them could win
    came: list[tuple[np.ndarray, np.ndarray] | None] = [None] * (most + 2)  # landings that a jump won at a length, and the beats it came from
    best = (np.inf, 0, -1)
    for t in range(1, most + 1):
        if t >= run["least"]:
            total = np.where(jumps >= run["least_jumps"], at, np.inf) + ends + lengths[t]
            k = int(np.argmin(total))
            if total[k] < best[0]:
                best = (float(total[k]), t, k)
        if t == most:
            break
        free = (since >= run["cooldown"]) & (t >= run["intro_beats"])
        new = np.full(n, np.inf)
        new[1:] = (at + step)[:-1] + np.where(free, nudge, 0.0)[:-1]
        n_since, n_jumps, n_worst = np.roll(since, 1) + 1, np.roll(jumps, 1), np.roll(worst, 1)
        ready = free & (jumps < most_jumps) & np.isfinite(at)
        now = np.flatnonzero(ready[sources])
        if len(now):
            dense -= 1
            e = whole
            if len(now) <= FULL:
                e = np.sort(np.concatenate([by_source[starts[s] : starts[s + 1]] for s in now]))
            elif dense < 0:
                costs = at[sources[now]]
                m = np.partition(costs, FULL)[FULL]
                reach = new[lands] - m
                reach += 1e-9 * (1 + np.abs(reach))
                # as many as the first of the ranks that is out of reach
                rank = (levels <= reach[:, None]).sum(1)
                upto = np.where(rank > 0, np.minimum(many, ranks[np.minimum(rank, len(ranks) - 1)]), least[first] <= reach)
                upto = np.where(rank >= len(ranks), many, upto)
                if upto.sum() > len(j) // 8:
                    dense = 16
                else:
                    to = np.flatnonzero(upto)
                    size = upto[to]
                    e = cheapest[np.repeat(first[to] - np.append(0, np.cumsum(size))[:-1], size) + np.arange(int(size.sum()))]
                    full = now[np.argpartition(costs, FULL)[:FULL]]
                    e = np.sort(np.concatenate([e, *(by_source[starts[s] : starts[s + 1]] for s in full)]))
                    e = e[ready[i[e]]]
        else:
            e = whole[:0]
        if len(e):
            by, land_of = i[e], group[e]
            w = np.maximum(worst[by], cost[e])
            c = at[by] + cost[e] + back[e] + tax[e] + worst_weight * np.maximum(0.0, w - worst[by])
            c[~ready[by]] = np.inf
            head = first if e is whole else np.flatnonzero(np.append(True, land_of[1:] != land_of[:-1]))
            size = many if e is whole else np.diff(np.append(head, len(e)))
            low = np.minimum.reduceat(c, head)
            pick = np.minimum.reduceat(np.where(c == np.repeat(low, size), np.arange(len(c)), len(c)), head)  # the lowest i of equals
            land = lands[land_of[head]]
            wins = np.isfinite(low) & ((low < new[land]) | ((low == new[land]) & (by[np.minimum(pick, len(c) - 1)] < land - 1)))
            if wins.any():
                to, k = land[wins], pick[wins]
                new[to], n_since[to], n_jumps[to], n_worst[to] = c[k], 0, jumps[by[k]] + 1, w[k]
                came[t + 1] = (to.astype(np.int32), by[k].astype(np.int32))
        at, since, jumps, worst = new, n_since, n_jumps, n_worst
    if best[2] < 0:
        return None
    cuts, k = [], best[2]
    for t in range(best[1], 1, -1):
        jumped = -1
        if came[t] is not None:
            where = int(np.searchsorted(came[t][0], k))
            if where < len(came[t][0]) and came[t][0][where] == k:
                jumped = int(came[t][1][where])
        if jumped >= 0:
            cuts.append((jumped, k))
        k = jumped if jumped >= 0 else k - 1
    return best[0], best[1], best[2], cuts[::-1]


def with_fallback(paths: DataFrame, runs: DataFrame) -> DataFrame:
    """paths, and for runs that have none the first target_beats beats in order, at no cost and without cuts."""
    none = F.expr("cast(array() as array<struct<i:bigint,j:bigint>>)")
    n = F.least("target_beats", "n_beats")
    rest = runs.join(paths, ["run_id", "track"], "left_anti").select("run_id", "track", F.lit(0.0).alias("cost"), n.alias("length"), (n - 1).alias("end"), none.alias("cuts"), F.lit(True).alias("fallback"))
    return paths.withColumn("fallback", F.lit(False)).unionByName(rest if "end" in paths.columns else rest.drop("end"))


def path_steps(paths: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, track, pos, beat): the beats of each path in order. Paths without a column `end` go on to the last beat."""
    p = paths.join(runs.select("run_id", "n_beats"), "run_id")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("cuts", lambda c: c["j"]))
    plain = F.col("end") if "end" in paths.columns else F.when(F.col("fallback"), F.col("length") - 1).otherwise(F.col("n_beats") - 1)
    ends = F.concat(F.transform("cuts", lambda c: c["i"]), F.array(plain))
    beats = F.flatten(F.zip_with(starts, ends, lambda a, b: F.sequence(a, b)))
    return p.select("run_id", "track", F.posexplode(beats).alias("pos", "beat")).withColumn("pos", F.col("pos").cast("long"))


def path_transitions(steps: DataFrame, candidates: DataFrame, meta: list[str] = [], rate: float | None = None) -> DataFrame:
    """(run_id, track, pos, i, j, cost[, lag_seconds][, meta]): steps that are not to the next beat, with the candidate's cost where there is one;
    with a rate its lag (in samples) in seconds, and the columns named in meta as a map of those that are not null."""
    w = Window.partitionBy("run_id").orderBy("pos")
    t = steps.withColumn("j", F.lead("beat").over(w)).where("j is not null and j <> beat + 1").select("run_id", "track", "pos", F.col("beat").alias("i"), "j")
    take = sorted({"cost", *meta, *(["lag"] if rate else [])})
    t = t.join(candidates.select("track", "i", "j", *take), ["track", "i", "j"], "left")
    more = [(F.col("lag") / F.lit(float(rate))).alias("lag_seconds")] if rate else []
    if meta:
        pairs = F.array(*(F.struct(F.lit(m).alias("k"), F.col(m).cast("double").alias("v")) for m in meta))
        more.append(F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull())).alias("meta"))
    return t.select("run_id", "track", "pos", "i", "j", "cost", *more)


def variations(paths: DataFrame, runs: DataFrame, searched: DataFrame, solve: Callable = best_paths, **how) -> DataFrame:
    """(run_id, track, cost, length, end, cuts, variation): the base path and, with each of its jumps blocked in turn, the next best
    ones, all solved (by best_paths, or by region_paths) as one batch of runs; equal paths once, ranked by cost."""
    jumps = paths.select("run_id", F.posexplode("cuts").alias("n", "c")).select("run_id", "n", "c.i", "c.j")
    if "entry" in runs.columns:  # the edges of a region count from its entry
        jumps = jumps.join(runs.select("run_id", "entry"), "run_id").select("run_id", "n", (F.col("i") - F.col("entry")).alias("i"), (F.col("j") - F.col("entry")).alias("j"))
    name = F.concat_ws("#", F.col("run_id"), F.col("n").cast("string"))
    more = runs.join(jumps.select("run_id", "n"), "run_id").withColumn("base", F.col("run_id")).withColumn("run_id", name).drop("n")
    e = searched.join(jumps.select("run_id", "n", F.col("i").alias("bi"), F.col("j").alias("bj")), "run_id").where((F.col("i") != F.col("bi")) | (F.col("j") != F.col("bj")))
    e = e.withColumn("run_id", name).drop("n", "bi", "bj")
    again = solve(more, e, **how).join(more.select("run_id", "base"), "run_id").select(F.col("base").alias("run_id"), "track", "cost", "length", "end", "cuts")
    every = paths.select("run_id", "track", "cost", "length", "end", "cuts").union(again).withColumn("key", F.to_json("cuts")).dropDuplicates(["run_id", "key"])
    w = Window.partitionBy("run_id").orderBy(F.round("cost", 9), "key")
    return every.withColumn("variation", F.row_number().over(w) - 1).drop("key")


def region_bounds(regions: DataFrame, beats: DataFrame, downbeats: DataFrame | None = None, flex: int = 0) -> DataFrame:
    """(run_id, track, entry, exit) of regions (run_id, track, start, end[, entry_override, exit_override]) on beats (track, beat, t).

    Overrides count where both are there, not negative and in order. Else, with downbeats (track, t) and a flex, each end goes to the beat nearest to
    the nearest downbeat within flex mean beats; without such a downbeat the entry is the first beat from the start on, the exit the last
    one up to the end. Else both are the nearest beats. The exit is at least one beat after the entry, and at most the last beat."""
    from .events import snap_nearest

    c, key = F.col, ["run_id", "track"]
    grid = beats.select("track", c("beat").alias("j"), "t")
    side = lambda x: regions.select(*key, c(x).alias("t"))
    near = lambda d: snap_nearest(d, grid).select(*key, c("j").cast("long").alias("j"))
    size = beats.groupBy("track").agg(F.count("*").alias("n"), ((F.max("t") - F.min("t")) / F.greatest(F.count("*") - 1, F.lit(1))).alias("mean"))
    r = regions.join(size, "track")
    if downbeats is None or flex <= 0:
        for x, out in (("start", "entry"), ("end", "exit")):
            r = r.join(near(side(x)).withColumnRenamed("j", out), key)
    else:
        down = downbeats.select("track", "t", F.row_number().over(Window.partitionBy("track").orderBy("t")).cast("long").alias("j"))
        for x, out in (("start", "entry"), ("end", "exit")):
            found = snap_nearest(side(x), down).join(size, "track").where(F.abs(c("grid_t") - c("t")) <= flex * c("mean")).select(*key, c("grid_t").alias("t"))
            # how many beats are before the start, or up to the end: one union, running counts
            u = side(x).withColumn("__b", F.lit(0)).unionByName(grid.select("track", "t").withColumn("__b", F.lit(1)), allowMissingColumns=True)
            at = F.sum("__b").over(Window.partitionBy("track").orderBy("t", "__b" if x == "start" else F.desc("__b")).rowsBetween(Window.unboundedPreceding, 0))
            past = u.withColumn("__k", at).where("__b = 0").select(*key, c("__k").alias("__k") if x == "start" else F.greatest(F.lit(0).cast("long"), c("__k") - 1).alias("__k"))
            r = r.join(near(found).withColumnRenamed("j", out), key, "left").join(past, key).withColumn(out, F.coalesce(out, F.least("__k", c("n") - 1))).drop("__k")
    if {"entry_override", "exit_override"} <= set(regions.columns):
        own = F.coalesce((c("entry_override") >= 0) & (c("exit_override") > c("entry_override")), F.lit(False))
        r = r.withColumns({"entry": F.when(own, c("entry_override")).otherwise(c("entry")), "exit": F.when(own, c("exit_override")).otherwise(c("exit"))})
    return r.select(*key, c("entry").cast("long").alias("entry"), F.greatest(c("entry") + 1, F.least("exit", c("n") - 1)).cast("long").alias("exit"))


def region_loop(bounds: DataFrame, edges: DataFrame, steps: DataFrame, around: int = 1) -> DataFrame:
    """(run_id, track, i, j, times, length, cost): the best repetition of j..i inside [entry, exit) of runs (run_id, track, entry, exit,
    target_beats): repeated N0 - 1, N0 or N0 + 1 times, N0 the number that comes nearest to the target."""
    w = Window.partitionBy("track").orderBy("i")
    sums = steps.select("track", "i", (F.sum("cost").over(w) - F.col("cost")).alias("p"))
    e = edges.where("j < i").join(sums.withColumnRenamed("p", "pi"), ["track", "i"]).join(sums.select("track", F.col("i").alias("j"), F.col("p").alias("pj")), ["track", "j"])
    x = bounds.join(e, "track").where((F.col("j") >= F.col("entry")) & (F.col("i") < F.col("exit")))
    size, plain = F.col("i") - F.col("j") + 1, F.col("exit") - F.col("entry")
    n0 = F.round((F.col("target_beats") - plain) / size)
    x = x.withColumn("times", F.explode(F.transform(F.sequence(F.lit(-around), F.lit(around)), lambda k: (n0 + k).cast("long")))).where("times >= 1")
    x = x.withColumns({"length": plain + F.col("times") * size})
    off = F.abs(F.col("length") - F.col("target_beats")) / F.col("target_beats")
    x = x.withColumn("cost", F.col("times") * (F.col("cost") + F.col("pi") - F.col("pj")) + off)
    b = x.groupBy("run_id", "track").agg(F.min(F.struct(F.round("cost", 9).alias("cost"), "i", "j", "times", "length")).alias("b"))
    return b.select("run_id", "track", "b.i", "b.j", "b.times", "b.length", "b.cost")


def tiled(bounds: DataFrame) -> DataFrame:
    """(run_id, track, pos, beat): the region repeated until target_beats are reached."""
    size = F.col("exit") - F.col("entry")
    return bounds.select("run_id", "track", "entry", size.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("target_beats") - 1)).alias("pos")).select("run_id", "track", "pos", (F.col("entry") + F.col("pos") % F.col("n")).alias("beat"))


def extend_outro(steps: DataFrame, runs: DataFrame, share: float = 0.2) -> DataFrame:
    """steps with up to max(4, share * length) following beats appended to paths that end inside the outro (runs: outro_start)."""
    top = steps.groupBy("run_id", "track").agg(F.max("pos").alias("pos"), F.max_by("beat", "pos").alias("beat")).join(runs.select("run_id", "n_beats", "outro_start"), "run_id").where("beat >= outro_start")
    add = F.least(F.greatest(F.lit(4).cast("long"), F.floor(share * (F.col("pos") + 1))), F.col("n_beats") - 1 - F.col("beat"))
    more = top.where(add > 0).select("run_id", "track", "pos", "beat", F.explode(F.sequence(F.lit(1).cast("long"), add)).alias("k"))
    return steps.select("run_id", "track", "pos", "beat").union(more.select("run_id", "track", F.col("pos") + F.col("k"), F.col("beat") + F.col("k")))



def intro_outro_beats(beats: DataFrame, meter: int = 4, intro: int = 8, outro: int = 4, most_bars: int = 3) -> DataFrame:
    """(track, intro_beats, outro_beats): lengths of the leading run of beats (track, beat, label) labelled intro and of the trailing
    one labelled outro, else the defaults; the outro not over most_bars bars."""
    w = Window.partitionBy("track")
    b = beats.withColumns({"first_other": F.min(F.when(F.col("label") != "intro", F.col("beat"))).over(w), "last_other": F.max(F.when(F.col("label") != "outro", F.col("beat"))).over(w)})
    g = b.groupBy("track").agg(F.count(F.when((F.col("label") == "intro") & (F.col("beat") < F.coalesce("first_other", F.lit(2**62))), 1)).alias("a"), F.count(F.when((F.col("label") == "outro") & (F.col("beat") > F.coalesce("last_other", F.lit(-1))), 1)).alias("z"))
    return g.select("track", F.when(F.col("a") > 0, F.col("a")).otherwise(intro).cast("long").alias("intro_beats"), F.least(F.when(F.col("z") > 0, F.col("z")).otherwise(outro), F.lit(most_bars * meter)).cast("long").alias("outro_beats"))
