"""Near-duplicate groups by min-max hashing.

A document is the set of its distinct n-word shingles. Under each of `permutations` hash functions both the smallest and the
largest value are kept, so k evaluations give a signature of 2k values, each of which agrees between two sets with probability
equal to their Jaccard similarity (and the two of one function less than independently, which lowers the variance). The signature
is cut into bands; documents that agree in a band are candidates, and a candidate becomes a link only when the full shingle sets
confirm it. With 64 functions and bands of 4, a pair at similarity 0.8 is missed with probability (1 - 0.8^4)^32 = 5e-8.

Inside a band not all pairs are tried. Rows with equal sets fall together first. Then every member of a band is tested against the
band's smallest member, and components are formed; in bands that still hold several, members that also agree in one of two other
bands are tested against the smallest and the largest of those; last, members outside a band's largest component are tested
against all others of the band, within the join, so that only links come out. No two members of different components that
share a band are left untested.

Defined cases: null or empty texts, and texts without words, have an empty set and link with nothing; a text of fewer than n
words is one shingle. Rows sharing a doc_id are one document. Rows with a null doc_id stay alone unless an equal set has an id.
Repeated rows fall into one group. Extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_stored, mix64, row_bounds, slices, stored, word_hashes
from .graph import components

_U = np.uint64


def _shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, 47-bit shingle hash) of every shingle of the texts, sorted, without repeats."""
    h, rows = word_hashes(texts)
    if not len(h):
        return rows, h
    n = row_bounds(rows, len(texts))
    size = np.diff(n)
    place = np.arange(len(h)) - n[rows]
    s = np.zeros(len(h), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):  # of words k places on, as far as the text goes
            far = np.minimum(np.arange(len(h)) + k, n[rows + 1] - 1)
            there = place + k < size[rows]
            s = mix64(s + np.where(there, h[far], _U(0)) + _U(k + 1))
    full = place <= np.maximum(size[rows] - words, 0)
    rows, s = rows[full], s[full]
    out_r, out_s = [], []
    for lo in range(0, len(texts), 1 << 16):  # 16 bits of row, 47 of hash: one sort of plain integers
        a, b = np.searchsorted(rows, [lo, lo + (1 << 16)])
        key = np.sort(((rows[a:b] - lo).astype(np.uint64) << _U(47)) | (s[a:b] >> _U(17)))
        key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
        out_r.append((key >> _U(47)).astype(np.int64) + lo)
        out_s.append(key & _U((1 << 47) - 1))
    return np.concatenate(out_r), np.concatenate(out_s)


def shingle_sets(docs: DataFrame, text: str = "text", words: int = 2) -> DataFrame:
    """docs with `shingles`: array of the hashes of its distinct shingles, in order."""
    kept = docs.select(*[c for c in docs.columns if c != text], F.col(text).cast("string").alias("__text"))
    names = kept.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            rows, s = _shingles(batch.column("__text"), words)
            off = row_bounds(rows, batch.num_rows).astype(np.int32)
            sets = pa.ListArray.from_arrays(pa.array(off), pa.array(s.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), sets], [*names, "shingles"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields[:-1], T.StructField("shingles", T.ArrayType(T.LongType()))]))


def signatures(docs: DataFrame, text: str = "text", words: int = 2, permutations: int = 64, band: int = 4, seed: int = 7) -> DataFrame:
    """docs without the text, with n_shingles, set_a and set_b (a 128-bit name of the set) and bands (array of hashes)."""
    kept = docs.select(*[c for c in docs.columns if c != text], F.col(text).cast("string").alias("__text"))
    names = kept.columns[:-1]
    mult = np.random.default_rng(seed).integers(1, 2**62, permutations, dtype=np.uint64) * _U(2) + _U(1)
    bands = 2 * permutations // band

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            n = batch.num_rows
            rows, s = _shingles(batch.column("__text"), words)
            bounds = row_bounds(rows, n)
            size = np.diff(bounds)
            some = np.flatnonzero(size)
            first = bounds[:-1][some]
            sig = np.zeros((len(some), 2 * permutations), dtype=np.uint64)
            name = np.zeros((2, n), dtype=np.uint64)
            with np.errstate(over="ignore"):
                x = mix64(s + _U(0x51ED2701))
                if len(some):
                    name[0, some] = np.add.reduceat(x, first)
                    name[1, some] = np.add.reduceat(mix64(x ^ _U(0x2545F4914F6CDD1D)), first)
                    for lo in range(0, len(some), 256):  # a few rows at a time stay in the CPU's cache
                        hi = min(lo + 256, len(some))
                        a, b = first[lo], bounds[some[hi - 1] + 1]
                        part, at = x[a:b], first[lo:hi] - a
                        for i in range(permutations):
                            v = part * mult[i]
                            v ^= v >> _U(29)
                            sig[lo:hi, 2 * i] = np.minimum.reduceat(v, at)
                            sig[lo:hi, 2 * i + 1] = np.maximum.reduceat(v, at)
                keys = np.zeros((len(some), bands), dtype=np.uint64)
                for k in range(band):
                    keys = mix64(keys + sig[:, k::band])  # min and max of a function fall into the same band
                keys = mix64(keys + np.arange(bands, dtype=np.uint64))
            off = np.zeros(n + 1, dtype=np.int32)
            off[1:] = np.cumsum((size > 0) * bands)
            lists = pa.ListArray.from_arrays(pa.array(off), pa.array(keys.ravel().view(np.int64)))
            cols = [pa.array(size.astype(np.int64)), pa.array(name[0].view(np.int64)), pa.array(name[1].view(np.int64)), lists]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *cols], [*names, "n_shingles", "set_a", "set_b", "bands"])

    long = T.LongType()
    extra = [T.StructField("n_shingles", long), T.StructField("set_a", long), T.StructField("set_b", long), T.StructField("bands", T.ArrayType(long))]
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields[:-1], *extra]))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    x = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    x = x.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return x.withColumn("both", both).where(100 * F.col("both") >= percent * (F.size("sa") + F.size("sb") - F.col("both"))).select("a", "b").distinct()


def _merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """The components after further links (a, b): only the graph of components is solved again, and nothing where there are no links."""
    if not links.limit(1).count():
        drop_stored(links)
        return comps
    of = lambda c: comps.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
    x = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    edges = stored(x.select("ca", "cb").distinct())
    solved = components(edges, "ca", "cb")
    up = solved.select(F.col("id").alias("component"), F.col("component").alias("up"))
    new = links.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(comps, "id", "left_anti").select("id", F.col("id").alias("component"))
    out = stored(comps.union(new).join(up, "component", "left").select("id", F.coalesce("up", "component").alias("component")))
    for table in (edges, solved, links, comps):
        drop_stored(table)
    return out


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 2, percent: int = 80, permutations: int = 64, band: int = 4) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of docs."""
    d = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    rows = stored(signatures(d, "text", words, permutations, band))
    n_bands = 2 * permutations // band
    # equal sets first: one representative, the smallest id
    reps = stored(rows.where("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("id").alias("rep"), F.max("n_shingles").alias("n")))
    mine = rows.join(reps.select("set_a", "set_b", F.col("rep").alias("id"), "n"), ["set_a", "set_b", "id"])
    bands = mine.select(F.posexplode("bands").alias("j", "band"), "id", "n", "bands")
    other = lambda k: F.get("bands", (F.col("j") + k) % n_bands)
    bands = bands.select("j", "band", "id", "n", other(n_bands // 4).alias("s1"), other(n_bands // 2).alias("s2"))
    # only bands that two sets share; the smallest member is the hub
    hub = bands.groupBy("band").agg(F.min(F.struct("id", "n")).alias("hub"), F.max("id").alias("top")).where("hub.id <> top")
    shared = stored(bands.join(hub.select("band", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n")), "band"))
    fits = lambda n, m: 100 * F.least(n, m) >= percent * F.greatest(n, m)  # noqa: E731  sets of other sizes can't be that similar
    pairs = shared.where((F.col("id") != F.col("hub")) & fits(F.col("n"), F.col("hub_n"))).select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    ids = shared.select("id").distinct()
    sets = stored(shingle_sets(d.join(ids, "id", "left_semi"), "text", words))
    links = stored(_confirmed(pairs, sets, percent))
    comps = components(links)
    drop_stored(links)
    at = _open(shared, comps)
    drop_stored(shared)
    tests = [_second(at, second, fits) for second in ("s1", "s2")]
    links = stored(_confirmed(tests[0].union(tests[1]).distinct(), sets, percent))
    if links.limit(1).count():
        comps = _merged(comps, links)
        before, at = at, _open(at.drop("component"), comps)
        drop_stored(before)
    else:
        drop_stored(links)
    comps = _merged(comps, stored(_rest(at, sets, rows, fits, percent)))
    of_set = reps.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("id", "n_shingles", "set_a", "set_b").join(of_set, ["set_a", "set_b"], "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")))
    out = stored(out.select(F.col("id").alias(id), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")))
    for table in (rows, reps, sets, at, comps):
        drop_stored(table)
    return out


def _open(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Members, with their component, of the bands that hold more than one component."""
    at = members.join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
    bands = at.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band")
    return stored(at.join(bands, "band", "left_semi").select("j", "band", "id", "n", "s1", "s2", "component"))


def _second(at: DataFrame, second: str, fits) -> DataFrame:
    """Pairs to test of members that agree in a second band too, with the smallest and the largest of these."""
    key = F.struct("id", "n", "component")
    ends = at.groupBy("band", second).agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.min("component").alias("c"), F.max("component").alias("top")).where("c <> top")
    tests = at.join(ends.select("band", second, F.explode(F.array("lo", "hi")).alias("hub")), ["band", second])
    tests = tests.where((F.col("component") != F.col("hub.component")) & fits(F.col("n"), F.col("hub.n")))
    return tests.select(F.greatest("id", "hub.id").alias("a"), F.least("id", "hub.id").alias("b"))


def _rest(at: DataFrame, sets: DataFrame, rows: DataFrame, fits, percent: int) -> DataFrame:
    """Links between the members outside a band's largest component and the other members of the band. A pair is tried in the
    first band that it shares. Bands and shortened sets, 31 bits of every shingle, travel with the members of bands that are still open;
    the pairs that these let through are confirmed on full sets."""
    counts = at.groupBy("band", "component").agg(F.count("*").alias("m"))
    # a large band is dealt out in parts of about 512 members; those outside its main component meet every part
    of = counts.groupBy("band").agg(F.max(F.struct("m", "component")).alias("main"), F.ceil(F.sum("m") / 512).alias("parts"))
    members = at.select("j", "band", "id", "n", "component").join(of.select("band", F.col("main.component").alias("main"), "parts"), "band")
    out = members.where("component <> main").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    members = members.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    short = F.array_distinct(F.transform("shingles", lambda s: s.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")))
    known = sets.select("id", short.alias("short"), F.size("shingles").alias("size"))
    known = known.join(rows.select("id", "bands").where(F.size("bands") > 0).dropDuplicates(["id"]), "id")
    # the sets are joined to the narrow rows, so that they are dealt by band once a side
    x, y = (t.select("j", "band", "part", "id", "n", "component").join(known, "id").alias(name) for t, name in ((out, "x"), (members, "y")))
    c = lambda name: F.col(name)
    # at least the shingles in common: a set's own that fall together when shortened might all be shared
    both = F.size(F.array_intersect(c("x.short"), c("y.short"))) + c("x.size") - F.size(c("x.short"))
    before = F.exists(F.zip_with(F.slice(c("x.bands"), 1, c("x.j")), F.slice(c("y.bands"), 1, c("y.j")), lambda p, q: p == q), lambda e: e)
    link = F.when((c("x.component") == c("y.component")) | ~fits(c("x.n"), c("y.n")), False).when(before, False).otherwise(100 * both >= percent * (c("x.size") + c("y.size") - both))
    pairs = x.join(y, (c("x.band") == c("y.band")) & (c("x.part") == c("y.part")) & link).select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b")).distinct()
    return _confirmed(pairs, sets, percent)
