"""Exact top-k search by inner product, with ball trees.

The vectors are dealt into shards of neighbours: each goes to the nearest of a bounded number of pivots (vectors with the smallest hashes
of their ids), and the vectors of a pivot that has too many are dealt into several shards. In each shard a ball tree is built. For a
query q the scores below a node with centre c and radius r are at most q.c + |q| r. A search branches from the root: of two children
the one with the higher bound comes first, and a child is entered only by the queries whose current kth score is not over its bound.
The same bound, for a shard's whole ball, decides where a query goes: first to the shard with the highest bound; its kth score then goes
with it to those other shards whose bound reaches it, where it prunes from the start. Queries travel in blocks, so a task holds one
shard and one block, however many there are of either.

Defined cases: vectors that are null or hold null or non-finite components take no part; neither do rows with a null id. Of rows
with one id, the one whose vector is smallest in array order counts. Vectors of different lengths are not compared. Ties go to
the smaller id. Extra columns are ignored. Scores are exact as long as they fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, stored

LEAF = 64


class BallTree:
    """Nodes: centre, radius, first and last row of the (reordered) points, children (-1: none)."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        centre, radius, self.rows, self.children = [], [], [], []
        queue = [(0, len(x), -1)]
        for lo, hi, up in queue:  # grows while it is read
            rows = self.order[lo:hi]
            pts = x[rows]
            c = pts.mean(0)
            me = len(centre)
            centre.append(c)
            radius.append(float(np.sqrt(((pts - c) ** 2).sum(1).max())))
            self.rows.append((lo, hi))
            self.children.append([])
            if up >= 0:
                self.children[up].append(me)
            if hi - lo <= leaf or radius[-1] == 0:
                continue
            far = pts[((pts - c) ** 2).sum(1).argmax()] - c
            mid = (hi - lo) // 2
            self.order[lo:hi] = rows[np.argpartition(pts @ far, mid)]
            queue += [(lo, lo + mid, me), (lo + mid, hi, me)]
        self.centre, self.radius = np.array(centre), np.array(radius)
        self.length = np.sqrt((self.centre**2).sum(1))

    def bound(self, node: int, q: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores below the node; never under the true ones by rounding."""
        return q @ self.centre[node] + norm * self.radius[node] + 1 + 1e-9 * norm * (self.length[node] + self.radius[node])


class Search:
    """The k best rows of a shard for each query of a block. scored: how many products were computed, of len(x) * len(q)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, kth: np.ndarray, k: int):
        self.exact = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, x.shape[1]) < 2**53
        self.tree = BallTree(x.astype(np.float64))
        self.ids, self.x, self.fx = ids[self.tree.order], x[self.tree.order], x[self.tree.order].astype(np.float64)
        self.qids, self.q, self.fq, self.k = qids, q, q.astype(np.float64), k
        self.norm = np.sqrt((self.fq**2).sum(1))
        self.kth = kth.astype(np.float64)
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(len(q))]  # scores, ids
        self.scored = 0
        alive = np.arange(len(q))
        self.visit(0, alive[self.tree.bound(0, self.fq, self.norm) >= self.kth])

    def visit(self, node: int, alive: np.ndarray) -> None:
        if not len(alive):
            return
        lo, hi = self.tree.rows[node]
        if not self.tree.children[node]:
            self.leaf(lo, hi, alive)
            return
        up = {c: self.tree.bound(c, self.fq[alive], self.norm[alive]) for c in self.tree.children[node]}
        for c in sorted(up, key=lambda c: -up[c].mean()):
            self.visit(c, alive[up[c] >= self.kth[alive]])  # the kth scores have grown since the bounds were taken

    def leaf(self, lo: int, hi: int, alive: np.ndarray) -> None:
        s = (self.fq[alive] @ self.fx[lo:hi].T).astype(np.int64) if self.exact else self.q[alive] @ self.x[lo:hi].T
        self.scored += s.size
        ids = self.ids[lo:hi]
        r, c = np.nonzero((s >= self.kth[alive][:, None]) & (ids != self.qids[alive][:, None]))
        cut = np.searchsorted(r, np.arange(len(alive) + 1))
        for n in np.flatnonzero(np.diff(cut)):
            at = c[cut[n] : cut[n + 1]]
            scores, names = (np.concatenate(z) for z in zip(self.best[alive[n]], (s[n, at], ids[at])))
            order = np.lexsort((names, -scores))[: self.k]
            self.best[alive[n]] = scores[order], names[order]
            if len(order) == self.k:
                self.kth[alive[n]] = max(self.kth[alive[n]], scores[order[-1]])


def _matrix(col: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = col.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1)


def _task(k: int):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        empty = pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
        if not candidates.num_rows or not queries.num_rows:
            return empty
        ids, qids = candidates["id"].to_numpy(), queries["qid"].to_numpy()
        best = Search(ids, _matrix(candidates["v"], len(ids)), qids, _matrix(queries["qv"], len(qids)), queries["kth"].to_numpy(), k).best
        q = np.repeat(qids, [len(s) for s, _ in best])
        return pa.table({"query_id": pa.array(q), "vec_id": pa.array(np.concatenate([i for _, i in best])), "score": pa.array(np.concatenate([s for s, _ in best]))})

    return run


_LOW = -(2**62)


def _sharded(v: DataFrame, n: int, shard_rows: int, most_pivots: int) -> DataFrame:
    """v (id, v, dim) with shard: the nearest pivot and, where a pivot has over shard_rows vectors, a part of it. The pivots, at most
    most_pivots for each length of vectors, are sent to all tasks."""
    order = Window.partitionBy("dim").orderBy(F.xxhash64("id"), "id")
    picked = v.withColumn("r", F.row_number().over(order)).where(F.col("r") <= min(most_pivots, max(1, -(-n // shard_rows)))).select("dim", "id", "v").orderBy("dim", F.xxhash64("id"), "id").toArrow()
    pivots = {}
    for dim in set(picked["dim"].to_pylist()):
        rows = picked.filter(pa.array(picked["dim"].to_numpy() == dim))
        pivots[dim] = _matrix(rows["v"], rows.num_rows).astype(np.float64)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, out = batch.column("dim").to_numpy(), np.zeros(batch.num_rows, np.int64)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                p = pivots[int(dim)]
                x = _matrix(pa.chunked_array([batch.column("v").take(pa.array(at))]), len(at)).astype(np.float64)
                for lo in range(0, len(at), 4096):
                    out[at[lo : lo + 4096]] = ((p**2).sum(1) - 2 * x[lo : lo + 4096] @ p.T).argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), batch.column("dim"), pa.array(out)], ["id", "v", "dim", "pivot"])

    near = stored(v.mapInArrow(nearest, "id long, v array<long>, dim int, pivot long"))
    parts = near.groupBy("dim", "pivot").agg(F.ceil(F.count("*") / shard_rows).alias("parts"))
    return near.join(parts, ["dim", "pivot"]).select("id", "v", "dim", F.struct("pivot", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part")).alias("shard"))


def top_k(vectors: DataFrame, every: int, k: int = 20, id: str = "vec_id", vector: str = "vector", shard_rows: int = 8192, block_rows: int = 4096, most_pivots: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows for every row whose id is divisible by `every`.
    vector: array<long>. shard_rows and block_rows bound what a task holds."""
    v = vectors.where(F.col(id).isNotNull() & F.col(vector).isNotNull()).groupBy(F.col(id).cast("long").alias("id")).agg(F.min(vector).alias("v"))
    v = stored(v.select("id", "v", F.size("v").alias("dim")))
    placed = stored(_sharded(v, v.count(), shard_rows, most_pivots))
    # the ball of every shard: mean of its vectors and largest distance from it
    mean = placed.select("dim", "shard", F.posexplode("v").alias("d", "x")).groupBy("dim", "shard", "d").agg(F.avg("x").alias("x"))
    mean = mean.groupBy("dim", "shard").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda p: p["x"]).alias("centre"))
    gap = F.aggregate(F.zip_with("v", "centre", lambda x, c: (x - c) * (x - c)), F.lit(0.0), lambda a, x: a + x)
    balls = stored(placed.join(mean, ["dim", "shard"]).groupBy("dim", "shard").agg(F.first("centre").alias("centre"), F.sqrt(F.max(gap)).alias("radius")))
    ask = placed.where(F.col("id") % every == 0).select(F.col("id").alias("qid"), F.col("v").alias("qv"), "dim")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    up = dot("qv", "centre") + F.sqrt(dot("qv", F.transform("qv", lambda x: x.cast("double")))) * F.col("radius") * (1 + 1e-9) + 1
    bounds = stored(ask.join(balls, "dim").select("qid", "dim", "shard", up.alias("up")))
    # queries with one best shard make up a block, as they go on to the same shards; too many of them several
    best = bounds.groupBy("qid", "dim").agg(F.max(F.struct("up", "shard")).alias("b")).select("qid", "dim", F.col("b.shard").alias("home"))
    parts = best.groupBy("dim", "home").agg(F.ceil(F.count("*") / block_rows).alias("parts"))
    best = stored(best.join(parts, ["dim", "home"]).select("qid", "home", F.struct("home", F.pmod(F.xxhash64("qid", F.lit(1)), F.col("parts")).alias("part")).alias("block")))

    def search(where: DataFrame) -> DataFrame:
        """where: (qid, shard, block, kth). Only the shards that a block asks for are copied for it."""
        asked = where.join(ask, "qid").select("qid", "qv", "kth", F.col("dim").alias("qdim"), F.col("shard").alias("qshard"), F.col("block").alias("qblock"))
        spread = placed.join(asked.select(F.col("qdim").alias("dim"), F.col("qshard").alias("shard"), F.col("qblock").alias("block")).distinct(), ["dim", "shard"])
        return spread.groupBy("dim", "shard", "block").cogroup(asked.groupBy("qdim", "qshard", "qblock")).applyInArrow(_task(k), "query_id long, vec_id long, score long")

    home = stored(search(best.select("qid", F.col("home").alias("shard"), "block", F.lit(_LOW).cast("long").alias("kth"))))
    reached = home.groupBy("query_id").agg(F.min("score").alias("low"), F.count("*").alias("n")).select(F.col("query_id").alias("qid"), F.when(F.col("n") >= k, F.col("low")).otherwise(F.lit(_LOW)).alias("kth"))
    away = bounds.join(best, "qid").where(F.col("shard") != F.col("home")).join(reached, "qid", "left").withColumn("kth", F.coalesce("kth", F.lit(_LOW))).where(F.col("up") >= F.col("kth"))
    found = home.union(search(away.select("qid", "shard", "block", "kth")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))  # at most k rows per shard that was reached
    out = stored(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    for table in (v, placed, balls, bounds, best, home):
        drop_stored(table)
    return out


def quantised(df: DataFrame, id: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """(id, vector): floor(scale * x) of every component x, without rows that are null or hold null or non-finite components."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(F.col(vector).isNotNull() & F.coalesce(whole, F.lit(False))).select(F.col(id), F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("vector"))
