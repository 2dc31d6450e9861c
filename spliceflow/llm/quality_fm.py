"""Text quality by a factorisation machine.

Features of a text: hashed words (counts scaled to length 1), structure statistics (case, punctuation, digits, lines, word lengths,
repetition), each cut into levels with one indicator per level, and numeric metadata columns in powers of two. The model is
w0 + sum w_j x_j + sum over pairs <v_j, v_l> x_j x_l; the pairs cost linear time, since their sum is half of
sum_f (sum_j v_jf x_j)^2 - sum_j v_jf^2 x_j^2. It is fitted by AdaGrad on a bounded sample of labelled rows (`max_rows`, those
with the smallest hash of their id) and scores all rows.

Defined cases: null text counts as empty and gets the score of its structure alone; null metadata has its own level; rows with a
null label are not learned from. With no labelled rows, every score is 0.5. Repeated rows count as often as they occur.
Extra columns are kept; one named score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import row_bounds, slices, text_buffers, word_hashes

WORD_BITS = 14
LEVELS = 16
_CLASS = np.zeros(256, dtype=np.uint8)  # 0 letters, 1 upper, 2 digit, 3 space, 4 line end, 5 sentence end, 6 other ASCII, 7 beyond ASCII
_CLASS[:] = 6
_CLASS[0x61:0x7B] = 0
_CLASS[0x41:0x5B] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 3
_CLASS[0x0A] = 4
_CLASS[[0x2E, 0x21, 0x3F]] = 5
_CLASS[0x80:] = 7
STATS = 12


def _structure(texts: pa.Array, per_row: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """(rows, STATS) statistics, each from 0 to 1."""
    body, off = text_buffers(texts)
    n = len(off) - 1
    kinds = np.zeros((8, n))
    seen = _CLASS[body]
    for c in range(8):
        total = np.concatenate([[0], np.cumsum(seen == c)])
        kinds[c] = total[off[1:]] - total[off[:-1]]
    size = np.maximum(off[1:] - off[:-1], 1)
    words = np.maximum(per_row, 1)
    alone = np.zeros(n)
    pair = np.concatenate([[0], np.cumsum((body[1:] == body[:-1]) & (seen[1:] >= 5) & (seen[1:] < 7))]) if len(body) > 1 else np.zeros(max(1, len(body)))
    last, first = np.clip(off[1:] - 1, 0, len(pair) - 1), np.clip(off[:-1], 0, len(pair) - 1)
    alone = pair[last] - pair[first]
    logs = np.log2(1 + size) / 24
    return np.stack([
        *(kinds[c] / size for c in (1, 2, 5, 6, 7)), kinds[4] / words, np.minimum(1, size / words / 24), distinct / words,
        np.minimum(1, alone / words), logs, np.minimum(1, np.log2(1 + words) / 20), np.minimum(1, kinds[6] / words),
    ], axis=1)


def features(texts: pa.Array, metadata: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Sparse rows: (row, feature, value), sorted by row, and the number of features."""
    n = len(texts)
    h, rows = word_hashes(texts)
    key = np.sort((rows.astype(np.uint64) << np.uint64(WORD_BITS)) | (h >> np.uint64(64 - WORD_BITS)))
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(at, len(key))).astype(np.float64)
    key = key[at]
    r = (key >> np.uint64(WORD_BITS)).astype(np.int64)
    norm = np.sqrt(np.bincount(r, weights=count**2, minlength=n))
    b = row_bounds(r, n)
    stats = _structure(texts, np.diff(row_bounds(rows, n)), np.diff(b))
    level = np.minimum((np.sqrt(np.clip(stats, 0, 1)) * LEVELS).astype(np.int64), LEVELS - 1)
    base = 1 << WORD_BITS
    more_r, more_j = [np.repeat(np.arange(n), STATS)], [(base + np.arange(STATS) * LEVELS + level).ravel()]
    base += STATS * LEVELS
    for m in metadata:
        with np.errstate(invalid="ignore", divide="ignore"):
            lev = np.where(np.isfinite(m), np.clip(np.log2(1 + np.maximum(m, 0)), 0, 30), 31)
        more_r.append(np.arange(n)), more_j.append(base + lev.astype(np.int64))
        base += 32
    row = np.concatenate([r, *more_r])
    col = np.concatenate([(key & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64), *more_j])
    val = np.concatenate([count / norm[r], np.full(sum(map(len, more_r)), 0.5)])
    o = np.argsort(row, kind="stable")
    return row[o], col[o], val[o], base


@dataclass
class FactorisationMachine:
    w0: float
    w: np.ndarray  # (features,)
    v: np.ndarray  # (features, rank)

    def raw(self, row: np.ndarray, col: np.ndarray, val: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(score before the logistic function, sum_j v_jf x_j) of n sparse rows."""
        vx = self.v[col] * val[:, None]
        first = row_bounds(row, n)[:-1]  # every row has features
        s = np.add.reduceat(vx, first, axis=0) if len(row) else np.zeros((n, self.v.shape[1]))
        linear = np.bincount(row, weights=self.w[col] * val, minlength=n)
        square = np.bincount(row, weights=(vx**2).sum(1), minlength=n)
        return self.w0 + linear + 0.5 * ((s**2).sum(1) - square), s


def fit(row: np.ndarray, col: np.ndarray, val: np.ndarray, y: np.ndarray, size: int, rank: int = 4, epochs: int = 6, batch: int = 64, rate: float = 0.1, decay: float = 1e-5, seed: int = 3) -> FactorisationMachine:
    rng = np.random.default_rng(seed)
    share = np.clip(y.mean(), 0.01, 0.99) if len(y) else 0.5
    m = FactorisationMachine(float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.02, (size, rank)))
    gw, gv, g0 = np.full(size, 1e-4), np.full((size, rank), 1e-4), 1e-4
    bounds = row_bounds(row, len(y))
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            at = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in pick])
            r = np.repeat(np.arange(len(pick)), [bounds[i + 1] - bounds[i] for i in pick])
            c, x = col[at], val[at].astype(np.float64)
            z, s = m.raw(r, c, x, len(pick))
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / len(pick)
            e = err[r] * x
            js, inv = np.unique(c, return_inverse=True)
            dw = np.bincount(inv, weights=e) + decay * m.w[js]
            dv_each = e[:, None] * (s[r] - m.v[c] * x[:, None])
            dv = np.stack([np.bincount(inv, weights=dv_each[:, f]) for f in range(rank)], axis=1) + decay * m.v[js]
            gw[js] += dw**2
            gv[js] += dv**2
            g0 += err.sum() ** 2
            m.w[js] -= rate * dw / np.sqrt(gw[js])
            m.v[js] -= rate * dv / np.sqrt(gv[js])
            m.w0 -= rate * err.sum() / np.sqrt(g0)
    return m


def _inputs(docs: DataFrame, text: str, metadata: list[str], keep: list) -> DataFrame:
    """The columns to keep, the text unless it is a kept string anyway, and the metadata."""
    meta = [F.col(c).cast("double").alias(f"__m{i}") for i, c in enumerate(metadata)]
    there = any(isinstance(c, str) and c == text for c in keep) and dict(docs.dtypes)[text] == "string"
    return docs.select(*keep, *([] if there else [F.col(text).cast("string").alias("__text")]), *meta)


def _of(batch: pa.RecordBatch, text: str, n_meta: int):
    meta = [batch.column(f"__m{i}").to_numpy(zero_copy_only=False).astype(np.float64) for i in range(n_meta)]
    return features(batch.column(text), meta)


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", metadata: list[str] | None = None, max_rows: int = 8000, **how) -> FactorisationMachine | None:
    """Fit on at most max_rows rows of the labelled documents; None where there are none. Ids with the smallest hashes are taken, and
    of rows that share one, those whose features come first, so both the ids that are broadcast and the rows that come
    to the driver are at most max_rows."""
    metadata = metadata or []
    good = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull()).groupBy(id).agg(F.max(label).cast("double").alias("__y"))
    sample = good.orderBy(F.xxhash64(id), id).limit(max_rows)
    d = _inputs(docs.join(F.broadcast(sample), id), text, metadata, [F.col(id).alias("__id"), "__y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", 4 << 20):
            row, col, val, _ = _of(batch, "__text", len(metadata))
            off = pa.array(row_bounds(row, batch.num_rows).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__y"), pa.ListArray.from_arrays(off, pa.array(col.astype(np.int32))), pa.ListArray.from_arrays(off, pa.array(val.astype(np.float32)))], ["id", "y", "cols", "vals"])

    kind = dict(docs.dtypes)[id]
    got = d.mapInArrow(run, f"id {kind}, y double, cols array<int>, vals array<float>").orderBy(F.xxhash64("id"), "id", "cols", "vals").limit(max_rows).toArrow()
    if got.num_rows == 0:
        return None
    y = got["y"].to_numpy()
    cols, vals = got["cols"].combine_chunks(), got["vals"].combine_chunks().flatten().to_numpy()
    del got  # the driver holds the sample once, as it came: a batch is widened when it is read
    row, cols = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(cols.offsets.to_numpy())), cols.flatten().to_numpy()
    return fit(row, cols, vals, y, (1 << WORD_BITS) + STATS * LEVELS + 32 * len(metadata), **how)


def score(docs: DataFrame, model: FactorisationMachine | None, text: str = "text", metadata: list[str] | None = None, keep: list[str | Column] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with score, the probability of label 1. No shuffle."""
    metadata = metadata or []
    d = _inputs(docs, text, metadata, keep if keep is not None else [c for c in docs.columns if c != "score"])
    names = [c for c in d.columns[: len(d.columns) - len(metadata)] if c != "__text"]
    read = "__text" if "__text" in d.columns else text
    given = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = given.value
        for batch in slices(batches, read, 4 << 20):
            n = batch.num_rows
            if model is None:
                p = np.full(n, 0.5)
            else:
                row, col, val, _ = _of(batch, read, len(metadata))
                p = 1 / (1 + np.exp(-np.clip(model.raw(row, col, val, n)[0], -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(p)], [*names, "score"])

    return d.mapInArrow(run, T.StructType([*d.schema.fields[: len(names)], T.StructField("score", T.DoubleType())]))
