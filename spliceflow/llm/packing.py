"""Packing of tokenised documents into sequences by a grouping genetic algorithm.

Documents longer than a sequence are cut into whole sequences and a rest; all other pieces stay whole. The pieces are dealt into shards;
each shard is given to several islands. An individual is a grouping of the shard's pieces into bins; crossover puts whole
well-filled bins of one parent into the other, removes the bins that hold the same pieces, and places the displaced pieces, in
exchange for smaller ones where that fills a bin better, then by best fit; mutation empties the least filled bins. The best of each island migrates: one more population per shard starts
from all islands' best. Last, the badly filled bins of neighbouring shards meet and evolve together. A population stops when it
reaches the least possible number of bins. No result is worse than best-fit decreasing on its shard.

Defined cases: null text counts as empty; an empty document is the end id alone; repeated rows are packed as often as they occur.
The ids are those of the tokenizer, special tokens of a text being ordinary text, then the end id 0.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, row_bounds, slices, stored, text_buffers, word_hashes

_MOST = 2_000_000
#: 1: ASCII letters, 2: marks between which and a letter every token of the tokenizer ends, 0: all other bytes.
_KINDS = np.zeros(256, dtype=np.uint8)
_KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KINDS[list(b",.!?;:()[]")] = 2
_loaded: dict[str, "WordCache"] = {}


class WordCache:
    """Ids of texts, by those of their words: no token reaches over white space or from a letter to a mark. Words are told apart by
    64-bit hashes; new ones are encoded, many at a time; beyond `_MOST` words every second one is forgotten.

    keys: hashes in order; of each the place and number of its ids in `flat`."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.keys, self.place, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Words in order of their keys: they are encoded as one text, and its tokens dealt out by their places."""
        sizes, ids = [], [self.flat]
        for lo in range(0, len(words), 1024):
            some = words[lo : lo + 1024]
            e = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            begin = np.array([x[0] for x in e.offsets], dtype=np.int64)
            sizes.append(np.diff(np.searchsorted(begin, np.cumsum([0, *(len(w) + 1 for w in some)]))))
            ids.append(np.array(e.ids, dtype=np.uint32))
        size = np.concatenate(sizes)
        place = len(self.flat) + np.cumsum(size) - size
        at = np.searchsorted(self.keys, keys)
        self.keys, self.place, self.size = np.insert(self.keys, at, keys), np.insert(self.place, at, place), np.insert(self.size, at, size)
        self.flat = np.concatenate(ids)

    def _forget(self) -> None:
        self.keys, place, self.size = self.keys[::2], self.place[::2], self.size[::2]
        self.flat = self.flat[_runs(place, self.size)]
        self.place = np.cumsum(self.size) - self.size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets)."""
        if len(self.keys) > _MOST:
            self._forget()
        h, rows, start, end = word_hashes(texts, spans=True, kinds=_KINDS)
        keys, first, which = np.unique(h, return_index=True, return_inverse=True)
        new = np.ones(len(keys), dtype=bool)
        if len(self.keys):
            new = self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] != keys
        if new.any():
            body = text_buffers(texts)[0]
            self._learn(keys[new], [body[a:b].tobytes().decode() for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist())])
        at = np.searchsorted(self.keys, keys)
        size = self.size[at][which]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.flat[_runs(self.place[at][which], size)], ends[row_bounds(rows, len(texts))]


def _runs(place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """place, place + 1, ... of every run."""
    return np.arange(int(size.sum())) + np.repeat(place - (np.cumsum(size) - size), size)


def word_cache(path: str) -> WordCache:
    if path not in _loaded:
        _loaded[path] = WordCache(path)
    return _loaded[path]


def best_fit(sizes: list[int], items: list[int], bins: list[list[int]], room: list[int], cap: int) -> None:
    """Put the items, largest first, each into the bin with the least sufficient room; opens bins as needed."""
    free = sorted((r, b) for b, r in enumerate(room) if r > 0)
    for i in sorted(items, key=sizes.__getitem__, reverse=True):
        s = sizes[i]
        at = bisect_left(free, (s, -1))
        if at < len(free):
            r, b = free.pop(at)
            bins[b].append(i)
            room[b] = r - s
        else:
            b = len(bins)
            bins.append([i])
            room.append(cap - s)
        if room[b] > 0:
            insort(free, (room[b], b))


class Population:
    def __init__(self, sizes: list[int], cap: int, seed: int):
        self.sizes, self.cap, self.rng = sizes, cap, np.random.default_rng(seed)
        self.least = max(1, -(-sum(sizes) // cap)) if sizes else 0
        bins: list[list[int]] = []
        best_fit(sizes, list(range(len(sizes))), bins, [], cap)
        self.members = [bins]

    def fitness(self, bins: list[list[int]]) -> tuple[int, float]:
        """Fewer bins first, then the more uneven filling (mean square of the fill)."""
        s = self.sizes
        return -len(bins), sum(sum(s[i] for i in b) ** 2 for b in bins) / (len(bins) or 1)

    def _rebuilt(self, kept: list[list[int]], loose: list[int]) -> list[list[int]]:
        """Bins of the kept ones and the loose pieces: first a loose piece takes the place of one or of two smaller ones where that fills a
        bin better, which leaves smaller pieces to place, then the loose ones are put by best fit."""
        bins = [list(b) for b in kept]
        room = [self.cap - sum(self.sizes[i] for i in b) for b in bins]
        s, free = self.sizes, sorted((self.sizes[i], i) for i in loose)
        for b in np.argsort(room, kind="stable")[::-1].tolist():
            if not free or room[b] == 0:
                continue
            outs = [(i,) for i in bins[b]] + [(i, j) for n, i in enumerate(bins[b][:12]) for j in bins[b][n + 1 : 12]]
            best = (0, None, None)
            for out in outs:
                size = sum(s[i] for i in out)
                at = bisect_left(free, (size + room[b] + 1, -1)) - 1  # the largest loose piece that fits
                if at >= 0 and free[at][0] - size > best[0]:
                    best = (free[at][0] - size, out, at)
            if best[1]:
                gain, out, at = best
                _, new = free.pop(at)
                bins[b] = [i for i in bins[b] if i not in out] + [new]
                room[b] -= gain
                for i in out:
                    insort(free, (s[i], i))
        best_fit(s, [i for _, i in free], bins, room, self.cap)
        return bins

    def cross(self, into: list[list[int]], of: list[list[int]]) -> list[list[int]]:
        """`into` with whole well-filled bins of `of`."""
        s, cap = self.sizes, self.cap
        good = [b for b in of if sum(s[i] for i in b) >= 0.98 * cap] or of
        take = [good[k] for k in self.rng.choice(len(good), max(1, len(good) // 3), replace=False)]
        got = {i for b in take for i in b}
        kept, loose = list(take), []
        for b in into:
            if got.isdisjoint(b):
                kept.append(b)
            else:
                loose += [i for i in b if i not in got]
        return self._rebuilt(kept, loose)

    def mutate(self, bins: list[list[int]], share: float = 0.05) -> list[list[int]]:
        """The least filled bins, and a few others, are emptied and their pieces placed anew, in an order disturbed by chance."""
        s = self.sizes
        fill = np.array([sum(s[i] for i in b) for b in bins]) + self.rng.uniform(0, 0.3 * self.cap, len(bins))
        out = set(np.argsort(fill)[: max(2, int(len(bins) * share))].tolist())
        return self._rebuilt([b for k, b in enumerate(bins) if k not in out], [i for k in out for i in bins[k]])

    def evolve(self, generations: int, size: int = 4) -> list[list[int]]:
        best = max(self.members, key=self.fitness)
        if len(best) <= self.least:
            return best
        while len(self.members) < size:
            self.members.append(self.mutate(self.members[0], 0.3))
        for _ in range(generations):
            self.members.sort(key=self.fitness, reverse=True)
            if len(self.members[0]) <= self.least:
                break
            a, b = self.members[0], self.members[1 + int(self.rng.integers(len(self.members) - 1))]
            self.members[-1] = self.mutate(self.cross(a, b))
            self.members[-2] = self.cross(b, a)
        return max(self.members, key=self.fitness)


def pieces(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", length: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, place) of every piece of every document, and with_ids its ids. place: a number that
    tells pieces apart, the same when a task is repeated on the same rows."""
    d = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = d.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, stop, made = word_cache(tokenizer), np.array([end_id], dtype="<u4").tobytes(), 0
        part = TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text", 4 << 20):
            row, piece, start, size, crc, ids = [], [], [], [], [], []
            flat, off = words.encode(batch.column("text"))
            for r, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
                body = flat[a:b].tobytes() + stop
                for k, at in enumerate(range(0, len(body), 4 * length)):
                    chunk = body[at : at + 4 * length]
                    row.append(r), piece.append(k), start.append(at // 4), size.append(len(chunk) // 4), crc.append(zlib.crc32(chunk))
                    if with_ids:
                        ids.append(np.frombuffer(chunk, dtype="<i4"))
            cols = [batch.column("id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64()), pa.array(part + made + np.arange(len(row)), pa.int64())]
            made += len(row)
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), ["id", "piece", "start", "length", "ids_crc32", "place", *(["ids"] if with_ids else [])])

    return d.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, place long" + (", ids array<int>" if with_ids else ""))


def _out(table: pa.Table, bins: list[list[int]], base: int) -> pa.Table:
    """The rows of the table with seq, offset and fill of their bin."""
    n = table.num_rows
    size = table["length"].to_numpy()
    seq, off, fill = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for b, items in enumerate(bins):
        at = np.array(items)
        ends = np.cumsum(size[at])
        seq[at], off[at], fill[at] = base + b, ends - size[at], ends[-1]
    for c, v in (("seq", seq), ("offset", off), ("fill", fill)):
        table = table.append_column(c, pa.array(v))
    return table


def pack(table: DataFrame, cap: int = 2048, shard_pieces: int = 4096, islands: int = 2, generations: int = 6, meet: int = 16, expected: int | None = None) -> DataFrame:
    """The pieces with sequence_id (long) and offset. expected: about how many pieces there are (counted if not given)."""
    table = stored(table)
    cols = table.columns
    full = table.where(F.col("length") >= cap)
    rest = table.where(F.col("length") < cap)
    shards = max(1, -(-(expected or rest.count()) // shard_pieces))
    rest = rest.withColumn("shard", F.pmod(F.xxhash64("place"), F.lit(shards)))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)

    def island(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("place")
        sizes = t["length"].to_pylist()
        return _out(t, Population(sizes, cap, seed=int(key[1].as_py())).evolve(generations), 0)

    spread = rest.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    elites = spread.groupBy("shard", "island").applyInArrow(island, f"{ddl}, island int, seq long, offset long, fill long")

    def migrated(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("island", "ascending"), ("place", "ascending")])
        which = t["island"].to_numpy()
        seqs = t["seq"].to_numpy()
        t = t.filter(pa.array(which == which[0])).drop_columns(["island", "seq", "offset", "fill"])
        pop = Population(t["length"].to_pylist(), cap, seed=7)
        for k in np.unique(which):
            mine = seqs[which == k]
            order = np.argsort(mine, kind="stable")
            cuts = np.flatnonzero(np.diff(mine[order])) + 1
            pop.members.append([b.tolist() for b in np.split(order, cuts)])
        return _out(t, pop.evolve(generations), int(key[0].as_py()) << 24)

    packed = stored(elites.groupBy("shard").applyInArrow(migrated, f"{ddl}, seq long, offset long, fill long"))
    poor = F.col("fill") < 0.97 * cap

    def met(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("seq", "ascending"), ("offset", "ascending")])
        seqs = t["seq"].to_numpy()
        t = t.drop_columns(["seq", "offset", "fill"])
        pop = Population(t["length"].to_pylist(), cap, seed=11)
        pop.members.append([b.tolist() for b in np.split(np.arange(len(seqs)), np.flatnonzero(np.diff(seqs)) + 1)])
        return _out(t, pop.evolve(generations), (1 << 61) + (int(key[0].as_py()) << 28))

    group = F.floor(F.col("shard") / meet).alias("group")
    again = packed.where(poor).groupBy(group).applyInArrow(met, f"{ddl}, seq long, offset long, fill long")
    out = packed.where(~poor).union(again).select(*cols, F.col("seq").alias("sequence_id"), "offset")
    alone = full.select(*cols, (-1 - F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out = stored(out.union(alone))
    drop_stored(packed)
    drop_stored(table)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", length: int = 2048, with_ids: bool = False, **how) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of every piece."""
    out = pack(pieces(docs, tokenizer, id, text, length, with_ids=with_ids), cap=length, **how)
    return out.withColumnRenamed("id", id).drop("place")
