"""Language-model scores by online logistic mixing of hashed-context bit predictors, over the running text.

A text is read as one stream of symbols: its words, A-Z in lower case, with one blank between them, then one end. A symbol is a path
through a binary tree that depends on the symbol before it and the class of the one before that (Huffman codes of the training text's
counts), so that a symbol takes few bits; every bit of every symbol is predicted. Three predictors look at the last 4 and 7 symbols and at the word so far; each
hashes its context and the place in the tree to a slot that holds how often a zero and a one followed in the training text. What a
pair of counts is worth is itself observed: for every state, how often a one followed when the bit in question was left out. The
log-odds are added with weights; which set of weights holds is decided by how well the contexts are known (the gate). The sets are
fitted on all training bits, again left out of the counts; while a text is read, its own correction of the weights is learned
online, after every STEP bits, anew for each SEGMENT symbols. A text's score is the sum over its bits, of which -log2 is the total of
bits, also given per byte.

All that is learned is sums over the training texts, so nothing depends on how Spark deals out the rows, but for the rounding of
sums. Word counts are exact: a word's count comes from a table of the most frequent words (at most `frequent`, a bound on what is
broadcast) or, for all other words, by a join. What comes to the driver has a fixed size: slots, weights, that table.

Defined cases: null text counts as empty: one end. Without training rows all bits have even odds. Repeated rows count as often as they
occur. Rows with a null id or shared ids are scored each on their own. Extra columns are ignored. Long texts are read in
ranges: besides about 20 bytes for each byte of the longest text, memory does not grow with it. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, slices, stored, text_buffers, word_hashes

_U = np.uint64
BLANK, END = 0x20, 0x0A
_SYMBOL = np.arange(256, dtype=np.uint8)
_SYMBOL[0x41:0x5B] += 32
_SYMBOL[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = BLANK
ORDERS = (4, 7)  # and the word so far
SLOT_BITS = 22
K = len(ORDERS) + 1
#: Classes of the symbol before the last: some letters, blank and end, other letters, all else.
_CLASS = np.full(256, 15, dtype=np.int64)
_CLASS[0x61:0x7B] = 14
for _i, _letters in enumerate([bytes([BLANK, END]), *(bytes([c]) for c in b"aeioulnrstdch")]):
    _CLASS[list(_letters)] = _i
PLACES = 16 * 256
OWN_CODES = 512
_FACTOR = np.random.default_rng(11).integers(1, 2**62, K + 1, dtype=np.uint64) * _U(2) + _U(1)
_NODE = np.random.default_rng(12).integers(0, 1 << SLOT_BITS, 256)
#: The last i of eight symbols, the latest in the highest byte.
_LATEST = np.array([0, *((~np.uint64(0)) << _U(64 - 8 * i) for i in range(1, 9))], dtype=np.uint64)
#: A slot holds a state of one byte: a level for its zeros and one for its ones, each the least count of the level.
LEVELS = 16
_LEVEL = np.array([0, 1, 2, 3, 4, 5, 7, 10, 14, 20, 32, 52, 90, 160, 300, 600])
_MIDDLE = np.where(np.arange(LEVELS) < 6, _LEVEL, np.sqrt(_LEVEL * np.append(_LEVEL[1:], 600)))
_ZEROS, _ONES = _MIDDLE[np.arange(LEVELS**2) // LEVELS], _MIDDLE[np.arange(LEVELS**2) % LEVELS]
GATES = 4**K
RANGE, SEGMENT, STEP = 1 << 17, 1024, 96
BLOCK = 1 << 16  # counters that travel together


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all texts, offsets)."""
    body, off = text_buffers(texts)
    s = _SYMBOL[body]
    keep = s != BLANK
    after = np.zeros(len(s), dtype=bool)
    after[1:] = keep[:-1]
    after[off[:-1][off[:-1] < len(s)]] = False  # white space at the start of a text
    at = np.flatnonzero(keep | after)
    cut = np.searchsorted(at, off)
    s = s[at]
    some = cut[1:] > cut[:-1]
    last = cut[1:][some] - 1
    closed = np.zeros(len(some), dtype=bool)
    closed[some] = s[last] == BLANK
    s[cut[1:][closed] - 1] = END
    return np.insert(s, cut[1:][~closed], END), cut + np.concatenate([[0], np.cumsum(~closed)])


def contexts(s: np.ndarray, start: np.ndarray, lo: int, hi: int, place: np.ndarray) -> np.ndarray:
    """(K, hi - lo) slots of the contexts before symbols lo to hi; start: where each text begins; place: from places()."""
    n = hi - lo
    padded = np.concatenate([np.full(max(0, 8 - lo), END, np.uint8), s[max(0, lo - 8) : hi]])
    near = np.lib.stride_tricks.as_strided(padded, (n, 8), (1, 1)).copy().view("<u8").ravel()  # symbols i-8 to i-1
    # symbols of the text before do not count: only the first few of each text are concerned
    begins = start[np.searchsorted(start, lo - 8) : np.searchsorted(start, hi)]
    for nth in range(7, -1, -1):  # of two texts, the later counts
        at = begins + nth - lo
        at = at[(at >= 0) & (at < n)]
        near[at] &= _LATEST[nth]
    out = np.empty((K, n), dtype=np.int64)
    for k, order in enumerate(ORDERS):
        out[k] = (((near >> _U(64 - 8 * order)) + _U(order)) * _FACTOR[k]) >> _U(64 - SLOT_BITS)
    # the word so far, of which the last eight symbols count: in padded, symbol i stands at i - lo + 8
    gap = (padded[: n + 7] == BLANK) | (padded[: n + 7] == END)
    gap[begins[begins > lo - 8] - lo + 7] = True
    at = np.arange(n + 7, dtype=np.int32)
    since = np.minimum(at - np.maximum.accumulate(np.where(gap, at, -1)), 8)[7:]
    # the tree is part of the context: under two symbols the word so far does not tell it
    word = (near & _LATEST.take(since)) * _FACTOR[K - 1]
    word += since.astype(np.uint64) << _U(16)
    word += place.astype(np.uint64) * _FACTOR[K]
    word *= _FACTOR[0]
    out[K - 1] = word >> _U(64 - SLOT_BITS)
    return out


class Code:
    """The bits of a symbol at a place: of each the node of the tree and the value. Every symbol has a tree for what follows it; the
    OWN_CODES most frequent places have their own."""

    def __init__(self, counts: np.ndarray):
        """counts: (PLACES, 256). Where little is known, symbols are as likely as in the whole text; none takes over 40 bits."""
        common = (counts.sum(0) + 1) / (counts.sum() + 256)
        after = counts.reshape(16, 256, 256).sum(0)
        seen = counts.sum(1)
        own = [int(x) for x in np.argsort(-seen, kind="stable")[:OWN_CODES] if seen[x] >= 1000]
        self.which = np.tile(np.arange(256), 16)
        self.which[own] = 256 + np.arange(len(own))
        lengths, flat = [], []
        for c in [*after, *counts[own]]:
            share = c + 4 * common
            paths = _huffman(np.maximum(share / share.sum(), 2.0**-22).tolist())
            lengths += [len(p) for p in paths]
            flat += [x for p in paths for x in p]
        self.length = np.array(lengths)
        self.first = np.cumsum(self.length) - self.length
        node, bit = np.array(flat, dtype=np.int64).T
        self.step = _NODE[node] * 2 + bit

    def bits(self, s: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which symbol, hash of the node * 2 + value) of every bit, and where each symbol's bits begin."""
        key = self.which.take(place)
        key *= 256
        key += s
        n = self.length.take(key)
        begin = np.cumsum(n) - n
        of = np.repeat(np.arange(len(s)), n)
        at = np.arange(len(of))
        at += (self.first.take(key) - begin).take(of)
        return of, self.step.take(at), begin


def _huffman(share: list[float]) -> list[tuple]:
    """(node, bit) of every step to each symbol."""
    heap = [(p, i) for i, p in enumerate(share)]
    heapq.heapify(heap)
    kids, n = {}, 256
    while len(heap) > 1:
        (p, a), (q, b) = heapq.heappop(heap), heapq.heappop(heap)
        kids[n] = (a, b)
        heapq.heappush(heap, (p + q, n))
        n += 1
    paths: list[tuple] = [()] * 256
    todo = [(n - 1, ())]
    while todo:
        v, path = todo.pop()
        if v < 256:
            paths[v] = path
        else:
            todo += [(kid, (*path, (v - 256, bit))) for bit, kid in enumerate(kids[v])]
    return paths


def places(s: np.ndarray, start: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """The place of symbols lo to hi: class of the symbol before the last * 256 + the last; END before a text."""
    last, other = (np.concatenate([np.full(max(0, k - lo), END, np.uint8), s[max(0, lo - k) : max(0, hi - k)]])[: hi - lo] for k in (1, 2))
    begins = start[np.searchsorted(start, lo - 1) : np.searchsorted(start, hi)] - lo
    last[begins[begins >= 0]] = END
    other[begins[begins >= 0]] = END
    after = begins + 1
    other[after[(after >= 0) & (after < hi - lo)]] = END
    out = _CLASS.take(other)
    out *= 256
    out += last
    return out


@dataclass
class Model:
    """code; per predictor its table of states and the log-odds of each state; weights per gate."""

    code: Code
    tables: list[np.ndarray]
    odds: list[np.ndarray]
    weights: np.ndarray = field(default_factory=lambda: np.concatenate([np.full((GATES, K), 0.4), np.zeros((GATES, 1))], axis=1))

    def inputs(self, s: np.ndarray, start: np.ndarray, lo: int, hi: int):
        """Of the bits of symbols lo to hi: the K inputs and room for two more rows, the gate and the value of each; and where each
        symbol's bits begin."""
        place = places(s, start, lo, hi)
        ctx = contexts(s, start, lo, hi, place)
        of, node, begin = self.code.bits(s[lo:hi], place)
        n = len(of)
        bit = (node & 1).astype(np.uint8)
        node >>= 1
        x = np.empty((K + 2, n + STEP), dtype=np.float32)
        x[:, n:] = 0
        gate = np.zeros(n, dtype=np.uint32)
        for k in range(K):
            slot = ctx[k].take(of)
            slot ^= node
            self.odds[k].take(self.tables[k].take(slot), out=x[k, :n], mode="clip")  # with this mode there is no second copy
            gate <<= 2
            gate |= x[k, :n].view(np.uint32) & 3  # see _log_odds
        return x, gate, bit, begin

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        w, at, n = self.weights.astype(np.float32), gate.astype(np.intp), len(gate)
        z = w[:, K].take(at)
        for k in range(K):
            part = w[:, k].take(at)
            part *= x[k, :n]
            z += part
        return z


#: How well a state is known, from 0 to 3.
_KNOWN = np.digitize(_ZEROS + _ONES, [1, 3, 12]).astype(np.uint32)


def _without() -> np.ndarray:
    """The state without the bit itself, at (draw * LEVELS^2 + state) * 2 + bit. One less than the counts of a wide level is mostly of the same
    level: of eight draws the share that counts equal to the level's least have goes a level down."""
    width = np.append(np.diff(_LEVEL), 10**6)
    down = np.arange(8)[:, None] < np.rint(8 / width)[None, :]
    less = np.where(down, np.maximum(np.arange(LEVELS) - 1, 0), np.arange(LEVELS))
    zeros, ones = np.divmod(np.arange(LEVELS**2), LEVELS)
    return np.stack([less[:, zeros] * LEVELS + ones, zeros * LEVELS + less[:, ones]], axis=2).ravel()


_WITHOUT = _without()


def _observed(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(states of the slots, zeros per state, ones per state): every counted bit is seen in the state of its slot without that bit.
    Counts beyond the last level are brought under it in the same proportion, none that occurs becoming 0."""
    c = c.reshape(-1, 2).astype(np.float64)
    top = c.max(1)
    share = np.where(top > _LEVEL[-1], _LEVEL[-1] / np.maximum(top, 1), 1.0)
    level = lambda n: np.maximum(np.searchsorted(_LEVEL, n * share, "right") - 1, n > 0)
    zeros, ones, one = c[:, 0], c[:, 1], share == 1  # one bit less does not show in a proportion
    lz, lo = level(zeros), level(ones)
    seen = lambda a, b, n: np.bincount((a * LEVELS + b)[n > 0], weights=n[n > 0], minlength=LEVELS**2)
    return (lz * LEVELS + lo).astype(np.uint8), seen(level(np.maximum(zeros - one, 0)), lo, zeros), seen(lz, level(np.maximum(ones - one, 0)), ones)


def _log_odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Of every state. Those of few counts are as observed, drawn to their counts where seen rarely; those of many stand for themselves, as
    copies of texts would make them look surer than they are. How well the state is known goes along in the two lowest bits of the number."""
    guess = (_ONES + 0.4) / (_ZEROS + _ONES + 0.8)
    p = (ones + 4 * guess) / (ones + zeros + 4)
    odds = np.where(_ZEROS + _ONES >= 24, np.log(guess / (1 - guess)), np.clip(np.log(p / (1 - p)), -9, 9)).astype(np.float32)
    return (odds.view(np.uint32) & ~np.uint32(3) | _KNOWN).view(np.float32)


def _ranges(n: int) -> Iterator[tuple[int, int]]:
    return ((lo, min(lo + RANGE, n)) for lo in range(0, n, RANGE))


def read(docs: DataFrame) -> tuple[np.ndarray, DataFrame]:
    """(symbols after each place, stored counts (kind, h, c), words being kind 0) of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(PLACES * 256, dtype=np.int64)
        made = lambda kind, h, n: pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int8)), pa.array(h), pa.array(n)], ["kind", "h", "n"])
        for batch in slices(batches, "text"):
            s, off = symbols(batch.column("text"))
            for lo, hi in _ranges(len(s)):
                np.add.at(seen, places(s, off[:-1], lo, hi) * 256 + s[lo:hi], np.int64(1))
            h, n = np.unique(word_hashes(batch.column("text"))[0], return_counts=True)
            yield made(0, h.view(np.int64), n.astype(np.int64))
        some = np.flatnonzero(seen)
        yield made(1, some.astype(np.int64), seen[some])

    counts = stored(docs.select("text").mapInArrow(run, "kind byte, h long, n long").groupBy("kind", "h").agg(F.sum("n").alias("c")))
    got = counts.where("kind = 1").select("h", "c").toArrow()  # at most PLACES * 256 rows
    seen = np.zeros(PLACES * 256, dtype=np.int64)
    seen[got["h"].to_numpy()] = got["c"].to_numpy()
    return seen.reshape(PLACES, 256), counts


def _blob(c: np.ndarray) -> bytes:
    """Counters as compressed planes of bytes, of which the upper ones are almost empty."""
    return pa.compress(np.ascontiguousarray(c.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _counters(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, 4 * BLOCK, codec="zstd", asbytes=True), np.uint8).reshape(4, BLOCK)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def _summed(t: pa.Table) -> np.ndarray:
    total = np.zeros(BLOCK, dtype=np.int64)
    for b in t["counts"]:
        total += _counters(b.as_py())
    return total


def count(docs: DataFrame, code: Code) -> Model:
    """The model's tables from all texts. Each task counts for itself and passes on its counters in blocks; these are added
    for 256 tasks at a time, then over all, so no group grows with the input by more than a block for 256 tasks."""
    given = docs.sparkSession.sparkContext.broadcast(code)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, one = [np.zeros(2 << SLOT_BITS, dtype=np.int32) for _ in range(K)], np.int32(1)
        for batch in slices(batches, "text", 1 << 20):
            s, off = symbols(batch.column("text"))
            for lo, hi in _ranges(len(s)):
                place = places(s, off[:-1], lo, hi)
                ctx = contexts(s, off[:-1], lo, hi, place) << 1
                of, step, _ = given.value.bits(s[lo:hi], place)
                for k in range(K):
                    at = ctx[k].take(of)
                    at ^= step
                    np.add.at(counts[k], at, one)
        part = TaskContext.get().partitionId() // 256
        for k in range(K):
            for b, c in enumerate(counts[k].reshape(-1, BLOCK)):
                if c.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([b], pa.int32()), pa.array([part], pa.int32()), pa.array([_blob(c)])], ["k", "b", "part", "counts"])

    def some(key: tuple, t: pa.Table) -> pa.Table:
        return pa.table({"k": t["k"][:1], "b": t["b"][:1], "counts": pa.array([_blob(np.minimum(_summed(t), 2**31 - 1))])})

    def last(key: tuple, t: pa.Table) -> pa.Table:
        table, zeros, ones = _observed(_summed(t))
        return pa.table({"k": t["k"][:1], "b": t["b"][:1], "states": pa.array([table.tobytes()]), "seen": pa.array([np.stack([zeros, ones]).tobytes()])})

    parts = docs.select("text").mapInArrow(run, "k int, b int, part int, counts binary").groupBy("k", "b", "part").applyInArrow(some, "k int, b int, counts binary")
    got = parts.groupBy("k", "b").applyInArrow(last, "k int, b int, states binary, seen binary").toArrow()
    tables, seen = [np.zeros(1 << SLOT_BITS, dtype=np.uint8) for _ in range(K)], np.zeros((K, 2, LEVELS**2))
    for k, b, states, n in zip(*(got[c].to_pylist() for c in ("k", "b", "states", "seen"))):
        tables[k][b * BLOCK // 2 : (b + 1) * BLOCK // 2] = np.frombuffer(states, np.uint8)
        seen[k] += np.frombuffer(n).reshape(2, -1)
    return Model(code, tables, [_log_odds(*seen[k]) for k in range(K)])


def _kinds(odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(kind of every state, log-odds of every kind): how well a state is known, and sixteen levels of its log-odds."""
    level = np.clip(np.rint(odds / 0.75 + 7.5), 0, 15).astype(np.int64)
    kind = _KNOWN.astype(np.int64) * 16 + level
    n = np.bincount(kind, minlength=64)
    return kind, np.bincount(kind, weights=odds, minlength=64) / np.maximum(n, 1)


def fit(docs: DataFrame, model: Model, prior: float = 50.0, rounds: int = 8) -> Model:
    """The model with the gates' weights that fit all bits of all texts best, by Newton's method. For this the states of a predictor fall into
    64 kinds: the bits of all texts are counted by the kinds of their states (the bit itself being left out) and by value, which settles
    every sum that the method needs."""
    kinds, levels = zip(*(_kinds(o) for o in model.odds))
    without = [(k[_WITHOUT] << 6 * (K - 1 - i)) * 2 for i, k in enumerate(kinds)]  # by (draw, state, value)
    given = docs.sparkSession.sparkContext.broadcast((model, without))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, without = given.value
        seen, one = np.zeros(2 << 6 * K, dtype=np.int64), np.int64(1)
        for batch in slices(batches, "text", 1 << 20):
            s, off = symbols(batch.column("text"))
            for lo, hi in _ranges(len(s)):
                place = places(s, off[:-1], lo, hi)
                ctx = contexts(s, off[:-1], lo, hi, place)
                of, node, _ = m.code.bits(s[lo:hi], place)
                bit = node & 1
                node >>= 1
                cell = bit.copy()
                for k in range(K):
                    slot = ctx[k].take(of)
                    slot ^= node
                    at = m.tables[k].take(slot).astype(np.intp)
                    slot &= 7  # the draw
                    slot *= LEVELS**2
                    at += slot
                    at <<= 1
                    at += bit
                    cell += without[k].take(at)
                np.add.at(seen, cell, one)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(seen[some])], ["cell", "n"])

    got = docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most 2 * 64^K rows
    cell, n = got["cell"].to_numpy(), got["n"].to_numpy().astype(np.float64)
    kind = [cell >> 1 + 6 * (K - 1 - k) & 63 for k in range(K)]
    gate, x = np.zeros(len(cell), np.int64), np.ones((len(cell), K + 1))
    for k in range(K):
        gate = gate * 4 + kind[k] // 16
        x[:, k] = levels[k][kind[k]]
    weights = model.weights.copy()
    for g in np.unique(gate):
        at = gate == g
        xg, ng, one = x[at], n[at], cell[at] & 1
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(xg @ weights[g], -12, 12)))
            step = np.linalg.solve((xg * (ng * p * (1 - p))[:, None]).T @ xg + prior * np.eye(K + 1), xg.T @ (ng * (one - p)))
            weights[g] += np.clip(step, -2, 2)
    return Model(model.code, model.tables, model.odds, weights)


def log2_of_texts(model: Model, s: np.ndarray, off: np.ndarray, rate: float = 0.01) -> np.ndarray:
    """log2 probability of each text of the stream: the gate's weights and, for each segment, a correction of its own that follows the
    slope of every STEP bits once they have been predicted."""
    begin = np.concatenate([np.arange(a, b, SEGMENT) for a, b in zip(off[:-1], off[1:])]) if len(off) > 1 else np.zeros(0, np.int64)
    end = np.append(begin[1:], len(s))
    out = np.zeros(len(begin))
    j = 0
    while j < len(begin):
        to = max(j + 1, int(np.searchsorted(end, begin[j] + 2 * RANGE, "right")))
        lo, hi = int(begin[j]), int(end[to - 1])
        x, gate, bit, first = model.inputs(s, off[:-1], lo, hi)
        cut = np.append(first, len(bit))[np.append(begin[j:to], hi) - lo]
        x[K, : len(bit)], x[K + 1, : len(bit)] = model.mixed(x, gate), 1 - 2.0 * bit  # the gate's sum, the value's sign
        runs = np.lib.stride_tricks.sliding_window_view(x, STEP, axis=1)
        size = np.diff(cut)
        order = np.argsort(-size, kind="stable")
        at, size = cut[:-1][order], size[order]
        own, bias = np.zeros((K, len(order), 1), dtype=np.float32), np.zeros((len(order), 1), dtype=np.float32)
        sums, step = np.zeros(len(order)), np.arange(STEP)
        times = np.arange(0, int(size[0]), STEP)
        for t, n in zip(times.tolist(), np.searchsorted(-size, -times, "left").tolist()):  # n segments have bits left
            b = runs[:, at[:n] + t]
            z = np.einsum("knj,knj->nj", np.broadcast_to(own[:, :n], (K, n, STEP)), b[:K])
            z += b[K]
            z += bias[:n]
            np.clip(z, -12, 12, out=z)
            sign = b[K + 1]
            odds = 1 + np.exp(sign * z)  # one over the probability of the value
            slope = (1 / odds - 1) * sign
            lost = np.log(odds)
            if size[n - 1] - t < STEP:
                there = step < size[:n, None] - t
                lost, slope = lost * there, slope * there
            sums[:n] += lost.sum(1)
            own[:, :n, 0] += rate * np.einsum("knj,nj->kn", b[:K], slope)
            bias[:n, 0] += 0.1 * rate * slope.sum(1)
        out[j:to][order] = -sums / np.log(2)
        j = to
    return np.add.reduceat(out, np.searchsorted(begin, off[:-1])) if len(begin) else out


def _frequent(words: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(hashes in order, counts) of the words that occur at least so often (third value) that there are at most `most` of them."""
    grade = F.floor(F.log2("c") * 8)
    hist = words.groupBy(grade.alias("g")).agg(F.count("*").alias("n")).orderBy(F.desc("g")).collect()  # some 500 rows at most
    least, total = float("inf"), 0
    for r in hist:
        total += r.n
        if total > most:
            break
        least = r.g
    got = words.where(grade >= F.lit(least)).select("h", "c").toArrow()
    h, c = got["h"].to_numpy().view(np.uint64), got["c"].to_numpy()
    order = np.argsort(h)
    return h[order], c[order], least


def train(docs: DataFrame, code: Code) -> Model:
    """The bit model of all texts (column `text`)."""
    return fit(docs, count(docs, code))


def score(docs: DataFrame, training: Column, id: str = "doc_id", text: str = "text", frequent: int = 1 << 19) -> DataFrame:
    """(id, training, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row. training: boolean."""
    spark: SparkSession = docs.sparkSession
    d = docs.select(F.col(id).alias("id"), F.coalesce(training, F.lit(False)).alias("training"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    seen = d.where("training")
    after, counts = read(seen)
    words = counts.where("kind = 0").select("h", "c")
    total = words.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    ends = int(after[:, END].sum())
    n_all, v_all = (total.n or 0) + ends, total.v + (ends > 0)
    top_h, top_c, least = _frequent(words, frequent)
    model = train(seen, Code(after))
    given = spark.sparkContext.broadcast((model, top_h, np.append(np.log10(top_c + 0.5), np.log10(0.5))))  # of bounded size
    low, end_base = np.log10(n_all + 0.5 * (v_all + 1)), np.log10(ends + 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known, worth = given.value
        made = TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text", 1 << 20):
            n = batch.num_rows
            s, off = symbols(batch.column("text"))
            bits = -log2_of_texts(m, s, off)
            h, rows = word_hashes(batch.column("text"))
            keys, which = np.unique(h, return_inverse=True)  # in order, so that the search stays in the cache
            at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
            hit = (known[at] == keys)[which] if len(known) else np.zeros(len(h), bool)
            at = at[which]
            base = np.bincount(rows, weights=worth[np.where(hit, at, len(known))], minlength=n)
            tokens = np.bincount(rows, minlength=n) + 1
            rest = np.concatenate([[0], np.cumsum(np.bincount(rows[~hit], minlength=n))]).astype(np.int32)
            _, size = text_buffers(batch.column("text"))
            cols = [
                batch.column("id"), batch.column("training"), pa.array(tokens.astype(np.int64)), pa.array(np.bincount(rows, weights=hit, minlength=n).astype(np.int64) + int(ends > 0)),
                pa.array(base + end_base - tokens * low), pa.array(-bits * np.log10(2)), pa.array(bits / np.maximum(np.diff(size), 1)),
                pa.array(made + np.arange(n), pa.int64()), pa.ListArray.from_arrays(pa.array(rest), pa.array(h[~hit].view(np.int64))),
            ]
            made += n
            yield pa.RecordBatch.from_arrays(cols, ["id", "training", "n_tokens", "known", "base", "score", "bits_per_byte", "place", "rest"])

    kind = dict(d.dtypes)["id"]
    first = stored(d.mapInArrow(run, f"id {kind}, training boolean, n_tokens long, known long, base double, score double, bits_per_byte double, place long, rest array<long>"))
    # counts of the words outside the table; a word of the text that no training text has gains nothing and finds no partner
    asked = first.select("place", F.explode("rest").alias("h")).groupBy("place", "h").agg(F.count("*").alias("n"))
    rare = words.where(F.floor(F.log2("c") * 8) < F.lit(least)) if least < float("inf") else words
    gain = F.col("n") * (F.log10(F.col("c") + 0.5) - F.log10(F.lit(0.5)))
    more = asked.join(rare, "h").groupBy("place").agg(F.sum(gain).alias("gain"), F.sum("n").alias("more"))
    out = first.join(more, "place", "left")
    out = stored(out.select(
        F.col("id").alias(id), "training", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("gain", F.lit(0.0))).alias("base_score"), "score", "bits_per_byte",
    ))
    drop_stored(counts)
    drop_stored(first)
    return out
