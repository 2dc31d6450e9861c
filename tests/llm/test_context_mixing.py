"""The bit model against its definition, bit by bit; sums to one; held-out texts against the unigram base."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spliceflow.llm import context_mixing as C
from spliceflow.llm.common import documents, fold

TEXTS = ["The cat sat.  On the mat\n", "", "   ", "a", " lead and trail \t", "naïve 日本 words", "averyverylongwordofmorethansixteenletters again averyverylongwordofmorethansixteenletters", "x" * 3000 + " end"]


def stream(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return " ".join(words).encode() + b"\n"


def test_symbols():
    s, off = C.symbols(pa.array([*TEXTS, None]))
    assert [s[a:b].tobytes() for a, b in zip(off[:-1], off[1:])] == [stream(t) for t in [*TEXTS, ""]]
    assert C.symbols(pa.array([], pa.string()))[1].tolist() == [0]


def test_contexts_do_not_depend_on_neighbours_or_ranges():
    s, off = C.symbols(pa.array(TEXTS * 2))
    contexts = lambda s, start, lo, hi: np.vstack([C.contexts(s, start, lo, hi, C.places(s, start, lo, hi)), C.places(s, start, lo, hi)])
    whole = contexts(s, off[:-1], 0, len(s))
    for a, b in zip(off[:-1], off[1:]):
        alone = contexts(s[a:b], np.array([0]), 0, b - a)
        assert (alone == whole[:, a:b]).all()
    for lo in range(0, len(s), 7):
        hi = min(lo + 7, len(s))
        assert (contexts(s, off[:-1], lo, hi) == whole[:, lo:hi]).all(), lo


@pytest.fixture(scope="module")
def model(spark):
    rng = np.random.default_rng(2)
    words = ["the", "cat", "sat", "on", "mats", "being", "seen", "größer"]
    rows = [(k, " ".join(rng.choice(words, 60))) for k in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    after, _ = C.read(d)
    return C.train(d, C.Code(after))


def test_probabilities_of_all_continuations_sum_to_one(model):
    for prefix in (b"", b"the cat s", b"the mats on being seen" + b" ztq" * 700):
        head = np.frombuffer(prefix, np.uint8)
        p = C.log2_of_texts(model, head, np.array([0, len(head)]))[0] if prefix else 0.0
        each = [C.log2_of_texts(model, np.append(head, np.uint8(v)), np.array([0, len(head) + 1]))[0] for v in range(256)]
        assert abs(sum(2 ** (np.array(each) - p)) - 1) < 2e-3


def brute_force(model, s, rate=0.01):
    """One text, one bit after the other, from the definition."""
    total, own, grown, done = 0.0, np.zeros(C.K + 1), np.zeros(C.K + 1), 0
    for i, v in enumerate(s.tolist()):
        if i % C.SEGMENT == 0:
            own, grown, done = np.zeros(C.K + 1), np.zeros(C.K + 1), 0
        place = C.places(s[: i + 1], np.array([0]), i, i + 1)
        slots = C.contexts(s[: i + 1], np.array([0]), i, i + 1, place)[:, 0]
        key = int(model.code.which[place[0]]) * 256 + v
        for step in model.code.step[model.code.first[key] : model.code.first[key] + model.code.length[key]].tolist():
            node, bit = step >> 1, step & 1
            states = [int(model.tables[k][slots[k] ^ node]) for k in range(C.K)]
            x = np.array([*(model.odds[k][states[k]] for k in range(C.K)), 1.0])
            gate = 0
            for a in states:
                gate = gate * 4 + sum(C._LEVEL[a // C.LEVELS] + C._LEVEL[a % C.LEVELS] >= n for n in (1, 3, 12))
            z = min(12, max(-12, (model.weights[gate] + own) @ x))
            p = 1 / (1 + math.exp(-z))
            total += math.log2(p if bit else 1 - p)
            grown += (bit - p) * np.array([*x[:-1], 0.1])
            done += 1
            if done % C.STEP == 0:
                own, grown = own + rate * grown, np.zeros(C.K + 1)
    return total


def test_scores_equal_the_bit_by_bit_definition(model):
    texts = ["the cat sat on mats", "zebras quite unseen größer größer", "", "seen " * 400]
    s, off = C.symbols(pa.array(texts))
    got = C.log2_of_texts(model, s, off)
    want = [brute_force(model, s[a:b]) for a, b in zip(off[:-1], off[1:])]
    assert np.allclose(got, want, rtol=1e-4)


def test_counts_and_states():
    c = np.array([0, 0, 3, 1, 100000, 2, 0, 7])
    state, zeros, ones = C._observed(c)
    assert state.tolist() == [0, 3 * C.LEVELS + 1, (C.LEVELS - 1) * C.LEVELS + 1, 6]
    assert {int(k): int(zeros[k]) for k in np.flatnonzero(zeros)} == {2 * C.LEVELS + 1: 3, (C.LEVELS - 1) * C.LEVELS + 1: 100000}
    assert {int(k): int(ones[k]) for k in np.flatnonzero(ones)} == {5: 7, 3 * C.LEVELS: 1, (C.LEVELS - 1) * C.LEVELS + 1: 2}


def test_words_outside_the_table_are_counted_by_the_join(spark, data):
    docs = documents(spark, data)
    few, many = (C.score(docs, fold() != 1, frequent=n).orderBy("doc_id").collect() for n in (50, 1 << 19))
    for a, b in zip(few, many):
        assert a.n_known == b.n_known and abs(a.base_score - b.base_score) < 1e-6


def test_base_and_held_out_score(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    rows = docs.select("doc_id", "text", (fold() != 1).alias("t")).collect()
    got = {r.doc_id: r for r in C.score(docs, fold() != 1).collect()}
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    c = Counter(w for r in rows if r.t for w in tokens(r.text))
    n, v = sum(c.values()), len(c)
    for r in rows:
        w, g = tokens(r.text), got[r.doc_id]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(w), sum(x in c for x in w), n)
        assert abs(g.base_score - sum(math.log10((c.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w)) < 1e-6 * len(w)
    out = [g for g in got.values() if not g.training]
    assert sum(g.score for g in out) > 1.0 * sum(g.base_score for g in out)
