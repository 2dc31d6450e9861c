"""Viterbi labels against all label sequences, word scores against single letters, and held-out accuracy."""

import itertools

import numpy as np
import pyarrow as pa

from spliceflow.llm import language_id as L
from spliceflow.llm.common import documents, fold


def test_viterbi_is_the_best_of_all_sequences():
    rng = np.random.default_rng(1)
    rows = np.repeat(np.arange(40), rng.integers(1, 7, 40))
    scores = rng.normal(0, 3, (len(rows), 3)).astype(np.float32)
    for penalty in (0.5, 3.0, 50.0):
        got = L._viterbi(scores, rows, penalty)
        for r in range(40):
            at = np.flatnonzero(rows == r)
            value = lambda seq: sum(scores[i, k] for i, k in zip(at, seq)) - penalty * sum(a != b for a, b in zip(seq, seq[1:]))
            best = max(value(seq) for seq in itertools.product(range(3), repeat=len(at)))
            assert abs(value(got[at].tolist()) - best) < 1e-3


def test_word_scores_do_not_depend_on_how_words_are_grouped(monkeypatch):
    rng = np.random.default_rng(2)
    model = L.LanguageModel([f"l{k}" for k in range(60)], rng.normal(0, 1, (L.BUCKETS, 60)).astype(np.float32), np.ones((len(L.SCRIPTS), 60), bool), 2.0)
    texts = [" ".join("".join(rng.choice(list("abcdeé"), rng.integers(1, 9))) for _ in range(n)) for n in (1, 40, 30000)]
    together = L._label(model, pa.array(texts), True)
    for k, t in enumerate(texts):
        names, score, spans = L._label(model, pa.array([t]), True)
        assert names[0] == together[0][k] and abs(score[0] - together[1][k]) < 1e-9 and spans[0] == together[2][k]


def test_held_out_accuracy(spark):
    d = documents(spark, "/root/testdata/sf0.01").withColumn("held_out", fold() == 0)
    got = L.predict(d, L.train(d.where("not held_out")), keep=["lang", "held_out"], with_spans=False).where("held_out and lang is not null").collect()
    assert len(got) > 100 and np.mean([r.lang == r.lang_pred for r in got]) > 0.95
