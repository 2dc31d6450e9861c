"""Substring removal against a brute-force version, and rows that share an id or have none."""

import re
from collections import defaultdict

import numpy as np

from spliceflow.llm import sentence_spans as S

SCHEMA = "doc_id long, text string"
LONG = " ".join(f"Passage sentence number {k} has exactly eight words." for k in range(8))


def brute_force(rows):
    """{(id, text): text} by the definition: all runs of all documents in lists, no joins."""

    def units(text):
        cuts = [m.span() for m in re.finditer(r"(?<=[.!?])\s+|\s*\n\s*", text)]
        edges = [0, *(x for c in cuts for x in c), len(text)]
        return [(a, b) for a, b in zip(edges[::2], edges[1::2]) if text[a:b].strip()]

    def spans(text):
        u = units(text)
        words = [text[a:b].lower().split() for a, b in u]
        size = lambda i, j: sum(map(len, words[i:j]))
        n = len(u)
        out = {(i, i + 3) for i in range(n - 2) if size(i, i + 3) >= 12} | {(i, i + 1) for i in range(n) if size(i, i + 1) >= 40}
        for i in range(n):
            out |= {(i, j) for j in range(i + 2, n + 1) if size(i, j) >= 20 and (j == i + 2 or size(i, j - 1) < 20)}
            out |= {(k, i + 1) for k in range(i) if size(k, i + 1) >= 20 and (k == i - 1 or size(k + 1, i + 1) < 20)}
        return [(tuple(map(tuple, words[i:j])), u[i][0], u[j - 1][1]) for i, j in sorted(out)]

    docs = {(i, t) for i, t in rows if t}
    met = defaultdict(set)
    for d in docs:
        for h, a, b in spans(d[1]):
            met[h].add((*d, a))
    # of rows with one id any may come first: the tests below have none with a repeated passage
    first = {h: min(m, key=lambda x: (x[0] is None, x[0] or 0, x[2])) for h, m in met.items()}
    out = {}
    for d in docs:
        gone = np.zeros(len(d[1]), bool)
        for h, a, b in spans(d[1]):
            if first[h] != (*d, a):
                gone[a:b] = True
        out[d] = "".join(c for c, g in zip(d[1], gone) if not g).strip()
    return out


def test_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    words = [f"w{k}" for k in range(400)]
    sentence = lambda n: " ".join(rng.choice(words, n)).capitalize() + "."
    shared = [" ".join(sentence(n) for n in sizes) for sizes in ([30, 5, 5, 5, 5], [5, 5, 5, 5, 30], [10] * 5, [55], [6, 6, 6], [25, 25])]
    rows = [(k, " ".join([sentence(7), *(shared[j] for j in rng.choice(6, 2, replace=False)), sentence(4), shared[k % 6]])) for k in range(40)]
    rows += [(100, None), (101, ""), (102, "One. Two. Three."), (103, sentence(200)), (104, "Line one\nline two\n\n  line three " + shared[2].upper())]
    want = brute_force(rows)
    got = S.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        if not text[r.doc_id]:
            assert r.text == text[r.doc_id]
        elif r.text != text[r.doc_id]:
            assert r.text == want[r.doc_id, text[r.doc_id]], r.doc_id
        else:
            assert r.text.strip() == want[r.doc_id, text[r.doc_id]], r.doc_id


def test_passages_are_covered_from_end_to_end():
    for sizes in ([30, 5, 5, 5, 5], [5, 5, 5, 5, 30], [10] * 5, [55], [6, 6, 6], [25, 30]):
        text = " ".join(" ".join(f"a{k}{j}" for j in range(n)) + "." for k, n in enumerate(sizes))
        covered = set()
        for _, a, b, _ in S.runs(text):
            covered |= set(range(a, b))
        assert all(i in covered or text[i] == " " for i in range(len(text))), sizes


def test_rows_without_an_id_do_not_lose_each_others_cuts(spark):
    other = "A quite unrelated text of its own. It repeats nothing at all. It has to stay as it is."
    got = {r.text for r in S.remove_repeats(spark.createDataFrame([(1, LONG), (None, LONG), (None, other)], SCHEMA)).collect()}
    assert got == {LONG, "", other}


def test_rows_that_share_an_id(spark):
    other = "Complete and unrelated words stay here. Nothing of them is repeated. Not even this last one."
    got = sorted(r.text for r in S.remove_repeats(spark.createDataFrame([(1, LONG), (7, LONG), (7, other), (7, other)], SCHEMA)).collect())
    assert got == sorted([LONG, "", other, other])


def test_rows_equal_in_id_and_text_stay_alike(spark):
    got = [r.text for r in S.remove_repeats(spark.createDataFrame([(3, LONG), (3, LONG)], SCHEMA)).collect()]
    assert got == [LONG, LONG]


def test_a_short_phrase_or_a_single_sentence_is_no_passage(spark):
    rows = [(k, f"Yes. No. Own sentence {k} here. All rights reserved by the owner of this page. Thank you.") for k in range(5)]
    assert sorted(r.text for r in S.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()) == [t for _, t in rows]
