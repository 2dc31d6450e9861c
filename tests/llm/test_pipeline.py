"""Every stage of the pipeline against a brute-force version on the smallest tables, and on odd rows."""

import zlib

import corpus_pipeline as P
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_secret_scan import brute_force as secrets_of
from test_sentence_spans import brute_force as without_repeats
from tokenizers import Tokenizer

from spliceflow.llm import quality_fm
from spliceflow.llm.common import documents, fold, stored

STAGES = dict(P.STAGES)


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def groups(rows, words=5):
    """Smallest id of every id's group: links at a Jaccard similarity of 0.8 of five-word sets, over all pairs."""
    sets = {}
    for i, t in rows.items():
        w = "".join(" " if c in "\t\n\x0b\x0c\r" else c.lower() if c.isascii() else c for c in t or "").split(" ")
        w = [x for x in w if x]
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    up = {i: i for i in rows}
    find = lambda x: x if up[x] == x else find(up[x])
    ids = sorted(rows)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            k = len(sets[a] & sets[b]) if sets[a] and sets[b] else 0
            if k and 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: find(i) for i in ids}


@pytest.fixture(scope="module")
def kept(spark, data):
    """The documents after each stage but the last."""
    out, docs = {}, documents(spark, data)
    for name, stage in P.STAGES[:-1]:
        out[name] = docs = stored(stage(spark, docs, data))
        assert docs.columns == documents(spark, data).columns
    return out


def test_quality_keeps_what_the_model_does_not_reject(spark, data, kept):
    docs = documents(spark, data)
    labels = spark.read.parquet(f"{data}/labels.parquet")
    model = quality_fm.train(docs, labels.where(fold() != 0), metadata=["n_chars"])
    scored = quality_fm.score(docs, model, metadata=["n_chars"]).select("doc_id", "score").collect()
    assert set(texts(kept["quality"])) == {r.doc_id for r in scored if r.score >= 0.3}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert len(good & set(texts(kept["quality"]))) >= 0.97 * len(good)


def test_near_dedup_keeps_one_of_each_group(kept):
    before, after = texts(kept["quality"]), texts(kept["near_dedup"])
    assert after == {i: t for i, t in before.items() if groups(before)[i] == i} and 0 < len(after) < len(before)


def test_substring_dedup_removes_repeats(kept):
    before, after = texts(kept["near_dedup"]), texts(kept["substring_dedup"])
    want = without_repeats(list(before.items()))
    assert set(after) == set(before)
    for i, t in after.items():
        assert (t or "").strip() == want.get((i, before[i]), ""), i
    assert any(after[i] != before[i] for i in after)


def test_secrets_are_replaced(kept):
    before, after = texts(kept["substring_dedup"]), texts(kept["secrets"])
    for i, t in before.items():
        out, at = "", 0
        for a, _, b in secrets_of(t or "")[1]:
            if a >= at:
                out += t[at:a] + "[SECRET]"
            at = max(at, b)
        assert after[i] == out + (t or "")[at:], i


def test_packing_holds_every_token_once(spark, data, kept):
    docs = texts(kept["secrets"])
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in docs.items()}
    got = STAGES["packing"](spark, kept["secrets"], data).collect()
    want = sorted((i, k // P.SEQUENCE, k, len(v[k : k + P.SEQUENCE]), zlib.crc32(np.array(v[k : k + P.SEQUENCE], "<u4").tobytes())) for i, v in ids.items() for k in range(0, len(v), P.SEQUENCE))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= P.SEQUENCE
    assert len(seqs) <= -(-sum(map(len, ids.values())) // P.SEQUENCE) + 1


ODD = [(1, None, "en", "s", None), (2, "", None, None, 0), (3, "Same text of one document, twice in the table.", "en", "s", 46), (3, "Same text of one document, twice in the table.", "en", "s", 46), (None, "A row without an id. It stays where it is. Nothing else happens.", "en", "s", 63), (4, "x" * 50000, "en", "s", 50000), (5, "password = abcdefghijklmnop end", "en", "s", 31)]


@pytest.mark.parametrize("name", list(STAGES))
def test_odd_rows_and_empty_tables(spark, data, name):
    schema = documents(spark, data).schema
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long").select(*(F.col(f.name).cast(f.dataType) for f in schema.fields))
    more = docs.withColumns({"score": F.lit("x"), "band": F.lit(1), "start": F.lit("y"), "__cut": F.lit(2)})
    for d in (docs, more):
        out = STAGES[name](spark, d, data)
        if name != "packing":
            assert out.columns == d.columns
        rows = [r.doc_id for r in out.collect()]
        if name in ("substring_dedup", "secrets"):
            assert sorted(map(str, rows)) == sorted(str(r[0]) for r in ODD)
        if name == "near_dedup":
            assert sorted(map(str, rows)) == sorted(map(str, [1, 2, 3, None, 4, 5]))
    assert STAGES[name](spark, docs.limit(0), data).count() == 0
