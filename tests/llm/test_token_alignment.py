"""Cross-tokenizer alignment against both libraries on whole texts."""

import hashlib
import random
from collections import Counter

import public_tokenizers as P
from pyspark.sql import functions as F

from spliceflow.llm import queries
from spliceflow.llm.byte_bpe import byte_chars
from spliceflow.llm.token_alignment import aligner, measures, pair_counts, align, distinct_texts

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def _whole(texts):
    """Groups of each text as lists of (A ids, B ids), from the libraries on the whole text; None without tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    back = {c: n for n, c in enumerate(byte_chars())}
    out = []
    for t in texts:
        if not t:
            out.append(None)
            continue
        raw = (" " + t).encode()
        xs, ys = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        bx = [bytes(back[c] for c in a.id_to_token(x)) for x in xs]
        by = [bytes([int(b.id_to_piece(y)[3:5], 16)]) if b.is_byte(y) else b.id_to_piece(y).replace("▁", " ").encode() for y in ys]
        if b"".join(bx) != raw or b"".join(by) != raw:
            out.append(None)
            continue
        ends = [{sum(map(len, v[: n + 1])): n for n in range(len(v))} for v in (bx, by)]
        groups, i, j = [], 0, 0
        for e in sorted(ends[0].keys() & ends[1].keys()):
            groups.append((xs[i : ends[0][e] + 1], ys[j : ends[1][e] + 1]))
            i, j = ends[0][e] + 1, ends[1][e] + 1
        out.append(groups)
    return out


def _expected(texts):
    groups = _whole(texts)
    count = Counter((x[-1], y[-1]) for g in groups if g for x, y in g)
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for g in groups:
        if not g:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x[-1], y[-1]) for x, y in g]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest()))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def test_measures_equal_the_libraries(spark):
    rng = random.Random(3)
    bits = ["a", "the", " ", "  ", "\n", "\n ", " word", "É", "中", "😀", "▁", "<s>", "<0x41>", "<|endoftext|>", "\x00", "\x1c", "\xa0", " 's", "12", "3.5", "\t", "ﬁ", "Ω", "---", "!", "é", "‍"]
    texts = [None, "", " ", "  ", "a", " a", "a ", "x" * 3000, "ab" * 50 + " " * 70 + "c"] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    texts += ["the same text"] * 60 + ["bad ▁ text"] * 60 + [""] * 60
    rows = [(n, t, n) for n, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a long").repartition(5)
    got = {r["doc_id"]: r for r in measures(docs, A, B, digest=F.sha2("groups", 256)).collect()}
    assert len(got) == len(texts)
    for n, want in enumerate(_expected(texts)):
        assert tuple(got[n][c] for c in (*COLUMNS, "groups_digest")) == want, (n, texts[n])


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op13_token_alignment(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for (n, _), want in zip(texts.items(), _expected(list(texts.values()))):
        assert tuple(got[n][c] for c in (*COLUMNS, "groups_sha256")) == want


def test_pairs_stay_below_their_bound(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counts = pair_counts(align(distinct_texts(docs), A, B)).collect()
    both = aligner(A, B)
    assert 0 < len(counts) <= both.most_pairs() < 2_000_000
    for r in counts:
        x, y = both.bytes_a[r["pair"] >> 32], both.bytes_b[r["pair"] & 0xFFFFFFFF]
        assert x.endswith(y) or y.endswith(x)


def test_empty_table_and_rows_without_ids(spark):
    kind = "doc_id long, text string, pairs string, text_2 string"
    assert measures(spark.createDataFrame([], kind), A, B, digest=F.sha2("groups", 256)).count() == 0
    rows = [(None, "one two", "x", "y"), (None, "one two", "x", "y"), (4, None, None, None)]
    got = measures(spark.createDataFrame(rows, kind), A, B, digest=F.col("groups"), keep=["doc_id", "pairs"]).collect()
    assert sorted((str(r["doc_id"]), r["n_links"], r["count_sum"]) for r in got) == [("4", 0, 0), ("None", 2, 4), ("None", 2, 4)]
