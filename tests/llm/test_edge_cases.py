"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns with clashing names, for every text operator."""

import base64
import hashlib
import zlib

import re

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spliceflow.llm import ball_tree, byte_bpe, context_mixing, graph, language_id, minhash, order_minhash, packing, quality_fm, secret_scan, sentence_spans

LONG = "long words of a text that goes on " * 3000
TEXTS = [(0, None), (1, ""), (2, "   \n\t "), (3, "one"), (3, "one"), (4, "Same text here, twice."), (5, "Same text here, twice."), (None, "no id"), (6, LONG), (7, "naïve Ünïcode — 日本語のテキスト 😀")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, score string, band int, start string"


def docs(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, None if k % 3 else "en", "s", None, "x", "y", 1, "z") for k, (i, t) in enumerate(rows)], SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_language_id(spark):
    d = docs(spark)
    model = language_id.train(docs(spark, [(1, "the cat and the dog " * 20), (2, "x"), (3, "y"), (4, "the house")]))
    got = language_id.predict(d, model).collect()
    assert len(got) == len(TEXTS)
    assert [r.lang_pred for r in got[:3]] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got)
    assert language_id.predict(none(spark), model).count() == 0
    nothing = language_id.train(none(spark))
    assert {r.lang_pred for r in language_id.predict(d, nothing).collect()} == {"und"}


def test_language_spans_of_mixed_text(spark):
    en, gr = "the quick brown fox jumps over the lazy dog and runs away ", "η γρήγορη καφέ αλεπού πηδάει πάνω από τον τεμπέλη σκύλο "
    rows = [(1, en * 10, "en"), (2, gr * 10, "el")]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = language_id.predict(docs(spark, [(1, en * 2 + gr)]), model).first()
    assert [s.lang for s in got.spans] == ["en", "el"] and got.lang_pred == "en"
    assert (en * 2 + gr)[got.spans[1].start : got.spans[1].end] == gr.strip()


def test_minhash_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(300)]
    rows = list(TEXTS)
    for g in range(6):
        base = rng.choice(words, 120).tolist()
        for c in range(8):
            copy = list(base)
            for at in rng.integers(0, 120, rng.integers(0, 12)):
                copy[at] = str(rng.choice(words))
            rows.append((100 + 10 * g + c, " ".join(copy)))
    got = {}
    for r in minhash.near_duplicates(docs(spark, rows), words=2).collect():
        got.setdefault(r.doc_id, []).append(r)
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split(" ") if t and t.strip() else []
        w = [x for x in "".join(c if c not in "\t\n\x0b\x0c\r" else " " for c in (t or "")).lower().split(" ") if x]
        sets[i] = set(zip(w, w[1:])) if len(w) > 1 else ({tuple(w)} if w else set())
    ids = sorted(i for i in sets if i is not None)
    up = {i: i for i in ids}
    find = lambda x: x if up[x] == x else find(up[x])
    for a in ids:
        for b in ids:
            k = len(sets[a] & sets[b])
            if a < b and k and 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    for i in ids:
        assert {r.component_id for r in got[i]} == {find(i)} and {r.kept for r in got[i]} == {find(i) == i}, i
    assert len(got[3]) == 2 and got[None][0].component_id is None
    assert minhash.near_duplicates(none(spark)).count() == 0


def test_order_minhash(spark):
    rows = [r for r in TEXTS if r[0] is not None]
    got = order_minhash.edited_likeness(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    distinct = sorted({(i, t or "") for i, t in rows}, key=lambda x: -x[0])
    nxt = {a: distinct[(k + 1) % len(distinct)][1] for k, (a, _) in enumerate(distinct)}
    text = dict(distinct)
    for r in got:
        t = text[r.doc_id]
        m = len(t) // 3
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256((t[: len(t) - m] + nxt[r.doc_id][:m]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by = {r.doc_id: r for r in got}
    assert by[4].fingerprint == by[5].fingerprint and by[5].near_next == 1.0
    assert order_minhash.edited_likeness(none(spark)).count() == 0
    assert order_minhash.edited_likeness(docs(spark)).count() == len(TEXTS)


def test_order_minhash_feels_order(spark):
    words = [f"word{k}" for k in range(200)]
    swapped = words[100:] + words[:100]
    got = order_minhash.fingerprints(docs(spark, [(1, " ".join(words)), (2, " ".join(swapped)), (3, " ".join(words[:190] + ["new"] + words[190:]))])).orderBy("doc_id").collect()
    like = lambda a, b: np.mean(np.array(a.signature) == np.array(b.signature))
    assert like(got[0], got[2]) > 0.8 > like(got[0], got[1])


PASSAGE = " ".join(f"Sentence number {k} of the passage holds eight words." for k in range(8))


def test_repeated_passage_goes_but_for_the_first(spark):
    rows = [(1, "Own words one. " + PASSAGE + " Own end one."), (2, "Other start two here. " + PASSAGE + " Other end two here."), (3, PASSAGE), (4, "Own words one. Nothing else."), (5, None), (6, "")]
    got = {r.doc_id: r for r in sentence_spans.remove_repeats(docs(spark, rows), count="gone").collect()}
    assert got[1].text == rows[0][1] and got[1].gone == 0
    assert got[2].text.split() == "Other start two here. Other end two here.".split()
    assert got[3].text == "" and got[4].text == rows[3][1] and got[5].text is None and got[6].text == ""
    assert sentence_spans.remove_repeats(docs(spark)).count() == len(TEXTS)
    assert sentence_spans.remove_repeats(none(spark)).count() == 0
    assert sentence_spans.remove_repeats(docs(spark)).columns == docs(spark).columns


def test_exact_top_k(spark):
    rng = np.random.default_rng(3)
    vec = [(i, [float(x) for x in rng.normal(0, 0.2, 8)], "c") for i in range(300)] + [(301, None, "c"), (302, [None] * 8, "c"), (303, [float("nan")] * 8, "c"), (None, [0.1] * 8, "c"), (320, [0.5] * 8, "c"), (320, [0.5] * 8, "c"), (321, [1.0, 2.0], "c")]
    v = spark.createDataFrame(vec, "vec_id long, embedding array<float>, score string")
    got = {}
    for r in ball_tree.top_k(ball_tree.quantised(v), every=20, k=5, shard_rows=70, block_rows=6).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    q = {i: np.floor(64 * np.float32(e).astype(np.float64)).astype(int) for i, e, _ in vec if i is not None and e and e[0] is not None and np.isfinite(e[0]) and len(e) == 8}
    for i in (x for x in q if x % 20 == 0):
        want = sorted(((-int(q[i] @ q[j]), j) for j in q if j != i))[:5]
        assert sorted(got[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(want)]
    assert ball_tree.top_k(ball_tree.quantised(v.limit(0)), every=20).count() == 0


def test_search_prunes_what_it_need_not_score():
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 60, (40, 16))
    x = np.floor(np.repeat(centres, 200, axis=0) + rng.normal(0, 3, (8000, 16))).astype(np.int64)
    ids, q = rng.permutation(8000), x[::100]
    found = ball_tree.Search(ids, x, ids[::100], q, np.full(len(q), -(2.0**62)), 20)
    for n in range(len(q)):
        want = sorted((-int(s), int(i)) for s, i in zip(x @ q[n], ids) if i != ids[100 * n])[:20]
        assert [(-int(s), int(i)) for s, i in zip(*found.best[n])] == want
    assert found.scored < 0.45 * len(x) * len(q)


def test_quality(spark):
    good, bad = "a calm text of plain words about things. ", "BUY!!! NOW### $$$ CLICK!!! "
    rows = [(k, (good if k % 2 else bad) * (3 + k % 5)) for k in range(80)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(61, None), (None, 1)], "doc_id long, quality int")
    model = quality_fm.train(docs(spark, rows), labels, metadata=["n_chars"])
    got = {r.doc_id: float(r.score) for r in quality_fm.score(docs(spark, rows).drop("score"), model, metadata=["n_chars"]).collect()}
    assert all((got[k] > 0.5) == bool(k % 2) for k in range(60, 80))
    assert quality_fm.score(docs(spark).drop("score"), model, metadata=["n_chars"]).count() == len(TEXTS)
    assert quality_fm.train(none(spark), labels) is None
    assert {r.score for r in quality_fm.score(docs(spark).drop("score"), None).collect()} == {0.5}


def test_quality_sample_is_bounded_in_rows(spark, monkeypatch):
    rows, seen = [(1, f"text {k} of one id") for k in range(500)], []
    monkeypatch.setattr(quality_fm, "fit", lambda row, col, val, y, size: seen.append(len(y)))
    quality_fm.train(docs(spark, rows), spark.createDataFrame([(1, 1)], "doc_id long, quality int"), max_rows=2)
    assert seen == [2]


def test_no_shared_folder_on_a_cluster_is_an_error():
    from types import SimpleNamespace

    from spliceflow.llm.common import shared_dir

    unset = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=SimpleNamespace(master=master))
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        with pytest.raises(RuntimeError):
            shared_dir(unset(master))


def test_quality_score_replaces_a_column_of_that_name(spark):
    d = docs(spark)
    got = quality_fm.score(d, None)
    assert sorted(got.columns) == sorted(d.columns) and {r.score for r in got.collect()} == {0.5}


def test_quality_pair_sums_match_the_definition():
    rng = np.random.default_rng(0)
    m = quality_fm.FactorisationMachine(0.3, rng.normal(size=6), rng.normal(size=(6, 3)))
    x = rng.normal(size=6)
    row, col = np.zeros(6, int), np.arange(6)
    want = 0.3 + m.w @ x + sum(m.v[i] @ m.v[j] * x[i] * x[j] for i in range(6) for j in range(i + 1, 6))
    assert abs(m.raw(row, col, x, 1)[0][0] - want) < 1e-9


def test_context_mixing(spark):
    import math
    import re
    from collections import Counter

    rows = [(k, " ".join(np.random.default_rng(k).choice(["the", "cat", "sat", "on", "mats", f"rare{k}"], 30))) for k in range(40)] + TEXTS
    d = docs(spark, rows)
    got = context_mixing.score(d, F.coalesce(F.col("doc_id") % 5 != 1, F.lit(False))).collect()
    assert len(got) == len(rows)
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    c = Counter(w for i, t in rows if i is not None and i % 5 != 1 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(sum(math.log10((c.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)))
    for r in got:
        assert min(abs(r.base_score - x) for x in want[r.doc_id]) < 1e-6 and r.train_tokens == n and r.score < 0 and math.isfinite(r.score)
    assert context_mixing.score(none(spark), F.lit(True)).count() == 0
    untrained = context_mixing.score(d, F.lit(False)).collect()
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in untrained)


SECRETS = 'x token = "abcdefghijkl" AKIAABCDEFGHIJKLMN 0123456789abcdef0 é password:short api_key=zzzzzzzzzzzz. key Zx81kQpT0aBvC93nLmW27rYe end'


def test_secrets(spark):
    got = {r.doc_id: r for r in secret_scan.scan(docs(spark, [(1, SECRETS), (2, None), (3, ""), (4, "plain words only")])).select("doc_id", secret_scan.written(F.col("base_spans")).alias("b"), secret_scan.written(F.col("spans")).alias("s")).collect()}
    at = lambda x: (SECRETS.index(x), SECRETS.index(x) + len(x))
    a, k, h, z, e = at('token = "abcdefghijkl'), at("AKIAABCDEFGHIJKLMN"), at("0123456789abcdef0"), at("api_key=zzzzzzzzzzzz."), at("Zx81kQpT0aBvC93nLmW27rYe")
    base = f"assign:{a[0]}:{a[1]},access:{k[0]}:{k[1]},hex:{h[0]}:{h[1]},assign:{z[0]}:{z[1]}"
    assert got[1].b == base and got[1].s == f"{base},entropy:{e[0]}:{e[1]}"
    assert all(got[i].s == "" for i in (2, 3, 4))
    red = {r.doc_id: r.text for r in secret_scan.redact(docs(spark, [(1, SECRETS), (2, None)])).collect()}
    assert red[1] == 'x [SECRET]" [SECRET] [SECRET] é password:short [SECRET] key [SECRET] end' and red[2] is None
    assert secret_scan.redact(docs(spark)).count() == len(TEXTS) and secret_scan.scan(none(spark)).count() == 0


def test_secrets_of_the_window_length_and_after_a_repetition(spark):
    keys = {1: "key Zx81kQpT0aBvC93nLmW2 end", 2: "key ====Zx81kQpT0aBvC93nLmW27rYe end", 3: f"rule {'xY1q' * 8} {'=' * 30} end", 4: "key Zx81kQpT0aBvC93nLmW end"}
    got = {r.doc_id: r.s for r in secret_scan.scan(docs(spark, list(keys.items()))).select("doc_id", secret_scan.written(F.col("spans")).alias("s")).collect()}
    assert got == {1: "entropy:4:24", 2: "entropy:4:32", 3: "", 4: ""}


def test_packing(spark):
    path = P.path("word_bpe_49k.json")
    got = packing.pack_documents(docs(spark), path, length=64, shard_pieces=5).collect()
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    want = sorted((str(i), k // 64, k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes())) for i, x in TEXTS for ids in [[*t.encode(x or "", add_special_tokens=False).ids, 0]] for k in range(0, len(ids), 64))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 64
    assert packing.pack_documents(none(spark), path).count() == 0


def test_packing_is_near_the_bound():
    sizes = np.random.default_rng(1).integers(1, 2048, 400).tolist()
    pop = packing.Population(sizes, 2048, 1)
    first = len(pop.members[0])
    bins = pop.evolve(10)
    assert sorted(i for b in bins for i in b) == list(range(400)) and all(sum(sizes[i] for i in b) <= 2048 for b in bins)
    assert pop.least <= len(bins) <= first


def test_packing_evolves_past_best_fit():
    for seed in range(6):
        sizes = np.random.default_rng(100 + seed).integers(400, 1100, 300).tolist()
        pop = packing.Population(sizes, 2048, seed)
        first = len(pop.members[0])
        bins = pop.evolve(6)
        assert sorted(i for b in bins for i in b) == list(range(300)) and all(sum(sizes[i] for i in b) <= 2048 for b in bins)
        assert pop.least <= len(bins) < first


@pytest.fixture(scope="module")
def ranks():
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}


def test_byte_bpe_equals_the_rank_encoder(spark, ranks):
    rng = np.random.default_rng(4)
    odd = ["".join(rng.choice(list(" \n\t ab'sé日😀-_0x"), 60)) for _ in range(200)] + ["aaaaaaaaaaa", "abababababa", "        x", "<|endoftext|>"]
    rows = TEXTS + [(100 + k, t) for k, t in enumerate(odd)]
    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    e = byte_bpe.encode(docs(spark, rows), path, P.PATTERN)
    got = byte_bpe.decode(e, path, P.PATTERN, as_text=True).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append((enc.encode_ordinary(t or ""), t or ""))
    assert all((list(r.ids), r.decoded) in want[r.doc_id] for r in got)
    placed = byte_bpe.encode(docs(spark, [(1, "naïve 日本")]), path, P.PATTERN, with_offsets=True).first()
    assert placed.ids_start[0] == 0 and placed.ids_end[-1] == 8 and len(placed.ids_start) == len(placed.ids)
    assert byte_bpe.encode(none(spark), path, P.PATTERN).count() == 0


def test_order_minhash_falls_with_edits(spark):
    """The share of equal elements is near what random orderings give, on average over texts, and falls with the share of replaced words."""
    rng = np.random.default_rng(12)
    words = [f"w{k:05d}" for k in range(5000)]
    rows, seen = [], {}
    for n in range(200):
        base = rng.choice(words, 300).tolist()
        for m, share in enumerate((0.0, 0.05, 0.2, 0.5)):
            text = list(base)
            for at in rng.choice(300, int(300 * share), replace=False):
                text[at] = str(rng.choice(words))
            rows.append((10 * n + m, " ".join(text)))
            mers = [set(zip(t, t[1:])) for t in (base, text)]
            seen[n, m] = len(mers[0] & mers[1]) / len(mers[0] | mers[1])
    got = {r.doc_id: np.array(r.signature) for r in order_minhash.fingerprints(docs(spark, rows)).select("doc_id", "signature").collect()}
    like = [np.mean([(got[10 * n] == got[10 * n + m]).mean() for n in range(200)]) for m in range(4)]
    want = [np.mean([seen[n, m] ** 2 for n in range(200)]) for m in range(4)]  # two k-mers agree, in order
    assert like[0] == 1.0 and all(a > b for a, b in zip(like, like[1:]))
    assert all(abs(a - b) < 0.03 for a, b in zip(like, want))


def test_order_minhash_element_by_element(spark):
    """Every element of every signature once more from the tokens, with the hashes of the xxhash library."""
    import struct

    import xxhash

    def chain(*parts):
        h = 42
        for p in parts:
            h = xxhash.xxh64_intdigest(p, h)
        return h

    long, low = (lambda v: struct.pack("<Q", v % 2**64)), (1 << 35) - 1

    def signature(text, k=2, picks=2, permutations=12):
        tokens = re.findall(r"\S{1,8}", text or "")
        if not tokens:
            return [0] * 2 * permutations
        seen, mers = {}, []
        for i in range(len(tokens)):
            h = chain(*((tokens[i + j] if i + j < len(tokens) else "").encode() for j in range(k))) & low
            mers.append(chain(long(h), long(seen.get(h, 0))) & low)
            seen[h] = seen.get(h, 0) + 1
        out = []
        for n in range(permutations):
            order = sorted((chain(struct.pack("<i", n), long(m)) & low, i) for i, m in enumerate(mers))
            for part in (order[:picks], order[max(0, len(order) - picks) :]):
                h = chain(*(long(v) for v, _ in sorted(part, key=lambda x: x[1])))
                out.append(h - 2**64 if h >= 2**63 else h)
        return out

    rng = np.random.default_rng(13)
    texts = [None, "", "  ", "one", "one two", "a b a b a b a b", "x" * 50, "é" * 20 + " 中文 😀"] + [" ".join(rng.choice(["ab", "cd", "longer-than-eight", "e"], rng.integers(1, 60))) for _ in range(60)]
    got = {r.doc_id: r.signature for r in order_minhash.fingerprints(docs(spark, list(enumerate(texts)))).select("doc_id", "signature").collect()}
    for n, text in enumerate(texts):
        assert got[n] == signature(text), text


def test_order_minhash_leaves_the_tables_that_its_result_reads(spark):
    import os

    root = spark.conf.get("spark.checkpoint.dir")
    tables = lambda: {f for f in os.listdir(root) if f.startswith("table-")} if os.path.isdir(root) else set()
    before = tables()
    made = order_minhash.edited_likeness(docs(spark))
    assert made.count() == len(TEXTS)
    assert len(tables() - before) == 2  # signatures and ring


def test_rest_of_bands_confirms_shortened_sets(spark):
    """Sets travel with 31 bits of each shingle: shingles that only then fall together neither make a link nor cost one, and the rows dealt by
    band are narrow until the sets are joined to them."""
    high = 1 << 40
    a = list(range(1, 11))
    sets = {1: a, 2: [x + high for x in a], 3: [*range(101, 109), 50, 50 + high], 4: [*range(101, 109), 50, 50 + high, 7, 8], 5: [*range(101, 109)]}
    at = spark.createDataFrame([(0, 9, i, len(s), 0, 0, i) for i, s in sets.items()], "j int, band long, id long, n long, s1 long, s2 long, component long")
    rows = spark.createDataFrame([(i, [9]) for i in sets], "id long, bands array<long>")
    fits = lambda n, m: 100 * F.least(n, m) >= 80 * F.greatest(n, m)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = minhash._rest(at, spark.createDataFrame(list(sets.items()), "id long, shingles array<long>"), rows, fits, 80)
        plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
        assert sorted((r.a, r.b) for r in out.collect()) == [(4, 3), (5, 3)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    depth = lambda line: line.find("+- ")
    by_band = [i for i, line in enumerate(plan) if re.search(r"hashpartitioning\(band#\d+L, \d+\)", line)]
    assert by_band
    for i in by_band:
        below = plan[i + 1 : next((k for k in range(i + 1, len(plan)) if 0 <= depth(plan[k]) <= depth(plan[i])), len(plan))]
        assert not any("shingles" in line or "short" in line for line in below)


def test_near_duplicates_solves_nothing_anew_without_further_links(spark, monkeypatch):
    tables = []
    for module in (minhash, graph):
        monkeypatch.setattr(module, "stored", lambda df, keep=module.stored: tables.append(1) or keep(df))
    text = " ".join(f"w{i}" for i in range(60))
    got = minhash.near_duplicates(spark.createDataFrame([(1, text), (2, text + " end"), (3, "else entirely")], "doc_id long, text string"))
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [(1, 1), (2, 1), (3, 3)]
    assert len(tables) <= 14


def test_quality_sample_stays_narrow_in_the_driver(spark, monkeypatch):
    """The driver fits on the sample as it came, in 32 bits a number, and the model is that of the same numbers widened."""
    got, fit = [], quality_fm.fit
    monkeypatch.setattr(quality_fm, "fit", lambda *a: got.append(a) or fit(*a))
    rows = [(i, f"word{i % 3} of text {i}") for i in range(40)]
    narrow = quality_fm.train(docs(spark, rows), spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int"))
    row, col, val, *rest = got[0]
    assert (row.itemsize, col.itemsize, val.itemsize) == (4, 4, 4)
    wide = fit(row.astype(np.int64), col.astype(np.int64), val.astype(np.float64), *rest)
    assert narrow.w0 == wide.w0 and (narrow.w == wide.w).all() and (narrow.v == wide.v).all()
