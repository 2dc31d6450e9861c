"""BPE by last tokens of prefixes against the tokenizers library."""

import hashlib
import random
import sys

import public_tokenizers as P
import pytest

from spliceflow.llm import queries
from spliceflow.llm.prefix_bpe import SuffixAutomaton, decode, decoder, encode, prefix_bpe

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def _same(library, texts):
    import numpy as np

    codec = prefix_bpe(PATH)
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(codec.encode(text), "<i4").tolist()
        assert got == want, repr(text)[:200]
        assert decoder(PATH).decode(got) == library.decode(want, skip_special_tokens=False)


def test_random_texts(library):
    rng = random.Random(7)
    bits = ["a", "b", "A", "É", "é", "Σ", "ς", " ", "\n", "\x1c", "\x85", "\xa0", "'s", "'ll", "'", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "5", "٣", "中", "😀", "̸", ">", "-", "aaaa", "the", "ing", "\x00", "ß", "İ", "ﬁ", "</w>", "<", "/", "‍", "Ω"]
    _same(library, ("".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(5000)))
    _same(library, ("".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 40))) for _ in range(3000)))


def test_long_words(library):
    rng = random.Random(8)
    _same(library, ["a" * 5001, "ab" * 3000, "=" * 3000, "中" * 800, "".join(rng.choice("abcdefgh") for _ in range(20000)), "é̸" * 500])


def test_every_prefix_has_the_encoding_of_its_own(library):
    """The last token that a word's prefix has is the last token of that prefix encoded alone."""
    codec = prefix_bpe(PATH)
    word = "internationalisationwithoutspaces"
    whole = codec.encode_word(word)
    for n in range(len(whole)):
        text = "".join(codec.shown[t] for t in whole[: n + 1]).replace("</w>", "")
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode_word(text) == ids


def test_automaton_finds_all_words_that_end_at_a_place():
    rng = random.Random(9)
    words = list({tuple(rng.randrange(3) for _ in range(rng.randint(1, 6))) for _ in range(150)})
    auto = SuffixAutomaton(words)
    text = [rng.randrange(4) for _ in range(3000)]
    s = size = 0
    for i, c in enumerate(text, 1):
        s, size = auto.step(s, size, c)
        at, found = s, []
        while at > 0:
            found += [words[w] for n, w in auto.words[at] if n <= size]
            at = auto.shorter[at]
        assert sorted(found) == sorted(w for w in words if tuple(text[max(0, i - len(w)) : i]) == w)
        assert [len(w) for w in found] == sorted((len(w) for w in found), reverse=True)


def test_query_equals_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op12_prefix_bpe(spark, sf).collect()}
    assert got.keys() == texts.keys()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for n, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert (got[n]["n_tokens"], got[n]["ids_sha256"], got[n]["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_edge_cases(spark):
    kind = "doc_id long, text string, ids string, decoded string"
    rows = [(1, None, "x", "y"), (1, "", None, None), (None, "Two words", "x", "y"), (None, "Two words", "x", "y")]
    got = decode(encode(spark.createDataFrame(rows, kind), PATH), PATH)
    assert got.columns == ["doc_id", "text", "ids", "decoded"]
    assert sorted((len(r["ids"]), r["decoded"]) for r in got.collect()) == [(0, ""), (0, ""), (2, "two</w> words</w>"), (2, "two</w> words</w>")]
    assert decode(encode(spark.createDataFrame([], kind), PATH), PATH).count() == 0
    with pytest.raises(IndexError):
        decoder(PATH).decode([sys.maxsize])
    with pytest.raises(ValueError):
        decoder(PATH).decode([-1])
