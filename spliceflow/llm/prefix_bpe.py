"""BPE encoding and decoding by dynamic programming over prefixes.

The encoding of every prefix of a word ends in one token and no other: the token t that ends there and goes together with the last token of
the prefix before t. Two tokens go together if no merge across their border would have come before a merge inside them; that is tested by
undoing their merges at the border, the latest first. The tokens that end at a place are read off a suffix automaton of the vocabulary,
the longest first. One pass over a word stores the last token of every prefix; the ids follow from the back-pointers.

Texts are normalised and cut into words as by the tokenizer file's own normalizer and pre-tokenizer, which drop white space, so that
pieces between white space are independent: equal ones are encoded once per worker (a bounded memory, which changes no result). Words
of a batch that are not remembered go through the programme side by side, in numpy, one place of all words after the other; long words alone.
Special tokens of the file are recognised in texts as the tokenizers library does. Decoding joins the tokens' strings by the file's
decoder, or by spaces where it has none.

Defined cases: null and empty texts have no ids; null ids decode to the empty text; ids outside the vocabulary are an error. Extra columns are
kept, ones with the names of results replaced. Words of any length are encoded whole, in time linear in their length.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .byte_bpe import byte_chars
from .common import slices

#: Pieces, words and token pairs that a worker remembers, the longest piece and word of those, and bits of the table of pairs.
_MOST, _LONGEST, _PAIR_BITS = 180_000, 64, 18
#: Below this character all versions of Unicode agree, and texts are in normal form already; but for one that becomes two in lower case.
_LATIN, _TWO = "\u0250", "\u0130"
#: White space to Python's str.split, but not to tokenizers.
_ODD_SPACE = re.compile(r"[\x1c-\x1f]")
_PIECE = re.compile(r"[^\x20\x09-\x0D]+")
_NEVER = 1 << 60
_loaded: dict[str, "PrefixBpe"] = {}
_decoders: dict[str, "Decoder"] = {}


class SuffixAutomaton:
    """Automaton of all substrings of a set of words (sequences of small ints), grown along their trie."""

    def __init__(self, words: list[tuple[int, ...]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        # every prefix once, the short ones first, from the state of the prefix that is shorter by one
        state: dict[tuple[int, ...], int] = {(): 0}
        for prefix in sorted({w[:n] for w in words for n in range(1, len(w) + 1)}, key=len):
            state[prefix] = self._grow(state[prefix[:-1]], prefix[-1])
        #: The words that a state stands for, the longest first, and its next shorter suffix that stands for one.
        self.words: list[list[tuple[int, int]]] = [[] for _ in self.link]
        for number, w in enumerate(words):
            self.words[self._state_of(w)].append((len(w), number))
        for found in self.words:
            found.sort(reverse=True)
        self.shorter = [0] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            up = self.link[s]
            self.shorter[s] = up if up <= 0 or self.words[up] else self.shorter[up]

    def _new(self, length: int, link: int, to: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(to)
        return len(self.link) - 1

    def _part(self, p: int, c: int, q: int) -> int:
        """A state of its own for the strings of q that are no longer than those of p and c."""
        if self.length[q] == self.length[p] + 1:
            return q
        made = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = made
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = made
            p = self.link[p]
        return made

    def _grow(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return self._part(last, c, q)
        new, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._part(p, c, self.next[p][c])
        return new

    def _state_of(self, word: tuple[int, ...]) -> int:
        s = 0
        for c in word:
            s = self.next[s][c]
        return s

    def step(self, s: int, size: int, c: int) -> tuple[int, int]:
        """State and length of the longest suffix of the text read so far, and c, that is part of any word."""
        while (to := self.next[s].get(c)) is None:
            if s == 0:
                return 0, 0
            s = self.link[s]
            size = self.length[s]
        return to, size + 1


class PrefixBpe:
    """Encoder for one tokenizer file: byte-level BPE with a mark of word ends, by merges in order."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges") or spec.get("post_processor"):
            raise ValueError(f"{path}: not a BPE model of plain merges")
        if any(a.get(k) for a in spec["added_tokens"] for k in ("normalized", "lstrip", "rstrip", "single_word")):
            raise ValueError(f"{path}: added tokens must be matched as they stand")
        self.normalizer, self.pre = lib.normalizer, lib.pre_tokenizer
        if [w for w, _ in self.pre.pre_tokenize_str("b a")] != ["b", "a"]:
            raise ValueError(f"{path}: the pre-tokenizer must drop white space")
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.shown = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for text, number in [*vocab.items(), *self.special.items()]:
            self.shown[number] = text
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merged: dict[int, tuple[int, int]] = {}  # of a pair: rank and token
        self.parts: dict[int, tuple[int, int, int]] = {}  # of a token: rank, left and right part
        size = self.size = len(self.shown)
        for rank, (a, b) in enumerate(merges):
            left, right, made = vocab[a], vocab[b], vocab[a + b]
            if made in self.parts:
                raise ValueError(f"{path}: two merges make {a + b!r}")
            self.merged[left * size + right] = rank, made
            self.parts[made] = rank, left, right
        made = self.parts.keys()
        self.symbols = {text: number for text, number in vocab.items() if number not in made and text not in self.special}
        numbers = {number: n for n, number in enumerate(self.symbols.values())}
        spelt: dict[int, tuple[int, ...]] = {number: (n,) for number, n in numbers.items()}
        for token, (rank, a, b) in self.parts.items():  # in the order of merges: parts come first
            spelt[token] = spelt[a] + spelt[b]
        # a token that its own symbols are not encoded to is never the last one of a prefix
        whole = set(numbers)
        for token, (rank, a, b) in self.parts.items():
            if a in whole and b in whole and self._apart(a, b, rank):
                whole.add(token)
        self.tokens = [t for t in spelt if t in whole]
        self.number = {text: numbers[t] for text, t in self.symbols.items()}
        self.automaton = SuffixAutomaton([spelt[t] for t in self.tokens])
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.known_words: dict[str, bytes] = {}
        self._tables()
        self.find = self._finder(spec)

    def _tables(self) -> None:
        """The automaton, merges and symbols as arrays."""
        auto, size = self.automaton, self.size
        moves = sorted((s * 512 + c, to) for s, found in enumerate(auto.next) for c, to in found.items())
        self.move_key, self.move_to = np.array(moves, dtype=np.int64).T.copy()
        self.link, self.length = np.array(auto.link, dtype=np.int64), np.array(auto.length, dtype=np.int64)
        # candidates of a state, the longest first, then those of its next shorter suffix: a chain through one list
        begin = np.cumsum([0, *map(len, auto.words)])
        flat = [w for found in auto.words for w in found]
        self.cand_len = np.array([n for n, _ in flat], dtype=np.int64)
        self.cand_token = np.array([self.tokens[t] for _, t in flat], dtype=np.int64)
        first, following = np.full(len(auto.words), -1), np.arange(1, len(flat) + 1)
        for s in sorted(range(1, len(auto.words)), key=auto.length.__getitem__):
            first[s] = begin[s] if auto.words[s] else first[auto.shorter[s]]
            if auto.words[s]:
                following[begin[s + 1] - 1] = first[auto.shorter[s]]
        self.first, self.following = first, following
        ranks = sorted((k, r) for k, (r, _) in self.merged.items())
        self.merge_key, self.merge_rank = np.array(ranks, dtype=np.int64).T.copy()
        self.rank, self.left, self.right = np.full(size, -1), np.arange(size), np.arange(size)
        for t, (r, a, b) in self.parts.items():
            self.rank[t], self.left[t], self.right[t] = r, a, b
        chars = self.chars = byte_chars()
        self.byte = {c: n for n, c in enumerate(chars)}
        self.inner = np.array([self.number[c] for c in chars])
        self.final = np.array([self.number[c + self.suffix] for c in chars])
        self.pair_key, self.pair_fits = np.full(1 << _PAIR_BITS, -1, dtype=np.int64), np.zeros(1 << _PAIR_BITS, dtype=bool)

    def _finder(self, spec: dict):
        """What finds the words, and line ends, of Latin letters in lower case, where the file's normalizer and pre-tokenizer are of the known kind."""
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        norms = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if norms != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in steps] != ["Split", "ByteLevel"]:
            return None
        cut, by_byte = steps
        if cut["behavior"] != "Removed" or not cut["invert"] or by_byte["add_prefix_space"] or by_byte["use_regex"]:
            return None
        import regex

        return regex.compile(cut["pattern"]["Regex"] + r"|\n").findall

    def _apart(self, a: int, b: int, below: int) -> bool:
        """Whether a and b, next to each other, are made without any merge over their border of a rank less than below."""
        merged, parts, size = self.merged, self.parts, self.size
        none = (-1, a, b)
        while True:
            if merged.get(a * size + b, (_NEVER, 0))[0] < below:
                return False
            (ra, _, inner_a), (rb, inner_b, _) = parts.get(a, none), parts.get(b, none)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:  # of equal ranks the left one merges first, so a merge over the border has to be of a lower rank than a's
                below, a = ra, inner_a
            else:  # and goes before b's of the same rank
                below, b = rb + 1, inner_b

    def together(self, a: int, b: int) -> bool:
        """Whether the symbols of a and b are encoded as a, b."""
        key = a * self.size + b
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) >= _MOST:
                self.pairs.clear()
            got = self.pairs[key] = self._apart(a, b, _NEVER)
        return got

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word as the pre-tokenizer gives it."""
        number, auto, tokens = self.number, self.automaton, self.tokens
        symbols = [number[c] for c in word[:-1]]
        symbols.append(number[word[-1] + self.suffix])
        last, size = [-1] * (len(symbols) + 1), [0] * (len(symbols) + 1)
        state = matched = 0
        for i, c in enumerate(symbols, 1):
            state, matched = auto.step(state, matched, c)
            s = state
            while last[i] < 0:
                for n, t in auto.words[s]:
                    if n <= matched and (n == i or self.together(last[i - n], tokens[t])):
                        last[i], size[i] = tokens[t], n
                        break
                else:
                    s = auto.shorter[s]
                    if s <= 0:
                        raise ValueError("symbols without a token")
        out, i = [], len(symbols)
        while i:
            out.append(last[i])
            i -= size[i]
        return out[::-1]

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """together() for arrays."""
        key = a * self.size + b
        at = ((key * 0x9E3779B1) >> 13) & ((1 << _PAIR_BITS) - 1)
        out = self.pair_fits[at]
        new = np.flatnonzero(self.pair_key[at] != key)
        if len(new):
            fits = self._apart_all(a[new], b[new])
            out[new], self.pair_fits[at[new]], self.pair_key[at[new]] = fits, fits, key[new]
            same = self.pair_key[at[new]] == key[new]  # of several pairs at one place the last is kept, with its own answer
            self.pair_fits[at[new][same]] = fits[same]
        return out

    def _apart_all(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, left, below = np.ones(len(a), dtype=bool), np.arange(len(a)), np.full(len(a), _NEVER)
        while len(left):
            key = a * self.size + b
            at = np.minimum(np.searchsorted(self.merge_key, key), len(self.merge_key) - 1)
            bad = (self.merge_key[at] == key) & (self.merge_rank[at] < below)
            out[left[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            a, b, ra, rb, left = a[go], b[go], ra[go], rb[go], left[go]
            undo = ra > rb
            below = np.where(undo, ra, rb + 1)
            a, b = np.where(undo, self.right[a], a), np.where(undo, b, self.left[b])
        return out

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each word, given as bytes: encode_word for all of them at a time."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-size, kind="stable")
        size, n = size[order], len(words)
        body = np.frombuffer(b"".join([words[k] for k in order.tolist()]), np.uint8)
        begin, longest = np.cumsum(size) - size, int(size[0])
        row = np.repeat(np.arange(n), size)
        symbol = np.empty((longest, n), dtype=np.int64)
        symbol[np.arange(len(body)) - begin[row], row] = self.inner[body]
        symbol[size - 1, np.arange(n)] = self.final[body[begin + size - 1]]
        last, back = np.full((longest + 1, n), -1, dtype=np.int64), np.zeros((longest + 1, n), dtype=np.int64)
        state, matched = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        for i in range(1, longest + 1):
            active = int(np.searchsorted(-size, -i, "right"))
            c, todo = symbol[i - 1], np.arange(active)
            while len(todo):  # follow the links of those that cannot go on
                key = state[todo] * 512 + c[todo]
                at = np.minimum(np.searchsorted(self.move_key, key), len(self.move_key) - 1)
                there = self.move_key[at] == key
                state[todo[there]] = self.move_to[at[there]]
                matched[todo[there]] += 1
                todo = todo[~there]
                state[todo] = self.link[state[todo]]
                matched[todo] = self.length[state[todo]]
            todo, cand = np.arange(active), self.first[state[:active]]
            while len(todo):
                n_symbols, token = self.cand_len[cand], self.cand_token[cand]
                ok = n_symbols <= matched[todo]
                test = np.flatnonzero(ok & (n_symbols < i))
                ok[test] = self._fit(last[i - n_symbols[test], todo[test]], token[test])
                last[i, todo[ok]], back[i, todo[ok]] = token[ok], n_symbols[ok]
                todo, cand = todo[~ok], self.following[cand[~ok]]
        at, count = size.copy(), np.zeros(n, dtype=np.int64)
        taken, live = [], np.arange(n)
        while len(live):
            taken.append((live, last[at[live], live]))
            count[live] += 1
            at[live] -= back[at[live], live]
            live = live[at[live] > 0]
        end = np.cumsum(count)
        ids = np.empty(int(end[-1]), dtype="<i4")
        for k, (rows, tokens) in enumerate(taken):
            ids[end[rows] - 1 - k] = tokens
        raw, out = ids.tobytes(), [b""] * n
        for k, lo, hi in zip(order.tolist(), (end - count).tolist(), end.tolist()):
            out[k] = raw[4 * lo : 4 * hi]
        return out

    def _words(self, piece: str) -> list[str]:
        """The words of a piece of text, by the library."""
        byte = self.byte
        plain = self.normalizer.normalize_str(piece) if self.normalizer else piece
        return [bytes([byte[c] for c in w]).decode() for w, _ in self.pre.pre_tokenize_str(plain)]

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of the pieces, of which those of usual length are remembered."""
        known = self.known_words
        if len(known) > _MOST:
            known.clear()
        odd = pieces
        if self.find:
            odd = [p for p in pieces if not p.isascii() and (max(p) >= _LATIN or _TWO in p)]
            if _ODD_SPACE.search("".join(pieces)):
                odd = list({*odd, *filter(_ODD_SPACE.search, pieces)})
        if odd:
            others = set(odd)
            latin = [p for p in pieces if p not in others]
        else:
            latin = pieces
        # the words of all pieces at a time, a line end after each piece
        found = self.find("".join([p + "\n" for p in latin]).lower()) if latin else []
        for p in odd:
            found += self._words(p)
            found.append("\n")
        new = list({w for w in set(found) if w not in known})
        short = [w for w in new if len(w) <= _LONGEST and w != "\n"] if len(new) > 50 else []
        for lo in range(0, len(short), 20_000):
            some = short[lo : lo + 20_000]
            known.update(zip(some, self.encode_words([w.encode() for w in some])))
        here = {w: np.array(self.encode_word("".join(map(self.chars.__getitem__, w.encode()))), dtype="<i4").tobytes() for w in new if w not in known and w != "\n"}
        out, ids, at = {}, b"", iter([*latin, *odd])
        for w in found:
            if w == "\n":
                out[next(at)] = ids
                ids = b""
            else:
                ids += known[w] if w in known else here[w]
        if here:
            known.update((w, x) for w, x in here.items() if len(w) <= _LONGEST)
        self.known.update(out if max(map(len, pieces)) <= _LONGEST else {p: x for p, x in out.items() if len(p) <= _LONGEST})
        return out

    def _plain(self, texts: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > _MOST:
            known.clear()
        cut = [_PIECE.findall(t) if _ODD_SPACE.search(t) else t.split() for t in texts]
        new = [p for p in set(chain.from_iterable(cut)) if p not in known]
        here = self._learn(new) if new else {}
        far = {p for p in here if len(p) > _LONGEST}
        if not far:
            return [b"".join(map(known.__getitem__, pieces)) for pieces in cut]
        return [b"".join([here[p] if p in far else known[p] for p in pieces]) for pieces in cut]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        special = [self.specials.split(t) if self.specials and self.specials.search(t) else [t] for t in texts]
        plain = iter(self._plain([p for parts in special for p in parts[::2]]))
        mark = lambda p: np.array([self.special[p]], dtype="<i4").tobytes()
        return [next(plain) if len(parts) == 1 else b"".join([mark(p) if k % 2 else next(plain) for k, p in enumerate(parts)]) for parts in special]

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]


class Decoder:
    """The strings of a tokenizer file's ids, joined by its decoder."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(path)
        self.decoder = lib.decoder
        vocab = lib.get_vocab(with_added_tokens=True)
        self.shown = [""] * (1 + max(vocab.values()))
        for text, number in vocab.items():
            self.shown[number] = text

    def decode(self, ids: list[int]) -> str:
        if ids and min(ids) < 0:
            raise ValueError(f"no such id: {min(ids)}")
        tokens = map(self.shown.__getitem__, ids)
        return self.decoder.decode(list(tokens)) if self.decoder else " ".join(tokens)


def prefix_bpe(path: str) -> PrefixBpe:
    """The encoder of this worker: built once for all its tasks."""
    if path not in _loaded:
        _loaded[path] = PrefixBpe(path)
    return _loaded[path]


def decoder(path: str) -> Decoder:
    if path not in _decoders:
        _decoders[path] = Decoder(path)
    return _decoders[path]


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with `out`: array<int>, the ids of the whole text."""
    d = docs.select(*[c for c in docs.columns if c != out], docs[text].cast("string").alias("__in"))
    names, fields = d.columns[:-1], d.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = prefix_bpe(path)
        for batch in slices(batches, "__in", 2 << 20):
            got = codec.encode_batch([t or "" for t in batch.column("__in").to_pylist()])
            off = np.concatenate([[0], np.cumsum([len(g) // 4 for g in got])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(off), pa.array(np.frombuffer(b"".join(got), dtype="<i4")))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), ids], [*names, out])

    return d.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with `out`: the text of the ids."""
    d = df.select(*[c for c in df.columns if c != out], df[ids].cast("array<int>").alias("__in"))
    names, fields = d.columns[:-1], d.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = decoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                made = [codec.decode(v.values.to_pylist()) if v.is_valid else "" for v in part.column("__in")]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), pa.array(made, pa.string())], [*names, out])

    return d.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.StringType())]))
