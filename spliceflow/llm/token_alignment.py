"""Alignment of two tokenizers over exactly deduplicated texts.

Equal texts are brought together by a shuffle on the whole text; each distinct text is tokenised by both tokenizers and aligned once.
A is a byte-level BPE of the tokenizers library and reads space + text, B a sentencepiece model that adds the space itself. Where tokens of both
end at one byte they are linked, and the tokens since the last such place are a group. Links are counted by pair of ids, each as often
as its text occurs, and the measures of a text go to the rows that hold it.

Both cut texts at a space between two other characters, the second no white space: A's words begin there, and no piece of B reaches over
it (checked when the model is loaded). The parts are therefore independent and equal ones are aligned once per worker (a bounded memory, which
changes no result).

Of two linked tokens the shorter is the end of the longer, so that there are at most as many pairs as the tokens of both vocabularies have bytes:
the table of counts is of that size whatever the corpus, and is broadcast. Texts with more copies than rows / HOT are fewer than HOT, and
their measures are broadcast to the copies; all others are joined on the digest of the text.

Defined cases: null and empty texts, and texts that a tokenizer does not give back byte by byte, have no tokens: zeros and an empty
group column. Special tokens' strings are plain text. Rows with a null or repeated id are rows like others. Empty tables give no
rows. Of extra columns only those to keep are kept; their names may not begin with two underscores.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import byte_chars
from .common import drop_stored, slices, stored

#: At most so many texts count as hot.
HOT = 1000
#: Parts that a worker remembers, and the longest of them.
_MOST, _LONGEST = 50_000, 64
_CUT = re.compile(r"(?<! )(?= \S)")
#: A part of one space and text that ends without white space.
_PLAIN = lambda p: p[1:2] not in ("", " ") and not p[1].isspace() and not p[-1].isspace()
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
SPACE = "▁"
_loaded: dict[tuple[str, str], "Aligner"] = {}


class Aligner:
    """Both tokenizers and what their tokens are as bytes."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        back = {c: n for n, c in enumerate(byte_chars())}
        self.bytes_a: dict[int, bytes] = {}
        for token, number in self.a.get_vocab(with_added_tokens=False).items():
            self.bytes_a[number] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(n) for n in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(m.group(1), 16)]) if self.b.is_byte(n) and (m := _BYTE_PIECE.fullmatch(p)) else p.replace(SPACE, " ").encode() for n, p in enumerate(pieces)]
        normal = [n for n in range(len(pieces)) if not (self.b.is_control(n) or self.b.is_unknown(n) or self.b.is_byte(n))]
        n = 1 + max(self.bytes_a)
        self.size_a = np.array([len(self.bytes_a.get(t, b"")) for t in range(n)])
        self.size_b = np.array([len(x) for x in self.bytes_b])
        follow = lambda n, end: np.array([f"{t}," for t in range(n)] + [f"{t}{end}" for t in range(n)], dtype=object)
        self.shown_a, self.shown_b = follow(n, "|"), follow(len(pieces), ";")
        #: Whether texts may be cut at spaces: no piece goes on with a space after another character, and spaces are kept as they are.
        self.cuts = not any(SPACE in pieces[n].lstrip(SPACE) for n in normal) and self.b.encode("a  b", out_type=str)[0].startswith(SPACE) and self._kept("a  b ")
        self.known: dict[str, tuple | None] = {}

    def _kept(self, text: str) -> bool:
        return b"".join(map(self.bytes_b.__getitem__, self.b.encode(text))) == b" " + text.encode()

    def most_pairs(self) -> int:
        """Bound of the number of different linked pairs."""
        return sum(map(len, self.bytes_a.values())) + sum(map(len, self.bytes_b))

    def part(self, text: str, ids_a: list[int], ids_b: list[int]) -> tuple[int, int, int, str, bytes] | None:
        """(tokens of A, of B, groups, groups as text, links as packed longs) of a part that begins with a space; None if it is not given back."""
        raw, of_a, of_b = text.encode(), [self.bytes_a[t] for t in ids_a], [self.bytes_b[t] for t in ids_b]
        if b"".join(of_a) != raw or b"".join(of_b) != raw:
            return None
        groups, links = [], []
        i = j = at_i = at_j = begin_i = begin_j = 0
        n_a, n_b = len(ids_a), len(ids_b)
        while i < n_a or j < n_b:
            if at_i <= at_j:
                at_i += len(of_a[i])
                i += 1
            else:
                at_j += len(of_b[j])
                j += 1
            if at_i == at_j:
                groups.append(f"{','.join(map(str, ids_a[begin_i:i]))}|{','.join(map(str, ids_b[begin_j:j]))}")
                links.append((ids_a[i - 1] << 32 | ids_b[j - 1]).to_bytes(8, "little"))
                begin_i, begin_j = i, j
        return n_a, n_b, len(groups), ";".join(groups), b"".join(links)

    def parts(self, texts: list[str], plain: bool) -> list[tuple | None]:
        """part() of many parts; plain: all of one space and text that ends without white space."""
        raw = "".join(texts).encode()
        ids_b = self.b.encode([t[1:] for t in texts], num_threads=1)
        # words of A begin where plain parts do, so that they can be encoded in one piece
        lists_a = [self.a.encode_batch_fast(["".join(texts)], add_special_tokens=False)[0].ids] if plain else [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        flat_a, flat_b = np.array(list(chain.from_iterable(lists_a)), dtype=np.int64), np.array(list(chain.from_iterable(ids_b)), dtype=np.int64)
        ends_a, ends_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])
        stop = np.cumsum([len(t.encode()) for t in texts])
        last_a, last_b = np.searchsorted(ends_a, stop, "right"), np.cumsum([len(y) for y in ids_b])
        good = b"".join(map(self.bytes_a.__getitem__, flat_a.tolist())) == raw and b"".join(map(self.bytes_b.__getitem__, flat_b.tolist())) == raw
        if not good or (last_b == 0).any() or (ends_b[last_b - 1] != stop).any() or (ends_a[last_a - 1] != stop).any():
            a = self.a.encode_batch_fast(texts, add_special_tokens=False)
            return [self.part(t, x.ids, y) for t, x, y in zip(texts, a, ids_b)]
        # both give back the same bytes: where both end, over all parts, and how many tokens each group has
        _, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        links = (flat_a[at_a] << 32 | flat_b[at_b]).astype("<i8").tobytes()
        group_a, group_b = np.searchsorted(at_a, np.arange(len(flat_a))), np.searchsorted(at_b, np.arange(len(flat_b)))
        # the tokens as text with what follows each, A's of a group and then B's
        shown = np.empty(len(flat_a) + len(flat_b), dtype=object)
        through_a, before_b = at_a + 1, np.concatenate([[0], at_b[:-1] + 1])
        final_a, final_b = np.isin(np.arange(len(flat_a)), at_a, assume_unique=True), np.isin(np.arange(len(flat_b)), at_b, assume_unique=True)
        shown[np.arange(len(flat_a)) + before_b[group_a]] = self.shown_a[flat_a + len(self.size_a) * final_a]
        shown[np.arange(len(flat_b)) + through_a[group_b]] = self.shown_b[flat_b + len(self.size_b) * final_b]
        words, stop_g = shown.tolist(), np.searchsorted(at_a, last_a)
        out, la, lb, lg = [], 0, 0, 0
        for na, nb, ng in zip(last_a.tolist(), last_b.tolist(), stop_g.tolist()):
            out.append((na - la, nb - lb, ng - lg, "".join(words[la + lb : na + nb])[:-1], links[8 * lg : 8 * ng]))
            la, lb, lg = na, nb, ng
        return out

    def align(self, texts: list[str]) -> list[tuple[int, int, int, str, bytes] | None]:
        """The same for whole texts, without their leading space; None where they have no tokens."""
        known = self.known
        if len(known) > _MOST:
            known.clear()
        cut = [_CUT.split(" " + t) if self.cuts else [" " + t] for t in texts]
        for c in cut:
            if c[0] == "":
                del c[0]  # the cut before the leading space
        here: dict[str, tuple | None] = {}
        new = [p for p in {p for c in cut for p in c} if p not in known]
        careful = [p for p in new if not _PLAIN(p)]
        few = len(careful)
        if few:
            apart = set(careful)
            new = careful + [p for p in new if p not in apart]
        for lo, hi in [*((k, min(few, k + 4096)) for k in range(0, few, 4096)), *((k, k + 4096) for k in range(few, len(new), 4096))]:
            some = new[lo:hi]
            for p, got in zip(some, self.parts(some, lo >= few)):
                (known if len(p) <= _LONGEST else here)[p] = got
        out: list[tuple[int, int, int, str, bytes] | None] = []
        for text, c in zip(texts, cut):
            got = [here[p] if p in here else known[p] for p in c] if here else list(map(known.__getitem__, c))
            if not text or None in got:
                out.append(None)
            else:
                n_a, n_b, n_groups, groups, links = zip(*got)
                out.append((sum(n_a), sum(n_b), sum(n_groups), ";".join(groups), b"".join(links)))
        return out


def aligner(path_a: str, path_b: str) -> Aligner:
    """The tokenizers of this worker: loaded once for all its tasks."""
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Aligner(path_a, path_b)
    return _loaded[path_a, path_b]


def distinct_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(text, copies): the non-empty texts, each once, brought together by the whole text."""
    t = docs.select(F.col(text).cast("string").alias("text")).where("text <> ''")
    return t.groupBy("text").agg(F.count("*").alias("copies"))


def align(texts: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """texts with n_a, n_b, n_groups (longs), groups (`a1,a2|b1;a3|b2,b3`, empty without tokens), and the different linked pairs
    as `pairs` (A id << 32 | B id) with their `links` in the text."""
    extra = [T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups")]
    extra += [T.StructField("groups", T.StringType()), T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("links", T.ArrayType(T.IntegerType()))]
    new = [f.name for f in extra]
    d = texts.select(*[c for c in texts.columns if c not in new], texts[text].cast("string").alias("__in"))
    names, fields = d.columns[:-1], d.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        for batch in slices(batches, "__in", 1 << 20):
            got = [g or (0, 0, 0, "", b"") for g in both.align([t or "" for t in batch.column("__in").to_pylist()])]
            counted = [np.unique(np.frombuffer(g[4], dtype="<i8"), return_counts=True) for g in got]
            off = pa.array(np.concatenate([[0], np.cumsum([len(p) for p, _ in counted])]).astype(np.int32))
            flat = lambda k, kind: pa.array(np.concatenate([c[k] for c in counted]).astype(kind)) if counted else pa.array([], kind)  # noqa: E731, B023
            cols = [*(pa.array([g[k] for g in got], pa.int64()) for k in range(3)), pa.array([g[3] for g in got], pa.string())]
            cols += [pa.ListArray.from_arrays(off, flat(0, np.int64)), pa.ListArray.from_arrays(off, flat(1, np.int32))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *cols], [*names, *new])

    return d.mapInArrow(run, T.StructType([*fields, *extra]))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best): links of each pair over all rows that hold them, and whether no other pair of its B id has more."""
    pairs = aligned.select("copies", F.explode(F.arrays_zip("pairs", "links")).alias("p"))
    counts = pairs.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum(F.col("p.links") * F.col("copies")).alias("count"))
    most = F.max("count").over(Window.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))))
    return counts.withColumn("best", F.col("count") == most)


def measures(docs: DataFrame, path_a: str, path_b: str, digest: Column, text: str = "text", keep: list[str] = ["doc_id"]) -> DataFrame:
    """The kept columns of every row with n_a, n_b, n_groups, n_links, n_best, count_sum and `groups_digest`: digest, a column of `groups`, of the text's
    groups ('' without tokens)."""
    key = F.sha2(F.col(text).cast("string"), 256)
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    aligned = align(distinct_texts(docs, text), path_a, path_b)
    aligned = stored(aligned.select(F.sha2("text", 256).alias("__key"), "copies", "n_a", "n_b", "n_groups", digest.alias("groups_digest"), "pairs", "links"))
    counts = stored(pair_counts(aligned))
    each = aligned.select("__key", F.explode(F.arrays_zip("pairs", "links")).alias("p")).select("__key", F.col("p.pairs").alias("pair"), F.col("p.links").alias("k"))
    sums = each.join(F.broadcast(counts), "pair").groupBy("__key").agg(
        F.sum("k").alias("n_links"), F.sum(F.when(F.col("best"), F.col("k")).otherwise(F.lit(0))).alias("n_best"), F.sum(F.col("k") * F.col("count")).alias("count_sum")
    )
    made = stored(aligned.drop("pairs", "links").join(sums, "__key", "left"))
    drop_stored(aligned)
    drop_stored(counts)
    text_there = F.coalesce(F.col(text).cast("string") != "", F.lit(False))
    rows, least = docs.where(text_there).select(*keep, key.alias("__key")), docs.count() / HOT
    hot, rest = made.where(F.col("copies") > least), made.where(F.col("copies") <= least)
    rows = rows.join(F.broadcast(hot.select("__key", F.lit(True).alias("__hot"))), "__key", "left")
    got = rows.where("__hot is null").join(rest, "__key").unionByName(rows.where("__hot").join(F.broadcast(hot), "__key"))
    got = got.unionByName(docs.where(~text_there).select(*keep), allowMissingColumns=True)
    return got.select(*keep, *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers), F.when(F.col("n_groups") > 0, F.col("groups_digest")).otherwise(F.lit("")).alias("groups_digest"))
