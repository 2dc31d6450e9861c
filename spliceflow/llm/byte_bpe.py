"""Byte-level BPE encoding and decoding by a table of ranks, with the tokenizers library over Arrow batches.

A rank file (lines of base64 token and rank) is turned into a BPE model: bytes are written as visible characters, and every way of
splitting a token into two tokens becomes a merge with the token's rank, so that pieces merge as by ranks. Texts are cut at
spaces that a character other than white space follows, where a match of the split pattern always begins; equal cuts are encoded once per worker.
Offsets are code points: each token of a character that is split over several tokens has that character's place. Decoding
joins the tokens' bytes; as text, bytes that make no character become U+FFFD only after all bytes are joined.

Defined cases: null text counts as empty and gives no ids; null ids decode to no bytes; unknown ids are an error. Extra columns
are kept, ones with the names of results replaced. Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices

_CUT = re.compile(r" (?=\S)")
_MOST = 300_000
_loaded: dict[tuple, "Codec"] = {}


def byte_chars() -> list[str]:
    """The visible character of each byte in byte-level vocabularies: printable ones stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(0x100 + rest.index(b)) for b in range(256)]


class Codec:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        chars = byte_chars()
        shown = lambda t: "".join(chars[b] for b in t)
        merges = []
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            pairs = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
            merges += sorted(pairs, key=lambda p: (ranks[p[0]], ranks[p[1]]))
        t = Tokenizer(models.BPE(vocab={shown(k): v for k, v in ranks.items()}, merges=[(shown(a), shown(b)) for a, b in merges], ignore_merges=True))
        t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.tokenizer = t
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            self.bytes[v] = k
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        known, cut = self.known, [_CUT.split(t) for t in texts]
        if len(known) > _MOST:
            known.clear()
        heads = [c[0] for c in cut]
        new = {p for c in cut for p in c[1:]} - known.keys()
        if new:
            new = list(new)
            for i in range(0, len(new), 4096):
                part = new[i : i + 4096]
                for p, e in zip(part, self.tokenizer.encode_batch_fast([" " + p for p in part], add_special_tokens=False)):
                    known[p] = np.array(e.ids, dtype="<u4").tobytes()
        first = self.tokenizer.encode_batch_fast(heads, add_special_tokens=False)
        get = known.__getitem__
        return [np.array(e.ids, dtype="<u4").tobytes() + b"".join(map(get, c[1:])) for e, c in zip(first, cut)]

    def encode_with_offsets(self, texts: list[str]) -> list[tuple[list[int], list[tuple[int, int]]]]:
        return [(e.ids, e.offsets) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


def codec(path: str, pattern: str) -> Codec:
    """The codec of this worker: built once for all its tasks."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Codec(path, pattern)
    return _loaded[path, pattern]


def _carried(df: DataFrame, column: str, cast: str, new: list[str]) -> tuple[DataFrame, list[str], list]:
    d = df.select(*[c for c in df.columns if c not in new], df[column].cast(cast).alias("__in"))
    return d, d.columns[:-1], d.schema.fields[:-1]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids", with_offsets: bool = False) -> DataFrame:
    """docs with `out`: array<int>, and with_offsets also `<out>_start` and `<out>_end`, the tokens' places in code points."""
    extra = [out, *([f"{out}_start", f"{out}_end"] if with_offsets else [])]
    d, names, fields = _carried(docs, text, "string", extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in slices(batches, "__in", 2 << 20):
            texts = [t or "" for t in batch.column("__in").to_pylist()]
            if with_offsets:
                got = c.encode_with_offsets(texts)
                cols = [pa.array([g[0] for g in got], pa.list_(pa.int32())), *(pa.array([[o[k] for o in g[1]] for g in got], pa.list_(pa.int32())) for k in (0, 1))]
            else:
                got = c.encode(texts)
                off = np.concatenate([[0], np.cumsum([len(g) // 4 for g in got])]).astype(np.int32)
                cols = [pa.ListArray.from_arrays(pa.array(off), pa.array(np.frombuffer(b"".join(got), dtype="<i4")))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *cols], [*names, *extra])

    return d.mapInArrow(run, T.StructType([*fields, *(T.StructField(x, T.ArrayType(T.IntegerType())) for x in extra)]))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded", as_text: bool = False) -> DataFrame:
    """df with `out`: the bytes of the ids, or as_text the characters they make."""
    d, names, fields = _carried(df, ids, "array<int>", [out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                made = [c.decode(v.values.to_numpy(zero_copy_only=False)) if v.is_valid else b"" for v in part.column("__in")]
                made = pa.array([m.decode("utf-8", "replace") for m in made], pa.string()) if as_text else pa.array(made, pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), made], [*names, out])

    return d.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.StringType() if as_text else T.BinaryType())]))
