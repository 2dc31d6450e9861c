"""Removal of repeated passages by sliding spans of sentences.

A text is cut into sentences (after . ! ? and white space, and at line ends). Every run of `sentences` consecutive sentences with at
least `least_words` words is hashed; so is, from every sentence on and up to every sentence, the shortest run of two or more with at
least `min_words` words, and every single sentence of `long_words` words: passages of few long sentences are found as well as ones
of many short ones, from their first whole sentence to their last. Runs are joined by hash over all documents; the first, by
(doc_id, hash of the text, place), stays, and sentences that another run of the same words covers are removed.

A document is a row's id and text: rows that share an id but not the text are documents of their own, ordered by a hash of the text;
rows equal in both are one document, which stays or loses sentences in all its rows alike.

Defined cases: null texts stay null; a text in which no run reaches its least number of words is never changed; a text that is removed
wholly becomes empty and its row stays. White space and case do not count in a comparison. Null ids come last. Extra columns
are kept. Besides the text itself, some 100 bytes for each sentence of a text are held at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, slices, stored

_CUT = re.compile(r"(?<=[.!?])\s+|\s*\n\s*")


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences, in code points."""
    out, at = [], 0
    for m in _CUT.finditer(text):
        if m.start() > at:
            out.append((at, m.start()))
        at = max(at, m.end())
    if len(text) > at and not text[at:].isspace():
        out.append((at, len(text)))
    return out


def runs(text: str, sentences_in_run: int = 3, least_words: int = 12, min_words: int = 20, long_words: int = 40) -> list[tuple[int, int, int, bool]]:
    """(hash, start, end, whether the text has the same run before) of the runs of a text."""
    places = sentences(text)
    low = text.lower() if text.isascii() else text
    at, words, total, n = [0], [0], 0, len(places)
    parts = []
    for a, b in places:
        w = low[a:b].split()
        total += len(w)
        words.append(total)
        p = (" ".join(w) if text.isascii() else " ".join(w).lower()).encode("utf-8", "surrogatepass")
        parts.append(p)
        at.append(at[-1] + len(p) + 1)
    if total < least_words:
        return []
    joined = b"\n".join(parts) + b"\n"
    spans = {(i, i + sentences_in_run) for i in range(n - sentences_in_run + 1) if words[i + sentences_in_run] - words[i] >= least_words}
    spans |= {(i, i + 1) for i in range(n) if words[i + 1] - words[i] >= long_words}
    j = 0
    for i in range(n - 1):  # forwards from i
        j = max(j, i + 2)
        while j < n and words[j] - words[i] < min_words:
            j += 1
        if words[j] - words[i] < min_words:
            break
        spans.add((i, j))
    i = n
    for j in range(n, 1, -1):  # backwards from j
        i = min(i, j - 2)
        while i > 0 and words[j] - words[i] < min_words:
            i -= 1
        if words[j] - words[i] < min_words:
            break
        spans.add((i, j))
    seen: set[int] = set()
    out = []
    for i, j in sorted(spans):
        h = xxhash.xxh3_64_intdigest(joined[at[i] : at[j]])
        h = h - (1 << 64) if h >> 63 else h
        out.append((h, places[i][0], places[j - 1][1], h in seen))
        seen.add(h)
    return out


def span_table(docs: DataFrame, **how) -> DataFrame:
    """(hash, doc, of, start, end, again): every run of every document (doc, of, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            row, h, start, end, again = [], [], [], [], []
            for k, t in enumerate(batch.column("text").to_pylist()):
                for a, b, c, e in runs(t, **how) if t else ():
                    row.append(k), h.append(a), start.append(b), end.append(c), again.append(e)
            at = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), batch.column("doc").take(at), batch.column("of").take(at), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(again, pa.bool_())], ["hash", "doc", "of", "start", "end", "again"])

    return docs.mapInArrow(run, "hash long, doc long, of long, start int, end int, again boolean")


def _keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(row, t, doc, of): the whole row, its text, and the id (or the largest long) and a hash of the text, which tell documents apart."""
    t = F.col(text).cast("string")
    return docs.select(F.struct(*docs.columns).alias("row"), t.alias("t"), F.coalesce(F.col(id).cast("long"), F.lit(2**63 - 1)).alias("doc"), F.xxhash64(t).alias("of"))


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", count: str | None = None, **how) -> DataFrame:
    """docs with repeated passages removed from the text; with `count`, a column of that name gets the number of characters
    removed. The runs are written once. They are counted per hash before the shuffle, so a passage that a third of all documents share
    is one row per task; the join back to the runs is one that adaptive execution can split, and only repeated hashes take part."""
    keyed = _keyed(docs, id, text)
    spans = stored(span_table(keyed.select("doc", "of", F.col("t").alias("text")), **how))
    key = F.struct("doc", "of")
    first = spans.where("not again").groupBy("hash").agg(F.min(key).alias("first"), F.max(key).alias("last")).where("first <> last").select("hash", "first")
    later = spans.where("not again").join(first, "hash").where(key != F.col("first")).select("doc", "of", "start", "end")
    cut = later.union(spans.where("again").select("doc", "of", "start", "end"))
    cut = stored(cut.groupBy("doc", "of").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("cut")))  # at most four per sentence
    drop_stored(spans)
    t = F.col("t")
    walk = F.aggregate(
        "cut",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.struct(
            F.greatest(a["at"], x["end"]).alias("at"),
            F.when(x["start"] > a["at"], F.concat(a["out"], F.substring(t, a["at"] + 1, x["start"] - a["at"]))).otherwise(a["out"]).alias("out"),
        ),
        lambda a: F.trim(F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t)))),
    )
    d = keyed.join(cut, ["doc", "of"], "left").select("row", "t", F.when(F.col("cut").isNotNull(), walk).otherwise(t).alias("new"))
    out = [F.col("new").alias(text) if c == text else F.col("row")[c].alias(c) for c in docs.columns if c != count]
    return d.select(*out, *([(F.length("t") - F.length("new")).cast("long").alias(count)] if count else []))
