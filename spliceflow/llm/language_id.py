"""Language identification of mixed-language text.

A model is learned from labelled texts in one pass: per language, counts of hashed letter n-grams (1 to 3 letters, word edges
included) and of the scripts its letters belong to. To label a text, its words (runs of letters) get a log-likelihood per
language; the script of a word narrows the candidates to languages that use that script; Viterbi over the words, with a penalty
for each switch, gives spans of one language. The text's language is the one with the most letters; its score is their share.

Defined cases: a null or letterless text is `und` with score 0 and no spans. A text whose scripts no language uses is scored with
all languages as candidates (equal scores: the one with the most training letters). With nothing to learn from, all is `und`.
Ties go to the alphabetically first language. Repeated rows count as often as they occur. Extra columns are kept;
ones with the names of results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_stored, slices, stored, text_buffers

UNKNOWN = "und"
BUCKETS = 1 << 16
#: First code points of the blocks that tell scripts apart (fixed values of the Unicode standard); other letters are Latin or common.
SCRIPT_STARTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"), (0x0E00, "thai"), (0x0E80, "lao"),
    (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, "other"),
    (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0x10000, "other"), (0x20000, "han"),
]
SCRIPTS = list(dict.fromkeys(name for _, name in SCRIPT_STARTS))
_STARTS = np.array([a for a, _ in SCRIPT_STARTS], dtype=np.uint32)
_SCRIPT_OF = np.array([SCRIPTS.index(n) for _, n in SCRIPT_STARTS], dtype=np.uint8)
_tables: list[np.ndarray] = []


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: its lower-case letter (0 if it is no letter), and its script. Built once in a worker."""
    if not _tables:
        lower = np.zeros(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                lower[c] = ord(low) if len(low) == 1 else c
        _tables.append(lower)
        _tables.append(_SCRIPT_OF[np.searchsorted(_STARTS, np.arange(0x110000, dtype=np.uint32), "right") - 1])
    return _tables[0], _tables[1]


@dataclass
class Words:
    """Words of a batch: hashed n-grams of every letter, and the words' places. Places are code points in the joined texts."""

    grams: np.ndarray  # (letters, 3) buckets
    first: np.ndarray  # first letter of each word, as an index into grams
    row: np.ndarray
    start: np.ndarray
    size: np.ndarray
    script: np.ndarray
    offsets: np.ndarray  # of the texts, in code points


def _words(texts: pa.Array) -> Words:
    lower, scripts = _letters()
    body, off = text_buffers(texts)
    cps = np.frombuffer(body.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    lead = np.cumsum(np.concatenate([[0], ((body & 0xC0) != 0x80).astype(np.int64)]))
    offsets = lead[off]
    if len(cps) != lead[-1]:  # bytes that are not UTF-8: take the texts one by one
        parts = [np.frombuffer(body[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(off, off[1:])]
        cps = np.concatenate(parts) if parts else cps[:0]
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    low = lower[cps]
    letter = low > 0
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    edge = offsets[:-1][offsets[:-1] < len(cps)]
    begins[edge] = letter[edge]
    at = np.flatnonzero(letter)
    x = low[at].astype(np.uint32)
    head = begins[at]
    tail = np.ones(len(at), dtype=bool)
    tail[:-1] = head[1:]
    prev = np.zeros_like(x)
    prev[1:] = x[:-1]
    prev[head] = 1
    nxt = np.zeros_like(x)
    nxt[:-1] = x[1:]
    nxt[tail] = 2
    with np.errstate(over="ignore"):
        g1 = x * np.uint32(0x85EBCA6B)
        g2 = (prev * np.uint32(0xC2B2AE35)) ^ (x * np.uint32(0x27D4EB2F)) ^ np.uint32(0x165667B1)
        g3 = g2 * np.uint32(5) ^ (nxt * np.uint32(0x9E3779B1))
        grams = np.stack([((g ^ (g >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16) for g in (g1, g2, g3)], axis=1)
    first = np.flatnonzero(head)
    start = at[first]
    size = np.diff(np.append(first, len(at)))
    return Words(grams, first, (np.searchsorted(offsets, start, "right") - 1).astype(np.int64), start, size, scripts[cps[start]] if len(start) else np.zeros(0, np.uint8), offsets)


@dataclass
class LanguageModel:
    """languages: sorted. logp: (BUCKETS, languages) log-likelihoods. allowed: (scripts, languages)."""

    languages: list[str]
    logp: np.ndarray
    allowed: np.ndarray
    penalty: float = 8.0


def train(docs: DataFrame, text: str = "text", lang: str = "lang", penalty: float = 8.0, smoothing: float = 0.5, script_share: float = 0.01, max_languages: int = 512) -> LanguageModel:
    """Learn from all rows of docs with a non-null language. One pass; each task sends a table of at most BUCKETS + scripts
    sums per language, summed before and after the shuffle. What comes to the driver is bounded by max_languages x BUCKETS
    numbers; more languages than max_languages are an error."""
    labelled = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text", 4 << 20):
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            w = _words(batch.column("text"))
            letters = np.repeat(np.arange(len(w.row)), w.size)
            for name in dict.fromkeys(langs):
                mine = (langs == name)[w.row] if len(w.row) else np.zeros(0, bool)
                s = sums.setdefault(name, np.zeros(BUCKETS + len(SCRIPTS), dtype=np.int64))
                s[:BUCKETS] += np.bincount(w.grams[mine[letters]].ravel(), minlength=BUCKETS) if len(letters) else 0
                s[BUCKETS:] += np.bincount(w.script[mine], weights=w.size[mine], minlength=len(SCRIPTS)).astype(np.int64)
        for name, s in sums.items():
            k = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array(k, pa.int32()), pa.array(s[k], pa.int64())], ["lang", "bucket", "n"])

    counted = stored(labelled.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    languages = sorted(r.lang for r in counted.select("lang").distinct().limit(max_languages + 1).collect())
    if len(languages) > max_languages:
        raise ValueError(f"more than {max_languages} languages: raise max_languages if the workers can hold so many tables of {BUCKETS} numbers")
    got = counted.toArrow()  # at most max_languages * (BUCKETS + scripts) rows
    drop_stored(counted)
    sums = np.zeros((BUCKETS + len(SCRIPTS), len(languages)))
    sums[got["bucket"].to_numpy(), np.searchsorted(np.array(languages, dtype=object), got["lang"].to_numpy())] = got["n"].to_numpy()
    grams, scripts = sums[:BUCKETS], sums[BUCKETS:]
    logp = np.log(grams + smoothing) - np.log(grams.sum(0) + smoothing * BUCKETS)
    allowed = scripts >= script_share * np.maximum(scripts.sum(0), 1)
    allowed[~allowed.any(1)] = True
    return LanguageModel(languages, logp.astype(np.float32), allowed, penalty)


def _viterbi(scores: np.ndarray, rows: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of each word, all rows at once: step t handles the t-th word of every row that has one."""
    n, k = scores.shape
    labels = np.zeros(n, dtype=np.int16)
    if n == 0 or k == 1:
        return labels
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    count = np.diff(np.append(first, n))
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    live = np.searchsorted(-count, -np.arange(1, count[0] + 1), "right")  # rows that have a t-th word
    stay = np.ones((n, k), dtype=bool)
    source = np.zeros(n, dtype=np.int16)
    v = scores[first].copy()
    for t in range(1, int(count[0])):
        m = live[t]
        at = first[:m] + t
        prev = v[:m]
        best = prev.argmax(1)
        jump = prev[np.arange(m), best] - penalty
        keep = prev >= jump[:, None]
        stay[at], source[at] = keep, best
        v[:m] = np.where(keep, prev, jump[:, None]) + scores[at]
    state = v.argmax(1).astype(np.int16)
    for t in range(int(count[0]) - 1, -1, -1):
        m = live[t]
        at = first[:m] + t
        labels[at] = state[:m]
        if t:
            state[:m] = np.where(stay[at, state[:m]], state[:m], source[at])
    return labels


def _label(model: LanguageModel, texts: pa.Array, with_spans: bool):
    w = _words(texts)
    n, k = len(texts), len(model.languages)
    letters = np.zeros((n, k))
    spans: list[list[dict]] = [[] for _ in range(n)]
    if len(w.row):
        scores = np.empty((len(w.row), k), dtype=np.float32)
        ends = np.append(w.first[1:], len(w.grams))
        lo = 0
        while lo < len(w.row):  # so many words at a time that the letters' scores take some 16 MB, or one word
            hi = max(lo + 1, int(np.searchsorted(ends, w.first[lo] + (1 << 22) // k, "right")))
            a, b = w.first[lo], ends[hi - 1]
            per_letter = model.logp[w.grams[a:b, 0]]
            per_letter += model.logp[w.grams[a:b, 1]]
            per_letter += model.logp[w.grams[a:b, 2]]
            scores[lo:hi] = np.add.reduceat(per_letter, w.first[lo:hi] - a, axis=0)
            lo = hi
        scores = np.where(model.allowed[w.script], scores, scores.min(1, keepdims=True) - 4 * model.penalty)
        got = _viterbi(scores, w.row, model.penalty)
        np.add.at(letters, (w.row, got), w.size)
        if with_spans:
            change = np.concatenate([[True], (got[1:] != got[:-1]) | (w.row[1:] != w.row[:-1])])
            a = np.flatnonzero(change)
            b = np.append(a[1:], len(got)) - 1
            for i, j in zip(a, b):
                r = int(w.row[i])
                spans[r].append({"start": int(w.start[i] - w.offsets[r]), "end": int(w.start[j] + w.size[j] - w.offsets[r]), "lang": model.languages[got[i]]})
    total = letters.sum(1)
    best = letters.argmax(1)
    names = [model.languages[b] if t > 0 else UNKNOWN for b, t in zip(best, total)]
    score = np.where(total > 0, letters.max(1) / np.maximum(total, 1), 0.0)
    return names, score, spans


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str | Column] | None = None, with_spans: bool = True) -> DataFrame:
    """docs (or its columns `keep`) with lang_pred, score and, if asked for, spans: array of (start, end, lang), in code points.
    No shuffle; texts are handled in slices of bounded size."""
    new = {"lang_pred", "score", *(["spans"] if with_spans else [])}
    kept = docs.select(*(keep if keep is not None else [c for c in docs.columns if c not in new]), F.col(text).cast("string").alias("__text"))
    carry = kept.schema.fieldNames()[:-1]
    fields = [*kept.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
    if with_spans:
        fields.append(T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())]))))
    known = bool(model.languages)
    given = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = given.value
        for batch in slices(batches, "__text", 4 << 20):
            names, score, spans = _label(model, batch.column("__text"), with_spans) if known else ([UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows), [[] for _ in range(batch.num_rows)])
            cols = [*(batch.column(i) for i in range(len(carry))), pa.array(names, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(spans, span)] if with_spans else []), [*carry, "lang_pred", "score", *(["spans"] if with_spans else [])])

    return kept.mapInArrow(run, T.StructType(fields))


