"""Shared pieces of the text operators: scratch tables, word hashing over Arrow buffers, column helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and 0x09 to 0x0D.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_U = np.uint64
_RNG = np.random.default_rng(20240229)
#: A random value per byte (0 for white space, so that it adds nothing to a word's sum).
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[_SPACE] = 0
_POW_BITS = 12
_BASE = _U(0x9E3779B97F4A7C15)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


_POW = _powers(_BASE, 1 << _POW_BITS)
CHUNK_BYTES = 1 << 21


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets) of an Arrow string array, without copies; nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, off - off[0]


def _cuts(body: np.ndarray, offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of at most about `limit` bytes that start and end between words."""
    end, lo = len(body), 0
    while lo < end:
        hi = min(end, lo + limit)
        if hi < end:
            near = offsets[np.searchsorted(offsets, hi, "right") - 1]
            if near > lo:
                hi = int(near)
            else:  # inside one long text: go on to its next white space
                text_end = int(offsets[np.searchsorted(offsets, hi, "right")])
                while hi < text_end:
                    gap = np.flatnonzero(_SPACE[body[hi : min(text_end, hi + limit)]])
                    if len(gap):
                        hi += int(gap[0])
                        break
                    hi = min(text_end, hi + limit)
        yield lo, hi
        lo = hi


def word_hashes(texts: pa.Array, spans: bool = False, kinds: np.ndarray | None = None):
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of the texts, A-Z in lower case. With kinds, a number for each of the 256 bytes,
    words also end between bytes of kinds 1 and 2.

    Returns (hash uint64, row int32), and with spans also (start, end) as byte offsets into the joined texts. Words never
    reach over two texts. The arrays besides these are of bounded size: the bytes are read in chunks cut between words."""
    body, offsets = text_buffers(texts)
    hs, rows, ss, es = [], [], [], []
    for lo, hi in _cuts(body, offsets, CHUNK_BYTES):
        b = _LOWER[body[lo:hi]]
        word = ~_SPACE[b]
        first = word.copy()
        parted = ~word[:-1]
        if kinds is not None:
            kind = kinds[b]
            parted |= (kind[1:] ^ kind[:-1]) == 3
        first[1:] &= parted
        cut = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi)] - lo
        first[cut] = word[cut]
        starts = np.flatnonzero(first)
        if not len(starts):
            continue
        s0 = int(starts[0])
        size = np.diff(np.append(starts, len(b)))
        pos = np.arange(s0, len(b), dtype=np.int64) - np.repeat(starts, size)
        with np.errstate(over="ignore"):
            v = _BYTE[b[s0:]] * _POW[pos & ((1 << _POW_BITS) - 1)]
            if int(size.max()) > 1 << _POW_BITS:
                far = pos >> _POW_BITS
                v *= _powers(mix64(np.array([12345], np.uint64))[0] | _U(1), int(far.max()) + 1)[far]
            h = mix64(np.add.reduceat(v, starts - s0))
        hs.append(h)
        rows.append((np.searchsorted(offsets, starts + lo, "right") - 1).astype(np.int32))
        if spans:
            last = word.copy()
            last[:-1] &= ~word[1:] | first[1:]
            ss.append(starts + lo)
            es.append(np.flatnonzero(last) + 1 + lo)
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    out = (cat(hs, np.uint64), cat(rows, np.int32))
    return (*out, cat(ss, np.int64), cat(es, np.int64)) if spans else out


def row_bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Offsets of each row's run in a sorted array of row numbers."""
    return np.searchsorted(rows, np.arange(n + 1))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of at most about `limit` bytes of text (a longer text comes alone)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, off = text_buffers(batch.column(column))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for scratch tables: spark.checkpoint.dir. On a local master, where driver and executors share a disk, one of
    our own if it is unset; elsewhere that is an error, as executors would not see each other's files."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """The table written once to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame | None) -> None:
    """Delete the files of a table made by stored() that nothing reads any more."""
    if df is None:
        return
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/table-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fold(key: str | Column = "doc_id", n: int = 5) -> Column:
    """crc32 of the key as text, modulo n (a null key counts as the empty text)."""
    col = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
