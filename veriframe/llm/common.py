"""Helpers that several operators of this subpackage share.

Words are maximal runs of bytes other than space and the five ASCII controls
``\\t \\n \\v \\f \\r``; ``bytes.split()`` cuts exactly there.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe import ship

#: Java and RE2 both read this class as the word characters of the contracts.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that one task holds in numpy at a time, in bytes of text.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run on one machine."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="veriframe-"))


def unused(df: DataFrame, name: str) -> str:
    """The name, or the first longer one, that df has no column of (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veriframe-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(df: DataFrame) -> None:
    """Let Spark delete the shuffle files of finished queries now: it does so once the driver's JVM collects their plans."""
    df.sparkSession._jvm.System.gc()


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one slice holds about SLICE_BYTES of text (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = np.cumsum([len(x) if x is not None else 0 for x in map(_buffer, batch.column(text))])
        start = 0
        while start < n:
            before = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def _buffer(scalar):
    return scalar.as_buffer() if scalar.is_valid else None


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as bytes; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def list_rows(column: pa.ListArray) -> list[np.ndarray]:
    """The rows of a column of lists of numbers as arrays, without a Python object for each number."""
    at, values = column.offsets.to_pylist(), column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(at, at[1:])]


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_shingles(words: np.ndarray, k: int) -> np.ndarray:
    """A uint64 hash for each run of k word hashes (fewer words: one hash of the whole run)."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    k = min(k, n)
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out = mix64(out + words[i : n - k + 1 + i] + np.uint64(0x9E3779B97F4A7C15))
    return out


_PIECE = 1 << 20
_PRIME = 0x9E3779B97F4A7C15
_LETTER = mix64(np.arange(1, 257, dtype=np.uint64))


@cache
def _powers(base: int) -> np.ndarray:
    out = np.full(_PIECE + 1, base % (1 << 64), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _pieces(buf: bytes) -> Iterator[tuple[int, int]]:
    """Ranges of about _PIECE bytes that end after white space (later, if a word is longer)."""
    at = 0
    while at < len(buf):
        end = at + _PIECE
        if end < len(buf):
            gap = _GAP.search(buf, end - 4096) or _GAP.search(buf, at)
            end = gap.end() if gap else len(buf)
        yield at, min(end, len(buf))
        at = end


_GAP = re.compile(rb"[ \t\n\v\f\r]")


def word_hashes(buf: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (bytes) of every word of buf.

    A word's hash is a polynomial in its bytes, from one running sum over the buffer and a division by
    the power of its start; no Python object is made for a word.
    """
    found = []
    for low, high in _pieces(buf):
        b = np.frombuffer(buf, np.uint8, high - low, low)
        space = (b == 32) | ((b >= 9) & (b <= 13))
        edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
        start, end = edge[::2], edge[1::2]
        if len(b) <= _PIECE:
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LETTER[b] * _powers(_PRIME)[: len(b)])))
            h = (total[end] - total[start]) * _powers(pow(_PRIME, -1, 1 << 64))[start]
        else:  # a word longer than a piece
            h = np.array([_long_hash(buf[low + s : low + e]) for s, e in zip(start.tolist(), end.tolist(), strict=True)], np.uint64)
        found.append((mix64(h + (end - start).astype(np.uint64)), start + low, end + low))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _long_hash(word: bytes) -> int:
    """The same polynomial, piece after piece."""
    total, scale = 0, 1
    for at in range(0, len(word), _PIECE):
        b = np.frombuffer(word, np.uint8, min(_PIECE, len(word) - at), at)
        total = (total + scale * int((_LETTER[b] * _powers(_PRIME)[: len(b)]).sum(dtype=np.uint64))) % (1 << 64)
        scale = scale * pow(_PRIME, _PIECE, 1 << 64) % (1 << 64)
    return total


def end_to_end(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts: hash, start and end within their own text, and each text's first word."""
    h, start, end = word_hashes(b"\n".join(texts))
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    base = np.concatenate(([0], np.cumsum(size)))
    first = np.searchsorted(start, base)
    own = np.repeat(base[:-1], np.diff(first))
    return h, start - own, end - own, first


class WordHasher:
    """XXH64 of words with a bounded memo: words repeat, so most are looked up."""

    def __init__(self, limit: int = 400_000):
        self.memo: dict[bytes, int] = {}
        self.limit = limit

    def __call__(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        memo = self.memo
        if len(memo) > self.limit:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = xxhash.xxh64_intdigest(w, 42)
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def content_key(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds __h1, a hash of the text: with doc_id it names a row; repeated rows share it."""
    return df.withColumn("__h1", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
