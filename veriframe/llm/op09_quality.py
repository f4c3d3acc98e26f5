"""Quality rules: compression bands over whole documents and fixed chunks.

Base rules count words, symbols, repeated lines and repeated word windows. The method itself
compresses each text with zstandard, whole and in chunks of ``CHUNK`` bytes. Text that compresses
far better than prose repeats itself; text that hardly compresses is noise. Short texts compress
worse than long ones (headers, an empty window), so the limits are set for bands of length.

One narrow pass, no shuffle: every row is judged alone. Null text counts as empty, empty text has
no word and fails, repeated rows get the same verdict, an empty table gives an empty result, and
columns besides ``doc_id`` and ``text`` are never looked at. Texts of any length are compressed
whole; memory is one slice of rows (see ``common.slices``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veriframe.llm.common import slices, texts_of

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
CHUNK = 4096
LEVEL = 3
#: (bytes below, least ratio, greatest ratio) of raw to compressed bytes; the last has no end.
BANDS = ((256, 0.0, 2.4), (1024, 1.05, 3.2), (4096, 1.25, 4.2), (16384, 1.45, 5.0), (None, 1.5, 8.0))
#: A chunk is judged by the band of its own length; this share of bad chunks rejects the document.
BAD_CHUNKS = 0.5

COLUMNS = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, bad_chunk_share double, reason string"
)


def band(n_bytes: int) -> tuple[float, float]:
    return next((lo, hi) for top, lo, hi in BANDS if top is None or n_bytes < top)


def compression(text: bytes, compressor) -> tuple[float, float]:
    """The ratio of the whole text, and the share of its chunks that fall out of their band."""
    if not text:
        return 0.0, 0.0
    whole = len(text) / len(compressor.compress(text))
    if len(text) <= CHUNK:
        lo, hi = band(len(text))
        return whole, float(not lo <= whole <= hi)
    chunks = [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]
    if len(chunks[-1]) < CHUNK // 4:  # too short to tell apart
        chunks[-2:] = [chunks[-2] + chunks[-1]]
    bad = 0
    for c in chunks:
        lo, hi = band(len(c))
        bad += not lo <= len(c) / len(compressor.compress(c)) <= hi
    return whole, bad / len(chunks)


def repeat_words(docs: list[list[bytes]]) -> np.ndarray:
    """For each document the words that lie in windows of WINDOW words found twice or more in it.

    Exact: windows get ranks by doubling (pairs of words, pairs of pairs, ...), no hashing.
    """
    counts = np.array([len(d) for d in docs], np.int64)
    total = int(counts.sum())
    out = np.zeros(len(docs), np.int64)
    if not total:
        return out
    flat = [w for d in docs for w in d]
    ids = {w: i for i, w in enumerate(set(flat))}
    rank = np.fromiter(map(ids.__getitem__, flat), np.int64, total)
    doc = np.repeat(np.arange(len(docs)), counts)
    starts = np.cumsum(counts) - counts
    step = 1
    while step < WINDOW:
        pair = np.full(total, -1, np.int64)
        pair[: total - step] = rank[: total - step] * (int(rank.max()) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1]
        step *= 2
    whole = np.flatnonzero(np.arange(total) - starts[doc] <= counts[doc] - WINDOW)
    if not len(whole):
        return out
    _, back, seen = np.unique(doc[whole] * (int(rank.max()) + 1) + rank[whole], return_inverse=True, return_counts=True)
    hit = whole[seen[back] > 1]
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + WINDOW, -1)
    np.add.at(out, doc[np.cumsum(edge[:total]) > 0], 1)
    return out


def dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def judge(texts: list[bytes]) -> list[tuple]:
    """The columns after doc_id, for each text."""
    import zstandard

    compressor = zstandard.ZstdCompressor(level=LEVEL)
    words = [t.split() for t in texts]
    repeats = repeat_words(words)
    rows = []
    for t, w, again in zip(texts, words, repeats.tolist(), strict=True):
        n = len(w)
        inner = b"".join(w)
        points = len(inner) - len(inner.translate(None, _LEADS)) if not inner.isascii() else len(inner)
        symbols = sum(map(t.count, _SYMBOLS))
        failed = n < MIN_WORDS or 100 * again > MAX_REPEAT_PERCENT * n
        whole, bad = compression(t, compressor)
        lo, hi = band(len(t))
        reason = "words" if n < MIN_WORDS else "windows" if failed else "repetitive" if whole > hi else "incompressible" if whole < lo else "chunks" if bad > BAD_CHUNKS else None
        rows.append((n, points, symbols, dup_lines(t), again, failed, reason is None, whole, bad, reason))
    return rows


#: Bytes that begin a code point in UTF-8.
_LEADS = bytes([*range(0x80), *range(0xC0, 0x100)])
_SYMBOLS = [bytes([c]) for c in SYMBOLS]


def quality(docs: DataFrame) -> DataFrame:
    """A verdict for each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2 + [pa.string()]
        names = [x.split()[0] for x in COLUMNS.split(", ")]
        for b in slices(batches):
            columns = zip(*judge(texts_of(b)), strict=True)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, COLUMNS)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, with all their columns, in the same narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array([row[6] for row in judge(texts_of(b))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
