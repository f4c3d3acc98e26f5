"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

Words are lower-cased and stripped of ASCII punctuation; shingles are five words, each weighing the bytes of its
words, so runs of short common words count for less. For each length of item (in words) the windows of that length in
a document are fingerprinted with a weighted SimHash of 64 bits. The items' fingerprints stand in BLOCKS inverted
lists, one for each block of 8 bits. A query looks up every value within BLOCK_RADIUS bits of its own block in each
list; if two fingerprints differ in at most RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1 bits, some block differs in
BLOCK_RADIUS or fewer, so every item within the radius is met. Those within it are verified with the exact weighted
(Ruzicka) similarity of the two shingle multisets: 0.8 or more matches.

Windows that can't reach the threshold are skipped by an exact bound: the weight that a window shares with
any item is at most that of its shingles that occur in the benchmark, and a match needs 0.8 of the item's.

Documents are read in place (no shuffle). Items are a stated query set, taken in blocks of about ``BLOCK_CHARS``
characters of text, packed by measured size: one broadcast index and one pass for each block, so a benchmark of any
size works; a single item that is longer is a block of its own. A worker holds the index once: some 250 bytes for each
word of a block, so about 0.35 GB for a full one of 8 million characters, beside a slice of 8 MB of documents.

Items of fewer than ``SHINGLE`` words have no shingle, are no evidence and match nothing; ``too_short`` lists them. Null
texts count as empty; items that repeat id and text are one; equal texts under several ids match each; repeated
documents each give their rows; an empty table of either kind gives no match; long texts are read whole; other columns,
whatever their names, are ignored by ``matches`` and kept by ``clean``.
"""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import end_to_end, hash_shingles, slices

SHINGLE = 5
THRESHOLD = 0.8
BLOCKS = 8
BLOCK_RADIUS = 1
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
BLOCK_CHARS = 8_000_000
#: Windows looked up at a time.
CHUNK = 2048
_NEAR = np.array([sum(1 << i for i in c) for r in range(BLOCK_RADIUS + 1) for c in itertools.combinations(range(8), r)], np.uint8)
_BITMAP = 20


#: ASCII punctuation to spaces, so that quotes and stops around a passage don't hide it.
_PLAIN = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def folded(text: str | None) -> bytes:
    return (text or "").lower().encode().translate(_PLAIN)


def signed_bits(shingles: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A row of 64 numbers for each shingle: its weight, negative where its hash has a 0."""
    bits = np.unpackbits(shingles.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
    return (2 * bits - 1) * weight[:, None].astype(np.int32)


def to_blocks(totals: np.ndarray) -> np.ndarray:
    """Fingerprints as BLOCKS bytes, from sums of signed bits."""
    return np.packbits(totals > 0, axis=-1)


def similarity(a: Counter, b: Counter, weight: dict) -> float:
    """Weighted (Ruzicka) similarity of two multisets of shingles."""
    shared = sum(min(n, b[s]) * weight[s] for s, n in a.items() if s in b)
    union = sum(n * weight[s] for s, n in a.items()) + sum(n * weight[s] for s, n in b.items()) - shared
    return shared / union if union else 0.0


class Tables:
    """The multi-index of the items of one length: for each block, the items in order of its value.

    The lists hold a number for each item and block. Probes of a window are neighbouring values of its blocks; the
    items of all probes of many windows are gathered at once.
    """

    def __init__(self, members: list[int], prints: np.ndarray):
        self.members, self.prints = np.array(members), prints
        self.order = np.argsort(prints, axis=0, kind="stable").astype(np.int32)
        counts = np.stack([np.bincount(prints[:, block], minlength=256) for block in range(BLOCKS)])
        self.start = np.concatenate((np.zeros((BLOCKS, 1), np.int64), np.cumsum(counts, axis=1)), axis=1)

    def within(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, differing bits) for every pair within RADIUS, in order of windows."""
        out = [self._within(windows[at : at + CHUNK], at) for at in range(0, len(windows), CHUNK)]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _within(self, windows: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = []
        for block in range(BLOCKS):
            probes = windows[:, block, None] ^ _NEAR
            low = self.start[block][probes].ravel()
            size = self.start[block][probes.astype(np.int64) + 1].ravel() - low
            at = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
            window = np.repeat(np.repeat(np.arange(len(windows)), len(_NEAR)), size)
            found.append(window * len(self.members) + self.order[at, block])
        w, i = np.divmod(np.unique(np.concatenate(found)), len(self.members))
        bits = np.bitwise_count(windows[w] ^ self.prints[i]).sum(axis=1)
        good = bits <= RADIUS
        return w[good] + base, self.members[i[good]], bits[good]


class Index:
    """Items by length: their multisets, weights and blocks."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items, self.weight = [], {}
        by_length = defaultdict(list)
        for item_id, text in items:
            words, start, end, _ = end_to_end([folded(text)])
            if len(words) < SHINGLE:
                continue
            shingles = hash_shingles(words, SHINGLE)
            weight = shingle_weight(end - start)
            self.weight |= dict(zip(shingles.tolist(), weight.tolist(), strict=True))
            by_length[len(shingles)].append(len(self.items))
            blocks = to_blocks(signed_bits(shingles, weight).sum(axis=0))
            self.items.append((item_id, Counter(shingles.tolist()), int(weight.sum()), blocks))
        self.known = np.array(sorted(self.weight), np.uint64)
        self.bitmap = np.zeros(1 << _BITMAP, bool)
        self.bitmap[(self.known >> np.uint64(64 - _BITMAP)).astype(np.int64)] = True
        self.lengths = {n: (min(self.items[i][2] for i in members), Tables(members, np.stack([self.items[i][3] for i in members]))) for n, members in by_length.items()}

    def occurs(self, shingles: np.ndarray) -> np.ndarray:
        """Which shingles are in the benchmark."""
        hit = self.bitmap[(shingles >> np.uint64(64 - _BITMAP)).astype(np.int64)]
        at = np.flatnonzero(hit)
        if len(at):
            place = np.minimum(np.searchsorted(self.known, shingles[at]), len(self.known) - 1)
            hit[at] = self.known[place] == shingles[at]
        return hit

    def search(self, sizes: np.ndarray, shingles: np.ndarray, hit: np.ndarray) -> list[tuple]:
        """(item_id, similarity, from word, words, differing bits), the best window for each item."""
        weight = shingle_weight(sizes)
        heavy = np.concatenate(([0], np.cumsum(weight * hit)))
        best: dict[int, tuple] = {}
        for n, (least, tables) in self.lengths.items():
            n = min(n, len(shingles))
            starts = np.flatnonzero(heavy[n:] - heavy[:-n] >= THRESHOLD * least)
            if not len(starts):
                continue
            for group in np.split(starts, np.flatnonzero(np.diff(starts) > n) + 1):
                low, high = int(group[0]), int(group[-1]) + n
                sums = np.concatenate((np.zeros((1, 64), np.int64), np.cumsum(signed_bits(shingles[low:high], weight[low:high]), axis=0, dtype=np.int64)))
                prints = to_blocks(sums[group - low + n] - sums[group - low])
                at = -1
                for w, i, bits in zip(*(x.tolist() for x in tables.within(prints)), strict=True):
                    if w != at:
                        at, s = w, int(group[w])
                        own = Counter(shingles[s : s + n].tolist())
                        local = _Both(self.weight, dict(zip(shingles[s : s + n].tolist(), weight[s : s + n].tolist(), strict=True)))
                    score = similarity(self.items[i][1], own, local)
                    if score >= THRESHOLD and (i not in best or score > best[i][1]):
                        best[i] = (self.items[i][0], score, s, n + SHINGLE - 1, bits)
        return list(best.values())


class _Both:
    """Weights of two dicts; they agree where both have a shingle."""

    def __init__(self, a: dict, b: dict):
        self.a, self.b = a, b

    def __getitem__(self, s):
        return self.b[s] if s in self.b else self.a[s]


def shingle_weight(sizes: np.ndarray) -> np.ndarray:
    """Bytes of the words of each shingle."""
    sums = np.concatenate(([0], np.cumsum(sizes)))
    k = min(SHINGLE, len(sizes))
    return sums[k:] - sums[:-k] if k else sums[:0]


def scan(texts: list[str | None], index: Index) -> Iterator[list[tuple]]:
    """The matches of each text. Texts are laid end to end, so the lookup is one vector operation."""
    words, start, end, first = end_to_end([folded(t) for t in texts])
    shingles = hash_shingles(words, SHINGLE) if len(words) >= SHINGLE else np.zeros(0, np.uint64)
    hit = index.occurs(shingles) if len(index.items) and len(shingles) else np.zeros(len(shingles), bool)
    hits = np.concatenate(([0], np.cumsum(hit)))
    for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        last = high - SHINGLE + 1
        if last <= low or hits[last] == hits[low]:
            yield []
        else:
            yield index.search((end - start)[low:high], shingles[low:last], hit[low:last])


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null").distinct()


def too_short(benchmark: DataFrame) -> DataFrame:
    """item_id, text of the items that have no shingle and so match nothing."""
    plain = F.regexp_replace("text", r"[\x00-\x7F&&[^A-Za-z0-9]]+", " ")
    return _items(benchmark).filter(F.regexp_count(plain, F.lit(r"[^\x20]+")) < SHINGLE)


def _indexes(benchmark: DataFrame, block_chars: int) -> Iterator[Index]:
    """Items fall into many small parts by hash; parts are packed into blocks by their sizes."""
    items = _items(benchmark)
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, 16 * total // block_chars)))
    packed, room = [], 0
    for r in items.groupBy(part.alias("part")).agg(F.sum(F.length("text")).alias("size")).orderBy("part").toLocalIterator():
        if r["size"] > room or not packed:
            packed.append([])
            room = block_chars
        packed[-1].append(r["part"])
        room -= r["size"]
    for parts in packed:
        own = items if len(packed) == 1 else items.filter(part.between(parts[0], parts[-1]))  # parts come in order
        yield Index([tuple(r) for r in own.toLocalIterator()])


MATCHES = "doc_id long, item_id long, similarity double, from_word long, n_words long, differing_bits int"


def matches(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each document and item that match, with the item's best window."""
    spark, found = docs.sparkSession, None
    for index in _indexes(benchmark, block_chars):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                scanned = scan(b.column("text").to_pylist(), shared.value)
                rows = [(d, *m) for d, ms in zip(b.column("doc_id").to_pylist(), scanned, strict=True) for m in ms]
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int32()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in MATCHES.split(", ")])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, MATCHES)
        found = part if found is None else found.union(part)
    return found if found is not None else spark.createDataFrame([], MATCHES)


def clean(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs that match no item, with all their columns; one narrow pass for each block."""
    for index in _indexes(benchmark, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                yield b.filter(pa.array([not m for m in scan(b.column("text").to_pylist(), shared.value)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
