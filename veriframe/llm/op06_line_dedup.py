"""Line dedup by winnowing over line hashes.

A document is its sequence of lines with a word, white space folded. Two consecutive lines are a gram, two consecutive grams a window (a
run of ``MIN_LINES`` = 3 lines), and each window selects its least gram (the first of equals): equal runs of three lines select the same gram at the same
place, and about two grams of three are selected. A selected gram is one fingerprint, with the line before it where the window on its left
selected it and the line after it where the one on its right did; gram and line together are that window. So a window meets the first
place of the very same window, and no stranger that shares only the gram can stand in between. Lines and pairs of lines of ``MIN_WORDS`` words or more
are fingerprints of their own.

Positions are joined: each place of a fingerprint but the first (order: doc_id, hash of the text, position) matches the first. Matches are extended both
ways along their diagonal (same two documents, same distance of positions) to runs, and the later run is deleted. A run of three lines or more, or of 40
words, that stands earlier anywhere is made of such windows, so all of its lines go, and no others.

The first place is found by an aggregation with map-side combine and joined back, which is linear however common a line is; a
fingerprint never meets all its other places. Matches of one pair of documents are one array, as long as the shorter document at most.

Null text counts as empty; texts without a line of words pass unchanged; repeated rows (same doc_id and
text) are one document and stay alike; null doc_ids sort first; other columns pass through. Lines without
a word are never deleted. Matches within one document count: the first occurrence stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriframe.llm.common import WordHasher, content_key, hash_shingles, materialize, slices, texts_of, unused

MIN_LINES = 3
MIN_WORDS = 40


def worded(text: bytes) -> list[list[bytes]]:
    return [w for w in map(bytes.split, text.split(b"\n")) if w]


def marks(lines: list[list[bytes]], hasher) -> Iterator[tuple]:
    """(print, pos, n, before, after) of a document's fingerprints: n = 2 with a line before or after, or heavy lines and pairs without."""
    h = hasher([b" ".join(x) for x in lines])
    total = np.concatenate(([0], np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)))))
    for n in (1, 2):
        if len(h) < n:
            return
        grams, words = hash_shingles(h, n).view(np.int64), total[n:] - total[:-n]
        chosen = np.flatnonzero(words >= MIN_WORDS)
        for p, value in zip(chosen.tolist(), grams[chosen].tolist(), strict=True):
            yield value, p, n, None, None
    if len(h) < MIN_LINES:
        return
    first = np.concatenate((grams[:-1] <= grams[1:], [False]))  # a window takes its first gram, or else its second
    second = np.concatenate(([False], ~first[:-1]))
    line = h.view(np.int64).tolist()
    chosen = np.flatnonzero(first | second)
    for p, value, left, right in zip(chosen.tolist(), grams[chosen].tolist(), second[chosen].tolist(), first[chosen].tolist(), strict=True):
        yield value, p, 2, line[p - 1] if left else None, line[p + 2] if right else None


_MARKS = "doc_id long, __h1 long, print long, pos int, n int, before long, after long"


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row for each fingerprint of docs (doc_id, __h1, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        wide, narrow = pa.int64(), pa.int32()
        schema = pa.schema([("doc_id", wide), ("__h1", wide), ("print", wide), ("pos", narrow), ("n", narrow), ("before", wide), ("after", wide)])
        for b in slices(batches):
            ids = zip(b.column("doc_id").to_pylist(), b.column("__h1").to_pylist(), texts_of(b), strict=True)
            rows = [(d, h, *m) for d, h, t in ids for m in marks(worded(t), hasher)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "__h1", "text").mapInArrow(run, _MARKS)


def _windows(found: DataFrame) -> DataFrame:
    """doc_id, __h1, print, side, line, from, n: what meets its first place. side: -1 and 1 for the line before and after, 0 for none."""
    place = lambda side, line, at, n: F.struct(F.lit(side).alias("side"), line.alias("line"), at.cast("int").alias("from"), n.cast("int").alias("n"))
    before, after, pos, n = (F.col(c) for c in ("before", "after", "pos", "n"))
    heavy = F.when(before.isNull() & after.isNull(), place(0, F.lit(0).cast("long"), pos, n))
    each = F.array(heavy, F.when(before.isNotNull(), place(-1, before, pos - 1, n + 1)), F.when(after.isNotNull(), place(1, after, pos, n + 1)))
    return found.select("doc_id", "__h1", "print", F.inline(F.array_compact(each)))


def matches(docs: DataFrame) -> DataFrame:
    """doc_id, __h1, from, n and first (doc_id, __h1, from): each later place of a fingerprint of docs and the first one."""
    found = _windows(materialize(fingerprints(docs)))  # repeated rows repeat their marks, which changes no result
    place, key = F.struct("doc_id", "__h1", "from"), ["n", "side", "print", "line"]
    first = found.groupBy(*key).agg(F.min(place).alias("first"), F.count("*").alias("times")).filter("times > 1").select(*key, "first")
    first = materialize(first)  # a join right above the aggregation couldn't split a hot fingerprint's rows
    return found.join(first, key).filter(~place.eqNullSafe(F.col("first"))).select("doc_id", "__h1", "from", "n", "first")


def _extended(ranges: Column) -> Column:
    """Ranges of one diagonal, in order, with those that touch or overlap as one."""
    start = F.array().cast("array<struct<from:int,to:int>>")

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["from"].alias("from"), F.greatest(last["to"], x["to"]).alias("to"))
        return F.when(x["from"] <= last["to"] + 1, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(ranges), start, step)


def repeated_runs(docs: DataFrame) -> DataFrame:
    """doc_id, __h1, runs: the ranges (from, to) of worded lines to delete, for documents that have any."""
    found = matches(docs).select("doc_id", "__h1", "first", (F.col("from") - F.col("first.from")).alias("shift"), F.struct(F.col("from"), (F.col("from") + F.col("n") - 1).cast("int").alias("to")).alias("range"))
    diagonals = found.groupBy("doc_id", "__h1", F.col("first.doc_id").alias("of"), F.col("first.__h1").alias("of_text"), "shift").agg(F.collect_set("range").alias("ranges"))
    runs = diagonals.select("doc_id", "__h1", F.explode(_extended(F.col("ranges"))).alias("run"))
    return runs.groupBy("doc_id", "__h1").agg(F.collect_set("run").alias("runs"))


def without(text: bytes, runs: list[dict]) -> tuple[bytes, int, int]:
    """The text without the worded lines in runs, how many worded lines it had, how many went."""
    gone = {i for r in runs for i in range(r["from"], r["to"] + 1)}
    kept, k = [], 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            k += 1
            if k - 1 in gone:
                continue
        kept.append(line)
    return b"\n".join(kept), k, len(gone)


def dedup_lines(docs: DataFrame, lines: str = "n_lines", deleted: str = "n_deleted") -> DataFrame:
    """docs with its text deduplicated, and two columns more: worded lines before, and how many of them went."""
    if {lines, deleted} & set(docs.columns):
        raise ValueError(f"docs has a column {lines} or {deleted}: give other names")
    key = lambda: F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), key().alias("row"))
    # written first: the join then has shuffles of its own, and can split a row that is repeated often
    runs = materialize(repeated_runs(content_key(docs.select("doc_id", "text"))).select(F.struct("doc_id", F.col("__h1").alias("h")).alias("row"), "runs"))
    joined = whole.join(runs.hint("merge"), "row", "left").select("doc.*", F.col("runs").alias(unused(docs, "runs")))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            new, total, gone = [], [], []
            for raw, t, r in zip(b.column(at).to_pylist(), texts_of(b), b.column(b.num_columns - 1).to_pylist(), strict=True):
                x, k, g = without(t, r or ())
                new.append(None if raw is None else x.decode() if g else raw)
                total.append(k)
                gone.append(g)
            columns = [pa.array(new, b.column(at).type) if i == at else b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], [*b.schema.names[:-1], lines, deleted])

    return joined.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(lines, T.LongType()), T.StructField(deleted, T.LongType())]))
