"""SimHash near-dedup with covering locality-sensitive hashing.

A fingerprint has 64 bits, from the XXH64 of all word shingles of the lower-cased text. Fingerprints
link at RADIUS or fewer differing bits; documents in one connected component are near copies.

Candidates. Bit i gets a non-zero vector m(i) of RADIUS+1 bits. For each non-zero v the table v keeps
the bits with <m(i), v> = 1 (mod 2) and masks the others. The vectors of at most RADIUS differing bits
don't span the space, so some v is orthogonal to all of them: that table masks every difference, and the
pair meets in one bucket. So no pair within the radius is missed, with 2**(RADIUS+1) - 1 tables.

The pipeline's stage, at a similarity of 0.8, is in ``near_copies``, which tells why masks can't serve there.

Only distinct fingerprints are dealt (copies share one), and buckets of up to ``PAIRWISE`` members are
compared pair by pair. A larger bucket is never paired: each of its members is linked to the balls of
radius RADIUS/2 around it over the bits that the table masks; two members share a ball's point exactly
if they differ in RADIUS bits or fewer. That is linear in the bucket, and no link is lost.

Null and empty texts, and texts without a word, have fingerprint zero and are linked like any other.
Repeated rows get equal rows in the result. Null doc_ids keep their row; they never name a component
unless all its members are null. Long texts are hashed whole. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import materialize, slices, texts_of
from veriframe.llm.components import components

SHINGLE = 3
RADIUS = 2
PAIRWISE = 16
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """The fingerprint as an unsigned number."""
    import xxhash

    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(k, len(words))
    hashed, cut = xxhash.xxh64_intdigest, len(words) - k + 1
    bits = np.zeros(64, np.int64)
    first, last = starts[:cut].tolist(), ends[k - 1 :].tolist()
    for at in range(0, cut, 65536):  # a bounded table of bits, however long the text
        h = np.array([hashed(joined[s:e], 42) for s, e in zip(first[at : at + 65536], last[at : at + 65536], strict=True)], dtype=">u8")
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > cut).tobytes(), "big")


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long), one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.array([fingerprint(t, k) for t in texts_of(b)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def masks(radius: int = RADIUS) -> list[int]:
    """The bits that each table keeps, as signed longs."""
    size = 1 << (radius + 1)
    vector = [1 + i % (size - 1) for i in range(64)]
    kept = [sum(1 << i for i in range(64) if (vector[i] & v).bit_count() & 1) for v in range(1, size)]
    return [m - (1 << 64) if m >> 63 else m for m in kept]


def links(fps: DataFrame, radius: int = RADIUS, pairwise: int = PAIRWISE) -> DataFrame:
    """fps (fp, distinct) -> (a, b): edges whose components are those of all pairs within the radius."""
    if radius % 2:
        raise ValueError("the radius must be even: balls of half of it are shared")
    table = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.lit(m).alias("m")) for i, m in enumerate(masks(radius))]))
    dealt = fps.select("fp", table.alias("x")).select("fp", "x.t", F.col("x.m").alias("mask"), F.col("fp").bitwiseAND(F.col("x.m")).alias("key"))
    # counts are written first: a join right above their aggregation couldn't split a hot bucket
    many = materialize(dealt.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1"))
    dealt = materialize(dealt.join(many, ["t", "key"]))
    small = dealt.filter(F.col("n") <= pairwise)
    x, y = small.select("t", "key", F.col("fp").alias("a")), small.select("t", "key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = x.join(y, ["t", "key"]).filter((F.col("a") < F.col("b")) & near).select("a", "b")
    points = dealt.filter(F.col("n") > pairwise).select("fp", "t", "mask", F.col("fp").alias("point"))
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
    for _ in range(radius // 2):
        free = F.filter(flips, lambda bit: bit.bitwiseAND(F.col("mask")) == 0)
        points = points.select("fp", "t", "mask", F.explode(F.concat(F.array(F.lit(0).cast("long")), free)).alias("bit"), "point").select("fp", "t", "mask", F.col("point").bitwiseXOR(F.col("bit")).alias("point"))
    # a point is a number of 64 bits, whatever table it comes from: fingerprints that share one are within the radius
    points = points.select("fp", "point").distinct()
    points = materialize(points)
    hub = materialize(points.groupBy("point").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1"))
    stars = points.join(hub.select("point", "b"), "point").filter("fp != b").select(F.col("fp").alias("a"), "b")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS, pairwise: int = PAIRWISE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable) for each row of docs."""
    rows = materialize(fingerprints(docs, k))
    by_fp = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = materialize(components(links(by_fp.select("fp"), radius, pairwise)))
    named = by_fp.join(found, F.col("fp") == F.col("node"))
    root = materialize(named.groupBy("root").agg(F.min("least").alias("component")))
    of_fp = by_fp.join(found, F.col("fp") == F.col("node"), "left").join(root, "root", "left").select(F.col("fp").alias("f"), F.coalesce("component", "least").alias("component_id"))
    of_fp = materialize(of_fp)  # the join below then has shuffles of its own, and can split a hot fingerprint's rows
    out = rows.join(of_fp, F.col("fp") == F.col("f"), "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
