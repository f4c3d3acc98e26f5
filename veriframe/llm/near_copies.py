"""Near copies by the similarity of word shingles: the pipeline's setting of SimHash near-dedup.

A document is the set of its runs of SHINGLE words, ASCII letters lower-cased; a shorter text is one run.
Documents whose sets have a Jaccard similarity of SIMILARITY or more link, and documents in one connected
component are near copies. Texts without a word are copies of each other.

Candidates come from SimHash with the covering masks of ``op03_simhash``. One fingerprint of 64 bits can't hold 0.8: two of them differ
in 10 bits on the average and in up to 16 of nearly all pairs, and masks that cover 16 bits are 2**17 - 1 tables. So a set
gets a longer fingerprint of ``parts`` parts, each dealt under the 7 masks that cover ``RADIUS`` differing bits. Sets meet that differ in RADIUS bits or
fewer in any part; by the pigeonhole that is every pair that differs in fewer than ``(RADIUS + 1) * parts`` bits in all.
At 0.8 a bit differs with probability FLIP, and there are as many parts as leave a pair at 0.8 out with probability
MISS, a more similar pair less often (``layout``). Parts have WIDTH bits, or as many as keep
a bucket's share of unrelated sets at CROWD or so: buckets are dealt in time and space linear in the rows up to 10 million sets.
Sets that meet go on if two words of their fingerprints differ in NEAR bits or fewer, which a pair at 0.8 exceeds with
probability 1e-7, and their sizes allow the similarity.

Every candidate's similarity is then taken from the whole sets. Equal sets are dealt once. First each set is compared with the
nearest one before it in each bucket of the first parts, so that the sets of a large group are mostly in one component. Then all parts are dealt, and buckets of up to
``PAIRWISE`` sets are compared pair by pair, but for pairs of one component. Larger buckets of several components, and those where a set
is near FEW others or more, are not paired: their sets, each once whatever the number of its buckets, meet by the rarest classes of
shingles that they hold in common (``_may_link``), an exact filter that leaves out no pair at SIMILARITY.

Repeated rows are copies; of the rows of a component that with the least doc_id stays (null last), of equal ids that
with the least hash of the text; rows that repeat id and text are one. Null text counts as empty; long texts are read
whole; an empty table gives an empty one; other columns pass through, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.llm.common import discard, end_to_end, hash_shingles, materialize, mix64, release, slices, texts_of
from veriframe.llm.components import components
from veriframe.llm.op03_simhash import RADIUS, masks

SHINGLE = 5
#: 0.8 as a fraction, so that the comparison is exact.
SIMILARITY = (4, 5)
PAIRWISE, FEW = 128, 2
#: Probability that a bit differs at SIMILARITY: the angle of two sets of equal size, as a part of the half turn. For a pair at SIMILARITY to meet nowhere.
FLIP, MISS = math.acos(8 / 9) / math.pi, 1e-6
#: Differing bits of the two words that go with a set, and steps of a 16th of a power of two between sizes; one step more than 0.8 takes.
NEAR, STEPS = 40, 6
#: Parts dealt at once, so that a round's shuffle is bounded.
ROUND = 9
#: Bits of a part at least, and unrelated sets in a bucket up to which that is enough.
WIDTH, CROWD = 32, 32
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_WORDS = mix64(np.arange(1, 1025, dtype=np.uint64))
_LANES = np.uint64(0x0101010101010101)
#: Counts as a shingle of every set: sets of four and five would differ in more bits without it.
_COMMON = np.uint64(0x5851F42D4C957F2D)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct hashes of each text's shingles, in order."""
    words, _, _, first = end_to_end([t.translate(_LOWER) for t in texts])
    runs = hash_shingles(words, SHINGLE)
    ends = zip(first[:-1].tolist(), first[1:].tolist(), strict=True)
    return [np.unique(runs[a : b - SHINGLE + 1] if b - a >= SHINGLE else hash_shingles(words[a:b], SHINGLE)) for a, b in ends]


def layout(rows: int) -> tuple[int, int]:
    """(parts, width of a part in bits) of the fingerprints of so many rows.

    A mask keeps four of seven bits. Bit i has vector 1 + i % 7; a pair meets if the vectors of its differing bits lie on a line.
    """
    width = min(64, max(WIDTH, math.ceil(7 / 4 * math.log2(max(rows, 1) / CROWD))))
    clean = [(1 - FLIP) ** len(range(v, width, 7)) for v in range(7)]
    meets = 0.0
    for differ in range(1 << 7):
        if any(all((v + 1 & m).bit_count() % 2 == 0 for v in range(7) if differ >> v & 1) for m in range(1, 8)):
            meets += math.prod(1 - c if differ >> v & 1 else c for v, c in enumerate(clean))
    return math.ceil(math.log(MISS) / math.log(1 - meets)), width


def simhash(own: np.ndarray, bits: int) -> np.ndarray:
    """The fingerprint of a set: bits that are set in over half its hashes, _COMMON among them."""
    own, words = np.append(own, _COMMON), -(-bits // 64)
    ones = np.zeros((8, words * 8), np.int64)
    for at in range(0, len(own), 255):  # a bounded table, however long the text; a byte counts to 255
        h = mix64(own[at : at + 255, None] + _WORDS[:words])
        for b in range(8):
            ones[b] += ((h >> np.uint64(b)) & _LANES).sum(axis=0, dtype=np.uint64).view(np.uint8)
    return (2 * ones > len(own)).T.reshape(-1)[:bits]


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of up to 64 bits as signed longs, the first bit lowest."""
    padded = np.zeros((*bits.shape[:-1], 64), np.uint8)
    padded[..., : bits.shape[-1]] = bits
    return np.packbits(padded, axis=-1, bitorder="little").view("<i8")[..., 0]


def prints(own: list[np.ndarray], parts: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts of the fingerprints of sets, and two words of each, the second with the size in place of its first 10 bits."""
    bits = np.stack([simhash(s, max(parts * width, 128)) for s in own])
    sizes = np.fromiter(map(len, own), np.float64, len(own))
    step = np.floor(16 * np.log2(np.maximum(sizes, 1))).astype(np.int64)
    other = (_packed(bits[:, 64:128]) & ~np.int64(1023)) | np.minimum(step, 1023)
    return _packed(bits[:, : parts * width].reshape(len(own), parts, width)), _packed(bits[:, :64]), other


def _key():
    """A row's name: its id with its text. Fields that are null are equal in it."""
    return F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))


_KEY = "struct<doc_id:bigint,h:bigint>"


def sets(docs: DataFrame, parts: int, width: int) -> DataFrame:
    """row (its name), sid (the set's name), size (of the set), parts (of its fingerprint), x and y (its two words) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            own = shingle_sets(texts_of(b))
            sizes = np.fromiter(map(len, own), np.int64, len(own))
            sid = np.array([int(mix64(s).sum(dtype=np.uint64)) for s in own], np.uint64)
            sid = mix64(sid + sizes.astype(np.uint64)).view(np.int64)
            each, x, y = prints(own, parts, width)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * parts), pa.array(each.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(sid), pa.array(sizes), lists, pa.array(x), pa.array(y)], ["row", "sid", "size", "parts", "x", "y"])

    return docs.select(_key().alias("row"), "text").mapInArrow(run, f"row {_KEY}, sid long, size long, parts array<long>, x long, y long")


def _dealt(once: DataFrame, first: int) -> DataFrame:
    """sid, root, x, y, key (of a bucket): a row for each mask of ROUND parts from the first."""
    part = once.select("sid", "root", "x", "y", F.posexplode(F.slice("parts", first + 1, ROUND)).alias("n", "part"))
    keys = [F.xxhash64(F.col("n") + first, F.lit(v), F.col("part").bitwiseAND(F.lit(m))) for v, m in enumerate(masks(RADIUS))]
    return part.select("sid", "root", "x", "y", F.explode(F.array(*keys)).alias("key"))


def _apart(one: Column, other: Column) -> Column:
    """Differing bits of the words of two sets (x, y)."""
    return F.bit_count(one["x"].bitwiseXOR(other["x"])) + F.bit_count(F.shiftright(one["y"].bitwiseXOR(other["y"]), 10))


def _near(one: Column, other: Column) -> Column:
    """Whether two sets (root, x, y) may reach SIMILARITY and would join two components."""
    size = lambda s: s["y"].bitwiseAND(F.lit(1023))
    return (one["root"] != other["root"]) & (F.abs(size(one) - size(other)) <= STEPS) & (_apart(one, other) <= NEAR)


def _others(first: int, last: int) -> tuple[Column, Column]:
    """The sets of a bucket from so many places before a set to so many behind it, and the set itself."""
    others = F.collect_list(F.struct("sid", "root", "x", "y")).over(Window.partitionBy("key").orderBy("sid").rowsBetween(first, last))
    return others, F.struct("root", "x", "y")


def _nearest(dealt: DataFrame, pairwise: int) -> DataFrame:
    """Pairs (a, b): each set b with the nearest a of those before it in its bucket."""
    before, own = _others(1 - pairwise, -1)
    rows = dealt.withColumn("others", before).filter(F.size("others") > 0)
    least = F.array_min(F.transform(F.filter("others", lambda o: _near(o, own)), lambda o: F.struct(_apart(o, own).alias("apart"), o["sid"].alias("a"))))
    return rows.select(least["a"].alias("a"), F.col("sid").alias("b")).filter("a is not null").distinct()


def _met(dealt: DataFrame, pairwise: int) -> DataFrame:
    """sid, others (near sets before it, of other components) for the sets of buckets of several components.

    Sets of crowded buckets have null for others: all sets of a bucket of more than ``pairwise``, and those that are near any where one has FEW before it.
    """
    others, own = _others(1 - pairwise, pairwise - 1)
    whole = Window.partitionBy("key").orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = dealt.withColumns({"n": F.count("*").over(whole), "low": F.min("root").over(whole), "high": F.max("root").over(whole), "others": others}).filter("low != high")
    near = F.transform(F.filter("others", lambda o: _near(o, own)), lambda o: o["sid"])  # a set is of its own component, so not near itself
    rows = rows.select("key", "sid", (F.col("n") > pairwise).alias("large"), F.when(F.col("n") <= pairwise, near).alias("near"))
    rows = rows.filter(F.col("large") | (F.size("near") > 0)).withColumn("others", F.filter("near", lambda o: o < F.col("sid")))
    crowded = F.col("large") | (F.max(F.size("others")).over(Window.partitionBy("key")) >= FEW)
    return rows.select("sid", F.when(~crowded, F.col("others")).alias("others")).filter("others is null or size(others) > 0")


def _shingles(asked: DataFrame, once: DataFrame, docs: DataFrame) -> DataFrame:
    """sid, shingles (64 bits each) of the sets asked for, from one row that has each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            own = [s.view(np.int64) for s in shingle_sets(texts_of(b))]
            yield pa.RecordBatch.from_arrays([b.column("sid"), pa.array(own, pa.list_(pa.int64()))], ["sid", "shingles"])

    named = materialize(once.select("sid", "row").join(asked, "sid", "left_semi"))
    held = docs.select(_key().alias("row"), "text").join(named.hint("merge"), "row").select("sid", "text").mapInArrow(run, "sid long, shingles array<long>")
    out = materialize(held.groupBy("sid").agg(F.any_value("shingles").alias("shingles")))
    discard(named)
    return out


def _alike(both: Column, a: Column, b: Column) -> Column:
    """Whether sets of a and b shingles that share ``both`` reach SIMILARITY."""
    return SIMILARITY[1] * both >= SIMILARITY[0] * (a + b - both)


def _linked(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by the whole sets (sid, shingles)."""
    x, y = own.select(F.col("sid").alias("a"), F.col("shingles").alias("x")), own.select(F.col("sid").alias("b"), F.col("shingles").alias("y"))
    n, m = F.size("x"), F.size("y")
    may = SIMILARITY[1] * F.least(n, m) >= SIMILARITY[0] * F.greatest(n, m)
    return materialize(pairs.join(x, "a").join(y, "b").filter(may).filter(_alike(F.size(F.array_intersect("x", "y")), n, m)).select("a", "b"))


def _compared(pairs: DataFrame, once: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) that link."""
    asked = materialize(pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct())
    own = _shingles(asked, once, docs)
    out = _linked(pairs, own)
    discard(asked, own)
    return out


def _may_link(own: DataFrame, rooted: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets that may link and would join two components: all that reach SIMILARITY are among them.

    own: sid, shingles; rooted: sid, root, x, y. Shingles that the same sets hold are one class, with its number of shingles;
    classes stand in one order, those of few sets first. What two sets share lies in their first common class and behind it in
    both, so where that is too little to reach SIMILARITY no row is made; neither is for sets of one component.
    """
    held = own.withColumn("size", F.size("shingles")).join(rooted, "sid")
    each = held.select("sid", "root", F.explode("shingles").alias("s"))
    holders = each.groupBy("s").agg(F.count("*").alias("n"), F.sum(F.xxhash64("sid").cast("decimal(38,0)")).alias("c"), F.min("root").alias("low"), F.max("root").alias("high"))
    # no two components share the others
    shared = materialize(holders.filter("low != high").select("s", "n", F.xxhash64("n", "c").alias("c")))
    classes = materialize(each.join(shared, "s").groupBy("sid", "n", "c").agg(F.count("*").alias("k")))
    behind = F.sum("k").over(Window.partitionBy("sid").orderBy("n", "c").rowsBetween(0, Window.unboundedFollowing))
    # a partner holds SIMILARITY of the set at least
    first = classes.withColumn("left", behind).join(held.drop("shingles"), "sid").filter(SIMILARITY[1] * F.col("left") >= SIMILARITY[0] * F.col("size"))
    first = materialize(first.select("sid", "c", "left", "size", "root", "x", "y"))
    # of two components one isn't the class's largest
    counts = materialize(first.groupBy("c", "root").agg(F.count("*").alias("k")))
    main = materialize(counts.groupBy("c").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.count("*").alias("of")).filter("of > 1").select("c", "main"))
    first = materialize(first.join(main, "c").withColumn("outside", F.col("root") != F.col("main")))
    x, y = first.filter("outside").alias("p"), first.alias("q")
    p, q = ({c: F.col(f"{n}.{c}") for c in ("sid", "root", "x", "y", "left", "size")} for n in "pq")
    once = ~F.col("q.outside") | (p["sid"] < q["sid"])
    pairs = x.join(y, (F.col("p.c") == F.col("q.c")) & once & _near(p, q) & _alike(F.least(p["left"], q["left"]), p["size"], q["size"]))
    out = materialize(pairs.select(F.least(p["sid"], q["sid"]).alias("a"), F.greatest(p["sid"], q["sid"]).alias("b")).distinct())
    discard(shared, classes, counts, main, first)
    return out


def links(rows: DataFrame, docs: DataFrame, parts: int, pairwise: int = PAIRWISE) -> DataFrame:
    """(node, root) of the components of all similar pairs that share a bucket, for sets that have any."""
    once = materialize(rows.groupBy("sid").agg(F.min("row").alias("row"), *[F.any_value(c).alias(c) for c in ("parts", "x", "y")]))
    known = _compared(materialize(_nearest(_dealt(once.withColumn("root", F.col("sid")), 0), pairwise)), once, docs)
    told = materialize(components(known))
    rooted = materialize(once.join(told, F.col("sid") == F.col("node"), "left").select("sid", F.coalesce("root", "sid").alias("root"), "parts", "x", "y"))
    rounds = []
    for first in range(0, parts, ROUND):
        rounds.append(materialize(_met(_dealt(rooted, first), pairwise)))
        release(docs)
    met = reduce(DataFrame.union, rounds)
    each = met.select(F.explode("others").alias("a"), F.col("sid").alias("b"))
    edges = materialize(known.union(_compared(materialize(each.distinct()), once, docs)))
    crowded = materialize(met.filter("others is null").select("sid").distinct())
    discard(rooted, told, *rounds)
    if crowded.isEmpty():
        return materialize(components(edges))
    found = materialize(components(edges))
    rooted = once.join(crowded, "sid", "left_semi").join(found, F.col("sid") == F.col("node"), "left")
    rooted = materialize(rooted.select("sid", F.coalesce("root", "sid").alias("root"), "x", "y"))
    own = _shingles(crowded, once, docs)
    more = _linked(_may_link(own, rooted), own)
    discard(own, rooted, crowded)
    return materialize(components(edges.union(more)))


def keep_first(docs: DataFrame, pairwise: int = PAIRWISE) -> DataFrame:
    """One row of docs for each component, with all columns of docs."""
    parts, width = layout(docs.count())
    rows = materialize(sets(docs, parts, width))
    found = links(rows, docs, parts, pairwise)
    # null ids last
    least = F.min(F.struct(F.col("row.doc_id").isNull().alias("none"), "row"))["row"]
    first = materialize(rows.groupBy("sid").agg(least.alias("row")))
    discard(rows)
    named = first.join(found, F.col("sid") == F.col("node"), "left").groupBy(F.coalesce("root", "sid").alias("root"))
    kept = materialize(named.agg(least.alias("__row")).select("__row"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), _key().alias("__row"))
    # rows that repeat id and text: one, the same in every run
    plain = [f"`{f.name}`" for f in docs.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    order = F.xxhash64(*[F.col(f"__doc.{c}") for c in plain])
    return whole.join(kept.hint("merge"), "__row", "left_semi").groupBy("__row").agg(F.min_by("__doc", order).alias("__doc")).select("__doc.*")
