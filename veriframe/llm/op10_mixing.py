"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

A document's expected copies are its source's target over its source's size. Within a source the
documents stand in an order (by size class, cell, size, doc_id, text); the prefix sum of expected copies
plus one random offset per source is taken, and a document is emitted once for each integer boundary
that its share crosses. Ordering by size keeps the words taken near the target: the error of a source
is about the size of its largest document, not the square root of its number of documents.

All documents of a source expect the same number of copies, so the prefix sum is rank times rate. Ranks are
prefix sums in three levels, so no task gets a whole source, however hot: documents are dealt to cells of about
``CELL_ROWS`` (source, size class, hash of doc_id and text), ``GROUP_CELLS`` cells make a group, and there are windows
over the groups of a source, over the cells of a group, and inside a cell. Rows that agree in id, source and text are
counted by partial aggregation and ranked as one, so repeated rows don't fill a cell.

Null text has size 0. A null source is a source of its own, ordered last. Source names are compared by
code point. Repeated rows are separate documents with ranks side by side; null doc_ids are told apart by their text. A
source of total size 0 has target 0 and takes nothing. An empty table gives an empty result. Other columns of
the input are kept by ``emit``, whatever their names, and ignored by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.llm.common import WORD, materialize, unused

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
CELL_ROWS = 200
GROUP_CELLS = 1_000
#: Parts in which the sources are sorted and numbered.
SOURCE_PARTS = 64
SEED = "mix-2"


def word_count(text: Column) -> Column:
    """Words of a text; null counts as 0. Splitting at the gaps is cheaper than listing the words."""
    gaps = F.regexp_count(text, F.lit(WORD))
    return F.coalesce(gaps, F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """Digits of the size and its first two: classes at most a tenth wide."""
    s = size.cast("string")
    return F.length(s) * 100 + F.substring(s, 1, 2).cast("int")


def _spread(c: Column, digits: int = 8) -> Column:
    """Bits of a hash that every SQL engine has."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, digits), 16, 10).cast("long")


def offset(name: Column, seed: str) -> Column:
    """One number in [0, 1) for each source, from a hash of its name."""
    return _spread(F.concat(F.lit(seed), name)).cast("double") / F.lit(4294967296.0)


def _name(source: Column) -> Column:
    """A source's name that is never null, so that joins and windows need no special case."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def _numbered(by_source: DataFrame) -> DataFrame:
    """Adds nth: the source's place by name, null last. Sorted parts are written, and counted before."""
    parts = by_source.repartitionByRange(SOURCE_PARTS, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    parts = materialize(parts)
    before, sizes = {}, {r["part"]: r["n"] for r in parts.groupBy("part").agg(F.count("*").alias("n")).collect()}  # SOURCE_PARTS counts
    total = 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]
    known = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.create_map(F.lit(0), F.lit(0))
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return parts.withColumn("nth", own + known[F.col("part")]).drop("part")


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP) -> DataFrame:
    """A row for each source (name, source, source_size, target) of sizes (source, size).

    Each source gets ``level`` times its weight, but its cap at most; the excess is shared again among the others,
    until none is above: a few rounds, each of them one aggregation that brings three numbers.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col("nth") - 1, F.lit(len(weights))).cast("int") + 1)
    rows = materialize(_numbered(by_source).withColumn("w", weight))
    most, level, full = F.lit(cap) * F.col("source_size"), 0.0, None
    while True:
        above = F.lit(level) * F.col("w") > most
        found = rows.agg(F.sum("source_size").alias("total"), F.sum(F.when(above, F.col("source_size"))).alias("filled"), F.sum(F.when(~above, F.col("w"))).alias("open"), F.count_if(above).alias("full")).first()
        if found["full"] == full or not found["open"]:
            break
        full, level = found["full"], (share * found["total"] - (found["filled"] or 0) * cap) / found["open"]
    return rows.select(_name(F.col("source")).alias("name"), "source", "source_size", F.least(F.lit(level) * F.col("w"), most).alias("target"))


def _plan(rows: DataFrame, by: tuple[str, ...], cell_rows: int, seed: str) -> DataFrame:
    """rows (name, size, count and the columns of ``by``) with source_size, target, place (before it) and rate."""
    classed = rows.withColumn("class", size_class(F.col("size")))
    # written first, here and below: a join right above an aggregation couldn't split a hot source's rows
    per_class = materialize(classed.groupBy("name", "class").agg(F.ceil(F.sum("count") / F.lit(float(cell_rows))).cast("long").alias("cells")))
    spread = _spread(F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) + F.col("text_hash")
    dealt = materialize(classed.join(per_class, ["name", "class"]).withColumn("cell", F.pmod(spread, F.col("cells"))).drop("cells"))
    cells = materialize(dealt.groupBy("name", "class", "cell").agg(F.sum("count").alias("n")))
    grouped = cells.withColumn("group", F.floor(F.col("cell") / F.lit(GROUP_CELLS)))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = grouped.groupBy("name", "class", "group").agg(F.sum("n").alias("n"))
    groups = materialize(groups.select("name", "class", "group", before(Window.partitionBy("name").orderBy("class", "group")).alias("a")))
    placed = grouped.withColumn("b", before(Window.partitionBy("name", "class", "group").orderBy("cell"))).join(groups, ["name", "class", "group"])
    placed = materialize(placed.select("name", "class", "cell", (F.col("a") + F.col("b")).alias("before")))
    inside = Window.partitionBy("name", "class", "cell").orderBy("size", *by)
    own = F.coalesce(F.sum("count").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = dealt.withColumn("own", own).join(placed, ["name", "class", "cell"])
    return ranked.withColumn("place", F.col("before") + F.col("own")).drop("class", "cell", "own", "before")


def _copies(first: Column, last: Column, seed: str) -> Column:
    """Boundaries crossed between two places of a source."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = offset(F.col("name"), seed)
    return (F.floor(last * rate + u) - F.floor(first * rate + u)).cast("long")


def _narrow(docs: DataFrame) -> list[Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.col("doc_id"), F.col("source"), _name(F.col("source")).alias("name"), word_count(F.col("text")).alias("size"), _spread(text, 15).alias("text_hash")]


def _times(rows: DataFrame, count: str, name: str) -> DataFrame:
    """Each row ``count`` times, numbered from 1; no array is longer than a block, however often a row is repeated."""
    block = 10_000
    last = F.col(count) - 1
    blocks = rows.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / F.lit(block)))))
    left = F.least(F.lit(block).cast("long"), F.col(count) - F.col("__block") * block)
    each = blocks.withColumn("__nth", F.explode(F.sequence(F.lit(1).cast("long"), left)))
    return each.withColumn(name, F.col("__nth") + F.col("__block") * block).drop("__block", "__nth")


def mix(docs: DataFrame, cell_rows: int = CELL_ROWS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for each row of docs (doc_id, text, source)."""
    rows = materialize(docs.select(*_narrow(docs)))
    by_source = materialize(targets(rows).drop("source"))
    counted = rows.groupBy("doc_id", "source", "name", "size", "text_hash").agg(F.count("*").alias("count"))
    plan = _plan(counted, ("doc_id", "text_hash"), cell_rows, seed).join(by_source, "name")
    at = F.col("place") + F.col("i")
    out = _times(plan, "count", "i").withColumn("copies", F.least(_copies(at - 1, at, seed), F.lit(int(CAP)).cast("long")))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(docs: DataFrame, cell_rows: int = CELL_ROWS, seed: str = SEED) -> DataFrame:
    """The mixed corpus: every row of docs as many times as it is taken, with copy_no (from 1) as its last column.

    Copies are decided on narrow rows (no text) and joined back. Rows that agree in all columns (maps and variants
    aside) are one row with as many copies as all of them take; copy_no goes on counting.
    """
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    key = ("doc_id", "source", "name", "size", "text_hash", "row_hash")
    rows = materialize(docs.select(*_narrow(docs), F.xxhash64(*hashed).alias("row_hash")))
    by_source = materialize(targets(rows).drop("source"))
    counted = rows.groupBy(*key).agg(F.count("*").alias("count"))
    plan = _plan(counted, ("doc_id", "text_hash", "row_hash"), cell_rows, seed).join(by_source, "name")
    copies = _copies(F.col("place"), F.col("place") + F.col("count"), seed)
    taken = materialize(plan.select(F.struct("doc_id", "name", "row_hash").alias("key"), copies.alias("copies")).filter("copies > 0"))
    named = docs.select(F.struct("doc_id", _name(F.col("source")).alias("name"), F.xxhash64(*hashed).alias("row_hash")).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    once = named.groupBy("key").agg(F.any_value("doc").alias("doc"))
    emitted = _times(once.join(taken, "key"), "copies", "n")
    return emitted.select("doc.*", F.col("n").cast("int").alias(unused(docs, "copy_no")))


#: The same steps in DuckDB's SQL, over the table documents.
ORACLE_SQL = rf"""
with sizes as (
  select doc_id, source, coalesce('=' || source, '-') as name, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    ('0x' || substr(md5(coalesce(text, '')), 1, 15))::bigint as text_hash from documents),
by_source as (select source, sum(size)::bigint as source_size from sizes group by source),
weighed as (
  select *, ([{', '.join(f'{float(x)}::double' for x in WEIGHTS)}])[((row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)} + 1)::int] as w,
         (sum(source_size) over ())::bigint as total from by_source),
levels as (
  select *, ({SHARE}::double * total - coalesce(sum(source_size) over (order by source_size / w, source nulls last rows between unbounded preceding and 1 preceding), 0)::double * {CAP}::double)
           / sum(w) over (order by source_size / w, source nulls last rows between current row and unbounded following) as level from weighed),
fitted as (
  select *, case when level * w <= {CAP}::double * source_size then row_number() over (order by source_size / w, source nulls last) end as fits from levels),
targets as (select source, source_size, least((arg_min(level, fits) over ()) * w, {CAP}::double * source_size) as target from fitted),
classed as (select *, length(size::varchar) * 100 + substr(size::varchar, 1, 2)::int as class from sizes),
dealt as (
  select *, (('0x' || substr(md5(coalesce(doc_id::varchar, '-')), 1, 8))::bigint + text_hash) % ceil(count(*) over (partition by name, class) / {float(CELL_ROWS)})::bigint as cell from classed),
placed as (
  select *, row_number() over (partition by name order by class, cell, size, doc_id nulls first, text_hash) as place from dealt)
select p.doc_id, p.size, t.source_size, t.target,
  p.size * least(floor(place * (case when t.source_size > 0 then t.target / t.source_size else 0.0 end) + u)
    - floor((place - 1) * (case when t.source_size > 0 then t.target / t.source_size else 0.0 end) + u), {int(CAP)})::bigint as taken
from (select *, ('0x' || substr(md5('{SEED}' || name), 1, 8))::bigint::double / 4294967296.0::double as u from placed) p
join targets t on p.source is not distinct from t.source
"""
