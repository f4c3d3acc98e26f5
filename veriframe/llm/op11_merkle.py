"""Merkle dataset manifest: trees built bottom-up over persisted levels, proofs pushed top-down.

Each row is a leaf, the hash of its fields. The leaves of a group stand in order of a key; runs of ``FANOUT`` consecutive
nodes become one node until one is left (the group's subroot), and the subroots, in order of their group, become the root
likewise. ``build`` persists every ``STRIDE``-th level: a block of ``FANOUT ** STRIDE`` nodes is hashed up ``STRIDE`` levels in one
row, and the block is a node of the next persisted level. ``prove`` goes down again: each persisted level is joined to the proofs of its parents,
and each child prepends its own siblings to the proof suffix that it inherits. ``fold`` recomputes a root from a leaf and its proof.

Built-in functions only. A leaf is shuffled as (key, digest, payload), never with its text. Places come from one sort by range over (group, key),
so a group with a third of all rows is spread over as many tasks as its size asks for; no array is longer than a block. Proofs
of parents are a block's size smaller than what they are joined to. Only the largest group's size reaches the driver.

Nulls: a null field is hashed as ``-``; a null group is a group of its own, before all others; a null key stands first in its
group and is never tampered with. Repeated keys are ordered by their leaf, so rows that agree in all fields are interchangeable and
each gets a proof. Empty and very long texts are hashed as they are. An empty table gives no rows (and has no root).
Columns besides the fields are ignored, whatever their names. The same rows give the same digests however they are dealt out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.llm.common import materialize

FANOUT = 3
#: Tree levels from one persisted level to the next.
STRIDE = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<left:string,right:string>>"


def leaf(*values: Column) -> Column:
    """The hash of a row's fields: each is ``-`` if null, else its length in UTF-8 bytes, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _group(c: Column) -> Column:
    """A group's name that is never null and keeps the order, null first."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))


def placed(rows: DataFrame, *by: str) -> DataFrame:
    """Adds n, the rows of a row's group, and at, its place there (from 0) in the order of ``by``."""
    order = [F.col(c).asc_nulls_first() for c in ("group", *by)]
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    # written at once: the ranges are drawn from a sample, and places have to fit one and the same deal
    parts = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("nth", inside))
    runs = parts.groupBy("group", "part").agg(F.min("nth").alias("first"), F.count("*").alias("size"))
    before = F.sum("size").over(Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("size").over(Window.partitionBy("group"))
    runs = materialize(runs.select("group", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), total.alias("n")))
    return parts.join(runs, ["group", "part"]).withColumn("at", F.col("nth") + F.col("shift")).drop("part", "nth", "shift")


def _parents(level: Column, fanout: int) -> Column:
    runs = F.sequence(F.lit(0), F.ceil(F.size(level) / F.lit(float(fanout))).cast("int") - 1)
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(level, i * fanout + 1, F.lit(fanout)), ""), 256))


def _levels(digests: Column, n: Column, fanout: int, stride: int) -> Column:
    """The levels of a block from its nodes up; a group that fits into one block ends with its one node."""
    height = sum((F.when(n > fanout**k, 1).otherwise(0) for k in range(stride)), F.lit(0))
    up = F.filter(F.sequence(F.lit(1), F.lit(stride)), lambda k: k <= height)
    return F.aggregate(up, F.array(digests), lambda done, _: F.concat(done, F.array(_parents(F.element_at(done, -1), fanout))))


@dataclass
class Tree:
    """Persisted levels, the leaves' first: group, n, block, rows (what each node stands for) and levels; tops: group, digest."""

    levels: list[DataFrame]
    tops: DataFrame
    fanout: int
    stride: int


def build(nodes: DataFrame, fanout: int = FANOUT, stride: int = STRIDE) -> Tree:
    """The trees over nodes (group, n, at, digest, row), one for each group."""
    width, levels = fanout**stride, []
    most = nodes.agg(F.max("n")).first()[0] or 1
    while True:
        kids = F.array_sort(F.collect_list(F.struct("at", "digest", "row")))
        blocks = nodes.groupBy("group", "n", F.floor(F.col("at") / width).alias("block")).agg(kids.alias("kids"))
        level = blocks.select("group", "n", "block", F.col("kids.row").alias("rows"), _levels(F.col("kids.digest"), F.col("n"), fanout, stride).alias("levels"))
        levels.append(materialize(level))
        top = F.element_at(F.element_at("levels", -1), 1).alias("digest")
        nodes = levels[-1].select("group", F.ceil(F.col("n") / width).alias("n"), F.col("block").alias("at"), top, F.lit(None).cast("string").alias("row"))
        most = -(-most // width)
        if most == 1:
            return Tree(levels, nodes.select("group", "digest"), fanout, stride)


def _siblings(levels: Column, i: Column, fanout: int) -> Column:
    """The siblings of a block's i-th node and of its ancestors there, level by level."""

    def step(level: Column, k: Column) -> Column:
        own = F.floor(i / F.pow(F.lit(float(fanout)), k)).cast("int")
        place = F.pmod(own, F.lit(fanout))
        left = F.array_join(F.slice(level, own - place + 1, place), "")
        return F.struct(left.alias("left"), F.array_join(F.slice(level, own + 2, F.lit(fanout - 1) - place), "").alias("right"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), step)


def push(tree: Tree, suffixes: DataFrame) -> DataFrame:
    """group, row, digest, proof and held for each leaf, from suffixes (group, proof, held) of the trees' tops."""
    width, above = tree.fanout**tree.stride, suffixes.withColumn("at", F.lit(0).cast("long"))
    for level in reversed(tree.levels):
        inherited = above.select(F.col("group"), F.col("at").alias("block"), "proof", "held")

        def child(digest: Column, i: Column) -> Column:
            proof = F.concat(_siblings(F.col("levels"), i, tree.fanout), F.col("proof"))
            at = F.col("block") * width + i
            return F.struct(at.alias("at"), F.get("rows", i).alias("row"), digest.alias("digest"), proof.alias("proof"))

        kids = F.transform(F.element_at("levels", 1), child)
        above = level.join(inherited, ["group", "block"]).select("group", "held", F.inline(kids))
    return above.drop("at")


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, start, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def proof_hash(proof: Column) -> Column:
    """The hash of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def prove(leaves: DataFrame, fanout: int = FANOUT, stride: int = STRIDE) -> DataFrame:
    """row, leaf, subroot, root and proof (steps of left and right siblings) for leaves (group, key, digest, row).

    ``row`` is a struct that is carried along. The proof leads from the leaf through its group's subroot to the root.
    """
    # written first: drawing the ranges and dealing by them would each read and hash all texts
    tree = build(placed(materialize(leaves), "key", "digest"), fanout, stride)
    subroots = tree.tops.select(F.lit("").alias("group"), F.col("group").alias("key"), "digest", F.col("group").alias("row"))
    crown = build(placed(subroots, "key"), fanout, stride)
    top = crown.tops.select("group", F.array().cast(_STEPS).alias("proof"), F.col("digest").alias("held"))
    down = push(crown, top).select(F.col("row").alias("group"), "proof", F.struct(F.col("digest").alias("subroot"), F.col("held").alias("root")).alias("held"))
    return push(tree, materialize(down)).select("row", F.col("digest").alias("leaf"), "held.subroot", "held.root", "proof")


def manifest(docs: DataFrame, fields=FIELDS, group: str = "source", key: str = "doc_id", fanout: int = FANOUT, stride: int = STRIDE) -> DataFrame:
    """key, leaf, subroot, root and proof for each row of docs."""
    leaves = docs.select(_group(F.col(group)).alias("group"), F.col(key).alias("key"), leaf(*[F.col(c) for c in fields]).alias("digest"), F.struct(F.col(key)).alias("row"))
    return prove(leaves, fanout, stride).select(f"row.{key}", "leaf", "subroot", "root", "proof")


def audit(docs: DataFrame, stride: int = STRIDE) -> DataFrame:
    """Which changes to the texts the manifest finds: every row's proof, held against the row as it is now.

    A row counts as tampered with where 2 divides the crc32 of its decimal doc_id: its text has lost its line ends.
    """
    fields = [F.col(c) for c in FIELDS]
    hit = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains(F.col("text"), F.lit("\n"))
    changed = leaf(*fields[:-1], F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    row = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.when(hit, changed).alias("now"))
    leaves = docs.select(_group(F.col("source")).alias("group"), F.col("doc_id").alias("key"), leaf(*fields).alias("digest"), row.alias("row"))
    proved = prove(leaves, stride=stride)
    folded = fold(F.coalesce(F.col("row.now"), F.col("leaf")), F.col("proof"))
    out = proved.select("row.doc_id", "leaf", "subroot", "root", proof_hash(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _oracle_tree(name: str, leaves: str) -> str:
    """Tables of DuckDB: name_nodes (lv, g, at, digest), name_runs (lv, g, run, ds) of nodes that are hashed together, name_tops (g, digest)."""
    return f"""{name}_nodes as materialized (
  select 0 as lv, g, at_ as spot, digest from {leaves}
  union all
  select lv + 1, g, spot // {FANOUT}, sha256(string_agg(digest, '' order by spot)) from (select *, count(*) over (partition by g) as c from {name}_nodes) where c > 1 group by lv, g, spot // {FANOUT}),
{name}_runs as materialized (
  select lv, g, spot // {FANOUT} as run, list(digest order by spot) as ds from (select *, count(*) over (partition by lv, g) as c from {name}_nodes) where c > 1 group by lv, g, spot // {FANOUT}),
{name}_tops as materialized (select g, arg_max(digest, lv) as digest from {name}_nodes where spot = 0 group by g)"""


def _oracle_walk(name: str, tree: str, start: str) -> str:
    """A table of each leaf's way up a tree: id, node (folded) and proof; the last step counts."""
    return f"""{name} as (
  select id, 0 as lv, g, spot, node, proof from {start}
  union all
  select id, w.lv + 1, w.g, spot // {FANOUT}, sha256(array_to_string(ds[1:spot % {FANOUT}], '') || node || array_to_string(ds[spot % {FANOUT} + 2:], '')),
    proof || array_to_string(ds[1:spot % {FANOUT}], '') || array_to_string(ds[spot % {FANOUT} + 2:], '')
  from {name} w join {tree}_runs r on r.lv = w.lv and r.g = w.g and r.run = w.spot // {FANOUT}),
{name}_done as materialized (select id, any_value(g) as g, arg_max(node, lv) as node, arg_max(proof, lv) as proof from {name} group by id)"""


def _oracle_leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({x}) || ':' || {x}, '-')" for x in ("doc_id::varchar", "source", "lang", "n_chars::varchar", text)) + ")"


_CRC_BYTE = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda v, z: xor(v >> 1, case when v & 1 = 1 then 3988292384 else 0 end))"
#: The same manifest in DuckDB's SQL: all levels of all trees, and each leaf's way up.
ORACLE_SQL = f"""with recursive docs as materialized (
  select row_number() over () as id, doc_id, coalesce('=' || source, '-') as g, {_oracle_leaf('text')} as digest, {_oracle_leaf("replace(text, chr(10), '')")} as changed,
    (list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda d: ascii(d)::bigint)), lambda c, b: {_CRC_BYTE}) & 1) = 1 as hit from documents),
leaves as materialized (select *, row_number() over (partition by g order by doc_id nulls first, digest, id) - 1 as at_ from docs),
{_oracle_tree('own', 'leaves')},
subroots as materialized (select '' as g, row_number() over (order by g) - 1 as at_, g as of_group, digest from own_tops),
{_oracle_tree('top', 'subroots')},
{_oracle_walk('low', 'own', "(select id, g, at_ as spot, case when hit then changed else digest end as node, '' as proof from leaves)")},
{_oracle_walk('high', 'top', "(select id, s.g, at_ as spot, node, proof from low_done d join subroots s on d.g = s.of_group)")}
select doc_id, leaves.digest as leaf, o.digest as subroot, t.digest as root, sha256(h.proof) as proof_sha256, h.node as folded_root, h.node = t.digest as verified
from leaves join high_done h using (id) join own_tops o on o.g = leaves.g cross join top_tops t
"""
