"""Connected components as Spark joins: alternating large-star and small-star rounds.

Edges stay distributed; each round is two aggregations (with map-side combine) and two joins. The aggregates are
written first: a join right above one shares its shuffle, and then the rows of a star's centre couldn't be split. Rounds grow with the logarithm of the number of nodes. Every round is cut by
a reliable checkpoint in the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: a > b, distinct. Large: link each larger neighbour of u to the least of u and its neighbours."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        linked = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = materialize(edges.groupBy("a").agg(F.min("b").alias("m")))
        joined = edges.join(least, "a")
        linked = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    out = materialize(linked.filter("a != b").distinct())
    discard(least)
    return out


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b) of one orderable type -> (node, root) for every node that has an edge; root is the least node."""
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    print_of = F.struct(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)))
    was = None
    for _ in range(max_rounds):
        half = _star(now, large=True)
        last, now = now, _star(half, large=False)
        discard(last, half)
        mark = now.agg(print_of.alias("x")).first()["x"]
        if mark == was or not mark[0]:
            break
        was = mark
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = now.select("b").distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select(F.col("b"), F.col("b")))
