"""Usage: all-or-nothing reservations in order of arrival, and what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.operators.places import placed
from veriframe.shared import written

#: Requests in a block, and blocks in a block of the next level.
WIDTH = 256


def _granted(used: Column, n: Column, limit: int) -> Column:
    return used + n <= limit if limit > 0 else F.lit(True)


def _after(used: Column, n: Column, limit: int) -> Column:
    return F.when(_granted(used, n, limit), used + n).otherwise(used)


def _transfer(ns: Column, limit: int) -> Column:
    """What a block of requests makes of each count that it may begin with: an array of limit + 1 counts; without a limit its sum."""
    zero = F.lit(0).cast("long")
    through = lambda u: F.aggregate(ns, u, lambda used, n: _after(used, n, limit))
    return F.transform(F.sequence(zero, F.lit(limit).cast("long")), through) if limit > 0 else F.array(through(zero))


def _apply(f: Column, used: Column, limit: int) -> Column:
    return F.get(f, used.cast("int")) if limit > 0 else used + F.get(f, F.lit(0))


def _composed(fs: Column, limit: int) -> Column:
    """The transfer functions of several blocks, one after the other."""
    zero = F.lit(0).cast("long")
    through = lambda u: F.aggregate(fs, u, lambda used, f: _apply(f, used, limit))
    return F.transform(F.sequence(zero, F.lit(limit).cast("long")), through) if limit > 0 else F.array(through(zero))


def _kept(start: Column, items: Column, then, told) -> Column:
    """told(count before, item) of each item in order, the count carried by then(count, item)."""
    first = F.struct(start.alias("u"), F.transform(F.slice(items, F.lit(1), F.lit(0)), lambda x: told(start, x)).alias("out"))
    step = lambda s, x: F.struct(then(s["u"], x).alias("u"), F.concat(s["out"], F.array(told(s["u"], x))).alias("out"))
    return F.aggregate(items, first, step)["out"]


def reserve(requests: DataFrame, limit: int, width: int = WIDTH) -> DataFrame:
    """requests (tenant, seq, n) -> the same with granted and used (after it).

    A rejected request takes nothing, so a running sum would be wrong. A tenant's requests, in order of seq (then n), are cut into blocks
    of ``width``; a block is a function from the count before it to the count after it, and functions compose: blocks of
    blocks, until a tenant has one. Then each block learns the count that it begins with from the block above, and replays its requests. So a
    tenant with most of all requests is spread over the tasks, and no array is longer than a block (or limit + 1, a
    configured number). n is 0 or more; null counts as 0. A null tenant is a tenant; without a limit (0 or less) all is granted.
    """
    if width < 2:
        raise ValueError("a block holds two requests or more")
    typed = requests.select("tenant", F.col("seq").cast("long").alias("seq"), F.coalesce(F.col("n").cast("long"), F.lit(0).cast("long")).alias("n"))
    rows = placed(typed, "tenant", "seq", "n")
    block = lambda at: F.floor(F.col(at) / width)
    sorted_of = lambda *c: F.array_sort(F.collect_list(F.struct(*c))).alias("items")
    first = rows.groupBy("tenant", block("at").alias("block")).agg(sorted_of("at", "seq", "n"))
    most, levels = typed.groupBy("tenant").count().agg(F.max("count")).first()[0] or 1, []
    if most > width:
        first = written(first.withColumn("f", _transfer(F.col("items.n"), limit)))
        level, most = first, -(-most // width)
        while most > 1:
            above = level.groupBy("tenant", block("block").alias("above")).agg(sorted_of("block", "f"))
            level, most = written(above.select("tenant", F.col("above").alias("block"), "items", _composed(F.col("items.f"), limit).alias("f"))), -(-most // width)
            levels.append(level)
    start = F.lit(0).cast("long")
    begins = levels[-1].select(F.col("tenant").alias("of"), F.col("block").alias("at"), start.alias("used")) if levels else None
    known = lambda df, found: df.join(found, F.col("tenant").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at")))
    for level in reversed(levels):
        each = _kept(F.col("used"), F.col("items"), lambda u, x: _apply(x["f"], u, limit), lambda u, x: F.struct(x["block"].alias("at"), u.alias("used")))
        begins = known(level, begins).select(F.col("tenant").alias("of"), F.inline(each))
    full = known(first, begins) if levels else first.withColumn("used", start)
    told = lambda u, x: F.struct(x["seq"].alias("seq"), x["n"].alias("n"), _granted(u, x["n"], limit).alias("granted"), _after(u, x["n"], limit).alias("used"))
    return full.select("tenant", F.inline(_kept(F.col("used"), F.col("items"), lambda u, x: _after(u, x["n"], limit), told)))


#: Fixed value: what is left where there is no limit.
NO_LIMIT = 999_999


def remaining(usage: DataFrame, limit: int) -> DataFrame:
    """tenant, used, max_tests, remaining (never below 0) of usage (tenant, used); without a limit 0, 0, NO_LIMIT."""
    if limit <= 0:
        zero = F.lit(0).cast("long")
        return usage.select("tenant", zero.alias("used"), zero.alias("max_tests"), F.lit(NO_LIMIT).cast("long").alias("remaining"))
    left = F.greatest(F.lit(limit).cast("long") - F.col("used"), F.lit(0).cast("long"))
    return usage.select("tenant", "used", F.lit(limit).cast("long").alias("max_tests"), left.alias("remaining"))
