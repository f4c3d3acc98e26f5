"""Lines of a read: reading order, gaps, grouping of words, the warning block.

Tables with geometry: lines(record_id, line_id, text, confidence, y_center, x_min, y_min, y_max, x_max). One
shuffle on record_id; folds that depend on what was kept run inside the record's array, not over rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.functions import text as T
from veriframe.functions import vocab as V
from veriframe.operators.extract import once
from veriframe.shared import met, written

_ORDER = ("y_center", "x_min", "line_id")


def reading_order(lines: DataFrame) -> DataFrame:
    """Adds line_no from 1: top to bottom, left to right."""
    return lines.withColumn("line_no", F.row_number().over(Window.partitionBy("record_id").orderBy(*_ORDER)))


def line_gaps(lines: DataFrame) -> DataFrame:
    """Adds line_no and the vertical gap to the line before (0 for the first, never negative)."""
    w = Window.partitionBy("record_id").orderBy(*_ORDER)
    return reading_order(lines).withColumn("gap", F.coalesce(F.greatest(F.col("y_min") - F.lag("y_max").over(w), F.lit(0.0)), F.lit(0.0)))


def collected(lines: DataFrame) -> DataFrame:
    """record_id, l: the record's lines as an array in reading order (a record's lines are few)."""
    item = F.struct(*_ORDER, "text", "confidence", "y_min", "y_max", "x_max")
    return lines.groupBy("record_id").agg(F.array_sort(F.collect_list(item)).alias("l"))


def raw_lines(lines: DataFrame) -> DataFrame:
    """record_id, raw_lines: texts in reading order, white space folded, blanks dropped."""
    texts = F.filter(F.transform("l.text", T.ws), lambda x: x != "")
    return collected(lines).select("record_id", texts.alias("raw_lines"))


def numbered_lines(reads: DataFrame) -> DataFrame:
    """record_id, line_no, line of reads (record_id, text): trimmed, blanks dropped, from 1."""
    return reads.select("record_id", F.posexplode(T.split_lines(F.col("text"))).alias("p", "line")).select("record_id", (F.col("p") + 1).alias("line_no"), "line")


def line_kinds(reads: DataFrame) -> DataFrame:
    """Lines with a flag for each kind; each line is folded once, and tested in generated code."""
    line, low, bare, lowered = (F.col(c) for c in ("line", "low", "bare", "lowered"))
    rows = once(numbered_lines(reads), low=T.low(line), bare=T.bare(line), lowered=F.lower("line"))
    rows = once(rows, is_batch_lot=T.batch_lot_in(bare), words=T.has_any(low, V.NOISE), bare_words=T.has_any(bare, V.NOISE), fragment=T.class_fragment_in(low))
    lot, prefix = F.col("is_batch_lot"), (low == "") | (((low == "small batch") | F.col("fragment")) & ~T.has_any(low, V.DISTILLERY))
    return rows.select(
        "record_id", "line_no", "line", "is_batch_lot", ((bare == "") | F.col("bare_words") | lot).alias("is_discard"), (F.col("words") | lot).alias("is_noise"),
        T.has_any(lowered, V.NOISE).alias("is_noise_words"), T.body_in(line, lowered).alias("is_body"), F.col("fragment").alias("is_class_fragment"),
        T.warning_fragment_in(low).alias("is_warning"), prefix.alias("is_class_prefix"),
    )


def warning_block(lines: DataFrame, max_gap: float = V.GAP_FULL) -> DataFrame:
    """record_id, warning: from the first header line on, while gaps to the last kept line are small.

    A noise line without the word warning is skipped and doesn't move the anchor, but a gap is looked at
    before that; a line that brings an end phrase is the last.
    """
    texts = F.transform("l", lambda x: x["text"].rlike(f"(?i){V.HEADER}"))
    first = F.array_position(texts, True).cast("int")
    start = F.element_at("l", first)
    begin = F.struct(T.strip(start["text"]).alias("t"), start["y_max"].alias("at"), F.lit(False).alias("done"))

    def step(acc: Column, x: Column) -> Column:
        far = F.greatest(x["y_min"] - acc["at"], F.lit(0.0)) > max_gap
        skip = T.is_noise(x["text"], batch=False) & ~F.contains(F.lower(x["text"]), F.lit("warning"))
        joined = F.concat_ws(" ", acc["t"], T.strip(x["text"]))
        ends = F.lower(T.ws(joined)).rlike(V.any_of(V.WARNING_END))
        taken = F.struct(joined.alias("t"), x["y_max"].alias("at"), ends.alias("done"))
        return F.when(acc["done"], acc).when(far, F.struct(acc["t"].alias("t"), acc["at"].alias("at"), F.lit(True).alias("done"))).when(skip, acc).otherwise(taken)

    rest = F.slice("l", first + 1, F.size("l"))
    block = F.when(first > 0, T.trim_warning(F.aggregate(rest, begin, step)["t"])).otherwise(F.lit(""))
    return collected(lines).select("record_id", block.alias("warning"))


def _line_starts(words: Column, tol: Column) -> Column:
    """Places (from 0) of the words of a segment that begin a line: a word joins if it is near the line's running centre."""
    start = F.struct(F.lit(None).cast("double").alias("c"), F.array().cast("array<int>").alias("at"))

    def step(acc: Column, x: Column) -> Column:
        joins = F.coalesce(F.abs(x["cy"] - acc["c"]) <= tol, F.lit(False))
        moved = F.struct(((acc["c"] + x["cy"]) / 2.0).alias("c"), acc["at"].alias("at"))
        return F.when(joins, moved).otherwise(F.struct(x["cy"].alias("c"), F.concat(acc["at"], F.array(x["i"])).alias("at")))

    return F.aggregate(F.transform(words, lambda x, i: F.struct(x["cy"].alias("cy"), i.alias("i"))), start, step)["at"]


def group_words(words: DataFrame) -> DataFrame:
    """Lines from word boxes (record_id, word_id, text, confidence, x0, y0, x1, y1).

    Words by centre, top to bottom; one joins the current line if its centre is within the tolerance of the
    line's running centre, which then moves half way to it. Tolerance: .65 of the upper median height, 8 at
    least. Out: record_id, line_no, text, confidence (mean), x_min, y_min, x_max, y_max.

    A running centre is never below the word before, so a gap above the tolerance always ends a line: such gaps cut a record into segments that are
    folded apart. A record of any length is sorted (and spilled) by Spark and never held as a whole; a fold keeps line starts only.
    """
    height = (F.col("y1") - F.col("y0")).cast("double")
    median = upper_value(words.select("record_id", height.alias("h")), "record_id", "h").withColumnRenamed("v", "h")
    tol = F.greatest(F.coalesce("h", F.lit(20.0)) * 0.65, F.lit(8.0))
    centred = words.withColumns({"cy": (F.col("y0") + F.col("y1")) / 2.0, "cx": (F.col("x0") + F.col("x1")) / 2.0})
    rows = met(centred, median, "record_id", "left").withColumn("tol", tol).drop("h")
    order = Window.partitionBy("record_id").orderBy("cy", "cx", "word_id")
    apart = F.coalesce(F.col("cy") - F.lag("cy").over(order) > F.col("tol"), F.lit(False)).cast("long")
    rows = rows.withColumn("apart", apart).withColumn("segment", F.sum("apart").over(order))
    item = F.struct("cy", "cx", "word_id", "text", "confidence", "x0", "y0", "x1", "y1")
    by = rows.groupBy("record_id", "segment", "tol").agg(F.array_sort(F.collect_list(item)).alias("w"))
    by = once(by, at=_line_starts(F.col("w"), F.col("tol")))
    before = F.sum(F.size("at")).over(Window.partitionBy("record_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1))
    by = by.withColumn("before", F.coalesce(before, F.lit(0)).cast("int"))
    ends = F.concat(F.slice("at", F.lit(2), F.size("at")), F.array(F.size("w")))
    lines = by.select("record_id", "before", "w", F.posexplode(F.arrays_zip(F.col("at").alias("at"), ends.alias("to"))).alias("k", "z"))
    lines = once(lines, own=F.slice("w", F.col("z.at") + 1, F.col("z.to") - F.col("z.at")))
    text = F.transform(F.array_sort(F.transform("own", lambda x: F.struct(x["cx"], x["word_id"], x["text"]))), lambda x: x["text"])
    known = F.filter("own", lambda x: x["confidence"].isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x["confidence"]) / F.nullif(F.size(known), F.lit(0))
    least, most = (lambda c: F.array_min(F.col(f"own.{c}"))), (lambda c: F.array_max(F.col(f"own.{c}")))
    return lines.select(
        "record_id", (F.col("before") + F.col("k") + 1).alias("line_no"), F.array_join(text, " ").alias("text"), mean.alias("confidence"),
        least("x0").alias("x_min"), least("y0").alias("y_min"), most("x1").alias("x_max"), most("y1").alias("y_max"),
    )


def paragraphs(words: DataFrame) -> DataFrame:
    """Fold words (record_id, block, paragraph, pos, text, confidence, x0, y0, x1, y1) into paragraphs.

    Confidence is the mean of those that aren't zero, .9 if none.
    """
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")
    return words.groupBy("record_id", "block", "paragraph").agg(
        text.alias("text"), F.coalesce(F.avg(F.when(F.col("confidence") != 0, F.col("confidence"))), F.lit(0.9)).alias("confidence"),
        F.min("x0").alias("x_min"), F.min("y0").alias("y_min"), F.max("x1").alias("x_max"), F.max("y1").alias("y_max"),
    )


def document_score(docs: DataFrame) -> DataFrame:
    """Adds score: mean confidence (that of the lines if the document's is 0) times the text's length; 0 without text."""
    mean = F.when(F.col("avg_confidence") != 0, F.col("avg_confidence")).otherwise(F.coalesce(F.col("line_confidence"), F.lit(0.0)))
    return docs.withColumn("score", F.when(F.coalesce(F.col("full_text"), F.lit("")) == "", 0.0).otherwise(mean * F.greatest(F.length("full_text"), F.lit(1))))


def union_lines(first: DataFrame, second: DataFrame) -> DataFrame:
    """Lines of two reads (record_id, line_no, line): all of the first, then those of the second that are new.

    New: not equal, case aside, to a line of the first or an earlier one of the second.
    """
    both = first.withColumn("part", F.lit(0)).union(second.withColumn("part", F.lit(1))).withColumn("k", F.lower("line"))
    w = Window.partitionBy("record_id", "k").orderBy("part", "line_no")
    kept = both.withColumn("r", F.row_number().over(w)).filter("part = 0 or r = 1")
    return kept.select("record_id", F.row_number().over(Window.partitionBy("record_id").orderBy("part", "line_no")).alias("line_no"), "line")


def merged_reads(brand: DataFrame, warning: DataFrame) -> DataFrame:
    """record_id, text, raw_lines of two reads (record_id, text, raw_lines) of a record, that of its brand and that of its warning.

    Both are repaired, the second's warning replaces the first's, and the second's new lines follow the first's.
    """
    rows = brand.alias("b").join(warning.alias("w"), "record_id")
    b, w = T.repair(F.col("b.text")), T.repair(F.col("w.text"))
    text = F.when(w == "", b).otherwise(T.repair(T.merge_warning(b, w)))
    low = lambda lines: F.transform(lines, F.lower)
    first = F.col("b.raw_lines")

    def fresh(lines: Column) -> Column:
        known = lambda x, i: F.array_contains(low(first), F.lower(x)) | (F.array_position(low(lines), F.lower(x)) - 1 < i)
        return F.filter(lines, lambda x, i: ~known(x, i))

    return rows.select("record_id", text.alias("text"), F.concat(first, fresh(F.col("w.raw_lines"))).alias("raw_lines"))


#: Cuts of a sketch, its accuracy, and the rows of a key that are sorted in one task at most.
CUTS, ACCURACY, SORTED = 1000, 10_000, 100_000


def upper_value(df: DataFrame, key: str, value: str, most: int = SORTED) -> DataFrame:
    """key and v: the element at n // 2 of a key's sorted values, exactly; nulls are left out.

    A key of more than ``most`` values is narrowed first: a sketch (merged on the map side) gives cuts by count, the cuts around the rank are
    counted exactly, and either one of them is the answer or only the values between them remain. That is about a hundredth or
    less, whatever the values' distances and however many are equal, so a few rounds are enough; then the rest is sorted.
    Only keys of so many values are broadcast, of which ``most`` bounds the number; the others, however many, need no join.
    """
    rows = df.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).filter("v is not null")
    none = F.lit(None).cast("double")
    state = rows.groupBy("k").agg(F.count("*").alias("n")).filter(F.col("n") > most)
    state = written(state.select("k", "n", F.expr("n div 2 + 1").alias("rank"), none.alias("low"), none.alias("high"), none.alias("found")))
    few = rows
    if not state.isEmpty():
        large = state.select(F.col("k").alias("of"))
        few = rows.join(F.broadcast(large), F.col("k").eqNullSafe(F.col("of")), "left_anti")
    within = (F.coalesce(F.col("v") > F.col("low"), F.lit(True))) & (F.coalesce(F.col("v") < F.col("high"), F.lit(True)))

    def inside(bounds: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(bounds.withColumnRenamed("k", "of")), F.col("k").eqNullSafe(F.col("of"))).filter(within).drop("of")

    while not state.filter(F.col("found").isNull() & (F.col("n") > most)).isEmpty():
        wide = F.col("found").isNull() & (F.col("n") > most)
        shares = [i / CUTS for i in range(CUTS + 1)]
        cuts = inside(state.filter(wide)).groupBy("k", "n", "rank", "low", "high").agg(F.percentile_approx("v", shares, ACCURACY).alias("c"))
        near = F.lit(CUTS) * (F.col("rank") / F.col("n"))
        slack = 2 * CUTS / ACCURACY
        at = lambda i: F.get("c", F.least(F.greatest(i, F.lit(0)), F.lit(CUTS)).cast("int"))
        cut = cuts.withColumns({"a": at(F.floor(near - slack - 1)), "b": at(F.ceil(near + slack + 1))}).drop("c")
        tally = {"less": F.col("v") < F.col("a"), "first": F.col("v") == F.col("a"), "between": (F.col("v") > F.col("a")) & (F.col("v") < F.col("b")), "last": (F.col("v") == F.col("b")) & (F.col("a") < F.col("b"))}
        told = inside(cut).groupBy("k", "n", "rank", "low", "high", "a", "b").agg(*[F.count_if(c).alias(name) for name, c in tally.items()])
        r, less, first, between, last = (F.col(c) for c in ("rank", "less", "first", "between", "last"))
        steps = (
            (r <= less, less, r, "low", "a", none), (r <= less + first, less, r, "low", "a", F.col("a")),
            (r <= less + first + between, between, r - less - first, "a", "b", none), (r <= less + first + between + last, between, r, "a", "b", F.col("b")),
        )
        made = lambda n, rank, low, high, found: F.struct(n.cast("long").alias("n"), rank.cast("long").alias("rank"), F.col(low).alias("low"), F.col(high).alias("high"), found.alias("found"))
        over = F.col("n") - less - first - between - last
        chosen = made(over, r - (F.col("n") - over), "b", "high", none)
        for cond, *values in reversed(steps):
            chosen = F.when(cond, made(*values)).otherwise(chosen)
        state = written(told.select("k", chosen.alias("s")).select("k", "s.*").unionByName(state.filter(~wide)))
    narrowed = inside(state.filter("found is null")).select("k", "rank", "v")
    each = few.withColumn("rank", F.lit(None).cast("long")).select("k", "rank", "v").unionByName(narrowed).groupBy("k", "rank", "v").agg(F.count("*").alias("c"))
    of_key = Window.partitionBy("k")
    each = each.withColumns({"upto": F.sum("c").over(of_key.orderBy("v")), "all": F.sum("c").over(of_key)})
    sorted_ones = each.filter(F.col("upto") >= F.coalesce("rank", F.expr("all div 2 + 1"))).groupBy("k").agg(F.min("v").alias("v"))
    both = sorted_ones.unionByName(state.filter("found is not null").select("k", F.col("found").alias("v")))
    return both.select(F.col("k").alias(key), "v")


def upper_median(df: DataFrame, key: str, value: str) -> DataFrame:
    """key and median: the element at n // 2 of a key's sorted values, rounded to three places."""
    return upper_value(df, key, value).select(key, F.round("v", 3).alias("median"))
