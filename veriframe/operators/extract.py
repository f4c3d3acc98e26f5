"""Typed fields from the text of a read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.functions import text as T
from veriframe.functions import vocab as V
from veriframe.shared import met


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that the optimizer won't inline where they are used again: each is evaluated once a row."""
    held = F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()])))
    return df.select("*", held.alias("__once")).select("*", "__once.*").drop("__once")


def flagged(df: DataFrame, lines: Column, *keep: str) -> DataFrame:
    """record_id, columns to keep, and f: an array of what the rules ask of each line, in order.

    The lines become rows, so that flags are plain columns of generated code and not parts of a lambda, each line
    is folded once, and meet again by record_id: the partitioning that a table of lines was collected with serves
    again. Of a line: x (itself), u (without a remark), and flags and values of either.
    """
    x, u, low, bare, lowered = (F.col(c) for c in ("x", "u", "low", "bare", "lowered"))
    each = df.select("record_id", *keep, F.posexplode_outer(lines).alias("pos", "x"))
    each = once(once(each, u=T.unannotated(x)), low=T.low(u), bare=T.bare(u), lowered=F.lower(x))
    each = once(each, noise=T.noise_in(low, bare), warn=T.warning_fragment_in(low), abv=T.abv(x).isNotNull(), noun=T.has_any(lowered, V.CLASS_NOUNS), volume=T.volume_text(x))
    told = F.struct(
        "pos", "x", "u", "noise", "warn", (T.body_in(u, F.lower(u)) | T.class_fragment_in(low)).alias("held"),
        # a distillery word is rare
        F.when(T.has_any(low, V.DISTILLERY) | F.contains(low, F.lit("government warning")), T.distillery_brand(u)).otherwise(F.lit("")).alias("named"),
        "noun", (F.col("noun") | F.col("abv") | (F.col("volume") != "") | F.contains(lowered, F.lit("government warning"))).alias("body"),
        T.has_any(lowered, V.CLASS_PREFIXES).alias("prefixed"), lowered.rlike("alc|proof|%").alias("alcohol"), "abv", "volume",
    )
    item = F.collect_list(F.when(x.isNotNull(), told))
    return each.groupBy("record_id").agg(*[F.any_value(c).alias(c) for c in keep], F.array_sort(item).alias("f"))


def brand_read(f: Column, longest: bool = True) -> Column:
    """The brand of an array of flagged lines: the run before the warning, else the longest distillery (unless left out), else a first line."""
    free = lambda x: (x["u"] != "") & ~x["noise"] & ~x["held"]
    stop = F.array_position(F.transform(f, lambda x: (x["u"] != "") & ~x["noise"] & x["warn"]), True).cast("int")
    before = F.slice(f, F.lit(1), F.when(stop > 0, stop - 1).otherwise(F.size(f)))
    run = T.ws(F.array_join(F.transform(F.filter(before, free), lambda x: x["u"]), " "))
    sized = F.transform(f, lambda x, i: F.struct(F.length(x["named"]).alias("n"), (-i).alias("k"), x["named"].alias("d")))
    best = F.array_max(F.filter(sized, lambda x: x["n"] > 0))["d"]
    alone = F.try_element_at(F.filter(f, lambda x: free(x) & ~x["warn"]), F.lit(1))["u"]
    named = [T.ws(F.nullif(best, F.lit("")))] if longest else []
    return T.let(run, lambda r: F.when(r != "", r).otherwise(F.coalesce(*[F.nullif(n, F.lit("")) for n in named], alone, F.lit(""))))


def _geo_first(c: Column) -> Column:
    geo = lambda w: F.lower(w).isin(*V.GEO_WORDS)
    moved = lambda words: F.array_join(F.concat(F.filter(words, geo), F.filter(words, lambda w: ~geo(w))), " ")
    return T.let(F.split(c, " "), lambda words: F.when(geo(words[0]), F.array_join(words, " ")).otherwise(moved(words)))


def class_read(f: Column) -> Column:
    """The class of an array of flagged lines: the first with a class noun, with the neighbours that continue it."""
    inside = lambda a, b: F.contains(F.lower(b), F.lower(a))

    def near(at: Column) -> Column:
        # an index below 1 is never asked for; missing neighbours are null
        prev = F.when(at > 1, F.try_element_at(f, F.greatest(at - 1, F.lit(1))))
        small = F.regexp_extract(F.coalesce(prev["x"], F.lit("")), V.SMALL_BATCH, 0)
        return F.struct(at.alias("at"), F.try_element_at(f, F.greatest(at, F.lit(1))).alias("own"), prev.alias("prev"), F.try_element_at(f, at + 1).alias("next"), small.alias("small"))

    def merged(n: Column) -> Column:
        line, prev, after = n["own"]["x"], n["prev"], n["next"]
        part = lambda x, fits: F.when(fits, F.struct(x["x"].alias("x"), x["prefixed"].alias("prefixed")))
        parts = F.array(part(prev, ~prev["body"] & prev["prefixed"] & ~inside(prev["x"], line)), part(n["own"], F.lit(True)), part(after, ~after["body"] & after["prefixed"]))
        texts = lambda p, yes: F.transform(F.filter(p, lambda y: y["prefixed"] if yes else ~y["prefixed"]), lambda y: y["x"])
        ordered = T.let(F.filter(parts, lambda p: p.isNotNull()), lambda p: F.array_distinct(F.concat(texts(p, True), texts(p, False))))
        whole = F.when((n["small"] != "") & ~inside(n["small"], line), F.concat_ws(" ", n["small"], line)).otherwise(F.array_join(ordered, " "))
        return F.when(n["at"] > 0, _geo_first(T.ws(whole))).otherwise(F.lit(""))

    return T.let(T.let(F.array_position(F.transform(f, lambda x: x["noun"]), True).cast("int"), near), merged)


def parse(reads: DataFrame) -> DataFrame:
    """record_id, the five fields, and raw_lines, of reads (record_id, text; one for each record)."""
    df = flagged(reads, F.transform(T.split_lines(F.col("text")), T.ws))
    f = F.col("f")
    first = lambda test, value: F.coalesce(F.try_element_at(F.filter(f, test), F.lit(1))[value], F.lit(""))
    warning = lambda w: F.when(w == "", w).otherwise(T.trim_warning(w))
    df = once(
        df, raw_lines=F.transform(f, lambda x: x["x"]), brand=brand_read(f), class_type=class_read(f), alcohol_content=first(lambda x: x["alcohol"], "x"),
        net_contents=first(lambda x: x["volume"] != "", "volume"), head=F.coalesce(F.try_element_at(f, F.lit(1))["x"], F.lit("")),
    )
    df = df.drop("f").withColumn("government_warning", T.let(F.regexp_extract(F.array_join("raw_lines", "\n"), V.WARNING_BLOCK, 1), warning))
    brand = F.when(F.col("brand") != "", F.col("brand")).when(~T.is_class_prefix(F.col("head")), F.col("head")).otherwise(F.lit(""))
    return df.select("record_id", brand.alias("brand_name"), *V.FIELDS[1:], "raw_lines")


def assemble(lines: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """record_id, text: brand, class, alcohol and volume of lines with geometry, then the warning block.

    Where nothing of these is found the text is that of documents (record_id, full_text), else the lines as they
    are; documents without lines keep their text.
    """
    from veriframe.operators.lines import collected, warning_block

    rows = collected(lines)
    stripped = F.filter(F.transform("l.text", T.strip), lambda x: x != "")
    first = lambda test, value: F.coalesce(F.try_element_at(F.filter("f", test), F.lit(1))[value], F.lit(""))
    found = flagged(rows, stripped, "l")
    # the class is read from lines with their white space folded
    folded = flagged(rows, F.transform(stripped, T.ws)).select("record_id", class_read(F.col("f")).alias("class_type"))
    parts = once(found, brand=brand_read(F.col("f"), longest=False), alcohol=first(lambda x: x["abv"], "x"), volume=first(lambda x: x["volume"] != "", "volume"))
    both = met(met(parts.drop("f"), folded, "record_id"), warning_block(lines), "record_id")
    kept = F.filter(F.array("brand", "class_type", "alcohol", "volume", "warning"), lambda x: x != "")
    plain = F.array_join("l.text", "\n")
    if documents is None:
        return both.select("record_id", F.when(F.size(kept) > 0, F.array_join(kept, "\n")).otherwise(plain).alias("text"))
    named = documents.select("record_id", F.coalesce("full_text", F.lit("")).alias("full_text"))
    both = named.join(both.select("record_id", F.array_join(kept, "\n").alias("made"), plain.alias("plain")), "record_id", "full")
    text = F.coalesce(F.nullif(F.col("made"), F.lit("")), F.nullif(F.col("full_text"), F.lit("")), F.col("plain"), F.lit(""))
    return both.select("record_id", text.alias("text"))
