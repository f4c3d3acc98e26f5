"""Brand lines: a better read from candidates, and a remark beside a garbled one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe.functions import text as T
from veriframe.functions import vocab as V
from veriframe.functions.similarity import ratio, similarity
from veriframe.operators.extract import brand_read, flagged, once
from veriframe.shared import met, written

FLOOR, REPLACE, BONUS = 0.45, 0.85, 0.08

#: So many different pairs of texts are broadcast at most.
FEW_PAIRS = 100_000


def measured(rows: DataFrame, claim: Column, read: Column, name: str, few: int = FEW_PAIRS) -> DataFrame:
    """Adds the similarity of claim and read; each different pair of folded texts is measured once, however many rows hold it."""
    rows = written(rows.withColumns({"__a": T.confusion_fold(claim), "__b": T.confusion_fold(read)}))
    # pairs are small and cost much: as many tasks as the session has, whatever their bytes
    pairs = rows.select("__a", "__b").distinct().repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    told = written(pairs.select(F.col("__a").alias("__c"), F.col("__b").alias("__d"), ratio(F.col("__a"), F.col("__b")).alias(name)))
    same = (F.col("__a") == F.col("__c")) & (F.col("__b") == F.col("__d"))
    near = F.broadcast(told) if told.limit(few + 1).count() <= few else told.hint("merge")
    return rows.join(near, same, "left").drop("__a", "__b", "__c", "__d")


def candidates(lines: DataFrame) -> DataFrame:
    """record_id, pos, candidate of further reads (record_id, pos, line): brand-like lines, each once, first places."""
    c = T.strip(F.col("line"))
    own = lines.select("record_id", "pos", c.alias("line"), F.lower(c).alias("k")).filter("line <> ''")
    first = own.withColumn("r", F.row_number().over(Window.partitionBy("record_id", "k").orderBy("pos"))).filter("r = 1")
    c = F.col("line")
    bad = T.millilitres(c).isNotNull() | T.abv(c).isNotNull() | F.contains(F.lower(c), F.lit("government warning")) | T.is_batch_lot(c) | T.is_class_prefix(c)
    return first.filter(~bad).select("record_id", "pos", T.let(T.distillery_brand(c), lambda d: F.when(d != "", d).otherwise(F.col("line"))).alias("candidate"))


def _with_brand(reads: DataFrame) -> DataFrame:
    """record_id, text, l (lines that aren't blank) and read (the brand) of reads (record_id, text; one for each record)."""
    rows = once(reads.select("record_id", "text"), l=F.filter(F.split("text", V.LINE_END), lambda x: T.strip(x) != ""))
    return once(flagged(rows, F.transform("l", T.strip), "text", "l"), read=brand_read(F.col("f"))).drop("f")


def improve(reads: DataFrame, found: DataFrame, claims: DataFrame) -> DataFrame:
    """record_id, text: reads whose brand line gives way to the candidate most like the claim, if that is better.

    The best candidate (a distillery word counts .08 more) replaces the first line that is nearly as like the
    claim, or a class prefix in the first line; else it goes on top.
    """
    rows = _with_brand(reads)
    rows = rows.withColumn("read", F.when(F.col("read") == "", T.strip(F.coalesce(F.try_element_at("l", F.lit(1)), F.lit("")))).otherwise(F.col("read")))
    rows = rows.withColumn("current", F.when(T.is_class_prefix(F.col("read")), F.lit("")).otherwise(F.col("read")))
    rows = met(rows, claims.select("record_id", F.col("brand_name").alias("claim")), "record_id")
    rows = measured(rows, F.col("claim"), F.col("current"), "current_score").withColumn("current_score", F.when(F.col("current") != "", F.col("current_score")).otherwise(0.0))
    scored = measured(met(found, claims.select("record_id", F.col("brand_name").alias("claim")), "record_id"), F.col("claim"), F.col("candidate"), "s")
    scored = scored.withColumn("s", F.when(T.has_distillery(F.col("candidate")), F.least(F.col("s") + BONUS, F.lit(1.0))).otherwise(F.col("s")))
    best = scored.groupBy("record_id").agg(F.max_by("candidate", F.struct("s", (-F.col("pos")).alias("p"))).alias("candidate"), F.max("s").alias("s"))
    rows = met(rows, best, "record_id", "left")
    better = F.coalesce(F.col("s") > F.col("current_score"), F.lit(False))
    rows = rows.withColumns({"best": F.when(better, F.col("candidate")).otherwise(F.col("current")), "best_score": F.when(better, F.col("s")).otherwise(F.col("current_score"))})
    rows = rows.withColumn("change", (F.col("best") != "") & (F.col("best_score") >= FLOOR) & ((F.col("best") != F.col("current")) | (F.col("current") == "")) & (F.size("l") > 0))
    rows = written(rows)
    each = rows.filter("change").select("record_id", "claim", "best_score", F.posexplode("l").alias("i", "line"))
    like = measured(each, F.col("claim"), T.strip(F.col("line")), "s").filter(F.col("s") >= F.col("best_score") * REPLACE).groupBy("record_id").agg(F.min("i").alias("at"))
    rows = met(rows, like, "record_id", "left")
    at = F.when(F.col("at").isNotNull(), F.col("at")).when((F.col("current") != "") & T.is_class_prefix(F.element_at("l", 1)), 0)
    changed = F.when(at.isNotNull(), F.transform("l", lambda x, i: F.when(i == at, F.col("best")).otherwise(x))).otherwise(F.concat(F.array("best"), F.col("l")))
    return rows.select("record_id", F.when(F.col("change"), F.array_join(changed, "\n")).otherwise(F.col("text")).alias("text"))


def clarified(reads: DataFrame, claims: DataFrame) -> DataFrame:
    """record_id, text for display: a garbled brand that is like the claim is shown as the claim, with a remark."""
    rows = _with_brand(reads)
    rows = rows.withColumn("raw", F.when(F.col("read") != "", F.col("read")).otherwise(T.strip(F.coalesce(F.try_element_at("l", F.lit(1)), F.lit("")))))
    rows = met(rows, claims.select("record_id", F.col("brand_name").alias("claim")), "record_id")
    some = (F.size("l") > 0) & (T.brand_fold(F.col("raw")) != T.brand_fold(F.col("claim")))
    rows = once(rows, garbled=some & T.is_garbled(F.col("raw")), some=some)
    rows = once(rows, s=similarity(F.col("claim"), F.col("raw"), F.col("garbled")))
    remark = F.concat("claim", F.lit(V.REMARK[0]), "raw", F.lit(V.REMARK[1]))
    shown = F.when(F.coalesce(F.col("s") >= V.BRAND_REVIEW, F.lit(False)), F.transform("l", lambda x, i: F.when(i == 0, remark).otherwise(x))).otherwise(F.col("l"))
    return rows.select("record_id", F.when(F.col("some"), F.array_join(shown, "\n")).otherwise(F.col("text")).alias("text"))
