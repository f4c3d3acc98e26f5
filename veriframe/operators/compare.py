"""Comparison of claimed and read fields: three-valued verdicts with a reason code.

Severity 0 is PASS, 1 REVIEW, 2 FAIL, so the verdict of a record is a maximum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.functions import text as T
from veriframe.functions import vocab as V
from veriframe.functions.similarity import similarity
from veriframe.operators.extract import once
from veriframe.shared import met

PASS, REVIEW, FAIL = 0, 1, 2
_OF = {PASS: "PASS", REVIEW: "REVIEW", FAIL: "FAIL"}


def status(severity: Column) -> Column:
    return F.when(severity == FAIL, _OF[FAIL]).when(severity == REVIEW, _OF[REVIEW]).otherwise(_OF[PASS])


def _rule(*steps: tuple[Column, int, str], other: tuple[int, str]) -> Column:
    """The first step whose condition holds: struct(severity, reason)."""
    made = lambda s, r: F.struct(F.lit(s).alias("severity"), F.lit(r).alias("reason"))
    out = F.when(steps[0][0], made(*steps[0][1:]))
    for cond, s, r in steps[1:]:
        out = out.when(cond, made(s, r))
    return out.otherwise(made(*other))


def _told(claim: Column, read: Column, **more: Column):
    """Claim, read and what several steps of a rule need, each computed once."""
    return F.struct(claim.alias("claim"), read.alias("read"), *[c.alias(k) for k, c in more.items()])


def text_rule(claim: Column, read: Column) -> Column:
    def judged(x: Column) -> Column:
        return _rule(
            (x["low_r"] == "", REVIEW, "not_read"), (x["low_c"] == x["low_r"], PASS, "equal"), (T.same_set(x["a"], x["b"]), PASS, "same_words"),
            (~T.is_garbled_prose(x["claim"]) & ~T.is_garbled_prose(x["read"]), FAIL, "different"), (T.jaccard(x["a"], x["b"]) >= V.CLASS_REVIEW, REVIEW, "near"),
            other=(FAIL, "different_garbled"),
        )

    return T.let(_told(claim, read, low_c=T.low(claim), low_r=T.low(read), a=T.tokens(claim), b=T.tokens(read)), judged)


def number_rule(claim: Column, read: Column, value, tolerance: float) -> Column:
    judged = lambda x: _rule((x["a"].isNull() | x["b"].isNull(), REVIEW, "not_read"), (F.abs(x["a"] - x["b"]) < tolerance, PASS, "equal"), other=(FAIL, "different"))
    return T.let(F.struct(value(claim).alias("a"), value(read).alias("b")), judged)


def warning_rule(claim: Column, read: Column) -> Column:
    def judged(x: Column) -> Column:
        return _rule(
            (x["ws_r"] == "", REVIEW, "not_read"), (~x["ws_r"].rlike(f"^{V.HEADER_COLON}"), FAIL, "header"), (T.ws(x["claim"]) == x["ws_r"], PASS, "equal"),
            (T.warning_fold(x["claim"]) == T.warning_fold(x["read"]), PASS, "equal_folded"),
            (F.array_contains(x["missing"], "(2)") | F.array_contains(x["missing"], "may cause health problems"), FAIL, "missing_end"),
            (F.size(x["missing"]) > 0, FAIL, "missing_part"), (T.jaccard(T.tokens(x["claim"]), T.tokens(x["read"])) >= V.WARNING_REVIEW, REVIEW, "near"),
            other=(FAIL, "different"),
        )

    return T.let(_told(claim, read, ws_r=T.ws(read), missing=T.missing_parts(read)), judged)


def brand_rule(claim: Column, read: Column, ratio: Column | None) -> Column:
    """ratio: similarity of claim and read; None leaves garbled reads at REVIEW, "garbled"."""

    def judged(x: Column) -> Column:
        steps = [
            (x["fold_r"] == "", REVIEW, "not_read"), (x["fold_c"] == x["fold_r"], PASS, "equal"), (T.same_set(T.tokens(x["claim"]), T.tokens(x["read"])), PASS, "same_words"),
            (T.confusion_fold(x["claim"]) == T.confusion_fold(x["read"]), PASS, "same_letters"), (~T.is_garbled(x["read"]), FAIL, "different"),
        ]
        if ratio is None:
            return _rule(*steps, other=(REVIEW, "garbled"))
        return _rule(*steps, (ratio >= V.BRAND_PASS, PASS, "similar"), (ratio >= V.BRAND_REVIEW, REVIEW, "likely"), other=(FAIL, "garbled_different"))

    return T.let(_told(claim, read, fold_c=T.brand_fold(claim), fold_r=T.brand_fold(read)), judged)


def brand_shown(read: Column) -> Column:
    """A class prefix in the brand's place is no brand."""
    return F.when(T.is_class_prefix(read), F.lit("")).otherwise(read)


#: Reasons for which a read counts as the claim, and is shown as it.
SHOWN_AS_CLAIM = ("same_words", "same_letters", "similar")


def compare(claims: DataFrame, reads: DataFrame, fuzzy: bool = True, fields: tuple[str, ...] = V.FIELDS) -> DataFrame:
    """A row for each record and field: record_id, field_pos, field_key, claim, read, shown, severity, reason, status.

    claims and reads have record_id and the five fields. A claim without a read gives unread rows.
    One equi-join on record_id; similarities are computed for garbled brands only; only the rules of ``fields`` are computed.
    ``shown`` is the claim where brand or class differ from it by order, case or letters that are often confused only.
    """
    keys = [k for k in V.FIELDS if k in fields]
    both = met(claims.alias("c"), reads.alias("r"), "record_id", "left")
    cols = [c for k in keys for c in (F.coalesce(F.col(f"c.{k}"), F.lit("")).alias(f"c_{k}"), F.coalesce(F.col(f"r.{k}"), F.lit("")).alias(f"r_{k}"))]
    df = both.select("record_id", *cols)
    c, r = (lambda k: F.col(f"c_{k}")), (lambda k: F.col(f"r_{k}"))
    ratio = None
    if "brand_name" in keys:
        df = df.withColumn("r_brand_name", brand_shown(F.col("r_brand_name")))
        if fuzzy:
            df = once(df, ratio=similarity(c("brand_name"), r("brand_name"), T.is_garbled(r("brand_name"))))
            ratio = F.col("ratio")
    rules = {
        "brand_name": lambda: brand_rule(c("brand_name"), r("brand_name"), ratio), "class_type": lambda: text_rule(c("class_type"), r("class_type")),
        "alcohol_content": lambda: number_rule(c("alcohol_content"), r("alcohol_content"), T.abv, V.ABV_TOLERANCE),
        "net_contents": lambda: number_rule(c("net_contents"), r("net_contents"), T.millilitres, V.ML_TOLERANCE),
        "government_warning": lambda: warning_rule(c("government_warning"), r("government_warning")),
    }
    df = once(df, **{k: rules[k]() for k in keys})
    rows = F.array(*[F.struct(F.lit(V.FIELDS.index(k)).alias("field_pos"), F.lit(k).alias("field_key"), c(k).alias("claim"), r(k).alias("read"), F.col(k)["severity"].alias("severity"), F.col(k)["reason"].alias("reason")) for k in keys])
    long = df.select("record_id", F.explode(rows).alias("x")).select("record_id", "x.*")
    shown = F.when(F.col("field_key").isin("brand_name", "class_type") & F.col("reason").isin(*SHOWN_AS_CLAIM), F.col("claim")).otherwise(F.col("read"))
    return long.withColumns({"shown": shown, "status": status(F.col("severity"))})


def rollup(compared: DataFrame) -> DataFrame:
    """record_id, overall_status, failed_keys, rescue_keys (in field order, joined by commas)."""
    keys = lambda test: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("field_pos", "field_key")))), lambda x: x["field_key"]), ",")
    s = F.col("severity")
    return compared.groupBy("record_id").agg(status(F.max(s)).alias("overall_status"), keys(s == FAIL).alias("failed_keys"), keys(s > PASS).alias("rescue_keys"))


def with_rescue(claims: DataFrame, reads: DataFrame, rescued: DataFrame, fuzzy: bool = True, compared: DataFrame | None = None) -> DataFrame:
    """The comparison with rescued fields in place of the read ones; blank ones fall back. Adds ``rescued``.

    rescued: record_id and any of the five fields, null or empty where not rescued. Only records with a rescued field are
    compared again; the rows of the others are those of ``compared`` (the comparison of claims and reads, made here if not given).
    """
    given = F.array(*[F.when(F.coalesce(T.strip(F.col(f"s_{k}")), F.lit("")) != "", F.lit(k)) for k in V.FIELDS])
    renamed = once(rescued.select("record_id", *[F.col(k).alias(f"s_{k}") for k in V.FIELDS]), hits=F.array_compact(given)).filter(F.size("hits") > 0)
    pick = lambda k: F.coalesce(F.nullif(T.strip(F.col(f"s_{k}")), F.lit("")), F.col(k))
    merged = met(reads, renamed, "record_id").select("record_id", *[pick(k).alias(k) for k in V.FIELDS])
    changed = renamed.select("record_id", "hits")
    again = met(compare(met(claims, changed.select("record_id"), "record_id", "left_semi"), merged, fuzzy), changed, "record_id")
    again = again.withColumn("rescued", F.array_contains("hits", F.col("field_key")) & (F.col("severity") == PASS)).drop("hits")
    before = compare(claims, reads, fuzzy) if compared is None else compared
    return again.unionByName(met(before, changed, "record_id", "left_anti").withColumn("rescued", F.lit(False)))


def rotation_reason(rotation: Column, skew: Column, upright: Column, inverted: Column, per_region: Column) -> Column:
    """Why a text was turned before it was read, as a code; empty if it wasn't."""
    turned, tilted = rotation.isin(90, 180, 270), skew != 0
    return (
        F.when(per_region, "per_region").when(inverted & (rotation == 0) & ~tilted, "brand_inverted").when(upright, "").when(turned & tilted, "turned_and_tilted")
        .when(turned, "turned").when(tilted, "tilted").otherwise("adjusted")
    )


#: Columns of a record's rotation, as ``regions.orientation`` gives them.
ROTATION = ("rotation_deg", "skew_deg", "was_upright", "brand_inverted", "per_region", "brand_deg", "warning_deg")


def results(claims: DataFrame, reads: DataFrame, texts: DataFrame, fuzzy: bool = True, rotations: DataFrame | None = None) -> DataFrame:
    """The nested result of each record as JSON text, with its overall status and a preview of the text.

    rotations: record_id and ROTATION, if any; a record without one gets none.
    """
    compared = compare(claims, reads, fuzzy)
    item = F.struct("field_pos", "field_key", "claim", "shown", "status", "reason")
    fields = compared.groupBy("record_id").agg(F.array_sort(F.collect_list(item)).alias("fields"), status(F.max("severity")).alias("overall_status"))
    out = met(fields, texts.select("record_id", T.preview(F.col("text")).alias("preview")), "record_id", "left")
    told = ["record_id", "overall_status", "fields", "preview"]
    if rotations is not None:
        named = rotations.select("record_id", F.struct(*ROTATION, rotation_reason(*map(F.col, ROTATION[:5])).alias("reason")).alias("rotation"))
        out, told = met(out, named, "record_id", "left"), [*told, "rotation"]
    return out.select("record_id", "overall_status", F.to_json(F.struct(*told)).alias("result"))


def score(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Correct verdicts by expected class; REVIEW is never correct. results: record_id, overall_status."""
    both = expected.join(results, "record_id", "left")
    return both.groupBy("expected").agg(F.count("*").alias("n"), F.count_if(F.col("overall_status") == F.col("expected")).alias("correct"), F.count_if(F.col("overall_status") == "REVIEW").alias("review"))


def reader_report(results: DataFrame, expected: DataFrame) -> DataFrame:
    """How each reader does: reader, n, correct_pass, correct_fail, review and median_seconds (upper median, three places; 0 without times).

    results: reader, record_id, overall_status, seconds; expected: record_id, expected. Results of records that nothing is expected of
    don't count; REVIEW is never correct.
    """
    from veriframe.operators.lines import upper_median

    both = results.join(expected, "record_id")
    right = lambda s: F.count_if((F.col("expected") == s) & (F.col("overall_status") == s)).alias(f"correct_{s.lower()}")
    counts = both.groupBy("reader").agg(F.count("*").alias("n"), right("PASS"), right("FAIL"), F.count_if(F.col("overall_status") == "REVIEW").alias("review"))
    medians = upper_median(both, "reader", "seconds").withColumnRenamed("median", "median_seconds")
    return counts.join(medians, "reader", "left").na.fill(0.0, ["median_seconds"])
