"""Bounded re-mapping: a payload assigns lines of a read to fields; the text is always taken from the lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.functions import text as T
from veriframe.functions import vocab as V
from veriframe.operators.extract import once
from veriframe.shared import met


def clean_payload(c: Column) -> Column:
    """Payload text without code fences."""
    return T.strip(F.regexp_replace(T.strip(c), r"^```[A-Za-z]*\s*|\s*```$", ""))


def payload_fields(payloads: DataFrame) -> DataFrame:
    """record_id, field_key, refs (JSON text) of payloads (record_id, payload): known keys by alias, the last wins.

    Values keep their kind: a string stays in quotes. A payload that is no JSON object gives no rows.
    """
    entries = F.map_entries(F.from_json(clean_payload(F.col("payload")), "map<string,variant>"))
    rows = payloads.select("record_id", F.posexplode(F.coalesce(entries, F.array().cast("array<struct<key:string,value:variant>>"))).alias("pos", "e"))
    token = F.regexp_replace(F.lower("e.key"), "[^a-z0-9_]", "")
    names = V.BIN_ALIASES | {k: k for k in (*V.FIELDS, "ignore")}
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    named = rows.select("record_id", "pos", F.try_element_at(known, token).alias("field_key"), F.to_json("e.value").alias("refs")).filter("field_key is not null")
    return named.groupBy("record_id", "field_key").agg(F.max_by("refs", "pos").alias("refs"))


def _content(c: Column) -> Column:
    """The text of a JSON string."""
    return F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>")[0]


#: A JSON string, or anything else between brackets, commas and blanks.
_TOKEN = r'"(?:[^"\\]|\\.)*"|[^\s\[\],]+'


def line_refs(c: Column) -> Column:
    """Line numbers in a JSON text: whole positive numbers and strings of digits, nested lists flattened; else none.

    Numbers must be above 0; digits in a string are taken as they are, and a string is one value, whatever stands in it.
    """
    flat = F.regexp_extract_all(F.regexp_replace(c, r"\{[^{}]*\}", "null"), F.lit(_TOKEN), F.lit(0))

    def number(x: Column) -> Column:
        quoted = F.regexp_extract(x, r'^"\s*([0-9]+)\s*"$', 1).try_cast("int")
        plain = F.when(x.rlike("^[0-9]"), x.try_cast("double"))
        return F.coalesce(quoted, F.when((plain > 0) & (plain == F.floor(plain)), plain.cast("int")))

    return F.filter(F.transform(flat, number), lambda x: x.isNotNull())


def text_refs(c: Column) -> Column:
    """The texts of a JSON string or list of strings that aren't digits."""
    items = F.when(F.startswith(c, F.lit('"')), F.array(c)).otherwise(F.transform(F.from_json(c, "array<variant>"), lambda x: F.to_json(x)))
    texts = F.transform(F.filter(items, lambda x: F.startswith(x, F.lit('"'))), lambda x: T.strip(_content(x)))
    return F.filter(texts, lambda x: (x != "") & ~x.rlike("^[0-9]+$"))


def first_line_with(lines: Column, candidate: Column, flats: Column | None = None) -> Column:
    """Number (from 1) of the first line that equals the candidate or holds it, white space and case aside; 0 if none.

    flats: the lines without white space and in lower case, where a caller has them.
    """
    flats = F.transform(lines, T.collapsed) if flats is None else flats
    held = lambda x, c: (x["line"] == c["own"]) | ((x["flat"] != "") & (c["flat"] != "") & (F.contains(x["flat"], c["flat"]) | F.contains(c["flat"], x["flat"])))
    both = F.zip_with(lines, flats, lambda x, y: F.struct(x.alias("line"), y.alias("flat")))
    found = lambda c: F.array_position(F.transform(both, lambda x: held(x, c)), True).cast("int")
    return T.let(F.struct(candidate.alias("own"), T.collapsed(candidate).alias("flat")), found)


def refs(reads: DataFrame, payloads: DataFrame, claims: DataFrame) -> DataFrame:
    """record_id, field_key, line_nos: the lines of each field.

    Numbers first; else lines found by the payload's texts, the claim as a hint; else a search of the field's
    own kind. Ignored, repeated and out-of-range numbers go. A record's lines are folded once, and so is each candidate.
    Claims, lines and payload meet as one row for each record, which becomes a row for each field behind the joins.
    """
    named = payload_fields(payloads).groupBy("record_id").agg(F.map_from_entries(F.collect_list(F.struct("field_key", "refs"))).alias("named"))
    lines = once(once(reads, lines=T.split_lines(F.col("text"))).select("record_id", "lines"), flats=F.transform("lines", T.collapsed))
    df = once(met(met(claims.select("record_id", *V.FIELDS), lines, "record_id"), named, "record_id", "left"), ignored=line_refs(F.try_element_at("named", F.lit("ignore"))))
    fields = F.array(*[F.struct(F.lit(k).alias("field_key"), F.col(k).alias("claim"), F.try_element_at("named", F.lit(k)).alias("refs")) for k in V.FIELDS])
    df = df.select("record_id", "lines", "flats", "ignored", F.explode(fields).alias("x")).select("record_id", "lines", "flats", "ignored", "x.*")
    at = lambda test: F.array_position(F.transform("lines", test), True).cast("int")
    df = once(df, numbers=F.coalesce(line_refs(F.col("refs")), F.array().cast("array<int>")), texts=F.coalesce(text_refs(F.col("refs")), F.array().cast("array<string>")))
    none = F.size("numbers") == 0
    asked = none & ((F.size("texts") > 0) | F.col("field_key").isin("brand_name", "class_type")) & (T.strip(F.col("claim")) != "")
    df = once(df, hint=F.when(asked, first_line_with(F.col("lines"), F.col("claim"), F.col("flats"))).otherwise(0))
    hint, numbers = F.col("hint"), F.col("numbers")
    by_text = F.when(none, F.transform("texts", lambda x: F.coalesce(F.nullif(first_line_with(F.col("lines"), x, F.col("flats")), F.lit(0)), hint)))
    own = (
        F.when(F.col("field_key") == "government_warning", at(lambda x: x.rlike(f"(?i){V.HEADER}")))
        .when(F.col("field_key") == "alcohol_content", at(lambda x: T.abv(x).isNotNull()))
        .when(F.col("field_key") == "net_contents", at(lambda x: T.millilitres(x).isNotNull()))
        .otherwise(hint)
    )
    df = once(df, found=F.filter(by_text, lambda x: x > 0))
    found = F.col("found")
    ladder = F.when(F.size(numbers) > 0, numbers).when(F.size(found) > 0, found).otherwise(F.array(own))
    good = F.filter(F.array_distinct(F.array_except(ladder, F.coalesce("ignored", F.array().cast("array<int>")))), lambda n: (n >= 1) & (n <= F.size("lines")))
    return df.select("record_id", "field_key", "lines", good.alias("line_nos"))


def skip_line(line: Column, field: Column) -> Column:
    """Lines that a field doesn't take even if they are assigned to it."""
    return (
        F.when(field == "government_warning", ~line.rlike(f"(?i){V.HEADER}") & T.is_discard(line) & ~T.is_warning_fragment(line))
        .when(field == "brand_name", (T.distillery_brand(line) == "") & (T.is_discard(line) | T.is_garbled(line)))
        .otherwise(T.is_discard(line))
    )


def picked(refs: DataFrame) -> DataFrame:
    """record_id and the five fields, joined from their lines."""
    # a line 0 for each field, which is none, keeps those without lines
    rows = refs.select("record_id", "field_key", "lines", F.posexplode(F.concat("line_nos", F.array(F.lit(0)))).alias("pos", "n"))
    rows = rows.select("record_id", "field_key", "pos", F.get("lines", F.col("n") - 1).alias("line"))
    taken = F.col("line").isNotNull() & ~skip_line(F.col("line"), F.col("field_key"))
    value = F.when(F.col("field_key") == "brand_name", F.coalesce(F.nullif(T.distillery_brand(F.col("line")), F.lit("")), F.col("line"))).otherwise(F.col("line"))
    parts = rows.groupBy("record_id", "field_key").agg(F.transform(F.array_sort(F.collect_list(F.when(taken, F.struct("pos", value.alias("v"))))), lambda x: x["v"]).alias("v"))
    whole = F.when((F.size("v") == 1) & (F.col("field_key") != "government_warning"), F.col("v")[0]).otherwise(T.ws(F.array_join("v", " ")))
    fields = parts.withColumn("whole", whole).groupBy("record_id").agg(*[F.max(F.when(F.col("field_key") == k, F.col("whole"))).alias(k) for k in V.FIELDS])
    return fields.select("record_id", *[F.coalesce(k, F.lit("")).alias(k) for k in V.FIELDS])


def completed(binned: DataFrame, parsed: DataFrame) -> DataFrame:
    """Blank fields filled from the parsed read."""
    p = parsed.select("record_id", *[F.col(k).alias(f"p_{k}") for k in V.FIELDS])
    return met(binned, p, "record_id", "left").select("record_id", *[F.coalesce(F.nullif(F.col(k), F.lit("")), F.col(f"p_{k}"), F.lit("")).alias(k) for k in V.FIELDS])


def validity(fields: DataFrame, reads: DataFrame) -> DataFrame:
    """record_id, missing (field keys, joined by commas), brand_ok, valid."""
    t = reads.select("record_id", "text")
    brand, warning = F.col("brand_name"), F.col("government_warning")
    brand_ok = (brand == "") | (T.millilitres(brand).isNull() & ~T.is_warning_fragment(brand))
    missing = F.array_join(F.filter(F.array(*[F.when(T.strip(F.col(k)) == "", F.lit(k)) for k in V.FIELDS]), lambda x: x.isNotNull()), ",")
    header = (warning == "") | warning.rlike(f"(?i){V.HEADER}")
    rows = met(fields, t, "record_id").select("record_id", missing.alias("missing"), brand_ok.alias("brand_ok"), header.alias("header"), (T.strip(F.coalesce("text", F.lit(""))) != "").alias("some"))
    return rows.select("record_id", "missing", "brand_ok", (F.col("some") & F.col("brand_ok") & F.col("header") & (F.col("missing") == "")).alias("valid"))


def rescued_fields(compared: DataFrame, binned: DataFrame) -> DataFrame:
    """Of the re-mapped fields those that were FAIL or REVIEW and pass their own check; others are empty."""
    target = compared.groupBy("record_id").agg(*[F.max(F.when(F.col("field_key") == k, F.col("severity"))).alias(f"s_{k}") for k in V.FIELDS])
    text = lambda k: T.strip(F.col(k))
    brand, warning = text("brand_name"), text("government_warning")
    own = F.coalesce(F.nullif(T.distillery_brand(brand), F.lit("")), brand)
    ok = {
        "brand_name": (own != "") & T.millilitres(own).isNull() & ~T.is_warning_fragment(own),
        "government_warning": warning.rlike(f"(?i){V.HEADER}"),
    }
    value = lambda k: own if k == "brand_name" else text(k)
    keep = lambda k: F.when((F.col(f"s_{k}") > 0) & ok.get(k, text(k) != ""), value(k)).otherwise(F.lit("")).alias(k)
    return met(binned, target, "record_id").select("record_id", *[keep(k) for k in V.FIELDS])


def is_object(payload: Column) -> Column:
    """Whether a payload is a JSON object."""
    return F.coalesce(F.startswith(F.to_json(F.try_parse_json(clean_payload(payload))), F.lit("{")), F.lit(False))


def rescue_outcome(compared: DataFrame, reads: DataFrame, payloads: DataFrame, rescued: DataFrame) -> DataFrame:
    """record_id, outcome of a rescue: no_targets, no_lines, bad_payload, nothing_valid or rescued.

    The first that applies, in this order; a record without a payload has a bad one.
    """
    target = compared.groupBy("record_id").agg(F.max("severity").alias("severity"))
    lines = reads.select("record_id", F.size(T.split_lines(F.col("text"))).alias("lines"))
    known = payloads.select("record_id", is_object(F.col("payload")).alias("good"))
    kept = rescued.select("record_id", F.exists(F.array(*V.FIELDS), lambda x: x != "").alias("some"))
    rows = met(met(met(target, lines, "record_id", "left"), known, "record_id", "left"), kept, "record_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    outcome = (
        F.when(F.col("severity") == 0, "no_targets").when(F.coalesce("lines", F.lit(0)) == 0, "no_lines").when(~yes("good"), "bad_payload")
        .when(~yes("some"), "nothing_valid").otherwise("rescued")
    )
    return rows.select("record_id", outcome.alias("outcome"))


def mapping_outcome(payloads: DataFrame, valid: DataFrame) -> DataFrame:
    """record_id, outcome (bad_payload, invalid or mapped) and missing of a full mapping; valid as ``validity`` gives it."""
    rows = met(valid, payloads.select("record_id", is_object(F.col("payload")).alias("good")), "record_id", "left")
    outcome = F.when(~F.coalesce("good", F.lit(False)), "bad_payload").when(~F.col("valid"), "invalid").otherwise("mapped")
    return rows.select("record_id", outcome.alias("outcome"), F.when(outcome == "invalid", F.col("missing")).otherwise(F.lit("")).alias("missing"))
