"""Text normalisation and line predicates as Column expressions; all run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veriframe.functions import vocab as V


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def ws(c: Column) -> Column:
    """Null to empty; runs of white space (no-break too) to one space; trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?U){V.SPACE}+", " "))


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, rf"(?U)^{V.SPACE}+|{V.SPACE}+\z", "")


def low(c: Column) -> Column:
    return F.lower(ws(c))


def warning_fold(c: Column) -> Column:
    t = low(c)
    for pattern, new in ((r"\s+:", ":"), (r"\(\s*1\s*\)", "(1)"), (r"\(\s*2\s*\)", "(2)"), (r"\s+([,.])", "$1"), (r"\.+$", "")):
        t = F.regexp_replace(t, pattern, new)
    return t


def brand_fold(c: Column) -> Column:
    return ws(F.regexp_replace(F.upper(ws(c)), r"[^A-Z0-9' ]+", ""))


def confusion_fold(c: Column) -> Column:
    """Brand letters with digits read as the letters they resemble."""
    return F.regexp_replace(F.translate(brand_fold(c), "015738", "OISTEB"), "[^A-Z]", "")


def tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(low(c), F.lit("([a-z0-9']+)"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 if either is empty."""
    share = lambda x: F.when((F.size(x["a"]) == 0) | (F.size(x["b"]) == 0), 0.0).otherwise(F.size(F.array_intersect(x["a"], x["b"])) / F.size(F.array_union(x["a"], x["b"])))
    return let(F.struct(a.alias("a"), b.alias("b")), share)


def same_set(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.array_sort(a) == F.array_sort(b))


def number(c: Column, pattern: str) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), pattern, 1).try_cast("double")


def abv(c: Column) -> Column:
    """Alcohol by volume: N % alc, else N proof halved, else N %; null if none."""
    return F.coalesce(number(c, V.ABV_PERCENT_ALC), number(c, V.ABV_PROOF) / 2.0, number(c, V.ABV_PERCENT))


def millilitres(c: Column) -> Column:
    return number(c, V.MILLILITRES)


def volume_text(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), V.MILLILITRES, 0)


def has_any(t: Column, words) -> Column:
    """Whether any of the words is a part of the text."""
    return reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in words])


# The tests below come in two forms: of a line, and (with _in) of a line that is folded already, for
# tables that fold each line once and test it in many ways. low: lower case, white space folded; bare: lower case, stripped.


def batch_lot_in(bare: Column) -> Column:
    return bare.rlike(V.BATCH_LOT) | (bare.rlike(V.BATCH) & bare.rlike(V.LOT))


def noise_in(low: Column, bare: Column) -> Column:
    return has_any(low, V.NOISE) | batch_lot_in(bare)


def discard_in(bare: Column) -> Column:
    return (bare == "") | has_any(bare, V.NOISE) | batch_lot_in(bare)


_FRAGMENT_WORDS = tuple(dict.fromkeys([*V.GEO_WORDS, *(w for p in V.CLASS_PREFIXES for w in p.split())]))


def class_fragment_in(low: Column) -> Column:
    return low.rlike(rf"^(?:(?:{'|'.join(_FRAGMENT_WORDS)})(?: |$))+$") & ~has_any(low, V.CLASS_NOUNS)


def warning_fragment_in(low: Column) -> Column:
    return has_any(low, ("government warning", *V.WARNING_FRAGMENTS)) | low.rlike(r"^\(\s*2\s*\)")


def class_prefix_in(low: Column) -> Column:
    return (low == "") | (((low == "small batch") | class_fragment_in(low)) & ~has_any(low, V.DISTILLERY))


def body_in(c: Column, lowered: Column) -> Column:
    """lowered: the line in lower case, its white space as it is."""
    return has_any(lowered, ("government warning", *V.CLASS_NOUNS)) | abv(c).isNotNull() | millilitres(c).isNotNull()


def bare(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def is_batch_lot(c: Column) -> Column:
    return let(bare(c), batch_lot_in)


def is_noise(c: Column, batch: bool = True) -> Column:
    """A noise line; without ``batch`` the word list alone decides, and white space isn't folded."""
    if not batch:
        return let(F.lower(c), lambda t: has_any(t, V.NOISE))
    return let(F.struct(low(c).alias("low"), bare(c).alias("bare")), lambda x: noise_in(x["low"], x["bare"]))


def is_discard(c: Column) -> Column:
    return let(bare(c), discard_in)


def has_class_noun(c: Column) -> Column:
    return let(F.lower(c), lambda t: has_any(t, V.CLASS_NOUNS))


def is_body(c: Column) -> Column:
    return let(F.struct(c.alias("c"), F.lower(c).alias("low")), lambda x: body_in(x["c"], x["low"]))


def is_class_fragment(c: Column) -> Column:
    return let(low(c), class_fragment_in)


def is_warning_fragment(c: Column) -> Column:
    return let(low(c), warning_fragment_in)


def has_distillery(c: Column) -> Column:
    return let(F.lower(c), lambda t: has_any(t, V.DISTILLERY))


def is_class_prefix(c: Column) -> Column:
    """A class prefix where a brand should be; empty counts."""
    return let(low(c), class_prefix_in)


def count_of(c: Column, keep: str) -> Column:
    return F.length(F.regexp_replace(c, f"[^{keep}]", ""))


def is_garbled(c: Column) -> Column:
    def judged(x: Column) -> Column:
        t, raw, digits, letters = x["t"], x["raw"], count_of(x["t"], "0-9"), x["n"]
        return (
            (t == "") | (digits >= 2) | ((digits == 1) & (F.length(t) < 14)) | raw.rlike("[^A-Za-z0-9' .-]")
            | ((letters >= 8) & (count_of(t, "AEIOU") / F.greatest(letters, F.lit(1)) < 0.15))
        )

    both = let(F.struct(brand_fold(c).alias("t"), ws(c).alias("raw")), lambda x: F.struct(x["t"].alias("t"), x["raw"].alias("raw"), count_of(x["t"], "A-Z").alias("n")))
    return let(both, judged)


def is_garbled_prose(c: Column) -> Column:
    return millilitres(c).isNull() & is_garbled(c)


def unannotated(c: Column) -> Column:
    return strip(F.regexp_replace(strip(c), V.ANNOTATION, ""))


def trim_warning(c: Column) -> Column:
    return let(ws(c), lambda t: let(ws(F.regexp_extract(t, V.WARNING_BLOCK, 1)), lambda m: F.when(m == "", t).otherwise(m)))


def distillery_brand(c: Column) -> Column:
    """The brand that a line with a distillery word gives, or empty; behind a warning's end too."""
    def own(t: Column) -> Column:
        tail = F.regexp_replace(strip(F.regexp_extract(t, V.BEHIND_WARNING, 1)), r"^[ .]+|[ .]+$", "")
        return F.when(F.contains(F.lower(t), F.lit("government warning")), tail).otherwise(t)

    # the distillery word is the rarest and cheapest to look for
    named = lambda t: F.when(has_distillery(t), F.when((t != "") & ~is_noise(t) & ~is_warning_fragment(t), t).otherwise(F.lit(""))).otherwise(F.lit(""))
    return let(let(unannotated(c), own), named)


def missing_parts(c: Column) -> Column:
    """Markers and phrases that a warning lacks, in order."""
    def missing(t: Column) -> Column:
        parts = []
        for p in (*V.WARNING_MARKERS, *V.WARNING_PHRASES):
            has = F.contains(t, F.lit(p))
            for alias in V.WARNING_ALIASES.get(p, ()):
                has = has | F.contains(t, F.lit(alias))
            parts.append(F.when(~has, F.lit(p)))
        return F.filter(F.array(*parts), lambda x: x.isNotNull())

    return let(warning_fold(c), missing)


def warning_complete(c: Column) -> Column:
    """Whether a read holds the whole warning, as far as its main phrases tell."""
    return let(low(c), lambda t: F.forall(F.array(*map(F.lit, V.WARNING_COMPLETE)), lambda p: F.contains(t, p)))


def warning_ok(c: Column) -> Column:
    def held(t: Column) -> Column:
        first, *rest = [F.contains(t, F.lit(p)) for p in V.WARNING_OK]
        for p in rest:
            first = first & p
        return first

    return let(F.lower(F.coalesce(c, F.lit(""))), held)


def readability(c: Column) -> Column:
    def scored(t: Column) -> Column:
        score = F.lit(0.0)
        for phrase, weight in V.READABILITY:
            score = score + F.when(F.contains(t, F.lit(phrase)), weight).otherwise(0.0)
        score = score + F.when(t.rlike(r"\d+\s*%\s*alc"), 0.10).when(t.rlike(r"\d+\s*%"), 0.05).otherwise(0.0)
        score = score + F.when(t.rlike(r"\d+\s*ml"), 0.08).otherwise(0.0)
        score = score + F.lit(0.12) * (F.length(F.regexp_replace(t, r"(?U)[^\p{L}]", "")) / F.greatest(F.length(t), F.lit(1)))
        return F.when(t == "", 0.0).otherwise(F.least(score, F.lit(1.0)))

    return let(low(c), scored)


def looks_upright(text: Column, score: Column) -> Column:
    mean = score / F.greatest(F.length(ws(text)), F.lit(1))
    return let(readability(text), lambda r: (r >= 0.55) | ((r >= 0.40) & text.rlike("(?i)government warning")) | ((r >= 0.35) & ((mean >= 0.55) | (score >= 180))))


def repair(c: Column) -> Column:
    """Known misreadings of the alcohol line and of the warning; the warning is put on one line, with a full stop."""
    t = F.coalesce(c, F.lit(""))
    for old, new in V.REPAIRED_WORDS:
        t = F.replace(t, F.lit(old), F.lit(new))
    for pattern, new in V.REPAIRED_PATTERNS:
        t = F.regexp_replace(t, pattern, new)
    for pattern, new, most in V.REPAIRED_AT_MOST:
        t = F.array_join(F.split(t, pattern, most + 1), new)
    body = ws(F.regexp_extract(t, rf"(?is)({V.HEADER_COLON}.*)", 1))
    head = F.regexp_replace(t, rf"(?is){V.HEADER_COLON}.*", "")
    fixed = body
    for pattern, new in V.REPAIRED_WARNING:
        fixed = F.regexp_replace(fixed, pattern, new)
    fixed = F.when(F.endswith(fixed, F.lit(".")), fixed).otherwise(F.concat(F.regexp_replace(fixed, "_+$", ""), F.lit(".")))
    return F.when(body == "", strip(t)).otherwise(F.array_join(F.concat(split_lines(head), F.array(fixed)), "\n"))


def split_lines(c: Column) -> Column:
    """Trimmed lines of a text without the empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), V.LINE_END), strip), lambda x: x != "")


def merge_warning(full: Column, warning: Column) -> Column:
    """Text with its warning replaced by that of a second read; as it is if the second read has none."""
    body = strip(F.regexp_extract(warning, rf"(?is)({V.HEADER_COLON}.*)", 1))
    head = F.regexp_replace(full, rf"(?is){V.HEADER_COLON}.*", "")
    return F.when(body == "", full).otherwise(F.array_join(F.concat(split_lines(head), F.array(body)), "\n"))


def collapsed(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), rf"(?U){V.SPACE}+", "")


def collapsed_match(a: Column, b: Column) -> Column:
    return let(F.struct(collapsed(a).alias("a"), collapsed(b).alias("b")), lambda x: (x["a"] != "") & (x["b"] != "") & (F.contains(x["a"], x["b"]) | F.contains(x["b"], x["a"])))


def preview(c: Column) -> Column:
    return F.when(F.length(c) > V.PREVIEW, F.concat(F.substring(c, 1, V.PREVIEW), F.lit("..."))).otherwise(c)
