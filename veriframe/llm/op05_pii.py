"""Personal data by candidate gradient boosting. DataFrame and SQL functions only; one narrow pass.

Base spans come from four fixed patterns. The method adds spans: high-recall generators propose overlapping
candidates (long numbers, tokens with digits, spelled-out addresses, grouped account numbers, whatever follows a cue
such as "password:"), each gets format features (length, digits, separators, checks) and context features (words before it, characters beside it), and boosted trees
score it. The trees are trained once per application on a generated, labelled sample of ``TRAIN_ROWS`` rows
(a documented bound: it doesn't grow with the corpus), and are written out as nested CASE expressions, so
scoring stays in the row's own pass: no shuffle, no Python. A third of the sample is held out to calibrate,
for each generator, the least threshold with a precision of ``PRECISION``. Added spans never replace or
overlap base spans; added ones that overlap one another are one span.

Positions without a scan of their own: matches are marked with two control characters, the text is split at
the first, and the lengths of the pieces add up to the starts, in code points. Texts that hold these
characters have them masked by another one first, which no base pattern can match.

Null text counts as empty (no spans, hash of the empty string). Texts are read whole; running sums are kept
in blocks, so a very long text with many matches stays cheap. Repeated rows give equal rows, an empty table
gives an empty result, null doc_ids are kept, and other columns are ignored.
"""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed patterns. Where one can't begin (inside its own run) a look-behind says so: the matches are those
#: of the plain pattern, found without starting again at every character of a long run.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

#: Generators of the method.
#: No length is capped. A number's end is tested after the match (in ``find``), so that a run is read once.
NUMBER = r"(?<![0-9A-Za-z])[(]?[0-9](?:[\x20()./-]{0,2}[0-9]){6,}+"
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{12,}+={0,2}(?![A-Za-z0-9+/_-])"
SPELLED = r"(?i)(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++\x20?(?:\x20at\x20|[(\[]at[)\]])\x20?[A-Za-z0-9-]++\x20?(?:\x20dot\x20|[(\[]dot[)\]])\x20?[A-Za-z]{2,}+"
IBAN = r"(?<![A-Za-z0-9])[A-Za-z]{2}[0-9]{2}(?:\x20[A-Za-z0-9]{4}){2,7}+(?:\x20[A-Za-z0-9]{1,3}(?![A-Za-z0-9]))?"
#: What follows a cue word and a sign, to the next white space or quote, however short; signs that end a sentence aren't part of it.
#: Short cues begin a word (a compass and a spin aren't any). The first group is left out of the match.
CUES = r"(?:(?<![A-Za-z0-9])(?:pass(?:phrase|code)?|pwd|pin)|password|passwd|secret|token|credential|api[\x20_-]?key|access[\x20_-]?key|private[\x20_-]?key)"
_SIGN = r"[\x22']?\x20{0,2}(?:[:=]=?>?|is\x20)\x20{0,2}[\x22']?"
CUED = rf"(?i)({CUES}{_SIGN})([^\x20\x09-\x0D\x22']*[^\x20\x09-\x0D\x22'.,;:)])"
ANY_CUE = rf"(?i){CUES}{_SIGN}"
GENERATORS = ("number", "secret", "contact", "iban", "cued")
#: The kind of a span by generator.
ADDED = ("number", "secret", "contact", "number", "secret")

TRAIN_ROWS = 4000
TREES = 16
DEPTH = 3
PRECISION = 0.99
CONTEXT = 24
_A, _B, _MASK = "\x01", "\x02", "\x03"


def _once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns and keeps the optimizer from inlining them where they are used, many times or in a
    lambda: each is evaluated once for a row. Exploding an array of one element is such a border."""
    held = F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()])))
    return df.select("*", held.alias("__once")).select("*", "__once.*").drop("__once")


def _blocks(lengths: Column) -> Column:
    """Running sums within each block of 256 numbers."""
    start = F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("a"))
    add = lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["a"], F.array(acc["s"] + x)).alias("a"))
    n = F.greatest(F.ceil(F.size(lengths) / F.lit(256)).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.aggregate(F.slice(lengths, b * 256 + 1, F.lit(256)), start, add))


def _sums(blocks: Column) -> Column:
    """Running sums over all blocks."""
    start = F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("a"))
    bases = F.aggregate(blocks, start, lambda acc, b: F.struct((acc["s"] + b["s"]).alias("s"), F.concat(acc["a"], F.array(acc["s"])).alias("a")))["a"]
    return F.flatten(F.zip_with(blocks, bases, lambda b, o: F.transform(b["a"], lambda x: x + o)))


def _spans(parts: Column, sums: Column) -> Column:
    """The matches in order, with the text beside them."""
    n = F.size(parts) - 1
    both = F.arrays_zip(F.slice(parts, F.lit(1), n).alias("before"), F.slice(parts, F.lit(2), n).alias("own"), F.slice(sums, F.lit(1), n).alias("start"))

    def one(x: Column) -> Column:
        m = F.substring_index(x["own"], _B, 1)
        return F.struct(x["start"].alias("start"), (x["start"] + F.length(m)).alias("end"), m.alias("m"), F.right(F.substring_index(x["before"], _B, -1), F.lit(CONTEXT)).alias("before"), F.left(F.substring_index(x["own"], _B, -1), F.lit(2)).alias("after"))

    return F.when(n > 0, F.transform(both, one))


def with_spans(df: DataFrame, text: str, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """Adds the spans of each pattern under its name; the second of a pair is a cheap test for any match.

    The span of CUED is its second group; that of any other pattern the whole match.
    """
    marked = lambda p: f"$1{_A}$2{_B}" if p == CUED else f"{_A}$0{_B}"
    parts = {f"__p_{k}": F.when(may, F.split(F.regexp_replace(F.col(text), p, marked(p)), _A, -1)) for k, (p, may) in patterns.items()}
    df = _once(df, parts)
    some = {k: F.size(f"__p_{k}") > 1 for k in patterns}
    df = _once(df, {f"__l_{k}": F.when(some[k], F.transform(f"__p_{k}", lambda p, i: F.length(p) - F.when(i == 0, 0).otherwise(1))) for k in patterns})
    df = _once(df, {f"__b_{k}": F.when(some[k], _blocks(F.col(f"__l_{k}"))) for k in patterns})
    df = _once(df, {f"__s_{k}": F.when(some[k], _sums(F.col(f"__b_{k}"))) for k in patterns})
    df = _once(df, {k: F.when(some[k], _spans(F.col(f"__p_{k}"), F.col(f"__s_{k}"))) for k in patterns})
    return df.drop(*[f"__{x}_{k}" for k in patterns for x in "plbs"])


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    at = F.split(F.reverse(d), "", -1)
    each = F.transform(F.filter(at, lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + (c.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _ip_ok(m: Column) -> Column:
    def small(p: Column) -> Column:
        q = F.ltrim(p, F.lit("0"))
        return (F.length(q) <= 3) & (F.coalesce(q.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(m, r"\."), small)


def features(c: Column, generator: int) -> Column:
    """Format and context of a candidate as an array of doubles, in the order of FEATURES."""
    m = F.lower(c["m"]) if generator == 2 else c["m"]  # a spelled-out address reads alike in either case
    d = digits(m)
    before = F.lower(c["before"])
    has = lambda words: F.when(before.rlike(words), 1.0).otherwise(0.0)
    count = lambda p: (F.length(m) - F.length(F.regexp_replace(m, p, ""))).cast("double")
    yes = lambda cond: F.when(cond, 1.0).otherwise(0.0)
    return F.array(
        F.lit(float(generator)),
        F.length(m).cast("double"),
        F.length(d).cast("double"),
        count("[A-Za-z]"),
        count("[A-Z]"),
        count("[-. /]"),
        count("[()]"),
        F.size(F.array_distinct(F.split(m, ""))).cast("double"),
        yes(m.rlike("^[0-9a-f]+$")),
        yes(m.rlike(r"^[(]?[0-9]{3}[)]?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}$")),
        yes(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$")),
        yes(m.rlike(r"^([0-9]{4}[-/.][0-9]{2}[-/.][0-9]{2}|[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{4})$")),
        F.when(F.length(d) >= 12, yes(luhn(d))).otherwise(0.0),
        has(r"(phone|tel|call|mobile|fax|cell)[a-z]*[ :.#=]*$"),
        has(r"(ssn|social|passport|national id|tax id|licen[cs]e no)[a-z]*[ :.#=]*[a-z]*[ :.#=]*$"),
        has(r"(pass(word|wd|phrase|code)?|secret|token|credential|api[ _-]?key|key|pwd|pin)[a-z]*[ \"':=]*(is)?[ \"'>:=]*$"),
        has(r"(card|visa|account|acct|iban|konto|compte)[a-z]*[ :.#=]*[a-z]*[ :.#=]*$"),
        has(r"(born|birth|dob)[a-z ]*[ :.#=]*$"),
        has(r"(mail|contact|write|reach)[a-z ]*[ :.#=]*$"),
        has(r"(order|version|ref|invoice|isbn|page|serial|sku|id|no|commit|sha|hash|rev)[a-z]*[ :.#=]*$"),
        yes(before.rlike("[a-z0-9]$")),
        yes(before.rlike(r"[:=][ \"']*$")),
        yes(m.rlike(r"^[a-z]+[.!?)]*$")),
        yes(m.rlike(r"[^A-Za-z0-9.()/ -]")),
        yes(c["after"].rlike("^[A-Za-z0-9]")),
    )


FEATURES = 25


#: What stands after a cue word in prose and forms and is no secret.
_PLAIN_ANSWERS = (
    "required", "required.", "optional", "missing", "none", "null", "true", "false", "expired", "invalid", "wrong", "yours", "here", "valid", "this", "that",
    "string", "hidden", "changed", "reset", "forgotten", "needed", "always", "never", "only", "sent", "correct", "incorrect", "empty", "stored", "unknown",
)


def labelled(seed: int = 7, n: int = TRAIN_ROWS) -> list[tuple[int, str, str, str, float]]:
    """Generated candidates: (generator, before, candidate, after, 1.0 if personal)."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choices("0123456789", k=k))
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9)))
    plain = lambda: " ".join(word() for _ in range(3)) + rng.choice((" ", ", ", ". "))
    after = lambda: rng.choice((" " + word()[:1], ". ", ", ", "\n", ""))[:2]
    near = lambda words: (plain() + rng.choice(words) + rng.choice((" ", ": ", " = ", "=", ' = "', " is ", " no. "))) if words else plain()
    hexa = lambda k: "".join(rng.choices("0123456789abcdef", k=k))
    mixed = lambda k: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=k - 1)) + d(1)
    dot = lambda: rng.choice((" at ", "(at)", "[at]", " (at) "))
    letters = lambda k: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=k))
    country = lambda: "".join(rng.choices("ABCDEFGHILMNPRST", k=2))
    sign = lambda: rng.choice((": ", " = ", "=", ':"', ' = "', ":"))
    cue = lambda signed: plain() + rng.choice(("password", "passwd", "pwd", "secret", "token", "api key", "api_key", "passphrase", "pin")) + (sign() if signed else " is ")
    makers = [
        # personal
        lambda: (0, near(("call", "tel", "phone", "mobile", "")), f"({d(3)}) {d(3)}-{d(4)}", 1.0),
        lambda: (0, near(("phone", "tel", "fax", "cell")), rng.choice((f"{d(3)}-{d(3)}-{d(4)}", f"{d(4)} {d(6)}", d(10))), 1.0),
        lambda: (0, near(("ssn", "social security", "tax id", "")), f"{d(3)}-{d(2)}-{d(4)}", 1.0),
        lambda: (0, near(("born", "date of birth", "dob")), rng.choice((f"19{d(2)}-0{rng.randint(1, 9)}-1{d(1)}", f"1{d(1)}/0{rng.randint(1, 9)}/19{d(2)}")), 1.0),
        lambda: (0, near(("account", "iban", "card", "konto", "passport")), d(rng.randint(8, 18)), 1.0),
        lambda: (1, near(("password", "token", "secret", "api key", "pwd", "api_key")), rng.choice((hexa(rng.randint(12, 64)), mixed(rng.randint(12, 40)))), 1.0),
        lambda: (1, near(("iban", "account", "konto")), "DE" + d(20), 1.0),
        lambda: (2, near(("mail", "contact", "write", "")), f"{word()}{dot()}{word()}{rng.choice((' dot ', '(dot)', '[dot]'))}com", 1.0),
        lambda: (3, near(("iban", "account", "konto", "transfer to", "")), country() + d(2) + " " + " ".join(d(4) for _ in range(rng.randint(3, 6))) + rng.choice(("", " " + d(2))), 1.0),
        lambda: (3, near(("iban", "bank", "pay to", "")), country() + d(2) + " " + letters(4).upper() + " " + " ".join(d(4) for _ in range(rng.randint(2, 5))) + rng.choice(("", " " + d(2))), 1.0),
        lambda: (4, cue(True), rng.choice((word() + d(rng.randint(1, 4)), word() + word(), mixed(rng.randint(6, 14)), word() + rng.choice("!$%&#*?") + d(2), letters(rng.randint(16, 40)))), 1.0),
        lambda: (4, cue(False), rng.choice((word() + d(rng.randint(2, 4)), mixed(rng.randint(8, 30)), word() + rng.choice("!$%&#*?") + d(2))), 1.0),
        lambda: (4, cue(True), rng.choice((d(rng.randint(4, 8)), word() + rng.choice(":;,=<") + mixed(rng.randint(4, 9)), mixed(rng.randint(4, 6)))), 1.0),
        # other
        lambda: (4, cue(True), rng.choice((letters(rng.randint(1, 3)), d(1), "-", "***", "n/a")), 0.0),
        lambda: (3, plain(), letters(2).upper() + d(2) + " " + " ".join([letters(4), *(rng.choice((d(4), letters(4))) for _ in range(rng.randint(1, 3)))]), 0.0),
        lambda: (3, plain(), f"{rng.choice(('in', 'to', 'no', 'by'))}{d(2)} {letters(4)} {letters(4)} {letters(4)}", 0.0),
        lambda: (4, cue(True), rng.choice(_PLAIN_ANSWERS), 0.0),
        lambda: (4, cue(False), rng.choice((*_PLAIN_ANSWERS, letters(rng.randint(4, 9)))), 0.0),
        lambda: (0, near(("order", "invoice", "ref", "isbn", "serial", "")), d(rng.randint(7, 18)), 0.0),
        lambda: (0, plain(), rng.choice((d(16), d(8), d(12))), 0.0),
        lambda: (0, near(("version", "page", "")), f"{d(1)}.{d(2)}.{d(3)}.{d(4)}", 0.0),
        lambda: (0, near(("", "on", "until")), rng.choice((f"20{d(2)}-0{rng.randint(1, 9)}-1{d(1)}", f"1{d(1)}/0{rng.randint(1, 9)}/20{d(2)}")), 0.0),
        lambda: (0, plain(), f"{d(4)} {d(4)}", 0.0),
        lambda: (1, near(("commit", "sha", "hash", "rev", "id", "")), hexa(rng.choice((12, 16, 32, 40))), 0.0),
        lambda: (1, plain(), rng.choice((f"{word()}-{word()}-{d(3)}", f"{word()}{word()}{d(2)}", f"{word()}/{word()}/{d(4)}", mixed(rng.randint(12, 30)))), 0.0),
        lambda: (2, plain(), f"{word()} at {word()} dot matrix"[:40], 0.0),
    ]
    rows = []
    for i in range(n):
        g, before, m, y = makers[i % len(makers)]()
        rows.append((g, before[-CONTEXT:], m, after(), y))
    return rows


_MODELS: dict[str, tuple] = {}


def model(spark: SparkSession) -> tuple[list, list[float]]:
    """(trees, thresholds): each tree is a leaf's number or (feature, threshold, left, right)."""
    key = spark.sparkContext.applicationId
    if key in _MODELS:
        return _MODELS[key]
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    rows = spark.createDataFrame(labelled(), "g int, before string, m string, after string, label double").coalesce(1)
    c = F.struct("m", "before", "after")
    x = features(c, 0)
    for g in range(1, len(GENERATORS)):
        x = F.when(F.col("g") == g, features(c, g)).otherwise(x)
    rows = rows.select("g", "label", array_to_vector(x).alias("features"), (F.xxhash64("m", "before") % 3 == 0).alias("held")).cache()
    fitted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=11).fit(rows.filter("not held"))

    def walk(node) -> tuple | float:
        if node.subtreeDepth() == 0:
            return float(node.prediction())
        return node.split().featureIndex(), float(node.split().threshold()), walk(node.leftChild()), walk(node.rightChild())

    trees = [(w, walk(t._call_java("rootNode"))) for w, t in zip(fitted.treeWeights, fitted.trees, strict=True)]
    scored = fitted.transform(rows.filter("held")).select("g", "label", "features").collect()
    rows.unpersist()
    thresholds = []
    for g in range(len(GENERATORS)):
        held = sorted(((_margin(trees, r["features"]), r["label"]) for r in scored if r["g"] == g), reverse=True)
        best, good = float("inf"), 0.0
        for k, (score, y) in enumerate(held, 1):
            good += y
            if good / k >= PRECISION and y and (k == len(held) or held[k][0] < score):
                best = score
        thresholds.append(best)
    _MODELS[key] = trees, thresholds
    return _MODELS[key]


def _margin(trees: list, x) -> float:
    def leaf(t):
        while isinstance(t, tuple):
            t = t[2] if x[t[0]] <= t[1] else t[3]
        return t

    return sum(w * leaf(t) for w, t in trees)


def margin(trees: list, x: Column) -> Column:
    """The sum of the trees as CASE expressions over an array of features."""

    def branch(t) -> Column:
        return F.lit(t) if not isinstance(t, tuple) else F.when(x[t[0]] <= t[1], branch(t[2])).otherwise(branch(t[3]))

    return reduce(lambda a, b: a + b, [F.lit(w) * branch(t) for w, t in trees])


def _scorer(trees: list, generator: int):
    def scored(c: Column) -> Column:
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), features(c, generator).alias("x"))

    def summed(c: Column) -> Column:
        # one-element transform: the array of features is computed once and then walked by every tree
        score = F.transform(F.array(scored(c)["x"]), lambda x: margin(trees, x))[0]
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), score.alias("score"))

    return summed


def _place(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def _at_least(threshold: float):
    return lambda c: c["score"] >= threshold


def find(docs: DataFrame) -> DataFrame:
    """doc_id, text, base and added spans of each row of docs: arrays of (kind, start, end)."""
    trees, thresholds = model(docs.sparkSession)
    raw = F.coalesce(F.col("text"), F.lit(""))
    safe = F.when(F.contains(raw, F.lit(_A)) | F.contains(raw, F.lit(_B)), F.translate(raw, _A + _B, _MASK + _MASK)).otherwise(raw)
    t, any_digit = F.col("t"), F.col("any_digit")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", safe.alias("t"))
    rows = _once(rows, {"any_digit": t.rlike("[0-9]")})
    rows = with_spans(rows, "t", {
        "s0": (EMAIL, F.contains(t, F.lit("@"))), "s1": (IP, any_digit), "s2": (CARD, any_digit), "s3": (PHONE, F.contains(t, F.lit("+"))),
        "g0": (NUMBER, any_digit), "g1": (TOKEN, any_digit), "g2": (SPELLED, t.rlike("(?i)dot")),
        "g3": (IBAN, any_digit), "g4": (CUED, t.rlike(ANY_CUE)),
    })
    rows = rows.withColumn("g0", F.filter("g0", lambda s: ~s["after"].rlike("^[0-9A-Za-z]")))
    n_digits = lambda s: F.length(digits(s["m"]))
    tests = (None, lambda s: _ip_ok(s["m"]), lambda s: luhn(digits(s["m"])), lambda s: (n_digits(s) >= 9) & (n_digits(s) <= 15))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    good = [F.filter(f"s{i}", test) if test else F.col(f"s{i}") for i, test in enumerate(tests)]
    rows = _once(rows, {f"b{i}": F.coalesce(F.transform(good[i], _place(kind)), none) for i, kind in enumerate(KINDS)})
    rows = _once(rows, {"base": F.concat(*[F.col(f"b{i}") for i in range(4)])})
    scored = {f"c{g}": F.filter(F.transform(f"g{g}", _scorer(trees, g)), _at_least(thresholds[g])) for g in range(len(GENERATORS))}
    rows = _once(rows, scored)
    clear = lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    place = lambda kind: lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit(kind).alias("kind"), c["score"].alias("score"))
    empty = F.array().cast("array<struct<start:int,end:int,kind:string,score:double>>")
    clean = [F.coalesce(F.transform(F.filter(f"c{g}", clear), place(kind)), empty) for g, kind in enumerate(ADDED)]
    rows = _once(rows, {"taken": F.array_sort(F.concat(*clean))})
    rows = _once(rows, {"added": _merged(F.col("taken"))})
    return rows.select("doc_id", "text", "base", "added", *[F.size(f"b{i}").cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)])


def _merged(spans: Column) -> Column:
    """Spans in order; those that overlap are one, of the kind that scores best."""
    kind = "struct<start:int,end:int,kind:string,score:double>"
    begin = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(None).cast(kind).alias("now"))

    def step(acc: Column, s: Column) -> Column:
        now = acc["now"]
        best = F.when(s["score"] > now["score"], s["kind"]).otherwise(now["kind"])
        grown = F.struct(now["start"].alias("start"), F.greatest(now["end"], s["end"]).alias("end"), best.alias("kind"), F.greatest(now["score"], s["score"]).alias("score"))
        inside = s["start"] < now["end"]
        done = F.when(now.isNull() | inside, acc["done"]).otherwise(F.concat(acc["done"], F.array(now)))
        return F.struct(done.alias("done"), F.when(inside, grown).otherwise(s).alias("now"))

    end = lambda acc: F.transform(F.when(acc["now"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return F.when(F.size(spans) > 0, F.aggregate(spans, begin, step, end)).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int>>"))


def listed(array: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """The counts, hash and list of spans of each row of docs."""
    return find(docs).select(
        "doc_id", *[f"n_{k}" for k in KINDS],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        (F.size("base") + F.size("added") > 0).alias("has_personal_data"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """doc_id and the text with every span replaced by its kind in brackets (of overlapping ones the first)."""
    every = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    step = lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct(F.concat(acc["done"], F.array(F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("["), s["kind"], F.lit("]")))).alias("done"), s["end"].alias("at")))
    out = F.aggregate(every, F.struct(F.array().cast("array<string>").alias("done"), F.lit(0).alias("at")), step, lambda acc: F.concat(F.array_join(acc["done"], ""), F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return find(docs).select("doc_id", F.when(F.size(every) > 0, out).otherwise(F.col("text")).alias("text"))
