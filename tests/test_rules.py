"""Rules and reads on small tables, one case for each row of a rule and each oddity."""

import random

import pytest
from pyspark.sql import functions as F

from veriframe.functions import text as T
from veriframe.functions import vocab as V
from veriframe.functions.similarity import ratio, similarity
from veriframe.operators import bins as B
from veriframe.operators import compare as C
from veriframe.operators import extract as E

FULL = "GOVERNMENT WARNING: (1) According to the Surgeon General, women should not drink alcoholic beverages during pregnancy because of the risk of birth defects. (2) Consumption of alcoholic beverages impairs your ability to drive a car or operate machinery, and may cause health problems."


def values(spark, rows, **columns):
    """Columns over rows of (a, b), as a list of tuples."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    out = df.select("i", *[c.alias(k) for k, c in columns.items()]).orderBy("i").collect()
    return [tuple(r)[1:] for r in out]


def verdicts(spark, rule, rows):
    r = rule(F.col("a"), F.col("b"))
    return values(spark, rows, s=r["severity"], r=r["reason"])


def test_numbers(spark):
    rows = [("45% Alc./Vol. (90 Proof)", ""), ("80 PROOF", ""), ("40% vol (90 Proof)", ""), ("12.5 %", ""), ("none", ""), (None, ""), ("750ML", ""), ("1.5 ml x", ""), ("1 L", ""), ("750 mlx", "")]
    got = values(spark, rows, a=T.abv(F.col("a")), m=T.millilitres(F.col("a")))
    assert got == [(45.0, None), (40.0, None), (45.0, None), (12.5, None), (None, None), (None, None), (None, 750.0), (None, 1.5), (None, None), (None, None)]


def test_folds(spark):
    got = values(spark, [("  Old Tom’s  5tar ", ""), (None, "")], b=T.brand_fold(F.col("a")), o=T.confusion_fold(F.col("a")), w=T.ws(F.col("a")))
    assert got == [("OLD TOMS 5TAR", "OLDTOMSSTAR", "Old Tom’s 5tar"), ("", "", "")]
    assert values(spark, [("Government Warning : ( 1 ) a , b ( 2 ) c ..", "")], f=T.warning_fold(F.col("a"))) == [("government warning: (1) a, b (2) c",)]


def test_line_predicates(spark):
    rows = [("Batch 12 Lot 9", ""), ("Small Batch Whiskey", ""), ("Virginia Estate", ""), ("the west hill", ""), ("", ""), ("Bottled in Bond", ""), ("Kentucky Straight", ""), ("( 2 ) Consumption", "")]
    c = F.col("a")
    got = values(spark, rows, lot=T.is_batch_lot(c), noise=T.is_noise(c), discard=T.is_discard(c), body=T.is_body(c), frag=T.is_class_fragment(c), warn=T.is_warning_fragment(c))
    assert got == [
        (True, True, True, False, False, False), (False, False, False, True, False, False),
        (False, False, False, True, False, False),  # "gin" in "Virginia"
        (False, True, True, False, False, False),  # "est " in "west "
        (False, False, True, False, False, False), (False, True, True, False, True, False), (False, False, False, False, True, False), (False, False, False, False, False, True),
    ]


def test_garbled(spark):
    rows = [("", ""), ("0ld T0m", ""), ("Old T0m", ""), ("Old Tom Distillers 7", ""), ("Stone & Mill", ""), ("Bcdfghjkl", ""), ("Blue Heron", "")]
    assert [r[0] for r in values(spark, rows, g=T.is_garbled(F.col("a")))] == [True, True, True, False, True, True, False]


def test_text_rule(spark):
    rows = [("a b", ""), ("A  b", "a B"), ("rye whiskey", "Whiskey Rye"), ("rye whiskey", "rye whisky"), ("a b c d e f g h é", "a b c d e f g h é 1")]
    assert verdicts(spark, C.text_rule, rows) == [(1, "not_read"), (0, "equal"), (0, "same_words"), (2, "different"), (1, "near")]


def test_number_rule(spark):
    rule = lambda a, b: C.number_rule(a, b, T.abv, V.ABV_TOLERANCE)
    assert verdicts(spark, rule, [("45%", "90 proof"), ("45%", "45.25%"), ("45%", "45.2%"), ("45%", ""), (None, "45%")]) == [(0, "equal"), (2, "different"), (0, "equal"), (1, "not_read"), (1, "not_read")]


def test_warning_rule(spark):
    rows = [
        (FULL, ""), (FULL, FULL.replace("GOVERNMENT WARNING", "Government Warning")), (FULL, FULL), (FULL, FULL.lower().replace("government warning", "GOVERNMENT WARNING")), (FULL, FULL.replace("(2) ", "")),
        (FULL, FULL.replace("Surgeon General", "Doctor")), (FULL, FULL.replace("machinery", "machines")), (FULL, FULL + " x y z 1 2 3 4 5 6 7 8 9 10 11"),
    ]
    want = [(1, "not_read"), (2, "header"), (0, "equal"), (0, "equal_folded"), (2, "missing_end"), (2, "missing_part"), (1, "near"), (2, "different")]
    assert verdicts(spark, C.warning_rule, rows) == want


def test_brand_rule(spark):
    rows = [("Old Lantern", ""), ("Old Lantern", "OLD LANTERN!"), ("Old Lantern", "Lantern Old"), ("Old Lantern", "01d Lantern"), ("Old Lantern", "Old Lanterm"), ("Old Lantern", "01d Lantem"), ("Old Lantern", "0ld X4ntexx"), ("Old Lantern", "9 zz 9 qq")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    df = df.withColumn("ratio", similarity(F.col("a"), F.col("b"), T.is_garbled(F.col("b"))))
    r = C.brand_rule(F.col("a"), F.col("b"), F.col("ratio"))
    got = [tuple(x) for x in df.orderBy("i").select(r["severity"], r["reason"]).collect()]
    # letters that digits stand for: 0 is O and 1 is I, so "01d" reads "OID"
    assert [x[1] for x in got][:3] == ["not_read", "equal", "same_words"]
    assert got[3] == (0, "similar") and got[4] == (2, "different") and got[7] == (2, "garbled_different")
    from difflib import SequenceMatcher

    for (a, b), (s, why) in zip(rows[5:7], got[5:7]):
        fold = lambda t: "".join(c for c in t.upper().translate(str.maketrans("015738", "OISTEB")) if c.isalpha())
        ratio = SequenceMatcher(None, fold(a), fold(b)).ratio()
        assert s == (0 if ratio >= 0.82 else 1 if ratio >= 0.68 else 2), (a, b, ratio, why)


def test_reads(spark):
    texts = {
        1: "OLD\nLANTERN\nSmall Batch\nRye Whiskey\n45% Alc./Vol.\n750 mL\nGOVERNMENT WARNING: (1) x\nhealth problems. tail",
        2: "GOVERNMENT WARNING: may cause health problems. Finch Distilling Co.\nwww.x.y",
        3: "Straight Bourbon\nKentucky\nPlain words",
        4: "",
        5: "because alcoholic drinks\nRum drum",
    }
    df = spark.createDataFrame(list(texts.items()), "record_id long, text string")
    got = {r["record_id"]: r for r in E.parse(df).collect()}
    assert (got[1]["brand_name"], got[1]["class_type"], got[1]["net_contents"]) == ("OLD LANTERN Small Batch".replace(" Small Batch", ""), "Small Batch Rye Whiskey", "750 mL")
    assert got[1]["government_warning"] == "GOVERNMENT WARNING: (1) x health problems."
    assert got[2]["brand_name"] == "Finch Distilling Co"
    assert got[3]["class_type"] == "Kentucky Straight Bourbon" and got[3]["brand_name"] == "Plain words"
    assert [got[4][k] for k in V.FIELDS] == [""] * 5
    assert got[5]["alcohol_content"] == "because alcoholic drinks"


def test_repair_and_merge(spark):
    text = "Brand\n45% Alc NVol.\ngovernment warning: (27 Consumption  drive car, and cause health problems__"
    out = values(spark, [(text, "x GOVERNMENT WARNING: new"), ("no header ", "none")], r=T.repair(F.col("a")), m=T.merge_warning(F.col("a"), F.col("b")))
    assert out[0][0] == "Brand\n45% Alc./Vol.\ngovernment warning: (2) Consumption drive a car, and may cause health problems."
    assert out[0][1] == "Brand\n45% Alc NVol.\nGOVERNMENT WARNING: new"
    assert out[1] == ("no header", "no header ")


def test_refs(spark):
    rows = [("[1, 2]", ""), ('"7"', ""), ("3.0", ""), ("3.5", ""), ("true", ""), ("0", ""), ('"0"', ""), ('["1", [2, [3]]]', ""), ("[]", ""), ("null", ""), ('["text", 4]', ""), ("-2", "")]
    got = [r[0] for r in values(spark, rows, n=B.line_refs(F.col("a")))]
    assert got == [[1, 2], [7], [3], [], [], [], [0], [1, 2, 3], [], [], [4], []]


def test_bins_and_rescue(spark):
    claims = spark.createDataFrame([(1, "Old Lantern", "Rye Whiskey", "45%", "750 mL", FULL)], "record_id long, " + ", ".join(f"{k} string" for k in V.FIELDS))
    text = "noise www.a.b\nOld Lantern\nRye Whiskey\n45%\n750 mL\n" + FULL
    reads = spark.createDataFrame([(1, text)], "record_id long, text string")
    payload = spark.createDataFrame([(1, '```json\n{"Brand": ["Old  LANTERN"], "class": [3, 1], "abv": [], "net": [99], "warning": ["6"], "ignore": [1]}\n```')], "record_id long, payload string")
    refs = {r["field_key"]: r["line_nos"] for r in B.refs(reads, payload, claims).collect()}
    assert refs == {"brand_name": [2], "class_type": [3], "alcohol_content": [4], "net_contents": [], "government_warning": [6]}
    fields = B.picked(B.refs(reads, payload, claims))
    r = fields.first()
    assert (r["brand_name"], r["net_contents"], r["government_warning"]) == ("Old Lantern", "", FULL)
    bad = spark.createDataFrame([(1, "", "Rye", "45%", "750 mL", "")], claims.schema)
    rescued = B.rescued_fields(C.compare(claims, bad), fields)
    again = {x["field_key"]: (x["status"], x["rescued"]) for x in C.with_rescue(claims, bad, rescued).collect()}
    assert again["brand_name"] == ("PASS", True) and again["government_warning"] == ("PASS", True) and again["alcohol_content"] == ("PASS", False)
    assert not B.validity(fields, reads).first()["valid"]


def test_rollup_of_unread_record(spark):
    claims = spark.createDataFrame([(1, "a", "b", "45%", "750 mL", FULL)], "record_id long, " + ", ".join(f"{k} string" for k in V.FIELDS))
    out = C.rollup(C.compare(claims, claims.limit(0))).first()
    assert (out["overall_status"], out["failed_keys"], out["rescue_keys"]) == ("REVIEW", "", ",".join(V.FIELDS))


@pytest.mark.parametrize("name", ["text"])
def test_reader_registry(spark, name, tmp_path):
    from veriframe.sources import connectors

    (tmp_path / "one.txt").write_text("Old Lantern\n45%")
    rows = connectors.read_images(spark.read.format("binaryFile").load(str(tmp_path)), name).orderBy("line_id").collect()
    assert [r["text"] for r in rows] == ["Old Lantern", "45%"]
    with pytest.raises(ValueError):
        connectors.reader("none")


def test_claims_file(spark, tmp_path):
    from veriframe.sources.claims import read_claims

    (tmp_path / "c.json").write_text('[{"brand_name": " A ", "sample_file": "x.png", "other": 1}, {"brand_name": null, "sample_file": "y.png"}]')
    rows = {r["sample_file"]: r["brand_name"] for r in read_claims(spark, str(tmp_path / "c.json")).collect()}
    assert rows == {"x.png": "A", "y.png": ""}


def test_similarity_against_difflib(spark):
    """Matching blocks of generated pairs, short and long (where frequent letters begin no run), nulls and empty texts."""
    from difflib import SequenceMatcher

    rng = random.Random(5)

    def edited(w):
        w = list(w)
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 2)] = rng.choices("ABCDE", k=rng.randint(0, 2))
        return "".join(w)

    pairs = [(None, "A"), ("A", None), ("", "A"), ("A", "")]
    for _ in range(8000):
        one = "".join(rng.choices("ABCDé日"[: rng.randint(2, 6)], k=rng.choice((0, 1, 2, 5, 8, 15, 25))))
        pairs.append((one, edited(one) if rng.random() < 0.6 else "".join(rng.choices("ABCD", k=rng.randint(0, 20)))))
    for _ in range(30):
        one = "".join(rng.choices("ABCDEFGHIJKLMNOP", weights=range(1, 17), k=rng.randint(150, 330)))
        pairs += [(one, edited(edited(one))), (edited(one)[:40], one)]
    for r in spark.createDataFrame(pairs, "a string, b string").repartition(16).select("a", "b", ratio(F.col("a"), F.col("b")).alias("r")).collect():
        a, b = r["a"], r["b"]
        want = None if a is None or b is None else 0.0 if not a or not b else SequenceMatcher(None, a, b).ratio()
        assert (r["r"] is None) == (want is None) and (want is None or abs(r["r"] - want) < 1e-12), (a, b)
