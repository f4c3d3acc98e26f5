"""Cases of reads, payloads and turned images, one by one."""

import pytest
from pyspark.sql import functions as F

from veriframe.functions import text as T
from veriframe.operators import bins as B
from veriframe.operators import compare as C
from veriframe.operators import extract as E
from veriframe.operators import lines as L
from veriframe.operators import regions as R


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("a\n\t\nb", ["a", "b"]), ("\tBrand \n \n x ", ["Brand", "x"]), ("a\r\nb\x0bc d\x1ee", list("abcde")), (None, []), ("", [])],
)
def test_lines(spark, text, want):
    assert one(spark, text, T.split_lines) == want


def test_repair_takes_two_marks_at_most(spark):
    assert one(spark, "(27 Consumption (27 Consumption (27 Consumption", T.repair) == "(2) Consumption (2) Consumption (27 Consumption"
    assert one(spark, "(27 consumption", T.repair) == "(27 consumption"
    text = "Brand\nGovernment Warning : drive car , and cause health problems__"
    assert one(spark, text, T.repair) == "Brand\nGovernment Warning : drive a car , and may cause health problems."


@pytest.mark.parametrize(
    ("refs", "numbers", "texts"),
    [
        ('"Old Lantern"', [], ["Old Lantern"]), ('["Stone, 2, Mill"]', [], ["Stone, 2, Mill"]), ('"5, 1"', [], ["5, 1"]), ('"3.0"', [], ["3.0"]), ("3", [3], []),
        ("[3,[2,[\"7\"]],true,null,0,-1,2.5]", [3, 2, 7], []), ('" 4 "', [4], []), ('["a \\"q\\" b",["x"]]', [], ['a "q" b']), ("null", [], []), ('{"a":[1]}', [], []), ('""', [], []),
    ],
)
def test_refs_keep_the_kind_of_their_json(spark, refs, numbers, texts):
    assert one(spark, refs, B.line_refs) == numbers
    assert (one(spark, refs, B.text_refs) or []) == texts


def test_refs_by_text(spark):
    reads = spark.createDataFrame([(1, "Old Lantern\nRye Whiskey\n45% alc\n750 mL\nStone, 2, Mill")], "record_id long, text string")
    claims = spark.createDataFrame([(1, "Old Lantern", "Rye Whiskey", "45%", "750 mL", "")], "record_id long, brand_name string, class_type string, alcohol_content string, net_contents string, government_warning string")
    for payload, want in (('{"brand": "old  lantern"}', [1]), ('{"brand": ["Stone, 2, Mill"]}', [5]), ('```json\n{"brand": "nowhere"}\n```', [1]), ('{"brand": [9, 5, 5]}', [5])):
        payloads = spark.createDataFrame([(1, payload)], "record_id long, payload string")
        assert B.refs(reads, payloads, claims).filter("field_key = 'brand_name'").first()["line_nos"] == want


def test_outcomes(spark):
    compared = spark.createDataFrame([(k, "brand_name", s) for k, s in ((1, 0), (2, 2), (3, 1), (4, 2), (5, 2))], "record_id long, field_key string, severity int")
    reads = spark.createDataFrame([(1, "a"), (2, " \t\n"), (3, "a"), (4, "a"), (5, "a")], "record_id long, text string")
    payloads = spark.createDataFrame([(1, "{}"), (2, "{}"), (3, "[1]"), (4, "{}"), (5, "{}")], "record_id long, payload string")
    rescued = spark.createDataFrame([(k, "x" if k == 5 else "", "", "", "", "") for k in range(1, 6)], "record_id long, brand_name string, class_type string, alcohol_content string, net_contents string, government_warning string")
    got = {r["record_id"]: r["outcome"] for r in B.rescue_outcome(compared, reads, payloads, rescued).collect()}
    assert got == {1: "no_targets", 2: "no_lines", 3: "bad_payload", 4: "nothing_valid", 5: "rescued"}


def test_claims_are_shown_where_words_or_letters_agree(spark):
    names = "record_id long, brand_name string, class_type string, alcohol_content string, net_contents string, government_warning string"
    claims = spark.createDataFrame([(1, "Old Lantern", "Rye Whiskey", "", "", ""), (2, "Blue Heron", "Rye", "", "", "")], names)
    reads = spark.createDataFrame([(1, "Lantern Old", "Whiskey Rye", "", "", ""), (2, "Blue Horizon", "Rum", "", "", "")], names)
    got = {(r["record_id"], r["field_key"]): (r["status"], r["shown"]) for r in C.compare(claims, reads).collect()}
    assert got[1, "brand_name"] == ("PASS", "Old Lantern") and got[1, "class_type"] == ("PASS", "Rye Whiskey")
    assert got[2, "brand_name"] == ("FAIL", "Blue Horizon")
    only = C.compare(claims, reads, fields=("brand_name",))
    assert only.count() == 2 and "c_class_type" not in only._jdf.queryExecution().executedPlan().toString()


WARNING = "GOVERNMENT WARNING: (1) According to the Surgeon General, women should not drink during pregnancy. (2) may cause health problems."


def test_turns(spark):
    label = f"Old Lantern Distillery\nKentucky Straight Bourbon Whiskey\n45% Alc./Vol. (90 Proof)\n750 mL\n{WARNING}"
    rows = [(1, 0, label, 150.0), (1, 180, label, 900.0), (2, 0, "xx yy", 9.0), (2, 90, label, 150.0), (2, 180, "zz", 8.0), (3, 0, "abc def", 5.0), (3, 90, "abc deg", 5.05)]
    got = {r["record_id"]: (r["angle"], r["upright"]) for r in R.best_read(spark.createDataFrame(rows, "record_id long, angle int, text string, score double")).collect()}
    assert got == {1: (0, True), 2: (90, False), 3: (0, False)}
    skews = [(1, 0, 0, label, 100.0), (1, 1, -6, label, 104.0), (1, 2, 6, label, 104.0), (2, 0, 0, label, 100.0), (2, 1, 3, label, 190.0)]
    df = spark.createDataFrame(skews, "record_id long, pos int, skew int, text string, score double")
    assert {r["record_id"]: r["skew"] for r in R.best_skew(df).collect()} == {1: -6, 2: 0}
    assert {r["skew"] for r in R.best_skew(df, readable=0.45).collect()} == {0}


def test_orientation(spark):
    rows = [
        (1, 0, True, 180, 9.0, 1.0, 0, 3, True), (2, 0, False, 90, 9.0, 1.0, 90, 0, True), (3, 90, False, 0, 1.0, 1.0, None, 3, True), (4, 90, False, 0, 1.0, 1.0, 0, 3, False), (5, 0, True, 90, 9.0, 1.0, 90, 0, True),
    ]
    df = spark.createDataFrame(rows, "record_id long, angle int, upright boolean, brand_angle int, brand_score double, brand_upright double, warning_angle int, skew int, sweeps boolean")
    out = R.orientation(df).withColumn("reason", C.rotation_reason(*map(F.col, C.ROTATION[:5])))
    got = {r["record_id"]: (r["decision"], r["rotation_deg"], r["skew_deg"], r["reason"]) for r in out.collect()}
    assert got == {1: ("per_region", 0, 0, "per_region"), 2: ("uniform", 90, 0, "turned"), 3: ("whole", 90, 3, "turned_and_tilted"), 4: ("direct", 0, 0, ""), 5: ("whole", 0, 0, "")}
    assert out.filter("record_id = 1").first()["brand_inverted"]


def test_merged_reads_and_documents_without_lines(spark):
    a = spark.createDataFrame([(1, "Brand\nGOVERNMENT WARNING: old", ["Brand", "x"])], "record_id long, text string, raw_lines array<string>")
    b = spark.createDataFrame([(1, "noise\nGovernment Warning: new one", ["X", "y", "Y", "z"])], a.schema)
    r = L.merged_reads(a, b).first()
    assert r["text"] == "Brand\nGovernment Warning: new one." and r["raw_lines"] == ["Brand", "x", "y", "z"]
    lines = spark.createDataFrame([(1, 1, "zzz", 0.9, 10.0, 0.0, 0.0, 20.0, 9.0)], "record_id long, line_id int, text string, confidence double, y_center double, x_min double, y_min double, y_max double, x_max double")
    documents = spark.createDataFrame([(1, "whole"), (2, "only text")], "record_id long, full_text string")
    assert {x["record_id"]: x["text"] for x in E.assemble(lines, documents).collect()} == {1: "zzz", 2: "only text"}


def test_assembled_brand_is_no_later_distillery(spark):
    f = E.flagged(spark.createDataFrame([(1, ["GOVERNMENT WARNING: x", "Old Lantern Distillery"])], "record_id long, l array<string>"), F.col("l"))
    assert f.select(E.brand_read(F.col("f"))).first()[0] == "Old Lantern Distillery"


def test_turn_search(spark):
    """Quarter turns first; then only the small turns of the list that belongs to the angle, at that angle."""
    from veriframe.functions import vocab as V

    records = spark.createDataFrame([(1,), (2,)], "record_id long")
    assert R.coarse_turns(records).count() == 8
    fine = R.fine_turns(spark.createDataFrame([(1, 0), (2, 90)], "record_id long, angle int"))
    got = {k: tuple(r["skew"] for r in sorted(fine.filter(F.col("record_id") == k).collect(), key=lambda r: r["pos"])) for k in (1, 2)}
    assert got == {1: V.SKEWS, 2: V.SKEWS_TURNED}
    label = "GOVERNMENT WARNING: Surgeon General 45% alc 750 ml whiskey"
    rows = [(1, 0, 0, label, 10.0), (1, 0, 12, label, 30.0), (1, 0, 6, label, 20.0), (1, 90, 0, "x", 1.0), (1, 90, 6, label, 900.0)]
    rows += [(2, 0, 0, "x", 1.0), (2, 90, 0, label, 100.0), (2, 90, 12, label, 500.0), (2, 90, 3, label, 400.0)]
    out = R.turn_search(spark.createDataFrame(rows, "record_id long, angle int, skew int, text string, score double"))
    # 12 degrees aren't in the list of turned texts, and 3 are too small a turn to be worth it
    assert {r["record_id"]: (r["angle"], r["skew"]) for r in out.collect()} == {1: (0, 12), 2: (90, 0)}


def test_reader_report(spark):
    results = spark.createDataFrame([("a", 1, "PASS", 1.0), ("a", 2, "REVIEW", 3.0), ("a", 3, "FAIL", 2.0), ("a", 9, "PASS", 50.0), ("b", 1, "FAIL", None)], "reader string, record_id long, overall_status string, seconds double")
    expected = spark.createDataFrame([(1, "PASS"), (2, "PASS"), (3, "FAIL")], "record_id long, expected string")
    got = {r["reader"]: tuple(r)[1:] for r in C.reader_report(results, expected).select("reader", "n", "correct_pass", "correct_fail", "review", "median_seconds").collect()}
    assert got == {"a": (3, 1, 1, 1, 2.0), "b": (1, 0, 0, 0, 0.0)}
