"""The pipeline's stages against brute force, each on its own input."""

import random

import pytest

import corpus_pipeline as pipeline
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_quality import brute as counts
from tests.llm.test_near_copies import brute as near_brute
from veriframe.llm import op06_line_dedup, op09_quality, op10_mixing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        before = docs
        docs = pipeline.materialize(stage(spark, docs, SF))
        out.append((name, before, docs))
    return {name: (a, b) for name, a, b in out}


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns(staged):
    for name, (before, after) in staged.items():
        assert after.columns[: len(before.columns)] == before.columns
        assert name == "mix_sources" or after.columns == before.columns


def test_quality(staged):
    before, after = map(texts, staged["quality_rules"])
    for d, t in before.items():
        if counts(t)[5]:
            assert d not in after
        elif d not in after:
            assert op09_quality.judge([t.encode()])[0][9] in ("repetitive", "incompressible", "chunks")
    assert len(after) > 0.85 * len(before)


def test_line_dedup(staged):
    before, after = map(texts, staged["line_dedup"])
    for d, t in after.items():
        assert t == before[d] or set(t.split("\n")) <= set(before[d].split("\n"))
    # no line of MIN_WORDS words is left twice
    seen = {}
    for d, t in after.items():
        for line in t.split("\n"):
            if len(line.split()) >= op06_line_dedup.MIN_WORDS:
                assert line not in seen, (d, seen[line])
                seen[line] = d
    # every line that is gone stands somewhere before
    left = {" ".join(line.split()) for t in after.values() for line in t.split("\n")}
    for d, t in before.items():
        assert {" ".join(line.split()) for line in t.split("\n")} <= left


def test_near_dedup(staged):
    """By the Jaccard similarity of all pairs of texts."""
    before, after = map(texts, staged["near_dedup"])
    groups = near_brute(list(before.items()))
    assert set(after) == {min(d for _, d, _ in members) for members in groups.values()}


def test_decontaminate(spark, staged):
    before, after = map(texts, staged["decontaminate"])
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert set(before) - set(after) == {d for d, _ in leaks(list(before.items()), items)}


def test_mix(staged):
    before, after = staged["mix_sources"]
    want = {r["doc_id"]: r["copies"] for r in op10_mixing.mix(before).collect() if r["copies"]}
    got = {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert got == want


def test_run(spark, staged):
    assert pipeline.run(spark, SF).count() == staged["mix_sources"][1].count()


def test_stages_with_odd_rows(spark):
    """Nulls in any column, empty texts, repeated rows, clashing names, an empty table."""
    rng = random.Random(1)
    words = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(90))
    names = "doc_id long, text string, lang string, source string, n_chars long, n_lines int, row string, copy_no int, key string"
    rows = [(1, words, "en", "a", 700, 1, "r", 2, "k"), (None, words, None, None, None, None, None, None, None), (2, None, None, None, None, None, None, None, None), (3, "", "en", "b", 0, 0, "", 0, ""), (1, words, "en", "a", 700, 1, "r", 2, "k")]
    docs = spark.createDataFrame(rows, names)
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns[: len(docs.columns)] == docs.columns
        got = out.collect()
        if name == "quality_rules":
            assert [r["doc_id"] for r in got].count(1) == 2 and {r["doc_id"] for r in got} <= {1, None}
        if name == "near_dedup":
            assert sorted(r["doc_id"] for r in got) == [1, 2]
        if name == "decontaminate":
            assert len(got) == 5
        assert stage(spark, docs.limit(0), SF).count() == 0
