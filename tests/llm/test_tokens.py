import random

import pytest

from veriframe.llm import op08_tokens as op
from veriframe.llm.queries import VOCABULARY


@pytest.fixture(scope="module")
def counter():
    return op.Counter(op.read_ranks(VOCABULARY))


def full(counter, text):
    return len(counter._bpe.encode_ordinary(text))


def test_random_edits_against_full_encoding(counter):
    rng = random.Random(4)
    parts = ["a", " ", "  ", "\n", "the", " of", "'s", "'", "12", "é", "日本", ".", "!!", "\t", " ", "ll", " we", "<|endoftext|>", "x" * 40]
    for trial in range(250):
        text = "".join(rng.choices(parts, k=rng.choice((0, 1, 5, 60, 600))))
        tree = op.Tree(text, counter)
        assert tree.tokens == full(counter, text)
        for _ in range(rng.randint(1, 8)):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.choice((0, 0, 1, 2, 5, 50, 1000)))
            new = "".join(rng.choices(parts, k=rng.choice((0, 0, 1, 2, 5, 80))))
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.text() == text
            assert tree.tokens == full(counter, text), (trial, a, b, new)
            assert tree.chars == len(text)


def test_edits_are_local(counter):
    tree = op.Tree("some words in a long text. " * 4000, counter)
    tree.edit(50_000, 50_003, "new")
    assert tree.encoded < 10


def test_rows(spark, counter):
    rows = [(1, "pay 123456 to 7777 now", "x"), (2, None, ""), (3, "", ""), (None, "12345", ""), (1, "pay 123456 to 7777 now", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = op.count_masked(df, VOCABULARY).collect()
    assert len(out) == 5
    r = next(r for r in out if r["doc_id"] == 1)
    assert (r["n_edits"], r["n_tokens_after"], r["n_chars_after"]) == (2, full(counter, "pay 0 to 0 now"), 14)
    assert next(r for r in out if r["doc_id"] == 2)["n_tokens"] == 0
    assert op.count_masked(df.limit(0), VOCABULARY).count() == 0


def test_given_edits_and_a_long_pretoken(spark, counter):
    long = "x" * 200_000
    rows = [(1, f"a {long} b", [(2, 5, "yy"), (200_000, 200_002, None)]), (2, "abc", None), (3, "abc", [])]
    df = spark.createDataFrame(rows, f"doc_id int, text string, edits {op.EDITS}")
    out = {r["doc_id"]: r for r in op.count_tokens(df, VOCABULARY).collect()}
    assert out[1]["n_tokens_after"] == full(counter, f"a yy{long[5:]} b") and out[1]["n_edits"] == 2
    assert out[2]["n_tokens"] == out[3]["n_tokens_after"] == full(counter, "abc")


def test_no_vocabulary():
    with pytest.raises(FileNotFoundError, match="no vocabulary"):
        op.read_ranks("/nowhere.tiktoken")


def test_edits_that_overlap_are_an_error():
    good = [(0, 2, "a"), (2, 2, "b"), (5, 9, "")]
    assert op._in_order(good, 9) == good
    for bad in ([(3, 5, ""), (1, 2, "")], [(0, 4, ""), (3, 5, "")], [(4, 3, "")], [(8, 10, "")], [(-1, 2, "")]):
        with pytest.raises(ValueError, match="sorted, disjoint"):
            op._in_order(bad, 9)
