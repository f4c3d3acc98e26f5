import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tests.compare import compare, duck
from veriframe.llm import op11_merkle as op

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, row string, digest int, level binary"


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(r):
    return digest("".join("-" if r[c] is None else f"{len(str(r[c]).encode())}:{r[c]}" for c in op.FIELDS))


def tree(nodes, fanout=3):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    return levels


def siblings(levels, i, fanout=3):
    out = []
    for level in levels[:-1]:
        first = i // fanout * fanout
        out.append(("".join(level[first:i]), "".join(level[i + 1 : first + fanout])))
        i //= fanout
    return out


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in by[s]])
    top = tree([trees[s][-1][0] for s in names])
    root, out = top[-1][0], []
    for k, s in enumerate(names):
        for i, r in enumerate(by[s]):
            proof, now = siblings(trees[s], i) + siblings(top, k), dict(r)
            if r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                now["text"] = r["text"].replace("\n", "")
            node = leaf(now)
            for a, b in proof:
                node = digest(a + node + b)
            out.append((r["doc_id"], leaf(r), trees[s][-1][0], root, digest("".join(a + b for a, b in proof)), node, node == root))
    return out


def ordered(rows):
    return sorted(rows, key=lambda t: tuple(map(str, t)))


def odd_rows():
    """Nulls in any column, empty and very long texts, repeated ids and rows, sources of 1, 2, 3, 4, 81, 82 and 250 rows."""
    rng, rows = random.Random(11), []
    for name, n in (("", 1), (None, 2), ("a", 3), ("B", 4), ("é", 81), ("\U0001f600", 82), ("￮", 250)):
        for _ in range(n):
            text = rng.choice((None, "", "\n", "one\ntwo", "no end", "ünï\ncode\n", "x"))
            rows.append((rng.choice((None, 7, rng.randrange(-500, 500))), name, rng.choice((None, "", "en")), rng.choice((None, 0, 12)), text, "r", 1, b"l"))
    return [*rows, (4, "a", "en", 3, "long line\n" * 300_000, "r", 1, b"l"), rows[5], rows[5]]


@pytest.mark.parametrize("stride", [4, 1])
def test_against_whole_trees(spark, stride):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    got = op.audit(docs.repartition(7), stride).collect()
    want = brute([r.asDict() for r in docs.collect()])
    assert ordered(map(tuple, got)) == ordered(want)
    assert {r["verified"] for r in got} == {True, False}


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = op.audit(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert ordered(map(tuple, got.collect())) == ordered(brute([r.asDict() for r in docs.collect()]))
    assert compare(spark, duck(SF), "op11", lambda s, d: got, op.ORACLE_SQL, SF) is None


def test_manifest_proves_each_row(spark):
    """Other fields, groups and fan-outs; a changed, moved or foreign leaf doesn't lead to the root."""
    rows = [(i, i % 2, f"t{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "k int, g int, t string")
    for fanout, stride in ((2, 3), (5, 2)):
        proofs = op.manifest(docs, ("k", "t"), "g", "k", fanout, stride)
        assert proofs.filter(op.fold(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
        assert proofs.select("root").distinct().count() == 1 and proofs.select("subroot").distinct().count() == 2
        assert proofs.filter(op.fold(F.sha2(F.col("leaf"), 256), F.col("proof")) == F.col("root")).count() == 0
        by = {r["k"]: r for r in proofs.collect()}
        leaves = tree([by[k]["leaf"] for k in range(0, 300, 2)], fanout)
        assert by[0]["subroot"] == leaves[-1][0] and len(by[0]["proof"]) == len(leaves)


def test_one_row_and_none(spark):
    docs = spark.createDataFrame([(1, None, None, None, None, "r", 1, b"l")], SCHEMA)
    (r,) = op.audit(docs).collect()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] == digest("1:1----") and r["proof_sha256"] == digest("")
    assert op.audit(docs.limit(0)).count() == 0
