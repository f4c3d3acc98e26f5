import random

import pytest

from tests.compare import compare, duck
from veriframe.llm import op10_mixing as op
from veriframe.llm import queries


def waterfill(sizes):
    """Share by weight, stop at the caps, share the excess again, in a loop."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: op.WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, full, out = 1.5 * sum(sizes.values()), set(), {}
    while True:
        rest = [s for s in names if s not in full]
        share = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 2 * sizes[s] + 1e-9]
        if not over:
            return out | share
        for s in over:
            full.add(s)
            out[s] = 2.0 * sizes[s]
            left -= out[s]


def docs():
    rng = random.Random(2)
    rows = []
    for i in range(3000):
        source = rng.choice(["hot"] * 8 + ["a", "B", "é", None, "z1", "z2", "z3"])
        rows.append((i, None if i % 101 == 0 else "w " * int(rng.paretovariate(1.1) * 5 % 4000), source, "x"))
    return rows + [(7, "a b c", "hot", "x")] * 5 + [(None, "a b", "empty", "x"), (9001, "", "zero", "x")]


def test_targets_and_taken(spark):
    rows = docs()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    out = op.mix(df, cell_rows=50).collect()
    assert len(out) == len(rows)
    assert sorted(map(str, out)) == sorted(map(str, op.mix(df.repartition(7), cell_rows=50).collect()))
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, taken, largest = waterfill(sizes), {}, {}
    for r in out:
        s = r["source"]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        largest[s] = max(largest.get(s, 0), r["size"])
    assert all(abs(taken[s] - want[s]) <= 1.2 * largest[s] + 1 for s in want)
    mixed = op.emit(df, cell_rows=50)
    assert mixed.columns == [*df.columns, "copy_no"]
    assert mixed.count() == sum(r["copies"] for r in out)
    assert sorted(map(str, mixed.collect())) == sorted(map(str, op.emit(df.repartition(5), cell_rows=50).collect()))


def test_clashing_columns_and_rows_repeated_often(spark):
    rows = [(None, None, "a b c", 1, 2, {"x": 1})] * 25_000 + [(k, "s", f"w {k}", 3, 4, {}) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, copy_no int, key int, size map<string,int>").repartition(8)
    out = op.emit(df)
    assert out.columns == [*df.columns, "copy_no_"]
    plan = op.mix(df)
    assert out.count() == plan.agg({"copies": "sum"}).first()[0] and plan.count() == len(rows)
    assert abs(plan.filter("source is null").agg({"taken": "sum"}).first()[0] - plan.filter("source is null").first()["target"]) <= 6


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert op.mix(df).count() == 0 and op.emit(df).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    assert compare(spark, duck(path), "op10", queries.op10_source_mixing, op.ORACLE_SQL, path) is None


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame(docs(), "doc_id long, text string, source string, size string").coalesce(1)
    plan = op.mix(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
