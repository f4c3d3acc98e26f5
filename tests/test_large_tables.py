"""What shows in tables larger than the given ones only."""

import json

import pytest

from tests.compare import compare, duck
from veriframe.plans import oracles, queries


@pytest.mark.parametrize("name", ["assembled_documents"])
def test_ids_beyond_a_million(spark, tmp_path, name):
    """Ids that are those of other records when a million or two are added."""
    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet").filter("p_partkey < 40")
    for shift in (1_000_000, 2_000_000):
        parts.selectExpr("*", f"p_partkey + {shift} as k").drop("p_partkey").withColumnRenamed("k", "p_partkey").unionByName(parts).write.mode("append").parquet(str(tmp_path / "all"))
    spark.read.parquet(str(tmp_path / "all")).distinct().write.parquet(str(tmp_path / "part.parquet"))
    assert compare(spark, duck(str(tmp_path)), name, queries.queries()[name], oracles.oracle_sql()[name], str(tmp_path)) is None


def test_events_beyond_the_limit(spark, tmp_path):
    """As in the SQL of event_log, more results than the limit leave less than nothing."""
    from veriframe.streaming.events import emit, read_events

    kind = "batch_id long, k int, n int, record_id long, status string"
    spark.createDataFrame([(1, k, 3, k, "PASS") for k in (1, 2, 3)], kind).write.parquet(str(tmp_path / "in"))
    emit(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), limit=2).awaitTermination(120)
    done = read_events(spark, str(tmp_path / "out")).filter("type = 'done'").collect()
    assert [json.loads(e["message"]) for e in done] == [{"used": 3, "remaining": -1}]


def test_reads_of_a_long_file(spark, tmp_path):
    """A file is given on in batches, and no batch or line depends on where a chunk of it ends."""
    import io

    from pyspark.sql.types import StructType

    from veriframe.sources import connectors, reads

    odd = "a\r\nb\rc\n\nd\u2028e\x85é\n\r\n last"
    for text in (odd, odd + "\r", "", "\n", "x" * 50):
        data = text.encode() + b"\xff"[: len(text) % 2]
        for chunk in range(1, 12):
            assert list(connectors.split_text(io.BytesIO(data), chunk)) == data.decode("utf-8", "replace").splitlines(), (text, chunk)
    (tmp_path / "long.txt").write_text("\n".join(f"line {i}" for i in range(25_000)))
    reader = reads.ReadsSource({"path": str(tmp_path)}).reader(StructType.fromDDL("line_id int, text string"))
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert max(b.num_rows for b in batches) <= reads.ROWS and len(batches) == 3
    assert [r for b in batches for r in b.to_pylist()] == [{"line_id": i, "text": f"line {i}"} for i in range(25_000)]


def test_similarity_of_many_equal_pairs(spark):
    """Each different pair is measured once, broadcast or not; nulls have no similarity."""
    from pyspark.sql import functions as F

    from veriframe.functions.similarity import similarity
    from veriframe.operators.brand import measured

    rows = spark.createDataFrame([(k, [None, "Blue Heron", "B1ue Herom", ""][k % 4], ["Blue Heron", "Copper Fox", None, "blue heron", ""][k % 5]) for k in range(200)], "k int, a string, b string")
    want = {r["k"]: r["s"] for r in rows.select("k", similarity(F.col("a"), F.col("b"), F.lit(True)).alias("s")).collect()}
    for few in (0, 100):
        got = measured(rows, F.col("a"), F.col("b"), "s", few)
        assert got.count() == 200 and {r["k"]: r["s"] for r in got.select("k", "s").collect()} == want
