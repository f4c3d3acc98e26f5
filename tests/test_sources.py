"""Sources and sinks: reads from folders, events of streams, calls of a model."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veriframe import ship
from veriframe.plans import corpus as K
from veriframe.plans import queries
from veriframe.sources import models, reads
from veriframe.streaming.events import emit, read_events

SF = "/root/testdata/sf0.001"


def test_reads_source(spark, tmp_path):
    ship(spark)
    reads.register(spark)
    for i in range(12):
        (tmp_path / f"r{i:02d}").write_text("".join(f"line {i} {j}\n" for j in range(i)))
    (tmp_path / "_SUCCESS").write_text("")
    df = spark.read.format(reads.NAME).option("path", str(tmp_path)).option("partitionbytes", 60).load()
    assert df.rdd.getNumPartitions() > 3
    assert Counter(r["record_id"][-3:] for r in df.collect()) == {f"r{i:02d}": i for i in range(1, 12)}
    some = df.filter(F.col("record_id") == str(tmp_path / "r05"))
    assert [r["text"] for r in some.orderBy("line_id").collect()] == [f"line 5 {j}" for j in range(5)]
    assert df.select("text").count() == 66
    narrow = spark.read.format(reads.NAME).schema("text string, line_id int").option("path", str(tmp_path)).load()
    assert narrow.columns == ["text", "line_id"] and narrow.count() == 66
    assert spark.read.format(reads.NAME).option("path", str(tmp_path / "none")).load().count() == 0
    with pytest.raises(Exception, match="unknown reader"):
        spark.read.format(reads.NAME).option("path", str(tmp_path)).option("reader", "nobody").load().count()


def test_events_of_a_restarted_stream(spark, tmp_path):
    ship(spark)
    kind = "batch_id long, k int, n int, record_id long, status string"

    def arrive(first, last):
        spark.createDataFrame([(1, k, 6, 100 + k, "PASS") for k in range(first, last)], kind).coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        emit(stream, str(tmp_path / "out"), str(tmp_path / "cp"), limit=10).awaitTermination(120)

    arrive(1, 4)
    run()
    # as after a crash between the sink's commit and the stream's own: the micro-batch runs again
    for log in (tmp_path / "cp" / "commits").iterdir():
        if log.name in ("0", ".0.crc"):
            log.unlink()
    run()
    arrive(4, 7)
    run()
    events = read_events(spark, str(tmp_path / "out")).collect()
    assert Counter(e["type"] for e in events) == {"log": 6, "result": 6, "done": 2}
    assert sorted(e["message"] for e in events if e["type"] == "log") == [f"[{k:03d}/006] {100 + k}" for k in range(1, 7)]
    assert sorted((e["micro_batch"], json.loads(e["message"])["used"], json.loads(e["message"])["remaining"]) for e in events if e["type"] == "done") == [(0, 3, 7), (1, 6, 4)]
    assert read_events(spark, str(tmp_path / "nothing")).count() == 0


def test_model_calls(spark, tmp_path):
    ship(spark)
    calls, store = spark.sparkContext.accumulator(0), str(tmp_path / "answers")
    prompts = spark.createDataFrame([(1, "a"), (2, "a"), (3, "bad"), (4, None), (5, "c")], "record_id long, prompt string")

    def model(prompt):
        if prompt == "bad":
            raise RuntimeError("no")
        return prompt.upper()

    got = {r["record_id"]: (r["answer"], r["reason"]) for r in models.ask(prompts, model, store, retries=1, calls=calls).collect()}
    assert got == {1: ("A", None), 2: ("A", None), 3: (None, "call_failed"), 4: (None, None), 5: ("C", None)}
    assert calls.value == 4  # a, c, and bad twice
    more = prompts.union(spark.createDataFrame([(6, "d"), (7, "e")], prompts.schema))
    got = {r["record_id"]: (r["answer"], r["reason"]) for r in models.ask(more.filter("record_id <> 3"), model, store, budget=1, calls=calls).collect()}
    assert calls.value == 5 and got[1] == ("A", None) and sorted([got[6][1] or "", got[7][1] or ""]) == ["", "over_budget"]
    assert models.ask(prompts, model, store, model="another", budget=0).filter("answer is not null").count() == 0


def test_rescue_by_a_model(spark, tmp_path):
    """Failures of the model are reasons; its answers change verdicts as payloads do."""
    p = queries.parsed(spark, SF).drop("raw_lines").cache()
    claims, lines = K.claims(spark, SF), K.reads(spark, SF)
    from veriframe.operators import compare as C

    compared = C.compare(claims, p).cache()

    def model(prompt):
        if "www.example.com" in prompt:
            raise RuntimeError("no")
        return '{"brand_name": [1], "net_contents": [5]}' if "Bottled" in prompt else "no json"

    out = models.rescue(claims, lines, p, compared, model, str(tmp_path / "store")).collect()
    assert len(out) == claims.count()
    assert set(Counter(r["reason"] for r in out)) >= {"call_failed", "bad_payload"}
    before = {r["record_id"]: r["overall_status"] for r in C.rollup(compared).collect()}
    assert all(before[r["record_id"]] == r["overall_status"] for r in out if r["reason"] in ("call_failed", "bad_payload", "no_targets"))
