"""Calls of a language model as a stage: the model is a function that the caller brings; nothing here opens a connection.

A prompt's answer is kept in a folder by the hash of model and prompt. Equal prompts are asked once, and a run that is repeated asks only what
has no answer yet. Each task makes its calls one after the other, tries a failed one again, and gives its failures a reason instead of an error, so that one bad
answer doesn't fail the job. A task that is run again after a lost executor asks its own prompts again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.functions import text as T
from veriframe.operators import bins as B
from veriframe.operators import compare as C
from veriframe.shared import met, written

_ANSWERS = "key string, answer string, reason string"


def _stored(spark: SparkSession, store: str) -> DataFrame:
    try:
        return spark.read.schema(_ANSWERS).option("recursiveFileLookup", True).parquet(store).filter("answer is not null")
    except AnalysisException:  # no folder yet
        return spark.createDataFrame([], _ANSWERS)


def ask(prompts: DataFrame, call: Callable[[str], str], store: str, model: str = "", retries: int = 2, budget: int | None = None, calls=None) -> DataFrame:
    """record_id, answer and reason of prompts (record_id, prompt); null prompts have neither.

    reason: null with an answer, else call_failed (after ``retries`` further tries) or over_budget: ``budget`` is the number of prompts that one run may
    ask, those with the least keys. calls: an accumulator that counts the calls made.
    """
    spark = prompts.sparkSession
    keyed = prompts.select("record_id", F.when(F.col("prompt").isNotNull(), F.sha2(F.concat(F.lit(f"{model}\n"), "prompt"), 256)).alias("key"), "prompt")
    known = _stored(spark, store)
    todo = met(keyed.filter("key is not null").groupBy("key").agg(F.any_value("prompt").alias("prompt")), known.select("key"), "key", "left_anti")
    if budget is not None:
        todo = todo.orderBy("key").limit(budget)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, prompt in zip(b["key"], b["prompt"], strict=True):
                answer = None
                for _ in range(retries + 1):
                    if calls is not None:
                        calls.add(1)
                    try:
                        answer = call(prompt)
                        break
                    except Exception:  # whatever a model's client raises
                        continue
                rows.append((key, answer, None if answer is not None else "call_failed"))
            yield pd.DataFrame(rows, columns=["key", "answer", "reason"])

    path = f"{store}/run-{uuid.uuid4().hex}"
    todo.mapInPandas(run, _ANSWERS).write.parquet(path)
    failed = spark.read.schema(_ANSWERS).parquet(path).filter("answer is null").select("key", "reason")
    answers = _stored(spark, store).groupBy("key").agg(F.max("answer").alias("answer"))
    both = met(met(keyed, answers, "key", "left"), failed, "key", "left")
    reason = F.when(F.col("answer").isNull() & F.col("key").isNotNull(), F.coalesce("reason", F.lit("over_budget")))
    return both.select("record_id", "answer", reason.alias("reason"))


def rescue_prompts(compared: DataFrame, reads: DataFrame) -> DataFrame:
    """record_id and prompt (JSON: fields and numbered lines) of each record with a field that isn't PASS and a line to map it to."""
    fields = F.array_sort(F.collect_list(F.struct("field_pos", "field_key")))
    target = compared.filter(F.col("severity") > C.PASS).groupBy("record_id").agg(F.transform(fields, lambda x: x["field_key"]).alias("fields"))
    lines = reads.select("record_id", T.split_lines(F.col("text")).alias("lines")).filter(F.size("lines") > 0)
    return met(target, lines, "record_id").select("record_id", F.to_json(F.struct("fields", "lines")).alias("prompt"))


def rescue(claims: DataFrame, reads: DataFrame, parsed: DataFrame, compared: DataFrame, call: Callable[[str], str], store: str, **options) -> DataFrame:
    """The verdict of each record after a model has re-mapped its unclear fields to lines: the columns of ``rollup`` and reason.

    Only line numbers are taken from an answer, the text is the read's own (see ``bins``). reason: no_targets, no_lines, call_failed, over_budget, bad_payload, nothing_valid
    or rescued; without an answer a record stays as it was.
    """
    answers = written(ask(rescue_prompts(compared, reads), call, store, **options))
    payloads = answers.filter("answer is not null").select("record_id", F.col("answer").alias("payload"))
    good = payloads.filter(B.is_object(F.col("payload")))
    known = lambda df: met(df, good.select("record_id"), "record_id", "left_semi")
    rescued = written(B.rescued_fields(known(compared), B.picked(B.refs(known(reads), good, known(claims)))))
    outcome = B.rescue_outcome(compared, reads, payloads, rescued)
    failed = answers.filter("reason is not null").select("record_id", "reason")
    told = met(outcome, failed, "record_id", "left").select("record_id", F.coalesce("reason", "outcome").alias("reason"))
    return met(C.rollup(C.with_rescue(claims, parsed, rescued, compared=compared)), told, "record_id")
