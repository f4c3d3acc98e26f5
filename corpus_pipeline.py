"""A training-data pipeline: quality rules, line dedup, near-dedup, decontamination, mixing.

Each stage takes what its predecessor kept, as a table, and returns the rows that it keeps. ``run`` writes
every stage's rows to the shared folder and reads them again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe import ship
from veriframe.llm import near_copies, op02_decontaminate, op06_line_dedup, op09_quality, op10_mixing
from veriframe.llm.common import discard, materialize, table, unused

#: zstandard ratios and hashes of shingles have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. Null and empty texts have no word and go; repeated rows fare alike."""
    ship(spark)
    return op09_quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go; a document of which nothing is left goes with them.

    Null texts and texts without a line stay as they are; repeated rows fare alike; n_chars, where docs has it, follows the text.
    """
    ship(spark)
    lines, deleted = unused(docs, "n_lines"), unused(docs, "n_deleted")
    done = op06_line_dedup.dedup_lines(docs, lines, deleted).filter(f"{lines} = 0 or {deleted} < {lines}")
    if "n_chars" in docs.columns:
        now = F.when(F.col(deleted) > 0, F.length("text")).otherwise(F.col("n_chars"))
        done = done.withColumn("n_chars", now.cast(docs.schema["n_chars"].dataType))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the least doc_id (null last, then by text).

    Rows without a word are copies of each other; rows that repeat id and text are one.
    """
    ship(spark)
    return near_copies.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go. Null texts have none and stay; repeated rows fare alike."""
    ship(spark)
    return op02_decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, with copy_no. Null sources are one source; rows without a word count 0 words."""
    ship(spark)
    return op10_mixing.emit(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
        if last is not None:
            discard(last)
        last = docs
    return docs
