"""Readers and writers of claims, reads and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriframe.functions.vocab import FIELDS

CLAIM = T.StructType([T.StructField(k, T.StringType()) for k in FIELDS])
CLAIM_FILE = T.StructType([*CLAIM.fields, T.StructField("sample_file", T.StringType())])


def read_claims(spark: SparkSession, path: str, strip: bool = True) -> DataFrame:
    """Claims of a JSON array file, with sample_file as the key; other keys are ignored, missing values empty."""
    return _filled(spark.read.schema(CLAIM_FILE).option("multiLine", True).json(path), strip)


def parse_claims(df: DataFrame, column: str, strip: bool = False) -> DataFrame:
    """A row (pos from 0, fields) for each claim in a column of JSON arrays; fails on bad JSON."""
    rows = df.select("*", F.posexplode(F.from_json(column, T.ArrayType(CLAIM), {"mode": "FAILFAST"})).alias("pos", "c"))
    return _filled(rows.select(*[c for c in df.columns if c != column], "pos", "c.*"), strip)


def _filled(df: DataFrame, strip: bool) -> DataFrame:
    value = lambda k: F.trim(F.coalesce(k, F.lit(""))) if strip else F.coalesce(k, F.lit(""))
    return df.withColumns({k: value(k) for k in FIELDS})


def pair_by_position(images: DataFrame, claims: DataFrame) -> DataFrame:
    """Images and claims (both with batch_id and pos) of batches that have as many of either; k and n for progress."""
    count = lambda df, name: df.groupBy("batch_id").agg(F.count("*").alias(name))
    good = count(images, "n").join(count(claims, "m"), "batch_id").filter("n = m").select("batch_id", "n")
    return images.join(claims, ["batch_id", "pos"]).join(good, "batch_id").withColumn("k", F.col("pos") + 1)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
