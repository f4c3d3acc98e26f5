"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veriframe.llm.common import table


#: The vocabulary that op8 counts with: a file of a public tokenizer, outside of the repository.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veriframe.llm.op01_substring import repeats

    return repeats(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veriframe.llm.op02_decontaminate import matches

    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veriframe.llm.op03_simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veriframe.llm.op04_license import licenses

    return licenses(table(spark, sf_dir, "documents"))


def op5_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veriframe.llm.op05_pii import report

    return report(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veriframe.llm.op06_line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veriframe.llm.op07_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veriframe.llm.op08_tokens import count_masked

    return count_masked(table(spark, sf_dir, "documents"), VOCABULARY)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veriframe.llm.op09_quality import quality

    return quality(table(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veriframe.llm.op10_mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veriframe.llm.op11_merkle import audit

    return audit(table(spark, sf_dir, "documents"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veriframe.llm.op12_secrets import report

    return report(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veriframe.llm.op13_divergence import audit

    return audit(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from veriframe.llm import op10_mixing, op11_merkle, op13_divergence

    return {"op10_source_mixing": op10_mixing.ORACLE_SQL, "op11_merkle_manifest": op11_merkle.ORACLE_SQL, "op13_source_divergence": op13_divergence.ORACLE_SQL}
