"""The stages of ``corpus_pipeline``: (spark, docs, sf_dir) -> DataFrame.

Each takes the rows that its predecessor kept and returns the columns it got
(the last one adds the mix). Null ids, texts and sources, repeated rows, empty
tables and further columns are handled as the operators' modules say.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tierflow.llm import decontaminate, minhash, mixing, quality
from tierflow.llm import secrets as secret_scan
from tierflow.llm.common import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or whose host is rejected, go."""
    return quality.passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return minhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; n_chars follows."""
    return secret_scan.redacted(docs, secret_scan.new_ledger(spark), length="n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with size and words taken (repeats counted)."""
    return mixing.mix(docs, keep_text=True).drop("first_budget").filter("taken > 0")
