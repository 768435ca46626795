"""A corpus pipeline: five stages over ``documents``, each written as Parquet
and read again as the next one's input.

Each stage reads all that its predecessor kept. The first four return the
columns of ``documents``; the last adds how many words the mix takes of each
document and leaves out those it takes none of.
"""
from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from tierflow.llm import pipeline_stages as S
from tierflow.session import checkpoint_path

STAGES = [
    ("quality", S.quality_rules),
    ("near_dedup", S.near_dedup),
    ("decontamination", S.decontamination),
    ("secrets", S.secrets),
    ("mix", S.mix),
]

#: Near-duplicate classes and the mix's hash thresholds aren't SQL; the tests
#: hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    top = checkpoint_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{top}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
