"""The query registry: Spark callables and their DuckDB oracle SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tierflow.plans import (label_queries, model_queries, policy_queries, settle_queries,
                            sink_queries, stream_queries, text_queries)
from tierflow.sources.views import with_views


def _families():
    return [settle_queries, label_queries, policy_queries, text_queries, stream_queries,
            sink_queries, model_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict = {}
    for fam in _families():
        out.update(fam.SPARK)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for fam in _families():
        for name, (ctes, body) in fam.ORACLE.items():
            out[name] = with_views(body, ctes)
    return out
