"""Registered queries: SQL where there is some, plans, and the pipeline."""
import corpus_pipeline
import pytest

from tests.conftest import SF_SMALL
from tests.oracle import compare
from tierflow.llm.queries import ORACLES, QUERIES


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, len(QUERIES) + 1))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, duck_small, name):
    a, b = compare(QUERIES[name](spark, SF_SMALL), duck_small, ORACLES[name])
    assert a == b


@pytest.mark.parametrize("name", ["op9_secrets"])
def test_native_plans_have_no_python(spark, name):
    plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_pipeline(spark):
    docs = spark.read.parquet(SF_SMALL + "/documents.parquet")
    n, columns = docs.count(), docs.columns
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert out.columns[:len(columns)] == columns
    got = out.collect()
    assert 0 < len(got) < n and len({r.doc_id for r in got}) == len(got)
    assert all(0 < r.taken <= 2 * r["size"] for r in got)


def test_stages_take_odd_rows(spark, docs, odd, nothing):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == docs.columns and out.count() <= len(odd)
        assert stage(spark, nothing, SF_SMALL).count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, SF_SMALL).count() <= len(odd)
    assert last(spark, nothing, SF_SMALL).count() == 0
