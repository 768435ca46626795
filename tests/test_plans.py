"""Physical-plan checks: the scale properties the README claims."""
import pytest

from tests.conftest import SF_SMALL
from tierflow.plans.registry import queries

Q = queries()
# training jobs, streams and sinks execute while being built; their plans are
# checked through the operators they reuse
SKIP = {"predict_success", "calibration_report", "quality_model_metrics", "stream_log", "stream_summary",
        "usage_log_appended", "usage_log_rejects", "labelled_split_written", "benchmark_roundtrip",
        "model_benchmark", "corpus_scan", "fit_optimality", "predict_fixed"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in Q if n not in SKIP))
def test_no_row_products(spark, name):
    plan = _plan(Q[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_settlement_exchanges(spark):
    """Lineitem is aggregated per order before its one exchange, the requests have
    another; join, window and fold add none, with broadcast off too."""
    for limit in ("-1", "10485760"):
        old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            plan = _plan(Q["request_results"](spark, SF_SMALL))
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        assert plan.count("Exchange hashpartitioning") == 2
        assert "SortAggregate" not in plan


def test_label_audits_prune_the_text_column(spark):
    df = Q["monotonicity"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "documents" in line]
    assert scans and all("text" not in s.split("ReadSchema:")[-1] for s in scans)


@pytest.mark.parametrize("name", ["target_balance", "policy_baselines", "policy_sweep", "policy_grid", "policy_best",
                                  "policy_test", "classifier_metrics"])
def test_policy_queries_read_no_text(spark, name):
    from tierflow.plans import text_queries
    df = text_queries.long_scores(spark, SF_SMALL) if name == "classifier_metrics" else Q[name](spark, SF_SMALL)
    scans = [line for line in _plan(df).splitlines() if "FileScan parquet" in line and "documents" in line]
    assert scans and all("text" not in s.split("ReadSchema:")[-1] for s in scans)


def test_training_features_run_no_python(spark):
    from pyspark.sql import functions as F

    from tierflow.operators.learn import FeatureModel
    from tierflow.sources import views as V
    docs = V.routing_raw(spark, SF_SMALL, with_labels=False).where(F.col("split") == "test").select("key", "prompt")
    plan = _plan(FeatureModel.fit(docs).transform(docs))
    assert "Python" not in plan


def test_documents_are_scanned_once_for_tfidf(spark):
    from tierflow.operators import text_model as TM
    from tierflow.sources import views as V
    docs = V.routing_raw(spark, SF_SMALL, with_labels=False).select("key", "prompt", "split")
    plan = _plan(TM.doc_terms(docs, carry=("split",)))
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange ") == 1
    lines = plan.splitlines()
    # tokens are made above the exchange of the raw text
    assert next(i for i, x in enumerate(lines) if "regexp_extract_all" in x) < next(i for i, x in enumerate(lines) if "Exchange " in x)
