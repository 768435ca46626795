"""Invariants of the policy and settlement outputs, each also shown to catch a
planted fault; results equal under 1, 4 and 16 shuffle partitions."""
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tierflow.plans.registry import queries
from tierflow.operators import policy as P
from tierflow.sources import views as V

Q = queries()


def _grid(spark):
    return [r.asDict() for r in Q["policy_grid"](spark, SF_SMALL).collect()]


def _check_grid(rows):
    for r in rows:
        shares = r["tier_1_usage"] + r["tier_2_usage"] + r["tier_3_usage"]
        assert shares == pytest.approx(1.0)
        assert r["under_routing"] <= 1 - r["solvable_success"] + 1e-12
        assert r["overall_success"] <= r["solvable_success"] + 1e-12


def test_grid_invariants(spark):
    rows = _grid(spark)
    _check_grid(rows)
    # threshold 3 never changes the pick
    by = {}
    for r in rows:
        by.setdefault((r["threshold_1"], r["threshold_2"]), set()).add(
            tuple(r[k] for k in ("overall_success", "average_tier", "under_routing")))
    assert all(len(v) == 1 for v in by.values())
    # under-routing never rises when t1 rises (t2 fixed)
    for t2 in {r["threshold_2"] for r in rows}:
        seq = sorted((r["threshold_1"], r["under_routing"]) for r in rows
                     if r["threshold_2"] == t2 and r["threshold_3"] == 0.4)
        assert all(b[1] <= a[1] + 1e-12 for a, b in zip(seq, seq[1:]))


def test_grid_invariant_catches_planted_fault(spark):
    rows = _grid(spark)
    rows[0]["tier_1_usage"] += 0.1
    with pytest.raises(AssertionError):
        _check_grid(rows)


def test_sweep_partition_of_solvable(spark):
    for r in Q["policy_sweep"](spark, SF_SMALL).collect():
        assert r["exact_match"] + r["under_routing"] + r["over_routing"] == pytest.approx(1.0)


def test_overall_vs_solvable_counts(spark):
    rows = P.policy_rows(V.routing_scored(spark, SF_SMALL, with_labels=False), "test")
    r = P.policy_test(rows).collect()[0]
    # an unsolvable row can never succeed: overall * N == solvable * N_solvable
    assert r["overall_success"] * r["rows"] == pytest.approx(r["solvable_success"] * r["solvable_rows"])


def test_cost_identities_clean_and_planted(spark):
    from tierflow.operators import settle as S
    from tierflow.plans.settle_queries import attempts, usage_log
    a, log = attempts(spark, SF_SMALL), usage_log(spark, SF_SMALL)
    assert S.cost_identity_violations(a, log).count() == 0
    bad = a.withColumn("total_attempt_cost_usd",
                       F.when(F.col("tier") == "tier_1", F.col("total_attempt_cost_usd") + 1e-6)
                       .otherwise(F.col("total_attempt_cost_usd")))
    found = {r["identity"] for r in S.cost_identity_violations(bad, log).collect()}
    assert found == {"attempt_cost", "request_cost"}  # the fold no longer equals the attempts


@pytest.mark.parametrize("name", ["usage_summary", "policy_grid", "strategy_summary",
                                  "classifier_metrics", "tier_usage"])
def test_partition_invariance(spark, name):
    outs = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 4, 16):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            outs.append(sorted(tuple(r) for r in Q[name](spark, SF_SMALL).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert outs[0] == outs[1] == outs[2]
