"""Registered queries: routing decisions and policy evaluation.

The oracle scores every configuration against every row by brute force
(rows x configurations), which is what the Spark cell collapse must equal.
"""
from __future__ import annotations


from tierflow.constants import GRID_THRESHOLDS, SWEEP_THRESHOLDS
from tierflow.operators import policy as P
from tierflow.operators.settle import with_decision
from tierflow.sources import views as V


def _rows(spark, sf, split):
    return P.policy_rows(V.routing_scored(spark, sf, with_labels=False), split)


SPARK = {
    "route_decision": lambda s, d: with_decision(V.routing_scored(s, d, with_labels=False)).select(
        "key", "split", "selected_tier", "fallback_used", "reason"),
    "policy_baselines": lambda s, d: P.policy_baselines(_rows(s, d, "validation")),
    "policy_sweep": lambda s, d: P.policy_sweep(_rows(s, d, "validation")),
    "policy_grid": lambda s, d: P.policy_grid(_rows(s, d, "validation")),
    "policy_best": lambda s, d: P.policy_best(P.policy_grid(_rows(s, d, "validation"))),
    "policy_test": lambda s, d: P.policy_test(_rows(s, d, "test")),
}


def D(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def _rows_sql(split):
    return (f"SELECT * FROM routing_scored WHERE split = '{split}' AND tier_1_score IS NOT NULL "
            f"AND tier_2_score IS NOT NULL AND tier_3_score IS NOT NULL AND prompt IS NOT NULL")


_P = {k: f"COALESCE(tier_{k}_score >= {D('0.8')}, FALSE)" for k in (1, 2, 3)}
_ORACLE_ORD = f"CASE WHEN {_P[1]} THEN 1 WHEN {_P[2]} THEN 2 WHEN {_P[3]} THEN 3 ELSE 0 END"


def _sel(t1, t2, t3):
    return (f"CASE WHEN tier_1_probability >= {t1} THEN 1 WHEN tier_2_probability >= {t2} THEN 2 "
            f"WHEN tier_3_probability >= {t3} THEN 3 ELSE 3 END")


def _metric_sql(exact: bool, avg_name: str = "average_tier") -> str:
    succ = f"CASE sel WHEN 1 THEN {_P[1]} WHEN 2 THEN {_P[2]} ELSE {_P[3]} END"
    solv = "orc > 0"
    n_solv = f"SUM(CASE WHEN {solv} THEN 1 ELSE 0 END)"

    def r(num, den="COUNT(*)"):
        return f"CASE WHEN {den} > 0 THEN CAST({num} AS DOUBLE) / {den} END"

    cols = [
        f"{r(f'SUM(CASE WHEN {succ} THEN 1 ELSE 0 END)')} AS overall_success",
        f"{r(f'SUM(CASE WHEN {solv} AND {succ} THEN 1 ELSE 0 END)', n_solv)} AS solvable_success",
    ]
    if exact:
        cols.append(f"{r(f'SUM(CASE WHEN {solv} AND sel = orc THEN 1 ELSE 0 END)', n_solv)} AS exact_match")
    cols += [
        f"{r(f'SUM(CASE WHEN {solv} AND sel < orc THEN 1 ELSE 0 END)', n_solv)} AS under_routing",
        f"{r(f'SUM(CASE WHEN {solv} AND sel > orc THEN 1 ELSE 0 END)', n_solv)} AS over_routing",
        f"{r('SUM(sel)')} AS {avg_name}",
        f"{r('SUM(CASE WHEN sel = 1 THEN 1 ELSE 0 END)')} AS tier_1_usage",
        f"{r('SUM(CASE WHEN sel = 2 THEN 1 ELSE 0 END)')} AS tier_2_usage",
        f"{r('SUM(CASE WHEN sel = 3 THEN 1 ELSE 0 END)')} AS tier_3_usage",
    ]
    return ",\n       ".join(cols)


_GRID_VALUES = ", ".join(f"({D(v)})" for v in GRID_THRESHOLDS)
_SWEEP_VALUES = ", ".join(f"({D(v)})" for v in SWEEP_THRESHOLDS)

_GRID_SQL = f"""
SELECT threshold_1, threshold_2, threshold_3,
       {_metric_sql(False)}
FROM (SELECT r.*, g1.v AS threshold_1, g2.v AS threshold_2, g3.v AS threshold_3,
             {_sel('g1.v', 'g2.v', 'g3.v')} AS sel, {_ORACLE_ORD} AS orc
      FROM ({_rows_sql('validation')}) r
      CROSS JOIN (VALUES {_GRID_VALUES}) g1(v) CROSS JOIN (VALUES {_GRID_VALUES}) g2(v)
      CROSS JOIN (VALUES {_GRID_VALUES}) g3(v)) x
GROUP BY threshold_1, threshold_2, threshold_3"""

ORACLE = {
    "route_decision": ([], f"""
SELECT key, split,
       CASE WHEN tier_1_probability >= {D('0.8')} THEN 'tier_1'
            WHEN tier_2_probability >= {D('0.7')} THEN 'tier_2' ELSE 'tier_3' END AS selected_tier,
       tier_1_probability < {D('0.8')} AND tier_2_probability < {D('0.7')} AS fallback_used,
       CASE WHEN tier_1_probability >= {D('0.8')} THEN 'Tier 1 predicted success score passed its threshold.'
            WHEN tier_2_probability >= {D('0.7')} THEN 'Tier 1 did not meet its threshold, but Tier 2 did.'
            ELSE 'Neither Tier 1 nor Tier 2 met the required routing threshold, so the strongest tier was selected.'
       END AS reason
FROM routing_scored"""),
    "policy_baselines": ([], f"""
SELECT v.baseline, v.success_rate FROM (
  SELECT COUNT(*) AS n,
         SUM(CAST({_P[1]} AS INT)) AS a1, SUM(CAST({_P[2]} AS INT)) AS a2, SUM(CAST({_P[3]} AS INT)) AS a3,
         SUM(CASE WHEN {_ORACLE_ORD} > 0 THEN 1 ELSE 0 END) AS orc
  FROM ({_rows_sql('validation')}) r) g,
LATERAL (VALUES ('always_tier_1', CAST(a1 AS DOUBLE) / n), ('always_tier_2', CAST(a2 AS DOUBLE) / n),
                ('always_tier_3', CAST(a3 AS DOUBLE) / n), ('oracle', CAST(orc AS DOUBLE) / n))
  AS v(baseline, success_rate)"""),
    "policy_sweep": ([], f"""
SELECT threshold,
       {_metric_sql(True, 'average_selected_tier')}
FROM (SELECT r.*, t.v AS threshold, {_sel('t.v', 't.v', 't.v')} AS sel, {_ORACLE_ORD} AS orc
      FROM ({_rows_sql('validation')}) r CROSS JOIN (VALUES {_SWEEP_VALUES}) t(v)) x
GROUP BY threshold"""),
    "policy_grid": ([], _GRID_SQL),
    "policy_best": ([("grid", _GRID_SQL)], f"""
SELECT * FROM grid WHERE solvable_success >= {D('0.88')}
ORDER BY average_tier, under_routing, threshold_1, threshold_2, threshold_3 LIMIT 10"""),
    "policy_test": ([], f"""
SELECT {D('0.8')} AS threshold_1, {D('0.7')} AS threshold_2, CAST(COUNT(*) AS BIGINT) AS rows,
       CAST(SUM(CASE WHEN orc > 0 THEN 1 ELSE 0 END) AS BIGINT) AS solvable_rows,
       {_metric_sql(True)}
FROM (SELECT r.*, {_sel(D('0.8'), D('0.7'), D('0.0'))} AS sel, {_ORACLE_ORD} AS orc
      FROM ({_rows_sql('test')}) r) x"""),
}
