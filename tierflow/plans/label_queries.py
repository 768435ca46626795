"""Registered queries: corpus labelling and label audits."""
from __future__ import annotations

from tierflow.constants import PASS_PATTERNS, SENSITIVITY_PAIRS, SENSITIVITY_THRESHOLDS
from tierflow.operators import labels as L
from tierflow.sources import views as V


def _raw(spark, sf):
    return V.routing_raw(spark, sf, with_labels=False)


def q_score_extract(spark, sf):
    return L.extract_scores(L.nested_corpus(_raw(spark, sf)))


def q_routing_label(spark, sf):
    return L.label_corpus(_raw(spark, sf)).select(
        "key", "split", "routing_label", "tier_1_score", "tier_2_score", "tier_3_score")


def q_label_counts(spark, sf):
    return L.label_counts(L.label_corpus(_raw(spark, sf)))


def q_labelled_split_valid(spark, sf):
    df = L.complete_rows(L.label_corpus(_raw(spark, sf)), need_prompt=True)
    return df.select("key", "source_dataset", "dataset_level", "prompt", "routing_label",
                     "tier_1_score", "tier_2_score", "tier_3_score", "split")


SPARK = {
    "score_extract": q_score_extract,
    "routing_label": q_routing_label,
    "label_counts": q_label_counts,
    "labelled_split_valid": q_labelled_split_valid,
    "target_balance": lambda s, d: L.target_balance(_raw(s, d)),
    "monotonicity": lambda s, d: L.monotonicity(_raw(s, d)),
    "pass_patterns": lambda s, d: L.pass_patterns(_raw(s, d)),
    "threshold_sensitivity": lambda s, d: L.threshold_sensitivity(_raw(s, d)),
    "label_changes": lambda s, d: L.label_changes(_raw(s, d)),
    "borderline_scores": lambda s, d: L.borderline_scores(_raw(s, d)),
}


# ---------------------------------------------------------------------------
# Oracle SQL
# ---------------------------------------------------------------------------
def D(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def label_sql(t="0.8") -> str:
    return (f"CASE WHEN tier_1_score >= {D(t)} THEN 'tier_1' WHEN tier_2_score >= {D(t)} THEN 'tier_2' "
            f"WHEN tier_3_score >= {D(t)} THEN 'tier_3' ELSE 'unresolved' END")


COMPLETE = ("SELECT * FROM routing_raw WHERE tier_1_score IS NOT NULL AND tier_2_score IS NOT NULL "
            "AND tier_3_score IS NOT NULL")


def _extract(col, bad, nan, missing):
    v = (f"TRY_CAST(CASE WHEN key % {bad} = 0 THEN 'n/a' WHEN key % {nan} = 0 THEN 'NaN' "
         f"ELSE CAST({col} AS VARCHAR) END AS DOUBLE)")
    return f"CASE WHEN key % {missing} = 0 THEN NULL WHEN isnan({v}) THEN NULL ELSE {v} END"


def _bit(c):
    return f"CAST(CAST(COALESCE({c} >= {D('0.8')}, FALSE) AS INT) AS VARCHAR)"


_PATTERN = f"{_bit('tier_1_score')} || {_bit('tier_2_score')} || {_bit('tier_3_score')}"

_PATTERN_ROWS = ", ".join(
    f"({i + 1}, '{p}', '{d}')" for i, (p, d) in enumerate(PASS_PATTERNS))

_SENS_ROWS = ", ".join(f"({D(t)})" for t in SENSITIVITY_THRESHOLDS)

ORACLE = {
    "score_extract": ([], f"""
SELECT key, split, {_extract('tier_1_score', 7, 13, 29)} AS tier_1_score,
       {_extract('tier_2_score', 11, 17, 31)} AS tier_2_score,
       {_extract('tier_3_score', 37, 41, 43)} AS tier_3_score
FROM routing_raw"""),
    "routing_label": ([], f"""
SELECT key, split, {label_sql()} AS routing_label, tier_1_score, tier_2_score, tier_3_score
FROM routing_raw"""),
    "label_counts": ([], f"""
SELECT COALESCE(split, 'all') AS split, COALESCE(routing_label, 'all') AS routing_label, COUNT(*) AS count
FROM (SELECT split, {label_sql()} AS routing_label FROM routing_raw) t
GROUP BY ROLLUP (split, routing_label)"""),
    "labelled_split_valid": ([], f"""
SELECT key, source_dataset, dataset_level, prompt, {label_sql()} AS routing_label,
       tier_1_score, tier_2_score, tier_3_score, split
FROM ({COMPLETE} AND prompt IS NOT NULL) t"""),
    "target_balance": ([], f"""
SELECT split, tier, CAST(pos AS BIGINT) AS positives, CAST(n - pos AS BIGINT) AS negatives,
       CAST(pos AS DOUBLE) / n AS positive_share
FROM (
  SELECT split, COUNT(*) AS n,
         SUM(CAST(tier_1_score >= {D('0.8')} AS INT)) AS p1,
         SUM(CAST(tier_2_score >= {D('0.8')} AS INT)) AS p2,
         SUM(CAST(tier_3_score >= {D('0.8')} AS INT)) AS p3
  FROM ({COMPLETE} AND prompt IS NOT NULL) c GROUP BY split) g,
LATERAL (VALUES ('tier_1', p1), ('tier_2', p2), ('tier_3', p3)) AS v(tier, pos)"""),
    "monotonicity": ([], f"""
SELECT split, rows,
       monotonic, CAST(monotonic AS DOUBLE) / rows AS monotonic_share,
       tier_1_gt_tier_2, CAST(tier_1_gt_tier_2 AS DOUBLE) / rows AS tier_1_gt_tier_2_share,
       tier_2_gt_tier_3, CAST(tier_2_gt_tier_3 AS DOUBLE) / rows AS tier_2_gt_tier_3_share,
       tier_1_gt_tier_3, CAST(tier_1_gt_tier_3 AS DOUBLE) / rows AS tier_1_gt_tier_3_share
FROM (
  SELECT split, COUNT(*) AS rows,
         CAST(SUM(CAST(tier_1_score <= tier_2_score AND tier_2_score <= tier_3_score AS INT)) AS BIGINT) AS monotonic,
         CAST(SUM(CAST(tier_1_score > tier_2_score AS INT)) AS BIGINT) AS tier_1_gt_tier_2,
         CAST(SUM(CAST(tier_2_score > tier_3_score AS INT)) AS BIGINT) AS tier_2_gt_tier_3,
         CAST(SUM(CAST(tier_1_score > tier_3_score AS INT)) AS BIGINT) AS tier_1_gt_tier_3
  FROM ({COMPLETE}) c GROUP BY split) g"""),
    "pass_patterns": ([], f"""
SELECT s.split, p.pattern_order, p.pattern, p.description,
       CAST(COALESCE(c.cnt, 0) AS BIGINT) AS count,
       CASE WHEN s.n > 0 THEN CAST(COALESCE(c.cnt, 0) AS DOUBLE) / s.n ELSE 0.0 END AS share
FROM (SELECT split, COUNT(*) AS n FROM ({COMPLETE}) x GROUP BY split) s
CROSS JOIN (VALUES {_PATTERN_ROWS}) AS p(pattern_order, pattern, description)
LEFT JOIN (SELECT split, {_PATTERN} AS pattern, COUNT(*) AS cnt FROM ({COMPLETE}) y GROUP BY split, pattern) c
  ON c.split = s.split AND c.pattern = p.pattern"""),
    "threshold_sensitivity": ([], f"""
SELECT split, threshold, label, CAST(count AS BIGINT) AS count,
       CAST(count AS DOUBLE) / SUM(count) OVER (PARTITION BY split, threshold) AS share
FROM (
  SELECT split, t.threshold,
         CASE WHEN tier_1_score >= t.threshold THEN 'tier_1' WHEN tier_2_score >= t.threshold THEN 'tier_2'
              WHEN tier_3_score >= t.threshold THEN 'tier_3' ELSE 'unresolved' END AS label,
         COUNT(*) AS count
  FROM ({COMPLETE}) c CROSS JOIN (VALUES {_SENS_ROWS}) AS t(threshold)
  GROUP BY 1, 2, 3) g"""),
    "label_changes": ([], "SELECT split, from_threshold, to_threshold, CAST(changed AS BIGINT) AS changed, "
                          "CAST(changed AS DOUBLE) / n AS changed_share FROM (" + " UNION ALL ".join(
        f"SELECT split, {D(a)} AS from_threshold, {D(b)} AS to_threshold, COUNT(*) AS n, "
        f"SUM(CAST({label_sql(a)} <> {label_sql(b)} AS INT)) AS changed FROM ({COMPLETE}) c GROUP BY split"
        for a, b in SENSITIVITY_PAIRS) + ") u"),
    "borderline_scores": ([], f"""
SELECT split, rows, borderline, CAST(borderline AS DOUBLE) / rows AS borderline_share,
       rows - borderline AS non_borderline, CAST(rows - borderline AS DOUBLE) / rows AS non_borderline_share
FROM (
  SELECT split, COUNT(*) AS rows,
         CAST(SUM(CAST(
           (tier_1_score >= {D('0.8')} - {D('0.1')} AND tier_1_score <= {D('0.8')} + {D('0.1')}) OR
           (tier_2_score >= {D('0.8')} - {D('0.1')} AND tier_2_score <= {D('0.8')} + {D('0.1')}) OR
           (tier_3_score >= {D('0.8')} - {D('0.1')} AND tier_3_score <= {D('0.8')} + {D('0.1')}) AS INT)) AS BIGINT) AS borderline
  FROM ({COMPLETE}) c GROUP BY split) g"""),
}
