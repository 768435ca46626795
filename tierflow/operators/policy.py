"""Routing-policy evaluation: baselines, threshold sweep, 216-point grid, test.

Cell collapse: thresholds come from a fixed grid, so a row matters only
through (bucket of p1, bucket of p2, bucket of p3, three pass bits), where
bucket = how many grid values the probability reaches.  The scan groups
rows into at most 7*7*7*8 cells (one shuffle of partial aggregates); each
configuration is then scored on the cells, not on the rows.  Cost is
O(N + cells * configs) instead of O(N * configs), and no row is ever
paired with anything.  Rates are exact integer counts divided once.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierflow.constants import (GRID_THRESHOLDS, QUALITY_THRESHOLD, SOLVABLE_SUCCESS_TARGET,
                                SWEEP_THRESHOLDS, TIER_1_THRESHOLD, TIER_2_THRESHOLD, TIERS)
from tierflow.functions.routing import dlit, passes, routing_label, three_threshold_tier, tier_ord
from tierflow.operators.labels import SCORES, complete_rows

PROBS = ["tier_1_probability", "tier_2_probability", "tier_3_probability"]


def _bucket(p: str, grid) -> F.Column:
    """Number of grid thresholds the probability reaches (grid literals, not i*0.1)."""
    total = None
    for g in sorted(grid):
        c = (F.col(p) >= dlit(g)).cast("int")
        total = c if total is None else total + c
    return total


def policy_rows(scored: DataFrame, split: str) -> DataFrame:
    """Evaluation population: one split, complete rows only."""
    return complete_rows(scored.where(F.col("split") == split), need_prompt=True)


def cells(rows: DataFrame, grid=GRID_THRESHOLDS) -> DataFrame:
    return rows.groupBy(
        _bucket(PROBS[0], grid).alias("b1"), _bucket(PROBS[1], grid).alias("b2"),
        _bucket(PROBS[2], grid).alias("b3"),
        *[passes(s).alias(f"pass{k}") for k, s in enumerate(SCORES, 1)],
    ).agg(F.count(F.lit(1)).alias("n"))


def _metrics(selected_ord: F.Column, weight: F.Column) -> list:
    """Weighted sums for the policy metrics, given the selected tier ordinal."""
    p1, p2, p3 = F.col("pass1"), F.col("pass2"), F.col("pass3")
    oracle = F.when(p1, 1).when(p2, 2).when(p3, 3).otherwise(0)
    success = F.when(selected_ord == 1, p1).when(selected_ord == 2, p2).otherwise(p3)
    solv = oracle > 0

    def wsum(cond):
        return F.sum(F.when(cond, weight).otherwise(0)).cast("bigint")

    return [
        F.sum(weight).cast("bigint").alias("n"),
        wsum(success).alias("n_success"),
        wsum(solv).alias("n_solvable"),
        wsum(solv & success).alias("n_solvable_success"),
        wsum(solv & (selected_ord == oracle)).alias("n_exact"),
        wsum(solv & (selected_ord < oracle)).alias("n_under"),
        wsum(solv & (selected_ord > oracle)).alias("n_over"),
        F.sum(selected_ord * weight).cast("bigint").alias("sum_tier"),
        wsum(selected_ord == 1).alias("n_t1"),
        wsum(selected_ord == 2).alias("n_t2"),
        wsum(selected_ord == 3).alias("n_t3"),
    ]


def _ratio(a, b):
    return F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b))


def _finish(df: DataFrame, keys: list, exact: bool, tier_name: str = "average_tier") -> DataFrame:
    cols = list(keys) + [
        _ratio("n_success", "n").alias("overall_success"),
        _ratio("n_solvable_success", "n_solvable").alias("solvable_success"),
    ]
    if exact:
        cols.append(_ratio("n_exact", "n_solvable").alias("exact_match"))
    cols += [
        _ratio("n_under", "n_solvable").alias("under_routing"),
        _ratio("n_over", "n_solvable").alias("over_routing"),
        _ratio("sum_tier", "n").alias(tier_name),
        _ratio("n_t1", "n").alias("tier_1_usage"),
        _ratio("n_t2", "n").alias("tier_2_usage"),
        _ratio("n_t3", "n").alias("tier_3_usage"),
    ]
    return df.select(*cols)


def _selected_from_buckets(i1, i2, i3) -> F.Column:
    """Tier chosen in a cell for thresholds at grid positions i1, i2, i3."""
    return (F.when(F.col("b1") > i1, 1).when(F.col("b2") > i2, 2)
            .when(F.col("b3") > i3, 3).otherwise(3))


# --------------------------------------------------------------------------
# E12 baselines
# --------------------------------------------------------------------------
def policy_baselines(rows: DataFrame) -> DataFrame:
    lab = routing_label(*SCORES)
    g = rows.agg(F.count(F.lit(1)).alias("n"),
                 *[F.sum(passes(s).cast("int")).alias(f"a{k}") for k, s in enumerate(SCORES, 1)],
                 F.sum((lab != "unresolved").cast("int")).alias("orc"))
    entries = [F.struct(F.lit(f"always_{t}").alias("baseline"),
                        (F.col(f"a{k}").cast("double") / F.col("n")).alias("success_rate"))
               for k, t in enumerate(TIERS, 1)]
    entries.append(F.struct(F.lit("oracle").alias("baseline"),
                            (F.col("orc").cast("double") / F.col("n")).alias("success_rate")))
    return g.select(F.inline(F.array(*entries)))


# --------------------------------------------------------------------------
# E13 one-threshold sweep, E14 grid, G2 best
# --------------------------------------------------------------------------
def _grid_literal(grid) -> F.Column:
    return F.array(*[F.lit(float(g)) for g in grid])


def policy_sweep(rows: DataFrame, thresholds=SWEEP_THRESHOLDS) -> DataFrame:
    grid = sorted(thresholds)
    c = cells(rows, grid)
    x = c.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1))).alias("i"))
    x = x.withColumn("threshold", F.element_at(_grid_literal(grid), F.col("i") + 1))
    sel = _selected_from_buckets(F.col("i"), F.col("i"), F.col("i"))
    agg = x.groupBy("threshold").agg(*_metrics(sel, F.col("n")))
    return _finish(agg, ["threshold"], exact=True, tier_name="average_selected_tier")


def policy_grid(rows: DataFrame, values=GRID_THRESHOLDS) -> DataFrame:
    """All len(values)^3 configurations, generated per cell from an index
    sequence (compact code; the configuration count is fixed, the cells are
    bounded), then aggregated per configuration."""
    grid = sorted(values)
    g = len(grid)
    c = cells(rows, grid)
    x = c.select("*", F.explode(F.sequence(F.lit(0), F.lit(g ** 3 - 1))).alias("cfg"))
    i1 = (F.col("cfg") / (g * g)).cast("int")
    i2 = ((F.col("cfg") / g).cast("int") % g)
    i3 = F.col("cfg") % g
    gl = _grid_literal(grid)
    x = x.select("*", i1.alias("i1"), i2.alias("i2"), i3.alias("i3")).select(
        "*", F.element_at(gl, F.col("i1") + 1).alias("threshold_1"),
        F.element_at(gl, F.col("i2") + 1).alias("threshold_2"),
        F.element_at(gl, F.col("i3") + 1).alias("threshold_3"))
    sel = _selected_from_buckets(F.col("i1"), F.col("i2"), F.col("i3"))
    keys = ["threshold_1", "threshold_2", "threshold_3"]
    agg = x.groupBy(*keys).agg(*_metrics(sel, F.col("n")))
    return _finish(agg, keys, exact=False)


def policy_best(grid: DataFrame, target=SOLVABLE_SUCCESS_TARGET, k: int = 10) -> DataFrame:
    """Acceptable configurations, cheapest first (top-k is the feature)."""
    return (grid.where(F.col("solvable_success") >= dlit(target))
            .orderBy("average_tier", "under_routing", "threshold_1", "threshold_2", "threshold_3")
            .limit(k))


# --------------------------------------------------------------------------
# E15 frozen policy on a split (direct, one pass)
# --------------------------------------------------------------------------
def policy_test(rows: DataFrame, t1=TIER_1_THRESHOLD, t2=TIER_2_THRESHOLD) -> DataFrame:
    sel = tier_ord(three_threshold_tier(PROBS[0], PROBS[1], PROBS[2], t1, t2, 0.0))
    x = rows.select(sel.alias("sel"),
                    *[passes(s, QUALITY_THRESHOLD).alias(f"pass{k}") for k, s in enumerate(SCORES, 1)])
    agg = x.agg(*_metrics(F.col("sel"), F.lit(1)))
    out = _finish(agg, [F.lit(float(t1)).alias("threshold_1"), F.lit(float(t2)).alias("threshold_2"),
                        "n", "n_solvable"], exact=True)
    return out.withColumnRenamed("n", "rows").withColumnRenamed("n_solvable", "solvable_rows")
