"""Column functions for labels, routing policies and outcomes.

All are native Catalyst expressions (CASE / comparisons), so they stay
inside whole-stage codegen.  A null score never passes a threshold, which
matches the labelling rule (missing score = did not pass).
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tierflow.constants import QUALITY_THRESHOLD


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dlit(x) -> Column:
    """A DOUBLE literal (a bare 0.8 in Spark SQL would be DECIMAL)."""
    return F.lit(float(x)) if not isinstance(x, Column) else x


def passes(score, threshold=QUALITY_THRESHOLD) -> Column:
    """score >= threshold, with null (and NaN turned null at load) as false."""
    return F.coalesce(_c(score) >= dlit(threshold), F.lit(False))


def routing_label(s1="tier_1_score", s2="tier_2_score", s3="tier_3_score",
                  threshold=QUALITY_THRESHOLD) -> Column:
    """Cheapest tier whose actual score reaches the threshold, else 'unresolved'."""
    return (F.when(passes(s1, threshold), "tier_1")
            .when(passes(s2, threshold), "tier_2")
            .when(passes(s3, threshold), "tier_3")
            .otherwise("unresolved"))


def pass_pattern(s1="tier_1_score", s2="tier_2_score", s3="tier_3_score",
                 threshold=QUALITY_THRESHOLD) -> Column:
    return F.concat(*[passes(s, threshold).cast("int").cast("string") for s in (s1, s2, s3)])


def binary_target(score, threshold=QUALITY_THRESHOLD) -> Column:
    return passes(score, threshold).cast("int")


def tier_ord(tier) -> Column:
    t = _c(tier)
    return (F.when(t == "tier_1", 1).when(t == "tier_2", 2)
            .when(t == "tier_3", 3).otherwise(F.lit(None).cast("int")))


def two_threshold_tier(p1, p2, t1, t2, fallback="tier_3") -> Column:
    """Serving policy: p1 >= t1 -> tier_1; p2 >= t2 -> tier_2; else fallback."""
    return (F.when(_c(p1) >= dlit(t1), "tier_1")
            .when(_c(p2) >= dlit(t2), "tier_2")
            .otherwise(F.lit(fallback)))


def three_threshold_tier(p1, p2, p3, t1, t2, t3) -> Column:
    """Study policy; both branches end in tier_3, so t3 never changes the pick."""
    return (F.when(_c(p1) >= dlit(t1), "tier_1")
            .when(_c(p2) >= dlit(t2), "tier_2")
            .when(_c(p3) >= dlit(t3), "tier_3")
            .otherwise("tier_3"))


def score_from_text(text) -> Column:
    """Safe score extraction: non-numeric or NaN text -> null."""
    v = _c(text).try_cast("double")
    return F.nanvl(v, F.lit(None).cast("double"))


# --------------------------------------------------------------------------
# B25 scores map <-> JSON text; B28 report rounding
# --------------------------------------------------------------------------
def scores_to_json(scores) -> Column:
    """MAP<STRING,DOUBLE> -> JSON object text (as stored in the usage log)."""
    return F.to_json(_c(scores))


def scores_from_json(text) -> Column:
    return F.from_json(_c(text), "map<string,double>")


def report_round(c, places: int) -> Column:
    """Report rounding is half-to-even on doubles (``bround``), not half-up."""
    return F.bround(_c(c), places)
