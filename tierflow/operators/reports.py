"""Reports over the usage log and the strategy benchmark.

Global figures are one ``agg`` (partial aggregation per task, one tiny
exchange).  Shares of a total are computed over the already-aggregated
group rows (a handful of tiers / modes / strategies), never over raw rows.
Rates come from exact integer counts divided once at the end, so they do
not depend on partitioning; money and latency sums are rounded because
floating-point summation order is free.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierflow.constants import (BASELINE_STRATEGY, HISTORY_DEFAULT_LIMIT, HISTORY_MAX_LIMIT,
                                TIERS)

MONEY_DP = 9
MS_DP = 4


def money(c):
    return F.round(c, MONEY_DP)


def ms(c):
    return F.round(c, MS_DP)


def _rate(num, den):
    """num / den as DOUBLE, 0 when den is 0 (both integer counts)."""
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(0.0))


# --------------------------------------------------------------------------
# E2 usage summary
# --------------------------------------------------------------------------
def usage_summary(log: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    flag = lambda c: F.sum(F.col(c).cast("int"))
    a = log.agg(
        n.alias("total_requests"),
        F.sum("total_cost_usd").alias("c"), F.sum("total_latency_ms").alias("l"),
        F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"),
        F.sum("thinking_tokens").alias("t"), F.sum("attempt_count").alias("att"),
        flag("verification_performed").alias("v"), flag("escalated").alias("e"),
        flag("any_verified").alias("av"),
    )
    N = F.col("total_requests")
    return a.select(
        N.alias("total_requests"),
        money(F.coalesce(F.col("c"), F.lit(0.0))).alias("total_cost_usd"),
        money(F.when(N > 0, F.col("c") / N).otherwise(0.0)).alias("average_cost_usd"),
        ms(F.when(N > 0, F.col("l") / N).otherwise(0.0)).alias("average_latency_ms"),
        F.coalesce(F.col("i"), F.lit(0)).cast("bigint").alias("total_input_tokens"),
        F.coalesce(F.col("o"), F.lit(0)).cast("bigint").alias("total_output_tokens"),
        F.coalesce(F.col("t"), F.lit(0)).cast("bigint").alias("total_thinking_tokens"),
        (F.coalesce(F.col("i"), F.lit(0)) + F.coalesce(F.col("o"), F.lit(0))
         + F.coalesce(F.col("t"), F.lit(0))).cast("bigint").alias("total_tokens"),
        _rate(F.coalesce(F.col("att"), F.lit(0)), N).alias("average_attempt_count"),
        (_rate(F.coalesce(F.col("v"), F.lit(0)), N) * 100).alias("verification_rate"),
        (_rate(F.coalesce(F.col("e"), F.lit(0)), N) * 100).alias("escalation_rate"),
        (_rate(F.coalesce(F.col("av"), F.lit(0)), N) * 100).alias("any_verification_rate"),
    )


# --------------------------------------------------------------------------
# E3 / E4 tier and mode usage
# --------------------------------------------------------------------------
def _with_share(counts: DataFrame, key: str) -> DataFrame:
    total = F.sum("count").over(Window.partitionBy())  # over the group rows only
    return counts.select(key, "count",
                         F.when(total > 0, F.col("count").cast("double") / total * 100)
                         .otherwise(F.lit(0.0)).alias("percentage"))


def tier_usage(log: DataFrame) -> DataFrame:
    """Count and percent by final tier; the three tiers always appear."""
    spark = log.sparkSession
    dim = spark.sql("SELECT tier FROM VALUES " + ", ".join(f"('{t}')" for t in TIERS) + " AS d(tier)")
    counts = log.groupBy(F.col("final_tier").alias("tier")).agg(F.count(F.lit(1)).alias("n"))
    full = F.broadcast(dim).join(counts, "tier", "full_outer").select(
        "tier", F.coalesce("n", F.lit(0)).cast("bigint").alias("count"))
    return _with_share(full, "tier")


def mode_usage(log: DataFrame) -> DataFrame:
    counts = log.groupBy("mode").agg(F.count(F.lit(1)).cast("bigint").alias("count"))
    return _with_share(counts, "mode")


# --------------------------------------------------------------------------
# E5 savings against a tier-3 token-equivalent baseline
# --------------------------------------------------------------------------
def savings_summary(log: DataFrame, price: DataFrame) -> DataFrame:
    # The tier-3 price row rides along in the same aggregation (union, then
    # one global agg), so no join is needed to put it beside the totals.
    t3 = price.where(F.col("tier") == "tier_3").select(
        F.lit(None).cast("double").alias("total_cost_usd"),
        F.lit(None).cast("bigint").alias("input_tokens"),
        F.lit(None).cast("bigint").alias("output_tokens"),
        F.lit(None).cast("bigint").alias("thinking_tokens"),
        F.lit(0).alias("is_log"),
        F.col("input_cost_per_million").alias("pin"),
        F.col("output_cost_per_million").alias("pout"))
    rows = log.select("total_cost_usd", "input_tokens", "output_tokens", "thinking_tokens",
                      F.lit(1).alias("is_log"), F.lit(None).cast("double").alias("pin"),
                      F.lit(None).cast("double").alias("pout")).unionByName(t3)
    j = rows.agg(
        F.sum("is_log").cast("bigint").alias("total_requests"),
        F.coalesce(F.sum("total_cost_usd"), F.lit(0.0)).alias("actual"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).cast("bigint").alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).cast("bigint").alias("output_tokens"),
        F.coalesce(F.sum("thinking_tokens"), F.lit(0)).cast("bigint").alias("thinking_tokens"),
        F.max("pin").alias("pin"), F.max("pout").alias("pout"),
    )
    N = F.col("total_requests")
    billable = F.col("output_tokens") + F.col("thinking_tokens")
    base = F.col("input_tokens") / 1000000 * F.col("pin") + billable / 1000000 * F.col("pout")
    j = j.select("*", base.alias("base"), billable.alias("billable_output_tokens"))
    sav = F.col("base") - F.col("actual")
    return j.select(
        N.alias("total_requests"),
        money(F.col("actual")).alias("actual_cost_usd"),
        money(F.col("base")).alias("tier_3_equivalent_cost_usd"),
        money(sav).alias("estimated_savings_usd"),
        F.round(F.when(F.col("base") > 0, sav / F.col("base") * 100).otherwise(0.0), 6)
        .alias("estimated_savings_percentage"),
        money(F.when(N > 0, F.col("actual") / N).otherwise(0.0)).alias("average_actual_cost_usd"),
        money(F.when(N > 0, F.col("base") / N).otherwise(0.0))
        .alias("average_tier_3_equivalent_cost_usd"),
        "input_tokens", "output_tokens", "thinking_tokens", "billable_output_tokens",
        F.col("pin").alias("input_cost_per_million"), F.col("pout").alias("output_cost_per_million"),
    )


# --------------------------------------------------------------------------
# G1 recent requests (top-k is the feature)
# --------------------------------------------------------------------------
def recent_requests(log: DataFrame, limit: int = HISTORY_DEFAULT_LIMIT) -> DataFrame:
    if limit < 1:
        raise ValueError("limit must be at least 1")
    limit = min(limit, HISTORY_MAX_LIMIT)
    return log.orderBy(F.col("created_at").desc(), F.col("request_id")).limit(limit)


# --------------------------------------------------------------------------
# Strategy benchmark reports (E16-E19), completeness (D6), work list (D3)
# --------------------------------------------------------------------------
def bool_text(c):
    """'true'/'false' in any case -> boolean, anything else -> null (text only)."""
    low = F.lower(c.cast("string"))
    return F.when(low == "true", True).when(low == "false", False)


def strategy_summary(bench: DataFrame, baseline: str = BASELINE_STRATEGY) -> DataFrame:
    """Per strategy figures and savings against the always-tier-3 baseline.

    Fails (raise_error at execution) when the baseline strategy is absent.
    """
    n = F.count(F.lit(1))
    s = bench.groupBy("strategy").agg(
        n.alias("requests"),
        F.sum("strategy_cost_usd").alias("c"),
        F.sum("strategy_latency_ms").alias("l"),
        F.sum(F.col("quality_passed").cast("int")).alias("qp"),
        F.count("quality_passed").alias("nqp"),
        F.sum("quality_score").alias("qs"), F.count("quality_score").alias("nqs"),
        F.sum(F.col("verification_performed").cast("int")).alias("v"),
        F.sum(F.col("escalated").cast("int")).alias("e"),
        F.sum("attempt_count").alias("att"),
    )
    w = Window.partitionBy()  # over the (few) strategy rows
    base = F.max(F.when(F.col("strategy") == baseline, F.col("c"))).over(w)
    has_base = F.max((F.col("strategy") == baseline).cast("int")).over(w)
    N = F.col("requests")
    out = s.select(
        "strategy", N.alias("requests"),
        money(F.col("c")).alias("total_cost_usd"),
        money(F.col("c") / N).alias("average_cost_usd"),
        ms(F.col("l") / N).alias("average_latency_ms"),
        _rate(F.col("qp"), F.col("nqp")).alias("quality_pass_rate"),
        F.round(F.col("qs") / F.col("nqs"), 9).alias("average_quality_score"),
        _rate(F.col("v"), N).alias("verification_rate"),
        _rate(F.col("e"), N).alias("escalation_rate"),
        _rate(F.col("att"), N).alias("average_attempts"),
        F.when(has_base == 1, F.round(F.try_divide(base - F.col("c"), base), 9))
        .otherwise(F.raise_error(F.lit(f"{baseline} baseline was not found")))
        .alias("cost_savings_vs_tier3"),
    )
    return out


def strategy_tier_share(bench: DataFrame) -> DataFrame:
    c = bench.groupBy("strategy", "final_tier").agg(F.count(F.lit(1)).alias("count"))
    tot = F.sum("count").over(Window.partitionBy("strategy"))
    return c.select("strategy", "final_tier", "count",
                    (F.col("count").cast("double") / tot).alias("share"))


def category_strategy(bench: DataFrame) -> DataFrame:
    return bench.groupBy("category", "strategy").agg(
        money(F.avg("strategy_cost_usd")).alias("cost"),
        F.round(F.avg("quality_score"), 9).alias("quality"),
        F.avg(F.col("quality_passed").cast("int")).alias("passed"),
    )


def strategy_completeness(bench: DataFrame, prompts: DataFrame | None = None,
                          required=("always_tier_3", "autopilot", "ml_only")):
    """Prompts missing one or more required strategy answers, named in order;
    ``prompts`` (prompt_id) adds those of which no answer was recorded at all."""
    flags = [F.max((F.col("strategy") == s).cast("int")).alias(f"has_{s}") for s in required]
    g = bench.groupBy("prompt_id").agg(*flags)
    if prompts is not None:
        g = prompts.select("prompt_id").join(g, "prompt_id", "left")
    missing = F.concat_ws(",", *[F.when(F.coalesce(F.col(f"has_{s}"), F.lit(0)) == 0, F.lit(s)) for s in sorted(required)])
    return g.select("prompt_id", missing.alias("missing")).where(F.col("missing") != "")


def coerce_bool_columns(df: DataFrame, cols=("quality_passed", "verification_performed", "escalated")):
    """A text column of 'true'/'false' (any case) becomes BOOLEAN, other
    text null; a column that is already BOOLEAN is left as it is."""
    types = dict(df.dtypes)
    out = df
    for c in cols:
        if c in types and types[c] == "string":
            out = out.withColumn(c, bool_text(F.col(c)))
    return out


def usage_dashboard(log: DataFrame, price: DataFrame) -> DataFrame:
    """A6, E2-E5 in one pass: a row for the whole log (report ``summary``, key
    ``all``), for each final tier (the three always appear) and for each mode.

    One scan and one exchange: grouping sets over (), tier and mode, partly
    aggregated before the shuffle; beyond that there are a dozen rows. Money is
    exact (see ``settle.money``), so no order of addition shows.
    """
    from tierflow.operators.settle import money as exact
    from tierflow.operators.settle import verifier_price
    flag = lambda c: F.sum(F.col(c).cast("int"))
    tier, mode = F.grouping("final_tier") == 0, F.grouping("mode") == 0
    g = log.groupingSets([[], ["final_tier"], ["mode"]], "final_tier", "mode").agg(
        F.when(tier, "tier").when(mode, "mode").otherwise("summary").alias("report"),
        F.when(tier, F.col("final_tier")).when(mode, F.col("mode")).otherwise("all").alias("key"),
        F.count(F.lit(1)).alias("n"), F.sum(exact("total_cost_usd")).alias("cost"), F.sum("total_latency_ms").alias("latency"),
        F.sum("attempt_count").alias("att"), flag("verification_performed").alias("ver"), flag("escalated").alias("esc"),
        flag("any_verified").alias("anyv"), *[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "thinking_tokens")])
    dim = log.sparkSession.sql("SELECT 'tier' AS r, k FROM VALUES " + ", ".join(f"('{t}')" for t in TIERS)
                               + " AS d(k) UNION ALL SELECT 'summary', 'all'")
    full = F.broadcast(dim).join(g, (F.col("r") == F.col("report")) & F.col("k").eqNullSafe(F.col("key")), "full_outer")
    zero = lambda c, kind: F.coalesce(F.col(c), F.lit(0)).cast(kind)
    rows = full.select(
        F.coalesce("report", "r").alias("report"), F.coalesce("key", "k").alias("key"), zero("n", "bigint").alias("requests"),
        zero("cost", "decimal(28,8)").alias("cost"), zero("latency", "double").alias("latency"),
        *[zero(c, "bigint").alias(c) for c in ("att", "ver", "esc", "anyv", "input_tokens", "output_tokens", "thinking_tokens")])
    pin, pout = (F.lit(str(p)).cast("decimal(10,2)") for p in verifier_price(price))
    per = lambda tokens, p: (tokens.cast("decimal(20,0)") * p / F.lit(1000000)).cast("decimal(28,8)")
    base = (per(F.col("input_tokens"), pin) + per(F.col("output_tokens") + F.col("thinking_tokens"), pout)).cast("decimal(28,8)")
    whole = F.max(F.when(F.col("report") == "summary", F.col("requests"))).over(Window.partitionBy())  # over the report's rows only
    rows = rows.withColumns({"base": base, "whole": whole})
    n, saved = F.col("requests"), (F.col("base") - F.col("cost")).cast("double")
    each = lambda c: F.when(n > 0, F.col(c).cast("double") / n).otherwise(0.0)
    return rows.select(
        "report", "key", "requests",
        F.when(F.col("whole") > 0, n.cast("double") / F.col("whole") * 100).otherwise(0.0).alias("percentage"),
        F.col("cost").cast("double").alias("total_cost_usd"), F.round(each("cost"), 9).alias("average_cost_usd"),
        F.round(each("latency"), 4).alias("average_latency_ms"), each("att").alias("average_attempt_count"),
        (each("ver") * 100).alias("verification_rate"), (each("esc") * 100).alias("escalation_rate"),
        (each("anyv") * 100).alias("any_verification_rate"), "input_tokens", "output_tokens", "thinking_tokens",
        F.col("base").cast("double").alias("tier_3_equivalent_cost_usd"), saved.alias("estimated_savings_usd"),
        F.round(F.when(F.col("base") > 0, saved / F.col("base").cast("double") * 100).otherwise(0.0), 6)
        .alias("estimated_savings_percentage"))


def usage_reports(log: DataFrame, price: DataFrame, name: str = "usage-log-snapshot") -> dict:
    """One written snapshot of the log feeds every usage report (one scan of
    the source instead of one per report)."""
    from tierflow.session import materialize
    snap = materialize(log.select("request_id", "created_at", "mode", "initial_tier", "final_tier",
                                  "verification_performed", "escalated", "any_verified",
                                  "attempt_count", "input_tokens", "output_tokens",
                                  "thinking_tokens", "total_cost_usd", "total_latency_ms"), name)
    return {
        "summary": usage_summary(snap),
        "tier_usage": tier_usage(snap),
        "mode_usage": mode_usage(snap),
        "savings": savings_summary(snap, price),
        "recent": recent_requests(snap),
    }
