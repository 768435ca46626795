"""Settlement: a chain of generate / verify / escalate attempts per request.

The serving loop (try the routed tier; verify unless confident or at the
top tier; on a failed verification escalate to the next tier) becomes
table work over a candidate table holding what each tier *would* answer:

  routed requests --(equi join on request_id, range residual tier_ord >=
  initial_ord)--> candidate attempts --(verification rule, judge parse)-->
  stop flags --(min over request)--> attempts actually made --(fold)-->
  one accounted row per request.

The join is a left join from the routed requests, so every request comes out:
where no answer stops the chain, the last attempt is the result, and a request
without any usable answer is ``unsettled``.  A judge reply that can't be parsed
counts as a failed verification (the chain goes on) and its error is carried on
the attempt and in the result.

Everything after the join is keyed by ``request_id``; the candidate view is
already hash-partitioned on it, so the join shuffles only the request side
and the window and fold add no exchange.  Per-request fan-out is bounded by
the three tiers, so a hot request cannot blow up a task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierflow.constants import (AUTO_ACCEPT_SCORE, FALLBACK_TIER, REASON_FALLBACK,
                                REASON_TIER_1, REASON_TIER_2, TIER_1_THRESHOLD,
                                TIER_2_THRESHOLD)
from tierflow.functions.judge import with_judge
from tierflow.functions.routing import dlit, tier_ord, two_threshold_tier

VERIFIER_TIER = "tier_3"


# --------------------------------------------------------------------------
# Routing decision
# --------------------------------------------------------------------------
def with_decision(scored: DataFrame, t1=TIER_1_THRESHOLD, t2=TIER_2_THRESHOLD,
                  fallback=FALLBACK_TIER, prefix: str = "") -> DataFrame:
    """Add ``selected_tier``, ``fallback_used`` and ``reason`` from tier probabilities."""
    p1, p2 = F.col("tier_1_probability"), F.col("tier_2_probability")
    sel = two_threshold_tier(p1, p2, t1, t2, fallback)
    reason = (F.when(p1 >= dlit(t1), REASON_TIER_1)
              .when(p2 >= dlit(t2), REASON_TIER_2)
              .otherwise(REASON_FALLBACK))
    return scored.select(
        "*",
        sel.alias(prefix + "selected_tier"),
        ((p1 < dlit(t1)) & (p2 < dlit(t2))).alias(prefix + "fallback_used"),
        reason.alias(prefix + "reason"),
    )


def route_requests(requests: DataFrame, t1=TIER_1_THRESHOLD, t2=TIER_2_THRESHOLD,
                   fallback=FALLBACK_TIER) -> DataFrame:
    """Requests with their initial tier and the routed tier's own score."""
    p1, p2, p3 = (F.col(f"tier_{k}_probability") for k in (1, 2, 3))
    init = two_threshold_tier(p1, p2, t1, t2, fallback)
    return requests.select(
        "*",
        init.alias("initial_tier"),
        tier_ord(init).alias("initial_ord"),
        F.when(init == "tier_1", p1).when(init == "tier_2", p2).otherwise(p3)
        .alias("initial_score"),
    )


# --------------------------------------------------------------------------
# Call cost; D1: attempt -> price by tier
# --------------------------------------------------------------------------
def _price_cols(price: DataFrame, key: str, prefix: str) -> DataFrame:
    return price.select(
        F.col("tier").alias(key),
        F.col("model_id").alias(prefix + "model_id"),
        F.col("input_cost_per_million").alias(prefix + "in_price"),
        F.col("output_cost_per_million").alias(prefix + "out_price"),
    )


def call_cost_expr(input_tokens, output_tokens, thinking_tokens, in_price, out_price):
    billable = F.coalesce(output_tokens, F.lit(0)) + F.coalesce(thinking_tokens, F.lit(0))
    return (F.coalesce(input_tokens, F.lit(0)) / 1000000 * in_price
            + billable / 1000000 * out_price)


def verifier_price(price: DataFrame, tier: str = VERIFIER_TIER) -> tuple[float, float]:
    """The judge model's (input, output) price: one row of the price dimension,
    read once as plan literals (a join on a constant key would plan as a
    nested-loop join)."""
    row = price.where(F.col("tier") == tier).select(
        "input_cost_per_million", "output_cost_per_million").first()
    if row is None:
        raise ValueError(f"price table has no row for verifier tier {tier}")
    return float(row[0]), float(row[1])


def with_cost(candidates: DataFrame, price: DataFrame) -> DataFrame:
    """Generation and (would-be) judge cost of every candidate answer.

    The generation price comes from a broadcast hash join on ``tier`` (the
    dimension is three rows); the verifier's price is a literal pair.
    """
    p = F.broadcast(_price_cols(price, "tier", "gen_"))
    vin, vout = verifier_price(price)
    df = candidates.join(p, "tier", "left")
    return df.select(
        "*",
        (F.coalesce("output_tokens", F.lit(0)) + F.coalesce("thinking_tokens", F.lit(0)))
        .alias("billable_output_tokens"),
        call_cost_expr(F.col("input_tokens"), F.col("output_tokens"), F.col("thinking_tokens"),
                       F.col("gen_in_price"), F.col("gen_out_price")).alias("generation_cost_usd"),
        call_cost_expr(F.col("judge_input_tokens"), F.col("judge_output_tokens"), F.lit(0),
                       F.lit(vin), F.lit(vout)).alias("judge_cost_usd"),
    )


# --------------------------------------------------------------------------
# Verify or skip
# --------------------------------------------------------------------------
def verification_rule(tier, escalated, routed_score, accept=AUTO_ACCEPT_SCORE):
    """(should_verify, rule); the order of the tests matters."""
    if not 0.0 <= accept <= 1.0:
        raise ValueError("auto-accept score must be between 0 and 1")
    rule = (F.when(tier == "tier_3", "top_tier_no_escalation")
            .when(escalated, "escalated_must_verify")
            .when(routed_score >= dlit(accept), "auto_accept")
            .otherwise("below_auto_accept"))
    should = rule.isin("escalated_must_verify", "below_auto_accept")
    return should, rule


# --------------------------------------------------------------------------
# D7 + C1/C2: settle
# --------------------------------------------------------------------------
def escalation_candidates(routed: DataFrame, candidates: DataFrame, keep_requests: bool = False) -> DataFrame:
    """Each request with its answers from the initial tier upward (range
    residual); with ``keep_requests`` a request without any has one row of nulls."""
    c = candidates.withColumnRenamed("request_id", "c_request_id")
    on = (F.col("request_id") == F.col("c_request_id")) & (F.col("tier_ord") >= F.col("initial_ord"))
    return routed.join(c, on, "left" if keep_requests else "inner").drop("c_request_id")


#: Parse errors as numbers, so that the fold's buffers stay fixed-width.
PARSE_ERRORS = ("missing_text", "missing_verdict", "missing_score", "score_out_of_range")


def _attempt_rows(routed: DataFrame, candidates: DataFrame, price: DataFrame,
                  accept: float, force_mode: str | None) -> DataFrame:
    cand = with_judge(with_cost(candidates, price), "judge_text", out="j_")
    if force_mode:
        routed = routed.withColumn("mode", F.lit(force_mode))
    c = cand.withColumnRenamed("request_id", "c_request_id")
    economy = F.col("mode") == "economy"
    # economy calls the routed tier and no other
    on = ((F.col("request_id") == F.col("c_request_id"))
          & (F.col("tier_ord") >= F.col("initial_ord"))
          & (~economy | (F.col("tier_ord") == F.col("initial_ord"))))
    j = routed.join(c, on, "left")
    escalated = F.col("tier_ord") > F.col("initial_ord")
    should, rule = verification_rule(F.col("tier"), escalated, F.col("initial_score"), accept)
    verify = F.when(F.col("tier_ord").isNotNull(), ~economy & should)  # null: no answer, nothing to verify
    passed = F.coalesce(F.col("j_passed"), F.lit(False))
    return j.select(
        "request_id", "created_at", "mode", "category", "initial_tier",
        "initial_ord", "tier_1_probability", "tier_2_probability", "tier_3_probability",
        "tier", "tier_ord", F.col("gen_model_id").alias("model_id"),
        escalated.alias("escalated_attempt"),
        F.when(economy, "economy_skips_verification").otherwise(rule).alias("verification_rule"),
        verify.alias("verification_performed"),
        F.when(verify, F.col("j_passed")).alias("verification_passed"),
        F.when(verify, F.col("j_score")).alias("verification_score"),
        F.when(verify, F.col("j_reason")).alias("verification_reason"),
        F.when(verify, F.col("j_parse_error")).alias("verification_error"),
        "input_tokens", "output_tokens", "thinking_tokens",
        "generation_latency_ms",
        F.when(verify, F.col("judge_latency_ms")).otherwise(F.lit(0.0)).alias("verification_latency_ms"),
        "generation_cost_usd",
        F.when(verify, F.col("judge_cost_usd")).otherwise(F.lit(0.0)).alias("verification_cost_usd"),
        "judge_text", "judge_cost_usd", "judge_latency_ms",
        (economy | ~verify | passed).alias("stop"),
    )


def settle_requests(routed: DataFrame, candidates: DataFrame, price: DataFrame,
                    accept: float = AUTO_ACCEPT_SCORE, force_mode: str | None = None) -> DataFrame:
    """The attempts made for each request: its answers up to the first stop, or
    all of them; a request without any has one row with a null ``tier_ord``."""
    rows = _attempt_rows(routed, candidates, price, accept, force_mode)
    w = Window.partitionBy("request_id")
    o = F.col("tier_ord")
    stop_ord = F.coalesce(F.min(F.when(F.col("stop"), o)).over(w), F.max(o).over(w))
    kept = rows.withColumn("stop_ord", stop_ord).where(o.isNull() | (o <= F.col("stop_ord")))
    return kept.select(
        "*",
        F.when(o.isNotNull(), F.row_number().over(w.orderBy("tier_ord"))).alias("attempt_no"),
        (F.col("generation_cost_usd") + F.col("verification_cost_usd")).alias("total_attempt_cost_usd"),
        (F.col("generation_latency_ms") + F.col("verification_latency_ms")).alias("attempt_latency_ms"),
    ).drop("stop", "stop_ord")


def settle(routed: DataFrame, candidates: DataFrame, price: DataFrame,
           accept: float = AUTO_ACCEPT_SCORE, force_mode: str | None = None) -> DataFrame:
    """Attempts actually made."""
    return settle_requests(routed, candidates, price, accept, force_mode).where(F.col("tier_ord").isNotNull())


ATTEMPT_COLUMNS = [
    "request_id", "mode", "initial_tier", "tier", "tier_ord", "attempt_no", "model_id",
    "verification_rule", "verification_performed", "verification_passed",
    "verification_score", "verification_error", "input_tokens", "output_tokens", "thinking_tokens",
    "generation_latency_ms", "verification_latency_ms", "generation_cost_usd",
    "verification_cost_usd", "total_attempt_cost_usd",
]


# --------------------------------------------------------------------------
# Fold attempts into one row per request
# --------------------------------------------------------------------------
def _ordered_sum(col: str):
    """Sum over the (at most three) attempts in tier order, as the loop adds them."""
    parts = [F.coalesce(F.sum(F.when(F.col("tier_ord") == k, F.col(col))), F.lit(0.0))
             for k in (1, 2, 3)]
    return parts[0] + parts[1] + parts[2]


def tier_name(ord_col) -> F.Column:
    return (F.when(ord_col == 1, "tier_1").when(ord_col == 2, "tier_2")
            .when(ord_col == 3, "tier_3"))


REQUEST_KEYS = ["request_id", "created_at", "mode", "category", "initial_tier",
                "tier_1_probability", "tier_2_probability", "tier_3_probability"]


def fold_attempts(attempts: DataFrame, price: DataFrame | None = None) -> DataFrame:
    """One row per request; the last attempt (highest tier) gives the final fields.
    A request without attempts (a null ``tier_ord``) is ``unsettled``.

    Request attributes are grouping keys (they depend on ``request_id``
    alone, so hash partitioning on ``request_id`` still satisfies the
    aggregate and no exchange is added); every aggregate has a fixed-width
    buffer (``max_by`` over numbers and booleans), so the plan is a hash
    aggregate rather than a sort aggregate.  The final model id is a
    broadcast lookup of the final tier.
    """
    o = F.col("tier_ord")
    codes = F.array(*[F.lit(e) for e in PARSE_ERRORS])
    g = attempts.withColumn("error_code", F.array_position(codes, F.col("verification_error")).cast("int")) \
        .groupBy(*REQUEST_KEYS).agg(
        F.max_by("error_code", o).alias("error_code"),
        F.max(o).alias("final_ord"),
        F.max_by("verification_performed", o).alias("verification_performed"),
        F.max_by("verification_passed", o).alias("verification_passed"),
        F.max_by("verification_score", o).alias("verification_score"),
        F.count(o).cast("int").alias("attempt_count"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.coalesce(F.sum("thinking_tokens"), F.lit(0)).alias("thinking_tokens"),
        _ordered_sum("total_attempt_cost_usd").alias("total_cost_usd"),
        _ordered_sum("attempt_latency_ms").alias("total_latency_ms"),
        F.bool_or("verification_performed").alias("any_verified"),
    ).withColumn("final_tier", tier_name(F.col("final_ord")))
    if price is None:
        price = _price_from(attempts)
    models = F.broadcast(price.select(F.col("tier").alias("final_tier"), "model_id"))
    return g.join(models, "final_tier", "left").select(
        "request_id", "created_at", "mode", "category", "initial_tier", "final_tier", "model_id",
        F.create_map(F.lit("tier_1"), "tier_1_probability", F.lit("tier_2"),
                     "tier_2_probability", F.lit("tier_3"), "tier_3_probability")
        .alias("routing_scores"),
        "verification_performed", "verification_passed", "verification_score",
        (F.col("final_tier") != F.col("initial_tier")).alias("escalated"),
        "attempt_count", "input_tokens", "output_tokens", "thinking_tokens",
        "total_cost_usd", "total_latency_ms", "any_verified",
        F.when(F.col("error_code") > 0, F.element_at(codes, F.col("error_code"))).alias("verification_error"),
        F.when(F.col("attempt_count") > 0, "settled").otherwise("unsettled").alias("status"),
    )


def _price_from(attempts: DataFrame) -> DataFrame:
    from tierflow.sources.views import price as price_view
    return price_view(attempts.sparkSession)


LOG_COLUMNS = [
    "request_id", "created_at", "mode", "initial_tier", "final_tier", "model_id",
    "routing_scores", "verification_performed", "verification_passed",
    "verification_score", "escalated", "attempt_count", "input_tokens", "output_tokens",
    "thinking_tokens", "total_cost_usd", "total_latency_ms",
]


def request_results(requests: DataFrame, candidates: DataFrame, price: DataFrame,
                    accept: float = AUTO_ACCEPT_SCORE) -> DataFrame:
    """One accounted row per request, settled or not (``status``)."""
    return fold_attempts(settle_requests(route_requests(requests), candidates, price, accept), price)


# --------------------------------------------------------------------------
# Cost identities as a data-quality job (violating rows only)
# --------------------------------------------------------------------------
def money(c: str | Column) -> Column:
    """An amount in USD as an exact decimal. Prices are multiples of 0.05 USD per
    million tokens, so amounts are multiples of 0.00000005 and eight places hold them
    exactly; a double that is off by its last bits comes back to its true value."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,8)")


def cost_identity_violations(attempts: DataFrame, log: DataFrame) -> DataFrame:
    """Rows that break a cost identity, in exact money: no tolerance, and no order of
    addition matters.

    attempt: total = generation + verification.  request: the total in the
    folded ``log`` equals the sum over the request's attempts, and the log has
    a row for it.  Attempts and log are keyed alike.
    """
    cost = money("total_attempt_cost_usd")
    diff = cost - (money("generation_cost_usd") + money("verification_cost_usd"))
    one = attempts.select("request_id", "tier", F.lit("attempt_cost").alias("identity"),
                          diff.cast("double").alias("difference")).where(F.col("difference") != 0)
    sums = attempts.groupBy("request_id").agg(F.sum(cost).alias("s"))
    both = sums.join(log.select("request_id", "total_cost_usd"), "request_id", "full")
    nothing = F.lit(0).cast("decimal(20,8)")
    total = F.coalesce(money("total_cost_usd"), nothing) - F.coalesce("s", nothing)
    two = both.select("request_id", F.lit(None).cast("string").alias("tier"),
                      F.lit("request_cost").alias("identity"), total.cast("double").alias("difference")) \
        .where(F.col("difference") != 0)
    return one.unionAll(two)


# --------------------------------------------------------------------------
# C4: strategy replay over recorded candidates
# --------------------------------------------------------------------------
def strategy_replay(requests: DataFrame, candidates: DataFrame, price: DataFrame,
                    accept: float = AUTO_ACCEPT_SCORE) -> DataFrame:
    """Three strategies per request from one settlement pass and one fold.

    always_tier_3: only the tier-3 answer; ml_only: only the routed tier, no
    judge; autopilot: the balanced escalation chain.  Quality of a strategy
    is the recorded judge verdict of the answer it ends with.  A strategy has a
    row where its answer was recorded; ``strategy_completeness`` lists the rest.
    """
    return _replay(requests, candidates, price, accept).drop("final_ord")


def strategy_answers(requests: DataFrame, candidates: DataFrame, price: DataFrame,
                     accept: float = AUTO_ACCEPT_SCORE) -> DataFrame:
    """prompt_id, strategy and judge_text of the answer that the strategy ended with."""
    r = _replay(requests, candidates, price, accept).select("prompt_id", "strategy", "final_ord")
    c = candidates.select(F.col("request_id").alias("prompt_id"), F.col("tier_ord").alias("final_ord"), "judge_text")
    return r.join(c, ["prompt_id", "final_ord"]).select("prompt_id", "strategy", "judge_text")


def _replay(requests: DataFrame, candidates: DataFrame, price: DataFrame, accept: float) -> DataFrame:
    routed = route_requests(requests)
    cand = with_judge(with_cost(candidates, price), "judge_text", out="j_", with_reason=False)
    rows = cand.join(routed, "request_id").select(
        "*", F.col("j_score").alias("q_score"),
        F.coalesce(F.col("j_passed"), F.lit(False)).alias("q_passed"))
    # autopilot chain on the same rows (balanced mode regardless of request mode)
    escalated = F.col("tier_ord") > F.col("initial_ord")
    should, _ = verification_rule(F.col("tier"), escalated, F.col("initial_score"), accept)
    in_chain = F.col("tier_ord") >= F.col("initial_ord")
    verify = in_chain & should
    stop = in_chain & (~verify | F.col("q_passed"))
    w = Window.partitionBy("request_id")
    rows = (rows.withColumn("verify", verify)
            .withColumn("stop_ord", F.coalesce(F.min(F.when(stop, F.col("tier_ord"))).over(w),
                                               F.max(F.when(in_chain, F.col("tier_ord"))).over(w))))
    ap = in_chain & (F.col("tier_ord") <= F.col("stop_ord"))
    ap_cost = F.col("generation_cost_usd") + F.when(F.col("verify"), F.col("judge_cost_usd")).otherwise(0.0)
    ap_lat = F.col("generation_latency_ms") + F.when(F.col("verify"), F.col("judge_latency_ms")).otherwise(0.0)
    is3 = F.col("tier_ord") == 3
    is_init = F.col("tier_ord") == F.col("initial_ord")
    is_last = ap & (F.col("tier_ord") == F.col("stop_ord"))

    def pick(cond, col):
        return F.max(F.when(cond, F.col(col)))

    def ordered(cond, expr):
        parts = [F.coalesce(F.sum(F.when(cond & (F.col("tier_ord") == k), expr)), F.lit(0.0))
                 for k in (1, 2, 3)]
        return parts[0] + parts[1] + parts[2]

    agg = rows.groupBy("request_id", "category", F.col("initial_tier").alias("routed_tier")).agg(
        pick(is3, "generation_cost_usd").alias("t3_cost"),
        pick(is3, "generation_latency_ms").alias("t3_lat"),
        F.max(F.when(is3, F.col("q_passed"))).alias("t3_pass"),
        pick(is3, "q_score").alias("t3_q"),
        pick(is_init, "generation_cost_usd").alias("ml_cost"),
        pick(is_init, "generation_latency_ms").alias("ml_lat"),
        F.max(F.when(is_init, F.col("q_passed"))).alias("ml_pass"),
        pick(is_init, "q_score").alias("ml_q"),
        F.max(F.when(is_last, F.col("tier_ord"))).alias("ap_final_ord"),
        F.max(F.when(is_last, F.col("q_passed"))).alias("ap_pass"),
        pick(is_last, "q_score").alias("ap_q"),
        F.count(F.when(ap, 1)).cast("int").alias("ap_attempts"),
        F.coalesce(F.max(F.when(ap, F.col("verify"))), F.lit(False)).alias("ap_verified"),
        ordered(ap, ap_cost).alias("ap_cost"),
        ordered(ap, ap_lat).alias("ap_lat"),
    )
    agg = agg.withColumn("ap_final", tier_name(F.col("ap_final_ord")))
    ml_ord = tier_ord("routed_tier")
    entry = "struct<strategy:string,initial_tier:string,final_tier:string," \
            "verification_performed:boolean,escalated:boolean,attempt_count:int," \
            "strategy_cost_usd:double,strategy_latency_ms:double,quality_passed:boolean," \
            "quality_score:double,final_ord:int>"
    three = F.array(
        F.when(F.col("t3_cost").isNotNull(), F.struct(
            F.lit("always_tier_3"), F.lit("tier_3"), F.lit("tier_3"), F.lit(False),
            F.lit(False), F.lit(1), F.col("t3_cost"), F.col("t3_lat"), F.col("t3_pass"),
            F.col("t3_q"), F.lit(3)).cast(entry)),
        F.when(F.col("ml_cost").isNotNull(), F.struct(
            F.lit("ml_only"), F.col("routed_tier"), F.col("routed_tier"), F.lit(False),
            F.lit(False), F.lit(1), F.col("ml_cost"), F.col("ml_lat"), F.col("ml_pass"),
            F.col("ml_q"), ml_ord).cast(entry)),
        F.when(F.col("ap_attempts") > 0, F.struct(F.lit("autopilot"), F.col("routed_tier"), F.col("ap_final"),
                 F.col("ap_verified"), F.col("ap_final") != F.col("routed_tier"),
                 F.col("ap_attempts"), F.col("ap_cost"), F.col("ap_lat"), F.col("ap_pass"),
                 F.col("ap_q"), F.col("ap_final_ord")).cast(entry)),
    )
    return agg.select(F.col("request_id").alias("prompt_id"), "category",
                      F.inline(F.array_compact(three)))
