"""Registered queries: settlement, usage reports, strategy benchmark, judge jobs."""
from __future__ import annotations

from pyspark.sql import functions as F

from tierflow.operators import judge as J
from tierflow.operators import reports as R
from tierflow.operators import settle as S
from tierflow.plans.oracle_settle import (REPLAY_CTES, SETTLE_CTES, judge_sql, reason_sql,
                                          ROUTED, COSTED)
from tierflow.session import materialize
from tierflow.sources import views as V
from tierflow.sources.tables import read_table

# ---------------------------------------------------------------------------
# shared inputs
# ---------------------------------------------------------------------------


def _inputs(spark, sf):
    return V.requests(spark, sf), V.candidates(spark, sf), V.price(spark)


def attempts(spark, sf):
    req, cand, price = _inputs(spark, sf)
    return S.settle(S.route_requests(req), cand, price)


def results(spark, sf):
    """One row per request, settled or not."""
    req, cand, price = _inputs(spark, sf)
    return S.request_results(req, cand, price)


def usage_log(spark, sf):
    """The settled requests: what the usage log and its reports hold."""
    return results(spark, sf).where(F.col("status") == "settled")


def replay(spark, sf):
    req, cand, price = _inputs(spark, sf)
    return S.strategy_replay(req, cand, price)


def withheld_replay(spark, sf):
    """Benchmark rows with some answers withheld (every 7th prompt lacks ml_only,
    every 11th lacks autopilot), to exercise the completeness check."""
    b = replay(spark, sf)
    pid = F.col("prompt_id").cast("bigint")
    drop = (((pid % 7) == 0) & (F.col("strategy") == "ml_only")) | \
           (((pid % 11) == 0) & (F.col("strategy") == "autopilot"))
    return b.where(~drop)


# ---------------------------------------------------------------------------
# Spark queries
# ---------------------------------------------------------------------------
LOG_OUT = [c for c in S.LOG_COLUMNS if c != "routing_scores"] + ["any_verified"]
FOLD_OUT = ["request_id", "attempt_count", "input_tokens", "output_tokens", "thinking_tokens",
            "total_cost_usd", "total_latency_ms", "final_tier", "model_id",
            "verification_performed", "verification_passed", "verification_score",
            "verification_error", "any_verified"]
RESULT_OUT = LOG_OUT + ["verification_error", "status"]


def q_route_decision_requests(spark, sf):
    return S.with_decision(V.requests(spark, sf)).select(
        "request_id", "selected_tier", "fallback_used", "reason")


def q_call_cost(spark, sf):
    cand = S.with_cost(V.candidates(spark, sf), V.price(spark))
    return cand.select("request_id", "tier", "billable_output_tokens",
                       F.col("generation_cost_usd").alias("estimated_cost_usd"),
                       "judge_cost_usd")


def q_verification_policy(spark, sf):
    req, cand, _ = _inputs(spark, sf)
    j = S.escalation_candidates(S.route_requests(req), cand)
    should, rule = S.verification_rule(F.col("tier"), F.col("tier_ord") > F.col("initial_ord"),
                                       F.col("initial_score"))
    return j.select("request_id", "tier", should.alias("should_verify"), rule.alias("rule"))


def q_escalation_candidates(spark, sf):
    req, cand, _ = _inputs(spark, sf)
    return S.escalation_candidates(S.route_requests(req), cand).select(
        "request_id", "initial_tier", "tier", "tier_ord")


def q_settled_attempts(spark, sf):
    return attempts(spark, sf).select(*S.ATTEMPT_COLUMNS)


def q_request_fold(spark, sf):
    return usage_log(spark, sf).select(*FOLD_OUT)


def q_request_results(spark, sf):
    return results(spark, sf).select(*RESULT_OUT)


def _written_attempts(spark, sf):
    """The attempts, written once, and the log folded from them."""
    req, cand, price = _inputs(spark, sf)
    rows = materialize(S.settle_requests(S.route_requests(req), cand, price), "attempts")
    return rows.where("tier_ord IS NOT NULL"), S.fold_attempts(rows, price).where("status = 'settled'")


def q_cost_identity_violations(spark, sf):
    att, log = _written_attempts(spark, sf)
    return S.cost_identity_violations(att, log)


def q_cost_identity_planted(spark, sf):
    """The same check over a log and attempts with faults put in: every 97th
    request's total is a cent too high, every 89th attempt-1 row too low, and
    every 83rd request is missing from the log."""
    rid = F.col("request_id").cast("bigint")
    att, log = _written_attempts(spark, sf)
    log = log.where(rid % 83 != 0).withColumn(
        "total_cost_usd", F.col("total_cost_usd") + F.when(rid % 97 == 0, 0.01).otherwise(0.0))
    att = att.withColumn(
        "total_attempt_cost_usd", F.col("total_attempt_cost_usd")
        - F.when((rid % 89 == 0) & (F.col("attempt_no") == 1), 0.02).otherwise(0.0))
    return S.cost_identity_violations(att, log)


def q_candidate_totals(spark, sf):
    """Per tier: answers and tokens of the view; the oracle sums lineitem itself."""
    return V.candidates(spark, sf).groupBy("tier").agg(
        F.count(F.lit(1)).alias("answers"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.sum("thinking_tokens").alias("thinking_tokens"))


def q_usage_summary(spark, sf):
    return R.usage_summary(usage_log(spark, sf))


def q_usage_dashboard(spark, sf):
    return R.usage_dashboard(usage_log(spark, sf), V.price(spark))


def q_tier_usage(spark, sf):
    return R.tier_usage(usage_log(spark, sf))


def q_mode_usage(spark, sf):
    return R.mode_usage(usage_log(spark, sf))


def q_savings_summary(spark, sf):
    return R.savings_summary(usage_log(spark, sf), V.price(spark))


def q_recent_requests(spark, sf):
    return R.recent_requests(usage_log(spark, sf)).select(*LOG_OUT)


def q_strategy_replay(spark, sf):
    return replay(spark, sf)


def q_strategy_summary(spark, sf):
    return R.strategy_summary(replay(spark, sf))


def q_strategy_tier_share(spark, sf):
    return R.strategy_tier_share(replay(spark, sf))


def q_category_strategy(spark, sf):
    return R.category_strategy(replay(spark, sf))


def q_strategy_completeness(spark, sf):
    prompts = V.requests(spark, sf).select(F.col("request_id").alias("prompt_id"))
    return R.strategy_completeness(withheld_replay(spark, sf), prompts)


def q_benchmark_matrix(spark, sf):
    return J.benchmark_matrix(read_table(spark, sf, "benchmark", "item_id", "text"),
                              V.price(spark))


def q_judge_parse(spark, sf):
    return J.parse_judge(V.candidates(spark, sf), "judge_text", keys=["request_id", "tier"])


def q_judge_parse_multi(spark, sf):
    return J.parse_judge_multi(J.combined_judge_texts(S.strategy_answers(*_inputs(spark, sf))))


def q_verification_overhead(spark, sf):
    return J.verification_overhead(attempts(spark, sf))


def q_judge_overhead(spark, sf):
    req, cand, price = _inputs(spark, sf)
    return J.evaluator_overhead(evaluator_calls(spark, sf), price)


def evaluator_calls(spark, sf):
    """One evaluator call per prompt that has all three answers: its reply is the
    combined text, its prompt the three answers (four characters a token)."""
    return J.evaluator_calls(J.combined_judge_texts(S.strategy_answers(*_inputs(spark, sf))))


def q_judge_batch_three(spark, sf):
    return J.judge_batch_three(V.qa_pairs(spark, sf))


def q_judge_batch(spark, sf):
    return J.judge_batch(V.qa_pairs(spark, sf))


SPARK = {
    "call_cost": q_call_cost,
    "verification_policy": q_verification_policy,
    "escalation_candidates": q_escalation_candidates,
    "settled_attempts": q_settled_attempts,
    "request_fold": q_request_fold,
    "request_results": q_request_results,
    "cost_identity_violations": q_cost_identity_violations,
    "cost_identity_planted": q_cost_identity_planted,
    "candidate_totals": q_candidate_totals,
    "verification_overhead": q_verification_overhead,
    "judge_batch_three": q_judge_batch_three,
    "usage_summary": q_usage_summary,
    "usage_dashboard": q_usage_dashboard,
    "tier_usage": q_tier_usage,
    "mode_usage": q_mode_usage,
    "savings_summary": q_savings_summary,
    "recent_requests": q_recent_requests,
    "strategy_replay": q_strategy_replay,
    "strategy_summary": q_strategy_summary,
    "strategy_tier_share": q_strategy_tier_share,
    "category_strategy": q_category_strategy,
    "strategy_completeness": q_strategy_completeness,
    "benchmark_matrix": q_benchmark_matrix,
    "judge_parse": q_judge_parse,
    "judge_parse_multi": q_judge_parse_multi,
    "judge_overhead": q_judge_overhead,
    "judge_batch": q_judge_batch,
    "request_route_decision": q_route_decision_requests,
}

# ---------------------------------------------------------------------------
# Oracle SQL bodies (views and CTEs are prefixed by plans.registry)
# ---------------------------------------------------------------------------
_LOG_SQL = ", ".join(LOG_OUT)
_FOLD_SQL = ", ".join(FOLD_OUT)
_ATT_SQL = ", ".join(S.ATTEMPT_COLUMNS)


def sql_lit(text: str) -> str:
    """A SQL string literal; newlines become chr(10) so both engines agree."""
    parts = text.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    return "(" + " || chr(10) || ".join(quoted) + ")"


def _rate(num, den="COUNT(*)"):
    return f"CASE WHEN ({den}) > 0 THEN CAST({num} AS DOUBLE) / ({den}) ELSE 0.0 END"


#: One evaluator reply per prompt: the judge's text of the answer that each
#: strategy ended with, its labels prefixed, in a fixed order.
EVALUATOR_SQL = """
SELECT prompt_id AS request_id, COUNT(judge_text) AS n,
       string_agg(replace(replace(judge_text, 'VERDICT:', p || '_VERDICT:'), 'SCORE:', p || '_SCORE:'), chr(10) ORDER BY k) AS t
FROM (SELECT *, upper(strategy) AS p,
             CASE strategy WHEN 'always_tier_3' THEN 0 WHEN 'ml_only' THEN 1 ELSE 2 END AS k FROM replay) z
GROUP BY prompt_id"""

ORACLE = {
    "call_cost": ([("costed", COSTED)], """
SELECT request_id, tier, billable_output_tokens, generation_cost_usd AS estimated_cost_usd,
       judge_cost_usd FROM costed"""),
    "verification_policy": ([("routed", ROUTED)], """
SELECT c.request_id, c.tier,
       c.tier <> 'tier_3' AND (c.tier_ord > r.initial_ord OR r.initial_score < CAST(0.9 AS DOUBLE)) AS should_verify,
       CASE WHEN c.tier = 'tier_3' THEN 'top_tier_no_escalation'
            WHEN c.tier_ord > r.initial_ord THEN 'escalated_must_verify'
            WHEN r.initial_score >= CAST(0.9 AS DOUBLE) THEN 'auto_accept'
            ELSE 'below_auto_accept' END AS rule
FROM candidates c JOIN routed r ON r.request_id = c.request_id WHERE c.tier_ord >= r.initial_ord"""),
    "escalation_candidates": ([("routed", ROUTED)], """
SELECT c.request_id, r.initial_tier, c.tier, c.tier_ord
FROM candidates c JOIN routed r ON r.request_id = c.request_id WHERE c.tier_ord >= r.initial_ord"""),
    "settled_attempts": (SETTLE_CTES, f"SELECT {_ATT_SQL} FROM settled"),
    "request_fold": (SETTLE_CTES, f"SELECT {_FOLD_SQL} FROM folded"),
    "request_results": (SETTLE_CTES, f"SELECT {', '.join(RESULT_OUT)} FROM folded_all"),
    "cost_identity_violations": (SETTLE_CTES, """
SELECT request_id, tier, 'attempt_cost' AS identity, CAST(d AS DOUBLE) AS difference
FROM (SELECT *, CAST(total_attempt_cost_usd AS DECIMAL(38,8)) - CAST(generation_cost_usd AS DECIMAL(38,8))
                - CAST(verification_cost_usd AS DECIMAL(38,8)) AS d FROM settled) x WHERE d <> 0
UNION ALL
SELECT request_id, CAST(NULL AS VARCHAR), 'request_cost', CAST(d AS DOUBLE)
FROM (SELECT f.request_id, CAST(f.total_cost_usd AS DECIMAL(38,8)) - s.s AS d
      FROM folded f JOIN (SELECT request_id, SUM(CAST(total_attempt_cost_usd AS DECIMAL(38,8))) AS s FROM settled GROUP BY request_id) s
        ON s.request_id = f.request_id) y WHERE d <> 0"""),
    "cost_identity_planted": (SETTLE_CTES, """
SELECT request_id, tier, 'attempt_cost' AS identity, CAST(-0.02 AS DOUBLE) AS difference
FROM settled WHERE CAST(request_id AS BIGINT) % 89 = 0 AND attempt_no = 1
UNION ALL
SELECT request_id, CAST(NULL AS VARCHAR), 'request_cost', CAST(d AS DOUBLE) FROM (
  SELECT request_id,
         CASE WHEN CAST(request_id AS BIGINT) % 83 = 0 THEN -CAST(total_cost_usd AS DECIMAL(38,8))
              WHEN CAST(request_id AS BIGINT) % 97 = 0 THEN CAST(0.01 AS DECIMAL(38,8)) ELSE CAST(0 AS DECIMAL(38,8)) END
         + CASE WHEN CAST(request_id AS BIGINT) % 89 = 0 THEN CAST(0.02 AS DECIMAL(38,8)) ELSE CAST(0 AS DECIMAL(38,8)) END AS d
  FROM folded) x WHERE d <> 0"""),
    "candidate_totals": ([], """
SELECT CONCAT('tier_', CAST((l_linenumber - 1) % 3 + 1 AS VARCHAR)) AS tier,
       COUNT(DISTINCT l_orderkey) AS answers, CAST(SUM(CAST(l_quantity AS BIGINT) * 20) AS BIGINT) AS input_tokens,
       CAST(SUM(l_partkey % 900 + 50) AS BIGINT) AS output_tokens,
       CAST(SUM(CASE WHEN (l_linenumber - 1) % 3 = 2 THEN l_suppkey % 200 ELSE 0 END) AS BIGINT) AS thinking_tokens
FROM lineitem GROUP BY 1"""),
    "usage_summary": (SETTLE_CTES, f"""
SELECT COUNT(*) AS total_requests,
       ROUND(COALESCE(SUM(total_cost_usd), 0.0), 9) AS total_cost_usd,
       ROUND(CASE WHEN COUNT(*) > 0 THEN SUM(total_cost_usd) / COUNT(*) ELSE 0.0 END, 9) AS average_cost_usd,
       ROUND(CASE WHEN COUNT(*) > 0 THEN SUM(total_latency_ms) / COUNT(*) ELSE 0.0 END, 4) AS average_latency_ms,
       CAST(COALESCE(SUM(input_tokens), 0) AS BIGINT) AS total_input_tokens,
       CAST(COALESCE(SUM(output_tokens), 0) AS BIGINT) AS total_output_tokens,
       CAST(COALESCE(SUM(thinking_tokens), 0) AS BIGINT) AS total_thinking_tokens,
       CAST(COALESCE(SUM(input_tokens), 0) + COALESCE(SUM(output_tokens), 0) + COALESCE(SUM(thinking_tokens), 0) AS BIGINT) AS total_tokens,
       {_rate('COALESCE(SUM(attempt_count), 0)')} AS average_attempt_count,
       {_rate('COALESCE(SUM(CAST(verification_performed AS INT)), 0)')} * 100 AS verification_rate,
       {_rate('COALESCE(SUM(CAST(escalated AS INT)), 0)')} * 100 AS escalation_rate,
       {_rate('COALESCE(SUM(CAST(any_verified AS INT)), 0)')} * 100 AS any_verification_rate
FROM folded"""),
    "usage_dashboard": (SETTLE_CTES, """
SELECT report, key, requests, percentage, CAST(cost AS DOUBLE) AS total_cost_usd,
       ROUND(CASE WHEN requests > 0 THEN CAST(cost AS DOUBLE) / requests ELSE 0.0 END, 9) AS average_cost_usd,
       ROUND(CASE WHEN requests > 0 THEN latency / requests ELSE 0.0 END, 4) AS average_latency_ms,
       CASE WHEN requests > 0 THEN CAST(att AS DOUBLE) / requests ELSE 0.0 END AS average_attempt_count,
       CASE WHEN requests > 0 THEN CAST(ver AS DOUBLE) / requests ELSE 0.0 END * 100 AS verification_rate,
       CASE WHEN requests > 0 THEN CAST(esc AS DOUBLE) / requests ELSE 0.0 END * 100 AS escalation_rate,
       CASE WHEN requests > 0 THEN CAST(anyv AS DOUBLE) / requests ELSE 0.0 END * 100 AS any_verification_rate,
       input_tokens, output_tokens, thinking_tokens,
       CAST(base AS DOUBLE) AS tier_3_equivalent_cost_usd, CAST(base - cost AS DOUBLE) AS estimated_savings_usd,
       ROUND(CASE WHEN base > 0 THEN CAST(base - cost AS DOUBLE) / CAST(base AS DOUBLE) * 100 ELSE 0.0 END, 6) AS estimated_savings_percentage
FROM (
  SELECT d.report, d.key, COALESCE(n, 0) AS requests, COALESCE(CAST(n AS DOUBLE) / SUM(n) FILTER (WHERE d.report = 'summary') OVER () * 100, 0.0) AS percentage,
         COALESCE(cost, 0) AS cost, COALESCE(latency, 0.0) AS latency, COALESCE(att, 0) AS att, COALESCE(ver, 0) AS ver,
         COALESCE(esc, 0) AS esc, COALESCE(anyv, 0) AS anyv, CAST(COALESCE(i, 0) AS BIGINT) AS input_tokens,
         CAST(COALESCE(o, 0) AS BIGINT) AS output_tokens, CAST(COALESCE(t, 0) AS BIGINT) AS thinking_tokens,
         CAST(CAST(COALESCE(i, 0) AS DECIMAL(20,0)) * CAST((SELECT input_cost_per_million FROM price WHERE tier = 'tier_3') AS DECIMAL(10,2)) / 1000000 AS DECIMAL(38,8))
         + CAST(CAST(COALESCE(o, 0) + COALESCE(t, 0) AS DECIMAL(20,0)) * CAST((SELECT output_cost_per_million FROM price WHERE tier = 'tier_3') AS DECIMAL(10,2)) / 1000000 AS DECIMAL(38,8)) AS base
  FROM (SELECT 'summary' AS report, 'all' AS key UNION SELECT 'tier', unnest(['tier_1', 'tier_2', 'tier_3'])
        UNION SELECT 'tier', final_tier FROM folded UNION SELECT 'mode', mode FROM folded) d
  LEFT JOIN (
    SELECT CASE WHEN GROUPING(final_tier) = 0 THEN 'tier' WHEN GROUPING(mode) = 0 THEN 'mode' ELSE 'summary' END AS report,
           CASE WHEN GROUPING(final_tier) = 0 THEN final_tier WHEN GROUPING(mode) = 0 THEN mode ELSE 'all' END AS key,
           COUNT(*) AS n, SUM(CAST(total_cost_usd AS DECIMAL(38,8))) AS cost, SUM(total_latency_ms) AS latency,
           CAST(SUM(attempt_count) AS BIGINT) AS att, CAST(SUM(CAST(verification_performed AS INT)) AS BIGINT) AS ver,
           CAST(SUM(CAST(escalated AS INT)) AS BIGINT) AS esc, CAST(SUM(CAST(any_verified AS INT)) AS BIGINT) AS anyv,
           SUM(input_tokens) AS i, SUM(output_tokens) AS o, SUM(thinking_tokens) AS t
    FROM folded GROUP BY GROUPING SETS ((), (final_tier), (mode))) g
  ON g.report = d.report AND g.key IS NOT DISTINCT FROM d.key) x"""),
    "tier_usage": (SETTLE_CTES, """
SELECT tier, count,
       CASE WHEN SUM(count) OVER () > 0 THEN CAST(count AS DOUBLE) / SUM(count) OVER () * 100 ELSE 0.0 END AS percentage
FROM (SELECT COALESCE(d.tier, c.tier) AS tier, CAST(COALESCE(c.n, 0) AS BIGINT) AS count
      FROM (VALUES ('tier_1'), ('tier_2'), ('tier_3')) AS d(tier)
      FULL OUTER JOIN (SELECT final_tier AS tier, COUNT(*) AS n FROM folded GROUP BY final_tier) c
        ON c.tier = d.tier) t"""),
    "mode_usage": (SETTLE_CTES, """
SELECT mode, count,
       CASE WHEN SUM(count) OVER () > 0 THEN CAST(count AS DOUBLE) / SUM(count) OVER () * 100 ELSE 0.0 END AS percentage
FROM (SELECT mode, CAST(COUNT(*) AS BIGINT) AS count FROM folded GROUP BY mode) t"""),
    "savings_summary": (SETTLE_CTES, """
SELECT total_requests,
       ROUND(actual, 9) AS actual_cost_usd, ROUND(base, 9) AS tier_3_equivalent_cost_usd,
       ROUND(base - actual, 9) AS estimated_savings_usd,
       ROUND(CASE WHEN base > 0 THEN (base - actual) / base * 100 ELSE 0.0 END, 6) AS estimated_savings_percentage,
       ROUND(CASE WHEN total_requests > 0 THEN actual / total_requests ELSE 0.0 END, 9) AS average_actual_cost_usd,
       ROUND(CASE WHEN total_requests > 0 THEN base / total_requests ELSE 0.0 END, 9) AS average_tier_3_equivalent_cost_usd,
       input_tokens, output_tokens, thinking_tokens, output_tokens + thinking_tokens AS billable_output_tokens,
       pin AS input_cost_per_million, pout AS output_cost_per_million
FROM (
  SELECT *, CAST(input_tokens AS DOUBLE) / 1000000 * pin
            + CAST(output_tokens + thinking_tokens AS DOUBLE) / 1000000 * pout AS base
  FROM (SELECT COUNT(*) AS total_requests, COALESCE(SUM(total_cost_usd), 0.0) AS actual,
               CAST(COALESCE(SUM(input_tokens), 0) AS BIGINT) AS input_tokens,
               CAST(COALESCE(SUM(output_tokens), 0) AS BIGINT) AS output_tokens,
               CAST(COALESCE(SUM(thinking_tokens), 0) AS BIGINT) AS thinking_tokens,
               (SELECT input_cost_per_million FROM price WHERE tier = 'tier_3') AS pin,
               (SELECT output_cost_per_million FROM price WHERE tier = 'tier_3') AS pout
        FROM folded) a) b"""),
    "recent_requests": (SETTLE_CTES, f"""
SELECT {_LOG_SQL} FROM folded ORDER BY created_at DESC, request_id LIMIT 50"""),
    "strategy_replay": (REPLAY_CTES, """
SELECT prompt_id, category, strategy, initial_tier, final_tier, verification_performed, escalated, attempt_count,
       strategy_cost_usd, strategy_latency_ms, quality_passed, quality_score FROM replay"""),
    "strategy_summary": (REPLAY_CTES, f"""
SELECT strategy, requests, ROUND(c, 9) AS total_cost_usd, ROUND(c / requests, 9) AS average_cost_usd,
       ROUND(l / requests, 4) AS average_latency_ms,
       {_rate('qp', 'nqp')} AS quality_pass_rate,
       ROUND(qs / nqs, 9) AS average_quality_score,
       {_rate('v', 'requests')} AS verification_rate,
       {_rate('e', 'requests')} AS escalation_rate,
       {_rate('att', 'requests')} AS average_attempts,
       ROUND((MAX(CASE WHEN strategy = 'always_tier_3' THEN c END) OVER () - c)
             / NULLIF(MAX(CASE WHEN strategy = 'always_tier_3' THEN c END) OVER (), 0), 9) AS cost_savings_vs_tier3
FROM (SELECT strategy, COUNT(*) AS requests, SUM(strategy_cost_usd) AS c, SUM(strategy_latency_ms) AS l,
             SUM(CAST(quality_passed AS INT)) AS qp, COUNT(quality_passed) AS nqp,
             SUM(quality_score) AS qs, COUNT(quality_score) AS nqs,
             SUM(CAST(verification_performed AS INT)) AS v, SUM(CAST(escalated AS INT)) AS e,
             SUM(attempt_count) AS att
      FROM replay GROUP BY strategy) s"""),
    "strategy_tier_share": (REPLAY_CTES, """
SELECT strategy, final_tier, count, CAST(count AS DOUBLE) / SUM(count) OVER (PARTITION BY strategy) AS share
FROM (SELECT strategy, final_tier, COUNT(*) AS count FROM replay GROUP BY strategy, final_tier) t"""),
    "category_strategy": (REPLAY_CTES, """
SELECT category, strategy, ROUND(AVG(strategy_cost_usd), 9) AS cost, ROUND(AVG(quality_score), 9) AS quality,
       AVG(CAST(quality_passed AS INT)) AS passed
FROM replay GROUP BY category, strategy"""),
    "strategy_completeness": (REPLAY_CTES, """
SELECT prompt_id, string_agg(strategy, ',' ORDER BY strategy) AS missing
FROM (SELECT q.request_id AS prompt_id, s.strategy FROM requests q,
             (VALUES ('always_tier_3'), ('autopilot'), ('ml_only')) AS s(strategy)
      EXCEPT
      SELECT prompt_id, strategy FROM replay
      WHERE NOT ((CAST(prompt_id AS BIGINT) % 7 = 0 AND strategy = 'ml_only')
              OR (CAST(prompt_id AS BIGINT) % 11 = 0 AND strategy = 'autopilot'))) t
GROUP BY prompt_id"""),
    "judge_parse": ([], f"""
SELECT request_id, tier, j_verdict AS verdict, j_score AS score,
       CASE WHEN j_parse_error IS NULL THEN {reason_sql('judge_text')} END AS reason,
       j_passed AS passed, j_parse_error AS parse_error
FROM (SELECT *, {judge_sql('judge_text')} FROM candidates) c"""),
    "judge_parse_multi": (REPLAY_CTES, f"""
SELECT request_id, s.strategy, s.verdict, s.score, s.passed, s.parse_error
FROM (SELECT request_id, {judge_sql('t', 'ALWAYS_TIER_3_', 'a_')}, {judge_sql('t', 'ML_ONLY_', 'm_')},
             {judge_sql('t', 'AUTOPILOT_', 'p_')}
      FROM ({EVALUATOR_SQL}) x) y,
LATERAL (VALUES ('always_tier_3', a_verdict, a_score, a_passed, a_parse_error),
                ('ml_only', m_verdict, m_score, m_passed, m_parse_error),
                ('autopilot', p_verdict, p_score, p_passed, p_parse_error))
  AS s(strategy, verdict, score, passed, parse_error)"""),
    "judge_overhead": (REPLAY_CTES, f"""
SELECT COUNT(*) AS evaluator_calls, CAST(SUM(i) AS BIGINT) AS evaluator_input_tokens,
       CAST(SUM(o) AS BIGINT) AS evaluator_output_tokens,
       ROUND(SUM(CAST(i AS DOUBLE) / 1000000 * 0.75 + CAST(o AS DOUBLE) / 1000000 * 3.75), 9) AS evaluator_cost_usd,
       ROUND(SUM(CAST(o * 10 AS DOUBLE)), 4) AS evaluator_latency_ms
FROM (SELECT length(t) // 4 + 300 AS i, length(t) // 4 + 1 AS o FROM ({EVALUATOR_SQL}) x WHERE n = 3) y"""),
    "judge_batch_three": ([], f"""
SELECT conv_id, turn,
       CASE WHEN prompt IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL
            THEN {sql_lit(J.THREE_HEAD)} || prompt || {sql_lit(J.THREE_MARKS[0])} || a || {sql_lit(J.THREE_MARKS[1])} || b
                 || {sql_lit(J.THREE_MARKS[2])} || c || {sql_lit(J.JUDGE_TEMPLATE_TAIL)} END AS judge_prompt,
       a IS NULL OR b IS NULL OR c IS NULL AS missing_answer
FROM (SELECT conv_id, turn, prompt, answer AS a,
             LEAD(answer, 1) OVER (PARTITION BY conv_id ORDER BY turn) AS b,
             LEAD(answer, 2) OVER (PARTITION BY conv_id ORDER BY turn) AS c FROM qa_pairs) q"""),
    "judge_batch": ([], f"""
SELECT conv_id, turn,
       CASE WHEN answer IS NOT NULL AND prompt IS NOT NULL
            THEN {sql_lit(J.JUDGE_TEMPLATE_HEAD)} || prompt || {sql_lit(J.JUDGE_TEMPLATE_MID)} || answer || {sql_lit(J.JUDGE_TEMPLATE_TAIL)}
       END AS judge_prompt,
       answer IS NULL AS missing_answer
FROM qa_pairs"""),
    "benchmark_matrix": ([], """
SELECT b.item_id AS prompt_id, p.tier, p.model_id, CAST(length(b.text) AS INT) AS prompt_chars
FROM benchmark b CROSS JOIN price p"""),
    "request_route_decision": ([], """
SELECT request_id,
       CASE WHEN tier_1_probability >= CAST(0.8 AS DOUBLE) THEN 'tier_1'
            WHEN tier_2_probability >= CAST(0.7 AS DOUBLE) THEN 'tier_2' ELSE 'tier_3' END AS selected_tier,
       tier_1_probability < CAST(0.8 AS DOUBLE) AND tier_2_probability < CAST(0.7 AS DOUBLE) AS fallback_used,
       CASE WHEN tier_1_probability >= CAST(0.8 AS DOUBLE) THEN 'Tier 1 predicted success score passed its threshold.'
            WHEN tier_2_probability >= CAST(0.7 AS DOUBLE) THEN 'Tier 1 did not meet its threshold, but Tier 2 did.'
            ELSE 'Neither Tier 1 nor Tier 2 met the required routing threshold, so the strongest tier was selected.'
       END AS reason
FROM requests"""),
    "verification_overhead": (SETTLE_CTES, """
SELECT mode, CAST(SUM(CAST(verification_performed AS INT)) AS BIGINT) AS judge_calls,
       ROUND(SUM(verification_cost_usd), 9) AS judge_cost_usd,
       ROUND(SUM(verification_latency_ms), 4) AS judge_latency_ms,
       ROUND(SUM(generation_cost_usd), 9) AS generation_cost_usd,
       ROUND(CASE WHEN SUM(total_attempt_cost_usd) > 0
                  THEN SUM(verification_cost_usd) / SUM(total_attempt_cost_usd) ELSE 0.0 END, 9) AS judge_cost_share
FROM settled GROUP BY mode"""),
}
