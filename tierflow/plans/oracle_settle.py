"""Oracle SQL (DuckDB) for settlement, reports and the strategy benchmark.

Written independently of the DataFrame code: plain window / CASE / GROUP BY
SQL over the fixture views.  Shared pieces are CTE bodies.
"""
from __future__ import annotations

from tierflow.constants import PY_SPACE_CLASS

WS = f"[{PY_SPACE_CLASS}]"

# judge text -> parsed columns (prefix p on the output names)
def judge_sql(text: str, prefix: str = "", out: str = "j_") -> str:
    v = f"NULLIF(regexp_extract({text}, '(?i){prefix}VERDICT:{WS}*(PASS|FAIL)', 1), '')"
    s = f"TRY_CAST(NULLIF(regexp_extract({text}, '(?i){prefix}SCORE:{WS}*([0-9]*\\.?[0-9]+)', 1), '') AS DOUBLE)"
    err = (f"CASE WHEN {text} IS NULL THEN 'missing_text' WHEN {v} IS NULL THEN 'missing_verdict' "
           f"WHEN {s} IS NULL THEN 'missing_score' WHEN {s} < 0 OR {s} > 1 THEN 'score_out_of_range' END")
    return (f"CASE WHEN ({err}) IS NULL THEN upper({v}) END AS {out}verdict, "
            f"CASE WHEN ({err}) IS NULL THEN {s} END AS {out}score, "
            f"CASE WHEN ({err}) IS NULL THEN upper({v}) = 'PASS' AND {s} >= CAST(0.80 AS DOUBLE) END AS {out}passed, "
            f"{err} AS {out}parse_error")


def reason_sql(text: str) -> str:
    r = f"regexp_extract({text}, '(?is)REASON:{WS}*(.+)', 1)"
    return (f"CASE WHEN {r} = '' THEN 'No reason provided.' "
            f"ELSE regexp_replace({r}, '^{WS}+|{WS}+$', '', 'g') END")


ROUTED = """
SELECT r.*, CASE initial_tier WHEN 'tier_1' THEN 1 WHEN 'tier_2' THEN 2 ELSE 3 END AS initial_ord,
       CASE initial_tier WHEN 'tier_1' THEN tier_1_probability WHEN 'tier_2' THEN tier_2_probability
            ELSE tier_3_probability END AS initial_score
FROM (SELECT *, CASE WHEN tier_1_probability >= CAST(0.8 AS DOUBLE) THEN 'tier_1'
                     WHEN tier_2_probability >= CAST(0.7 AS DOUBLE) THEN 'tier_2'
                     ELSE 'tier_3' END AS initial_tier
      FROM requests) r"""

COSTED = """
SELECT c.*, p.model_id,
       COALESCE(c.output_tokens, 0) + COALESCE(c.thinking_tokens, 0) AS billable_output_tokens,
       CAST(COALESCE(c.input_tokens, 0) AS DOUBLE) / 1000000 * p.input_cost_per_million
         + CAST(COALESCE(c.output_tokens, 0) + COALESCE(c.thinking_tokens, 0) AS DOUBLE) / 1000000
           * p.output_cost_per_million AS generation_cost_usd,
       CAST(COALESCE(c.judge_input_tokens, 0) AS DOUBLE) / 1000000 * v.input_cost_per_million
         + CAST(COALESCE(c.judge_output_tokens, 0) + 0 AS DOUBLE) / 1000000
           * v.output_cost_per_million AS judge_cost_usd
FROM candidates c
LEFT JOIN price p ON p.tier = c.tier
LEFT JOIN price v ON v.tier = 'tier_3'"""

# the answers a request may get: economy calls the routed tier only
ATT = f"""
SELECT *, mode = 'economy' OR NOT verify OR COALESCE(j_passed, FALSE) AS stop
FROM (
  SELECT *, mode <> 'economy' AND rule0 IN ('escalated_must_verify', 'below_auto_accept') AS verify,
         {judge_sql('judge_text')}, {reason_sql('judge_text')} AS j_reason
  FROM (
    SELECT c.*, r.created_at, r.mode, r.category, r.initial_tier, r.initial_ord, r.initial_score,
           r.tier_1_probability, r.tier_2_probability, r.tier_3_probability,
           CASE WHEN c.tier = 'tier_3' THEN 'top_tier_no_escalation'
                WHEN c.tier_ord > r.initial_ord THEN 'escalated_must_verify'
                WHEN r.initial_score >= CAST(0.9 AS DOUBLE) THEN 'auto_accept'
                ELSE 'below_auto_accept' END AS rule0
    FROM costed c JOIN routed r ON r.request_id = c.request_id
    WHERE c.tier_ord >= r.initial_ord AND (r.mode <> 'economy' OR c.tier_ord = r.initial_ord)) a) b"""

# the loop: an attempt is made if no earlier one of its request stopped
SETTLED = """
SELECT request_id, created_at, mode, category, initial_tier, initial_ord,
       tier_1_probability, tier_2_probability, tier_3_probability,
       tier, tier_ord, CAST(ROW_NUMBER() OVER (PARTITION BY request_id ORDER BY tier_ord) AS INT) AS attempt_no, model_id,
       CASE WHEN mode = 'economy' THEN 'economy_skips_verification' ELSE rule0 END AS verification_rule,
       verify AS verification_performed,
       CASE WHEN verify THEN j_passed END AS verification_passed,
       CASE WHEN verify THEN j_score END AS verification_score,
       CASE WHEN verify THEN j_parse_error END AS verification_error,
       input_tokens, output_tokens, thinking_tokens, generation_latency_ms,
       CASE WHEN verify THEN judge_latency_ms ELSE 0.0 END AS verification_latency_ms,
       generation_cost_usd,
       CASE WHEN verify THEN judge_cost_usd ELSE 0.0 END AS verification_cost_usd,
       generation_cost_usd + CASE WHEN verify THEN judge_cost_usd ELSE 0.0 END AS total_attempt_cost_usd,
       generation_latency_ms + CASE WHEN verify THEN judge_latency_ms ELSE 0.0 END AS attempt_latency_ms
FROM att a
WHERE NOT EXISTS (SELECT 1 FROM att b WHERE b.request_id = a.request_id AND b.tier_ord < a.tier_ord AND b.stop)"""


def _osum(col: str) -> str:
    return " + ".join(f"COALESCE(SUM(CASE WHEN tier_ord = {k} THEN {col} END), 0.0)" for k in (1, 2, 3))


# every routed request, with what its last attempt says
FOLD = f"""
SELECT r.request_id, r.created_at, r.mode, r.category, r.initial_tier,
       last.tier AS final_tier, last.model_id,
       last.verification_performed, last.verification_passed, last.verification_score, last.verification_error,
       last.tier <> r.initial_tier AS escalated,
       CAST(COALESCE(s.n, 0) AS INT) AS attempt_count,
       CAST(COALESCE(s.input_tokens, 0) AS BIGINT) AS input_tokens,
       CAST(COALESCE(s.output_tokens, 0) AS BIGINT) AS output_tokens,
       CAST(COALESCE(s.thinking_tokens, 0) AS BIGINT) AS thinking_tokens,
       COALESCE(s.cost, 0.0) AS total_cost_usd, COALESCE(s.lat, 0.0) AS total_latency_ms, s.any_verified,
       CASE WHEN s.n IS NULL THEN 'unsettled' ELSE 'settled' END AS status
FROM routed r
LEFT JOIN (SELECT request_id, COUNT(*) AS n, SUM(input_tokens) AS input_tokens, SUM(output_tokens) AS output_tokens,
                  SUM(thinking_tokens) AS thinking_tokens, {_osum('total_attempt_cost_usd')} AS cost,
                  {_osum('attempt_latency_ms')} AS lat, bool_or(verification_performed) AS any_verified
           FROM settled GROUP BY request_id) s ON s.request_id = r.request_id
LEFT JOIN settled last ON last.request_id = r.request_id AND last.attempt_no = s.n"""

FOLDED_ALL = ("folded_all", FOLD)
SETTLE_CTES = [("routed", ROUTED), ("costed", COSTED), ("att", ATT), ("settled", SETTLED),
               FOLDED_ALL, ("folded", "SELECT * FROM folded_all WHERE status = 'settled'")]

# autopilot: the balanced chain, whatever the request's mode
REPLAY = f"""
WITH judged AS (
  SELECT c.*, r.category, r.initial_tier, r.initial_ord, j_score AS q_score, COALESCE(j_passed, FALSE) AS q_passed,
         c.tier <> 'tier_3' AND (c.tier_ord > r.initial_ord OR r.initial_score < CAST(0.9 AS DOUBLE)) AS verify
  FROM (SELECT *, {judge_sql('judge_text')} FROM costed) c JOIN routed r ON r.request_id = c.request_id),
chain AS (
  SELECT * FROM judged a WHERE tier_ord >= initial_ord AND NOT EXISTS (
    SELECT 1 FROM judged b WHERE b.request_id = a.request_id AND b.tier_ord >= b.initial_ord
                             AND b.tier_ord < a.tier_ord AND (NOT b.verify OR b.q_passed))),
ap AS (
  SELECT request_id, MAX(tier_ord) AS last_ord, CAST(COUNT(*) AS INT) AS n, bool_or(verify) AS verified,
         {_osum("generation_cost_usd + CASE WHEN verify THEN judge_cost_usd ELSE 0.0 END")} AS cost,
         {_osum("generation_latency_ms + CASE WHEN verify THEN judge_latency_ms ELSE 0.0 END")} AS lat
  FROM chain GROUP BY request_id)
SELECT request_id AS prompt_id, category, 'always_tier_3' AS strategy, 'tier_3' AS initial_tier, 'tier_3' AS final_tier,
       FALSE AS verification_performed, FALSE AS escalated, CAST(1 AS INT) AS attempt_count,
       generation_cost_usd AS strategy_cost_usd, generation_latency_ms AS strategy_latency_ms,
       q_passed AS quality_passed, q_score AS quality_score, tier_ord AS final_ord, judge_text
FROM judged WHERE tier_ord = 3
UNION ALL
SELECT request_id, category, 'ml_only', initial_tier, initial_tier, FALSE, FALSE, 1,
       generation_cost_usd, generation_latency_ms, q_passed, q_score, tier_ord, judge_text
FROM judged WHERE tier_ord = initial_ord
UNION ALL
SELECT c.request_id, category, 'autopilot', initial_tier, tier, verified, tier <> initial_tier, n, cost, lat,
       q_passed, q_score, tier_ord, judge_text
FROM chain c JOIN ap ON ap.request_id = c.request_id AND ap.last_ord = c.tier_ord"""

REPLAY_CTES = [("routed", ROUTED), ("costed", COSTED), ("replay", REPLAY)]
