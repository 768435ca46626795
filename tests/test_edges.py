"""Hand-made edge sets: text features, judge parsing, accept paths, report edges."""
import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tierflow.functions.judge import with_judge
from tierflow.functions.text import gate_columns
from tierflow.operators import reports as R
from tierflow.operators import settle as S
from tierflow.operators.text_model import prompt_features
from tierflow.sources.views import price

PAYMENT = ("Design a distributed payment platform. Explain how the database handles a race "
           "condition, and compare the latency trade-off.")
EDGE_PROMPTS = [
    (1, "What is Python?"),
    (2, "Explain authentication and authorization with examples."),
    (3, PAYMENT),
    (4, "Use a vector database for storage in the capital"),
    (5, "Café naïve x² éa a_b 3.14!? \n\t . ok"),
    (6, "..."),
    (7, "def f(): import os"),
    (8, "DEF F()"),
    (9, "  "),
    (10, ""),
    (11, "İstanbul ﬁne ½ x́y"),
    (12, "a. .b!\x1c?c"),
]


def _py_features(s: str) -> dict:
    """Independent statement of the feature rules in plain Python."""
    low = s.lower()
    reasoning = ["explain", "analyze", "compare", "evaluate", "design", "reason", "justify",
                 "debug", "optimize", "trade-off", "tradeoff", "architecture"]
    technical = ["api", "database", "redis", "docker", "kubernetes", "async", "fastapi", "python",
                 "algorithm", "distributed", "latency", "scalability", "race condition",
                 "vector database", "rag", "llm"]
    return {
        "word_count": len(re.findall(r"\w+", low)),
        "character_count": len(s),
        "sentence_count": len([p for p in re.split(r"[.!?]+", s) if p.strip()]),
        "question_count": s.count("?"),
        "newline_count": s.count("\n"),
        "reasoning_keyword_count": sum(k in low for k in reasoning),
        "technical_keyword_count": sum(k in low for k in technical),
        "has_code": int(any(m in s for m in ["```", "def ", "class ", "import "])),
    }


def test_prompt_features_edge_set(spark):
    df = spark.createDataFrame(EDGE_PROMPTS, "key long, prompt string")
    got = {r["key"]: r.asDict() for r in prompt_features(df).collect()}
    for k, text in EDGE_PROMPTS:
        exp = _py_features(text)
        row = {n: got[k][n] for n in exp}
        assert row == exp, (k, text, row, exp)


def test_feature_spot_values(spark):
    df = spark.createDataFrame(EDGE_PROMPTS, "key long, prompt string")
    got = {r["key"]: r for r in prompt_features(df).collect()}
    assert got[1]["technical_keyword_count"] == 1
    assert got[2]["reasoning_keyword_count"] == 1
    assert got[4]["technical_keyword_count"] == 4        # vector database, database, rag, api
    assert got[6]["word_count"] == 0 and got[6]["sentence_count"] == 0
    assert got[7]["has_code"] == 1 and got[8]["has_code"] == 0


def test_prompt_gate(spark):
    rows = [(1, "ok", "economy"), (2, "ok", " Balanced "), (3, "ok", None), (4, "ok", "turbo"),
            (5, "", "economy"), (6, "  \t", "economy"), (7, "x" * 20000, "economy"),
            (8, "x" * 20001, "economy"), (9, None, "economy")]
    df = spark.createDataFrame(rows, "key long, prompt string, mode string")
    cols = gate_columns(F.col("prompt"), F.col("mode"))
    got = {r["key"]: (r["accepted"], r["reject_reason"], r["clean_mode"])
           for r in df.select("key", *[c.alias(n) for n, c in cols.items()]).collect()}
    assert got[1] == (True, None, "economy")
    assert got[2] == (True, None, "balanced")
    assert got[3] == (True, None, "balanced")
    assert got[4][1] == "unsupported_mode"
    assert got[5][1] == "empty_prompt"
    assert got[6][1] == "blank_prompt"
    assert got[7][0] is True
    assert got[8][1] == "prompt_too_long"
    assert got[9][1] == "missing_prompt"


JUDGE_TEXTS = [
    (1, "verdict: pass\nscore: .85\nreason: ok\nmore", ("PASS", 0.85, "ok\nmore", True, None)),
    (2, "VERDICT: PASS\nSCORE: 0.79", ("PASS", 0.79, "No reason provided.", False, None)),
    (3, "VERDICT: FAIL\nSCORE: 0.95", ("FAIL", 0.95, "No reason provided.", False, None)),
    (4, "SCORE: 0.9", (None, None, None, None, "missing_verdict")),
    (5, "VERDICT: PASS", (None, None, None, None, "missing_score")),
    (6, "VERDICT: PASS\nSCORE: 1.5", (None, None, None, None, "score_out_of_range")),
    (7, "VERDICT: PASS\nSCORE: -0.5", (None, None, None, None, "missing_score")),
    (8, "VERDICT: MAYBE\nSCORE: 0.9", (None, None, None, None, "missing_verdict")),
    (9, "VERDICT: FAIL\nVERDICT: PASS\nSCORE: 0.9", ("FAIL", 0.9, "No reason provided.", False, None)),
    (10, "VERDICT:PASS SCORE:0.8 REASON:   ", ("PASS", 0.8, "", True, None)),
    (11, "VERDICT: PASS\nSCORE: 0.9 then SCORE: 0.1\nREASON: fine ", ("PASS", 0.9, "fine", True, None)),
    (12, None, (None, None, None, None, "missing_text")),
]


def test_judge_parse_edges(spark):
    df = spark.createDataFrame([(k, t) for k, t, _ in JUDGE_TEXTS], "k int, t string")
    out = with_judge(df, "t").collect()
    got = {r["k"]: (r["verdict"], r["score"], r["reason"], r["passed"], r["parse_error"]) for r in out}
    for k, _, exp in JUDGE_TEXTS:
        assert got[k] == exp, (k, got[k], exp)


# ---------------------------------------------------------------------------
# Settlement accept paths (accept score 0.90, thresholds .80 / .70)
# ---------------------------------------------------------------------------
def _judge(ok: bool) -> str:
    return f"VERDICT: {'PASS' if ok else 'FAIL'}\nSCORE: {'0.92' if ok else '0.40'}\nREASON: x"


PATHS = {
    # id: (mode, p1, p2, verdicts per tier 1..3, expected)
    "t1_confident": ("balanced", 0.95, 0.1, (True, True, True), (1, "tier_1", False, None, False, False)),
    "t1_pass": ("balanced", 0.85, 0.1, (True, True, True), (1, "tier_1", True, True, True, False)),
    "t1_fail_pass": ("balanced", 0.85, 0.1, (False, True, True), (2, "tier_2", True, True, True, True)),
    "t1_fail_fail": ("balanced", 0.85, 0.1, (False, False, True), (3, "tier_3", False, None, True, True)),
    "t2_confident": ("balanced", 0.5, 0.95, (False, True, True), (1, "tier_2", False, None, False, False)),
    "t2_pass": ("balanced", 0.5, 0.75, (False, True, True), (1, "tier_2", True, True, True, False)),
    "t2_fail": ("balanced", 0.5, 0.75, (True, False, True), (2, "tier_3", False, None, True, True)),
    "t3": ("balanced", 0.1, 0.1, (False, False, False), (1, "tier_3", False, None, False, False)),
    "economy": ("economy", 0.85, 0.1, (False, False, False), (1, "tier_1", False, None, False, False)),
}


def _fixture(spark):
    ts = dt.datetime(2024, 1, 1)
    req, cand = [], []
    for rid, (mode, p1, p2, verdicts, _) in PATHS.items():
        req.append((rid, ts, mode, "simple", p1, p2, 0.5))
        for k in (1, 2, 3):
            cand.append((rid, k, f"tier_{k}", 10, 100, 7 if k == 3 else 0, 500.0, 40.0, 300, 30,
                         _judge(verdicts[k - 1])))
    r = spark.createDataFrame(req, "request_id string, created_at timestamp, mode string, "
                                   "category string, tier_1_probability double, "
                                   "tier_2_probability double, tier_3_probability double")
    c = spark.createDataFrame(cand, "request_id string, tier_ord int, tier string, input_tokens long, "
                                    "output_tokens long, thinking_tokens long, "
                                    "generation_latency_ms double, judge_latency_ms double, "
                                    "judge_input_tokens long, judge_output_tokens long, "
                                    "judge_text string")
    return r, c


def test_accept_paths(spark):
    r, c = _fixture(spark)
    log = S.request_results(r, c, price(spark)).collect()
    got = {x["request_id"]: (x["attempt_count"], x["final_tier"], x["verification_performed"],
                             x["verification_passed"], x["any_verified"], x["escalated"]) for x in log}
    for rid, (*_, exp) in PATHS.items():
        assert got[rid] == exp, (rid, got[rid], exp)


def test_accept_path_cost(spark):
    r, c = _fixture(spark)
    log = {x["request_id"]: x for x in S.request_results(r, c, price(spark)).collect()}
    # unverified tier_1 answer: 10 input, 100 output tokens
    assert log["t1_confident"]["total_cost_usd"] == pytest.approx(10 / 1e6 * 0.25 + 100 / 1e6 * 1.50)
    # verified tier_1 answer adds one tier_3 judge call (300 in, 30 out) and its latency
    judge = 300 / 1e6 * 0.75 + 30 / 1e6 * 3.75
    assert log["t1_pass"]["total_cost_usd"] == pytest.approx(10 / 1e6 * 0.25 + 100 / 1e6 * 1.50 + judge)
    assert log["t1_pass"]["total_latency_ms"] == pytest.approx(540.0)
    # tier_3 bills thinking tokens as output
    assert log["t3"]["total_cost_usd"] == pytest.approx(10 / 1e6 * 0.75 + 107 / 1e6 * 3.75)


def test_no_request_is_lost(spark):
    """A chain that nothing stops ends with its last attempt; a request without a
    usable answer is unsettled; a reply that can't be parsed fails and is named."""
    r, c = _fixture(spark)
    c = c.where(~((F.col("request_id") == "t1_fail_fail") & (F.col("tier_ord") == 3))
                & ~F.col("request_id").isin("t3", "economy")
                & ~((F.col("request_id") == "t2_pass") & (F.col("tier_ord") == 2)))
    c = c.withColumn("judge_text", F.when((F.col("request_id") == "t1_pass") & (F.col("tier_ord") == 1),
                                          "SCORE: 0.9").otherwise(F.col("judge_text")))
    log = {x["request_id"]: x for x in S.request_results(r, c, price(spark)).collect()}
    assert set(log) == set(PATHS)
    last = log["t1_fail_fail"]
    assert (last["final_tier"], last["attempt_count"], last["verification_passed"], last["status"]) == \
        ("tier_2", 2, False, "settled")
    for rid in ("t3", "economy"):
        assert (log[rid]["status"], log[rid]["attempt_count"], log[rid]["total_cost_usd"]) == ("unsettled", 0, 0.0)
        assert log[rid]["final_tier"] is None
    assert log["t2_pass"]["final_tier"] == "tier_3"  # its own tier has no answer; the chain goes on
    assert log["t1_pass"]["final_tier"] == "tier_2"
    first = {(x["request_id"], x["tier"]): x for x in S.settle(S.route_requests(r), c, price(spark)).collect()}
    assert first["t1_pass", "tier_1"]["verification_error"] == "missing_verdict"
    rep = S.strategy_replay(r, c, price(spark)).collect()
    have = {(x["prompt_id"], x["strategy"]) for x in rep}
    assert ("t1_fail_fail", "always_tier_3") not in have and ("t1_fail_fail", "autopilot") in have
    assert all(x["final_tier"] and x["attempt_count"] for x in rep)
    prompts = r.select(F.col("request_id").alias("prompt_id"))
    miss = {x["prompt_id"]: x["missing"] for x in R.strategy_completeness(S.strategy_replay(r, c, price(spark)), prompts).collect()}
    assert miss["t3"] == "always_tier_3,autopilot,ml_only" and miss["t1_fail_fail"] == "always_tier_3"
    assert "t1_confident" not in miss


def test_zero_baseline(spark):
    rows = [(1, s, 0.0, 1.0, True, 0.9, False, False, 1) for s in ("always_tier_3", "ml_only")]
    bench = spark.createDataFrame(rows, "prompt_id long, strategy string, strategy_cost_usd double, "
                                        "strategy_latency_ms double, quality_passed boolean, quality_score double, "
                                        "verification_performed boolean, escalated boolean, attempt_count int")
    assert [x["cost_savings_vs_tier3"] for x in R.strategy_summary(bench).collect()] == [None, None]


def test_bad_accept_score_rejected():
    with pytest.raises(ValueError):
        S.verification_rule(F.col("tier"), F.lit(False), F.lit(0.5), accept=1.5)


# ---------------------------------------------------------------------------
# Report edges
# ---------------------------------------------------------------------------
LOG_SCHEMA = ("request_id string, created_at timestamp, mode string, initial_tier string, "
              "final_tier string, model_id string, verification_performed boolean, "
              "verification_passed boolean, verification_score double, escalated boolean, "
              "attempt_count int, input_tokens long, output_tokens long, thinking_tokens long, "
              "total_cost_usd double, total_latency_ms double, any_verified boolean")


def test_empty_log_gives_zeros(spark):
    empty = spark.createDataFrame([], LOG_SCHEMA)
    s = R.usage_summary(empty).collect()[0]
    assert s["total_requests"] == 0 and s["total_cost_usd"] == 0.0
    assert s["verification_rate"] == 0.0 and s["average_latency_ms"] == 0.0
    sv = R.savings_summary(empty, price(spark)).collect()[0]
    assert sv["estimated_savings_percentage"] == 0.0 and sv["average_actual_cost_usd"] == 0.0
    tu = {r["tier"]: (r["count"], r["percentage"]) for r in R.tier_usage(empty).collect()}
    assert tu == {"tier_1": (0, 0.0), "tier_2": (0, 0.0), "tier_3": (0, 0.0)}


def test_single_row_summary_and_savings_identity(spark):
    row = ("r1", dt.datetime(2024, 1, 1), "balanced", "tier_1", "tier_1", "model-small", False, None,
           None, False, 1, 10, 100, 0, 0.0001, 500.0, False)
    log = spark.createDataFrame([row], LOG_SCHEMA)
    s = R.usage_summary(log).collect()[0]
    assert s["total_requests"] == 1 and s["total_tokens"] == 110
    sv = R.savings_summary(log, price(spark)).collect()[0]
    base = 10 / 1e6 * 0.75 + 100 / 1e6 * 3.75
    assert sv["tier_3_equivalent_cost_usd"] == pytest.approx(base)
    assert sv["estimated_savings_usd"] == pytest.approx(base - 0.0001, abs=1e-12)


def test_unknown_tier_is_kept(spark):
    rows = [("r1", dt.datetime(2024, 1, 1), "balanced", "tier_1", "tier_9", "m", False, None, None,
             False, 1, 1, 1, 0, 0.0, 1.0, False)]
    tu = {r["tier"]: r["count"] for r in R.tier_usage(spark.createDataFrame(rows, LOG_SCHEMA)).collect()}
    assert tu == {"tier_1": 0, "tier_2": 0, "tier_3": 0, "tier_9": 1}


def test_recent_requests_limits(spark):
    empty = spark.createDataFrame([], LOG_SCHEMA)
    with pytest.raises(ValueError):
        R.recent_requests(empty, 0)
    rows = [(f"r{i:03d}", dt.datetime(2024, 1, 1 + i % 3), "balanced", "tier_1", "tier_1", "m", False,
             None, None, False, 1, 1, 1, 0, 0.0, 1.0, False) for i in range(150)]
    out = R.recent_requests(spark.createDataFrame(rows, LOG_SCHEMA), 500).collect()
    assert len(out) == 100
    assert out[0]["created_at"] == dt.datetime(2024, 1, 3) and out[0]["request_id"] == "r002"


def test_missing_baseline_fails(spark):
    rows = [(1, "simple", "ml_only", "tier_1", "tier_1", False, False, 1, 0.1, 1.0, True, 0.9)]
    bench = spark.createDataFrame(rows, "prompt_id long, category string, strategy string, "
                                        "initial_tier string, final_tier string, "
                                        "verification_performed boolean, escalated boolean, "
                                        "attempt_count int, strategy_cost_usd double, "
                                        "strategy_latency_ms double, quality_passed boolean, "
                                        "quality_score double")
    with pytest.raises(Exception, match="baseline was not found"):
        R.strategy_summary(bench).collect()


def test_bool_text_coercion(spark):
    df = spark.createDataFrame([("True",), ("false",), ("yes",), ("1",), (None,)], "x string")
    got = [r[0] for r in df.select(R.bool_text(F.col("x"))).collect()]
    assert got == [True, False, None, None, None]


def test_coerce_bool_columns_only_text(spark):
    df = spark.createDataFrame([("TRUE", True), ("no", False)], "quality_passed string, escalated boolean")
    out = R.coerce_bool_columns(df).collect()
    assert [r["quality_passed"] for r in out] == [True, None]
    assert [r["escalated"] for r in out] == [True, False]


def test_usage_reports_bundle(spark):
    r, c = _fixture(spark)
    log = S.request_results(r, c, price(spark))
    rep = R.usage_reports(log, price(spark))
    assert rep["summary"].first()["total_requests"] == len(PATHS)
    assert sum(x["count"] for x in rep["tier_usage"].collect()) == len(PATHS)
