"""Registered queries that exercise the sinks end to end (write, re-write, read)."""
from __future__ import annotations

from pyspark.sql import functions as F

from tierflow.functions.routing import report_round, scores_from_json, scores_to_json
from tierflow.operators import labels as L
from tierflow.operators import reports as R
from tierflow.plans import label_queries, settle_queries
from tierflow.plans.oracle_settle import SETTLE_CTES
from tierflow.sources import sinks as K
from tierflow.sources import views as V
from tierflow.session import materialize


def _planted_log(spark, sf):
    """The settled log, a later repeat of every 13th row, and two equal rows
    without an id for every 17th."""
    log = settle_queries.usage_log(spark, sf)
    rid = F.col("request_id").cast("bigint")
    # the log is settled once, and each row brings its copies
    kinds = F.array(F.lit("log"), F.when(rid % 13 == 0, "later"), *[F.when(rid % 17 == 0, "bare")] * 2)
    copies = log.withColumn("__kind", F.explode(kinds)).where(F.col("__kind").isNotNull())
    later = F.when(F.col("__kind") == "later", F.col("created_at") + F.expr("INTERVAL 10 DAYS")).otherwise(F.col("created_at"))
    rid = F.when(F.col("__kind") != "bare", F.col("request_id"))
    return copies.withColumns({"created_at": later, "request_id": rid}).drop("__kind")


def q_usage_log_appended(spark, sf):
    """A log with planted repeats and missing ids, appended twice.
    Ids that the log has are rejected; rows without an id are new each time
    (their generated id is shown as null).  Scores went through JSON (B25)."""
    path = K.scratch_path(spark, "usage_log")
    log = materialize(_planted_log(spark, sf), "usage-log-input")
    K.append_log(spark, log, path)
    K.append_log(spark, log, path)
    out = K.read_usage_log(spark, path)
    scores = scores_from_json(scores_to_json("routing_scores"))
    rid = F.when(~F.col("request_id").startswith(K.GENERATED), F.col("request_id"))
    return out.select(rid.alias("request_id"), *[c for c in settle_queries.LOG_OUT if c != "request_id"],
                      *[scores[f"tier_{k}"].alias(f"score_{k}") for k in (1, 2, 3)])


def q_usage_log_rejects(spark, sf):
    """What both appends reject, by reason."""
    path = K.scratch_path(spark, "usage_log")
    log = materialize(_planted_log(spark, sf), "usage-log-input")
    first = K.append_log(spark, log, path).withColumn("append", F.lit(1))
    second = K.append_log(spark, log, path).withColumn("append", F.lit(2))
    return first.unionByName(second).groupBy("append", "reject_reason").agg(
        F.count(F.lit(1)).alias("ids"), F.sum("rejected_rows").alias("rows"))


def q_labelled_split_written(spark, sf):
    """A2 / A3: labelled corpus written per split, read back with the training drop rule."""
    path = K.scratch_path(spark, "labelled")
    K.write_labelled(L.label_corpus(V.routing_raw(spark, sf, with_labels=False)).drop("quality", "toxic"), path)
    df = K.read_labelled(spark, path, need_prompt=True)
    return df.select("key", "source_dataset", "dataset_level", "prompt", "routing_label",
                     "tier_1_score", "tier_2_score", "tier_3_score", "split")


def q_labelled_split_csv(spark, sf):
    """A2 / A3 as CSV: the labelled corpus written a split a folder, its quoted newlines read
    back in many tasks, with the training drop rule (texts that mean missing are missing)."""
    path = K.scratch_path(spark, "labelled-csv")
    K.write_labelled_csv(L.label_corpus(V.routing_raw(spark, sf, with_labels=False)), path, L.CSV_COLUMNS)
    return L.read_labelled_csv(spark, path, need_prompt=True).withColumn("key", F.col("key").cast("bigint"))


def q_benchmark_roundtrip(spark, sf):
    """A strategy benchmark that was broken off after some prompts, goes on with
    what is still to do, and is run again for one strategy with other costs."""
    path = K.scratch_path(spark, "benchmark")
    b = materialize(settle_queries.replay(spark, sf), "benchmark-input")
    K.write_benchmark(b.where(F.col("prompt_id").cast("bigint") % 3 == 0), path)
    # were the rows that are there done again, their latency would tell
    K.write_benchmark(K.benchmark_to_do(b.withColumn("strategy_latency_ms", F.col("strategy_latency_ms") * 3), path), path)
    again = b.where(F.col("strategy") == "autopilot").withColumn("strategy_cost_usd", F.col("strategy_cost_usd") * 2)
    K.write_benchmark(again, path)
    return K.read_benchmark(spark, path).select(*b.columns)


def q_recent_from_log(spark, sf):
    """G1 on the stored log: its newest 50 rows, from the days that have them; appended in two lots."""
    path = K.scratch_path(spark, "usage_log")
    log = materialize(settle_queries.usage_log(spark, sf), "usage-log-input")
    even = F.col("request_id").cast("bigint") % 2 == 0
    K.append_log(spark, log.where(even), path)
    K.append_log(spark, log.where(~even), path)
    return R.recent_requests(K.newest_rows(spark, path, 50), 50).select(*settle_queries.LOG_OUT)


def q_model_benchmark(spark, sf):
    """Two appends of model results; a failed call (every 7th) is a row with
    zero counts and its error.  Read back per model and outcome."""
    path = K.scratch_path(spark, "model_benchmark")
    m = V.candidates(spark, sf).join(F.broadcast(V.price(spark).select("tier", "model_id")), "tier")
    failed = F.col("request_id").cast("bigint") % 7 == 0
    rows = m.select(F.col("request_id").alias("prompt_id"), F.col("model_id").alias("model"),
                    *[F.when(~failed, F.col(c)).alias(c) for c in ("input_tokens", "output_tokens", "thinking_tokens")],
                    F.when(~failed, F.col("generation_latency_ms")).alias("latency_ms"),
                    F.when(failed, "timeout").alias("error"))
    K.append_model_benchmark(rows.where(F.col("model") == "model-small"), path)
    K.append_model_benchmark(rows.where(F.col("model") != "model-small"), path)
    return spark.read.schema(K.MODEL_BENCH_SCHEMA).parquet(path).groupBy("model", "success", "error").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.sum("thinking_tokens").alias("thinking_tokens"),
        F.round(F.sum("latency_ms"), 3).alias("latency_ms"))


def q_corpus_scan(spark, sf):
    """A1: the nested corpus written as JSON, scanned with its explicit schema, scores extracted."""
    path = K.scratch_path(spark, "corpus")
    raw = V.routing_raw(spark, sf, with_labels=False).drop("quality", "toxic")
    L.nested_corpus(raw).withColumn("key", F.col("key").cast("string")).write.json(path)
    out = L.extract_scores(L.read_corpus(spark, path))
    return out.withColumn("key", F.col("key").cast("bigint"))


def q_corpus_rejects(spark, sf):
    """A1: a corpus with planted faults: of every 19th key a line that breaks off, of every
    23rd one whose model entry is a number. All are in the rejects with the reason,
    and the scan has the others only."""
    path, rejects = K.scratch_path(spark, "corpus"), K.scratch_path(spark, "corpus-rejects")
    raw = V.routing_raw(spark, sf, with_labels=False).drop("quality", "toxic")
    k = F.col("key")
    line = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) if c == "key" else F.col(c) for c in L.nested_corpus(raw).columns]))
    text = F.when(k % 19 == 0, F.concat(F.lit('{"key":"'), k, F.lit('","split":"'), "split")) \
        .when(k % 23 == 0, F.concat(F.lit('{"key":"'), k, F.lit('","model_small":7}'))).otherwise(line)
    L.nested_corpus(raw).select(text.alias("value")).write.text(path)
    rows = L.read_corpus(spark, path, rejects=rejects)
    kept = rows.select("key", F.lit(None).cast("string").alias("record"), F.lit("kept").alias("outcome"))
    lost = spark.read.parquet(rejects).select(F.lit(None).cast("string").alias("key"), "record", F.col("reason").alias("outcome"))
    return kept.unionByName(lost)


def q_bool_text(spark, sf):
    """Flags kept as text come back as booleans (other text is null),
    and report figures are rounded at the edge."""
    b = settle_queries.replay(spark, sf)
    pid = F.col("prompt_id").cast("bigint")
    text = F.when(pid % 5 == 0, "yes").when(F.col("quality_passed"), "True").otherwise("FALSE")
    back = R.coerce_bool_columns(b.withColumn("quality_passed", text))
    return back.groupBy("strategy", "quality_passed").agg(
        F.count(F.lit(1)).alias("n"), report_round(F.avg("strategy_cost_usd"), 6).alias("average_cost_usd"))


SPARK = {
    "usage_log_appended": q_usage_log_appended,
    "usage_log_rejects": q_usage_log_rejects,
    "labelled_split_written": q_labelled_split_written,
    "labelled_split_csv": q_labelled_split_csv,
    "benchmark_roundtrip": q_benchmark_roundtrip,
    "recent_from_log": q_recent_from_log,
    "model_benchmark": q_model_benchmark,
    "corpus_scan": q_corpus_scan,
    "corpus_rejects": q_corpus_rejects,
    "bool_text": q_bool_text,
}

_LOG = ", ".join(c for c in settle_queries.LOG_OUT if c != "request_id")
_SCORES = ", ".join(f"tier_{k}_probability AS score_{k}" for k in (1, 2, 3))

_MISSING = ", ".join(f"'{x}'" for x in L.MISSING_TEXTS)
_KNOWN = ", ".join(f"CASE WHEN {c} NOT IN ({_MISSING}) THEN {c} END AS {c}"
                   for c in ("source_dataset", "dataset_level", "prompt", "routing_label"))

ORACLE = {
    "usage_log_appended": (SETTLE_CTES, f"""
SELECT f.request_id, {_LOG}, {_SCORES} FROM (SELECT f.*, r.tier_1_probability, r.tier_2_probability, r.tier_3_probability
  FROM folded f JOIN requests r ON r.request_id = f.request_id) f
UNION ALL
SELECT NULL, {_LOG}, {_SCORES} FROM (SELECT f.*, r.tier_1_probability, r.tier_2_probability, r.tier_3_probability
  FROM folded f JOIN requests r ON r.request_id = f.request_id WHERE CAST(f.request_id AS BIGINT) % 17 = 0) f,
  (VALUES (1), (2), (3), (4)) AS copies(n)"""),
    "usage_log_rejects": (SETTLE_CTES, """
SELECT CAST(1 AS INT) AS append, 'duplicate_in_batch' AS reject_reason, COUNT(*) AS ids, CAST(COUNT(*) AS BIGINT) AS rows
FROM folded WHERE CAST(request_id AS BIGINT) % 13 = 0
UNION ALL
SELECT 2, 'duplicate_request_id', COUNT(*),
       CAST(SUM(CASE WHEN CAST(request_id AS BIGINT) % 13 = 0 THEN 2 ELSE 1 END) AS BIGINT) FROM folded"""),
    "labelled_split_written": label_queries.ORACLE["labelled_split_valid"],
    "labelled_split_csv": ([("valid", label_queries.ORACLE["labelled_split_valid"][1])], f"""
SELECT key, {_KNOWN}, tier_1_score, tier_2_score, tier_3_score FROM valid WHERE prompt NOT IN ({_MISSING})"""),
    "benchmark_roundtrip": (settle_queries.REPLAY_CTES, """
SELECT prompt_id, category, strategy, initial_tier, final_tier, verification_performed, escalated, attempt_count,
       strategy_cost_usd * CASE WHEN strategy = 'autopilot' THEN 2 ELSE 1 END AS strategy_cost_usd,
       strategy_latency_ms * CASE WHEN strategy <> 'autopilot' AND CAST(prompt_id AS BIGINT) % 3 <> 0 THEN 3 ELSE 1 END
         AS strategy_latency_ms, quality_passed, quality_score FROM replay"""),
    "recent_from_log": settle_queries.ORACLE["recent_requests"],
    "model_benchmark": ([], """
SELECT model_id AS model, NOT failed AS success, CASE WHEN failed THEN 'timeout' END AS error, COUNT(*) AS calls,
       CAST(SUM(CASE WHEN failed THEN 0 ELSE input_tokens END) AS BIGINT) AS input_tokens,
       CAST(SUM(CASE WHEN failed THEN 0 ELSE output_tokens END) AS BIGINT) AS output_tokens,
       CAST(SUM(CASE WHEN failed THEN 0 ELSE thinking_tokens END) AS BIGINT) AS thinking_tokens,
       ROUND(SUM(CASE WHEN failed THEN 0.0 ELSE generation_latency_ms END), 3) AS latency_ms
FROM (SELECT c.*, p.model_id, CAST(request_id AS BIGINT) % 7 = 0 AS failed
      FROM candidates c JOIN price p ON p.tier = c.tier) x GROUP BY 1, 2, 3"""),
    "corpus_scan": label_queries.ORACLE["score_extract"],
    "corpus_rejects": ([], """
SELECT CASE WHEN outcome = 'kept' THEN CAST(key AS VARCHAR) END AS key,
       CASE outcome WHEN 'malformed_json' THEN '{"key":"' || key || '","split":"' || split
                    WHEN 'unexpected_shape' THEN '{"key":"' || key || '","model_small":7}' END AS record, outcome
FROM (SELECT key, split, CASE WHEN key % 19 = 0 THEN 'malformed_json' WHEN key % 23 = 0 THEN 'unexpected_shape' ELSE 'kept' END AS outcome
      FROM routing_raw) x"""),
    "bool_text": (settle_queries.REPLAY_CTES, """
SELECT strategy, CASE WHEN CAST(prompt_id AS BIGINT) % 5 = 0 THEN NULL ELSE quality_passed END AS quality_passed,
       COUNT(*) AS n, ROUND(AVG(strategy_cost_usd), 6) AS average_cost_usd
FROM replay GROUP BY 1, 2"""),
}
