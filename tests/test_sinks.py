"""Sinks and readers: labelled CSV, usage log keys, benchmark runs, model benchmark."""
import datetime as dt
import os
import re

import pytest
from pyspark.sql import functions as F

from tierflow.functions.routing import scores_from_json, scores_to_json
from tierflow.functions.text import gate
from tierflow.operators.labels import read_labelled_csv
from tierflow.sources import sinks as K


def test_labelled_csv_quoted_newlines_and_null_tokens(spark, tmp_path):
    p = tmp_path / "split.csv"
    p.write_text(
        "key,source_dataset,dataset_level,prompt,routing_label,tier_1_score,tier_2_score,tier_3_score\n"
        '1,a,x,"line one\nline ""two""",tier_1,0.9,0.9,0.9\n'
        "2,a,x,NA,tier_2,0.1,0.9,0.9\n"
        "3,a,x,ok,tier_3,,0.5,0.9\n"
        "4,a,x,ok,tier_3,#N/A,0.5,0.9\n"
        "5,a,x,ok,tier_3,-nan,0.5,0.9\n"
        "6,#NA,x,ok,1.#IND,0.5,0.5,0.9\n", encoding="utf-8")
    analysis = {r["key"]: r for r in read_labelled_csv(spark, str(p)).collect()}
    assert set(analysis) == {"1", "2", "6"}                  # rows 3 to 5 lack a score
    assert analysis["6"]["source_dataset"] is None and analysis["6"]["routing_label"] is None
    assert analysis["1"]["prompt"] == 'line one\nline "two"'
    training = {r["key"] for r in read_labelled_csv(spark, str(p), need_prompt=True).collect()}
    assert training == {"1", "6"}                             # 'NA' prompt is missing


def _log_rows(spark, ids):
    schema = ("request_id string, created_at timestamp_ntz, mode string, final_tier string, "
              "attempt_count int, total_cost_usd double")
    return spark.createDataFrame(
        [(i, dt.datetime(2024, 1, 1 + n % 3), "balanced", "tier_1", 1, 0.1) for n, i in enumerate(ids)],
        schema)


def test_append_log_primary_key(spark):
    path = K.scratch_path(spark, "log-test")
    r1 = K.append_log(spark, _log_rows(spark, ["a", "b", "b", None, None, None]), path)
    assert [(r["request_id"], r["rejected_rows"], r["reject_reason"]) for r in r1.collect()] == [("b", 1, "duplicate_in_batch")]
    r2 = K.append_log(spark, _log_rows(spark, ["b", "b", "c", None]), path)
    assert [(r["request_id"], r["rejected_rows"], r["reject_reason"]) for r in r2.collect()] == [("b", 2, "duplicate_request_id")]
    ids = [r["request_id"] for r in K.read_usage_log(spark, path).collect()]
    assert len(ids) == len(set(ids)) == 7 and {"a", "b", "c"} <= set(ids)
    assert sum(x.startswith(K.GENERATED) for x in ids) == 4  # equal rows without an id stay apart


def test_append_log_keeps_the_earliest(spark):
    path = K.scratch_path(spark, "log-test")
    K.append_log(spark, _log_rows(spark, ["x", "x", "x"]).orderBy(F.col("created_at").desc()), path)
    assert K.read_usage_log(spark, path).first()["created_at"] == dt.datetime(2024, 1, 1)


def test_append_opens_only_buckets_in_question(spark):
    """The log is pruned to the buckets that may hold an id of the batch, and never shuffled."""
    path = K.scratch_path(spark, "log-test")
    K.append_log(spark, _log_rows(spark, [f"r{i}" for i in range(500)]), path)
    probe = spark.createDataFrame([(f"r{i}",) for i in (3, 4)] + [(f"new{i}",) for i in range(200)], "request_id string")
    found = K.known_ids(spark, probe, path)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["request_id"] for r in found.collect()) == ["r3", "r4"]
    assert "ShuffleExchange" not in plan and "BroadcastHashJoin" in plan and "PartitionFilters: [bucket" in plan
    filters = re.search(r"PartitionFilters: \[(.*?)\]", plan)[1]
    opened = re.findall(r"\bIN \(([\d,]+)\)|bucket#\d+ = (\d+)", filters)
    assert 1 <= len(",".join(x for pair in opened for x in pair if x).split(",")) <= 4
    assert K.known_ids(spark, spark.createDataFrame([], "request_id string"), path).count() == 0


def test_batch_sent_again_adds_nothing(spark):
    """A batch with a name may be appended again after a failure, rows without id included."""
    path = K.scratch_path(spark, "log-test")
    rows = _log_rows(spark, ["a", None, None, "b", None])
    K.append_log(spark, rows, path, batch_id="2024-01-01")
    again = K.append_log(spark, rows.repartition(3), path, batch_id="2024-01-01").collect()
    assert sum(r["rejected_rows"] for r in again) == 5 and {r["reject_reason"] for r in again} == {"duplicate_request_id"}
    assert K.read_usage_log(spark, path).count() == 5
    K.append_log(spark, rows, path, batch_id="2024-01-02")
    assert K.read_usage_log(spark, path).count() == 8


def test_sketch_never_misses_an_id(spark, monkeypatch):
    """Filters that are far too small only open more buckets."""
    monkeypatch.setattr(K, "SKETCH_KEYS", 8)
    path = K.scratch_path(spark, "log-test")
    K.append_log(spark, _log_rows(spark, [f"r{i}" for i in range(300)]), path)
    K.append_log(spark, _log_rows(spark, [f"r{i}" for i in range(200, 400)]), path)
    assert sorted(r["request_id"] for r in K.read_usage_log(spark, path).collect()) == sorted(f"r{i}" for i in range(400))


def test_benchmark_reader_fails_when_missing_or_empty(spark):
    with pytest.raises(FileNotFoundError):
        K.read_benchmark(spark, K.scratch_path(spark, "absent"))
    path = K.scratch_path(spark, "empty-bench")
    schema = "prompt_id string, strategy string, strategy_cost_usd double"
    K.write_benchmark(spark.createDataFrame([], schema), path)
    with pytest.raises(ValueError, match="benchmark table is empty"):
        K.read_benchmark(spark, path)


def test_benchmark_rerun_rewrites_only_its_buckets(spark):
    """A row replaces the earlier one of its key, other buckets keep their files, what is
    outdated goes, a write that died midway doesn't count, and the rest of a list is found."""
    path = K.scratch_path(spark, "bench")
    rows = lambda ids, c: spark.createDataFrame([(i, s, c) for i in ids for s in ("ml_only", "autopilot")],
                                                "prompt_id string, strategy string, strategy_cost_usd double")
    ids = [f"p{i}" for i in range(40)]
    K.write_benchmark(rows(ids[:30], 1.0), path)
    first, old = K.benchmark_folders(spark, path)
    assert len(first) > 4 and not old
    K.write_benchmark(rows(["p7"], 2.0).where(F.col("strategy") == "ml_only"), path)
    second, old = K.benchmark_folders(spark, path)
    assert len([b for b in first if second[b] != first[b]]) == 1 and not old
    want = {(i, s): 1.0 for i in ids[:30] for s in ("ml_only", "autopilot")} | {("p7", "ml_only"): 2.0}
    have = lambda: {(r["prompt_id"], r["strategy"]): r["strategy_cost_usd"] for r in K.read_benchmark(spark, path).collect()}
    assert have() == want and K.read_benchmark(spark, path).count() == len(want)
    # died midway: files without the mark of completion
    rows(["p1"], 9.0).withColumn("bucket", F.lit(0)).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false") \
        .partitionBy("bucket").parquet(f"{path}/version=000000099")
    assert have() == want
    todo = K.benchmark_to_do(rows(ids, 3.0), path)
    assert sorted({r["prompt_id"] for r in todo.collect()}) == sorted(ids[30:])
    K.write_benchmark(todo, path)
    K.write_benchmark(rows(ids[30:], 3.0), path)  # sent again
    assert have() == want | {(i, s): 3.0 for i in ids[30:] for s in ("ml_only", "autopilot")}


def test_newest_rows_read_the_days_they_need(spark):
    """The scan is cut at the latest day with enough rows; rows without a
    time are read only where the dated ones don't suffice."""
    path = K.scratch_path(spark, "recent_log")
    rows = spark.sql("""SELECT CONCAT('r', id) AS request_id, CASE WHEN id % 10 <> 9 THEN
        TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(CAST(id % 30 AS INT)) END AS created_at FROM range(300)""")
    K.append_log(spark, rows, path)
    cut = K.newest_rows(spark, path, 15)
    assert "GreaterThanOrEqual(created_at" in cut._jdf.queryExecution().executedPlan().toString()
    assert cut.count() == 20 and cut.agg(F.min("created_at")).first()[0].day == 28  # 10 rows a day; the 30th, 20th and 10th have none
    assert K.newest_rows(spark, path, 271).count() == 300
    assert K.newest_rows(spark, path, 270).count() == 270
    K.append_log(spark, spark.sql("SELECT 'late' AS request_id, TIMESTAMP_NTZ'2024-03-01 00:00:00' AS created_at"), path)
    assert [r["request_id"] for r in K.newest_rows(spark, path, 1).collect()] == ["late"]


def test_model_benchmark_failure_rows(spark):
    path = K.scratch_path(spark, "model-bench")
    df = spark.createDataFrame([("p1", "m1", 10, 20, None, "ok", None), ("p1", "m2", None, None, None, None, "timeout")],
                               "prompt_id string, model string, input_tokens long, output_tokens long, "
                               "thinking_tokens long, response string, error string")
    K.append_model_benchmark(df, path)
    got = {r["model"]: r for r in spark.read.parquet(path).collect()}
    assert got["m1"]["success"] is True and got["m2"]["success"] is False
    assert got["m2"]["input_tokens"] == 0 and got["m2"]["error"] == "timeout"


def test_gate_split_and_scores_json(spark):
    df = spark.createDataFrame([("ok", "economy"), (" ", "economy"), ("ok", "x")], "prompt string, mode string")
    acc, rej = gate(df)
    assert acc.count() == 1
    assert sorted(r["reject_reason"] for r in rej.collect()) == ["blank_prompt", "unsupported_mode"]
    m = spark.createDataFrame([({"tier_1": 0.5, "tier_2": 0.25},)], "s map<string,double>")
    back = m.select(scores_from_json(scores_to_json("s")).alias("b")).first()["b"]
    assert back == {"tier_1": 0.5, "tier_2": 0.25}


def test_nested_corpus_json_roundtrip(spark):
    from tests.conftest import SF_SMALL
    from tierflow.operators import labels as L
    from tierflow.sources import views as V
    raw = V.routing_raw(spark, SF_SMALL, with_labels=False)
    corpus = L.nested_corpus(raw).withColumn("key", F.col("key").cast("string"))
    path = K.scratch_path(spark, "corpus-json")
    corpus.write.json(path)
    back = L.extract_scores(L.read_corpus(spark, path))
    direct = L.extract_scores(corpus)
    key = lambda r: r["key"]
    assert sorted(back.collect(), key=key) == sorted(direct.collect(), key=key)


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from tierflow import session

    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_an_id_is_one_row_of_the_sketch(spark):
    """An id is looked up as one row (not one for each of its bits), and a log whose
    sketch is of the former kind gets one."""
    ids = spark.createDataFrame([(f"r{i}",) for i in range(50)], "request_id string")
    marks = K._marks(ids).collect()
    assert len(marks) == 50 and all(1 <= bin(r["mask"] % (1 << 64)).count("1") <= K.HASHES for r in marks)
    path = K.scratch_path(spark, "log-test")
    K.create_usage_log(spark, path)
    rows = _log_rows(spark, ["a", "b"]).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in K.USAGE_LOG_SCHEMA.fields
                                                     if f.name not in _log_rows(spark, ["a"]).columns])
    rows.withColumn("bucket", K.bucket_of("request_id")).write.mode("append").partitionBy("bucket").parquet(path)
    spark.createDataFrame([(0, 1, 1)], "bucket int, word bigint, bits bigint").write.parquet(path + "-keys")
    found = K.known_ids(spark, spark.createDataFrame([("a",), ("c",)], "request_id string"), path)
    assert [r["request_id"] for r in found.collect()] == ["a"]
