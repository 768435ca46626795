"""Sinks and their readers: labelled splits, the usage log, benchmark tables.

All writes are Spark job commits (task output is discarded on task retry
and committed once), and every id used for de-duplication is
deterministic, so a job that loses executors and retries tasks writes the
same rows.
"""
from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierflow.session import materialize

# A4: the usage log, one row per request (17 columns of the reference table
# plus the any-attempt verification flag), in folders by a hash of the id.
USAGE_LOG_SCHEMA = T.StructType([
    T.StructField("request_id", T.StringType(), False),
    T.StructField("created_at", T.TimestampNTZType(), True),
    T.StructField("mode", T.StringType(), True),
    T.StructField("initial_tier", T.StringType(), True),
    T.StructField("final_tier", T.StringType(), True),
    T.StructField("model_id", T.StringType(), True),
    T.StructField("routing_scores", T.MapType(T.StringType(), T.DoubleType()), True),
    T.StructField("verification_performed", T.BooleanType(), True),
    T.StructField("verification_passed", T.BooleanType(), True),
    T.StructField("verification_score", T.DoubleType(), True),
    T.StructField("escalated", T.BooleanType(), True),
    T.StructField("attempt_count", T.IntegerType(), True),
    T.StructField("input_tokens", T.LongType(), True),
    T.StructField("output_tokens", T.LongType(), True),
    T.StructField("thinking_tokens", T.LongType(), True),
    T.StructField("total_cost_usd", T.DoubleType(), True),
    T.StructField("total_latency_ms", T.DoubleType(), True),
    T.StructField("any_verified", T.BooleanType(), True),
])
LOG_COLUMNS = [f.name for f in USAGE_LOG_SCHEMA.fields]


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


# --------------------------------------------------------------------------
# A2 labelled splits
# --------------------------------------------------------------------------
def write_labelled(labelled: DataFrame, path: str) -> None:
    """One folder per split; re-writing a split replaces only that split."""
    (labelled.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("split").parquet(path))


def read_labelled(spark: SparkSession, path: str, need_prompt: bool = False) -> DataFrame:
    from tierflow.operators.labels import complete_rows
    return complete_rows(spark.read.parquet(path), need_prompt)


def write_labelled_csv(labelled: DataFrame, path: str, columns: list[str]) -> None:
    """A2 as CSV: one folder a split, every value in quotes (doubled inside), a header
    in each file; texts keep their newlines and outer spaces, nulls are empty."""
    (labelled.select(*columns, "split").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .partitionBy("split").csv(path))


# --------------------------------------------------------------------------
# A4-A6, D8 usage log
# --------------------------------------------------------------------------
#: The log is dealt into folders by a hash of the request id. Beside it lies a
#: sketch of its ids, a Bloom filter for each bucket whose bits for an id all lie in one
#: 64-bit word, kept as rows (bucket, word, bits) of the words that are not zero, so
#: that an id is looked up as one row, and filters of several appends
#: are joined by bit_or. More ids than it is sized for only cost more looks at the log.
BUCKETS = 16
SKETCH_KEYS, BITS_A_KEY, HASHES = 1 << 20, 10, 7
SKETCH_SCHEMA = "bucket int, word bigint, bits bigint"
BROADCAST_IDS = 1 << 20


def create_usage_log(spark: SparkSession, path: str) -> None:
    """Create the (empty) log if it is absent."""
    if not _exists(spark, path):
        empty = spark.createDataFrame([], USAGE_LOG_SCHEMA).withColumn("bucket", bucket_of("request_id"))
        empty.write.mode("ignore").partitionBy("bucket").parquet(path)


def bucket_of(request_id: str) -> Column:
    return F.pmod(F.xxhash64(request_id), F.lit(BUCKETS).cast("bigint")).cast("int")


def _keys_path(path: str) -> str:
    return path.rstrip("/") + "-words"


def _marks(ids: DataFrame) -> DataFrame:
    """request_id, bucket, word, mask: the bits that stand for each id in its bucket's filter."""
    words = max(1, SKETCH_KEYS * BITS_A_KEY // 64)
    word = F.pmod(F.xxhash64(F.lit(0), "request_id"), F.lit(words).cast("bigint"))
    bits = [F.expr(f"shiftleft(1L, CAST(shiftright(__h, {6 * i}) & 63 AS INT))") for i in range(HASHES)]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return ids.select("request_id", F.xxhash64(F.lit(1), "request_id").alias("__h")).select(
        "request_id", bucket_of("request_id").alias("bucket"), word.alias("word"), mask.alias("mask"))


def add_to_sketch(spark: SparkSession, ids: DataFrame, path: str) -> None:
    """Enter ids (request_id) into the sketch of the log at ``path``. An id that is
    then not logged does no harm, so this comes before the log is written."""
    words = _marks(ids).groupBy("bucket", "word").agg(F.bit_or("mask").alias("bits"))
    words.write.mode("append").partitionBy("bucket").parquet(_keys_path(path))


def known_ids(spark: SparkSession, ids: DataFrame, path: str) -> DataFrame:
    """Those of ids (request_id) that the log at ``path`` holds. The sketch says which
    may be there and in which buckets; only the id column of those buckets is
    read, against the few ids in question, which are broadcast if they are no more
    than ``BROADCAST_IDS``."""
    if not _exists(spark, _keys_path(path)):
        if not _exists(spark, path.rstrip("/") + "-keys"):
            return ids.select("request_id").limit(0)
        add_to_sketch(spark, read_usage_log(spark, path), path)  # the log has a sketch of the former kind
    sketch = spark.read.schema(SKETCH_SCHEMA).parquet(_keys_path(path))
    words = sketch.groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))
    maybe = (_marks(ids).join(words, ["bucket", "word"]).where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
             .select("request_id", "bucket"))
    maybe = materialize(maybe, "log-maybe")
    per_bucket = {r["bucket"]: r["n"] for r in maybe.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    asked = maybe.select("request_id")
    if sum(per_bucket.values()) <= BROADCAST_IDS:
        asked = F.broadcast(asked)
    log = _log_with_parts(spark, path).where(F.col("bucket").isin(*per_bucket) if per_bucket else F.lit(False))
    return log.select("request_id").join(asked, "request_id", "left_semi")


def _log_with_parts(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType(USAGE_LOG_SCHEMA.fields + [T.StructField("bucket", T.IntegerType())])
    return spark.read.schema(schema).parquet(path)


def read_usage_log(spark: SparkSession, path: str) -> DataFrame:
    return _log_with_parts(spark, path).drop("bucket")


GENERATED = "gen-"


def with_ids(rows: DataFrame, batch_id: str | None = None) -> DataFrame:
    """A row without an id gets one of its own (equal rows get different ones):
    random, or, with a ``batch_id``, made of it and the row's place, so that a
    batch that is sent again brings the same ids. Write the result before it is used twice."""
    own = F.expr("uuid()") if batch_id is None else F.concat_ws(
        "-", F.lit(batch_id), F.row_number().over(Window.partitionBy("request_id", "__h").orderBy(F.lit(0))), F.col("__h"))
    if batch_id is not None:
        rows = rows.withColumn("__h", F.xxhash64(*[c for c, t in rows.dtypes if not t.startswith("map")]))
    return rows.withColumn("request_id", F.coalesce(F.col("request_id"), F.concat(F.lit(GENERATED), own))).drop("__h")


def first_per_id(df: DataFrame, time: str) -> DataFrame:
    """The first row of each id: earliest time (nulls last), then content.  A
    row-number-1 filter, so each map task ships at most one row per id."""
    content = F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")])
    w = Window.partitionBy("request_id").orderBy(F.col(time).asc_nulls_last(), "__h")
    return (df.withColumn("__h", content).withColumn("__r", F.row_number().over(w))
            .where(F.col("__r") == 1).drop("__h", "__r"))


def append_log(spark: SparkSession, rows: DataFrame, path: str, batch_id: str | None = None) -> DataFrame:
    """Append request rows; return the rejects as (request_id, rejected_rows, reason).

    * a row without an id gets a fresh one and is never a duplicate, unless its
      batch, named by ``batch_id``, is appended again after a failure;
    * within the batch the first row per id is kept (see ``first_per_id``);
    * an id that the log has is rejected with all its rows. The log itself isn't
      shuffled, and of its buckets only those are opened whose sketch may hold
      an id of the batch (see ``known_ids``).
    """
    create_usage_log(spark, path)
    batch = materialize(with_ids(rows.select(*[c for c in LOG_COLUMNS if c in rows.columns]), batch_id), "log-batch")
    ids = materialize(batch.groupBy("request_id").agg(F.count(F.lit(1)).alias("n")), "log-ids")
    # written before the log changes under the join
    known = materialize(known_ids(spark, ids, path).distinct(), "log-known").withColumn("known", F.lit(True))
    ids = ids.join(known, "request_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    new = ids.where(~F.col("known")).select("request_id")
    add_to_sketch(spark, new, path)
    # written, as the range partitioning, the log and the days each read it
    fresh = materialize(first_per_id(batch, "created_at").join(new, "request_id", "left_semi"), "log-fresh")
    # range-partition on (bucket, time, id): each task writes few files, in order of time, and
    # no folder lands in one task because it is hot
    out = fresh.withColumn("bucket", bucket_of("request_id"))
    (out.repartitionByRange("bucket", "created_at", "request_id").sortWithinPartitions("bucket", "created_at")
     .write.mode("append").partitionBy("bucket").parquet(path))
    rejected = F.when(F.col("known"), F.col("n")).otherwise(F.col("n") - 1)
    reason = F.when(F.col("known"), "duplicate_request_id").otherwise("duplicate_in_batch")
    # after the log, so that the counts never say more than is there
    (fresh.groupBy(F.col("created_at").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
     .coalesce(1).write.mode("append").parquet(_days_path(path)))  # a row a day
    return ids.select("request_id", rejected.alias("rejected_rows"), reason.alias("reject_reason")) \
        .where(F.col("rejected_rows") > 0)


def _days_path(path: str) -> str:
    return path.rstrip("/") + "-days"


def newest_rows(spark: SparkSession, path: str, k: int) -> DataFrame:
    """Rows of the log at ``path`` among which the ``k`` newest are (all, if it has fewer).

    The counts a day beside the log tell the latest day from which on there are ``k``
    rows; the scan is cut there, and as the log's files are in order of time, those
    of earlier days are skipped by their statistics. Counts that a crash left out only move the day back.
    """
    log = read_usage_log(spark, path)
    if not _exists(spark, _days_path(path)):
        return log
    per_day = spark.read.schema("day date, n bigint").parquet(_days_path(path)).where(F.col("day").isNotNull())
    # at most k days can be needed, as each has a row or more
    days = per_day.groupBy("day").agg(F.sum("n").alias("n")).orderBy(F.col("day").desc()).limit(k).collect()
    have = 0
    for r in days:
        have += r["n"]
        if have >= k:
            return log.where(F.col("created_at") >= F.lit(r["day"]).cast("timestamp_ntz"))
    return log


# --------------------------------------------------------------------------
# A7 / A8 strategy benchmark
# --------------------------------------------------------------------------
#: The benchmark is dealt into buckets by a hash of the prompt. A write makes anew the
#: buckets that it has rows for, old rows that it doesn't replace included, in a
#: folder of its own, which counts once Spark has marked it complete. Readers take each
#: bucket from the latest folder that has it; outdated forms are then deleted.
BENCHMARK_BUCKETS = 16
BENCHMARK_KEY = ["prompt_id", "strategy"]


def _children(spark: SparkSession, path: str, prefix: str) -> list[str]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(n for n in names if n.startswith(prefix))


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def benchmark_folders(spark: SparkSession, path: str) -> tuple[dict[str, str], list[str]]:
    """The folder of each bucket's latest complete form, and those that are outdated."""
    latest, old = {}, []
    for version in _children(spark, path, "version="):
        if _exists(spark, f"{path}/{version}/_SUCCESS"):
            for bucket in _children(spark, f"{path}/{version}", "bucket="):
                if bucket in latest:
                    old.append(latest[bucket])
                latest[bucket] = f"{path}/{version}/{bucket}"
    return latest, old


def write_benchmark(df: DataFrame, path: str) -> None:
    """Enter rows, one for each prompt and strategy; each replaces the earlier one of its key.

    Only the buckets of prompts in ``df`` are read and written. A write that died
    midway leaves nothing that counts (the next one deletes it) and may be sent again,
    as may one that went through. One writer at a time.
    """
    spark = df.sparkSession
    versions = _children(spark, path, "version=")
    for v in versions:
        if not _exists(spark, f"{path}/{v}/_SUCCESS"):
            delete(spark, f"{path}/{v}")
    bucket = F.pmod(F.xxhash64("prompt_id"), F.lit(BENCHMARK_BUCKETS).cast("bigint")).cast("int")
    rows = materialize(df.withColumn("bucket", bucket), "benchmark-rows")
    touched = {f"bucket={r[0]}" for r in rows.select("bucket").distinct().collect()}  # at most BENCHMARK_BUCKETS
    latest, _ = benchmark_folders(spark, path)
    before = [folder for b, folder in latest.items() if b in touched]
    out = rows
    if before:
        stay = (spark.read.option("basePath", path).parquet(*before).drop("version")
                .join(rows.select(*BENCHMARK_KEY), BENCHMARK_KEY, "left_anti"))
        out = rows.unionByName(stay, allowMissingColumns=True)
    number = max([int(v.split("=")[1]) for v in versions], default=0) + 1
    # range-partitioned, so that a hot bucket isn't one task
    (out.repartitionByRange("bucket", *BENCHMARK_KEY).write.partitionBy("bucket")
     .parquet(f"{path}/version={number:09d}"))
    for folder in benchmark_folders(spark, path)[1]:
        delete(spark, folder)


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """The one row of each (prompt, strategy); fails if missing or empty."""
    if not _exists(spark, path):
        raise FileNotFoundError(f"benchmark table not found: {path}")
    folders = sorted(benchmark_folders(spark, path)[0].values())
    df = spark.read.option("basePath", path).parquet(*folders).drop("version", "bucket") if folders else None
    if df is None or df.limit(1).count() == 0:
        raise ValueError("benchmark table is empty")
    return df


def benchmark_to_do(work: DataFrame, path: str) -> DataFrame:
    """Rows of ``work`` (with prompt_id and strategy) that the benchmark lacks: where a
    run that was broken off goes on. Reads the two key columns only."""
    spark = work.sparkSession
    folders = sorted(benchmark_folders(spark, path)[0].values())
    if not folders:
        return work
    done = spark.read.option("basePath", path).parquet(*folders).select(*BENCHMARK_KEY)
    return work.join(done, BENCHMARK_KEY, "left_anti")


# --------------------------------------------------------------------------
# A9 model benchmark (failures kept as rows)
# --------------------------------------------------------------------------
MODEL_BENCH_SCHEMA = T.StructType([
    T.StructField("prompt_id", T.StringType()), T.StructField("expected_complexity", T.StringType()),
    T.StructField("prompt", T.StringType()), T.StructField("model", T.StringType()),
    T.StructField("input_tokens", T.LongType()), T.StructField("output_tokens", T.LongType()),
    T.StructField("thinking_tokens", T.LongType()), T.StructField("latency_ms", T.DoubleType()),
    T.StructField("estimated_cost_usd", T.DoubleType()), T.StructField("response", T.StringType()),
    T.StructField("success", T.BooleanType()), T.StructField("error", T.StringType()),
])


def append_model_benchmark(df: DataFrame, path: str) -> None:
    """Append result rows; a failed call is a row with zero counts and its error."""
    cols = []
    for f in MODEL_BENCH_SCHEMA.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        if f.name in ("input_tokens", "output_tokens", "thinking_tokens"):
            c = F.coalesce(c.cast(f.dataType), F.lit(0).cast(f.dataType))
        elif f.name in ("latency_ms", "estimated_cost_usd"):
            c = F.coalesce(c.cast(f.dataType), F.lit(0.0))
        elif f.name == "success":
            c = F.coalesce(c.cast("boolean"), F.col("error").isNull() if "error" in df.columns else F.lit(True))
        cols.append(c.cast(f.dataType).alias(f.name))
    df.select(*cols).write.mode("append").parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    import uuid

    from tierflow.session import checkpoint_path
    return checkpoint_path(spark, os.path.join("tables", f"{name}-{uuid.uuid4().hex}"))
