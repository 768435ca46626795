"""Structured Streaming: continuous usage-log ingest and a live summary.

S1 ingest:  file source of raw events -> usage rows -> one keyed state per request
            id in the state store (RocksDB, changelog checkpoints) -> log and
            rejects. The state tells for each id of a micro-batch whether an
            earlier one had it, however long ago, so a micro-batch costs its own
            rows and never reads the log. Of the rows of an id the first stays; the
            others are rejects, as are rows without a time. A row without an id
            gets one made of its file and place, the same in every replay. No
            watermark drops late rows. Each micro-batch is written to its own
            ``batch_id=<n>`` folder with overwrite, so a replay replaces itself.
S2 summary: follows the log's files with running sums per (day, mode, tier) in the state
            store, written as a new version of the groups that changed; old
            days are not read again. Files that a replay rewrites bring the same
            request ids, which a second keyed state drops, so they never count twice.

The batch's time, which Spark keeps in its offset log and reuses in a replay, marks
when an id was first and last seen. State and sinks grow with the ids, as a key
is one for ever. Checkpoints and sinks live under the shared folder named by
``spark.checkpoint.dir``; nothing uses a machine-local path on a cluster.
"""
from __future__ import annotations

import os
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierflow.operators.settle import verifier_price
from tierflow.session import checkpoint_path
from tierflow.sources.sinks import GENERATED, delete

LOG_SCHEMA = ("request_id string, created_at timestamp, event_time timestamp_ntz, mode string, final_tier string, "
              "input_tokens bigint, output_tokens bigint, total_latency_ms double, batch_id int, day string")
ROW = ("request_id", "created_at", "event_time", "mode", "final_tier", "input_tokens", "output_tokens", "total_latency_ms")
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def event_instant(ntz) -> F.Column:
    """The wall-clock event time read as a UTC instant, whatever the session
    zone: windows need a TIMESTAMP, and daily ones (aligned to UTC
    midnight) then fall on the wall-clock dates."""
    c = F.col(ntz) if isinstance(ntz, str) else ntz
    return F.make_timestamp(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.minute(c),
                            F.second(c), F.lit("UTC"))


def usage_rows(events: DataFrame, *more: str) -> DataFrame:
    """Raw events -> usage-log rows (same rules as the batch ``usage_events`` view).

    ``event_time`` keeps the original wall-clock value; ``created_at`` is its
    UTC instant for the windows. ``more`` names columns to carry along.
    """
    et = F.col("event_type")
    n = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    return events.select(
        F.col("event_id").cast("string").alias("request_id"),
        event_instant("ts").alias("created_at"),
        F.col("ts").alias("event_time"),
        F.when(et.isin("click", "view"), "economy").otherwise("balanced").alias("mode"),
        F.when(et.isin("click", "error"), "tier_1").when(et == "view", "tier_2")
        .otherwise("tier_3").alias("final_tier"),
        n.alias("input_tokens"),
        (n * 7).alias("output_tokens"),
        (F.col("value") * 10).alias("total_latency_ms"),
        *more,
    )


@contextmanager
def _state_store(spark: SparkSession):
    """The state store's settings, for queries started inside."""
    old = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def arrivals(source: DataFrame) -> DataFrame:
    """Stateful: each id that a micro-batch brings, with its first row (earliest batch,
    then earliest time, then content), how many rows it has had in all, and
    the times of the first and the last batch that had it.

    Repeats within a batch are counted before the exchange, so a hot id ships one
    row per map task. An undated row has a key of its own and claims no id.
    """
    place = F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string"))
    rows = usage_rows(source.select("*", F.md5(place).alias("place")), "place")
    own = F.concat(F.lit(GENERATED), F.col("place"))
    rows = rows.withColumn("request_id", F.coalesce("request_id", own))
    key = F.when(F.col("created_at").isNotNull(), F.col("request_id")).otherwise(own)
    order = F.struct("arrived", "created_at", F.xxhash64(*ROW))
    return (rows.select(key.alias("key"), F.struct(*ROW).alias("row"), *ROW, F.current_timestamp().alias("arrived"))
            .groupBy("key").agg(F.min_by("row", order).alias("row"), F.count(F.lit(1)).alias("n"),
                                F.min("arrived").alias("first_at"), F.max("arrived").alias("last_at")))


def _batch_writer(out: str, rejects: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # the state is asked once: what it answers is written, then both sinks are derived
        path = checkpoint_path(spark, f"tables/stream-batch-{uuid.uuid4().hex}")
        batch.write.parquet(path)
        seen = spark.read.parquet(path)
        new = F.col("first_at") == F.col("last_at")
        dated = F.col("row.created_at").isNotNull()
        day = F.date_format("event_time", "yyyy-MM-dd")
        (seen.where(new & dated).select("row.*").withColumn("day", day).repartitionByRange("day", "request_id")
         .write.mode("overwrite").partitionBy("day").parquet(f"{out}/batch_id={batch_id}"))
        undated = seen.where(~dated).select("row.*", F.lit(1).cast("bigint").alias("rows"), F.lit("missing_time").alias("reason"))
        blank = [F.lit(None).cast(undated.schema[c].dataType).alias(c) for c in ROW[1:]]
        again = seen.where(dated & (F.col("n") > 1)).select(
            F.col("key").alias("request_id"), *blank, (F.col("n") - 1).alias("rows"), F.lit("duplicate_request_id").alias("reason"))
        undated.unionByName(again).write.mode("overwrite").parquet(f"{rejects}/batch_id={batch_id}")
        delete(spark, path)
    return write


def ingest(spark: SparkSession, source: DataFrame, out: str, ckpt: str, rejects: str) -> None:
    """Run S1 over a stream of files to completion over what is available
    (restartable from ``ckpt``, whose state knows every id so far)."""
    with _state_store(spark):
        q = (arrivals(source).writeStream.outputMode("update").foreachBatch(_batch_writer(out, rejects))
             .option("checkpointLocation", ckpt)
             .trigger(availableNow=True).start())
        q.awaitTermination()


def read_rejects(spark: SparkSession, rejects: str) -> DataFrame:
    """Rejected rows: an undated one in full; of an id with repeats the id and how many
    rows beside its first have come so far (each batch that brings one writes the new count)."""
    r = spark.read.parquet(rejects).drop("batch_id")
    again = F.col("reason") == "duplicate_request_id"
    counted = r.where(again).groupBy("request_id", "reason").agg(F.max("rows").alias("rows"))
    return r.where(~again).unionByName(counted, allowMissingColumns=True)


def read_log(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).parquet(out).drop("batch_id", "day")


GROUP = ("day", "mode", "final_tier")


def day_sums(log: DataFrame) -> DataFrame:
    """Requests, tokens and latency per day, mode and tier; of a stream, running sums."""
    return log.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("requests"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.sum("total_latency_ms").alias("total_latency_ms"))


def with_costs(sums: DataFrame, price: DataFrame) -> DataFrame:
    """``day_sums`` with cost, what tier_3 would have cost, and the savings, from exact token sums."""
    p = F.broadcast(price.select(F.col("tier").alias("final_tier"), F.col("input_cost_per_million").alias("pi"),
                                 F.col("output_cost_per_million").alias("po")))
    ti, to = verifier_price(price)
    i, o = F.col("input_tokens").cast("double") / 1000000, F.col("output_tokens").cast("double") / 1000000
    cost, base = i * F.col("pi") + o * F.col("po"), i * F.lit(ti) + o * F.lit(to)
    return sums.join(p, "final_tier", "left").select(
        *GROUP, "requests", "input_tokens", "output_tokens", "total_latency_ms",
        cost.alias("total_cost_usd"), base.alias("tier_3_equivalent_cost_usd"), (base - cost).alias("estimated_savings_usd"))


def _summary_writer(out: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        from tierflow.sources.views import price
        (with_costs(batch, price(batch.sparkSession)).withColumn("version", F.lit(batch_id))
         .write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}"))
    return write


def live_summary(spark: SparkSession, log_dir: str, out: str, ckpt: str) -> None:
    """Run S2 to completion over what S1 has added to the log since the last run."""
    src = spark.readStream.schema(LOG_SCHEMA).parquet(log_dir).dropDuplicates(["request_id"])
    with _state_store(spark):
        q = (day_sums(src).writeStream.outputMode("update").foreachBatch(_summary_writer(out))
             .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
        q.awaitTermination()


def read_summary(spark: SparkSession, out: str) -> DataFrame:
    """Latest version of every (day, mode, tier) group."""
    w = Window.partitionBy(*GROUP).orderBy(F.col("version").desc())
    s = spark.read.parquet(out).withColumn("__r", F.row_number().over(w)).where(F.col("__r") == 1)
    return s.drop("__r", "version", "batch_id")


def run_paths(spark: SparkSession, tag: str | None = None) -> dict:
    base = checkpoint_path(spark, f"streams/{tag or uuid.uuid4().hex}")
    return {k: f"{base}/{k}" for k in ("log", "log_ckpt", "rejects", "summary", "summary_ckpt")}


def planted_runs(spark: SparkSession, sf_dir: str):
    """The events as a stream that comes in two lots, yielded once each is there: all events;
    then, late, repeats of every 50th dated ten days on, two equal rows
    without an id for every 41st, and a row without a time for every 43rd."""
    path = checkpoint_path(spark, f"tables/event-source-{uuid.uuid4().hex}")
    ev = spark.read.parquet(os.path.join(sf_dir, "events.parquet"))
    n, types = F.col("event_id"), dict(ev.dtypes)
    again = ev.where(n % 50 == 0).withColumn("ts", (F.col("ts") + F.expr("INTERVAL 10 DAYS")).cast(types["ts"]))
    bare = ev.where(n % 41 == 0).withColumn("event_id", F.lit(None).cast(types["event_id"]))
    undated = ev.where(n % 43 == 0).withColumn("ts", F.lit(None).cast(types["ts"]))
    late = again.unionByName(bare).unionByName(bare).unionByName(undated)
    for name, rows in (("a", ev), ("b", late)):
        rows.write.parquet(f"{path}/{name}")
        yield (spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 64)
               .option("recursiveFileLookup", "true").parquet(path))


def stream_log(spark: SparkSession, sf_dir: str, paths: dict | None = None) -> DataFrame:
    """Every row that came in, logged or rejected; a generated id is shown as null.
    Repeats of an id are one row that says how many they are."""
    p = paths or run_paths(spark)
    for source in planted_runs(spark, sf_dir):  # the second run starts from the first one's state
        ingest(spark, source, p["log"], p["log_ckpt"], p["rejects"])
    rid = F.when(~F.col("request_id").startswith(GENERATED), F.col("request_id"))
    show = lambda df, rows, outcome: df.select(
        rid.alias("request_id"), F.col("event_time").alias("created_at"), "mode", "final_tier",
        "input_tokens", "output_tokens", "total_latency_ms", rows.alias("n_rows"), outcome.alias("outcome"))
    logged = show(read_log(spark, p["log"]), F.lit(1).cast("bigint"), F.lit("logged"))
    return logged.unionByName(show(read_rejects(spark, p["rejects"]), F.col("rows"), F.col("reason")))


def stream_summary(spark: SparkSession, sf_dir: str, paths: dict | None = None) -> DataFrame:
    p = paths or run_paths(spark)
    for source in planted_runs(spark, sf_dir):  # the second run adds late rows to old days
        ingest(spark, source, p["log"], p["log_ckpt"], p["rejects"])
        live_summary(spark, p["log"], p["summary"], p["summary_ckpt"])
    return read_summary(spark, p["summary"]).select(
        "day", "mode", "final_tier", "requests", "input_tokens", "output_tokens",
        F.round("total_latency_ms", 4).alias("total_latency_ms"),
        *[F.round(c, 9).alias(c) for c in ("total_cost_usd", "tier_3_equivalent_cost_usd", "estimated_savings_usd")])
