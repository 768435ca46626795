"""Streams: duplicates dropped, bad rows rejected, restart adds nothing, equals batch."""
import os
import tempfile

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tierflow.streaming import log_stream as LS


def _source_dir(spark):
    """Two event files; the second repeats 50 events and adds one without a timestamp."""
    d = tempfile.mkdtemp(prefix="tierflow-stream-src-")
    ev = spark.read.parquet(os.path.join(SF_SMALL, "events.parquet"))
    ev.coalesce(1).write.parquet(os.path.join(d, "part1"))
    bad = ev.limit(1).withColumn("event_id", F.lit(10 ** 9)).withColumn("ts", F.lit(None).cast(ev.schema["ts"].dataType))
    ev.orderBy("event_id").limit(50).unionByName(bad).coalesce(1).write.parquet(os.path.join(d, "part2"))
    return d, ev.count()


def _stream(spark, d):
    schema = spark.read.parquet(os.path.join(d, "part1")).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/*")


def _ingest(spark, d, p):
    LS.ingest(spark, _stream(spark, d), p["log"], p["log_ckpt"], p["rejects"])


def test_ingest_dedup_rejects_and_restart(spark):
    d, n = _source_dir(spark)
    p = LS.run_paths(spark)
    _ingest(spark, d, p)
    log = LS.read_log(spark, p["log"])
    assert log.count() == n
    assert log.select("request_id").distinct().count() == n
    why = {r["reason"]: r["n"] for r in LS.read_rejects(spark, p["rejects"]).groupBy("reason").agg(F.sum("rows").alias("n")).collect()}
    assert why == {"missing_time": 1, "duplicate_request_id": 50}
    batches = sorted(os.listdir(p["log"]))
    # restart from the checkpoint: nothing new to process, nothing added
    _ingest(spark, d, p)
    assert sorted(os.listdir(p["log"])) == batches
    assert LS.read_log(spark, p["log"]).count() == n


def test_late_rows_old_keys_and_missing_ids(spark):
    """A row weeks late is logged; a key is a key for ever; rows without an id all stay."""
    import datetime as dt
    ev = spark.read.parquet(os.path.join(SF_SMALL, "events.parquet"))
    d = tempfile.mkdtemp(prefix="tierflow-stream-src-")
    one = ev.limit(1).drop("event_id", "ts")
    ids = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 28)), (2, dt.datetime(2024, 1, 28))], "event_id long, ts timestamp_ntz")
    late = spark.createDataFrame(
        [(3, dt.datetime(2024, 1, 2)), (1, dt.datetime(2024, 1, 20)), (None, dt.datetime(2024, 1, 5)),
         (None, dt.datetime(2024, 1, 5)), (None, None), (4, None)], "event_id long, ts timestamp_ntz")
    for name, keys in (("part1", ids), ("part2", late)):
        keys.crossJoin(one).select(*[F.col(c).cast(t).alias(c) for c, t in ev.dtypes]).coalesce(1).write.parquet(f"{d}/{name}")
    p = LS.run_paths(spark)
    _ingest(spark, d, p)
    rows = LS.read_log(spark, p["log"]).collect()
    known = sorted(r["request_id"] for r in rows if not r["request_id"].startswith(LS.GENERATED))
    assert known == ["1", "2", "3"] and len(rows) == 5
    out = sorted((r["reason"], r["request_id"], r["rows"]) for r in LS.read_rejects(spark, p["rejects"]).collect())
    assert [r[0] for r in out] == ["duplicate_request_id", "missing_time", "missing_time"]
    assert out[0] == ("duplicate_request_id", "1", 1) and out[1][1] == "4"


def test_repeats_are_counted_over_batches_and_a_crash_leaves_one_copy(spark):
    """An id's repeats add up over micro-batches; a batch that ran but was not committed
    is replaced by its replay, generated ids included."""
    import glob
    import datetime as dt
    ev = spark.read.parquet(os.path.join(SF_SMALL, "events.parquet"))
    d = tempfile.mkdtemp(prefix="tierflow-stream-src-")
    one = ev.limit(1).drop("event_id", "ts")
    t = dt.datetime(2024, 1, 28)
    for k, ids in enumerate([[1, 1, 2], [1, 3, None], [1, 2, None, 4]], 1):
        keys = spark.createDataFrame([(i, t) for i in ids], "event_id long, ts timestamp_ntz")
        keys.crossJoin(one).select(*[F.col(c).cast(y).alias(c) for c, y in ev.dtypes]).coalesce(1).write.parquet(f"{d}/part{k}")
    p = LS.run_paths(spark)
    _ingest(spark, d, p)
    LS.live_summary(spark, p["log"], p["summary"], p["summary_ckpt"])
    first = sorted(r["request_id"] for r in LS.read_log(spark, p["log"]).collect())
    assert len(first) == 6 and first[:4] == ["1", "2", "3", "4"]
    last = max(glob.glob(f"{p['log_ckpt']}/commits/[0-9]*"), key=lambda f: int(os.path.basename(f)))
    os.remove(last)  # as if the process had died after the writes
    os.remove(os.path.join(os.path.dirname(last), f".{os.path.basename(last)}.crc"))
    _ingest(spark, d, p)
    LS.live_summary(spark, p["log"], p["summary"], p["summary_ckpt"])
    assert sorted(r["request_id"] for r in LS.read_log(spark, p["log"]).collect()) == first
    assert {r["request_id"]: r["rows"] for r in LS.read_rejects(spark, p["rejects"]).collect()} == {"1": 3, "2": 1}
    assert sum(r["requests"] for r in LS.read_summary(spark, p["summary"]).collect()) == 6


def test_summary_survives_a_replayed_batch(spark):
    d, _ = _source_dir(spark)
    p = LS.run_paths(spark)
    _ingest(spark, d, p)
    LS.live_summary(spark, p["log"], p["summary"], p["summary_ckpt"])
    key = lambda r: (r["day"], r["mode"], r["final_tier"])
    before = sorted((r.asDict() for r in LS.read_summary(spark, p["summary"]).collect()), key=key)
    # what a replay does: the same rows in files of other names
    folder = sorted(os.listdir(p["log"]))[0]
    assert folder.startswith("batch_id=")
    rows = spark.read.parquet(os.path.join(p["log"], folder))
    copy = tempfile.mkdtemp(prefix="tierflow-replay-")
    rows.write.mode("overwrite").partitionBy("day").parquet(copy)
    spark.read.parquet(copy).write.mode("overwrite").partitionBy("day").parquet(os.path.join(p["log"], folder))
    LS.live_summary(spark, p["log"], p["summary"], p["summary_ckpt"])
    after = sorted((r.asDict() for r in LS.read_summary(spark, p["summary"]).collect()), key=key)
    for a, b in zip(before, after, strict=True):
        assert key(a) == key(b) and a["requests"] == b["requests"] and a["input_tokens"] == b["input_tokens"]


def test_streams_independent_of_session_zone(spark):
    """Event time is wall clock: a non-UTC session gives the same log and days."""
    old = spark.conf.get("spark.sql.session.timeZone")
    run = lambda: ({(r["request_id"], r["created_at"], r["outcome"]) for r in LS.stream_log(spark, SF_SMALL).collect()},
                   {(r["day"], r["mode"], r["final_tier"]): r["requests"] for r in LS.stream_summary(spark, SF_SMALL).collect()})
    utc = run()
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        assert run() == utc
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
