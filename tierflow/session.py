"""Session helpers."""
from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int = 8, shuffle_partitions: int | None = None,
                  app: str = "tierflow") -> SparkSession:
    """A local session configured like the cluster profile (AQE on, UTC, no UI)."""
    parts = shuffle_partitions or cores
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the operator sets it to shared storage.  Where it is unset, a
    session with a ``local`` master gets a scratch folder that goes when the
    process ends; any other master is an error, as its executors would write to
    folders of their own.
    """
    global _LOCAL_CKPT
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if _LOCAL_CKPT is None:
            _LOCAL_CKPT = tempfile.mkdtemp(prefix="tierflow-ckpt-")
            atexit.register(shutil.rmtree, _LOCAL_CKPT, ignore_errors=True)
        path = _LOCAL_CKPT
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


_LOCAL_CKPT: str | None = None


@contextlib.contextmanager
def shuffle_partitions(spark: SparkSession, least: int):
    """At least so many shuffle partitions for the jobs inside."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(least, int(before))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def storage_bytes(spark: SparkSession) -> int:
    """What all executors together can cache in memory; on a ``local`` master, what the driver can."""
    sc = spark.sparkContext._jsc.sc()
    status = spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc.getExecutorMemoryStatus())
    room = {at: status[at]._1() for at in status}
    driver = sc.env().blockManager().blockManagerId().hostPort()
    return sum(v for at, v in room.items() if at != driver) or sum(room.values())


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for one job or stream."""
    return os.path.join(ensure_checkpoint_dir(spark), name)


def materialize(df, name: str):
    """Cut lineage by writing ``df`` as a parquet table under the shared
    checkpoint folder and reading it back.

    One columnar pass (``Dataset.checkpoint`` computes the plan twice and
    stores rows), and the result survives executor loss: it lives on the
    shared file system, not in executor memory or local disk.
    """
    import uuid
    path = checkpoint_path(df.sparkSession, os.path.join("tables", f"{name}-{uuid.uuid4().hex}"))
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
