"""Small Spark helpers shared by the operators of this package."""
from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierflow.session import checkpoint_path, materialize

__all__ = ["materialize", "Scratch", "table", "key_of", "fingerprint", "map_batches", "ship", "MIN_LONG", "WORD"]

WORD = r"[^\x20\x09-\x0D]+"
MIN_LONG = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")).select(*columns)


def key_of(column: str) -> Column:
    """An id that joins and sorts without nulls: a null id comes first."""
    return F.coalesce(F.col(column).cast("long"), F.lit(MIN_LONG))


def fingerprint(column: str) -> Column:
    """20 bits of a text's hash. They tell apart rows that share an id."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit(""))).bitwiseAND(F.lit(0xFFFFF))


class Scratch:
    """Tables of one job in the shared checkpoint folder, by name.

    ``write`` cuts the lineage: the table outlives lost executors, and the shuffle
    files that made it go at once, as nothing reads them again. ``drop`` deletes
    the tables of a name once what was made of them is written.
    """
    CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession, job: str):
        self.spark, self.job, self.paths = spark, job, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = checkpoint_path(self.spark, f"tables/{self.job}-{name}-{uuid.uuid4().hex}")
        before = self.spark.conf.get(self.CLEANUP, None)
        self.spark.conf.set(self.CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(self.CLEANUP)
            else:
                self.spark.conf.set(self.CLEANUP, before)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def trim(self, name: str) -> None:
        """Delete the tables of a name but the last."""
        while len(self.paths.get(name, [])) > 1:
            delete(self.spark, self.paths[name].pop(0))

    def drop(self, *names: str) -> None:
        for name in names:
            for path in self.paths.pop(name, []):
                delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system its path names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once for each session, so
    that tasks find it where it isn't installed."""
    sc = spark.sparkContext
    if getattr(sc, "_tierflow_shipped", False):
        return
    import tierflow

    top = os.path.dirname(os.path.dirname(os.path.abspath(tierflow.__file__)))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="tierflow-code-"), "tierflow_code"),
                                  "zip", top, "tierflow")
    sc.addPyFile(archive)
    sc._tierflow_shipped = True


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """Apply f to every Arrow batch; it yields dicts of equally long columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for out in f(batch):
                cols = [pa.array(out[x.name], type=x.type) for x in target]
                yield pa.RecordBatch.from_arrays(cols, schema=target)

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
