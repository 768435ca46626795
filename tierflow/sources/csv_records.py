"""CSV records whose quoted values hold newlines, read from many splits of a file.

A line of a CSV file begins a record if the quotes before it in the file are
even in number (a doubled quote counts twice and changes nothing). So each split of
a file needs one figure from the splits before it: how many of their lines
hold an odd number of quotes. Such lines open and close, in turn, the records of several
lines.

1. Per split, count those lines: partial sums, then one row a split. A window
   over a file's splits adds them up.
2. Read again; lines are exchanged by split, running sums tell the lines that
   begin records, and the lines of a record are joined where they are.
3. Only records that lie across splits, at most two a split, are exchanged
   once more and joined.

A split is at most ``spark.sql.files.maxPartitionBytes``, so no group is larger than
that or one record. A compressed file is one split.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierflow.session import materialize


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, split (its first byte), pos (in reading order), value, quotes: how many the line holds."""
    text = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                       F.monotonically_increasing_id().alias("pos"), "value", quotes.alias("quotes"))


def split_offsets(lines: DataFrame) -> DataFrame:
    """file, split, odd_before: lines with an odd number of quotes in the file's earlier
    splits. A file that ends inside a quoted value is an error."""
    sums = lines.groupBy("file", "split").agg(F.sum(F.col("quotes") % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    out = materialize(sums.withColumn("odd_before", F.coalesce(F.sum("odd").over(before), F.lit(0))), "csv-splits")
    bad = out.groupBy("file").agg(F.sum("odd").alias("n")).where(F.col("n") % 2 == 1).limit(3).collect()
    if bad:
        raise ValueError(f"a quoted value is not closed in {[r['file'] for r in bad]}")
    return out.select("file", "split", "odd_before")


def csv_records(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """record: the text of each CSV record under ``path`` (files in subfolders too), without
    its line end; empty lines between records and, with ``header``, each file's first record are left out."""
    lines = _lines(spark, path)
    order = Window.partitionBy("file", "split").orderBy("pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # one row a split on the other side, whose size Spark sees and broadcasts while it is small
    marked = lines.join(split_offsets(lines), ["file", "split"]).select(
        "*", (F.col("odd_before") + F.sum(F.col("quotes") % 2).over(so_far) - F.col("quotes") % 2).alias("odd"),
        F.row_number().over(order).alias("nth"))
    begins = F.col("odd") % 2 == 0
    numbered = marked.withColumn("rec", F.sum(begins.cast("long")).over(so_far))
    # the records of several lines are numbered in their file by half the odd lines before them
    parts = numbered.groupBy("file", "split", "rec").agg(
        F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("lines"),
        F.min(F.when(begins, F.col("nth"))).alias("first"), F.sum("quotes").alias("quotes"),
        F.min(F.floor(F.col("odd") / 2)).alias("multi"))
    parts = parts.select("file", "split", "multi", "first",
                         (F.col("first").isNotNull() & (F.col("quotes") % 2 == 0)).alias("whole"),
                         F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("record"))
    top = (F.col("split") == 0) & (F.col("first") == 1)
    whole = parts.where("whole").select(top.alias("top"), "record")
    across = parts.where("NOT whole").groupBy("file", "multi").agg(
        F.array_sort(F.collect_list(F.struct("split", "record"))).alias("parts"), F.bool_or(F.coalesce(top, F.lit(False))).alias("top"))
    across = across.select("top", F.array_join(F.transform("parts", lambda x: x["record"]), "\n").alias("record"))
    out = whole.unionByName(across)
    if header:
        out = out.where(~F.col("top"))
    return out.select(F.regexp_replace("record", r"\r\z", "").alias("record")).where(F.col("record") != "")
