"""Global ranks and top-k without a single-task sort."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierflow.session import materialize


def global_rank(df: DataFrame, group: list[str], order: list[Column], out: str = "rank", name: str = "rank") -> DataFrame:
    """df with ``out``, the row's rank from 0 within ``group`` in ``order``.

    Rows are range-partitioned and written; each partition ranks its own rows,
    and a table of counts per partition and group gives the offsets.
    """
    keys = [F.col(g).asc_nulls_first() for g in group] + order
    part = materialize(df.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()), name)
    counts = part.groupBy("__part", *group).agg(F.count(F.lit(1)).alias("__n"))
    # partitions times groups rows
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("__part").alias("__p"), *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)],
                            F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    on = F.col("__part") == F.col("__p")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    inside = Window.partitionBy("__part", *group).orderBy(*order)
    ranked = part.withColumn("__r", F.row_number().over(inside) - 1).join(offsets, on)
    return ranked.select(*df.columns, (F.col("__r") + F.col("__before")).alias(out))


def top_by_count(df: DataFrame, count: str, tie: str, k: int, name: str = "top") -> DataFrame:
    """The k rows of largest ``count`` (ties in the order of ``tie``).

    A histogram of the counts gives the cut-off value: as each value has at
    least one row, its k largest values hold the k largest rows, however many
    rows there are.  All above the cut-off stay, and only its ties are ranked.
    """
    hist = df.groupBy(count).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col(count).desc()).limit(k)
    upto = hist.withColumn("upto", F.sum("n").over(Window.orderBy(F.col(count).desc())))  # at most k rows
    cut = upto.where(F.col("upto") >= k).orderBy(F.col(count).desc()).first()
    if cut is None:  # fewer than k rows in all
        return df
    above, room = df.where(F.col(count) > cut[count]), k - (cut["upto"] - cut["n"])
    ties = df.where(F.col(count) == cut[count])
    if cut["n"] == room:
        return above.unionByName(ties)
    ranked = global_rank(ties, [], [F.col(tie).asc()], name=name)
    return above.unionByName(ranked.where(F.col("rank") < room).drop("rank"))
