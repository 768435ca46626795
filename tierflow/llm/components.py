"""Connected components of an edge table, without gathering it anywhere."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierflow.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """node and comp (the smallest node of its component) for every node that
    an edge (``a``, ``b``; longs) joins to another.

    Each round hangs every vertex on its least neighbour, if that is less than
    itself, and contracts the edges. By turns, less means a smaller id, which
    ends stars around small ids at once, and a smaller hash that differs from
    round to round, by which a constant share of the vertices goes whatever the
    graph's shape. So rounds are few, and logarithmic at worst. Edges are
    written between rounds, which cuts the lineage; at the end the rounds'
    pointers are followed in order.
    """
    at, up_at, label_at = (f"{name}-{x}" for x in ("edges", "ups", "labels"))
    live = scratch.write(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                         .distinct(), at)
    nodes = live.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    label, ups, seed = scratch.write(nodes.withColumn("comp", F.col("node")), label_at), 0, 0
    while not live.isEmpty():
        seed += 1
        order = (lambda c: F.col(c)) if seed % 2 else (lambda c: F.xxhash64(F.lit(seed), F.col(c)))
        both = live.select(F.inline(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")),
                                            F.struct(F.col("b").alias("v"), F.col("a").alias("w")))))
        least = both.groupBy("v").agg(F.min_by("w", order("w")).alias("to"))
        up = scratch.write(least.filter(order("to") < order("v")), up_at)
        label = label.join(up, label["comp"] == up["v"], "left").select("node", F.coalesce("to", "comp").alias("comp"))
        ups += 1
        if ups % 4 == 0:
            label = scratch.write(label, label_at)
        for end in ("a", "b"):
            live = live.join(up, live[end] == up["v"], "left").withColumn(end, F.coalesce("to", end)).drop("v", "to")
        live = scratch.write(live.filter("a <> b").distinct(), at)
    label = scratch.write(label, label_at)
    scratch.trim(label_at)
    scratch.drop(at, up_at)
    least = label.groupBy("comp").agg(F.min("node").alias("least"))
    return label.join(least, "comp").select("node", F.col("least").alias("comp"))
