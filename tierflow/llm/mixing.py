"""Mixing sources to target weights by hash-threshold histograms.

Tokens are summed by source and bucket of a document hash. The running sum
shows in which bucket a source's budget runs out; only that bucket is split
again, so after each level only boundary buckets are read, and at the end a
document belongs to the mix if its hash is below its source's threshold.
Nothing is sorted but at most 4,096 bucket sums a source. Thresholds of
smaller budgets lie below those of larger ones, so their mixes are nested.

Cases: a null text has size 0; a null source is a source of its own, last in
order; the hash covers id and text, so repeated rows are taken alike; an empty
table or one without words takes nothing; other columns stay, but those called
as a column that ``mix`` adds give way to it.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierflow.llm.common import WORD, Scratch, materialize, table

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
BITS, LEVELS = 12, 4


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def hash_of(doc_id: str = "doc_id", text: str = "text", seed: int = 17) -> Column:
    """48 bits that decide a document's place in every budget."""
    h = F.xxhash64(F.lit(seed), F.col(doc_id), F.coalesce(F.col(text), F.lit("")))
    return F.shiftrightunsigned(h, 64 - BITS * LEVELS)


def ranked(df: DataFrame, by: Column, name: str) -> DataFrame:
    """df with ``rank`` (from 0) in the order of ``by``, without a single-task
    sort: range partitions, ranks inside each, and an offset for each."""
    part = materialize(df.repartitionByRange(by).withColumn("part", F.spark_partition_id()), name)
    offsets = part.groupBy("part").count().select(
        "part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    return part.join(offsets, "part").withColumn(
        "rank", F.row_number().over(Window.partitionBy("part").orderBy(by)) - 1 + F.col("before")
    ).drop("part", "before")


def targets(sized: DataFrame, shares: tuple[float, ...], weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """source, budget (index into shares), source_size, target.

    A source's target is its weight's share, but at most cap times its size;
    what is cut off goes to the others by weight until none is above.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = F.col("source").asc_nulls_last()
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    src = materialize(ranked(sums, by, "mix-order").select("source", "source_size", weight.alias("w")), "mix-sources")
    total = src.agg(F.sum("source_size")).first()[0] or 0
    top, out = F.col("source_size") * F.lit(float(cap)), None
    for k, share in enumerate(shares):
        goal, rate, full = share * total, None, 0
        while True:  # a round of three sums over the sources; the rate only rises
            above = F.lit(False) if rate is None else top < F.col("w") * rate
            n, cut, w = src.agg(F.count_if(above), F.sum(F.when(above, top)), F.sum(F.when(~above, F.col("w")))).first()
            if rate is not None and n == full or not w:
                break
            rate, full = (goal - (cut or 0.0)) / w, n
        one = src.select("source", F.lit(k).alias("budget"), "source_size",
                         F.least(top, F.col("w") * F.lit(float(rate or 0.0))).alias("target"))
        out = one if out is None else out.unionAll(one)
    return out


def thresholds(sized: DataFrame, shares: tuple[float, ...] = (SHARE,), weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """source, budget, source_size, target, base, below: a document is taken
    base times, and once more if its hash is under ``below``."""
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goals = materialize(
        targets(sized, shares, weights, cap).withColumn("base", base.cast("long"))
        .withColumn("left", F.col("target") - F.col("base") * F.col("source_size"))
        .withColumn("prefix", F.lit(0).cast("long")), "mix-goals")
    state = goals.filter("left > 0").select("source", "budget", "left", "prefix")
    done = None
    for level in range(1, LEVELS + 1):
        rest = BITS * (LEVELS - level)
        s = state.select(F.col("source").alias("s"), "budget", "left", "prefix")
        inside = sized.join(s, F.col("source").eqNullSafe(F.col("s"))
                            & (F.shiftright("hv", rest + BITS) == F.col("prefix")))
        hist = inside.groupBy("source", "budget", "left", F.shiftright("hv", rest).alias("bucket")).agg(
            F.sum("size").alias("size"), F.min("hv").alias("lo"), F.max("hv").alias("hi"))
        # at most 4,096 buckets for each source and budget
        over = Window.partitionBy("source", "budget").orderBy("bucket")
        cut = (hist.withColumn("upto", F.sum("size").over(over))
               .filter((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("size") < F.col("left")))
               .select("source", "budget", (F.col("left") - F.col("upto") + F.col("size")).alias("left"),
                       F.col("bucket").alias("prefix"), "size", "lo", "hi"))
        cut = materialize(cut, f"mix-level-{level}")
        one = F.col("lo") == F.col("hi") if rest else F.lit(True)  # nothing left to refine
        near = F.when(F.col("size") < 2 * F.col("left"), F.col("hi") + 1).otherwise(F.col("lo"))
        ended = cut.filter(one).select("source", "budget", near.alias("below"))
        done = ended if done is None else done.unionAll(ended)
        state = cut.filter(~one).select("source", "budget", "left", "prefix")
        if not rest or state.isEmpty():
            break
    d = done.select(F.col("source").alias("s"), F.col("budget").alias("b"), "below")
    return goals.join(d, F.col("source").eqNullSafe(F.col("s")) & (F.col("budget") == F.col("b")), "left").select(
        "source", "budget", "source_size", "target", "base", F.coalesce("below", F.lit(0)).alias("below"))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text",
        shares: tuple[float, ...] = (SHARE,), weights=WEIGHTS, cap: float = CAP, keep_text: bool = False) -> DataFrame:
    """docs (without text unless kept) with size, source_size, target, taken
    and first_budget: the smallest budget, as an index into the ascending
    shares, whose mix holds the document (null: none). target and taken are
    those of the largest budget."""
    shares = tuple(sorted(shares))
    added = ("size", "source_size", "target", "taken", "first_budget")
    own = [c for c in docs.columns if (keep_text or c != text) and c not in added]
    scratch = Scratch(docs.sparkSession, "mix")
    # a row's columns stay in a struct of their own, whatever their names
    rows = docs.select(F.struct(*own).alias("row"), F.col(source).alias("source"), size_of(text).alias("size"),
                       hash_of(doc_id, text).alias("hv"))
    slim = scratch.write(rows if not keep_text else rows.drop("row"), "sizes")
    t = thresholds(slim.select("source", "size", "hv"), shares, weights, cap)
    t = t.groupBy(F.col("source").alias("of")).agg(
        F.max("source_size").alias("source_size"),
        F.max_by("target", "budget").alias("target"),
        *[F.max(F.when(F.col("budget") == k, F.col(c))).alias(f"{c}{k}") for k in range(len(shares)) for c in ("base", "below")])
    # written, so that its size decides whether it is broadcast: a row a source
    t = scratch.write(t, "thresholds")
    times = [F.col(f"base{k}") + (F.col("hv") < F.col(f"below{k}")).cast("long") for k in range(len(shares))]
    first = F.coalesce(*[F.when(x > 0, F.lit(k)) for k, x in enumerate(times)])
    # sizes and hashes are a small table; where texts stay, they are read once more instead of written
    out = (rows if keep_text else slim).join(t, F.col("source").eqNullSafe(F.col("of")), "left").select(
        "row", F.struct("size", "source_size", "target", (F.col("size") * times[-1]).alias("taken"),
                        first.alias("first_budget")).alias("mix"))
    if keep_text:
        scratch.drop("sizes")
    return out.select(*[F.col("row")[c].alias(c) for c in own], "mix.*")


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    return mix(docs, shares=(0.5, 1.0, SHARE)).select("doc_id", "size", "source_size", "target", "taken", "first_budget")
