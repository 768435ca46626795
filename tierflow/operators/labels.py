"""Labelling a routing corpus and auditing the labels.

Every audit is ONE conditional aggregation grouped by split: the shuffle
carries one partial-aggregate row per (task, split), however many rows the
corpus has.  Fixed-size fan-outs (8 patterns, 4 thresholds, 3 pairs) are
produced from the aggregated row with ``inline`` over a literal array, so
zero-filled outputs need no dimension join.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierflow.constants import (BORDERLINE_MARGIN, PASS_PATTERNS, QUALITY_THRESHOLD,
                                SENSITIVITY_PAIRS, SENSITIVITY_THRESHOLDS, TIERS)
from tierflow.functions.routing import pass_pattern, passes, routing_label, score_from_text
from tierflow.sources.csv_records import csv_records

SCORES = ["tier_1_score", "tier_2_score", "tier_3_score"]
LABELS = TIERS + ["unresolved"]


# --------------------------------------------------------------------------
# Nested corpus and safe score extraction
# --------------------------------------------------------------------------
def nested_corpus(raw: DataFrame) -> DataFrame:
    """The corpus as it arrives: one struct column per model with a text score.

    Rendering rules (deterministic on the key) plant the malformed inputs the
    extractor must survive: non-numeric text, ``NaN`` text and a missing
    model entry.
    """
    k = F.col("key")

    def model(score_col, bad_mod, nan_mod, missing_mod):
        txt = (F.when(k % bad_mod == 0, F.lit("n/a"))
               .when(k % nan_mod == 0, F.lit("NaN"))
               .otherwise(F.col(score_col).cast("string")))
        s = F.struct(txt.alias("score"), F.col("split").alias("source_split"))
        return F.when(k % missing_mod == 0, F.lit(None)).otherwise(s)

    return raw.select(
        "key", F.col("source_dataset").alias("dataset"), "dataset_level", "prompt", "split",
        model("tier_1_score", 7, 13, 29).alias("model_small"),
        model("tier_2_score", 11, 17, 31).alias("model_medium"),
        model("tier_3_score", 37, 41, 43).alias("model_large"),
    )


CORPUS_MODELS = ("model_small", "model_medium", "model_large")


BROKEN = "_broken"


def corpus_schema(models=CORPUS_MODELS):
    from pyspark.sql import types as T
    model = T.StructType([T.StructField("score", T.StringType())])
    return T.StructType(
        [T.StructField("key", T.StringType()), T.StructField("dataset", T.StringType()),
         T.StructField("dataset_level", T.StringType()), T.StructField("prompt", T.StringType()),
         T.StructField("split", T.StringType())]
        + [T.StructField(m, model) for m in models])


def read_corpus(spark, path: str, fmt: str = "json", models=CORPUS_MODELS, rejects: str | None = None) -> DataFrame:
    """A1: scan a nested corpus with an explicit schema; only ``<model>.score``
    is declared for each model column, so nothing else is parsed or read.

    A JSON record that can't be read (broken, or of another shape) is never
    a row of nulls: with ``rejects`` it is written there as (record, reason), and
    without, it is an error.
    """
    schema = corpus_schema(models)
    if fmt != "json":
        return spark.read.schema(schema).format(fmt).load(path)
    if rejects is None:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    from pyspark.sql import types as T
    whole = T.StructType(schema.fields + [T.StructField(BROKEN, T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}).alias("r")).select("r.*")
    shape = F.when(F.trim(BROKEN).rlike(r"^\{[\s\S]*\}$"), "unexpected_shape").otherwise("malformed_json")
    rows.where(F.col(BROKEN).isNotNull()).select(F.col(BROKEN).alias("record"), shape.alias("reason")) \
        .write.mode("append").parquet(rejects)
    return rows.where(F.col(BROKEN).isNull()).drop(BROKEN)


def extract_scores(corpus: DataFrame) -> DataFrame:
    return corpus.select(
        "key", "split",
        score_from_text(F.col("model_small.score")).alias("tier_1_score"),
        score_from_text(F.col("model_medium.score")).alias("tier_2_score"),
        score_from_text(F.col("model_large.score")).alias("tier_3_score"),
    )


# --------------------------------------------------------------------------
# B10 / A2 / A3 / E6
# --------------------------------------------------------------------------
def label_corpus(df: DataFrame) -> DataFrame:
    """Labelling rule: a missing score is 'did not pass'; the row is still labelled."""
    return df.withColumn("routing_label", routing_label(*SCORES))


def complete_rows(df: DataFrame, need_prompt: bool = False) -> DataFrame:
    """Analysis rule: drop a row when any score (and, for training, the prompt) is
    missing.  Where the table has a ``has_prompt`` flag, the text isn't read."""
    if need_prompt and "has_prompt" in df.columns:
        return df.where("has_prompt").na.drop(subset=SCORES)
    return df.na.drop(subset=SCORES + (["prompt"] if need_prompt else []))


def label_counts(labelled: DataFrame) -> DataFrame:
    """Counts per split and label, with per-split and grand totals ('all')."""
    g = labelled.rollup("split", "routing_label").agg(F.count(F.lit(1)).alias("count"))
    return g.select(F.coalesce("split", F.lit("all")).alias("split"),
                    F.coalesce("routing_label", F.lit("all")).alias("routing_label"), "count")


# The texts that the usual CSV reader takes as missing.
MISSING_TEXTS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
                 "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


CSV_COLUMNS = ["key", "source_dataset", "dataset_level", "prompt", "routing_label", *SCORES]


def read_labelled_csv(spark, path: str, need_prompt: bool = False) -> DataFrame:
    """A3: read a labelled CSV split with an explicit schema; quoted newlines and
    doubled quotes are honoured, and the usual missing-value texts become null
    in every column.  A file is read by as many tasks as it has splits."""
    schema = ", ".join(f"`{c}` string" for c in CSV_COLUMNS)
    df = csv_records(spark, path).select(F.from_csv("record", schema, {"escape": '"', "mode": "PERMISSIVE"}).alias("r")).select("r.*")
    value = {c: F.when(~F.col(c).isin(*MISSING_TEXTS), F.col(c)) for c in CSV_COLUMNS}
    return complete_rows(df.select(*[
        (value[c].try_cast("double") if c in SCORES else value[c]).alias(c) for c in CSV_COLUMNS]), need_prompt)


# --------------------------------------------------------------------------
# E21 class balance of the three binary targets
# --------------------------------------------------------------------------
def target_balance(df: DataFrame) -> DataFrame:
    rows = complete_rows(df, need_prompt=True)
    aggs = [F.count(F.lit(1)).alias("n")]
    for t, s in zip(TIERS, SCORES):
        aggs.append(F.sum(passes(s).cast("int")).alias(f"pos_{t}"))
    g = rows.groupBy("split").agg(*aggs)
    entries = [F.struct(F.lit(t).alias("tier"),
                        F.col(f"pos_{t}").cast("bigint").alias("positives"),
                        (F.col("n") - F.col(f"pos_{t}")).cast("bigint").alias("negatives"),
                        (F.col(f"pos_{t}").cast("double") / F.col("n")).alias("positive_share"))
               for t in TIERS]
    return g.select("split", F.inline(F.array(*entries)))


# --------------------------------------------------------------------------
# E7 monotonicity
# --------------------------------------------------------------------------
def monotonicity(df: DataFrame) -> DataFrame:
    s1, s2, s3 = (F.col(c) for c in SCORES)
    conds = {
        "monotonic": (s1 <= s2) & (s2 <= s3),
        "tier_1_gt_tier_2": s1 > s2,
        "tier_2_gt_tier_3": s2 > s3,
        "tier_1_gt_tier_3": s1 > s3,
    }
    g = complete_rows(df).groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.sum(c.cast("int")).cast("bigint").alias(n) for n, c in conds.items()])
    out = ["split", "rows"]
    for n in conds:
        out += [n, (F.col(n).cast("double") / F.col("rows")).alias(f"{n}_share")]
    return g.select(*out)


# --------------------------------------------------------------------------
# E8 pass patterns (zero-filled, fixed order)
# --------------------------------------------------------------------------
def pass_patterns(df: DataFrame) -> DataFrame:
    pat = pass_pattern(*SCORES)
    g = complete_rows(df).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum((pat == p).cast("int")).alias(f"p{p}") for p, _ in PASS_PATTERNS])
    entries = [F.struct(F.lit(i + 1).alias("pattern_order"), F.lit(p).alias("pattern"),
                        F.lit(d).alias("description"),
                        F.col(f"p{p}").cast("bigint").alias("count"),
                        F.when(F.col("n") > 0, F.col(f"p{p}").cast("double") / F.col("n"))
                        .otherwise(0.0).alias("share"))
               for i, (p, d) in enumerate(PASS_PATTERNS)]
    return g.select("split", F.inline(F.array(*entries)))


# --------------------------------------------------------------------------
# E9 / E10 threshold sensitivity and label changes
# --------------------------------------------------------------------------
def _tkey(t: float) -> str:
    return f"{int(round(t * 100)):03d}"


def threshold_sensitivity(df: DataFrame) -> DataFrame:
    """Label shares at each threshold; labels absent at a threshold are omitted."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for t in SENSITIVITY_THRESHOLDS:
        lab = routing_label(*SCORES, threshold=t)
        aggs += [F.sum((lab == L).cast("int")).alias(f"c{_tkey(t)}_{L}") for L in LABELS]
    g = complete_rows(df).groupBy("split").agg(*aggs)
    entries = [F.struct(F.lit(float(t)).alias("threshold"), F.lit(L).alias("label"),
                        F.col(f"c{_tkey(t)}_{L}").cast("bigint").alias("count"),
                        (F.col(f"c{_tkey(t)}_{L}").cast("double") / F.col("n")).alias("share"))
               for t in SENSITIVITY_THRESHOLDS for L in LABELS]
    return g.select("split", F.inline(F.array(*entries))).where(F.col("count") > 0)


def label_changes(df: DataFrame) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n")]
    for a, b in SENSITIVITY_PAIRS:
        changed = routing_label(*SCORES, threshold=a) != routing_label(*SCORES, threshold=b)
        aggs.append(F.sum(changed.cast("int")).alias(f"ch{_tkey(a)}"))
    g = complete_rows(df).groupBy("split").agg(*aggs)
    entries = [F.struct(F.lit(float(a)).alias("from_threshold"),
                        F.lit(float(b)).alias("to_threshold"),
                        F.col(f"ch{_tkey(a)}").cast("bigint").alias("changed"),
                        (F.col(f"ch{_tkey(a)}").cast("double") / F.col("n")).alias("changed_share"))
               for a, b in SENSITIVITY_PAIRS]
    return g.select("split", F.inline(F.array(*entries)))


# --------------------------------------------------------------------------
# E11 borderline scores
# --------------------------------------------------------------------------
def borderline_scores(df: DataFrame) -> DataFrame:
    lo = F.lit(QUALITY_THRESHOLD) - F.lit(BORDERLINE_MARGIN)   # 0.7000000000000001
    hi = F.lit(QUALITY_THRESHOLD) + F.lit(BORDERLINE_MARGIN)
    near = None
    for s in SCORES:
        c = (F.col(s) >= lo) & (F.col(s) <= hi)
        near = c if near is None else (near | c)
    g = complete_rows(df).groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(near.cast("int")).cast("bigint").alias("borderline"))
    return g.select(
        "split", "rows", "borderline",
        (F.col("borderline").cast("double") / F.col("rows")).alias("borderline_share"),
        (F.col("rows") - F.col("borderline")).alias("non_borderline"),
        ((F.col("rows") - F.col("borderline")).cast("double") / F.col("rows"))
        .alias("non_borderline_share"),
    )
