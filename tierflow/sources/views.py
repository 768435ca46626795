"""Fixture views derived from the driver tables.

Each view is built with the DataFrame API so Catalyst can prune and push
filters into the parquet scans.  ``VIEW_SQL`` holds the same views as SQL
text; the oracle runs them in DuckDB, and a test checks both engines agree
row by row.

Partitioning notes: ``candidates`` ranks lines per order with a window
partitioned by ``request_id`` (not ``l_orderkey``), so the settlement join
and every later per-request step reuse that one shuffle of ``lineitem``;
the rank filter is pushed below the shuffle (partial WindowGroupLimit), so
a hot order cannot concentrate its lines in one task.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierflow.constants import PRICE_ROWS
from tierflow.sources.tables import read_table


def price(spark: SparkSession) -> DataFrame:
    """The three-row price dimension (always small; callers broadcast it).

    Built from SQL ``VALUES`` so it is a JVM-side local relation whose size
    Catalyst knows, rather than a Python-decoded RDD scan.
    """
    rows = ", ".join(f"('{t}', {o}, '{m}', CAST({i} AS DOUBLE), CAST({out} AS DOUBLE))"
                     for t, o, m, i, out in PRICE_ROWS)
    return spark.sql(
        f"SELECT tier, CAST(tier_ord AS INT) AS tier_ord, model_id, input_cost_per_million, "
        f"output_cost_per_million FROM VALUES {rows} "
        f"AS t(tier, tier_ord, model_id, input_cost_per_million, output_cost_per_million)")


def routing_raw(spark: SparkSession, sf_dir: str, with_labels: bool = True) -> DataFrame:
    """Documents as a labelled routing corpus.

    ``labels`` is keyed by ``doc_id`` (unique), so the left join never changes
    the row set; callers that do not read ``quality``/``toxic`` pass
    ``with_labels=False`` and skip that join (and its shuffle at scale).
    """
    # n_chars says whether there is a prompt, so filters on that read no text
    d = read_table(spark, sf_dir, "documents", "doc_id", "source", "lang", "text", "n_chars")
    k = F.col("doc_id")
    if with_labels:
        lab = read_table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
        d = d.join(lab, "doc_id", "left")
    else:
        d = d.select("*", F.lit(None).cast("int").alias("quality"),
                     F.lit(None).cast("int").alias("toxic"))
    return (
        d.select(
            k.alias("key"),
            F.col("source").alias("source_dataset"),
            F.col("lang").alias("dataset_level"),
            F.col("text").alias("prompt"),
            F.col("n_chars").isNotNull().alias("has_prompt"),
            F.when(k % 10 < 6, "train").when(k % 10 < 8, "validation")
            .otherwise("test").alias("split"),
            F.when(k % 19 == 0, F.lit(None).cast("double"))
            .otherwise(((k * 37 + 11) % 101).cast("double") / 100).alias("tier_1_score"),
            (F.least(F.lit(100), (k * 53 + 29) % 101 + 10).cast("double") / 100)
            .alias("tier_2_score"),
            F.when(k % 23 == 0, F.lit(None).cast("double"))
            .otherwise(F.least(F.lit(100), (k * 71 + 47) % 101 + 30).cast("double") / 100)
            .alias("tier_3_score"),
            "quality", "toxic",
        )
    )


def routing_scored(spark: SparkSession, sf_dir: str, with_labels: bool = True) -> DataFrame:
    k = F.col("key")

    def prob(a, b, c, d, e):
        v = F.least(F.lit(1000), ((k * a + b) % 101 + c) * 9 + ((k * d + e) % 101) * 1)
        return v.cast("double") / 1000

    return routing_raw(spark, sf_dir, with_labels).select(
        "*",
        prob(37, 11, 0, 17, 5).alias("tier_1_probability"),
        prob(53, 29, 10, 29, 3).alias("tier_2_probability"),
        prob(71, 47, 30, 41, 7).alias("tier_3_probability"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey",
                   "o_orderdate", "o_orderpriority")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pr = F.col("o_orderpriority")
    return o.select(
        k.cast("string").alias("request_id"),
        F.col("o_orderdate").alias("created_at"),
        F.when(k % 3 == 0, "economy").otherwise("balanced").alias("mode"),
        F.when(pr.isin("1-URGENT"), "complex")
        .when(pr.isin("2-HIGH", "3-MEDIUM"), "moderate")
        .otherwise("simple").alias("category"),
        (((k * 37 + c) % 1001).cast("double") / 1000).alias("tier_1_probability"),
        (((k * 53 + c * 3) % 1001).cast("double") / 1000).alias("tier_2_probability"),
        (((k * 71 + c * 7) % 1001).cast("double") / 1000).alias("tier_3_probability"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each tier would answer to a request: its order's lines, dealt to the
    tiers by line number, every line counted.

    One aggregate per order with a column set for each tier, so partial sums
    are formed before the only exchange (a hot order ships one row per task),
    and the result is partitioned by ``request_id``.  All buffers are numbers.
    A tier without a line has no answer.
    """
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey",
                    "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                    "l_tax", "l_returnflag", "l_linestatus")
    li = li.select("*", F.col("l_orderkey").cast("string").alias("request_id"),
                   ((F.col("l_linenumber") - 1) % 3 + 1).alias("o"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    aggs = {
        "qty": (F.sum, F.col("l_quantity").cast("bigint")),
        "part": (F.sum, F.col("l_partkey") % 900),
        "think": (F.sum, F.col("l_suppkey") % 200),
        "cents": (F.sum, cents),
        "tax": (F.sum, F.round(F.col("l_tax") * 100).cast("bigint")),
        "n": (F.sum, F.lit(1).cast("bigint")),
        "final": (F.max, (F.col("l_linestatus") == "F").cast("int")),
        "disc": (F.max, F.round(F.col("l_discount") * 100).cast("int")),
        "flag": (F.min, F.ascii("l_returnflag")),
        "maxpart": (F.max, F.col("l_partkey")),
    }
    wide = li.groupBy("request_id").agg(*[
        f(F.when(F.col("o") == k, c)).alias(f"{name}_{k}") for k in (1, 2, 3) for name, (f, c) in aggs.items()])
    tiers = F.array(*[F.struct(F.lit(k).alias("tier_ord"), *[F.col(f"{name}_{k}").alias(name) for name in aggs])
                      for k in (1, 2, 3)])
    a = wide.select("request_id", F.inline(tiers)).where(F.col("n").isNotNull())
    o, pct = F.col("tier_ord"), F.col("judge_pct")
    verdict = F.when(F.col("final") == 1, "PASS").otherwise("FAIL")
    score = F.when(pct == 100, F.lit("1.0")).otherwise(F.concat(F.lit("0."), pct.cast("string")))
    reason = F.concat(F.lit("REASON: flag "), F.char(F.col("flag")))
    # one answer in about seven comes with a reply that the parser must refuse
    odd = F.col("maxpart") % 29
    text = (F.when(odd == 0, F.lit(None).cast("string"))
            .when(odd == 1, F.concat(F.lit("SCORE: "), score, F.lit("\n"), reason))
            .when(odd == 2, F.concat(F.lit("VERDICT: "), verdict, F.lit("\n"), reason))
            .when(odd == 3, F.concat(F.lit("VERDICT: "), verdict, F.lit("\nSCORE: 1.5\n"), reason))
            .otherwise(F.concat(F.lit("VERDICT: "), verdict, F.lit("\nSCORE: "), score, F.lit("\n"), reason)))
    return a.withColumn("judge_pct", 100 - 4 * F.col("disc")).select(
        "request_id", o.cast("int").alias("tier_ord"),
        F.when(o == 1, "tier_1").when(o == 2, "tier_2").otherwise("tier_3").alias("tier"),
        (F.col("qty") * 20).alias("input_tokens"),
        (F.col("part") + 50 * F.col("n")).alias("output_tokens"),
        F.when(o == 3, F.col("think")).otherwise(F.lit(0).cast("bigint")).alias("thinking_tokens"),
        (F.col("cents") / 1000).alias("generation_latency_ms"),
        (F.col("tax") * 100).cast("double").alias("judge_latency_ms"),
        (F.col("qty") * 20 + F.col("part") + 200).alias("judge_input_tokens"),
        F.lit(30).cast("bigint").alias("judge_output_tokens"),
        text.alias("judge_text"),
    )


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events", "event_id", "ts", "event_type", "value", "props")
    et = F.col("event_type")
    n = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    return ev.select(
        F.col("event_id").cast("string").alias("request_id"),
        F.col("ts").alias("created_at"),
        F.when(et.isin("click", "view"), "economy").otherwise("balanced").alias("mode"),
        F.when(et.isin("click", "error"), "tier_1").when(et == "view", "tier_2")
        .otherwise("tier_3").alias("final_tier"),
        n.alias("input_tokens"),
        (n * 7).alias("output_tokens"),
        (F.col("value") * 10).alias("total_latency_ms"),
    )


def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    u = conv.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("prompt"), (F.col("turn") + 1).alias("next_turn"))
    a = conv.where(F.col("role") == "assistant").select(
        "conv_id", F.col("turn").alias("next_turn"), F.col("text").alias("answer"))
    return u.join(a, ["conv_id", "next_turn"], "left").select("conv_id", "turn", "prompt", "answer")


# ---------------------------------------------------------------------------
# The same views as SQL text (DuckDB oracle; also valid Spark SQL).
# ---------------------------------------------------------------------------
VIEW_SQL = {
    "price": """
SELECT tier, CAST(tier_ord AS INT) AS tier_ord, model_id,
       CAST(i AS DOUBLE) AS input_cost_per_million,
       CAST(o AS DOUBLE) AS output_cost_per_million
FROM (VALUES ('tier_1', 1, 'model-small',  0.25, 1.50),
             ('tier_2', 2, 'model-medium', 0.30, 2.50),
             ('tier_3', 3, 'model-large',  0.75, 3.75)) AS t(tier, tier_ord, model_id, i, o)""",
    "routing_raw": """
SELECT d.doc_id AS key, d.source AS source_dataset, d.lang AS dataset_level, d.text AS prompt, d.text IS NOT NULL AS has_prompt,
       CASE WHEN d.doc_id % 10 < 6 THEN 'train' WHEN d.doc_id % 10 < 8 THEN 'validation' ELSE 'test' END AS split,
       CASE WHEN d.doc_id % 19 = 0 THEN NULL ELSE CAST((d.doc_id * 37 + 11) % 101 AS DOUBLE) / 100 END AS tier_1_score,
       CAST(LEAST(100, (d.doc_id * 53 + 29) % 101 + 10) AS DOUBLE) / 100 AS tier_2_score,
       CASE WHEN d.doc_id % 23 = 0 THEN NULL ELSE CAST(LEAST(100, (d.doc_id * 71 + 47) % 101 + 30) AS DOUBLE) / 100 END AS tier_3_score,
       l.quality, l.toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "routing_scored": """
SELECT r.*,
       CAST(LEAST(1000, ((key * 37 + 11) % 101) * 9 + ((key * 17 + 5) % 101) * 1) AS DOUBLE) / 1000 AS tier_1_probability,
       CAST(LEAST(1000, ((key * 53 + 29) % 101 + 10) * 9 + ((key * 29 + 3) % 101) * 1) AS DOUBLE) / 1000 AS tier_2_probability,
       CAST(LEAST(1000, ((key * 71 + 47) % 101 + 30) * 9 + ((key * 41 + 7) % 101) * 1) AS DOUBLE) / 1000 AS tier_3_probability
FROM routing_raw r""",
    "requests": """
SELECT CAST(o_orderkey AS STRING) AS request_id, o_orderdate AS created_at,
       CASE WHEN o_orderkey % 3 = 0 THEN 'economy' ELSE 'balanced' END AS mode,
       CASE WHEN o_orderpriority IN ('1-URGENT') THEN 'complex' WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 'moderate' ELSE 'simple' END AS category,
       CAST((o_orderkey * 37 + o_custkey) % 1001 AS DOUBLE) / 1000 AS tier_1_probability,
       CAST((o_orderkey * 53 + o_custkey * 3) % 1001 AS DOUBLE) / 1000 AS tier_2_probability,
       CAST((o_orderkey * 71 + o_custkey * 7) % 1001 AS DOUBLE) / 1000 AS tier_3_probability
FROM orders""",
    "candidates": """
SELECT request_id, tier_ord, tier, qty * 20 AS input_tokens, part + 50 * n AS output_tokens,
       CASE WHEN tier_ord = 3 THEN think ELSE 0 END AS thinking_tokens,
       CAST(cents AS DOUBLE) / 1000 AS generation_latency_ms, CAST(tax * 100 AS DOUBLE) AS judge_latency_ms,
       qty * 20 + part + 200 AS judge_input_tokens, CAST(30 AS BIGINT) AS judge_output_tokens,
       CASE WHEN odd = 0 THEN NULL
            WHEN odd = 1 THEN CONCAT('SCORE: ', score, CHR(10), reason)
            WHEN odd = 2 THEN CONCAT('VERDICT: ', verdict, CHR(10), reason)
            WHEN odd = 3 THEN CONCAT('VERDICT: ', verdict, CHR(10), 'SCORE: 1.5', CHR(10), reason)
            ELSE CONCAT('VERDICT: ', verdict, CHR(10), 'SCORE: ', score, CHR(10), reason) END AS judge_text
FROM (
  SELECT CAST(l_orderkey AS STRING) AS request_id, CAST((l_linenumber - 1) % 3 + 1 AS INT) AS tier_ord,
         CONCAT('tier_', CAST((l_linenumber - 1) % 3 + 1 AS STRING)) AS tier,
         CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty, CAST(SUM(l_partkey % 900) AS BIGINT) AS part,
         CAST(SUM(l_suppkey % 200) AS BIGINT) AS think,
         CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents,
         CAST(SUM(CAST(ROUND(l_tax * 100) AS BIGINT)) AS BIGINT) AS tax, COUNT(*) AS n,
         CASE WHEN MIN(l_linestatus) = 'F' THEN 'PASS' ELSE 'FAIL' END AS verdict,
         CASE WHEN MAX(l_discount) < 0.005 THEN '1.0'
              ELSE CONCAT('0.', CAST(100 - 4 * CAST(ROUND(MAX(l_discount) * 100) AS INT) AS STRING)) END AS score,
         CONCAT('REASON: flag ', MIN(l_returnflag)) AS reason, MAX(l_partkey) % 29 AS odd
  FROM lineitem GROUP BY l_orderkey, (l_linenumber - 1) % 3 + 1) x""",
    "usage_events": """
SELECT CAST(event_id AS STRING) AS request_id, ts AS created_at,
       CASE WHEN event_type IN ('click', 'view') THEN 'economy' ELSE 'balanced' END AS mode,
       CASE WHEN event_type IN ('click', 'error') THEN 'tier_1' WHEN event_type = 'view' THEN 'tier_2' ELSE 'tier_3' END AS final_tier,
       CAST(REGEXP_EXTRACT(props, '([0-9]+)', 1) AS BIGINT) AS input_tokens,
       CAST(REGEXP_EXTRACT(props, '([0-9]+)', 1) AS BIGINT) * 7 AS output_tokens,
       value * 10 AS total_latency_ms
FROM events""",
    "qa_pairs": """
SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS answer
FROM conversations u LEFT JOIN conversations a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
WHERE u.role = 'user'""",
}

VIEW_ORDER = ["price", "routing_raw", "routing_scored", "requests", "candidates",
              "usage_events", "qa_pairs"]

VIEW_BUILDERS = {
    "routing_raw": routing_raw,
    "routing_scored": routing_scored,
    "requests": requests,
    "candidates": candidates,
    "usage_events": usage_events,
    "qa_pairs": qa_pairs,
}


def with_views(body: str, extra_ctes: list[tuple[str, str]] | None = None) -> str:
    """Prefix an oracle query with the fixture views it names, as CTEs."""
    ctes = []
    needed = set()
    text = body + " " + " ".join(sql for _, sql in (extra_ctes or []))
    for name in reversed(VIEW_ORDER):
        if name in needed or _mentions(text, name):
            needed.add(name)
            text += " " + VIEW_SQL[name]
    for name in VIEW_ORDER:
        if name in needed:
            ctes.append(f"{name} AS ({VIEW_SQL[name]}\n)")
    for name, sql in extra_ctes or []:
        ctes.append(f"{name} AS ({sql}\n)")
    if not ctes:
        return body
    return "WITH " + ",\n".join(ctes) + "\n" + body


def _mentions(text: str, name: str) -> bool:
    import re
    return re.search(rf"\b{name}\b", text) is not None
