"""Registered queries: prompt features, gate, TF-IDF, scaling, classifier metrics."""
from __future__ import annotations

from pyspark.sql import functions as F

from tierflow.constants import (CODE_MARKERS, PY_SPACE_CLASS, REASONING_KEYWORDS,
                                TECHNICAL_KEYWORDS, TFIDF_MAX_FEATURES, TFIDF_MIN_DF, WORD_CLASS)
from tierflow.functions.routing import binary_target
from tierflow.functions.text import FEATURE_NAMES, feature_columns, gate_columns
from tierflow.session import materialize
from tierflow.operators import text_model as T
from tierflow.operators.labels import complete_rows
from tierflow.sources import views as V
from tierflow.sources.tables import read_table


def _docs(spark, sf):
    return read_table(spark, sf, "documents", "doc_id", "text").select(
        F.col("doc_id").alias("key"), F.col("text").alias("prompt"))


def gate_input(spark, sf):
    """Documents as prompts, each with a request mode derived from its id
    (clean, padded/mixed-case, missing and unsupported modes all occur)."""
    k = F.col("doc_id")
    mode = (F.when(k % 4 == 0, F.lit("economy")).when(k % 4 == 1, F.lit(" Balanced "))
            .when(k % 4 == 2, F.lit(None).cast("string")).otherwise(F.lit("premium")))
    return read_table(spark, sf, "documents", "doc_id", "text").select(
        k.alias("key"), F.col("text").alias("prompt"), mode.alias("mode"))


def q_prompt_gate(spark, sf):
    g = gate_input(spark, sf)
    cols = gate_columns(F.col("prompt"), F.col("mode"))
    return g.select("key", F.length("prompt").cast("int").alias("prompt_chars"),
                    *[c.alias(n) for n, c in cols.items()])


def q_tfidf_weights(spark, sf):
    raw = V.routing_raw(spark, sf, with_labels=False).select("key", "prompt", "split")
    vocab, _ = T.fit_tfidf(raw.where(F.col("split") == "train"))
    return T.tfidf_weights(raw, vocab).select("key", "term", F.round("weight", 9).alias("weight"))


def q_scaled_features(spark, sf):
    """M2: one pass over the text computes the 8 features for every document
    (kept as a written table: 8 integers per document), the train split's
    exact moments are fitted from it, and the scaling is a projection."""
    raw = V.routing_raw(spark, sf, with_labels=False)
    cols = feature_columns(F.col("prompt"))
    feats = raw.select("key", "split", "tier_1_score", "tier_2_score", "tier_3_score",
                       *[c.alias(n) for n, c in cols.items()])
    feats = materialize(feats, "prompt-features")
    stats = T.fit_scaler(complete_rows(feats.where(F.col("split") == "train")))
    scaled = T.apply_scaler(feats, stats, keep=("key", "split"))
    return scaled.select("key", "split", *[F.round(c, 9).alias(c) for c in FEATURE_NAMES])


def long_scores(spark, sf, split="validation"):
    """(key, tier, p, y): one row per prompt and tier from the scored view."""
    rows = complete_rows(V.routing_scored(spark, sf, with_labels=False).where(F.col("split") == split),
                         need_prompt=True)
    entries = [F.struct(F.lit(f"tier_{k}").alias("tier"),
                        F.col(f"tier_{k}_probability").alias("p"),
                        binary_target(f"tier_{k}_score").alias("y")) for k in (1, 2, 3)]
    return rows.select("key", F.inline(F.array(*entries)))


def q_classifier_metrics(spark, sf):
    return T.classifier_metrics(long_scores(spark, sf), "tier", "p", "y")


SPARK = {
    "prompt_features": lambda s, d: T.prompt_features(_docs(s, d)),
    "prompt_gate": q_prompt_gate,
    "tfidf_weights": q_tfidf_weights,
    "scaled_features": q_scaled_features,
    "classifier_metrics": q_classifier_metrics,
}


# ---------------------------------------------------------------------------
# Oracle SQL (DuckDB; RE2 regexes)
# ---------------------------------------------------------------------------
def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _contains_sum(col, words):
    return "(" + " + ".join(f"CAST(contains({col}, {_q(w)}) AS INT)" for w in words) + ")"


def features_sql(text: str) -> str:
    low = f"lower({text})"
    code = " OR ".join(f"contains({text}, {_q(m)})" for m in CODE_MARKERS)
    return f"""
       CAST(len(regexp_extract_all({low}, '[{WORD_CLASS}]+')) AS INT) AS word_count,
       CAST(length({text}) AS INT) AS character_count,
       CAST(len(list_filter(regexp_split_to_array({text}, '[.!?]+'),
                            lambda x: regexp_matches(x, '[^{PY_SPACE_CLASS}]'))) AS INT) AS sentence_count,
       CAST(length({text}) - length(replace({text}, '?', '')) AS INT) AS question_count,
       CAST(length({text}) - length(replace({text}, chr(10), '')) AS INT) AS newline_count,
       CAST({_contains_sum(low, REASONING_KEYWORDS)} AS INT) AS reasoning_keyword_count,
       CAST({_contains_sum(low, TECHNICAL_KEYWORDS)} AS INT) AS technical_keyword_count,
       CAST(({code}) AS INT) AS has_code"""


_WS = f"[{PY_SPACE_CLASS}]"
def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"

_TF = f"""
SELECT key, term, COUNT(*) AS tf FROM (
  SELECT key, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term
  FROM (SELECT key, regexp_extract_all(lower(prompt), '[{WORD_CLASS}]{{2,}}') AS t FROM routing_raw) a) b
GROUP BY key, term"""

_VOCAB = f"""
SELECT term, df, ln(CAST(1 + (SELECT COUNT(*) FROM routing_raw WHERE split = 'train') AS DOUBLE) / (df + 1)) + 1 AS idf
FROM (SELECT term, COUNT(*) AS df, SUM(tf) AS cf FROM tf
      WHERE key IN (SELECT key FROM routing_raw WHERE split = 'train') GROUP BY term) s
WHERE df >= {TFIDF_MIN_DF}
ORDER BY cf DESC, term LIMIT {TFIDF_MAX_FEATURES}"""

_FEATS = f"SELECT key, split, tier_1_score, tier_2_score, tier_3_score, {features_sql('prompt')} FROM routing_raw"


def _moments():
    cols = []
    for c in FEATURE_NAMES:
        cols.append(f"CAST(SUM(CAST({c} AS BIGINT)) AS HUGEINT) AS sx_{c}, "
                    f"CAST(SUM(CAST({c} AS BIGINT) * CAST({c} AS BIGINT)) AS HUGEINT) AS sxx_{c}")
    return ("SELECT CAST(COUNT(*) AS HUGEINT) AS n, " + ", ".join(cols) +
            " FROM feats WHERE split = 'train' AND tier_1_score IS NOT NULL "
            "AND tier_2_score IS NOT NULL AND tier_3_score IS NOT NULL")


def _scaled_cols():
    out = []
    for c in FEATURE_NAMES:
        mean = f"(CAST(sx_{c} AS DOUBLE) / CAST(n AS DOUBLE))"
        var = f"(CAST(n * sxx_{c} - sx_{c} * sx_{c} AS DOUBLE) / CAST(n * n AS DOUBLE))"
        scale = f"(CASE WHEN sqrt({var}) = 0 THEN 1.0 ELSE sqrt({var}) END)"
        out.append(f"ROUND((CAST({c} AS DOUBLE) - {mean}) / {scale}, 9) AS {c}")
    return ", ".join(out)


_LONG = """
SELECT key, v.tier, v.p, v.y FROM (
  SELECT * FROM routing_scored WHERE split = 'validation' AND tier_1_score IS NOT NULL
    AND tier_2_score IS NOT NULL AND tier_3_score IS NOT NULL AND prompt IS NOT NULL) r,
LATERAL (VALUES ('tier_1', tier_1_probability, CAST(COALESCE(tier_1_score >= CAST(0.8 AS DOUBLE), FALSE) AS INT)),
                ('tier_2', tier_2_probability, CAST(COALESCE(tier_2_score >= CAST(0.8 AS DOUBLE), FALSE) AS INT)),
                ('tier_3', tier_3_probability, CAST(COALESCE(tier_3_score >= CAST(0.8 AS DOUBLE), FALSE) AS INT)))
  AS v(tier, p, y)"""


def _sf(num, den):
    return f"CASE WHEN ({den}) > 0 THEN CAST({num} AS DOUBLE) / ({den}) ELSE 0.0 END"


_METRICS = f"""
SELECT c.tier, n, tp, fp, tn, fn,
       {_sf('tp + tn', 'n')} AS accuracy,
       ({_sf('tn', 'tn + fp')} + {_sf('tp', 'tp + fn')}) / 2 AS balanced_accuracy,
       {_sf('tp', 'tp + fp')} AS precision_1, {_sf('tp', 'tp + fn')} AS recall_1,
       {_sf('2 * tp', '2 * tp + fp + fn')} AS f1_1, tp + fn AS support_1,
       {_sf('tn', 'tn + fn')} AS precision_0, {_sf('tn', 'tn + fp')} AS recall_0,
       {_sf('2 * tn', '2 * tn + fn + fp')} AS f1_0, tn + fp AS support_0,
       ({_sf('2 * tn', '2 * tn + fn + fp')} + {_sf('2 * tp', '2 * tp + fp + fn')}) / 2 AS macro_f1,
       {_sf(f"{_sf('2 * tn', '2 * tn + fn + fp')} * (tn + fp) + {_sf('2 * tp', '2 * tp + fp + fn')} * (tp + fn)", 'n')} AS weighted_f1,
       ({_sf('tn', 'tn + fn')} + {_sf('tp', 'tp + fp')}) / 2 AS macro_precision,
       {_sf(f"{_sf('tn', 'tn + fn')} * (tn + fp) + {_sf('tp', 'tp + fp')} * (tp + fn)", 'n')} AS weighted_precision,
       ({_sf('tn', 'tn + fp')} + {_sf('tp', 'tp + fn')}) / 2 AS macro_recall,
       {_sf(f"{_sf('tn', 'tn + fp')} * (tn + fp) + {_sf('tp', 'tp + fn')} * (tp + fn)", 'n')} AS weighted_recall,
       a.roc_auc
FROM (SELECT tier, COUNT(*) AS n,
             CAST(SUM(CAST(p > 0.5 AND y = 1 AS INT)) AS BIGINT) AS tp,
             CAST(SUM(CAST(p > 0.5 AND y = 0 AS INT)) AS BIGINT) AS fp,
             CAST(SUM(CAST(p <= 0.5 AND y = 0 AS INT)) AS BIGINT) AS tn,
             CAST(SUM(CAST(p <= 0.5 AND y = 1 AS INT)) AS BIGINT) AS fn
      FROM long GROUP BY tier) c
LEFT JOIN (
  SELECT tier, CASE WHEN SUM(pos) > 0 AND SUM(neg) > 0 THEN
           CAST(SUM(CAST(pos AS HUGEINT) * below * 2 + CAST(pos AS HUGEINT) * neg) AS DOUBLE)
           / CAST(CAST(SUM(pos) AS HUGEINT) * SUM(neg) * 2 AS DOUBLE) END AS roc_auc
  FROM (SELECT tier, score, pos, neg,
               COALESCE(SUM(neg) OVER (PARTITION BY tier ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
        FROM (SELECT tier, p AS score, SUM(y) AS pos, SUM(1 - y) AS neg FROM long GROUP BY tier, p) d) e
  GROUP BY tier) a ON a.tier = c.tier"""

ORACLE = {
    "prompt_features": ([], f"SELECT doc_id AS key, {features_sql('text')} FROM documents"),
    "prompt_gate": ([], f"""
SELECT key, CAST(length(prompt) AS INT) AS prompt_chars, clean_mode, reason IS NULL AS accepted, reason AS reject_reason
FROM (SELECT key, prompt, clean_mode,
             CASE WHEN prompt IS NULL THEN 'missing_prompt' WHEN length(prompt) < 1 THEN 'empty_prompt'
                  WHEN length(prompt) > 20000 THEN 'prompt_too_long'
                  WHEN length({_strip('prompt')}) = 0 THEN 'blank_prompt'
                  WHEN clean_mode NOT IN ('economy', 'balanced') THEN 'unsupported_mode' END AS reason
      FROM (SELECT doc_id AS key, text AS prompt,
                   COALESCE(lower({_strip('m')}), 'balanced') AS clean_mode
            FROM (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'economy' WHEN 1 THEN ' Balanced '
                                 WHEN 2 THEN NULL ELSE 'premium' END AS m FROM documents) d) e) f"""),
    "tfidf_weights": ([("tf", _TF), ("vocab", _VOCAB)], """
SELECT key, term, ROUND(w / sqrt(SUM(w * w) OVER (PARTITION BY key)), 9) AS weight
FROM (SELECT tf.key, tf.term, (1 + ln(CAST(tf.tf AS DOUBLE))) * v.idf AS w
      FROM tf JOIN vocab v ON v.term = tf.term) x"""),
    "scaled_features": ([("feats", _FEATS), ("moments", _moments())], f"""
SELECT key, split, {_scaled_cols()} FROM feats, moments"""),
    "classifier_metrics": ([("long", _LONG)], _METRICS),
}
