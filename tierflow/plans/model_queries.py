"""Registered queries: the learned router.  Trained predictions have no SQL oracle;
scoring with stated coefficients and the optimality of fits have one."""
from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from tierflow.operators.labels import complete_rows
from tierflow.operators import text_model as TM
from tierflow.constants import TIERS
from tierflow.functions.routing import binary_target
from tierflow.functions.text import FEATURE_NAMES
from tierflow.operators.learn import (FeatureModel, PromptFeatures, Router, RouterEstimator, TierModel, fit_base,
                                      fit_platt, gradient_norm, predict_linear, slopes_along_fit)
from tierflow.plans import text_queries
from tierflow.session import materialize
from tierflow.sources import views as V
from tierflow.sources.sinks import scratch_path
from tierflow.sources.tables import read_table


def q_predict_success(spark, sf):
    """M4-M8, A10: train on the train split as a pipeline, save it, load it and predict
    the test split with what was loaded, joined on key."""
    raw = V.routing_raw(spark, sf, with_labels=False)
    train = complete_rows(raw.where(F.col("split") == "train"), need_prompt=True)
    test = complete_rows(raw.where(F.col("split") == "test"), need_prompt=True)
    path = scratch_path(spark, "router")
    Pipeline(stages=[RouterEstimator()]).fit(train).write().overwrite().save(path)
    return PipelineModel.load(path).transform(test.select("key", "prompt", "split")).drop("prompt")


def q_calibration_report(spark, sf):
    """M5 check: Brier score before and after calibration on the validation split."""
    raw = V.routing_raw(spark, sf, with_labels=False)
    train = complete_rows(raw.where(F.col("split") == "train"), need_prompt=True)
    val = complete_rows(raw.where(F.col("split") == "validation"), need_prompt=True)
    return Router.train(train).calibration_report(val)


def q_quality_model_metrics(spark, sf):
    """M7 with the document-quality label as the target: the calibrated model
    trained on labelled train documents, scored on labelled validation
    documents, reported with the E20 metrics (confusion counts, AUC)."""
    raw = V.routing_raw(spark, sf, with_labels=True)
    lab = raw.where(F.col("quality").isNotNull() & F.col("prompt").isNotNull()).select(
        "key", "prompt", "split", F.col("quality").cast("int").alias("y"))
    train = lab.where(F.col("split") == "train")
    val = lab.where(F.col("split") == "validation")
    fm, vectors = FeatureModel.fit_transform(train.select("key", "prompt"))
    x = materialize(vectors.join(train.select("key", "y"), "key"), "quality-train")
    model = TierModel.fit(x)
    scored = model.predict(fm.transform(val.select("key", "prompt")).join(val.select("key", "y"), "key"), "p")
    return TM.classifier_metrics(scored.withColumn("target", F.lit("quality")), "target", "p", "y")


# stated coefficients of the fixed model
PLATT = [(0.9, 0.1), (1.1, -0.2), (1.0, 0.05)]
INTERCEPT = -0.1


def q_predict_fixed(spark, sf):
    """M6 with stated coefficients over this engine's TF-IDF weights and scaled
    features: a term's coefficient comes from its length and first code point,
    the k-th prompt feature's is (13 k + 7) mod 11 - 5 hundredths."""
    raw = V.routing_raw(spark, sf, with_labels=False).select("key", "prompt", "split")
    vocab, _ = TM.fit_tfidf(raw.where(F.col("split") == "train"))
    weights = TM.tfidf_weights(raw, vocab)
    scaled = text_queries.q_scaled_features(spark, sf)
    coef = ((F.length("term") * 37 + F.ascii(F.substring("term", 1, 1)) * 11) % 101 - 50).cast("double") / 100
    coefs = vocab.select("term", coef.alias("coef"))
    tail = {c: ((13 * k + 7) % 11 - 5) / 100 for k, c in enumerate(FEATURE_NAMES)}
    out = predict_linear(weights, scaled, coefs, INTERCEPT, tail, PLATT)
    return out.select("key", F.round("margin", 6).alias("margin"), F.round("probability", 6).alias("probability"))


def q_platt_fit(spark, sf):
    """M5: slope and intercept of the calibration of ``predict_fixed``'s margins against
    each tier's target, on the complete rows of the train split."""
    raw = V.routing_raw(spark, sf, with_labels=False)
    train = complete_rows(raw.where(F.col("split") == "train"), need_prompt=True).select(
        "key", *[binary_target(f"{t}_score").cast("int").alias(t) for t in TIERS])
    rows = materialize(train.join(q_predict_fixed(spark, sf).select("key", "margin"), "key"), "platt-rows")
    fits = [(t, *fit_platt(rows, "margin", t)) for t in TIERS]
    out = spark.createDataFrame(fits, "tier string, slope double, intercept double")
    return out.select("tier", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


GRADIENT_BOUND = 1e-2
#: The solution is moved along its own ray by these factors.
SCALES = [0.0, 0.5, 0.9, 0.95, 1.05, 1.1, 1.5, 2.0]


def q_fit_optimality(spark, sf):
    """M4: for each tier, the base model fitted on the train split is a minimum of its
    penalised loss: no component of the gradient exceeds the bound, and along the ray
    of the solution the loss falls up to it and rises from it on."""
    raw = V.routing_raw(spark, sf, with_labels=False)
    train = complete_rows(raw.where(F.col("split") == "train"), need_prompt=True)
    _, vectors = FeatureModel.fit_transform(train.select("key", "prompt"))
    x = materialize(vectors.join(train.select("key", *[f"{t}_score" for t in TIERS]), "key"), "optimality")
    rows = []
    for t in TIERS:
        y = x.select("key", "features", binary_target(f"{t}_score").alias("y"))
        model = fit_base(y)
        small = bool(gradient_norm(model, y) <= GRADIENT_BOUND)
        rows += [(t, s, "falls" if g < 0 else "rises", small) for s, g in zip(SCALES, slopes_along_fit(model, y, SCALES))]
    return spark.createDataFrame(rows, "tier string, scale double, loss string, optimal boolean")


def q_feature_pipeline(spark, sf):
    """Prompt features through a pipeline that was saved and loaded."""
    docs = read_table(spark, sf, "documents", "doc_id", "text").select(
        F.col("doc_id").alias("key"), F.col("text").alias("prompt"))
    path = scratch_path(spark, "feature-pipeline")
    Pipeline(stages=[PromptFeatures()]).fit(docs).write().overwrite().save(path)
    return PipelineModel.load(path).transform(docs).drop("prompt")


SPARK = {"predict_success": q_predict_success, "calibration_report": q_calibration_report,
         "quality_model_metrics": q_quality_model_metrics, "predict_fixed": q_predict_fixed,
         "platt_fit": q_platt_fit,
         "fit_optimality": q_fit_optimality, "feature_pipeline": q_feature_pipeline}

_MARGIN = " + ".join(["s", f"CAST({INTERCEPT} AS DOUBLE)"] + [
    f"{c} * CAST({((13 * k + 7) % 11 - 5) / 100} AS DOUBLE)" for k, c in enumerate(FEATURE_NAMES)])
_PROB = " + ".join(f"1.0 / (1.0 + exp(-(m * CAST({a} AS DOUBLE) + CAST({b} AS DOUBLE))))" for a, b in PLATT)

ORACLE: dict = {
    "predict_fixed": (
        [*text_queries.ORACLE["tfidf_weights"][0], ("weights", text_queries.ORACLE["tfidf_weights"][1]),
         *text_queries.ORACLE["scaled_features"][0], ("scaled", text_queries.ORACLE["scaled_features"][1])], f"""
SELECT key, ROUND(m, 6) AS margin, ROUND(({_PROB}) / {len(PLATT)}, 6) AS probability
FROM (SELECT key, {_MARGIN} AS m FROM (
  SELECT c.*, COALESCE(t.s, 0.0) AS s FROM scaled c LEFT JOIN (
    SELECT key, SUM(weight * CAST((length(term) * 37 + unicode(term) * 11) % 101 - 50 AS DOUBLE) / 100) AS s
    FROM weights GROUP BY key) t ON t.key = c.key) a) b"""),
    "fit_optimality": ([], f"""
SELECT tier, scale, CASE WHEN scale < 1 THEN 'falls' ELSE 'rises' END AS loss, COUNT(*) > 0 AS optimal
FROM routing_raw, (VALUES ('tier_1'), ('tier_2'), ('tier_3')) AS t(tier),
     (VALUES {", ".join(f"(CAST({s} AS DOUBLE))" for s in SCALES)}) AS v(scale)
WHERE split = 'train' GROUP BY tier, scale"""),
    "feature_pipeline": text_queries.ORACLE["prompt_features"],
}

# Twenty Newton rounds, one recursion each, from the same six sums less the loss.
_TARGETS = ", ".join(f"('{t}', CAST({t}_score >= CAST(0.8 AS DOUBLE) AS INT))" for t in TIERS)
ORACLE["platt_fit"] = (
    [*ORACLE["predict_fixed"][0], ("fixed", ORACLE["predict_fixed"][1])], f"""
SELECT tier, ROUND(a, 6) AS slope, ROUND(b, 6) AS intercept FROM (
  WITH RECURSIVE hits AS MATERIALIZED (
    SELECT v.tier, f.margin AS m, v.y FROM routing_raw r JOIN fixed f ON f.key = r.key,
      LATERAL (VALUES {_TARGETS}) AS v(tier, y)
    WHERE r.split = 'train' AND r.prompt IS NOT NULL AND r.tier_1_score IS NOT NULL
      AND r.tier_2_score IS NOT NULL AND r.tier_3_score IS NOT NULL),
  sizes AS MATERIALIZED (
    SELECT tier, CAST(SUM(y) AS DOUBLE) AS pos, CAST(SUM(1 - y) AS DOUBLE) AS neg FROM hits GROUP BY tier),
  aims AS MATERIALIZED (
    SELECT h.tier, h.m, CASE WHEN y = 1 THEN (pos + 1) / (pos + 2) ELSE 1 / (neg + 2) END AS t
    FROM hits h JOIN sizes s ON s.tier = h.tier),
  newton(k, tier, a, b) AS (
    SELECT 0, tier, CAST(0 AS DOUBLE), ln((pos + 1) / (neg + 1)) FROM sizes
    UNION ALL
    SELECT k + 1, tier, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab),
           b - (haa * gb - hab * ga) / (haa * hbb - hab * hab)
    FROM (SELECT k, tier, a, b, SUM((p - t) * m) AS ga, SUM(p - t) AS gb, SUM(p * (1 - p) * m * m) AS haa,
                 SUM(p * (1 - p) * m) AS hab, SUM(p * (1 - p)) AS hbb
          FROM (SELECT n.k, n.tier, n.a, n.b, x.m, x.t, 1 / (1 + exp(-(n.a * x.m + n.b))) AS p
                FROM newton n JOIN aims x ON x.tier = n.tier WHERE n.k < 20) q
          GROUP BY k, tier, a, b) g)
  SELECT * FROM newton WHERE k = 20) z""")
