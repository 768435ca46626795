"""Learning P(tier succeeds | prompt): features, calibrated logistic models.

M3  features = L2 TF-IDF (fit on train) ++ 8 population-scaled prompt
    features, as one sparse vector per document.  A document's terms are counted
    as a sparse vector by the vocabulary, so no row is made for a term.  The counts
    are written and read back as the struct that Spark ML stores for a vector, the
    weighted vectors are written as that struct and read back with the vector type as
    schema, so no Python runs per row.  Only where keys repeat is the long (key, index,
    weight) table folded by key with a sorted ``collect_list``.
M4  Spark ML ``LogisticRegression`` per tier with class-balanced weights
    n / (2 * n_class); with those weights summing to n, an L2 penalty of
    C = 1 is ``regParam = 1 / n`` (no standardisation, intercept free).
M5  sigmoid (Platt) calibration over 3 folds: per fold, fit M4 on the other
    two, take margins on the held-out fold, fit slope and intercept on them
    with Platt's smoothed targets by Newton steps from six sums a round.
    The margins are written once, so a round reads no vectors.
    The prediction averages the three calibrated models.  Folds are stratified: each class is dealt evenly in the
    order of a hash of the key; a class too small for the folds is an error.
M6  batch prediction = vector -> three margins -> calibrated mean.
M8  predictions are joined on ``key``, never aligned by row order.
"""
from __future__ import annotations

import json
import math
import os
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
                             MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tierflow.constants import CALIBRATION_FOLDS, LR_MAX_ITER, LR_TOL, SEED, TIERS
from tierflow.functions.routing import binary_target
from tierflow.functions.text import FEATURE_NAMES, feature_columns
from tierflow.operators import text_model as TM
from tierflow.operators.ranking import global_rank
from tierflow.session import checkpoint_path, materialize, storage_bytes


#: A sparse vector as Spark ML stores it.  A table with such a struct, read with
#: the vector type as its schema, is a column of vectors: no Python is run.
_VECTOR = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"


def as_vectors(df: DataFrame, size: int, idx: Column, val: Column, name: str) -> DataFrame:
    """df's other columns and ``features``, written once and read back as vectors."""
    keep = [c for c in df.columns if c not in ("__idx", "__val")]
    raw = df.select(*keep, F.struct(F.lit(0), F.lit(size), idx, val).cast(_VECTOR).alias("features"))
    path = checkpoint_path(df.sparkSession, f"tables/{name}-{uuid.uuid4().hex}")
    raw.write.parquet(path)
    schema = StructType([*[raw.schema[c] for c in keep], StructField("features", VectorUDT())])
    return df.sparkSession.read.schema(schema).parquet(path)


#: An entry of a sparse vector in memory: its index and its value
ENTRY_BYTES = 12

#: Entries of one task of a round, in bytes. A task costs a round a dense array of all coefficients, and
#: holds its rows once more while they are cached, read back from disk or sent to another executor
ROUND_BYTES = 32 << 20

#: Rows of a fit aren't spread evenly: the share of the executors' storage that fits side by side may take
STORAGE_SHARE = 0.8

#: Rows go to the solver in blocks; each costs it a dense array of all coefficients a round
BLOCK_MB = 16.0

#: Newton rounds, the step at which they end, and the ridge of an idle parameter
PLATT_ROUNDS, PLATT_STEP, PLATT_RIDGE = 50, 1e-10, 1e-12


class FeatureModel:
    """Fitted M1 + M2: vocabulary (term -> index, idf) and scaler moments."""

    def __init__(self, vocab: DataFrame, n_terms: int, n_docs: int, scaler: dict):
        self.vocab, self.n_terms, self.n_docs, self.scaler = vocab, n_terms, n_docs, scaler
        self._counter = None

    @property
    def size(self) -> int:
        return self.n_terms + len(FEATURE_NAMES)

    @staticmethod
    def fit(docs: DataFrame, key: str = "key", text: str = "prompt") -> "FeatureModel":
        vocab, n_docs = TM.fit_tfidf(docs, key, text)  # bounded: max_features rows, indexed in the order of terms
        n_terms = vocab.count()
        feats = TM.prompt_features(docs, key, text)
        return FeatureModel(vocab, n_terms, n_docs, TM.fit_scaler(feats))

    @staticmethod
    def fit_transform(docs: DataFrame, key: str = "key", text: str = "prompt") -> tuple["FeatureModel", DataFrame]:
        """``fit`` and ``transform`` of the same documents; their prompt features are computed once."""
        vocab, n_docs = TM.fit_tfidf(docs, key, text)
        model = FeatureModel(vocab, vocab.count(), n_docs, {})
        counted = model._counted(docs, key, text)
        model.scaler = TM.fit_scaler(counted)
        return model, model._vectors(counted, key)

    def transform(self, docs: DataFrame, key: str = "key", text: str = "prompt") -> DataFrame:
        return self._vectors(self._counted(docs, key, text), key)

    def _counted(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        """(key, prompt features, idx, weight), unscaled, from a table that is written."""
        if TM.keys_repeat(docs, key):  # rows of a key are one document
            w = TM.tfidf_weights(docs, self.vocab, key, text)
            packed = w.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("idx", "weight"))).alias("tw"))
            j = TM.prompt_features(docs, key, text).join(packed, key, "left")
            return materialize(j.select(key, *FEATURE_NAMES, "tw.idx", "tw.weight"), "weights")
        if self._counter is None:
            self._counter = TM.term_counter(self.vocab)
        counter, idf = self._counter
        plain = docs.select(key, text, *[c.alias(n) for n, c in feature_columns(F.col(text)).items()])
        counts = TM.count_terms(plain, counter, key, text, tuple(FEATURE_NAMES))
        path = checkpoint_path(docs.sparkSession, f"tables/counts-{uuid.uuid4().hex}")
        counts.write.parquet(path)
        stored = StructType([*counts.drop("tf").schema, StructField("tf", VectorUDT.sqlType())])
        idx, weight = TM.tfidf_arrays("tf", idf)
        return docs.sparkSession.read.schema(stored).parquet(path).select(
            key, *FEATURE_NAMES, idx.alias("idx"), weight.alias("weight"))

    def _vectors(self, counted: DataFrame, key: str) -> DataFrame:
        j = TM.apply_scaler(counted, self.scaler, keep=(key, "idx", "weight"))
        tail_idx = F.array(*[F.lit(self.n_terms + i) for i in range(len(FEATURE_NAMES))])
        tail_val = F.array(*[F.col(c) for c in FEATURE_NAMES])
        idx = F.concat(F.coalesce("idx", F.array().cast("array<int>")), tail_idx)
        val = F.concat(F.coalesce("weight", F.array().cast("array<double>")), tail_val)
        return as_vectors(j.select(key, idx.alias("__idx"), val.alias("__val")), self.size,
                          F.col("__idx"), F.col("__val"), "features")

    def save(self, path: str) -> None:
        self.vocab.select("term", "df", "idf", "idx").write.mode("overwrite").parquet(f"{path}/vocabulary")
        meta = {"n_terms": self.n_terms, "n_docs": self.n_docs,
                "scaler": {k: list(v) for k, v in self.scaler.items()}}
        self.vocab.sparkSession.createDataFrame([(json.dumps(meta),)], "meta string") \
            .write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "FeatureModel":
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        vocab = spark.read.parquet(f"{path}/vocabulary")
        return FeatureModel(vocab, meta["n_terms"], meta["n_docs"],
                            {k: tuple(v) for k, v in meta["scaler"].items()})


def materialize_vectors(df: DataFrame, name: str) -> DataFrame:
    """Write a table with ``features`` once for the many passes of a fit."""
    return materialize(df, name)


def entry_bytes(written: DataFrame) -> int:
    """What the vectors of a written table hold in memory: lengths of the indices of the stored struct."""
    files = written.inputFiles()
    if not files:
        return 0
    stored = written.sparkSession.read.schema(f"features {_VECTOR}").parquet(*files)
    return ENTRY_BYTES * (stored.agg(F.sum(F.size("features.indices"))).first()[0] or 0)


def fits_at_once(spark: SparkSession, size: int, most: int, folds: int = CALIBRATION_FOLDS) -> int:
    """How many fits of a table's vectors, each of all folds but one, the executors can keep in memory side
    by side; one at least. A fit reads all its rows in each of its some hundred rounds, and what others
    have driven out of memory it reads from disk."""
    room = int(STORAGE_SHARE * storage_bytes(spark))
    return max(1, min(most, room // max(size * (folds - 1) // folds, 1)))


def few_parts(df: DataFrame, size: int = 0) -> DataFrame:
    """df in as many partitions as tasks of ``ROUND_BYTES`` need, and every core two; rows aren't exchanged."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-size // ROUND_BYTES)))


def stratified_folds(df: DataFrame, label: str = "y", folds: int = CALIBRATION_FOLDS, key: str = "key") -> DataFrame:
    """df with ``fold``, joined on key; see ``dealt_folds``."""
    return df.join(dealt_folds(df, label, folds, key), key)


def dealt_folds(df: DataFrame, label: str = "y", folds: int = CALIBRATION_FOLDS, key: str = "key") -> DataFrame:
    """(key, fold): each class is dealt evenly to the folds in the order of a
    hash of the key.  A class with fewer rows than folds is an error."""
    small = df.groupBy(label).count().collect()  # two rows
    if len(small) < 2 or any(r["count"] < folds for r in small):
        raise ValueError(f"each class needs at least {folds} rows, found {[tuple(r) for r in small]}")
    h = F.xxhash64(F.col(key), F.lit(SEED))
    dealt = global_rank(df.select(key, label), [label], [h, F.col(key)], "__rank", "folds")
    return dealt.select(key, (F.col("__rank") % folds).cast("int").alias("fold"))


def _balanced(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """Class-balanced weights n / (2 * n_class) over ``df`` (counts via one agg)."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label)).alias("pos")).first()
    n, pos = int(row["n"]), int(row["pos"] or 0)
    neg = n - pos
    w1 = n / (2.0 * pos) if pos else 0.0
    w0 = n / (2.0 * neg) if neg else 0.0
    return df.withColumn("w", F.when(F.col(label) == 1, F.lit(w1)).otherwise(F.lit(w0))), n


def fit_base(df: DataFrame, label: str = "y") -> LogisticRegressionModel:
    weighted, n = _balanced(df, label)
    lr = LogisticRegression(featuresCol="features", labelCol=label, weightCol="w",
                            maxIter=LR_MAX_ITER, tol=LR_TOL, regParam=1.0 / max(n, 1),
                            elasticNetParam=0.0, standardization=False, fitIntercept=True,
                            maxBlockSizeInMB=BLOCK_MB)
    model = lr.fit(weighted)
    return model


def margin(model: LogisticRegressionModel, df: DataFrame, out: str) -> DataFrame:
    """Class-1 margin."""
    m = vector_to_array("rawPrediction")[1]
    return model.transform(df).select(*df.columns, m.alias(out))


def fit_platt(margins: DataFrame, m: str, label: str = "y", rounds: int = PLATT_ROUNDS) -> tuple[float, float]:
    """Platt scaling with smoothed targets: (a, b) of P = 1 / (1 + exp(-(a m + b))) at
    the minimum of the cross entropy, without penalty.

    Newton steps; a round is one aggregation of six sums (the loss, its two first
    and three second derivatives), so no row is moved or doubled. A step that
    raises the loss is halved. Rows without margin or label are left out; no
    rows at all is an error. Where one parameter is idle (equal margins), a tiny ridge keeps it still.
    """
    rows = margins.select(F.col(m).cast("double").alias("m"), F.col(label).alias("y")).dropna()
    row = rows.agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n")).first()
    pos, n = int(row["pos"] or 0), int(row["n"])
    if n == 0:
        raise ValueError("no rows to calibrate on")
    neg = n - pos
    t = F.when(F.col("y") == 1, F.lit((pos + 1.0) / (pos + 2.0))).otherwise(F.lit(1.0 / (neg + 2.0)))

    def sums(a: float, b: float):
        z = F.col("m") * F.lit(a) + F.lit(b)
        p = 1.0 / (1.0 + F.exp(-z))
        loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - t * z
        w = p * (1.0 - p)
        return rows.agg(F.sum(loss), F.sum((p - t) * F.col("m")), F.sum(p - t),
                        F.sum(w * F.col("m") * F.col("m")), F.sum(w * F.col("m")), F.sum(w)).first()

    a, b = 0.0, math.log((pos + 1.0) / (neg + 1.0))
    loss, ga, gb, haa, hab, hbb = sums(a, b)
    for _ in range(rounds):
        haa, hbb = haa + PLATT_RIDGE, hbb + PLATT_RIDGE
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        if max(abs(da), abs(db)) < PLATT_STEP:
            break
        new = sums(a - da, b - db)
        while new[0] > loss * (1 + 1e-12) and max(abs(da), abs(db)) >= PLATT_STEP:
            da, db = da / 2, db / 2
            new = sums(a - da, b - db)
        a, b = a - da, b - db
        loss, ga, gb, haa, hab, hbb = new
    return a, b


class TierModel:
    """Three (base, Platt) pairs for one tier."""

    def __init__(self, pairs: list[tuple[LogisticRegressionModel, tuple[float, float]]]):
        self.pairs = pairs

    @staticmethod
    def fit_pair(train: DataFrame, k: int, label: str = "y", folds: int = CALIBRATION_FOLDS):
        """Fold k: base model on the other folds, Platt model on fold k's margins.
        ``train`` has ``fold`` (see ``stratified_folds``)."""
        f = F.col("fold")
        base = fit_base(train.where(f != k), label)
        held = margin(base, train.where(f == k).select("features", label), "m").select("m", label)
        return base, fit_platt(materialize(few_parts(held), "margins"), "m", label)

    @staticmethod
    def fit(train: DataFrame, label: str = "y", folds: int = CALIBRATION_FOLDS) -> "TierModel":
        """The folds are independent jobs: submit them side by side, as far as they fit in memory."""
        train = materialize_vectors(stratified_folds(train, label, folds), "tier-train")
        size = entry_bytes(train)
        train = few_parts(train, size)
        with ThreadPoolExecutor(max_workers=fits_at_once(train.sparkSession, size, folds, folds)) as pool:
            futs = [pool.submit(TierModel.fit_pair, train, k, label, folds) for k in range(folds)]
            return TierModel([f.result() for f in futs])

    def predict(self, feats: DataFrame, out: str, uncalibrated: str | None = None) -> DataFrame:
        """Mean of the calibrated fold models' P(class 1); optionally also the
        mean of the base models' own probabilities (before calibration)."""
        df = feats
        probs, raw = [], []
        for i, (base, (a, b)) in enumerate(self.pairs):
            df = margin(base, df, f"__m{i}")
            probs.append(1.0 / (1.0 + F.exp(-(F.col(f"__m{i}") * a + b))))
            raw.append(1.0 / (1.0 + F.exp(-F.col(f"__m{i}"))))

        def mean(cols):
            total = cols[0]
            for c in cols[1:]:
                total = total + c
            return total / len(cols)

        df = df.withColumn(out, mean(probs))
        if uncalibrated:
            df = df.withColumn(uncalibrated, mean(raw))
        return df.drop(*[f"__m{i}" for i in range(len(self.pairs))])

    def save(self, path: str) -> None:
        for i, (base, platt) in enumerate(self.pairs):
            base.write().overwrite().save(f"{path}/fold_{i}/base")
            SparkSession.active().createDataFrame([platt], "a double, b double").coalesce(1) \
                .write.mode("overwrite").parquet(f"{path}/fold_{i}/platt")

    @staticmethod
    def load(path: str, folds: int = CALIBRATION_FOLDS) -> "TierModel":
        return TierModel([(LogisticRegressionModel.load(f"{path}/fold_{i}/base"),
                           tuple(SparkSession.active().read.parquet(f"{path}/fold_{i}/platt").first()))
                          for i in range(folds)])


def brier_report(scored: DataFrame, label: str, calibrated: str, uncalibrated: str) -> DataFrame:
    """Brier score (mean squared error of the probability) before and after
    calibration: one global aggregation."""
    y = F.col(label).cast("double")
    return scored.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg((F.col(uncalibrated) - y) * (F.col(uncalibrated) - y)).alias("brier_uncalibrated"),
        F.avg((F.col(calibrated) - y) * (F.col(calibrated) - y)).alias("brier_calibrated"))


def predict_linear(weights: DataFrame, scaled: DataFrame, coefficients: DataFrame, intercept: float,
                   tail: dict[str, float], platt: list[tuple[float, float]], key: str = "key") -> DataFrame:
    """M6 from stated coefficients, relationally: the margin of each document from
    its term weights (key, term, weight), the terms' coefficients (term, coef)
    and its scaled features, then the mean of the calibrated probabilities."""
    terms = weights.join(F.broadcast(coefficients), "term").groupBy(key).agg(
        F.sum(F.col("weight") * F.col("coef")).alias("__m"))
    m = F.coalesce("__m", F.lit(0.0)) + F.lit(intercept)
    for c, w in tail.items():
        m = m + F.col(c) * F.lit(w)
    probs = [1.0 / (1.0 + F.exp(-(F.col("margin") * a + b))) for a, b in platt]
    mean = probs[0]
    for p in probs[1:]:
        mean = mean + p
    return scaled.join(terms, key, "left").select(key, m.alias("margin")).select(
        key, "margin", (mean / len(probs)).alias("probability"))


def slopes_along_fit(model: LogisticRegressionModel, df: DataFrame, scales: list[float], label: str = "y") -> list[float]:
    """Slope of the weighted, penalised mean loss where the solution's coefficients and
    intercept are multiplied by each of ``scales``, in the direction of growth: below
    zero before the minimum of that ray, above it after. One aggregation."""
    weighted, n = _balanced(df, label)
    m, y, w = F.col("__m"), F.col(label), F.col("w")
    sums = [F.sum(w * (1.0 / (1.0 + F.exp(-m * F.lit(float(s)))) - y) * m) for s in scales]
    row = margin(model, weighted, "__m").agg(F.sum("w"), *sums).first()
    penalty = float((model.coefficients.toArray() ** 2).sum()) / n
    return [g / row[0] + s * penalty for s, g in zip(scales, row[1:])]


def gradient_norm(model: LogisticRegressionModel, df: DataFrame, label: str = "y") -> float:
    """Largest component of the gradient of the weighted, penalised mean loss at
    the model's solution, from the vectors' stored entries."""
    weighted, n = _balanced(df, label)
    scored = margin(model, weighted, "__m")
    r = F.col("w") * (1.0 / (1.0 + F.exp(-F.col("__m"))) - F.col(label))
    path = checkpoint_path(df.sparkSession, f"tables/gradient-{uuid.uuid4().hex}")
    scored.select("features", r.alias("r")).write.parquet(path)
    rows = df.sparkSession.read.schema(f"features {_VECTOR}, r double").parquet(path)
    cells = rows.select("r", F.explode(F.arrays_zip("features.indices", "features.values")).alias("c"))
    sums = cells.groupBy(F.col("c.indices").alias("i")).agg(F.sum(F.col("r") * F.col("c.values")).alias("g"))
    total = weighted.agg(F.sum("w")).first()[0]
    beta = df.sparkSession.createDataFrame(
        [(i, float(b)) for i, b in enumerate(model.coefficients.toArray())], "i int, b double")
    g = beta.join(sums, "i", "left").select(
        F.abs(F.coalesce("g", F.lit(0.0)) / F.lit(total) + F.col("b") / F.lit(float(n))).alias("g"))
    bias = abs(rows.agg(F.sum("r")).first()[0] / total)
    return max(g.agg(F.max("g")).first()[0], bias)


class PromptFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """The eight prompt features as a pipeline stage that can be saved."""

    text = Param(Params._dummy(), "text", "column of the prompts", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, text: str = "prompt"):
        super().__init__()
        self._setDefault(text="prompt")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.select("*", *[c.alias(n) for n, c in feature_columns(F.col(self.getOrDefault(self.text))).items()])


class Router:
    """M7: one shared feature model and three calibrated tier models."""

    def __init__(self, features: FeatureModel, tiers: dict[str, TierModel], config: dict):
        self.features, self.tiers, self.config = features, tiers, config

    @staticmethod
    def train(train_rows: DataFrame, config: dict | None = None, parallelism: int | None = None) -> "Router":
        fm, vectors = FeatureModel.fit_transform(train_rows.select("key", "prompt"))
        scores = train_rows.select("key", *[binary_target(f"{t}_score").alias(t) for t in TIERS])
        # The folds are dealt by key and label alone. The vectors are joined with the labels and
        # folds of all tiers at once; a key has a list of folds, one if it doesn't repeat.
        labels = materialize(vectors.select("key").join(scores, "key"), "router-labels")
        x = vectors.join(scores, "key")
        for t in TIERS:
            x = x.join(dealt_folds(labels, t).groupBy("key").agg(F.collect_list("fold").alias(f"{t}_folds")), "key")
        x = materialize_vectors(x, "router-train")
        size = entry_bytes(x)
        x = few_parts(x, size)
        # The 9 (tier, fold) fits are independent Spark jobs; submitting them
        # from a small thread pool lets the scheduler run them side by side
        # (the same idea as ``parallelism`` in Spark's tuning estimators), as far
        # as the executors can keep their vectors in memory.
        jobs = [(t, k) for t in TIERS for k in range(CALIBRATION_FOLDS)]
        if parallelism is None:
            parallelism = fits_at_once(x.sparkSession, size, len(jobs))
        with ThreadPoolExecutor(max_workers=parallelism) as pool:
            dealt = {t: x.select("features", F.col(t).alias("y"), F.explode(f"{t}_folds").alias("fold")) for t in TIERS}
            futs = {job: pool.submit(TierModel.fit_pair, dealt[job[0]], job[1]) for job in jobs}
            tiers = {t: TierModel([futs[(t, k)].result() for k in range(CALIBRATION_FOLDS)])
                     for t in TIERS}
        cfg = {"quality_threshold": 0.8, "tier_1_threshold": 0.8, "tier_2_threshold": 0.7,
               "fallback_tier": "tier_3"}
        cfg.update(config or {})
        return Router(fm, tiers, cfg)

    def predict(self, docs: DataFrame) -> DataFrame:
        """M6: key -> tier_k_probability for every document."""
        df = self.features.transform(docs.select("key", "prompt"))
        for t in TIERS:
            df = self.tiers[t].predict(df, f"{t}_probability")
        return df.drop("features")

    def calibration_report(self, rows: DataFrame) -> DataFrame:
        """Per tier: Brier score of the base models' mean probability and of the
        calibrated probability, on labelled rows (key, prompt, tier scores)."""
        df = self.features.transform(rows.select("key", "prompt")).join(
            rows.select("key", *[f"{t}_score" for t in TIERS]), "key")
        aggs = [F.count(F.lit(1)).alias("rows")]
        for t in TIERS:
            df = self.tiers[t].predict(df, f"{t}_cal", uncalibrated=f"{t}_raw")
            y = binary_target(f"{t}_score").cast("double")
            aggs += [F.avg((F.col(f"{t}_raw") - y) * (F.col(f"{t}_raw") - y)).alias(f"{t}_before"),
                     F.avg((F.col(f"{t}_cal") - y) * (F.col(f"{t}_cal") - y)).alias(f"{t}_after")]
        g = df.drop("features").agg(*aggs)
        entries = [F.struct(F.lit(t).alias("tier"), F.col("rows"),
                            F.col(f"{t}_before").alias("brier_uncalibrated"),
                            F.col(f"{t}_after").alias("brier_calibrated")) for t in TIERS]
        return g.select(F.inline(F.array(*entries)))

    def save(self, path: str) -> None:
        self.features.save(f"{path}/features")
        for t, m in self.tiers.items():
            m.save(f"{path}/{t}")
        spark = self.features.vocab.sparkSession
        spark.createDataFrame([(json.dumps(self.config),)], "c string").write.mode("overwrite") \
            .text(f"{path}/router_config")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Router":
        """A10: every artifact must be present; a missing one is an error."""
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        need = ["features/meta", "features/vocabulary", "router_config"] + \
               [f"{t}/fold_{i}/{k}" for t in TIERS for i in range(CALIBRATION_FOLDS)
                for k in ("base", "platt")]
        for rel in need:
            p = fs_path(os.path.join(path, rel))
            if not p.getFileSystem(conf).exists(p):
                raise FileNotFoundError(f"router artifact missing: {rel}")
        cfg = json.loads(spark.read.text(f"{path}/router_config").first()[0])
        return Router(FeatureModel.load(spark, f"{path}/features"),
                      {t: TierModel.load(f"{path}/{t}") for t in TIERS}, cfg)


class RouterEstimator(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """M7 as a pipeline stage: fitted on rows (key, prompt, tier scores) without gaps."""

    tier1 = Param(Params._dummy(), "tier1", "probability from which on tier 1 is picked", typeConverter=TypeConverters.toFloat)
    tier2 = Param(Params._dummy(), "tier2", "probability from which on tier 2 is picked", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, tier1: float = 0.8, tier2: float = 0.7):
        super().__init__()
        self._setDefault(tier1=0.8, tier2=0.7)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "RouterModel":
        config = {"tier_1_threshold": self.getOrDefault(self.tier1), "tier_2_threshold": self.getOrDefault(self.tier2)}
        return RouterModel(Router.train(dataset, config))


class RouterModel(Model, MLWritable, MLReadable):
    """M6 as a pipeline stage: adds tier_k_probability to rows (key, prompt), by key.
    Saved beside its metadata; loading fails if any part is missing."""

    def __init__(self, router: Router):
        super().__init__()
        self.router = router

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.join(self.router.predict(dataset.select("key", "prompt")), "key")

    def write(self) -> MLWriter:
        return _RouterWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _RouterReader(cls)


class _RouterWriter(MLWriter):
    def __init__(self, model: RouterModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.router.save(f"{path}/router")


class _RouterReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> RouterModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls(Router.load(self.sparkSession, f"{path}/router"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
