"""Learning operators: features, calibrated tier model, persistence, metrics."""
import os

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tierflow.functions.routing import binary_target
from tierflow.operators import text_model as TM
from tierflow.operators.labels import complete_rows
from tierflow.operators.learn import (FeatureModel, PromptFeatures, Router, RouterEstimator, TierModel, _balanced, brier_report, fit_base,
                                      fit_platt,
                                      gradient_norm, stratified_folds)
from tierflow.operators.ranking import top_by_count
from tierflow.plans.model_queries import GRADIENT_BOUND
from tierflow.session import checkpoint_path
from tierflow.sources import views as V


@pytest.fixture(scope="module")
def train_rows(spark):
    raw = V.routing_raw(spark, SF_SMALL)
    return complete_rows(raw.where(F.col("split") == "train"), need_prompt=True)


def test_feature_vectors(spark, train_rows):
    fm = FeatureModel.fit(train_rows.select("key", "prompt"))
    x = fm.transform(train_rows.select("key", "prompt")).collect()
    assert len(x) == train_rows.count()
    v = x[0]["features"]
    assert v.size == fm.n_terms + 8
    # TF-IDF part is L2-normalised
    tfidf = [val for i, val in zip(v.indices, v.values) if i < fm.n_terms]
    assert sum(t * t for t in tfidf) == pytest.approx(1.0, rel=1e-6)


def test_tier_model_save_load(spark, train_rows):
    fm = FeatureModel.fit(train_rows.select("key", "prompt"))
    x = fm.transform(train_rows.select("key", "prompt")).join(
        train_rows.select("key", "tier_3_score"), "key").withColumn("y", binary_target("tier_3_score"))
    m = TierModel.fit(x)
    scored = m.predict(x, "p", uncalibrated="p_raw")
    p1 = {r["key"]: r["p"] for r in scored.select("key", "p").collect()}
    assert all(0.0 <= v <= 1.0 for v in p1.values())
    rep = brier_report(scored, "y", "p", "p_raw").first()
    assert rep["rows"] == len(p1)
    assert 0.0 <= rep["brier_calibrated"] <= 1.0 and 0.0 <= rep["brier_uncalibrated"] <= 1.0
    path = checkpoint_path(spark, "test-tier-model")
    m.save(path)
    p2 = {r["key"]: r["p"] for r in TierModel.load(path).predict(x, "p").select("key", "p").collect()}
    assert p1 == pytest.approx(p2)


def test_router_load_requires_every_artifact(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        Router.load(spark, str(tmp_path / "absent"))


def test_auc_matches_pairwise_definition(spark):
    rows = [("a", 0.9, 1), ("a", 0.8, 0), ("a", 0.8, 1), ("a", 0.3, 0), ("a", 0.3, 0), ("a", 0.1, 1),
            ("b", 0.5, 1), ("b", 0.5, 0)]
    df = spark.createDataFrame(rows, "g string, p double, y int")
    got = {r["g"]: r["roc_auc"] for r in TM.roc_auc(df, "g", "p", "y", parts=3).collect()}

    def brute(g):
        pos = [p for gg, p, y in rows if gg == g and y == 1]
        neg = [p for gg, p, y in rows if gg == g and y == 0]
        s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
        return s / (len(pos) * len(neg))
    assert got["a"] == pytest.approx(brute("a"))
    assert got["b"] == pytest.approx(0.5)


def test_scaler_constant_column_divides_by_one(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "key int, word_count int")
    stats = TM.fit_scaler(df, cols=["word_count"])
    out = [r["word_count"] for r in TM.apply_scaler(df, stats).collect()]
    assert out == [0.0, 0.0, 0.0]
    df2 = spark.createDataFrame([(1, 1), (2, 3)], "key int, word_count int")
    out2 = sorted(r["word_count"] for r in TM.apply_scaler(df2, TM.fit_scaler(df2, cols=["word_count"])).collect())
    assert out2 == [-1.0, 1.0]        # population deviation, not sample


def test_scaler_beyond_64_bits(spark):
    """Moments past 2 ** 63 (and 2 ** 127) scale without overflow."""
    n = 4 * 10 ** 9
    for big in (10 ** 3, 10 ** 9):
        stats = {"word_count": (n, n * big, n * (big * big + 4))}   # mean big, deviation 2
        df = spark.createDataFrame([(1, big + 2)], "key int, word_count int")
        assert TM.apply_scaler(df, stats).first()["word_count"] == pytest.approx(1.0, rel=1e-2)
    rows = spark.range(4).select(F.lit(1).alias("key"), F.lit(2_000_000_000).alias("word_count"))
    (m,) = TM.fit_scaler(rows, cols=["word_count"]).values()
    assert m == (4, 8 * 10 ** 9, 16 * 10 ** 18)


def test_one_class_is_an_error(spark):
    df = spark.createDataFrame([(i, 1) for i in range(9)] + [(9, 0), (10, 0)], "key int, y int")
    with pytest.raises(ValueError, match="each class needs at least 3 rows"):
        stratified_folds(df)


def test_folds_are_even_in_each_class(spark):
    df = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(100)], "key int, y int")
    got = {(r["y"], r["fold"]): r["count"] for r in stratified_folds(df).groupBy("y", "fold").count().collect()}
    assert got == {(0, 0): 27, (0, 1): 27, (0, 2): 26, (1, 0): 7, (1, 1): 7, (1, 2): 6}


def test_top_by_count_is_exact(spark):
    rows = [(f"t{i:03d}", c) for i, c in enumerate([9, 9, 7, 5, 5, 5, 5, 3, 2, 2])]
    df = spark.createDataFrame(rows, "term string, cf long").repartition(4)
    for k in range(1, 13):
        got = {r["term"] for r in top_by_count(df, "cf", "term", k).collect()}
        assert got == {t for t, _ in sorted(rows, key=lambda r: (-r[1], r[0]))[:k]}


def test_gradient_is_large_away_from_the_solution(spark, train_rows):
    fm = FeatureModel.fit(train_rows.select("key", "prompt"))
    x = fm.transform(train_rows.select("key", "prompt")).join(
        train_rows.select("key", "tier_1_score"), "key").withColumn("y", binary_target("tier_1_score"))
    good = fit_base(x)
    poor = LogisticRegression(weightCol="w", labelCol="y", maxIter=0, regParam=1.0, standardization=False).fit(_balanced(x, "y")[0])
    assert gradient_norm(good, x) < GRADIENT_BOUND < gradient_norm(poor, x)


def test_router_pipeline_save_load_predicts_the_same(spark, train_rows, tmp_path):
    """A pipeline with both stages comes back from disk with its settings and gives
    equal rows; one whose parts are missing doesn't load."""
    import shutil
    model = Pipeline(stages=[PromptFeatures(), RouterEstimator(tier1=0.75)]).fit(train_rows)
    path = str(tmp_path / "pipeline")
    model.write().overwrite().save(path)
    back = PipelineModel.load(path)
    assert back.stages[1].router.config["tier_1_threshold"] == 0.75
    assert [s.uid for s in back.stages] == [s.uid for s in model.stages]
    docs = train_rows.select("key", "prompt").limit(20)
    rows = lambda m: {r["key"]: r.asDict() for r in m.transform(docs).collect()}
    one, two = rows(model), rows(back)
    probs = [f"tier_{k}_probability" for k in (1, 2, 3)]
    assert one.keys() == two.keys() and len(one) == 20 and "word_count" in two[min(two)]
    for k in one:
        assert [one[k][p] for p in probs] == pytest.approx([two[k][p] for p in probs])
        assert all(0 <= two[k][p] <= 1 for p in probs)
    (stage,) = (tmp_path / "pipeline" / "stages").glob("1_*")
    shutil.rmtree(stage / "router" / "tier_2" / "fold_1" / "platt")
    with pytest.raises(FileNotFoundError, match="tier_2/fold_1/platt"):
        PipelineModel.load(path)


def test_prompt_features_column_is_a_parameter(spark, tmp_path):
    docs = spark.createDataFrame([(1, "What is this?")], "key int, q string")
    stage = PromptFeatures(text="q")
    stage.write().overwrite().save(str(tmp_path / "stage"))
    assert PromptFeatures.load(str(tmp_path / "stage")).transform(docs).first()["word_count"] == 3


def test_platt_newton_against_brute_force(spark):
    """Slope and intercept are a stationary point of the smoothed cross entropy; equal
    margins leave the slope still, rows without margin are left out, no rows are an error."""
    rng = np.random.default_rng(3)
    m = rng.normal(size=400) * 3
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.7 * m - 0.4)))).astype(int)
    rows = [(float(a), int(b)) for a, b in zip(m, y)] + [(None, 1), (1.0, None)]
    a, b = fit_platt(spark.createDataFrame(rows, "m double, y int"), "m")
    pos, neg = y.sum(), 400 - y.sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    p = 1 / (1 + np.exp(-(a * m + b)))
    assert abs(((p - t) * m).sum()) < 1e-6 and abs((p - t).sum()) < 1e-6
    assert a > 0
    # separable margins of large size: the smoothed targets keep the fit finite
    a, b = fit_platt(spark.createDataFrame([(-500.0, 0)] * 5 + [(400.0, 1)] * 5, "m double, y int"), "m")
    assert np.isfinite([a, b]).all() and 1 / (1 + np.exp(-(400 * a + b))) == pytest.approx(6 / 7, abs=1e-6)
    a, b = fit_platt(spark.createDataFrame([(2.0, 0), (2.0, 1), (2.0, 1)], "m double, y int"), "m")
    t = (3 / 4 + 3 / 4 + 1 / 3) / 3
    assert 1 / (1 + np.exp(-(2 * a + b))) == pytest.approx(t, abs=1e-6)
    with pytest.raises(ValueError):
        fit_platt(spark.createDataFrame([], "m double, y int"), "m")


def test_weights_stay_on_the_exchange_of_the_text(spark, monkeypatch):
    """The terms are not exchanged again for the norms, partitions grow with the text, and
    rows of a key that repeats count as one document."""
    docs = spark.createDataFrame([(1, "aa bb aa"), (2, "aa bb cc"), (2, "bb cc"), (None, "bb"), (3, None)], "key long, prompt string")
    monkeypatch.setattr(TM, "TASK_BYTES", 1)
    assert TM.text_partitions(docs) == max(23, spark.sparkContext.defaultParallelism)
    got = sorted((r["key"], r["term"], r["tf"]) for r in TM.doc_terms(docs.where("key IS NOT NULL")).collect())
    assert got == [(1, "aa", 2), (1, "aa bb", 1), (1, "bb", 1), (1, "bb aa", 1),
                   (2, "aa", 1), (2, "aa bb", 1), (2, "bb", 2), (2, "bb cc", 2), (2, "cc", 2)]
    vocab, n_docs = TM.fit_tfidf(docs)
    w = TM.tfidf_weights(docs.where("key = 1"), vocab)
    assert w._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1  # before it runs
    assert n_docs == 5 and sum(r["weight"] ** 2 for r in w.collect()) == pytest.approx(1.0)


def _entries(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["key"], []).append({int(i): float(v) for i, v in zip(r["features"].indices, r["features"].values)})
    return out


def test_vectors_are_the_relational_weights(spark, monkeypatch):
    """Vectors hold the weights of the table of terms; where no key repeats, no such table is made.
    A row without text or key has its features alone, and rows of a repeated key are one document."""
    texts = [(1, "aa bb aa cc?"), (2, "bb cc dd"), (3, None), (4, ""), (5, "Zz zz"), (None, "aa bb")]
    once = spark.createDataFrame(texts, "key long, prompt string")
    for docs in (once, once.unionByName(spark.createDataFrame([(2, "aa aa bb"), (5, "Zz zz")], once.schema))):
        model, x = FeatureModel.fit_transform(docs)
        want = {}
        for r in TM.tfidf_weights(docs.where("key IS NOT NULL"), model.vocab).collect():
            want.setdefault(r["key"], {})[r["idx"]] = r["weight"]
        scaled = {}
        for r in TM.apply_scaler(TM.prompt_features(docs), TM.fit_scaler(TM.prompt_features(docs))).collect():
            scaled.setdefault(r["key"], []).append([r[c] for c in model.scaler])
        with monkeypatch.context() as m:
            if docs is once:
                m.setattr(TM, "tfidf_weights", None)
            for got in (_entries(x), _entries(model.transform(docs))):
                assert got.keys() == scaled.keys()
                for key, rows in got.items():
                    terms = [{i: v for i, v in row.items() if i < model.n_terms} for row in rows]
                    assert all(t == pytest.approx(want.get(key, {})) for t in terms)
                    tails = [[row.get(model.n_terms + i, 0.0) for i in range(8)] for row in rows]
                    assert sorted(tails) == [pytest.approx(t) for t in sorted(scaled[key], key=lambda t: [float("-inf") if v is None else v for v in t])] \
                        or None in sum(scaled[key], [])


def test_calibration_reads_no_vectors(spark, monkeypatch):
    """The rounds of the calibration read written margins."""
    from tierflow.operators import learn
    rows = [(float(i), i % 2, i % 3) for i in range(24)]
    train = spark.createDataFrame(rows, "a double, y int, fold int")
    from pyspark.ml.feature import VectorAssembler
    train = VectorAssembler(inputCols=["a"], outputCol="features").transform(train)
    seen = []
    monkeypatch.setattr(learn, "fit_platt", lambda m, *a: seen.append(m) or fit_platt(m, *a))
    TierModel.fit_pair(train, 1)
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "features" not in plan and "UDF" not in plan


def test_tiers_train_on_one_table_of_vectors(spark, monkeypatch):
    """Each tier's rows and folds are those of ``stratified_folds``, repeated keys included, but no
    tier has a table of its own."""
    from tierflow.operators import learn
    raw = [(i, f"word{i % 7} and word{i % 5}", (i % 4) / 4 + 0.2, (i % 3) / 2, (i % 5) / 4) for i in range(40)]
    rows = spark.createDataFrame(raw + raw[:3], "key long, prompt string, tier_1_score double, tier_2_score double, tier_3_score double")
    trained, names, written = {}, [], learn.materialize

    def fit_pair(train, k):
        counts = sorted(tuple(r) for r in train.groupBy("y", "fold").count().collect())
        trained.setdefault(k, []).append(counts)
        return None, (1.0, 0.0)
    monkeypatch.setattr(TierModel, "fit_pair", staticmethod(fit_pair))
    monkeypatch.setattr(learn, "materialize", lambda df, name: names.append((name, "features" in df.columns)) or written(df, name))
    Router.train(rows, parallelism=1)
    scores = rows.select("key", *[f"tier_{k}_score" for k in (1, 2, 3)])
    want = [sorted(tuple(r) for r in stratified_folds(rows.select("key").join(scores, "key").select(
        "key", binary_target(f"tier_{k}_score").alias("y"))).groupBy("y", "fold").count().collect()) for k in (1, 2, 3)]
    assert trained == {k: want for k in range(3)}
    assert [n for n, vectors in names if vectors] == ["router-train"]


def test_fits_side_by_side_are_kept_in_memory(spark, monkeypatch):
    """As many fits run at once as the executors can cache the rows of, one at least; tasks of a round
    have a size that doesn't come from the scan."""
    import threading
    import time

    from tierflow.operators import learn
    from tierflow.session import storage_bytes
    raw = [(i, f"word{i % 7} and word{i % 5}", (i % 4) / 4 + 0.2, (i % 3) / 2, (i % 5) / 4) for i in range(40)]
    rows = spark.createDataFrame(raw, "key long, prompt string, tier_1_score double, tier_2_score double, tier_3_score double")
    _, x = FeatureModel.fit_transform(rows.select("key", "prompt"))
    size = learn.entry_bytes(x)
    assert size == 12 * sum(len(r["features"].indices) for r in x.collect())
    assert storage_bytes(spark) > 1 << 27  # of a local master's driver
    assert [learn.fits_at_once(spark, n, 9) for n in (0, size, 1 << 50)] == [9, 9, 1]
    now, parts, lock = [0, 0], [], threading.Lock()

    def fit_pair(train, k):
        with lock:
            now[0] += 1
            now[1] = max(now)
            parts.append(train.rdd.getNumPartitions())
        time.sleep(0.2)
        with lock:
            now[0] -= 1
        return None, (1.0, 0.0)
    monkeypatch.setattr(TierModel, "fit_pair", staticmethod(fit_pair))
    monkeypatch.setattr(learn, "materialize_vectors", lambda df, name: learn.materialize(df.repartition(3 * cores), name))
    cores, most = spark.sparkContext.defaultParallelism, "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(most)
    spark.conf.set(most, "4m")  # what opening a file counts for: a task for each file
    try:
        for room, at_once in ((0, 1), (3 * (size * 2 // 3), 2)):
            now[1] = 0
            monkeypatch.setattr(learn, "storage_bytes", lambda _: room)
            Router.train(rows)
            assert now[1] == at_once and {*parts} == {2 * cores}
    finally:
        spark.conf.set(most, before)


def test_margins_are_few_files(spark, monkeypatch):
    """A fold's margins are some numbers a row: they don't get a file for each task of the vectors' scan."""
    from pyspark.ml.feature import VectorAssembler

    from tierflow.operators import learn
    train = VectorAssembler(inputCols=["a"], outputCol="features").transform(
        spark.createDataFrame([(float(i), i % 2, i % 3) for i in range(240)], "a double, y int, fold int")).repartition(80)
    seen = []
    monkeypatch.setattr(learn, "fit_platt", lambda m, *a: seen.append(m) or fit_platt(m, *a))
    TierModel.fit_pair(train, 1)
    assert seen[0].count() == 80
    assert len(seen[0].inputFiles()) <= 2 * spark.sparkContext.defaultParallelism
