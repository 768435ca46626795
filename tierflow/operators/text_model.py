"""Text features, TF-IDF, scaling and classifier metrics as DataFrame jobs.

TF-IDF (words and bigrams, min_df 2, top 40,000 terms, sublinear tf,
smoothed idf, L2 rows):

  documents -> exchange of the raw text on key, partitions by its size
  -> tokens, bigrams (zip_with), both steps above that exchange
  fit:    sorted terms of a document -> (term, tf) by their runs -> explode
          -> df, corpus count = groupBy(term)   [partitions by the text's size]
          -> vocabulary = top by count          [cut-off from a histogram; 40,000 rows]
  weigh:  (term, tf) -> broadcast join with the vocabulary -> L2 norm by a
          window on key, which needs no other exchange

A task sorts and sums ``TASK_BYTES`` of text, however large the corpus is.

Weights for a model's vectors (``tfidf_arrays``) need no row for each term: Spark ML's
``CountVectorizerModel`` counts a document's terms by the vocabulary, and two
arrays hold them.

Spark ML's ``IDF`` (no +1) and ``CountVectorizer`` (raw tf) do not give the
same numbers, so the weighting is our own DataFrame code.

Scaling uses the population deviation from exact integer moments
(n*Sxx - Sx^2): sums in DECIMAL, arithmetic in Python's integers.
"""
from __future__ import annotations

import math

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierflow.constants import TFIDF_MAX_FEATURES, TFIDF_MIN_DF, WORD_CLASS
from tierflow.functions.text import FEATURE_NAMES, feature_columns
from tierflow.operators.ranking import top_by_count
from tierflow.session import materialize, shuffle_partitions

TOKEN = f"[{WORD_CLASS}]{{2,}}"
#: text of one task, in bytes
TASK_BYTES = 16 << 20


# --------------------------------------------------------------------------
# B1-B8
# --------------------------------------------------------------------------
def prompt_features(docs: DataFrame, key: str = "key", text: str = "prompt") -> DataFrame:
    cols = feature_columns(F.col(text))
    return docs.select(key, *[c.alias(n) for n, c in cols.items()])


# --------------------------------------------------------------------------
# M1 TF-IDF
# --------------------------------------------------------------------------
def text_partitions(docs: DataFrame, text: str = "prompt") -> int:
    """Partitions that give each task ``TASK_BYTES`` of text, and every core one."""
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-text_bytes(docs, text) // TASK_BYTES))


def text_bytes(docs: DataFrame, text: str = "prompt") -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def keys_repeat(docs: DataFrame, key: str = "key") -> bool:
    """Whether a key (null too) has several rows; reads the key alone."""
    return not docs.groupBy(key).count().where("count > 1").isEmpty()


def _rows_of(df: DataFrame, array: Column, field: str, *keep: str) -> DataFrame:
    """A row for each struct of the array. The outer form, as for ``inline`` Spark infers a
    filter on the array's size and pushes it, with all that makes the array, below the exchange."""
    return df.select(*keep, F.inline_outer(array)).where(F.col(field).isNotNull())


def _words(docs: DataFrame, key: str, text: str, carry: tuple[str, ...], parts: int) -> DataFrame:
    """(key, *carry, t): words and bigrams of each row, repeats included.

    The raw text, the smallest form of a document, is hash-partitioned on the
    key and tokenised above that exchange, so the tokens are spread over all tasks.
    """
    d = docs.select(key, *carry, text).repartition(parts, key)
    d = d.select(key, *carry, F.regexp_extract_all(F.lower(F.col(text)), F.lit(TOKEN), 0).alias("t"))
    nxt = F.slice(F.col("t"), 2, F.greatest(F.size("t"), F.lit(1)))
    bigrams = F.filter(F.zip_with(F.col("t"), nxt, lambda a, b: F.concat(a, F.lit(" "), b)),
                       lambda x: x.isNotNull())
    return d.select(key, *carry, F.concat(F.col("t"), bigrams).alias("t"))


def doc_terms(docs: DataFrame, key: str = "key", text: str = "prompt", carry: tuple[str, ...] = (),
              parts: int | None = None) -> DataFrame:
    """(key, *carry, term, tf): unigram and bigram counts per document.

    A row's terms are counted as runs of its sorted array, so nothing is held
    for more than one row; only where keys repeat are their rows summed, on the
    same exchange.
    """
    d = _words(docs, key, text, carry, parts or text_partitions(docs, text))
    d = d.select(key, *carry, F.sort_array("t").alias("t"))
    new = lambda i: (i == 0) | (F.get("t", i) != F.get("t", i - 1))
    at = F.when(F.size("t") > 0, F.filter(F.sequence(F.lit(0), F.size("t") - 1), new))
    d = d.select(key, *carry, "t", at.alias("at"))
    run = lambda s, k: F.struct(
        F.get("t", s).alias("term"), (F.coalesce(F.get("at", k + 1), F.size("t")) - s).cast("bigint").alias("tf"))
    terms = _rows_of(d, F.transform("at", run), "term", key, *carry)
    if keys_repeat(docs, key):
        terms = terms.groupBy(key, *carry, "term").agg(F.sum("tf").alias("tf"))
    return terms


def fit_vocabulary(tf: DataFrame, n_docs: int, min_df: int = TFIDF_MIN_DF,
                   max_features: int = TFIDF_MAX_FEATURES, parts: int = 1) -> DataFrame:
    """(term, df, idf) for the kept terms, from the tf rows of the fit documents.

    ``n_docs`` (number of fit documents, empty ones included) is a one-number
    aggregate taken from the documents, not from the terms; the vocabulary
    itself is bounded by ``max_features``. The terms are summed in ``parts``
    partitions or more.
    """
    stats = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    with shuffle_partitions(tf.sparkSession, parts):
        stats = materialize(stats.where(F.col("df") >= min_df), "term-stats")
    kept = top_by_count(stats, "cf", "term", max_features, "term-ties")
    idf = F.log(F.lit(float(1 + n_docs)) / (F.col("df") + 1)) + 1
    return kept.select("term", "df", idf.alias("idf"))


def indexed(vocab: DataFrame) -> DataFrame:
    """The vocabulary with ``idx``, each term's rank, written; at most max_features rows."""
    return materialize(vocab.withColumn("idx", F.row_number().over(Window.orderBy("term")) - 1), "vocabulary")


def tfidf_weights(docs: DataFrame, vocab: DataFrame, key: str = "key", text: str = "prompt") -> DataFrame:
    """(key, term, idx, weight) of every document, by an ``indexed`` vocabulary.

    The terms stay where the exchange of the text on key has put them, so the
    window for the norms only sorts a partition, which is ``TASK_BYTES`` of text.
    """
    tf = doc_terms(docs, key, text)
    j = tf.join(F.broadcast(vocab.select("term", "idx", "idf")), "term")
    w = (1 + F.log(F.col("tf").cast("double"))) * F.col("idf")
    j = j.select(key, "term", "idx", w.alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return j.select(key, "term", "idx", (F.col("w") / norm).alias("weight"))


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once a row; as a column of its own, Spark may
    put it into the body, which for a lambda means once an element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def term_counter(vocab: DataFrame) -> tuple[CountVectorizerModel, list[float]]:
    """Counts of an ``indexed`` vocabulary's terms, words in ``t``, vector in ``tf``, and the
    terms' idf; at most max_features rows."""
    rows = vocab.select("term", "idf").orderBy("idx").collect()
    model = CountVectorizerModel.from_vocabulary([r["term"] for r in rows], inputCol="t", outputCol="tf")
    return model, [r["idf"] for r in rows]


def count_terms(docs: DataFrame, counter: CountVectorizerModel, key: str = "key", text: str = "prompt",
                carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, *carry, tf): each row's counts as a sparse vector, none without a key. Keys don't repeat."""
    d = _words(docs, key, text, carry, text_partitions(docs, text))
    t = F.coalesce(F.when(F.col(key).isNotNull(), F.col("t")), F.array().cast("array<string>"))
    return counter.transform(d.select(key, *carry, t.alias("t"))).drop("t")


def tfidf_arrays(tf: str, idf: list[float]) -> tuple[Column, Column]:
    """Indices and weights of a vector of counts, read as a struct."""
    table = F.split(F.lit(",".join(map(repr, idf))), ",").cast("array<double>")  # folded to a constant by Spark
    w = F.zip_with(f"{tf}.indices", f"{tf}.values", lambda i, n: (1 + F.log(n)) * F.get(table, i))
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    return F.col(f"{tf}.indices"), _let(w, lambda v: _let(F.sqrt(square(v)), lambda n: F.transform(v, lambda x: x / n)))


def fit_tfidf(docs: DataFrame, key: str = "key", text: str = "prompt") -> tuple[DataFrame, int]:
    """The ``indexed`` vocabulary of the documents, and their number."""
    parts, n_docs = text_partitions(docs, text), docs.count()  # the count reads no text
    return indexed(fit_vocabulary(doc_terms(docs, key, text, parts=parts), n_docs, parts=parts)), n_docs


# --------------------------------------------------------------------------
# M2 population scaling
# --------------------------------------------------------------------------
def fit_scaler(feats: DataFrame, cols=FEATURE_NAMES) -> dict:
    """Exact integer moments (n, Sx, Sxx) of the fit rows per column."""
    dec = "decimal(18,0)"
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in cols:
        x = F.col(c).cast(dec)
        aggs += [F.sum(x).alias(f"sx_{c}"), F.sum((x * x).cast("decimal(38,0)")).alias(f"sxx_{c}")]
    row = feats.agg(*aggs).first()
    return {c: (int(row["n"]), int(row[f"sx_{c}"] or 0), int(row[f"sxx_{c}"] or 0)) for c in cols}


def mean_and_scale(n: int, sx: int, sxx: int) -> tuple[float, float]:
    """Mean and population deviation (1 for a constant column) from exact
    integers of any size; only the last division is in floating point."""
    if not n:
        return 0.0, 1.0
    std = math.sqrt(float(n * sxx - sx * sx) / float(n * n))
    return float(sx) / float(n), std or 1.0


def apply_scaler(feats: DataFrame, stats: dict, keep=("key",)) -> DataFrame:
    cols = []
    for c, moments in stats.items():
        mean, scale = mean_and_scale(*moments)
        cols.append(((F.col(c).cast("double") - F.lit(mean)) / F.lit(scale)).alias(c))
    return feats.select(*keep, *cols)


# --------------------------------------------------------------------------
# E20 classifier metrics
# --------------------------------------------------------------------------
def _safe(num, den):
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(0.0))


def confusion_metrics(df: DataFrame, group: str, p: str, y: str) -> DataFrame:
    """Accuracy, balanced accuracy, per-class precision / recall / F1 / support.

    Prediction is p > 0.5 (a tie goes to class 0, as an argmax over
    [1-p, p] does).  Undefined ratios are 0.
    """
    return confusion_of_scores(score_counts(df, group, p, y), group)


def confusion_of_scores(dist: DataFrame, group: str) -> DataFrame:
    """The same figures from ``score_counts``."""
    hit = F.col("score") > F.lit(0.5)
    total = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).cast("bigint")
    g = dist.groupBy(group).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("n"), total("pos", hit).alias("tp"), total("neg", hit).alias("fp"),
        total("neg", ~hit).alias("tn"), total("pos", ~hit).alias("fn"))
    tp, fp, tn, fn, n = (F.col(c) for c in ("tp", "fp", "tn", "fn", "n"))
    r1, r0 = _safe(tp, tp + fn), _safe(tn, tn + fp)
    f1_1, f1_0 = _safe(2 * tp, 2 * tp + fp + fn), _safe(2 * tn, 2 * tn + fn + fp)
    return g.select(
        group, "n", "tp", "fp", "tn", "fn",
        _safe(tp + tn, n).alias("accuracy"),
        ((r0 + r1) / 2).alias("balanced_accuracy"),
        _safe(tp, tp + fp).alias("precision_1"), r1.alias("recall_1"), f1_1.alias("f1_1"),
        (tp + fn).alias("support_1"),
        _safe(tn, tn + fn).alias("precision_0"), r0.alias("recall_0"), f1_0.alias("f1_0"),
        (tn + fp).alias("support_0"),
        ((f1_0 + f1_1) / 2).alias("macro_f1"),
        _safe(f1_0 * (tn + fp) + f1_1 * (tp + fn), n).alias("weighted_f1"),
        ((_safe(tn, tn + fn) + _safe(tp, tp + fp)) / 2).alias("macro_precision"),
        _safe(_safe(tn, tn + fn) * (tn + fp) + _safe(tp, tp + fp) * (tp + fn), n).alias("weighted_precision"),
        ((r0 + r1) / 2).alias("macro_recall"),
        _safe(r0 * (tn + fp) + r1 * (tp + fn), n).alias("weighted_recall"),
    )


def roc_auc(df: DataFrame, group: str, p: str, y: str, parts: int | None = None) -> DataFrame:
    """Exact ROC AUC (ties count half) per group, without a single-task window.

    1. collapse rows to distinct (group, score) with positive/negative counts;
    2. range-partition that table on (group, score) and checkpoint it, so each
       task holds a contiguous slice of the score order, and materialise it
       (written table in the shared checkpoint folder) so slice ids are fixed;
    3. prefix sums inside each slice (window on (slice, group)) plus slice
       offsets from a per-slice total table (slices x groups rows, broadcast);
    4. AUC = sum(pos * (neg_below + neg/2)) / (P * N), summed as exact
       integers (2*pos*neg_below + pos*neg) in DECIMAL(38,0).
    """
    return auc_of_scores(score_counts(df, group, p, y), group, parts)


def score_counts(df: DataFrame, group: str, p: str, y: str) -> DataFrame:
    """Distinct (group, score) with how many positives and negatives have it."""
    return df.groupBy(group, F.col(p).alias("score")).agg(
        F.sum(F.col(y).cast("bigint")).alias("pos"),
        F.sum((1 - F.col(y)).cast("bigint")).alias("neg"))


def auc_of_scores(dist: DataFrame, group: str, parts: int | None = None) -> DataFrame:
    """The AUC from ``score_counts``."""
    spark = dist.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sliced = materialize(dist.repartitionByRange(parts, group, "score")
                         .withColumn("slice", F.spark_partition_id()), "auc-slices")
    w_in = Window.partitionBy("slice", group).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    within = sliced.withColumn("neg_before", F.coalesce(F.sum("neg").over(w_in), F.lit(0)))
    totals = sliced.groupBy("slice", group).agg(F.sum("neg").alias("slice_neg"))
    w_off = Window.partitionBy(group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("slice", group,
                            F.coalesce(F.sum("slice_neg").over(w_off), F.lit(0)).alias("offset"))
    j = within.join(F.broadcast(offsets), ["slice", group])
    dec = "decimal(38,0)"
    below = (F.col("offset") + F.col("neg_before")).cast(dec)
    g = j.groupBy(group).agg(
        F.sum(F.col("pos").cast(dec) * below * 2 + F.col("pos").cast(dec) * F.col("neg").cast(dec))
        .alias("num"),
        F.sum("pos").cast(dec).alias("P"), F.sum("neg").cast(dec).alias("N"))
    return g.select(group, F.when((F.col("P") > 0) & (F.col("N") > 0),
                                  F.col("num").cast("double") / (F.col("P") * F.col("N") * 2).cast("double"))
                    .alias("roc_auc"))


def classifier_metrics(df: DataFrame, group: str, p: str, y: str) -> DataFrame:
    """Confusion figures and AUC per group, put side by side without a join:
    both are tiny per-group aggregates, unioned and folded with a max (a
    join on a constant group key would plan as a nested-loop join)."""
    dist = materialize(score_counts(df, group, p, y), "score-counts")  # the input is read once
    conf = confusion_of_scores(dist, group)
    auc = auc_of_scores(dist, group)
    cols = [c for c in conf.columns if c != group]
    both = conf.withColumn("roc_auc", F.lit(None).cast("double")).unionByName(
        auc.select(group, *[F.lit(None).cast(conf.schema[c].dataType).alias(c) for c in cols],
                   "roc_auc"))
    return both.groupBy(group).agg(*[F.max(c).alias(c) for c in cols + ["roc_auc"]])
