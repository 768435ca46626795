"""Language identification by nearest centroids of n-gram vectors.

A text's letters, lower-cased and with one space for everything between them,
are read as UTF-8. Counts of its byte bigrams and trigrams, hashed to
``FEATURES`` places, weigh 1 + log(count) times the inverse document frequency
and have length 1. Each language has several centroids, found by spherical
k-means over a bounded sample; a text gets the language of the centroid of
largest cosine. A text farther from it than ``SLACK`` times the distance that
``WITHIN`` of the centroid's own sample keep is marked as rejected.

Bounded by parameters: at most ``SAMPLE`` different texts of each language, those
of least hash, are clustered, in a task of their own by their vectors. Document
frequencies are of all learnable texts; every text is predicted. The model
(``CLUSTERS`` vectors a language) is shipped with the tasks.

Cases: a null text, or one without a letter, is ``und`` with score 0; with no text
to learn from, so is every text; a null language is never learnt; a cosine tie
goes to the first language in code-point order; equal texts get equal results;
an empty table gives an empty result; other columns of the input are not read.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierflow.llm import textnp as T
from tierflow.llm.common import Scratch, map_batches, ship, table

FEATURES, CLUSTERS, SAMPLE, ROUNDS = 4096, 4, 1000, 10
WITHIN, SLACK = 0.99, 1.25
UNKNOWN = "und"
DOCS = 256  # vectors made at once
HELD_OUT = 2  # remainder of the id's hash by 4


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning; null for a null id, which isn't learnt either."""
    return F.crc32(F.col(doc_id).cast("string")) % 4 == HELD_OUT


def letters(text: str = "text") -> Column:
    """The text's words between single spaces; null without a letter."""
    low = F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{M}]+", " ")
    return F.when(F.col(text).rlike(r"\p{L}"), F.concat(F.lit(" "), low, F.lit(" ")))


def counts(buf: np.ndarray, off: np.ndarray, features: int = FEATURES) -> np.ndarray:
    """(documents, features) n-gram counts of a chunk."""
    n = len(off) - 1
    out = np.zeros(n * features, np.int64)
    doc = np.repeat(np.arange(n), np.diff(off))
    b = buf.astype(T.U)
    for k in (2, 3):
        if len(buf) < k:
            continue
        inside = doc[: len(doc) - k + 1] == doc[k - 1:]
        gram = b[: len(b) - k + 1].copy()
        for j in range(1, k):
            gram = gram << T.U(8) | b[j: len(b) - k + 1 + j]
        place = (T.mix(gram + T.U(k << 32)) % T.U(features)).astype(np.int64)
        out += np.bincount((doc[: len(place)] * features + place)[inside], minlength=n * features)
    return out.reshape(n, features)


def _blocks(text: pa.Array):
    """(first row, row after the last, counts) of a column, a bounded block at a time."""
    for lo, hi, buf, off in T.chunks(text):
        for s in range(0, hi - lo, DOCS):
            e = min(s + DOCS, hi - lo)
            yield lo + s, lo + e, counts(buf[off[s]:off[e]], off[s:e + 1] - off[s])


def vectors(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors; a row without n-grams is zero."""
    x = np.where(count > 0, 1 + np.log(np.maximum(count, 1)), 0.0) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def clustered(x: np.ndarray, k: int = CLUSTERS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, place of each row) of spherical k-means; starts are the row
    nearest to the mean and then each time the row farthest from all starts."""
    start = [int(np.argmax(x @ x.mean(0)))]
    near = x @ x[start[0]]
    while len(start) < min(k, len(x)) and near.min() < 1 - 1e-9:
        start.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[start[-1]])
    c = x[start]
    for _ in range(rounds):
        place = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[place == i].sum(0) if (place == i).any() else c[i] for i in range(len(c))])
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c, np.argmax(x @ c.T, axis=1)


@dataclass(frozen=True)
class Model:
    """lang, vector and radius (the distance beyond which a text is rejected) of
    each centroid, by language; idf of each feature."""
    idf: np.ndarray
    lang: list[str]
    centroid: np.ndarray
    radius: np.ndarray


def _frequencies(texts: DataFrame, features: int) -> tuple[np.ndarray, int]:
    """Documents with each feature, and documents, of a column ``letters``."""
    def run(batches):
        total, docs = np.zeros(features, np.int64), 0
        for b in batches:
            for lo, hi, count in _blocks(b.column(0)):
                total += (count > 0).sum(0)
                docs += hi - lo
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(features + 1)), pa.array(np.append(total, docs))], names=["at", "n"])

    ship(texts.sparkSession)
    sums = texts.select("letters").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(features + 1, np.int64)
    for r in sums:  # a row a feature
        out[r["at"]] = r["n"]
    return out[:features], int(out[features])


def fit(labelled: DataFrame, lang: str = "lang", text: str = "text", features: int = FEATURES,
        clusters: int = CLUSTERS, sample: int = SAMPLE) -> Model:
    """A model of all languages of ``labelled``; texts without a letter are passed over."""
    scratch = Scratch(labelled.sparkSession, "language")
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    df, docs = _frequencies(rows.select(letters().alias("letters")), features)
    idf = np.log((1 + docs) / (1 + df)) + 1
    # which texts are sampled is settled by hashes alone; copies count once. Of a language
    # of n texts only the hashes below 2 * sample / n are ranked, about twice as many as needed
    hashed = scratch.write(rows.select("lang", "h"), "hashes")
    share = scratch.write(hashed.groupBy("lang").agg(
        (F.lit(2.0 * sample) / F.approx_count_distinct("h", 0.02)).alias("share")), "shares")
    place = F.shiftrightunsigned("h", 11).cast("double") / float(1 << 53)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(place, "h"))
    chosen = scratch.write(hashed.join(share, "lang").filter(place < F.col("share")).select("lang", "h").distinct()
                           .withColumn("rank", rank).filter(F.col("rank") <= sample).select("lang", "h"), "chosen")
    taken = rows.join(chosen, ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text")).select(
        "lang", "h", letters().alias("letters"))

    def embed(batch: pa.RecordBatch):
        for lo, hi, count in _blocks(batch.column(2)):
            x = vectors(count, idf).astype(np.float32)
            yield {"lang": batch.column(0).slice(lo, hi - lo), "h": batch.column(1).slice(lo, hi - lo),
                   "x": pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * features, pa.int32()), pa.array(x.ravel()))}

    def cluster(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(part.sort_values("h")["x"].to_list()).astype(np.float64)
        c, place = clustered(x, clusters)
        away = 1 - (x * c[place]).sum(1)
        radius = [float(np.quantile(away[place == i], WITHIN)) * SLACK if (place == i).any() else 0.0 for i in range(len(c))]
        return pd.DataFrame({"lang": key[0], "cluster": range(len(c)), "centroid": list(c), "radius": radius})

    drawn = scratch.write(map_batches(taken, embed, "lang string, h long, x array<float>"), "vectors")
    found = drawn.groupBy("lang").applyInPandas(cluster, "lang string, cluster int, centroid array<double>, radius double")
    found = sorted(found.collect(), key=lambda r: (r["lang"], r["cluster"]))  # a few rows a language
    scratch.drop("hashes", "shares", "chosen", "vectors")
    centroid = np.array([r["centroid"] for r in found]).reshape(len(found), features)
    return Model(idf, [r["lang"] for r in found], centroid, np.array([r["radius"] for r in found]))


def identify(docs: DataFrame, model: Model, ids: list[str], text: str = "text") -> DataFrame:
    """ids, lang_pred, score (cosine, 0 to 1) and rejected of every row of docs."""
    rows = docs.select(F.struct(*ids).alias("ids"), letters(text).alias("letters"))
    names = np.array([*model.lang, UNKNOWN], object)

    def run(batches):
        for b in batches:
            for lo, hi, count in _blocks(b.column(1)):
                best, near = np.full(hi - lo, len(model.lang)), np.zeros(hi - lo)
                known = count.any(1)
                if len(model.lang):
                    cosine = vectors(count[known], model.idf) @ model.centroid.T
                    best[known], near[known] = cosine.argmax(1), cosine.max(1, initial=0)
                far = np.ones(hi - lo, bool)
                far[known] = 1 - near[known] > np.append(model.radius, -1.0)[best[known]]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(names[best], pa.string()),
                     pa.array(np.clip(near, 0, 1)), pa.array(far)], names=["ids", "lang_pred", "score", "rejected"])

    ship(docs.sparkSession)
    kind = rows.schema["ids"].dataType.simpleString()
    return rows.mapInArrow(run, f"ids {kind}, lang_pred string, score double, rejected boolean").select(
        "ids.*", "lang_pred", "score", "rejected")


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = fit(docs.filter(~held_out()))
    out = identify(docs, model, ["doc_id"])
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred",
                      F.round("score", 9).alias("score"), "rejected")
