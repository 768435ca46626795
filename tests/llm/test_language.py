"""Language identification: held-out accuracy, the vectors against plain Python, odd rows."""
import collections
import math
import random
import zlib

import numpy as np
import pytest

from tests.conftest import SF_MID
from tests.llm.conftest import SCHEMA
from tierflow.llm import language as L
from tierflow.llm import textnp as T


def test_held_out_accuracy(spark):
    """At least 99 of 100 held-out documents of 20 words or more, 95 of all."""
    truth = {r.doc_id: (r.lang, len((r.text or "").split())) for r in spark.read.parquet(SF_MID + "/documents.parquet").collect()}
    got = L.op13_language(spark, SF_MID).collect()
    assert len(got) == len(truth)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and (r.lang_pred != "und" or r.score == 0)
    rows = [(truth[r.doc_id][0] == r.lang_pred, truth[r.doc_id][1]) for r in got if r.held_out and truth[r.doc_id][0]]
    assert len(rows) > 150
    assert np.mean([ok for ok, _ in rows]) >= 0.95
    assert np.mean([ok for ok, n in rows if n >= 20]) >= 0.99


def grams(text):
    b = text.encode()
    out = collections.Counter()
    for k in (2, 3):
        for i in range(len(b) - k + 1):
            g = int.from_bytes(b[i:i + k], "big") + (k << 32)
            out[int(T.mix(np.array([g], np.uint64))[0]) % L.FEATURES] += 1
    return out


def test_vectors_and_nearest_centroid(spark):
    """Predictions equal a plain search over all centroids."""
    rng = random.Random(2)
    words = {"x": ["ab", "abba", "baab"], "y": ["cd", "dcd", "ab"], "z": ["éf", "féé"]}
    rows = [(i, " ".join(rng.choices(words[lang], k=rng.randint(1, 30))), lang) for i in range(150) for lang in words]
    d = spark.createDataFrame([(i, t, lang, *[None] * 9) for i, t, lang in rows], SCHEMA).repartition(3)
    model = L.fit(d, sample=40)
    df = collections.Counter(g for _, t, _ in rows for g in grams(f" {t} "))
    assert all(math.isclose(model.idf[g], math.log((1 + len(rows)) / (1 + n)) + 1) for g, n in df.items())
    assert len(model.lang) <= 3 * L.CLUSTERS and model.lang == sorted(model.lang)
    got = {(r.doc_id, r.lang): (r.lang_pred, r.score) for r in L.identify(d, model, ["doc_id", "lang"]).collect()}
    right = 0
    for i, t, lang in rows:
        x = {g: (1 + math.log(n)) * model.idf[g] for g, n in grams(f" {t} ").items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        cosine = [sum(v * c[g] for g, v in x.items()) / norm for c in model.centroid]
        pred, score = got[i, lang]
        assert math.isclose(score, max(cosine), abs_tol=1e-9)
        assert any(model.lang[j] == pred for j, c in enumerate(cosine) if c > max(cosine) - 1e-9)
        right += pred == lang
    assert right > 0.9 * len(rows)


def test_far_texts_are_rejected(spark):
    rng = random.Random(4)
    words = "der die das und nicht ein eine mit von auch".split()
    d = spark.createDataFrame([(i, " ".join(rng.choices(words, k=6)), "de", *[None] * 9) for i in range(200)], SCHEMA)
    model = L.fit(d)
    probe = spark.createDataFrame([(1, "mit der das und auch ein", None, *[None] * 9), (2, "zzyzx qqq", None, *[None] * 9)], SCHEMA)
    got = {r.doc_id: r for r in L.identify(probe, model, ["doc_id"]).collect()}
    assert not got[1].rejected and got[2].rejected and got[2].lang_pred == "de"


def test_odd_rows(spark, docs, odd, nothing):
    model = L.fit(docs.filter(~L.held_out()))
    got = L.identify(docs, model, ["doc_id"]).collect()
    assert len(got) == len(odd) and set(model.lang) == {"en"}
    empty = {r.doc_id for r in got if r.lang_pred == "und"}
    assert empty == {r[0] for r in odd if not any(c.isalpha() for c in r[1] or "")}
    assert L.identify(nothing, model, ["doc_id"]).count() == 0
    none = L.fit(nothing)
    assert {(r.lang_pred, r.score, r.rejected) for r in L.identify(docs, none, ["doc_id"]).collect()} == {("und", 0.0, True)}


@pytest.mark.parametrize("k", [1, 3, 50])
def test_clusters(k):
    rng = np.random.default_rng(0)
    x = np.abs(rng.normal(size=(20, 6)))
    x = np.concatenate([x, x])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c, place = L.clustered(x, k)
    assert len(c) <= min(k, 20) and (place == (x @ c.T).argmax(1)).all()
    assert np.allclose(np.linalg.norm(c, axis=1), 1)
