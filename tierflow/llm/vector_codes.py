"""Vector codes: product quantisation with an equal-average entry search.

Components become integers, floor(scale * x), so every sum and distance is
exact and no order of rows matters. A vector is cut into equal parts, and each
part position has a codebook. The search for a part's nearest entry runs over
the entries sorted by the sum of their components, outward from the part's own
sum: for k components a squared distance is at least the squared gap of the
sums over k, so a direction ends as soon as that bound strictly exceeds the
best distance; entries at the same distance are still seen, and the lowest
index wins. Rounds reduce to sums and counts of each entry in every task; only
codebooks (entries x dimension integers) reach the driver.

Cases: a vector that is null or holds a null or non-finite component is left out;
an id that is null comes after all others; rows that share an id are entries in
the order of their components; the dimension is that of the first vector
whose length is a positive multiple of the number of parts, and vectors of
another length get null codes and errors; scaled components beyond 2 ** 24 count
as that; with fewer vectors than entries the codebooks are shorter; a sum of
errors beyond a long is null; an empty table gives an empty result; other columns
of the input are not read.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierflow.llm.common import Scratch, ship, table

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
BOUND = 1 << 24
ROWS = 4096  # vectors searched at once


def quantised(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
              scale: int = SCALE) -> DataFrame:
    """vec_id, label and v (integers) of the vectors that are whole."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                      & (F.abs(x.cast("double")) != float("inf")))
    near = lambda x: F.least(F.greatest(x.cast("double") * scale, F.lit(-float(BOUND))), F.lit(float(BOUND)))
    return vectors.filter(F.col(vector).isNotNull() & finite).select(
        F.col(vec_id).alias("vec_id"), F.col(label).alias("label"),
        F.transform(vector, lambda x: F.floor(near(x)).cast("int")).alias("v"))


def search(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the entry nearest to each row of x; the lowest on a tie."""
    k, n = x.shape[1], len(entries)
    order = np.argsort(entries.sum(1), kind="stable")
    sums, own = entries.sum(1)[order], x.sum(1)
    up = np.searchsorted(sums, own)
    ways = [(up - 1, -1, -1), (up, 1, n)]  # next entry, direction, where it ends
    best = np.full(len(x), np.iinfo(np.int64).max // k)
    who = np.full(len(x), n)
    live = np.arange(len(x))
    while len(live):
        for at, step, end in ways:
            row = live[(at[live] >= 0) & (at[live] < n)]
            gap = own[row] - sums[at[row]]
            open_ = gap * gap <= best[row] * k
            at[row[~open_]] = end
            row = row[open_]
            entry = order[at[row]]
            d = ((x[row] - entries[entry]) ** 2).sum(1)
            better = (d < best[row]) | (d == best[row]) & (entry < who[row])
            best[row[better]], who[row[better]] = d[better], entry[better]
            at[row] += step
        live = live[(ways[0][0][live] >= 0) | (ways[1][0][live] < n)]
    return who, best


def _blocks(batches, column: int, size: int):
    """(batch, first row, matrix of the vectors of ``size`` components, their rows)."""
    for b in batches:
        for lo in range(0, b.num_rows, ROWS):
            part = b.slice(lo, ROWS)
            v = part.column(column)
            n = np.diff(np.asarray(v.offsets))
            fit = np.flatnonzero(n == size)
            flat = np.asarray(v.filter(pa.array(n == size)).flatten()).astype(np.int64)
            yield part, fit, flat.reshape(len(fit), size)


def _improved(q: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks (parts, entries, k) with each entry the floored mean of its parts."""
    parts, entries, k = books.shape

    def run(batches):
        total, count = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for _, _, x in _blocks(batches, 0, parts * k):
            for p in range(parts):
                part = x[:, p * k:(p + 1) * k]
                who, _ = search(part, books[p])
                count[p] += np.bincount(who, minlength=entries)
                np.add.at(total[p], who, part)
        if count.any():
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(used), pa.array(count.ravel()[used]), pa.array(list(total.reshape(-1, k)[used]), pa.list_(pa.int64()))],
                names=["entry", "n", "total"])

    ship(q.sparkSession)
    sums = q.select("v").mapInArrow(run, "entry long, n long, total array<long>").groupBy("entry").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(k)])
    out = books.reshape(-1, k).copy()
    for r in sums.collect():  # a row an entry
        out[r["entry"]] = [r[f"t{i}"] // r["n"] for i in range(k)]
    return out.reshape(books.shape)


def codebooks(q: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """(parts, entries, components of a part) integers fitted to all of q."""
    by = [F.col("vec_id").asc_nulls_last(), "v"]
    first = q.filter((F.size("v") > 0) & (F.size("v") % parts == 0)).orderBy(*by).limit(1).collect()
    if not first:
        return np.zeros((parts, 0, 1), np.int64)
    size = len(first[0]["v"])
    rows = q.filter(F.size("v") == size).orderBy(*by).limit(entries).collect()
    books = np.array([r["v"] for r in rows], np.int64).reshape(len(rows), parts, size // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = _improved(q, books)
    return books


def encode(q: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error of every row of q."""
    parts, entries, k = books.shape
    label = q.schema["label"].dataType.simpleString()
    ids = q.schema["vec_id"].dataType.simpleString()
    digits = np.array([f"{i:02x}" for i in range(max(entries, 1))])

    def run(batches):
        for part, fit, x in _blocks(batches, 2, parts * k if entries else -1):
            code, error = np.full(part.num_rows, None, object), np.zeros(part.num_rows, np.int64)
            text = np.full(len(fit), "", "U%d" % (2 * parts))
            for p in range(parts if len(fit) else 0):
                who, d = search(x[:, p * k:(p + 1) * k], books[p])
                text = np.char.add(text, digits[who])
                error[fit] += d
            code[fit] = text
            known = np.zeros(part.num_rows, bool)
            known[fit] = True
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(code, pa.string()), pa.array(error, mask=~known)],
                names=["vec_id", "label", "code", "error"])

    ship(q.sparkSession)
    return q.select("vec_id", "label", "v").mapInArrow(run, f"vec_id {ids}, label {label}, code string, error long")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
               parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error, label_error of every whole vector; codebooks)."""
    scratch = Scratch(vectors.sparkSession, "vectors")
    q = scratch.write(quantised(vectors, vec_id, vector, label, scale), "quantised")
    books = codebooks(q, parts, entries, rounds)
    done = scratch.write(encode(q, books), "codes")
    scratch.drop("quantised")
    # written, so that its size decides whether it is broadcast; a hot label's rows can be split
    per = scratch.write(done.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error")), "labels")
    return done.join(per, F.col("label").eqNullSafe(F.col("of")), "left").drop("of"), books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = compressed(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
