"""Spelling variants: words one edit apart, grouped under the most frequent form.

Two words are near if the longer, of length L, has a common prefix and a common
suffix with the other that together reach L - 1. Words are compared in dense
tiles: their code points stand in padded matrices, once from the left and once
from the right, and a pair of blocks is compared column by column.

Not every block meets every other. If prefix + suffix >= L - 1, one of them is at
least L // 2 long, so near words share a first or a last half: each word is
filed under both, as the longer (L) and as the shorter word (L + 1) of a pair. A
group of more than ``GROUP`` words is filed anew by the same rule: what is between
the shared ends is halved again, until a single place is left, which an alphabet
bounds. A pair is reported by one group alone, the one to which its own common
ends lead (the prefix first), so nothing is sorted out afterwards.

Cases: a null text has no words; a null id is written as nothing before the
colon; repeated rows count repeatedly; an empty table gives an empty result;
other columns of the input are not read.
"""
from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierflow.llm.common import Scratch, ship, table

RUN = r"[A-Za-zÀ-ÿ]+"
MISSPELT, LEAST_LENGTH, LEAST_COUNT, FACTOR = 97, 5, 3, 2
GROUP = 256  # a larger group is split
TILE = 192  # words of a block
HELD = 1 << 14  # words that a task holds, about


def words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per run of letters: lower-cased (A-Z only), with one code point
    deleted where 97 divides the hash of document and run."""
    low = F.translate(F.col(text), string.ascii_uppercase, string.ascii_lowercase)
    own = F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("own")
    runs = docs.select(own, F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("own", F.lit(":"), "run"))
    at = F.pmod(h, F.length("run").cast("long")).cast("int")
    less = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    return runs.select(F.when(h % MISSPELT == 0, less).otherwise(F.col("run")).alias("word"))


def vocabulary(found: DataFrame, length: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """word, n of the words that are long and frequent enough."""
    return (found.filter(F.length("word") >= length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= count))


def _filed(path: Column, a: Column, b: Column) -> list[Column]:
    """An entry of ``word``, of which a leading and b trailing code points are its group's."""
    ends = F.xxhash64(F.col("word").substr(F.lit(1), a),
                      F.col("word").substr(F.greatest(F.length("word") - b + 1, F.lit(1)), b))
    return [F.col("word"), F.col("n"), F.col("long"), path.alias("path"), a.alias("a"), b.alias("b"), ends.alias("k")]


def _split(entries: DataFrame) -> DataFrame:
    """Each entry filed by the first and by the last half of what its group doesn't share."""
    half = F.floor((F.col("long") - F.col("a") - F.col("b")) / 2).cast("int")
    both = F.array(*[F.struct(F.concat("path", F.lit(way)).alias("path"), a.alias("a"), b.alias("b")) for way, a, b in
                     (("p", F.col("a") + half, F.col("b")), ("s", F.col("a"), F.col("b") + half))])
    way = entries.select("word", "n", "long", F.explode(both).alias("to"))
    return way.select(*_filed(F.col("to.path"), F.col("to.a"), F.col("to.b")))


def _common(x: np.ndarray, y: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Equal leading columns of each live pair of rows."""
    live, out = live.copy(), np.zeros(live.shape, np.int32)
    for c in range(x.shape[1]):
        live &= x[:, c][:, None] == y[:, c][None, :]
        if not live.any():
            break
        out += live
    return out


def _tile(left: np.ndarray, right: np.ndarray, long: int, path: str, short: np.ndarray,
          group: np.ndarray, x: slice, y: slice) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs (rows) of the blocks x and y whose own group this is."""
    live = (group[x][:, None] == group[y][None, :]) & ~(short[x][:, None] & short[y][None, :])
    if x == y:
        live &= np.tri(len(live), k=-1, dtype=bool)
    if not live.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before, after = _common(left[x], left[y], live), _common(right[x], right[y], live)
    i, j = np.nonzero(live & (before + after >= long - 1))
    prefix, a, b, here = before[i, j], 0, 0, np.ones(len(i), bool)
    for way in path:
        half = (long - a - b) // 2
        here &= (prefix >= a + half) == (way == "p")
        a, b = (a + half, b) if way == "p" else (a, b + half)
    return i[here] + x.start, j[here] + y.start


def near_pairs(entries: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of near words; groups (long, path, k) lie together."""
    long, k = entries["long"].to_numpy(), entries["k"].to_numpy()
    path = entries["path"].to_numpy(zero_copy_only=False)
    size = entries["word"].to_pylist()
    flat = np.frombuffer("".join(size).encode("utf-32-le"), np.uint32)
    size = np.fromiter(map(len, size), np.int64, len(size))
    off = np.cumsum(size) - size
    kind = np.append(True, (long[1:] != long[:-1]) | (path[1:] != path[:-1]))
    head = np.flatnonzero(kind | np.append(True, k[1:] != k[:-1]))
    group = np.cumsum(np.bincount(head, minlength=len(k))) - 1
    stop = np.append(head[1:], len(k))
    found, g = [], 0
    while g < len(head):
        e = g + 1  # whole groups of one kind make a block; a large group makes several
        while e < len(head) and not kind[head[e]] and stop[e] - head[g] <= TILE:
            e += 1
        lo, hi = head[g], stop[e - 1]
        g = e
        if hi - lo < 2:
            continue
        n, width = size[lo:hi], int(long[lo])
        step = max(1, min(TILE, (1 << 22) // width))  # rows of a block, fewer of very long words
        at = np.arange(width)
        for s in range(0, hi - lo, step):
            x = slice(s, min(s + step, hi - lo))
            for t in range(0, s + 1, step):
                y = slice(t, min(t + step, hi - lo))
                rows = np.r_[x, y] if s != t else np.r_[x]
                o, m = off[lo + rows][:, None], n[rows][:, None]
                left = np.where(at < m, flat[np.minimum(o + at, len(flat) - 1)], 0)
                right = np.where(at < m, flat[np.maximum(o + m - 1 - at, 0)], 0)
                u = slice(0, x.stop - x.start)
                v = slice(u.stop, u.stop + y.stop - y.start) if s != t else u
                i, j = _tile(left, right, width, path[lo], (n[rows] < width), group[lo + rows], u, v)
                found.append((lo + rows[i], lo + rows[j]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _nearest(entries: pa.Table) -> pa.RecordBatch:
    """word, n_near, and of its near words the one of largest n (smallest on a tie)."""
    i, j = near_pairs(entries)
    n = entries["n"].to_numpy()
    word = entries["word"].combine_chunks()
    text = word.to_pylist()
    rank = np.empty(len(text), np.int64)
    rank[sorted(range(len(text)), key=text.__getitem__)] = np.arange(len(text))
    one, other = np.concatenate([i, j]), np.concatenate([j, i])
    o = np.lexsort((rank[other], -n[other], one))
    one, other = one[o], other[o]
    head = np.flatnonzero(np.append(True, one[1:] != one[:-1])[: len(one)])
    count = np.diff(np.append(head, len(one)))
    best = other[head]
    return pa.RecordBatch.from_arrays(
        [word.take(pa.array(one[head])), pa.array(count), pa.array(n[best]), word.take(pa.array(best))],
        names=["word", "n_near", "best_n", "best"])


def _compared(entries: DataFrame) -> DataFrame:
    """A row per word and task part with near words; the task holds whole groups."""
    keys = ["long", "path", "k"]

    def run(batches):
        held, rows = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows < HELD:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            last = [t[c][-1] for c in keys]
            whole = t.num_rows - 1
            while whole and [t[c][whole - 1] for c in keys] == last:
                whole -= 1
            if whole:
                yield _nearest(t.slice(0, whole).combine_chunks())
            held = t.slice(whole).combine_chunks().to_batches()
            rows -= whole
        if held:
            yield _nearest(pa.Table.from_batches(held).combine_chunks())

    ship(entries.sparkSession)
    return entries.select("word", "n", *keys).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(
        run, "word string, n_near long, best_n long, best string")


def nearest(vocab: DataFrame, scratch: Scratch, limit: int = GROUP) -> DataFrame:
    """Partial rows (word, n_near, best_n, best) of the words that have near ones."""
    longs = F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("long")
    level = _split(vocab.select("word", "n", longs).withColumns(
        {"path": F.lit(""), "a": F.lit(0), "b": F.lit(0)}))
    done, keys = None, ["long", "path", "k"]
    while True:
        level = scratch.write(level, "filed")
        large = (level.filter("long - a - b > 1").groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
                 .filter(F.col("size") > limit).select(*keys))
        large = scratch.write(large, "large")
        last = large.isEmpty()
        ready = level if last else level.join(large, keys, "left_anti")
        part = scratch.write(_compared(ready), "near")
        done = part if done is None else done.unionAll(part)
        if last:
            scratch.drop("filed", "large")
            return done
        level = _split(level.join(large, keys, "left_semi"))  # read before it is trimmed


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word and root of (word, form): the end of the chain of forms. A form is at
    least twice as frequent as its word, so a chain has no ring and no more
    links than n has bits; each round doubles the links that are followed."""
    at = scratch.write(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("to"), F.col("root").alias("next"))
        at = scratch.write(at.join(ahead, F.col("root") == F.col("to"), "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        scratch.trim("roots")
        if at.filter("moved").isEmpty():
            return at.select("word", "root")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", factor: int = FACTOR,
             limit: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near, form_n of the whole vocabulary of docs."""
    scratch = Scratch(docs.sparkSession, "spelling")
    vocab = scratch.write(vocabulary(words(docs, doc_id, text)), "vocabulary")
    none = lambda kind: F.lit(None).cast(kind)
    rows = vocab.select("word", "n", F.lit(0).cast("long").alias("n_near"), none("long").alias("best_n"),
                        none("string").alias("best"))
    rows = rows.unionByName(nearest(vocab, scratch, limit).withColumn("n", none("long")))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("form"))))
    per = rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    is_form = -F.col("best.n") >= F.col("n") * factor
    per = scratch.write(per.select("word", "n", "n_near", F.when(is_form, F.col("best.form")).alias("form"),
                                   F.when(is_form, -F.col("best.n")).alias("form_n")), "words")
    scratch.drop("vocabulary", "near")
    end = roots(per.filter("form IS NOT NULL"), scratch)
    return per.join(end, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents", "doc_id", "text"))
