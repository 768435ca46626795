"""Repeated windows of a corpus, found around content-defined anchors.

Shared by the two substring operators. A window (so many symbols of one
document) is the string to be judged. Every window has an anchor, the start of
its least-hashed short gram, so that equal windows meet under the gram's hash
with equal distances to it. A *run* is the stretch of text whose consecutive
windows share an anchor; a document has a run for some forty windows' worth
of text, and only runs travel:

1. grams that occur once are dropped by a count with map-side combining;
2. runs with equal content become one *content* with its count and first place;
3. grams with two or more contents send one copy of each content to the task
   of the gram, where the operator's own method finds equal windows;
4. spans go back to the places of each content and are cut out of the texts.

A gram with more than ``HOT`` contents isn't gathered: its key is lengthened
to the whole window, and equal windows are counted with map-side combining.
Texts travel compressed, written once with a number for each row, by which the
row is known from there on: repeated ids and repeated rows are rows of their own,
and none gathers another's spans. A null id counts as the smallest.

What rests on hashes: that two runs of one gram hash are equal contents (two
polynomial hashes modulo 2 ** 61 - 1 of independent bases, 122 bits), and that
windows of a hot gram are equal (the same). Within a gram the operator compares
the bytes.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierflow.llm import textnp as T
from tierflow.llm.common import MIN_LONG, Scratch, key_of, map_batches, ship

HOT = 20_000
#: Contents are handed to an operator in groups of whole grams of about this many.
BATCH_ROWS, BATCH_BYTES = 8_000, 4 << 20


@dataclass(frozen=True)
class Kind:
    """symbols(buf, off, family) gives a 64-bit symbol for each position, by one of two
    independent hashes, the first position of each document, and the byte range of each symbol."""
    window: int
    gram: int
    symbols: Callable
    #: places(buf, off): the last three of these
    places: Callable
    #: (window, Batch) -> (content index, first window, last window) of runs of judged windows
    judge: Callable
    first_stays: bool


@dataclass
class Batch:
    """Contents of whole grams: ``group`` ascending, ``left`` symbols before the
    anchor, ``n`` symbols in all, ``first`` symbol of each; ``buf[off[i]:off[i + 1]]``
    is the text. ``key`` and ``at`` are the first place."""
    group: np.ndarray
    left: np.ndarray
    n: np.ndarray
    first: np.ndarray
    buf: np.ndarray
    off: np.ndarray
    key: np.ndarray
    at: np.ndarray


def packed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """r (a number of its own for each row), k (the id) and z (the text as a Zstandard frame; null: null).
    The numbers hold once this is written."""
    def run(batch: pa.RecordBatch):
        z = zstandard.ZstdCompressor(level=1)
        texts = batch.column(2).cast(pa.large_binary())
        for lo in range(0, len(texts), 256):
            part = texts.slice(lo, 256)
            yield {"r": batch.column(0).slice(lo, 256), "k": batch.column(1).slice(lo, 256),
                   "z": [None if x is None else z.compress(x) for x in part.to_pylist()]}

    rows = docs.select(F.monotonically_increasing_id().alias("r"), key_of(doc_id).alias("k"), F.col(text).alias("text"))
    return map_batches(rows, run, "r long, k long, z binary")


def _grams(kind: Kind, rows: DataFrame) -> DataFrame:
    """h of every run: what is counted before contents are hashed at all."""
    def run(batch: pa.RecordBatch):
        for _, _, buf, off in T.unpacked(batch.column(0)):
            symbols, first, *_ = kind.symbols(buf, off, 0)
            yield {"h": T.as_long(T.anchors(symbols, first, kind.window, kind.gram)[4])}

    return map_batches(rows.select("z"), run, "h long")


def _runs(kind: Kind, rows: DataFrame) -> DataFrame:
    """h (gram hash), c and c2 (content hashes), r, k, at (first symbol), span (left << 32 | length)."""
    def run(batch: pa.RecordBatch):
        r, k = (batch.column(i).to_numpy() for i in (0, 1))
        for lo, _, buf, off in T.unpacked(batch.column(2)):
            symbols, first, *_ = kind.symbols(buf, off, 0)
            doc, s, e, anchor, h = T.anchors(symbols, first, kind.window, kind.gram)
            end = e + kind.window
            shape = T.mix(((end - s).astype(T.U) << T.U(32)) + (anchor - s).astype(T.U))
            c = T.mix(T.span_hash(T.prefix_hash(symbols), s, end) ^ shape)
            other = T.prefix_hash(kind.symbols(buf, off, 1)[0], 1)
            row = lo + doc
            yield {"h": T.as_long(h), "c": T.as_long(c), "c2": T.as_long(T.span_hash(other, s, end, 1)), "r": r[row],
                   "k": k[row], "at": s - first[doc], "span": (anchor - s) << 32 | (end - s)}

    return map_batches(rows, run, "h long, c long, c2 long, r long, k long, at long, span long")


def _contents(kind: Kind, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The text of one copy of each wanted content (h, c, c2, m, r, k, at, span)."""
    per_row = wanted.groupBy("r").agg(F.collect_list(F.struct("h", "c", "c2", "m", "at", "span")).alias("runs"))

    def run(batch: pa.RecordBatch):
        unpack = zstandard.ZstdDecompressor()
        for i in range(batch.num_rows):
            z, runs = batch.column(1)[i].as_py(), batch.column(2).slice(i, 1).flatten()
            text = unpack.decompress(z) if z else b""
            cols = {n: runs.field(n).to_numpy(zero_copy_only=False) for n in ("h", "c", "c2", "m", "at", "span")}
            buf = np.frombuffer(text, np.uint8)
            start, end = kind.places(buf, np.array([0, len(buf)]))[1:]
            n = cols["span"] & 0xFFFFFFFF
            a, b = start[cols["at"]], end[cols["at"] + n - 1]
            yield {**cols, "k": np.full(len(n), batch.column(0)[i].as_py()),
                   "text": [text[x:y] for x, y in zip(a.tolist(), b.tolist())]}

    joined = rows.join(per_row, "r").select("k", "z", "runs")
    return map_batches(joined, run, "h long, c long, c2 long, m long, k long, at long, span long, text binary")


def _batch(kind: Kind, t: pa.Table) -> Batch:
    h = t["h"].to_numpy()
    span = t["span"].to_numpy()
    group = np.cumsum(np.append(False, h[1:] != h[:-1]))
    text = t["text"].combine_chunks().cast(pa.large_binary())
    _, offs, data = text.buffers()
    off = np.frombuffer(offs, np.int64, len(text) + 1, text.offset * 8)
    buf = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if len(text) else np.zeros(0, np.uint8)
    off = off - off[0]
    return Batch(group, span >> 32, span & 0xFFFFFFFF, kind.places(buf, off)[0][:-1], buf, off, t["k"].to_numpy(), t["at"].to_numpy())


def _spans(window: int, content: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, list]:
    """(contents, their spans [start, end, start, end ...]) of judged windows lo..hi."""
    step = np.int64(1) << 32
    s, e = T.union_spans(content * step + lo, content * step + hi + window)
    who = s // step
    flat = np.empty(2 * len(s), np.int32)
    flat[0::2], flat[1::2] = s - who * step, e - who * step
    own, at = np.unique(who, return_index=True)
    return own, np.split(flat, 2 * at[1:]) if len(own) else []


def _judged(kind: Kind, contents: DataFrame) -> DataFrame:
    """h, c, c2, cut: spans of each content's judged windows. Grams come whole and together."""
    schema = "h long, c long, c2 long, cut array<int>"

    def emit(t: pa.Table) -> pa.RecordBatch:
        who, cut = _spans(kind.window, *kind.judge(kind.window, _batch(kind, t)))
        return pa.RecordBatch.from_arrays(
            [*[pa.array(t[n].to_numpy()[who]) for n in ("h", "c", "c2")], pa.array(cut, pa.list_(pa.int32()))],
            names=["h", "c", "c2", "cut"])

    def run(batches):
        held, rows, size = [], 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows, size = rows + b.num_rows, size + b.nbytes
            if rows < BATCH_ROWS and size < BATCH_BYTES:
                continue
            t = pa.Table.from_batches(held)
            h = t["h"].to_numpy()
            whole = int(np.searchsorted(h, h[-1]))  # the last gram may go on
            if whole:
                yield emit(t.slice(0, whole))
            held = t.slice(whole).combine_chunks().to_batches()
            rows, size = len(h) - whole, sum(x.nbytes for x in held)
        if held:
            yield emit(pa.Table.from_batches(held))

    ship(contents.sparkSession)
    return contents.repartition("h").sortWithinPartitions("h").mapInArrow(run, schema)


def _hot(kind: Kind, contents: DataFrame, scratch: Scratch) -> DataFrame:
    """The same for hot grams, keyed by whole windows."""
    def windows(batch: pa.RecordBatch):
        for lo in range(0, batch.num_rows, 2000):
            t = pa.Table.from_batches([batch.slice(lo, 2000)])
            b = _batch(kind, t)
            count = b.n - kind.window + 1
            who = np.repeat(np.arange(len(count)), count)
            at = T.ranges(np.zeros(len(count), np.int64), count)
            s = b.first[who] + at
            x, y = (T.span_hash(T.prefix_hash(kind.symbols(b.buf, b.off, f)[0], f), s, s + kind.window, f) for f in (0, 1))
            yield {**{n: t[n].to_numpy()[who] for n in ("h", "c", "c2")}, "p": at.astype(np.int32),
                   "x": T.as_long(x), "y": T.as_long(y), "k": b.key[who], "at": b.at[who] + at}

    w = map_batches(contents, windows, "h long, c long, c2 long, p int, x long, y long, k long, at long")
    same = scratch.write(w.groupBy("x", "y").agg(F.count(F.lit(1)).alias("w"), F.min(F.struct("k", "at")).alias("o"))
                         .filter("w > 1"), "windows")
    hit = w.join(same, ["x", "y"])
    if kind.first_stays:
        hit = hit.filter((F.col("k") != F.col("o.k")) | (F.col("at") != F.col("o.at")))

    def merge(batch: pa.RecordBatch):
        cuts = []
        for p in batch.column(3):
            s = np.array(p.as_py(), np.int64)
            a, b = T.union_spans(s, s + kind.window)
            cuts.append(np.stack([a, b], 1).ravel().astype(np.int32))
        yield {"h": batch.column(0), "c": batch.column(1), "c2": batch.column(2), "cut": cuts}

    return map_batches(hit.groupBy("h", "c", "c2").agg(F.collect_list("p").alias("p")), merge,
                       "h long, c long, c2 long, cut array<int>")


def spans_of(kind: Kind, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """r, starts and ends (symbols, unsorted, may overlap) of what the judged
    windows of each row cover; rows is ``packed`` and written."""
    runs = _runs(kind, rows)
    content = ["h", "c", "c2"]
    # counts are written before they are joined: Spark splits a hot key only where
    # both sides of the join come straight from a shuffle
    often = scratch.write(_grams(kind, rows).groupBy("h").count().filter("count > 1").select("h"), "grams")
    found = scratch.write(runs.join(often, "h"), "runs")
    scratch.drop("grams")
    classes = scratch.write(
        found.groupBy(*content).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "at", "r", "span")).alias("o"))
        .select(*content, "n", "o.*"), "contents")
    several = scratch.write(classes.groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "several")
    contents = scratch.write(_contents(kind, rows, classes.join(several, "h")), "texts")
    scratch.drop("several")
    cuts = _judged(kind, contents.filter(F.col("m") <= HOT))
    hot = contents.filter(F.col("m") > HOT)
    if not hot.isEmpty():
        cuts = cuts.unionAll(_hot(kind, hot, scratch))
    if kind.first_stays:
        here = (F.col("k") != F.col("ok")) | (F.col("at") != F.col("oat"))
    else:
        here = F.col("n") > 1
    length = F.col("span").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    verdict = classes.select(*content, "n", F.col("k").alias("ok"), F.col("at").alias("oat")).join(cuts, content, "left")
    verdict = scratch.write(verdict.filter("n > 1 OR cut IS NOT NULL"), "verdicts")
    scratch.drop("contents", "texts", "windows")
    cut = F.when(here, F.array(F.lit(0), length)).otherwise(F.col("cut"))
    spans = (found.join(verdict, content)
             .select("r", F.transform(cut, lambda x: x + F.col("at")).alias("cut"))
             .filter("cut IS NOT NULL").groupBy("r").agg(F.flatten(F.collect_list("cut")).alias("cut")))
    spans = scratch.write(spans, "spans")
    scratch.drop("runs", "verdicts")
    return spans


def cut_out(docs: DataFrame, doc_id: str, text: str, kind: Kind, apply: Callable, schema: str) -> DataFrame:
    """Apply ``apply(text bytes, starts, ends) -> dict of one row`` to every row of
    docs, with merged ascending spans; ``k`` becomes doc_id again."""
    scratch = Scratch(docs.sparkSession, "repeats")
    rows = scratch.write(packed(docs, doc_id, text), "packed")
    cuts = spans_of(kind, rows, scratch)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batch: pa.RecordBatch):
        unpack = zstandard.ZstdDecompressor()
        out, size = [], 0
        for k, z, cut in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            z = z.as_py()
            flat = cut.values.to_numpy() if cut.is_valid else np.zeros(0, np.int64)
            s, e = T.union_spans(flat[0::2], flat[1::2])
            row = apply(unpack.decompress(z) if z else b"", s, e)
            out.append((k, *row))
            size += sum(len(x) for x in row if isinstance(x, bytes))
            if size > T.CHUNK_BYTES:
                yield dict(zip(("k", *names), zip(*out)))
                out, size = [], 0
        if out:
            yield dict(zip(("k", *names), zip(*out)))

    joined = rows.join(cuts, "r", "left").select("k", "z", "cut")
    done = map_batches(joined, run, f"k long, {schema}")
    return done.select(F.when(F.col("k") != MIN_LONG, F.col("k")).alias(doc_id), *names)
