"""Benchmark decontamination by pigeonhole edit matching.

An item of n characters may be found with up to ``rate`` * n edits. Cut into
one piece more than its budget of errors, at least one piece of any such
occurrence is unchanged. An automaton over all pieces finds exact hits in a
single pass over each text; around a hit, Myers' bit-parallel algorithm gives
the least edit distance of the whole item. Texts and items are lower-cased and
their white space collapsed.

The benchmark is the query set. It goes to the tasks in blocks of at most
about BLOCK_CHARS characters, one pass over the documents for each block.

Cases: null, empty and blank items match nothing; a null text holds nothing;
repeated items and repeated rows give a row each; an empty table gives an
empty result; columns other than id and text are not read.
"""
from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierflow.llm.common import map_batches, ship, table

RATE, BLOCK_CHARS = 0.05, 4 << 20


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(n: int, rate: float = RATE) -> int:
    return int(n * rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): errors + 1 pieces of nearly equal length."""
    cut = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:]) if b > a]


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(mask: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(least distance, its first end) of a pattern of m characters against any
    substring of text."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, at = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = mask.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        if score < best:
            best, at = score, j + 1
    return best, at


class Matcher:
    """Items found in a text within their budgets."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        self.items = [(i, t, budget(len(t), rate)) for i, t in items if t]
        by_piece: dict[str, list] = {}
        for n, (_, t, e) in enumerate(self.items):
            for at, piece in pieces(t, e):
                by_piece.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in by_piece.items():
            self.automaton.add_word(piece, (len(piece), where))
        if by_piece:
            self.automaton.make_automaton()
        self.any = bool(by_piece)
        self.masks: dict[int, dict] = {}

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item id, least distance, end of it in the normal text)."""
        if not self.any or not text:
            return []
        starts: dict[int, set] = {}
        for end, (size, where) in self.automaton.iter(text):
            for n, at in where:
                starts.setdefault(n, set()).add(end + 1 - size - at)
        out = []
        for n, found in starts.items():
            item, t, e = self.items[n]
            exact = [s for s in found if s >= 0 and text.startswith(t, s)]
            if exact:
                out.append((item, 0, min(exact) + len(t)))
                continue
            if n not in self.masks:
                self.masks[n] = masks(t)
            best = None
            for lo, hi in self.windows(sorted(found), len(t), e, len(text)):
                d, at = myers(self.masks[n], len(t), text[lo:hi])
                if d <= e and (best is None or (d, lo + at) < best):
                    best = d, lo + at
            if best:
                out.append((item, *best))
        return out

    @staticmethod
    def windows(starts: list[int], size: int, errors: int, n: int):
        """Stretches of text that hold every occurrence near the starts; near
        starts share one, so no character is read twice for an item."""
        lo = hi = None
        for s in starts:
            a, b = max(0, s - errors), min(n, s + size + errors)
            if lo is not None and a <= hi:
                hi = max(hi, b)
                continue
            if lo is not None:
                yield lo, hi
            lo, hi = a, b
        if lo is not None:
            yield lo, hi


_KEPT: dict = {}


def _matcher(block) -> Matcher:
    """The block's matcher, made once in a worker."""
    if block.id not in _KEPT:
        _KEPT.clear()
        _KEPT[block.id] = Matcher(*block.value)
    return _KEPT[block.id]


class _Block:
    def __init__(self, spark: SparkSession, items: list, rate: float):
        self.shared = spark.sparkContext.broadcast((items, rate))
        self.id = f"{spark.sparkContext.applicationId}-{self.shared._jbroadcast.id()}"

    def __getstate__(self):
        return {"shared": self.shared, "id": self.id}

    @property
    def value(self):
        return self.shared.value


def blocks(spark: SparkSession, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS):
    """The benchmark (item_id, text) in broadcast blocks of about block_chars."""
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n = int(total // block_chars) + 1
    for b in range(n):
        rows = benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).select("item_id", "text").collect()
        yield _Block(spark, [(r.item_id, normal(r.text)) for r in rows], rate)


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """id, item_id, distance, end: a row per row of docs (id, text) and item in it."""
    out = None
    for block in blocks(docs.sparkSession, benchmark, rate, block_chars):
        def run(batch: pa.RecordBatch, block=block):
            m = _matcher(block)
            ids, text = batch.column(0).to_pylist(), batch.column(1)
            for lo in range(0, batch.num_rows, 256):
                rows = [(ids[lo + i], *hit) for i, t in enumerate(text.slice(lo, 256).to_pylist()) for hit in m.find(normal(t))]
                if rows:
                    yield dict(zip(("id", "item_id", "distance", "end"), zip(*rows)))

        one = map_batches(docs, run, "id long, item_id long, distance int, end long")
        out = one if out is None else out.unionAll(one)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 rate: float = RATE) -> DataFrame:
    """doc_id, item_id, distance and end (in the normal text)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    return matches(rows, benchmark, rate).withColumnRenamed("id", doc_id)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", rate: float = RATE) -> DataFrame:
    """The rows of docs in which no item is found, in one pass for each block."""
    ship(docs.sparkSession)
    out = docs.select(F.struct("*").alias("row"))
    for block in blocks(docs.sparkSession, benchmark, rate):
        def run(batches, block=block):
            m = _matcher(block)
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    part = batch.slice(lo, 256)
                    yield part.filter(pa.array([not m.find(normal(t)) for t in part.column(0).field(text).to_pylist()], pa.bool_()))

        out = out.mapInArrow(run, out.schema)
    return out.select("row.*")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents", "doc_id", "text"),
                        table(spark, sf_dir, "benchmark", "item_id", "text")).select("doc_id", "item_id", "distance")
