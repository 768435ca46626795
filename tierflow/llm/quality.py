"""Host-level quality rules.

Every document is measured. Failures of each rule are counted for each host, the
rates are shrunk towards the corpus by a beta prior whose parameters come from the
hosts themselves (beta-binomial moments, hosts weighted by documents), and a host's
verdict is joined back to its documents: a document goes if it fails the base
rule, or if its host fails any one rule too often. Words and lines are compared by their bytes.

Cases: a null text has no words; a null host is a host of its own; an empty
table gives an empty result; repeated rows count and come back repeatedly;
``passing`` carries all other columns, whatever their names.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierflow.llm import textnp as T
from tierflow.llm.common import materialize, ship, table

#: Rules by name, as conditions on a document's counts. base: too short or too repetitive;
#: symbols: more than one in ten words; lines: more than three in ten repeat an earlier
#: one; short_words: under two code points on average, as in spaced-out letters. (Long
#: words are no rule: scripts without spaces have them.)
RULES = {"base": "n_words < 50 OR 100 * n_repeat_words > 50 * n_words",
         "symbols": "10 * n_symbols > n_words",
         "lines": "10 * n_dup_lines > 3 * n_lines",
         "short_words": "word_chars < 2 * n_words"}
#: A host is rejected when its shrunk rate of failures of any rule reaches this.
MAX_HOST_RATE = 0.75
#: Bounds of the prior's strength, in documents.
WEAKEST, STRONGEST = 1.0, 1e6

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_LEAD = (np.arange(256) & 0xC0) != 0x80  # a byte that begins a code point


def _repeats(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """True where (group, key) is found more than once."""
    order = np.lexsort((key, group))
    g, k = group[order], key[order]
    same = np.zeros(len(g), bool)
    same[1:] = (g[1:] == g[:-1]) & (k[1:] == k[:-1])
    twice = same.copy()
    twice[:-1] |= same[1:]
    out = np.zeros(len(g), bool)
    out[order] = twice
    return out


def _later(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """True where the same (group, key) stands at an earlier position."""
    order = np.lexsort((np.arange(len(key)), key, group))
    g, k = group[order], key[order]
    out = np.zeros(len(g), bool)
    out[order[1:]] = (g[1:] == g[:-1]) & (k[1:] == k[:-1])
    return out


def _per_doc(doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, minlength=n).astype(np.int64)


def measure_chunk(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The six counts of each document of a chunk."""
    n = len(off) - 1
    words = T.Words(buf, off)
    out = {"n_words": np.diff(words.first).astype(np.int64)}
    doc_of = np.repeat(np.arange(n), np.diff(off))
    out["word_chars"] = _per_doc(doc_of[_LEAD[buf] & ~T.SPACE[buf]], n)
    out["n_symbols"] = _per_doc(doc_of[_SYMBOL[buf]], n)

    # lines: cut at \n and at the ends of documents
    newline = np.flatnonzero(buf == 10)
    start = np.union1d(newline + 1, off[:-1])
    start = start[start < len(buf)]
    end = np.sort(np.concatenate([newline, off[1:]]))
    line_of = np.searchsorted(start, words.start, "right") - 1
    with_word = np.unique(line_of)
    s = start[with_word]
    e = end[np.searchsorted(end, s, "right")] if len(s) else s  # a line with a word isn't empty
    line = T.span_codes(buf, s, e)
    line_doc = words.doc[np.searchsorted(words.start, s)] if len(s) else s
    out["n_lines"] = _per_doc(line_doc, n)
    out["n_dup_lines"] = _per_doc(line_doc[_later(line_doc, line)], n)

    # words in 3-word windows that are found twice or more
    covered = np.zeros(len(words) + 3, np.int64)
    if len(words) >= 3:
        gram = T.gram_codes(words.codes(), 3)
        inside = np.flatnonzero(words.doc[:-2] == words.doc[2:])
        at = inside[_repeats(words.doc[inside], gram[inside])]
        covered[at] += 1
        covered[at + 3] -= 1
    covered = np.cumsum(covered)[: len(words)] > 0
    out["n_repeat_words"] = _per_doc(words.doc[covered], n)
    return out


def measure(docs: DataFrame, text: str = "text", row: str | None = None) -> DataFrame:
    """docs without ``text`` and with the six counts of each whole text; with
    ``row``, the text is a field of that struct column, which stays."""
    keep = [c for c in docs.columns if row or c != text]
    fields = [docs.schema[c] for c in keep]
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType(fields + [StructField(c, LongType()) for c in _COUNTS])

    def run(batches):
        for batch in batches:
            rest = [batch.column(c) for c in keep]
            texts = batch.column(row).field(text) if row else batch.column(text)
            for lo, hi, buf, off in T.chunks(texts):
                counts = measure_chunk(buf, off)
                yield pa.RecordBatch.from_arrays(
                    [x.slice(lo, hi - lo) for x in rest] + [pa.array(counts[c]) for c in _COUNTS],
                    names=[*keep, *_COUNTS])

    ship(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def host_verdicts(measured: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host: documents, failures and shrunk rate of each rule, verdict.

    For each rule the prior Beta(a, b) has the corpus rate m as its mean. Its strength is
    a + b = 1 / r - 1, where r is the correlation within hosts by the moments
    of the beta-binomial distribution: with S = sum(n (rate - m)^2) over k hosts of n documents
    and N in all, r = (S / (m (1 - m)) - (k - 1)) / (N - sum(n^2) / N - (k - 1)). It is held between
    ``WEAKEST`` and ``STRONGEST``, the latter too where hosts differ no more than by chance. The
    shrunk rate is (failures + a) / (documents + a + b).
    """
    per_host = measured.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n_docs"),
        *[F.count_if(F.expr(rule)).alias(f"fail_{name}") for name, rule in RULES.items()])
    per_host = materialize(per_host, "quality-hosts")
    n = F.col("n_docs").cast("double")
    sums = per_host.agg(  # one row
        F.count(F.lit(1)).alias("k"), F.sum(n).alias("n"), F.sum(n * n).alias("n2"),
        *[F.sum(f"fail_{r}").cast("double").alias(f"x_{r}") for r in RULES],
        *[F.sum(F.col(f"fail_{r}") * F.col(f"fail_{r}") / n).alias(f"xx_{r}") for r in RULES]).first()
    out = per_host
    for r in RULES:
        m, strength = _prior(sums["k"], sums["n"] or 0.0, sums["n2"] or 0.0, sums[f"x_{r}"] or 0.0, sums[f"xx_{r}"] or 0.0)
        out = out.withColumn(f"rate_{r}", (F.col(f"fail_{r}") + m * strength) / (F.col("n_docs") + strength))
    return out.select(
        "host", "n_docs", *[f"fail_{r}" for r in RULES], *[f"rate_{r}" for r in RULES],
        (F.greatest(*[f"rate_{r}" for r in RULES]) < max_rate).alias("host_ok"))


def _prior(k: int, n: float, n2: float, x: float, xx: float) -> tuple[float, float]:
    """Mean and strength from the number of hosts and the sums of documents, their
    squares, failures, and failures squared by documents."""
    m = x / n if n else 0.0
    free = n - n2 / n - (k - 1) if n else 0.0
    if not 0.0 < m < 1.0 or free <= 0.0:
        return m, STRONGEST
    within = ((xx - x * x / n) / (m * (1.0 - m)) - (k - 1)) / free
    return m, min(max(1.0 / max(within, 1e-9) - 1.0, WEAKEST), STRONGEST)


def judge(docs: DataFrame, ids: list[str], host: str = "source", text: str = "text") -> DataFrame:
    """ids, counts, base_failed, the host's rate and kept, a row per row of docs."""
    m = materialize(measure(docs.select(*ids, F.col(host).alias("host"), F.col(text).alias("text"))), "quality")
    v = host_verdicts(m, "host").select(F.col("host").alias("v_host"), "rate_base", "host_ok")
    base = F.expr(RULES["base"])
    return m.join(v, F.col("host").eqNullSafe(F.col("v_host")), "left").select(
        *ids, *_COUNTS, base.alias("base_failed"), F.col("rate_base").alias("host_rate"),
        (~base & F.col("host_ok")).alias("kept"))


def passing(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The rows of docs that keep their place. Texts are measured twice, once
    for the hosts and once to filter, and are never shuffled."""
    verdict = host_verdicts(measure(docs.select(F.col(host).alias("host"), F.col(text).alias("text"))), "host")
    v = verdict.select(F.col("host").alias("v_host"), "host_ok")
    rows = measure(docs.select(F.struct("*").alias("row"), F.col(host).alias("host")), text, "row")
    fit = rows.filter(~F.expr(RULES["base"])).select("row", "host")
    return fit.join(v, F.col("host").eqNullSafe(F.col("v_host"))).filter("host_ok").select("row.*")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    return judge(docs, ["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.round("host_rate", 9).alias("host_rate"))
