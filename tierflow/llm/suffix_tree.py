"""Substring de-duplication by prefix-partitioned suffix trees over words.

Suffixes begin at windows of words and are split by prefixes of variable
length: first by the gram that anchors their windows (see ``repeats``), a hot
gram by whole windows, and in a task by one word more at each level of the
tree. A suffix that is alone under its prefix is a leaf and goes no deeper; a
node as deep as the window with two or more suffixes is a repeat. Overlapping
repeats of one document make up its maximal removed runs. The first place of a
repeat (smallest id, then earliest start) stays.

Cases: a null text has no words; a text with fewer words than the window is
never cut; repeated rows have one id, so neither comes before the other; a null
id comes before all others; an empty table gives an empty result; other columns
of the input are not read.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierflow.llm import repeats as R
from tierflow.llm import textnp as T
from tierflow.llm.common import table

WINDOW, GRAM = 20, 4


def _symbols(buf: np.ndarray, off: np.ndarray, family: int):
    w = T.Words(buf, off)
    return w.hashes(family), w.first, w.start, w.end


def _places(buf: np.ndarray, off: np.ndarray):
    w = T.Words(buf, off)
    return w.first, w.start, w.end


def _judge(window: int, b: R.Batch):
    """Windows of which another content, or a place in one, has an earlier copy."""
    count = b.n - window + 1
    who = np.repeat(np.arange(len(count)), count)
    at = T.ranges(np.zeros(len(count), np.int64), count)
    word = T.Words(b.buf, b.off).codes()  # words are told apart by their bytes
    words = int(word.max(initial=0)) + 1
    where = b.first[who] + at
    node, alive = b.group[who].astype(np.int64), np.arange(len(who))
    for depth in range(window):  # one level of the tree: the next word splits each node
        edge = node * words + word[where[alive] + depth]
        _, node, size = np.unique(edge, return_inverse=True, return_counts=True)
        inner = size[node] > 1
        alive, node = alive[inner], node[inner]
        if not len(alive):
            break
    # the first place of each deep node stays
    key, place = b.key[who[alive]], b.at[who[alive]] + at[alive]
    o = np.lexsort((place, key, node))
    node, key, place = node[o], key[o], place[o]
    head = np.append(True, node[1:] != node[:-1])[: len(node)]
    first = np.maximum.accumulate(np.where(head, np.arange(len(node)), 0))
    later = (key != key[first]) | (place != place[first])
    hit = alive[o[later]]
    return who[hit], at[hit], at[hit]


WORDS = R.Kind(WINDOW, GRAM, _symbols, _places, _judge, first_stays=True)


def _apply(text: bytes, start: np.ndarray, end: np.ndarray):
    words = text.split()  # bytes split at ASCII white space
    n = len(words)
    for s, e in zip(start[::-1].tolist(), end[::-1].tolist()):
        del words[s:e]
    return b" ".join(words), n, [{"start": s, "end": e} for s, e in zip(start.tolist(), end.tolist())]


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", kind: R.Kind = WORDS) -> DataFrame:
    """doc_id, kept (words that stay, joined by a space), n_words, and spans
    (maximal removed runs, in words)."""
    return R.cut_out(docs, doc_id, text, kind, _apply, "kept binary, n_words long, spans array<struct<start:long,end:long>>")


def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
