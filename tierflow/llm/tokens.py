"""Token counts by a linear longest-match automaton.

Greedy word-piece takes the longest piece that begins a word, then the longest
continuation, and so on. The automaton reads each byte once: a trie of
word-initial and continuation pieces, where every node has a failure link (the
node that holds what is left once the longest pieces have been taken off) and
the number of pieces so taken off. Following links adds up counts; no piece is
ever built. A word that can't be cut into pieces counts as one unknown token.

The vocabulary is a public tokenizer's file, given by path: a token with the
mark for a leading space begins words, any other continues them. Its size is
checked before it is broadcast.

Cases: a null text has no words; repeated rows give a row each; an empty table
gives an empty result; columns other than id and text are not read.
"""
from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tierflow.llm.common import map_batches, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
MAX_VOCABULARY_BYTES = 64 << 20
KEPT_WORDS = 300_000
_UNKNOWN = 1 << 40


def _byte_of() -> dict[str, int]:
    """Byte-level tokenizers print a byte as itself where that is visible, and
    else as the next character from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str = VOCABULARY) -> tuple[list[bytes], list[bytes]]:
    """(pieces that begin words, pieces that continue them)."""
    byte = _byte_of()
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["model"]["vocab"]
    raw = [bytes(byte[c] for c in t) for t in tokens if all(c in byte for c in t)]
    begin = [t[1:] for t in raw if t[:1] == b" " and len(t) > 1]
    go_on = [t for t in raw if t and t[:1] != b" "]
    if sum(map(len, raw)) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"the vocabulary has more than {MAX_VOCABULARY_BYTES} bytes")
    return sorted(begin), sorted(go_on)


def build(begin: list[bytes], go_on: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(edge keys node * 256 + byte, edge targets, failure links, popped counts).

    Node 0 is the root of words, node 1 that of continuations; a link of -1
    means that the text so far can't be cut into pieces.
    """
    child: dict[int, int] = {}
    parent: list[tuple[int, int]] = [(-1, 0), (-1, 0)]
    token = [False, False]
    for root, words in ((0, begin), (1, go_on)):
        for word in words:
            at = root
            for b in word:
                key = at << 8 | b
                if key not in child:
                    child[key] = len(parent)
                    parent.append((at, b))
                    token.append(False)
                at = child[key]
            token[at] = True
    depth = [0] * len(parent)
    for v in range(2, len(parent)):  # a parent is always made before its child
        depth[v] = depth[parent[v][0]] + 1
    fail, popped = [-1] * len(parent), [0] * len(parent)
    for v in sorted(range(2, len(parent)), key=depth.__getitem__):
        if token[v]:
            fail[v], popped[v] = 1, 1
            continue
        u, b = parent[v]
        z, n = fail[u], popped[u]
        while z >= 0 and (z << 8 | b) not in child:
            n += popped[z]
            z = fail[z]
        if z >= 0:
            fail[v], popped[v] = child[z << 8 | b], n
    return (np.fromiter(child.keys(), np.int64), np.fromiter(child.values(), np.int32),
            np.array(fail, np.int32), np.array(popped, np.int32))


class Counter(dict):
    """Word (bytes) to its number of pieces, or to 1 + _UNKNOWN; a bounded memo."""

    def __init__(self, edges, targets, fail, popped, kept: int = KEPT_WORDS):
        self.child = dict(zip(edges.tolist(), targets.tolist()))
        self.fail, self.popped, self.kept = fail.tolist(), popped.tolist(), kept

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.kept:
            self.clear()
        n = self[word] = self.count(word)
        return n

    def count(self, word: bytes) -> int:
        child, fail, popped = self.child, self.fail, self.popped
        at = n = 0
        for b in word:
            while (to := child.get(at << 8 | b)) is None:
                n += popped[at]
                at = fail[at]
                if at < 0:
                    return 1 + _UNKNOWN
            at = to
        while at != 1:  # take off what is left
            n += popped[at]
            at = fail[at]
            if at < 0:
                return 1 + _UNKNOWN
        return n


_KEPT: dict = {}


def count_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_words, n_tokens (an unknown word counts 1) and n_unknown."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(build(*load_vocabulary(vocabulary)))
    name = f"{spark.sparkContext.applicationId}-{shared._jbroadcast.id()}"

    def run(batch: pa.RecordBatch):
        if name not in _KEPT:
            _KEPT.clear()
            _KEPT[name] = Counter(*shared.value)
        counter = _KEPT[name]
        for lo in range(0, batch.num_rows, 256):
            texts = [(t or "").encode().split() for t in batch.column(1).slice(lo, 256).to_pylist()]
            total = [sum(map(counter.__getitem__, words)) for words in texts]
            yield {"_id": batch.column(0).slice(lo, 256), "n_words": [len(w) for w in texts],
                   "n_tokens": [t % _UNKNOWN for t in total], "n_unknown": [t // _UNKNOWN for t in total]}

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_batches(docs.select(doc_id, text), run, f"_id {kind}, n_words long, n_tokens long, n_unknown long") \
        .withColumnRenamed("_id", doc_id)


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"))
