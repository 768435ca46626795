"""License scans by a positional rare-token index.

The index maps each word of the licence templates to its postings (template,
position). How rare a word is comes from the corpus: one pass counts in how
many documents each licence word is found. In a file, the rarest word of a
template's mandatory phrase is looked up; its places give the template's
possible alignments, those of the next-rarest words are intersected by relative
position, and the phrase is verified word by word. The rest of the template
then says how much of it is there.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.

Cases: a null text has no words; repeated rows give a row each; an empty table
gives an empty result; columns other than id and text are not read.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierflow.llm.common import map_batches, table


@dataclass(frozen=True)
class Template:
    """``phrase`` must stand at ``at`` within ``words``."""
    label: str
    words: str
    phrase: str
    base: bool = False

    @property
    def at(self) -> int:
        w, p = self.words.split(), self.phrase.split()
        return next(i for i in range(len(w)) if w[i:i + len(p)] == p)


# The base phrases, then headers of public licences.
TEMPLATES = (
    Template("gpl", "gnu general public license", "gnu general public license", True),
    Template("apache", "apache license", "apache license", True),
    Template("cc-by", "cc by", "cc by", True),
    Template("mit", "mit license", "mit license", True),
    Template("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("boost", "boost software license version 1 0", "boost software license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             "redistribution and use in source and binary forms"),
    Template("cc-by", "licensed under a creative commons attribution license", "creative commons attribution"),
    Template("cc-by-nc", "cc by nc", "cc by nc"),
    Template("cc-by-nd", "cc by nd", "cc by nd"),
    Template("cc-by-sa", "cc by sa", "cc by sa"),
    Template("gpl", "this program is free software you can redistribute it and or modify it",
             "free software you can redistribute it"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose",
             "permission to use copy modify and or distribute this software"),
    Template("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
             "permission is hereby granted free of charge"),
    Template("mpl", "subject to the terms of the mozilla public license", "mozilla public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             "free and unencumbered software"),
)

_WORD_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD_BYTES else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class Index:
    """Templates with the words of each phrase ordered from the rarest on."""

    def __init__(self, templates: tuple[Template, ...], idf: dict[bytes, float]):
        self.templates = templates
        self.plans = []
        for n, t in enumerate(templates):
            phrase = [w.encode() for w in t.phrase.split()]
            # postings of the phrase's words, rarest first; equal ones by word
            order = sorted({w: i for i, w in reversed(list(enumerate(phrase)))}.items(),
                           key=lambda x: (-idf.get(x[0], 0.0), x[0]))
            self.plans.append((n, t, phrase, [w.encode() for w in t.words.split()], t.at, order))
        self.anchors = sorted({plan[5][0][0] for plan in self.plans})
        self.wanted = frozenset(w for plan in self.plans for w, _ in plan[5])

    def places(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, start of its phrase, share of the template's words that stand
        where they should), for every place of every phrase."""
        at: dict[bytes, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.wanted:
                at.setdefault(w, []).append(i)
        out = []
        for n, _, phrase, full, offset, order in self.plans:
            starts: set | None = None
            for w, rel in order:  # intersect by relative position
                here = {i - rel for i in at.get(w, ())}
                starts = here if starts is None else starts & here
                if not starts:
                    break
            for s in sorted(starts or ()):
                if s >= 0 and words[s:s + len(phrase)] == phrase:
                    head = s - offset
                    same = sum(1 for j, w in enumerate(full) if 0 <= head + j < len(words) and words[head + j] == w)
                    out.append((n, s, same / len(full)))
        return out


def rarity(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text: str = "text") -> dict[bytes, float]:
    """idf of the words of the phrases, over all documents. As many numbers as
    the templates have words."""
    vocabulary = frozenset(w.encode() for t in templates for w in t.phrase.split())

    def run(batch: pa.RecordBatch):
        counts: dict[bytes, int] = dict.fromkeys(vocabulary, 0)
        for lo in range(0, batch.num_rows, 256):
            for t in batch.column(0).slice(lo, 256).to_pylist():
                for w in vocabulary.intersection(words_of(t)):
                    counts[w] += 1
        yield {"word": [w.decode() for w in counts], "df": list(counts.values()), "n": [batch.num_rows] * len(counts)}

    rows = map_batches(docs.select(text), run, "word string, df long, n long").groupBy("word").agg(
        F.sum("df").alias("df"), F.sum("n").alias("n")).collect()
    return {r.word.encode(): math.log((1 + r.n) / (1 + r.df)) for r in rows}


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words and places: (label, base, start, share) of every phrase found."""
    index = Index(templates, rarity(docs, templates, text))
    schema = f"_id {docs.schema[doc_id].dataType.simpleString()}, n_words long, " \
             "places array<struct<label:string,base:boolean,start:long,share:double>>"

    def run(batch: pa.RecordBatch):
        for lo in range(0, batch.num_rows, 256):
            n_words, places = [], []
            for t in batch.column(1).slice(lo, 256).to_pylist():
                raw = (t or "").encode().translate(_FOLD)
                words = raw.split()
                n_words.append(len(words))
                found = index.places(words) if any(a in raw for a in index.anchors) else []
                places.append([{"label": index.templates[n].label, "base": index.templates[n].base, "start": s, "share": x}
                               for n, s, x in found])
            yield {"_id": batch.column(0).slice(lo, 256), "n_words": n_words, "places": places}

    return map_batches(docs.select(doc_id, text), run, schema).withColumnRenamed("_id", doc_id)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])
    labels = lambda p: F.array_join(F.array_sort(F.array_distinct(F.transform(p, lambda x: x["label"]))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"))
