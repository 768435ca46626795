"""Prompt text features and the prompt / mode gate, as native expressions.

No Python UDF: every feature is a JVM-side string or regex function, so a
feature pass is one codegen'd projection over the documents scan.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tierflow.constants import (CODE_MARKERS, DEFAULT_MODE, MAX_PROMPT_CHARS, MODES,
                                PY_SPACE_CLASS, REASONING_KEYWORDS, TECHNICAL_KEYWORDS,
                                WORD_CLASS)

WORD_RUN = f"[{WORD_CLASS}]+"
SENTENCE_SPLIT = "[.!?]+"
NON_SPACE = f"[^{PY_SPACE_CLASS}]"

FEATURE_NAMES = ["word_count", "character_count", "sentence_count", "question_count",
                 "newline_count", "reasoning_keyword_count", "technical_keyword_count",
                 "has_code"]


def _count_char(c: Column, ch: str) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))).cast("int")


def _keyword_hits(lowered: Column, words: list[str]) -> Column:
    hits = [F.contains(lowered, F.lit(w)).cast("int") for w in words]
    total = hits[0]
    for h in hits[1:]:
        total = total + h
    return total.cast("int")


def feature_columns(text: Column) -> dict[str, Column]:
    lowered = F.lower(text)
    pieces = F.split(text, SENTENCE_SPLIT, -1)
    code = F.lit(False)
    for m in CODE_MARKERS:
        code = code | F.contains(text, F.lit(m))
    return {
        "word_count": F.regexp_count(lowered, F.lit(WORD_RUN)).cast("int"),
        "character_count": F.length(text).cast("int"),
        "sentence_count": F.size(F.filter(pieces, lambda s: s.rlike(NON_SPACE))).cast("int"),
        "question_count": _count_char(text, "?"),
        "newline_count": _count_char(text, "\n"),
        "reasoning_keyword_count": _keyword_hits(lowered, REASONING_KEYWORDS),
        "technical_keyword_count": _keyword_hits(lowered, TECHNICAL_KEYWORDS),
        "has_code": code.cast("int"),
    }


def gate_columns(prompt: Column, mode: Column) -> dict[str, Column]:
    """Accept / reject a (prompt, mode) pair the way the serving path does.

    Order: request bounds on the raw text (1..20,000 code points), then the
    service's blank check after a Unicode strip, then the mode check.
    """
    # blank after a Unicode strip <=> only whitespace: an anchored match that
    # stops at the first non-space character (no copy of a long text)
    blank = prompt.rlike(f"^[{PY_SPACE_CLASS}]*$")
    clean_mode = F.coalesce(F.lower(F.regexp_replace(
        mode, f"^[{PY_SPACE_CLASS}]+|[{PY_SPACE_CLASS}]+$", "")), F.lit(DEFAULT_MODE))
    reason = (F.when(prompt.isNull(), "missing_prompt")
              .when(F.length(prompt) < 1, "empty_prompt")
              .when(F.length(prompt) > MAX_PROMPT_CHARS, "prompt_too_long")
              .when(blank, "blank_prompt")
              .when(~clean_mode.isin(*MODES), "unsupported_mode"))
    return {
        "clean_mode": clean_mode,
        "accepted": reason.isNull(),
        "reject_reason": reason,
    }


def gate(df, prompt_col: str = "prompt", mode_col: str = "mode"):
    """Split (prompt, mode) rows into (accepted, rejected-with-reason) DataFrames."""
    cols = gate_columns(F.col(prompt_col), F.col(mode_col))
    tagged = df.select("*", *[c.alias(n) for n, c in cols.items()])
    accepted = tagged.where(F.col("accepted")).drop("accepted", "reject_reason")
    rejected = tagged.where(~F.col("accepted")).drop("accepted", "clean_mode")
    return accepted, rejected
