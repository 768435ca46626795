"""Judge-output parsing.

A verdict text carries ``VERDICT: PASS|FAIL``, ``SCORE: <number>`` and an
optional ``REASON: ...`` running to the end of the text, all case-blind.
The first match of each wins.  Instead of raising, a malformed text yields
a ``parse_error`` code and null parsed fields, so one bad row never kills a
bulk job.

Parsing is two projections: the regexes are evaluated once into raw
columns, then the derived fields read those columns (an expensive
expression referenced from several CASE branches would otherwise be
re-evaluated per branch).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierflow.constants import DEFAULT_JUDGE_REASON, JUDGE_PASS_SCORE, PY_SPACE_CLASS

WS = f"[{PY_SPACE_CLASS}]"
NUMBER = r"([0-9]*\.?[0-9]+)"
REASON_PATTERN = f"(?is)REASON:{WS}*(.+)"


def verdict_pattern(prefix: str = "") -> str:
    return f"(?i){prefix}VERDICT:{WS}*(PASS|FAIL)"


def score_pattern(prefix: str = "") -> str:
    return f"(?i){prefix}SCORE:{WS}*{NUMBER}"


def py_strip(c: Column) -> Column:
    """Python str.strip(): trims Unicode whitespace, not only spaces."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def raw_judge_columns(text: Column, prefix: str = "", with_reason: bool = True) -> dict[str, Column]:
    """Step 1: one evaluation of each regex ('' = no match)."""
    out = {
        "v": F.regexp_extract(text, verdict_pattern(prefix), 1),
        "s": F.regexp_extract(text, score_pattern(prefix), 1),
        "null_text": text.isNull(),
    }
    if with_reason:
        out["r"] = F.regexp_extract(text, REASON_PATTERN, 1)
    return out


def derived_judge_columns(v: Column, s: Column, null_text: Column,
                          r: Column | None = None) -> dict[str, Column]:
    """Step 2: verdict, score, reason, passed, parse_error from the raw columns."""
    score_raw = F.when(s != "", s).cast("double")
    error = (F.when(null_text, "missing_text")
             .when(v == "", "missing_verdict")
             .when(s == "", "missing_score")
             .when((score_raw < 0.0) | (score_raw > 1.0), "score_out_of_range"))
    ok = error.isNull()
    verdict = F.when(ok, F.upper(v))
    score = F.when(ok, score_raw)
    out = {"verdict": verdict, "score": score}
    if r is not None:
        out["reason"] = F.when(ok, F.when(r == "", F.lit(DEFAULT_JUDGE_REASON)).otherwise(py_strip(r)))
    out["passed"] = F.when(ok, (verdict == "PASS") & (score >= F.lit(JUDGE_PASS_SCORE)))
    out["parse_error"] = error
    return out


def with_judge(df: DataFrame, text_col: str, prefix: str = "", out: str = "",
               with_reason: bool = True) -> DataFrame:
    """Append parsed judge fields (named ``out + field``) to ``df``."""
    raw = raw_judge_columns(F.col(text_col), prefix, with_reason)
    tmp = {k: f"__j_{out}{k}" for k in raw}
    staged = df.select("*", *[c.alias(tmp[k]) for k, c in raw.items()])
    der = derived_judge_columns(F.col(tmp["v"]), F.col(tmp["s"]), F.col(tmp["null_text"]),
                                F.col(tmp["r"]) if with_reason else None)
    return staged.select("*", *[c.alias(out + k) for k, c in der.items()]).drop(*tmp.values())
