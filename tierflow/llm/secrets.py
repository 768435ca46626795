"""Secret scans over an incremental ledger of blobs.

Every version of every text is addressed by its SHA-256. The ledger, a Parquet
table in shared storage, has which rules at which version have scanned which
blob and what they found. A scan reads only blobs with a rule version that the
ledger lacks, appends what it finds, and joins findings back to all versions.
DataFrame functions only: matches and the texts between them come from the
JVM's regular expressions, positions from running sums of their lengths.

Cases: a null text is the empty blob; equal texts are one blob, scanned once
and reported for each row; a text's findings are grouped by blob, so one task
never holds more than those of one text; an empty table gives an empty result.
"""
from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierflow.llm.common import materialize, table
from tierflow.session import checkpoint_path


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and non-overlapping; those whose group
    ``group`` is shorter than ``least`` are dropped after matching."""
    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    #: The same for engines without look-behind: group 1 is the match.
    plain: str | None = None

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The first three are the base kinds, in the order of their listing.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    # a run of 16 or more is what is left of the maximal runs after the shorter ones are dropped
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    # a token begins where its run does, and no run is read twice: linear on any text
    Rule("jwt", 2, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+",
         plain=r"(?:^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE_KINDS = ("assign", "access", "hex")

LEDGER_SCHEMA = "blob string, rules array<string>, found array<struct<start:int,kind:int,end:int,rule:string>>"


def blob_of(text: str = "text") -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def _matches(rule: Rule, order: int, todo: Column) -> Column:
    """An array of (gap before, length, fits) for the rule's matches in ``text``."""
    pat = F.lit(rule.pattern)
    gaps = F.transform(F.split("text", rule.pattern, -1), F.length)
    found = F.transform(F.regexp_extract_all("text", pat, F.lit(0)), F.length)
    group = F.transform(F.regexp_extract_all("text", pat, F.lit(rule.group)), F.length) if rule.group else found
    rows = F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("len"), group.alias("grp")),
                       lambda x: F.struct(x["gap"].alias("gap"), x["len"].alias("len"), (x["grp"] >= rule.least).alias("fits")))
    return F.when(F.array_contains(todo, rule.name) & F.col("text").rlike(rule.pattern),
                  F.struct(F.lit(order).alias("kind"), F.lit(rule.name).alias("rule"), rows.alias("rows")))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, text, todo (names of rules) to rows of the ledger."""
    hits = blobs.select("blob", "todo", F.array_compact(F.array(
        *[_matches(r, k, F.col("todo")) for k, r in enumerate(rules)])).alias("hits"))
    one = (hits.select("blob", "todo", F.explode_outer("hits").alias("h"))
           .select("blob", "todo", "h.kind", "h.rule", F.posexplode_outer("h.rows").alias("at", "m")))
    upto = Window.partitionBy("blob", "kind").orderBy("at")
    end = F.sum(F.col("m.gap") + F.col("m.len")).over(upto)
    placed = one.select("blob", "todo", "kind", "rule", "m.len", "m.fits", end.cast("int").alias("end"))
    span = F.struct((F.col("end") - F.col("len")).alias("start"), "kind", "end", "rule")
    return placed.groupBy("blob").agg(
        F.first("todo").alias("rules"),
        F.array_sort(F.collect_list(F.when(F.col("fits"), span))).alias("found"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger; an empty one where none has been written yet."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(fs_path):
        return spark.createDataFrame([], LEDGER_SCHEMA)
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Bring the ledger up to date with all texts of ``versions`` and return it.

    Appends one row for each blob that lacked a rule version, with the rules
    that ran; a run that fails before its commit adds nothing and can be rerun.
    """
    spark = versions.sparkSession
    names = F.array(*[F.lit(r.name) for r in rules])
    blobs = versions.select(blob_of(text).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    seen = read_ledger(spark, ledger).select("blob", F.explode("rules").alias("r")).groupBy("blob").agg(
        F.collect_set("r").alias("seen"))
    pending = (blobs.dropDuplicates(["blob"]).join(seen, "blob", "left")
               .select("blob", "text", F.array_except(names, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo"))
               .filter(F.size("todo") > 0))
    scan_blobs(pending, rules).write.mode("append").parquet(ledger)
    return read_ledger(spark, ledger)


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """versions without text, with blob and found (columns so called give way): the spans of ``rules`` (the
    given versions only), by start and then by the order of the rules."""
    names = F.array(*[F.lit(r.name) for r in rules])
    mine = ledger.select("blob", F.explode("found").alias("f")).filter(F.array_contains(names, F.col("f.rule")))
    order = F.array_position(names, F.col("f.rule")).cast("int") - 1
    per_blob = mine.groupBy("blob").agg(F.array_sort(F.collect_set(F.struct(
        F.col("f.start").alias("start"), order.alias("kind"), F.col("f.end").alias("end")))).alias("found"))
    keep = [c for c in versions.columns if c not in (text, "blob", "found")]
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return (versions.select(*keep, blob_of(text).alias("blob")).join(per_blob, "blob", "left")
            .select(*keep, "blob", F.coalesce("found", none).alias("found")))


def redacted(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text: str = "text",
             length: str | None = None) -> DataFrame:
    """docs with every found span of ``text`` replaced, and the column ``length``
    (if given) set to the new number of characters where something was found."""
    names = F.array(*[F.lit(r.name) for r in rules])
    seen = scan(docs.select(F.col(text).alias("text")), ledger, rules)
    # a text that no pattern matches has no span: such rows stay where they are
    may = F.lit(False)
    for r in rules:
        may = may | F.col(text).rlike(r.pattern)
    may = F.coalesce(may, F.lit(False))
    clean, docs = docs.filter(~may), docs.filter(may)
    hits = seen.select("blob", F.explode("found").alias("f")).filter(F.array_contains(names, F.col("f.rule")))
    per_blob = materialize(hits.groupBy(F.col("blob").alias("b")).agg(F.array_sort(F.collect_set(F.struct(
        F.col("f.start").alias("start"), F.col("f.end").alias("end")))).alias("found")), "secret-findings")
    rows = docs.select(F.struct("*").alias("row"), blob_of(text).alias("blob")).join(
        per_blob, F.col("blob") == F.col("b"), "left").select("row", "found")
    new = F.when(F.col("found").isNull(), F.col(f"row.{text}")).otherwise(redact(F.col(f"row.{text}"), F.col("found")))
    out = rows.select("row", "found", new.alias("new"))
    value = lambda c: F.col("new") if c == text else F.when(
        F.col("found").isNull(), F.col(f"row.{c}")).otherwise(F.length("new")) if c == length else F.col(f"row.{c}")
    return clean.unionAll(out.select(*[value(c).cast(docs.schema[c].dataType).alias(c) for c in docs.columns]))


def redact(text: Column, found: Column, mark: str = "[secret]") -> Column:
    """text with each found span replaced; overlapping spans become one mark."""
    acc = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, x: F.when(x["start"] >= a["at"], F.struct(
        F.concat(a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.lit(mark)).alias("out"),
        x["end"].alias("at"))).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["at"], x["end"]).alias("at")))
    rest = lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text)))
    return F.when(F.size(found) == 0, text).otherwise(F.aggregate(found, acc, step, rest))


def _joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def new_ledger(spark: SparkSession) -> str:
    return checkpoint_path(spark, f"secret-ledger-{uuid.uuid4().hex}")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = findings(docs, scan(docs, new_ledger(spark)))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("found", lambda x: x["kind"] < len(BASE_KINDS))
    return out.select(
        "doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(BASE_KINDS)],
        F.sha2(_joined(base, RULES), 256).alias("base_sha256"), _joined(F.col("found"), RULES).alias("spans"))
