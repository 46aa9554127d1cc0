"""Operator 6 [native]: secret scans with an incremental blob ledger.

Input is a history: every version of every path with its text. A version's
blob is the SHA-256 of its text. ``scan`` looks only at pairs of (blob, rule
with its version) that the ledger doesn't hold yet, each blob once however many
paths and versions show it, and returns the ledger's new rows: one for each
pair, with its spans (an empty list is a result, too). ``at_paths`` joins the
ledger's findings back to every version of every path.

Everything is DataFrame expressions. Spans: a text is split at the matches of
a rule, and the running lengths of the pieces and matches are the positions
(code points, end exclusive). Rules look at whole texts, leftmost first,
without overlap, and matches that fail a rule's length test are dropped.

Scale: paths move as (hash, key) rows only. The text of one carrier for each
unseen blob moves once, in a join on the carrier's key, so a blob with very
many copies costs one scan; in an increment with few new blobs that join is a
broadcast. Versions of one path are rows like any other.

Defined results: a null text is the empty blob; rows that are repeated are
found at each of their rows; null keys are kept; an empty history adds nothing;
an empty ledger means that all is unseen; other columns are kept out.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import broadcast_if_small
from .shared import written

LEDGER_SCHEMA = "blob binary, rule string, version int, spans array<struct<start:int,end:int>>"


class Rule(NamedTuple):
    """A pattern; matches whose group ``tested`` is shorter than ``least`` characters are dropped."""

    name: str
    version: int
    pattern: str
    tested: int
    least: int


# The rules that the task states, in its order.
RULES = (
    Rule("assign", 1, r"""(?:(?i)(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"(AKIA[A-Z0-9]+)", 1, 20),
    Rule("hex", 1, r"([0-9a-f]+)", 1, 24),
)


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def spans_of(text: Column, rule: Rule) -> Column:
    """Array of (start, end) of a rule's matches that pass its test."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.tested))
    gaps = F.split(text, rule.pattern, -1)
    lengths = F.zip_with(F.transform(F.slice(gaps, 1, F.greatest(F.size(whole), F.lit(0))), F.length), F.zip_with(whole, tested, lambda w, t: F.struct(F.length(w).alias("w"), F.length(t).alias("t"))), lambda g, x: F.struct(g.alias("g"), x["w"].alias("w"), x["t"].alias("t")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    step = lambda acc, x: F.struct(
        (acc["at"] + x["g"] + x["w"]).alias("at"),
        F.when(x["t"] >= rule.least, F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["g"]).alias("start"), (acc["at"] + x["g"] + x["w"]).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
    )
    found = F.aggregate(lengths, start, step, lambda acc: acc["spans"])
    return F.when(text.rlike(rule.pattern), found).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def versions(history: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``blob`` of every row of the history."""
    return history.select(F.col(f"`{key}`").alias("key"), blob_of(F.col(f"`{text}`")).alias("blob"))


def scan(history: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """New rows of the ledger: spans of every (blob, rule, version) of the history that it doesn't hold."""
    texts = history.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    wanted = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    blobs = versions(history, key, text).groupBy("blob").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key")).alias("carrier"))
    held = ledger.select("blob", F.struct("rule", "version").alias("pair")).groupBy("blob").agg(F.collect_set("pair").alias("held"))
    unseen = (
        blobs.join(held, "blob", "left")
        .select("blob", F.col("carrier.key").alias("carrier"), F.when(F.col("held").isNull(), wanted).otherwise(F.array_except(wanted, "held")).alias("todo"))
        .filter(F.size("todo") > 0)
    )
    # The carrier may have other texts in other versions: the blob decides.
    carried = texts.withColumn("text_blob", blob_of(F.col("text")))
    join = carried["key"].eqNullSafe(unseen["carrier"]) & (carried["text_blob"] == unseen["blob"])
    once = carried.join(unseen, join).select("blob", "todo", "text")
    todo = lambda r: F.exists("todo", lambda x: (x["rule"] == r.name) & (x["version"] == r.version))
    results = F.array(*[F.when(todo(r), F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), spans_of(F.col("text"), r).alias("spans"))) for r in rules])
    found = once.select("blob", F.filter(results, lambda x: x.isNotNull()).alias("results"))
    # a carrier's row may be repeated
    found = found.groupBy("blob").agg(F.first("results").alias("results"))
    return found.select("blob", F.explode("results").alias("r")).select("blob", "r.rule", "r.version", "r.spans")


def findings_of(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob``, ``found`` (map from rule to spans) of the ledger's blobs with spans under the current rule versions."""
    current = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    return (
        ledger.filter(F.array_contains(current, F.struct("rule", "version")) & (F.size("spans") > 0))
        .groupBy("blob").agg(F.map_from_entries(F.collect_list(F.struct("rule", "spans"))).alias("found"))
    )


def at_paths(history: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``found`` (map from rule to spans, rules without spans left out) of every row of the history."""
    hits = findings_of(ledger, rules)
    none = F.create_map().cast("map<string,array<struct<start:int,end:int>>>")
    return versions(history, key, text).join(hits, "blob", "left").select(F.col("key").alias(key), F.coalesce("found", none).alias("found"))


def span_texts(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``kind:start:end`` of all spans by start, then by the rules' order, joined by commas."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def of(k: int, name: str) -> Column:
        return F.transform(F.coalesce(found[name], none), lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), F.concat_ws(":", F.lit(name), s["start"], s["end"]).alias("t")))

    return F.array_join(F.transform(F.array_sort(F.concat(*[of(k, r.name) for k, r in enumerate(rules)])), lambda x: x["t"]), ",")


def redacted_text(text: Column, found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The text with each found span replaced by its rule's name in angle brackets.

    Spans that overlap are replaced as one, under the rule that starts first
    (of those at one place, the first rule).
    """
    none = F.array().cast("array<struct<start:int,end:int>>")

    def of(k: int, name: str) -> Column:
        return F.transform(F.coalesce(found[name], none), lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), s["end"].alias("end"), F.lit(name).alias("name")))

    spans = F.array_sort(F.concat(*[of(k, r.name) for k, r in enumerate(rules)]))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), s["name"], F.lit(">"))).alias("out"),
    )
    done = F.aggregate(spans, start, step)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))


def redacted(history: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text", n_chars_col: str | None = None) -> DataFrame:
    """history with secrets replaced in its texts, all its columns kept; n_chars_col follows the new length where a text changed.

    Unseen blobs are scanned once; the findings, few, join back by blob.
    """
    spark = history.sparkSession
    mark = "blob"
    while mark in history.columns or f"{mark}_found" in history.columns:
        mark += "_"
    ledger = written(scan(history, spark.createDataFrame([], LEDGER_SCHEMA), rules, key, text), "ledger")
    hits = written(findings_of(ledger, rules).select(F.col("blob").alias(mark), F.col("found").alias(f"{mark}_found")), "findings")
    joined = history.withColumn(mark, blob_of(F.col(f"`{text}`"))).join(broadcast_if_small(hits), mark, "left")
    found = F.col(f"{mark}_found")
    new = F.when(found.isNotNull(), redacted_text(F.col(f"`{text}`"), found, rules)).otherwise(F.col(f"`{text}`"))
    out = joined.withColumn(text, new)
    if n_chars_col in history.columns:
        out = out.withColumn(n_chars_col, F.when(found.isNotNull(), F.length(f"`{text}`").cast(history.schema[n_chars_col].dataType)).otherwise(F.col(f"`{n_chars_col}`")))
    return out.select([F.col(f"`{c}`") for c in history.columns])
