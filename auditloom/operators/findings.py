"""Findings as a relation: build, union, default, dedup, translate, rank, cut, gate, search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditloom.dimensions import (
    DEFAULT_CONFIDENCE, DEFAULT_SOURCE, CONFIDENCES, SEVERITIES, SEVERITY_NAMES,
)
from auditloom.functions.translations import CATEGORIES, TEXTS
from auditloom.operators.rules_catalog import RULES
from auditloom.schemas import DEDUP_KEY, FINDING_COLUMNS, carried

Text = str | Column | None


def text_of(value: Text) -> Column:
    """A text given as a column, or as a literal."""
    return (value if isinstance(value, Column) else F.lit(value)).cast("string")


def emit(
    rows: DataFrame,
    rule_id: str,
    detail: Text = None,
    line: str | None = None,
    file: str | None = "path",
    title: Text = None,
    severity: Text = None,
    confidence: Text = DEFAULT_CONFIDENCE,
    recommendation: Text = None,
    source: str = DEFAULT_SOURCE,
    rule: str | None = None,
) -> DataFrame:
    """Turn matching rows into findings of one rule.

    ``file``, ``line`` and ``rule`` (an id other than the catalogue's) name columns; texts not given come from the rule's catalogue entry.
    """
    texts = RULES[rule_id]
    return rows.select(
        F.col("repo"),
        text_of(texts.severity if severity is None else severity).alias("severity"),
        F.lit(texts.category).alias("category"),
        text_of(texts.title if title is None else title).alias("title"),
        text_of(texts.detail if detail is None else detail).alias("detail"),
        (F.lit(None) if file is None else F.col(file)).cast("string").alias("file"),
        (F.lit(None) if line is None else F.col(line)).cast("int").alias("line"),
        text_of(texts.recommendation if recommendation is None else recommendation).alias("recommendation"),
        F.lit(source).alias("source"),
        (F.lit(rule_id) if rule is None else F.col(rule)).alias("rule_id"),
        text_of(confidence).alias("confidence"),
        *carried(rows),
    )


def hit(
    rule_id: str, detail: Text = None, title: Text = None, line: Column | None = None,
    confidence: Text = DEFAULT_CONFIDENCE, recommendation: Text = None,
) -> Column:
    """A finding as a struct, for rules that are evaluated side by side on one row."""
    texts = RULES[rule_id]
    return F.struct(
        F.lit(texts.severity).alias("severity"),
        F.lit(texts.category).alias("category"),
        text_of(texts.title if title is None else title).alias("title"),
        text_of(texts.detail if detail is None else detail).alias("detail"),
        (F.lit(None) if line is None else line).cast("int").alias("line"),
        text_of(texts.recommendation if recommendation is None else recommendation).alias("recommendation"),
        F.lit(rule_id).alias("rule_id"),
        text_of(confidence).alias("confidence"),
    )


def emit_hits(rows: DataFrame, hits: Column, file: str = "path") -> DataFrame:
    """Turn an array of hits per row, some of them null, into findings."""
    kept = carried(rows)
    found = rows.select("repo", F.col(file).alias("file"), *kept, F.explode(hits).alias("hit")).filter("hit IS NOT NULL")
    return found.select(
        "repo", "hit.severity", "hit.category", "hit.title", "hit.detail", "file", "hit.line",
        "hit.recommendation", F.lit(DEFAULT_SOURCE).alias("source"), "hit.rule_id", "hit.confidence", *kept,
    )


def emit_by_rule(
    rows: DataFrame, rule: str, details: dict[str, Column | None], line: str | None, file: str | None = "path",
    titles: dict[str, Column] | None = None,
) -> DataFrame:
    """Turn rows into findings of the rule each row names, in one pass over the rows."""
    titles = titles or {}

    def pick(values: dict[str, Text]) -> Column:
        out = F
        for name, value in values.items():
            out = out.when(F.col(rule) == name, text_of(value))
        return out.otherwise(F.lit(None))

    chosen = {name: RULES[name] for name in details}
    return rows.select(
        F.col("repo"),
        pick({n: r.severity for n, r in chosen.items()}).alias("severity"),
        pick({n: r.category for n, r in chosen.items()}).alias("category"),
        pick({n: titles.get(n, r.title) for n, r in chosen.items()}).alias("title"),
        pick({n: r.detail if details[n] is None else details[n] for n, r in chosen.items()}).alias("detail"),
        (F.lit(None) if file is None else F.col(file)).cast("string").alias("file"),
        (F.lit(None) if line is None else F.col(line)).cast("int").alias("line"),
        pick({n: r.recommendation for n, r in chosen.items()}).alias("recommendation"),
        F.lit(DEFAULT_SOURCE).alias("source"),
        F.col(rule).alias("rule_id"),
        F.lit(DEFAULT_CONFIDENCE).alias("confidence"),
        *carried(rows),
    )


def union_findings(*parts: DataFrame) -> DataFrame:
    """Bag union by column name."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def with_defaults(findings: DataFrame) -> DataFrame:
    """Give absent or null columns their default value."""
    defaults = {
        "source": DEFAULT_SOURCE, "confidence": DEFAULT_CONFIDENCE, "recommendation": "",
    }
    columns = []
    for name in FINDING_COLUMNS:
        kind = "int" if name == "line" else "string"
        value = F.col(name) if name in findings.columns else F.lit(None)
        value = value.cast(kind)
        if name in defaults:
            value = F.coalesce(value, F.lit(defaults[name]))
        columns.append(value.alias(name))
    return findings.select(*columns)


def sort_weight(severity: Column) -> Column:
    """Weight of a severity for ranking and gating; an unknown one weighs nothing."""
    out = F
    for name, weight, _ in SEVERITIES:
        out = out.when(severity == name, F.lit(weight))
    return out.otherwise(F.lit(0))


def certainty(confidence: Column) -> Column:
    out = F
    for name, value in CONFIDENCES:
        out = out.when(confidence == name, F.lit(value))
    return out.otherwise(F.lit(dict(CONFIDENCES)[DEFAULT_CONFIDENCE]))


def dedup(findings: DataFrame) -> DataFrame:
    """One finding per key; of several, the most certain, then the smallest texts.

    An aggregate rather than a window: copies are already merged before the shuffle,
    so a finding repeated a billion times costs no more than its partial results.
    """
    best = F.min(F.struct(
        (-certainty(F.col("confidence"))).alias("doubt"), "source", "recommendation", "confidence"
    )).alias("best")
    kept = findings.groupBy(*DEDUP_KEY).agg(best)
    return kept.select(*[
        F.col("best")[c].alias(c) if c in ("source", "recommendation", "confidence") else F.col(c)
        for c in FINDING_COLUMNS
    ])


def translate(findings: DataFrame, columns: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Replace known texts through dictionaries; unknown texts stay.

    The dictionaries are fixed and small, so each is a literal map and no join.
    """
    chosen = columns or {
        "category": CATEGORIES, "title": TEXTS, "detail": TEXTS, "recommendation": TEXTS,
    }
    labels = {
        name: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in words.items() for x in pair]), F.col(name)), F.col(name))
        for name, words in chosen.items() if words
    }
    return findings.withColumns(labels)


def report_order() -> list[Column]:
    """Worst first, then category, file and line; the rest only breaks ties."""
    return [
        F.desc(sort_weight(F.col("severity"))),
        F.asc("category"),
        F.asc(F.coalesce("file", F.lit(""))),
        F.asc(F.coalesce("line", F.lit(0))),
        F.asc("rule_id"), F.asc("title"), F.asc("detail"),
        F.asc("recommendation"), F.asc("source"), F.asc("confidence"),
    ]


def order_key() -> Column:
    """The report order as one comparable struct, for use inside aggregates."""
    return F.struct(
        (-sort_weight(F.col("severity"))).alias("w"), F.col("category"),
        F.coalesce("file", F.lit("")).alias("f"), F.coalesce("line", F.lit(0)).alias("l"),
        F.col("rule_id"), F.col("title"), F.col("detail"),
        F.col("recommendation"), F.col("source"), F.col("confidence"),
    )


def rank(findings: DataFrame) -> DataFrame:
    """Globally sorted findings (a range-partitioned sort)."""
    return findings.orderBy("repo", *report_order())


def top_per_group(
    df: DataFrame, keys: list[str], order: list[Column], k: int, rank_name: str = "rank", salts: int = 64
) -> DataFrame:
    """First k rows of each group in the given order, with their rank.

    Two rounds of row numbers: first within slices of the group, then over the at most
    ``salts * k`` survivors, so a group holding a third of the table is ranked by many
    tasks. Both filters are rank limits that Spark applies before each shuffle.
    """
    slice_of = F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int")
    first = Window.partitionBy(*keys, "_slice").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_slice", slice_of)
        .withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= k)
        .drop("_slice", "_rank")
        .withColumn(rank_name, F.row_number().over(final)).filter(F.col(rank_name) <= k)
    )


def head(findings: DataFrame, k: int) -> DataFrame:
    """The first k findings of each repository in report order."""
    return top_per_group(findings, ["repo"], report_order(), k)


def priorities(findings: DataFrame, k: int = 10) -> DataFrame:
    """Per repository the first k critical or high findings that are not uncertain."""
    urgent = findings.filter(F.col("severity").isin("CRITICAL", "HIGH") & (F.col("confidence") != "LOW"))
    return top_per_group(urgent, ["repo"], report_order(), k)


def gate_status(findings: DataFrame, threshold: str = "HIGH") -> DataFrame:
    """(repo, failed): some finding is at least as severe as the threshold."""
    limit = {name: weight for name, weight, _ in SEVERITIES}[threshold]
    return findings.groupBy("repo").agg(
        F.bool_or(sort_weight(F.col("severity")) >= limit).alias("failed")
    )


def count_pivot(rows: DataFrame, keys: list[str], column: str, values: dict[str, str]) -> DataFrame:
    """One row per key with a count for each of a fixed set of values, as value -> column name."""
    return rows.groupBy(*keys).agg(*[
        F.count_if(F.col(column) == value).alias(name) for value, name in values.items()
    ])


def severity_pivot(findings: DataFrame) -> DataFrame:
    """One row per repository with a count for each of the five severities."""
    return count_pivot(findings, ["repo"], "severity", {s: s for s in SEVERITY_NAMES})


def health_band(findings: DataFrame, scores: DataFrame) -> DataFrame:
    """(repo, score, actionable, total, band) for every scored repository."""
    severity = F.col("severity")
    counts = findings.groupBy("repo").agg(
        F.count_if(severity.isin("CRITICAL", "HIGH", "MEDIUM")).alias("actionable"),
        F.count("*").alias("total"),
        F.bool_or(severity == "CRITICAL").alias("any_critical"),
        F.bool_or(severity == "HIGH").alias("any_high"),
    )
    critical = F.coalesce("any_critical", F.lit(False)) | (F.col("score") < 50)
    warn = F.coalesce("any_high", F.lit(False)) | (F.col("score") < 80)
    return scores.join(counts, "repo", "left").select(
        "repo", "score",
        F.coalesce("actionable", F.lit(0)).alias("actionable"),
        F.coalesce("total", F.lit(0)).alias("total"),
        F.when(critical, "critical").when(warn, "warn").otherwise("ok").alias("band"),
    )


def search(
    findings: DataFrame, text: str | None = None, severity: str | None = None, confidence: str | None = None
) -> DataFrame:
    """Findings whose visible text contains a phrase, of a severity and a confidence."""
    out = findings
    if text:
        place = F.concat(
            F.coalesce("file", F.lit("")),
            F.when(F.col("line").isNotNull(), F.concat(F.lit(":"), F.col("line").cast("string"))).otherwise(""),
        )
        shown = F.concat_ws("\n", "severity", "category", "title", place, "detail", "recommendation", "source")
        out = out.filter(F.contains(F.lower(shown), F.lit(text.lower())))
    if severity:
        out = out.filter(F.col("severity") == severity)
    if confidence:
        out = out.filter(F.col("confidence") == confidence)
    return out
