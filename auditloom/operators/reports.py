"""Reports written per repository: SARIF and JSON documents, and Parquet findings.

A document holds ``CHUNK`` findings of its repository, the last one fewer. Documents are numbered
from 0 in report order: read one after another, they are the ranked findings. So no task ever
assembles an unbounded list, and no finding is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom import __version__
from auditloom.dimensions import DEFAULT_SOURCE
from auditloom.operators.findings import report_order
from auditloom.operators.windows import group_ranks
from auditloom.schemas import FINDING_COLUMNS

CHUNK = 5_000

# The SARIF format.
SARIF_VERSION = "2.1.0"
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
SLUG_LENGTH = 80


def chunked(findings: DataFrame, size: int = CHUNK) -> DataFrame:
    """Add ``_rank``, the place of a finding of its repository in report order, and ``chunk``, ``size`` of them each."""
    # What the report order takes for equal: two severities of one weight, no file and "", no line and 0.
    ties = [F.asc(c) for c in findings.columns if c in ("severity", "file", "line") or c not in FINDING_COLUMNS]
    ranked = group_ranks(findings, ["repo"], report_order() + ties, "_rank")
    return ranked.withColumn("chunk", F.floor(F.col("_rank") / size).cast("int"))


def in_order(*values: Column | str) -> Column:
    """Aggregate: structs of the values in the order of the first one, which no two rows share."""
    return F.sort_array(F.collect_list(F.struct(*values)))


def sarif_rule_id() -> Column:
    slug = F.substring(F.regexp_replace(F.lower("title"), "[^A-Za-z0-9_.-]+", "-"), 1, SLUG_LENGTH)
    return F.coalesce(F.nullif("rule_id", F.lit("")), slug)


def sarif_level() -> Column:
    return (
        F.when(F.col("severity").isin("CRITICAL", "HIGH"), "error")
        .when(F.col("severity") == "MEDIUM", "warning").otherwise("note")
    )


def sarif_results(findings: DataFrame) -> DataFrame:
    """(repo, chunk, _rank, title, help, result): each chunked finding as a SARIF result struct."""
    has_file = F.coalesce(F.col("file"), F.lit("")) != ""
    region = F.when(F.coalesce("line", F.lit(0)) != 0, F.struct(F.col("line").alias("startLine")))
    location = F.struct(F.struct(
        F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region"),
    ).alias("physicalLocation"))
    result = F.struct(
        sarif_rule_id().alias("ruleId"), sarif_level().alias("level"),
        F.struct(F.col("detail").alias("text")).alias("message"),
        F.when(has_file, F.array(location)).alias("locations"),
    )
    return findings.select(
        "repo", "chunk", "_rank", "title", F.coalesce(F.nullif("recommendation", F.lit("")), F.col("detail")).alias("help"),
        result.alias("result"),
    )


def sarif_rules(found: Column) -> Column:
    """Distinct rules, by id, with the texts of their first finding in report order; ``found`` is one chunk's findings."""
    by_rule = F.sort_array(F.transform(found, lambda f: F.struct(f["result"]["ruleId"].alias("rule"), f["_rank"], f["title"], f["help"])))

    def first(rows: Column) -> Column:
        return F.filter(rows, lambda r, i: (i == 0) | ~r["rule"].eqNullSafe(F.get(rows, i - 1)["rule"]))

    # Bound as a lambda variable, so that the rows are sorted once.
    firsts = F.element_at(F.transform(F.array(by_rule), first), 1)
    return F.transform(firsts, lambda r: F.struct(
        r["rule"].alias("id"), r["title"].alias("name"),
        F.struct(r["title"].alias("text")).alias("shortDescription"),
        F.struct(r["help"].alias("text")).alias("help"),
    ))


def to_sarif(findings: DataFrame, size: int = CHUNK) -> DataFrame:
    """(repo, chunk, json): complete SARIF logs; findings without a repository have none."""
    results = sarif_results(chunked(findings.filter("repo IS NOT NULL"), size))
    logs = results.groupBy("repo", "chunk").agg(in_order("_rank", "result", "title", "help").alias("found"))
    driver = F.struct(
        F.lit(DEFAULT_SOURCE).alias("name"), F.lit(__version__).alias("version"), sarif_rules(F.col("found")).alias("rules"))
    run = F.struct(
        F.struct(driver.alias("driver")).alias("tool"), F.transform("found", lambda f: f["result"]).alias("results"))
    log = F.struct(
        F.lit(SARIF_VERSION).alias("version"), F.lit(SARIF_SCHEMA).alias("$schema"), F.array(run).alias("runs")
    )
    return logs.select("repo", "chunk", F.to_json(log).alias("json"))


def to_report(
    findings: DataFrame, scores: DataFrame, features: DataFrame | None = None, metrics: DataFrame | None = None,
    sections: dict[str, DataFrame] | None = None, mode: str = "standard", size: int = CHUNK,
    tools: DataFrame | None = None,
) -> DataFrame:
    """(repo, chunk, json): one nested report per repository, in chunks of findings.

    ``features`` and ``metrics`` are wide tables with one row per repository and become
    maps; each of ``sections`` does the same under its own name and stays null for a
    family that did not run; ``tools`` has a row for each known tool and becomes a list. A
    repository without findings has one chunk.
    """
    finding = F.struct(*[c for c in findings.columns if c != "repo"]).alias("finding")
    lists = chunked(findings, size).groupBy("repo", "chunk").agg(
        F.transform(in_order("_rank", finding), lambda f: f["finding"]).alias("findings")
    )
    out = scores
    fields = [
        F.lit(__version__).alias("version"), F.col("repo").alias("project"), F.lit(mode).alias("mode"),
    ]
    for name, table in {"detected": features, "metrics": metrics, **(sections or {})}.items():
        if table is not None:
            out = out.join(as_map(table, name), "repo", "left")
            fields.append(F.col(name))
    if tools is not None:
        columns = [c for c in tools.columns if c != "repo"]
        listed = tools.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("tools"))
        out = out.join(listed, "repo", "left")
        fields.append(F.col("tools"))
    fields += [
        F.coalesce("findings", F.array().cast(lists.schema["findings"].dataType)).alias("findings"),
        F.col("score"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssxx").alias("generated_at"),
    ]
    # One row for each chunk, so that the lists are joined by chunk: a repository has any number of them.
    # These short rows are hashed; a merge join would sort the lists.
    counts = findings.groupBy("repo").agg(F.count("*").alias("_n"))
    last = F.coalesce(F.floor((F.col("_n") - 1) / size).cast("int"), F.lit(0))
    out = out.join(counts, "repo", "left").withColumn("chunk", F.explode(F.sequence(F.lit(0), last)))
    out = out.hint("shuffle_hash").join(lists, ["repo", "chunk"], "left")
    return out.select("repo", "chunk", F.to_json(F.struct(*fields)).alias("json"))


def as_map(table: DataFrame, name: str) -> DataFrame:
    """(repo, map): a wide row per repository as a map from column name to value."""
    entries = []
    for column in table.columns:
        if column != "repo":
            entries += [F.lit(column), F.col(column)]
    return table.select("repo", F.create_map(*entries).alias(name))


def write_documents(documents: DataFrame, path: str) -> None:
    """(repo, chunk, json) as Parquet in the order of repositories: few files, quick to look one up in."""
    documents.select("repo", "chunk", "json").repartitionByRange("repo", "chunk").sortWithinPartitions(
        "repo", "chunk").write.mode("overwrite").parquet(path)


def write_findings(findings: DataFrame, path: str) -> None:
    """Findings as Parquet, split by severity, the column every consumer filters first."""
    findings.write.mode("overwrite").partitionBy("severity").parquet(path)
