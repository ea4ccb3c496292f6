"""Registration and shared inputs of the bound queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.operators import text_rules
from auditloom.operators.findings import emit
from auditloom.operators.rules_catalog import RULES
from auditloom.dimensions import DEFAULT_SOURCE
from auditloom.plans.expected import HARDCODED, SECRET_SIGNATURES, literal
from auditloom.session import spread
from auditloom.sources.files import files_from_table
from auditloom.sources.lines import to_lines

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def bind(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with its oracle if SQL can express one."""

    def keep(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the Python files of their sources."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    path = F.concat(F.col("doc_id").cast("string"), F.lit(".py"))
    return files_from_table(documents, F.col("source"), path, F.col("text"))


# Lines of documents in SQL: the data has no line break but the newline.
DOC_LINES_SQL = """
    SELECT repo, file, unnest(l) AS line, CAST(generate_subscripts(l, 1) AS INTEGER) AS line_no FROM (
        SELECT source AS repo, doc_id || '.py' AS file,
               CASE WHEN text LIKE '%' || chr(10) THEN list_slice(string_split(text, chr(10)), 1, -2)
                    ELSE string_split(text, chr(10)) END AS l
        FROM documents WHERE text <> '')
"""

COMMON_WORD = " the "
LONG_DOCUMENT = 5_000


def document_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of four severities on the documents' own text."""
    files = document_files(spark, sf_dir)
    lines = to_lines(files)
    worded = text_rules.first_matching_line(lines, F.contains("line", F.lit(COMMON_WORD)))
    return (
        text_rules.text_findings(files, ["secrets"])
        .unionByName(emit(worded, "ARCH-DB-IN-API", line="line_no"))
        .unionByName(text_rules.large_files(files, LONG_DOCUMENT))
    )


def finding_select(rule_id: str, rows: str, line: str = "NULL", title: str | None = None, detail: str | None = None) -> str:
    """SQL that turns (repo, file, ...) rows into findings of a rule."""
    rule = RULES[rule_id]
    return f"""
        SELECT repo, {literal(rule.severity)} AS severity, {literal(rule.category)} AS category,
               {title or literal(rule.title)} AS title, {detail or literal(rule.detail)} AS detail,
               file, CAST({line} AS INTEGER) AS line, {literal(rule.recommendation)} AS recommendation,
               {literal(DEFAULT_SOURCE)} AS source, {literal(rule_id)} AS rule_id, 'MEDIUM' AS confidence
        FROM ({rows})
    """


def any_case(pattern: str) -> str:
    return literal("(?i)" + pattern)


def secret_rows_sql(files: str) -> str:
    """One row per file and matching signature."""
    return " UNION ALL ".join(
        f"SELECT repo, file, {literal(label)} AS label FROM ({files}) "
        f"WHERE regexp_matches(text, {literal(pattern) if exact else any_case(pattern)})"
        for label, pattern, exact in SECRET_SIGNATURES
    )


DOC_FILES_SQL = "SELECT source AS repo, doc_id || '.py' AS file, text FROM documents"

HARDCODED_SQL = HARDCODED.removeprefix("(?i)")

DOC_FINDINGS_SQL = " UNION ALL ".join([
    finding_select("SEC-SECRET-SCAN", secret_rows_sql(DOC_FILES_SQL), title="label"),
    finding_select(
        "SEC-HARDCODED-SECRET",
        f"SELECT * FROM ({DOC_LINES_SQL}) WHERE regexp_matches(line, {any_case(HARDCODED_SQL)})", line="line_no"),
    finding_select(
        "ARCH-DB-IN-API",
        f"SELECT repo, file, min(line_no) AS line_no FROM ({DOC_LINES_SQL}) "
        f"WHERE contains(line, {literal(COMMON_WORD)}) GROUP BY repo, file", line="line_no"),
    finding_select(
        "REPO-LARGE-FILE",
        f"SELECT repo, file, strlen(text) AS size FROM ({DOC_FILES_SQL}) WHERE strlen(text) > {LONG_DOCUMENT}",
        detail="'Taille approximative: ' || format('{:.1f}', size / 1000000) || ' MB.'"),
])

# Penalties in hundred-thousandths of a point, so that the sum is exact.
SCORE_SQL = """
    SELECT r.repo, CAST(greatest(0, least(100, round_even(100 - coalesce(p.penalty, 0) / 100000.0, 0))) AS INTEGER) AS score
    FROM ({repos}) r LEFT JOIN (
        SELECT repo, sum(
            CASE severity WHEN 'CRITICAL' THEN 150 WHEN 'HIGH' THEN 80 WHEN 'MEDIUM' THEN 30 WHEN 'LOW' THEN 5 ELSE 0 END
            * CASE confidence WHEN 'HIGH' THEN 100 WHEN 'LOW' THEN 30 ELSE 65 END
            * (100 + 15 * least(4, n - 1))) AS penalty
        FROM (SELECT repo, coalesce(nullif(rule_id, ''), nullif(title, ''), 'unknown') AS rule, count(*) AS n,
                     min(severity) AS severity, min(confidence) AS confidence
              FROM ({findings}) GROUP BY ALL)
        GROUP BY repo) p ON r.repo = p.repo
"""


def score_sql(findings: str, repos: str = "SELECT DISTINCT source AS repo FROM documents") -> str:
    """Score in SQL, for findings where a rule has one severity and one confidence."""
    return SCORE_SQL.format(findings=findings, repos=repos)
