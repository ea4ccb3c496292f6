"""Specifications and tool reports written from rows, and the arrival stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.dimensions import TOOLS
from auditloom.operators import ingest, spec_rules
from auditloom.plans.bound.base import DOC_FINDINGS_SQL, bind, table
from auditloom.plans.expected import literal
from auditloom.plans.round_trips import spec_files, tool_reports
from auditloom.session import scratch_dir, spread
from auditloom.sources.files import describe
from auditloom.sources.specs import endpoints, parse_specs, store_specs
from auditloom.streaming.incremental import Versions, run_available, run_versions, window_counts

# --- API specifications ------------------------------------------------------------------

SPEC_SQL = """
    SELECT p_brand AS repo, p_partkey // 50 AS block, (p_partkey // 50) % 11 = 6 AS broken,
           (p_partkey // 50) % 3 = 1 AS is_yaml, (p_partkey // 50) % 2 = 1 AS secured,
           CASE WHEN (p_partkey // 50) % 7 = 0 THEN '' WHEN (p_partkey // 50) % 5 = 0 THEN '2.0'
                WHEN (p_partkey // 50) % 8 = 3 THEN '3' ELSE '3.0.1' END AS version,
           'OpenAPI-' || (p_partkey // 50) || CASE WHEN (p_partkey // 50) % 3 = 1 THEN '.yaml' ELSE '.json' END AS name,
           p_partkey, p_size FROM part
"""
DOCUMENT_SQL = f"SELECT DISTINCT repo, block, broken, is_yaml, secured, version, name FROM ({SPEC_SQL})"
SOUND_SQL = "NOT broken AND version <> '3'"
NO_CONTENT_SQL = "p_partkey % 5 <> 0 AND p_partkey % 3 = 0"


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_specs(parse_specs(describe(spec_files(table(spark, sf_dir, "part")))))


@bind("o1_selected_specs", f"SELECT repo, 'spec/' || name AS path, NOT broken AS parsed FROM ({DOCUMENT_SQL})")
def selected_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return specs(spark, sf_dir).select("repo", "path", "parsed")


@bind("o2_o3_o4_o8_document_rules", f"""
    SELECT repo, rule_id, 'spec/' || name AS file, detail FROM (
        SELECT *, 'OPENAPI-INVALID-FORMAT' AS rule_id, 'Could not parse ' || name || ' as JSON or YAML.' AS detail
        FROM ({DOCUMENT_SQL}) WHERE broken
        UNION ALL SELECT *, 'OPENAPI-ANALYSIS-ERROR', 'Error analyzing ' || name || ': the version is not a string'
        FROM ({DOCUMENT_SQL}) WHERE NOT broken AND version = '3'
        UNION ALL SELECT *, 'OPENAPI-OUTDATED-VERSION', 'OpenAPI version ' || version || ' may be outdated.'
        FROM ({DOCUMENT_SQL}) WHERE {SOUND_SQL} AND version <> '3.0.1'
        UNION ALL SELECT *, 'OPENAPI-NO-SECURITY', 'OpenAPI specification has no security schemes defined.'
        FROM ({DOCUMENT_SQL}) WHERE {SOUND_SQL} AND NOT secured)
""")
def document_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spec_rules.document_rules(specs(spark, sf_dir)).select("repo", "rule_id", "file", "detail")


@bind("o5_endpoints", f"""
    SELECT repo, 'spec/' || name AS path, '/' || p_partkey AS url, 'get' AS method FROM ({SPEC_SQL}) WHERE NOT broken
""")
def documented_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return endpoints(specs(spark, sf_dir)).select("repo", "path", "url", "method")


@bind("o6_o7_endpoint_rules", f"""
    SELECT repo, 'spec/' || name AS file, 'OPENAPI-MISSING-DESCRIPTION' AS rule_id,
           'GET /' || p_partkey || ' is missing a description.' AS detail
    FROM ({SPEC_SQL}) WHERE {SOUND_SQL} AND p_size % 2 = 0
    UNION ALL SELECT repo, 'spec/' || name, 'OPENAPI-MISSING-RESPONSE',
                     'GET /' || p_partkey || ' 200 response is missing content schema.'
    FROM ({SPEC_SQL}) WHERE {SOUND_SQL} AND {NO_CONTENT_SQL}
""")
def endpoint_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spec_rules.endpoint_rules(specs(spark, sf_dir)).select("repo", "file", "rule_id", "detail")


@bind("o9_spec_metrics", f"""
    SELECT d.repo, openapi_files_found, coalesce(schemas_found, 0) AS schemas_found,
           coalesce(endpoints_documented, 0) AS endpoints_documented,
           coalesce(missing_descriptions, 0) AS missing_descriptions, coalesce(security_schemes, 0) AS security_schemes
    FROM (SELECT repo, count(*) AS openapi_files_found,
                 CAST(sum(CASE WHEN {SOUND_SQL} THEN CASE WHEN is_yaml THEN 1 ELSE 2 END ELSE 0 END) AS BIGINT) AS schemas_found,
                 count(*) FILTER ({SOUND_SQL} AND secured) AS security_schemes
          FROM ({DOCUMENT_SQL}) GROUP BY repo) d
    LEFT JOIN (SELECT repo, count(*) AS endpoints_documented, count(*) FILTER (p_size % 2 = 0) AS missing_descriptions
               FROM ({SPEC_SQL}) WHERE {SOUND_SQL} GROUP BY repo) e ON d.repo = e.repo
""")
def spec_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spec_rules.spec_metrics(specs(spark, sf_dir))


# --- Tool reports --------------------------------------------------------------------------

BLOCK_SQL = "'r' || (event_id // 1000)"
ROW_SQL = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


def tool_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_reports(table(spark, sf_dir, "events"))


@bind("i1_lint_findings", f"""
    SELECT {BLOCK_SQL} AS repo, 'Ruff ' || event_type AS title, 'u' || user_id || '.py' AS file, {ROW_SQL} AS line,
           'RUFF' AS rule_id, 'Ruff' AS source, count(*) AS n
    FROM events
    GROUP BY ALL
""")
def lint_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ingest.lint_findings(tool_runs(spark, sf_dir))
    return found.groupBy("repo", "title", "file", "line", "rule_id", "source").agg(F.count("*").alias("n"))


@bind("i2_security_findings", f"""
    SELECT {BLOCK_SQL} AS repo, CASE WHEN value < 2 THEN 'LOW' WHEN value < 5 THEN 'MEDIUM' WHEN value < 20 THEN 'HIGH'
           ELSE 'MEDIUM' END AS severity, event_type AS title, props AS detail, 'u' || user_id || '.py' AS file,
           {ROW_SQL} AS line, 'B' || event_id AS rule_id, 'Security' AS category, 'Bandit' AS source
    FROM events
""")
def security_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.security_findings(tool_runs(spark, sf_dir)).select(
        "repo", "severity", "title", "detail", "file", "line", "rule_id", "category", "source"
    )


@bind("i3_vulnerability_findings", f"""
    SELECT {BLOCK_SQL} AS repo, 'HIGH' AS severity, 'Dépendance vulnérable: pkg' || user_id AS title,
           'V' || event_id || ': ' || repeat(props, 60) AS detail, 'DEP-VULN' AS rule_id
    FROM events WHERE event_type = 'error'
""")
def vulnerability_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.vulnerability_findings(tool_runs(spark, sf_dir)).select("repo", "severity", "title", "detail", "rule_id")


@bind("i4_failed_test_runs", f"""
    SELECT repo, output AS detail, 'TEST-FAIL' AS rule_id FROM (
        SELECT {BLOCK_SQL} AS repo, '[' || string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) || ']' AS output
        FROM events WHERE event_type = 'error' GROUP BY {BLOCK_SQL})
    WHERE CAST(substr(repo, 2) AS BIGINT) % 2 <> 0
""")
def failed_test_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.test_findings(tool_runs(spark, sf_dir)).select("repo", "detail", "rule_id")


@bind("i5_timeouts", f"""
    SELECT DISTINCT {BLOCK_SQL} AS repo, 'ruff a dépassé le délai' AS title, 'TOOL-TIMEOUT' AS rule_id, 'MEDIUM' AS severity
    FROM events WHERE (event_id // 1000) % 3 = 0
""")
def timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.timeout_findings(tool_runs(spark, sf_dir)).select("repo", "title", "rule_id", "severity")


@bind("i6_tool_summary", f"""
    SELECT r.repo, t.tool, CASE t.tool WHEN 'ruff' THEN true WHEN 'bandit' THEN true
           WHEN 'pip-audit' THEN errors > 0 WHEN 'pytest' THEN errors > 0 ELSE false END AS available
    FROM (SELECT {BLOCK_SQL} AS repo, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY ALL) r,
         (VALUES {', '.join(f"({literal(t)})" for t in TOOLS)}) t(tool)
""")
def tool_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = tool_runs(spark, sf_dir)
    return ingest.tool_summary(runs, runs).select("repo", "tool", "available")


# --- Stream --------------------------------------------------------------------------------

WINDOW, LATENESS = "6 hours", "12 hours"


@bind("st1_incremental_audit", f"""
    SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, repo, severity, count(*) AS n FROM (
        SELECT DISTINCT time_bucket(INTERVAL 6 HOURS, a.ts, TIMESTAMP '1970-01-01') AS w, f.*
        FROM (SELECT ts, event_id % (SELECT count(*) FROM documents) || '.py' AS file FROM events) a
        JOIN ({DOC_FINDINGS_SQL}) f ON f.file = a.file
        WHERE f.rule_id IN ('SEC-SECRET-SCAN', 'SEC-HARDCODED-SECRET'))
    WHERE w + INTERVAL 6 HOURS <= (SELECT max(ts) FROM events) - INTERVAL 12 HOURS
    GROUP BY ALL
""")
def incremental_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as arrivals of documents; the closed windows, as the stream wrote them."""
    documents = spread(table(spark, sf_dir, "documents"))
    place = f"{scratch_dir(spark)}/stream-{uuid.uuid4()}"
    versions = Versions(spark, place)
    # A document never changes here, so its id is its digest, and all versions are known at the start.
    path, digest = F.concat(F.col("doc_id").cast("string"), F.lit(".py")), F.col("doc_id").cast("string")
    named = documents.select(F.col("source").alias("repo"), path.alias("path"), digest.alias("digest"), F.lit(None).cast("timestamp").alias("arrived"))
    versions.add(named, lambda _: describe(documents.select(
        F.col("source").alias("repo"), path.alias("path"), digest.alias("digest"), F.col("text").alias("content"), F.octet_length("text").alias("size"))), 0)
    arriving = document_arrivals(spark, sf_dir, documents.count()).withWatermark("arrived", LATENESS)
    findings = versions.findings().withColumn("doc_id", F.col("digest").cast("long"))
    counts = window_counts(arriving.select("doc_id", "arrived").join(findings, "doc_id"), WINDOW)
    run_available(counts, f"{place}/counts", f"{place}/checkpoint")
    written = spark.read.schema(counts.schema).parquet(f"{place}/counts")
    return written.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "repo", "severity", "n")


def document_arrivals(spark: SparkSession, sf_dir: str, n_documents: int) -> DataFrame:
    """The stream of events as arrivals of documents, every second time in a second version."""
    events = table(spark, sf_dir, "events")
    return spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events*.parquet").select(
        F.col("ts").cast("timestamp").alias("arrived"), (F.col("event_id") % n_documents).alias("doc_id"),
        (F.floor(F.col("event_id") / n_documents) % 2).alias("version"), "event_id",
    )


# Lines appended to the second version of a document, by its id, and the rules that each breaks. The secret
# scan looks at whole texts: it names no line, and what a text holds already it doesn't find again.
EDITS = [
    ('token = "abcdefgh"', ["SEC-HARDCODED-SECRET"]),
    ('q = f"SELECT a FROM t WHERE b = {c}"', ["SQL-INJECTION-PATTERN", "SQL-INJECTION-FSTRING"]),
    ('q = "SELECT a FROM t WHERE b = {}".format(c)', ["SQL-INJECTION-PATTERN", "SQL-INJECTION-FORMAT"]),
    ("app = FastAPI(openapi_url=None)", ["FASTAPI-OPENAPI-DISABLED"]),
    ("app = FastAPI(docs_url=None, redoc_url=None)", ["FASTAPI-DOCS-DISABLED", "FASTAPI-REDOC-DISABLED"]),
]
EDIT_SQL = "(VALUES " + ", ".join(f"({k}, {literal(rule)}, NULL)" for k, (_, rules) in enumerate(EDITS) for rule in rules) + \
    ", (0, 'SEC-SECRET-SCAN', 'Token codé en dur')) e(edit, rule_id, title)"


@bind("st1_open_findings", f"""
    WITH last AS (
        SELECT event_id % n AS doc_id, arg_max(event_id // n % 2, (ts, event_id // n % 2)) AS version
        FROM events, (SELECT count(*) AS n FROM documents) GROUP BY 1)
    SELECT repo, file, line, rule_id, CASE rule_id WHEN 'SEC-SECRET-SCAN' THEN title END AS title
    FROM ({DOC_FINDINGS_SQL}) JOIN last ON file = last.doc_id || '.py'
    WHERE rule_id IN ('SEC-SECRET-SCAN', 'SEC-HARDCODED-SECRET')
    UNION
    SELECT source, d.doc_id || '.py', CASE WHEN title IS NULL THEN strlen(text) - strlen(replace(text, chr(10), '')) + 2 END, rule_id, title
    FROM documents d JOIN last USING (doc_id) JOIN {EDIT_SQL} ON edit = d.doc_id % {len(EDITS)} WHERE version = 1
""")
def open_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive again and again in two versions; the findings of each one's last version."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    place = f"{scratch_dir(spark)}/stream-{uuid.uuid4()}"
    versions = Versions(spark, place)
    edit = F.get(F.array(*[F.lit(line) for line, _ in EDITS]), (F.col("doc_id") % len(EDITS)).cast("int"))

    def contents(fresh: DataFrame) -> DataFrame:
        """Texts of new versions, whose digest ends in the number of the version."""
        wanted = fresh.select(F.regexp_extract("path", r"^\d+", 0).cast("long").alias("doc_id"), "repo", "path", "digest")
        text = F.when(F.col("digest").endswith("-1"), F.concat("text", F.lit("\n"), edit)).otherwise(F.col("text"))
        return describe(wanted.join(documents, "doc_id").select(
            "repo", "path", "digest", text.alias("content"), F.octet_length("text").alias("size")))

    arriving = document_arrivals(spark, sf_dir, documents.count()).join(documents.select("doc_id", "source"), "doc_id").select(
        F.col("source").alias("repo"), F.concat(F.col("doc_id").cast("string"), F.lit(".py")).alias("path"),
        F.concat_ws("-", "doc_id", "version").alias("digest"), "arrived",
    )
    run_versions(arriving, versions, contents, f"{place}/checkpoint")
    found = versions.open_findings()
    title = F.when(F.col("rule_id").isin("SEC-SECRET-SCAN"), F.col("title"))
    return found.select("repo", "file", "line", "rule_id", title.alias("title"))
