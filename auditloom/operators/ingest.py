"""Reports of external tools, read as data: tool_report(repo, tool, returncode, output[, error])."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.dimensions import SEVERITY_NAMES, TOOLS
from auditloom.operators.findings import emit

# Fixed value: the return code of a tool that ran out of time.
TIMED_OUT = 124

LINT = "array<struct<code:string,message:string,filename:string,location:struct<row:int>>>"
SECURITY = (
    "struct<results:array<struct<issue_severity:string,test_name:string,issue_text:string,"
    "filename:string,line_number:int,test_id:string>>>"
)
PACKAGES = "array<struct<name:string,vulns:array<struct<id:string,description:string>>>>"


def of_tool(reports: DataFrame, tool: str) -> DataFrame:
    return reports.filter((F.col("tool") == tool) & (F.col("output") != ""))


def is_list() -> Column:
    """The report's outermost value is a JSON list."""
    return F.ltrim("output").startswith("[")


def report_items(reports: DataFrame, items: Column) -> DataFrame:
    """One row per report item."""
    return reports.select("repo", F.explode(items).alias("item"))


def lint_findings(reports: DataFrame) -> DataFrame:
    """Items of a lint report; a malformed report yields nothing."""
    items = report_items(of_tool(reports, "ruff").filter(is_list()), F.from_json("output", LINT)).select(
        "repo", "item.code", "item.message", "item.filename", F.col("item.location.row").alias("row")
    )
    return emit(
        items, "RUFF", title=F.concat(F.lit("Ruff "), F.coalesce("code", F.lit("issue"))),
        detail=F.coalesce("message", F.lit("Violation Ruff.")), file="filename", line="row", source="Ruff",
    )


def security_findings(reports: DataFrame) -> DataFrame:
    """Items of a security report; severities outside the known five count as MEDIUM."""
    items = report_items(of_tool(reports, "bandit"), F.from_json("output", SECURITY)["results"]).select("repo", "item.*")
    given = F.upper("issue_severity")
    severity = F.when(given.isin(SEVERITY_NAMES), given).otherwise("MEDIUM")
    return emit(
        items, "BANDIT", severity=severity,
        title=F.coalesce("test_name", F.lit("Bandit finding")),
        detail=F.coalesce("issue_text", F.lit("Finding Bandit.")),
        file="filename", line="line_number", source="Bandit", rule="test_id",
    )


def vulnerability_findings(reports: DataFrame) -> DataFrame:
    """Known vulnerabilities per package, from a bare list or one under ``dependencies``."""
    listed = F.when(is_list(), F.from_json("output", PACKAGES)).otherwise(
        F.from_json("output", f"struct<dependencies:{PACKAGES}>")["dependencies"]
    )
    packages = of_tool(reports, "pip-audit").select("repo", F.explode(listed).alias("package"))
    vulns = packages.select(
        "repo", F.coalesce("package.name", F.lit("unknown")).alias("name"), F.explode("package.vulns").alias("v")
    )
    text = F.coalesce("v.description", F.lit(""))
    return emit(
        vulns, "DEP-VULN", title=F.concat(F.lit("Dépendance vulnérable: "), F.col("name")),
        detail=F.concat(F.coalesce("v.id", F.lit("")), F.lit(": "), text), file=None, source="pip-audit",
    )


def test_findings(reports: DataFrame) -> DataFrame:
    """A failed test run, with its error text or else its output."""
    error = F.nullif("error", F.lit("")) if "error" in reports.columns else F.lit(None).cast("string")
    text = F.coalesce(error, F.col("output"), F.lit(""))
    failed = reports.filter((F.col("tool") == "pytest") & (F.col("returncode") != 0))
    return emit(failed, "TEST-FAIL", detail=text, file=None, source="pytest")


def timeout_findings(reports: DataFrame) -> DataFrame:
    late = reports.filter(F.col("returncode") == TIMED_OUT)
    return emit(late, "TOOL-TIMEOUT", title=F.concat("tool", F.lit(" a dépassé le délai")), file=None)


def tool_findings(reports: DataFrame) -> DataFrame:
    return (
        timeout_findings(reports).unionByName(lint_findings(reports)).unionByName(security_findings(reports))
        .unionByName(vulnerability_findings(reports)).unionByName(test_findings(reports))
    )


def tool_summary(repos: DataFrame, reports: DataFrame, tools: list[str] = TOOLS) -> DataFrame:
    """One row per repository and known tool, absent tools marked.

    The tools are spread as an array over the repositories, so a repository only ever
    multiplies by the fixed number of tools.
    """
    wanted = repos.select("repo").distinct().select(
        "repo", F.explode(F.array(*map(F.lit, tools))).alias("tool")
    )
    runs = reports.groupBy("repo", "tool").agg(F.max("returncode").alias("returncode"))
    return wanted.join(runs, ["repo", "tool"], "left").select(
        "repo", "tool", F.col("returncode").isNotNull().alias("available"), "returncode",
        F.when(F.col("returncode").isNull(), "Outil non installé; analyse ignorée.").otherwise("").alias("note"),
    )
