"""Rules that look at file names, whole texts or single lines. None of them shuffles,
except the first-matching-line rule, which keeps one row per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.dimensions import LARGE_FILE
from auditloom.functions import text
from auditloom.operators.findings import emit, emit_by_rule, emit_hits, hit
from auditloom.operators.marks import DISABLED_DOCS, mark_files, mark_lines, may_hold_secrets
from auditloom.sources.lines import texts_and_lines

# Layers a file may belong to.
CONCERNS = ["api", "model", "service", "repository", "controller", "view", "schema"]

# Line rules by group. Secrets are never reported in tests, statements only on request,
# switched-off documentation always.
LINE_GROUPS = {
    "secrets": ["SEC-HARDCODED-SECRET"],
    "sql": ["SQL-INJECTION-PATTERN", "SQL-INJECTION-FSTRING", "SQL-INJECTION-FORMAT"],
    "docs": [rule for _, rule in DISABLED_DOCS],
}


def secret_hits() -> Column:
    """One hit per signature found in the file."""
    return F.transform("secrets", lambda label: hit("SEC-SECRET-SCAN", title=label))


def env_file() -> Column:
    detail = F.format_string(
        "Le fichier %s existe dans l'arborescence auditée; il doit normalement être ignoré par Git.",
        F.col("name"),
    )
    return F.when(F.col("is_dotenv"), hit("SEC-ENV-FILE", detail=detail))


def large_file(threshold: int = LARGE_FILE) -> Column:
    megabytes = F.translate(F.format_number(F.col("size") / 1_000_000, 1), ",", "")
    detail = F.concat(F.lit("Taille approximative: "), megabytes, F.lit(" MB."))
    return F.when(F.col("size") > threshold, hit("REPO-LARGE-FILE", detail=detail))


def clean_architecture() -> Column:
    """A domain file mentions a framework; the first in list order is reported."""
    detail = F.format_string("Domain file imports framework code (%s).", F.col("framework"))
    return F.when(F.col("framework").isNotNull(), hit("ARCH-CLEAN-VIOLATION", detail=detail))


def mixed_concerns(concerns: list[str] = CONCERNS) -> Column:
    found = text.words_found(F.lower("path"), concerns)
    detail = F.concat(F.lit("File appears to mix "), F.array_join(found, ", "), F.lit(" concerns."))
    mixed = F.col("is_py") & F.col("has_text") & (F.size(found) > 1)
    return F.when(mixed, hit("ARCH-MIXED-CONCERNS", detail=detail))


def file_rule(rule_id: str) -> Column:
    """The hit of one file rule, null where the file does not break it."""
    return {
        "SEC-ENV-FILE": env_file,
        "REPO-LARGE-FILE": large_file,
        "DOCKER-NONROOT": lambda: F.when(F.col("no_user"), hit("DOCKER-NONROOT")),
        "DOCKER-REMOTE-ADD": lambda: F.when(F.col("remote_add"), hit("DOCKER-REMOTE-ADD")),
        "ARCH-CLEAN-VIOLATION": clean_architecture,
        "ARCH-MIXED-CONCERNS": mixed_concerns,
    }[rule_id]()


FILE_RULES = [
    "SEC-SECRET-SCAN", "SEC-ENV-FILE", "REPO-LARGE-FILE", "DOCKER-NONROOT", "DOCKER-REMOTE-ADD",
    "ARCH-CLEAN-VIOLATION", "ARCH-MIXED-CONCERNS",
]


def file_findings(files: DataFrame, rules: list[str] = FILE_RULES, skip_tests: list[str] = ()) -> DataFrame:
    """Any number of file rules in one pass; some of them not on tests."""
    hits = []
    for rule in rules:
        if rule == "SEC-SECRET-SCAN":
            continue
        found = file_rule(rule)
        hits.append(F.when(~F.col("is_test"), found) if rule in skip_tests else found)
    found = [F.array(*hits)] if hits else []
    if "SEC-SECRET-SCAN" in rules:
        found.append(F.coalesce(secret_hits(), F.array()))
    return emit_hits(mark_files(files), F.concat(*found))


def large_files(files: DataFrame, threshold: int = LARGE_FILE) -> DataFrame:
    return emit_hits(files, F.array(large_file(threshold)))


def line_rules(lines: DataFrame, groups: list[str] = tuple(LINE_GROUPS), include_tests: bool = False) -> DataFrame:
    """All rules that look at one line, in one pass over the lines."""
    chosen = [rule for group in groups for rule in LINE_GROUPS[group]]
    everywhere = LINE_GROUPS["docs"] + (LINE_GROUPS["sql"] if include_tests else [])
    hits = mark_lines(lines, groups).withColumn("rule", F.explode("broken")).filter(
        F.col("rule").isin(chosen) & (~F.col("is_test") | F.col("rule").isin(everywhere))
    )
    return emit_by_rule(hits, "rule", line_details(chosen), line="line_no")


def line_details(rules: list[str]) -> dict[str, Column | None]:
    quoted = F.concat(F.lit("SQL statement with potential injection pattern: "), F.col("head"), F.lit("..."))
    return {rule: quoted if rule == "SQL-INJECTION-PATTERN" else None for rule in rules}


def text_findings(files: DataFrame, groups: list[str] = tuple(LINE_GROUPS)) -> DataFrame:
    """The secret scan and all line rules in a single pass over contents."""
    chosen = [rule for group in groups for rule in LINE_GROUPS[group]]
    rows = mark_lines(texts_and_lines(files), groups)
    whole = F.when(may_hold_secrets(), text.secret_hits(F.col("line")))
    labels = F.transform(whole, lambda label: F.struct(F.lit("SEC-SECRET-SCAN").alias("rule"), label.alias("label")))
    broken = F.filter("broken", lambda rule: rule.isin(chosen) & (~F.col("is_test") | rule.isin(LINE_GROUPS["docs"])))
    rules = F.transform(broken, lambda rule: F.struct(rule.alias("rule"), F.lit(None).cast("string").alias("label")))
    hits = rows.select("*", F.explode(F.when(F.col("line_no") == 0, labels).otherwise(rules)).alias("h")).select(
        "*", "h.rule", "h.label", F.nullif("line_no", F.lit(0)).alias("at")
    )
    details = {"SEC-SECRET-SCAN": None} | line_details(chosen)
    return emit_by_rule(hits, "rule", details, line="at", titles={"SEC-SECRET-SCAN": F.col("label")})


def unreadable(lost: DataFrame) -> DataFrame:
    """What a scan could not read, as findings; ``lost(repo, path, reason)`` is the scan's own table."""
    return emit(lost, "SCAN-UNREADABLE", detail=F.format_string("Not read: %s.", F.col("reason")))


def first_matching_line(lines: DataFrame, test: Column) -> DataFrame:
    """(repo, path, line_no) of each file's first line satisfying a predicate."""
    return lines.filter(test).groupBy("repo", "path").agg(F.min("line_no").alias("line_no"))


def database_in_api(lines: DataFrame) -> DataFrame:
    first = first_matching_line(mark_lines(lines), F.col("database_word"))
    return emit(first, "ARCH-DB-IN-API", line="line_no")
