"""The rule registry: what runs in which mode, on which repositories and files.

A rule set is a function from ``Tables`` and the chosen rule ids to a findings DataFrame.
Rules that can share a pass over their input share one; ``CHOICES`` says when each rule
runs. To add a rule, append an ``ExtraRule`` to the audit call; nothing is computed for
rules that are not chosen.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import paths
from auditloom.operators import (
    code_rules, features, graph, model_rules, route_rules, spec_rules, text_rules,
)
from auditloom.operators.marks import mark_files, marked_only
from auditloom.session import stored
from auditloom.sources.facts import extract_facts, imports, store_facts
from auditloom.sources.files import heuristic_scope, select_python
from auditloom.sources.lines import to_lines
from auditloom.sources.specs import parse_specs, store_specs


class Tables:
    """The inputs of the rules, each derived once from `files`.

    Contents are read four times in all: by the parse job, for the file marks, for the line
    marks and for the specifications. What these passes find is stored, and the rules read
    only that.
    """

    def __init__(self, files: DataFrame, include_tests: bool = False, facts_path: str | None = None):
        self.all_files = files
        self.include_tests = include_tests
        self.facts_path = facts_path
        self._families: dict[str, Tables] = {}

    @cached_property
    def features(self) -> DataFrame:
        code = features.has_sql(self.code(self.files))
        joined = features.detect_stack(self.files).join(code, "repo", "left")
        return stored(joined.withColumn("has_sql", F.coalesce("has_sql", F.lit(False))), "features")

    @cached_property
    def files(self) -> DataFrame:
        """Marked files, without their content."""
        return stored(mark_files(self.all_files).drop("content"), "files")

    @cached_property
    def lines(self) -> DataFrame:
        """Marked lines of all Python files."""
        return stored(marked_only(to_lines(select_python(self.all_files))), "lines")

    @cached_property
    def facts(self) -> DataFrame:
        return store_facts(extract_facts(self.all_files), self.facts_path)

    @cached_property
    def specs(self) -> DataFrame:
        return store_specs(parse_specs(self.all_files))

    def of_family(self, family: str) -> Tables:
        """These tables, cut down to the repositories that a gated family applies to.

        The gate comes before the work: specifications of other repositories aren't parsed,
        and their graphs aren't searched.
        """
        gates = family_gates()
        if family not in gates:
            return self
        if family not in self._families:
            repos = self.features.filter(gates[family]).select("repo")
            inner = Tables(self.all_files.join(repos, "repo", "left_semi"), self.include_tests)
            for name in ("files", "lines", "facts"):
                inner.__dict__[name] = getattr(self, name).join(repos, "repo", "left_semi")
            self._families[family] = inner
        return self._families[family]

    def code(self, rows: DataFrame) -> DataFrame:
        """Rows the heuristic rules look at: those of tests only when asked for."""
        if "is_test" in rows.columns:
            return heuristic_scope(rows, self.include_tests)
        return rows if self.include_tests else rows.filter(~paths.is_test(F.col("path")))

    @cached_property
    def routes(self) -> DataFrame:
        return route_rules.routes(self.code(self.facts), self.code(self.lines))

    @cached_property
    def import_edges(self) -> DataFrame:
        index = graph.module_index(self.code(self.files))
        return graph.import_edges(imports(self.code(self.facts)), index)


# Which modes run a family. "standard" is part of every audit.
FAMILY_MODES: dict[str, set[str]] = {
    "basic": {"standard"},
    "basic_deep": {"deep"},
    "dataflow": {"deep"},
    "sql": {"deep"},
    "deps": {"deep", "deps"},
    "openapi": {"deep", "openapi"},
    "pydantic": {"deep"},
    "async": {"deep"},
    "performance": {"deep", "performance"},
    "architecture": {"deep"},
}


def family_gates() -> dict[str, Column]:
    """The features a repository must have for a family to apply to it."""
    return {
        "sql": F.col("sqlalchemy") | F.col("has_sql"),
        "deps": F.col("fastapi"),
        "openapi": F.col("openapi") | F.col("fastapi"),
        "pydantic": F.col("pydantic"),
    }


# The rules of each family.
FAMILIES: dict[str, list[str]] = {
    "basic": [
        "PY-SYNTAX", "SEC-EVAL", "SEC-SHELL", "SEC-HARDCODED-SECRET", "SEC-SECRET-SCAN", "REPO-LARGE-FILE",
        "PROD-DEBUG", "API-CORS-WILDCARD", "DOCKER-REMOTE-ADD",
    ],
    "basic_deep": ["PY-LONG-FUNCTION", "PY-UNTYPED", "SEC-ENV-FILE", "AUTH-JWT-NONE", "DOCKER-NONROOT"],
    "dataflow": ["DATAFLOW-LOGGING-LEAK", "DATAFLOW-PRINT-LEAK"],
    "sql": [
        "SQL-INJECTION-PATTERN", "SQL-INJECTION-FSTRING", "SQL-INJECTION-FORMAT", "SQLALCHEMY-FSTRING-TEXT",
        "SQL-CONCAT-EXECUTE", "SQL-INJECTION-FSTRING-KEYWORDS",
    ],
    "deps": ["FASTAPI-CIRCULAR-DEP", "FASTAPI-UNPROTECTED-ROUTE", "FASTAPI-MISSING-DEP"],
    "openapi": [
        "OPENAPI-INVALID-FORMAT", "OPENAPI-ANALYSIS-ERROR", "OPENAPI-OUTDATED-VERSION",
        "OPENAPI-MISSING-DESCRIPTION", "OPENAPI-MISSING-RESPONSE", "OPENAPI-NO-SECURITY",
        "FASTAPI-OPENAPI-DISABLED", "FASTAPI-DOCS-DISABLED", "FASTAPI-REDOC-DISABLED",
    ],
    "pydantic": [
        "PYDANTIC-UNTYPED-FIELD", "PYDANTIC-CUSTOM-INIT", "PYDANTIC-MUTABLE-DEFAULT",
        "PYDANTIC-SENSITIVE-NO-VALIDATOR", "PYDANTIC-NO-BASEMODEL", "PYDANTIC-OPTIONAL-NO-DEFAULT",
    ],
    "async": [
        "ASYNC-NESTED-FUNCTION", "ASYNC-BLOCKING-AWAIT", "ASYNC-BLOCKING-IO", "ASYNC-MISSING-AWAIT",
        "ASYNC-CONTEXT-MANAGER",
    ],
    "performance": [
        "PERF-N-PLUS-ONE", "PERF-LIST-IN-LOOP", "PERF-EXPENSIVE-IN-LOOP", "PERF-COMPLEX-COMPREHENSION",
        "PERF-COMPLEX-DICT-COMP", "PERF-LARGE-DATA-STRUCTURE",
    ],
    "architecture": [
        "ARCH-CLEAN-VIOLATION", "ARCH-MIXED-CONCERNS", "ARCH-DB-IN-API", "ARCH-GOD-CLASS",
        "ARCH-CIRCULAR-IMPORT", "ARCH-HIGH-COUPLING",
    ],
}
FAMILY_OF = {rule: family for family, rules in FAMILIES.items() for rule in rules}

# Rules that look at tests even when the heuristic rules do not.
ON_TESTS = {
    "PY-SYNTAX", "PY-LONG-FUNCTION", "SEC-EVAL", "SEC-SHELL", "SEC-SECRET-SCAN", "REPO-LARGE-FILE",
    "DOCKER-REMOTE-ADD", "SEC-ENV-FILE", "DOCKER-NONROOT", *FAMILIES["openapi"],
}
# Rules that never look at tests.
NEVER_ON_TESTS = {"PY-UNTYPED", "PROD-DEBUG", "API-CORS-WILDCARD", "AUTH-JWT-NONE", "SEC-HARDCODED-SECRET"}


@dataclass(frozen=True)
class RuleSet:
    """Rules computed together."""

    rules: list[str]
    find: Callable[[Tables, list[str]], DataFrame]


@dataclass(frozen=True)
class ExtraRule:
    """A rule of the user's own, in one of the families."""

    rule_id: str
    family: str
    find: Callable[[Tables], DataFrame]


def skipped(tables: Tables, rules: list[str]) -> list[str]:
    """The rules that must leave tests out."""
    return [r for r in rules if r in NEVER_ON_TESTS or not (tables.include_tests or r in ON_TESTS)]


def node_set(tables: Tables, rules: list[str]) -> DataFrame:
    return code_rules.node_findings(tables.facts, rules, skipped(tables, rules))


def file_set(tables: Tables, rules: list[str]) -> DataFrame:
    return text_rules.file_findings(tables.files, rules, skipped(tables, rules))


def line_set(tables: Tables, rules: list[str]) -> DataFrame:
    """Line rules in one pass; secrets are not reported for files that do not parse."""
    found = text_rules.line_rules(tables.lines, include_tests=tables.include_tests).filter(F.col("rule_id").isin(rules))
    broken = tables.facts.filter("kind = 'SyntaxError'").select("repo", F.col("path").alias("file"), F.lit(True).alias("bad"))
    secret = F.col("rule_id") == "SEC-HARDCODED-SECRET"
    return found.join(broken, ["repo", "file"], "left").filter(~(secret & F.coalesce("bad", F.lit(False)))).drop("bad")


RULE_SETS: list[RuleSet] = [
    RuleSet(list(code_rules.NODE_RULES), node_set),
    RuleSet(text_rules.FILE_RULES, file_set),
    RuleSet([r for group in text_rules.LINE_GROUPS.values() for r in group], line_set),
    RuleSet(FAMILIES["dataflow"], lambda t, _: code_rules.leaks(t.code(t.facts))),
    RuleSet(["FASTAPI-CIRCULAR-DEP"], lambda t, _: route_rules.circular_dependencies(
        route_rules.dep_edges(t.code(t.facts)))),
    RuleSet(["FASTAPI-UNPROTECTED-ROUTE"], lambda t, _: route_rules.unprotected_routes(t.routes)),
    RuleSet(["FASTAPI-MISSING-DEP"], lambda t, _: route_rules.missing_dependencies(t.code(t.facts))),
    RuleSet([r for r in FAMILIES["openapi"] if r.startswith("OPENAPI")], lambda t, _: spec_rules.spec_findings(t.specs)),
    RuleSet(
        ["PYDANTIC-UNTYPED-FIELD", "PYDANTIC-MUTABLE-DEFAULT", "PYDANTIC-OPTIONAL-NO-DEFAULT"],
        lambda t, _: model_rules.field_rules(t.code(t.facts))),
    RuleSet(["PYDANTIC-CUSTOM-INIT"], lambda t, _: model_rules.custom_init(t.code(t.facts))),
    RuleSet(["PYDANTIC-SENSITIVE-NO-VALIDATOR"], lambda t, _: model_rules.unvalidated_secrets(t.code(t.facts))),
    RuleSet(
        ["ASYNC-MISSING-AWAIT", "ASYNC-CONTEXT-MANAGER"],
        lambda t, _: code_rules.unawaited(t.code(t.facts), t.lines)),
    RuleSet(["PERF-N-PLUS-ONE"], lambda t, _: code_rules.queries_in_loops(t.code(t.facts))),
    RuleSet(["ARCH-DB-IN-API"], lambda t, _: text_rules.database_in_api(t.code(t.lines))),
    RuleSet(["ARCH-GOD-CLASS"], lambda t, _: code_rules.god_classes(t.code(t.facts))),
    RuleSet(["ARCH-CIRCULAR-IMPORT"], lambda t, _: graph.circular_imports(t.import_edges)),
    RuleSet(["ARCH-HIGH-COUPLING"], lambda t, _: graph.high_coupling(t.import_edges)),
]


def chosen_rules(modes: set[str]) -> list[str]:
    return [r for family, rules in FAMILIES.items() if FAMILY_MODES[family] & modes for r in rules]


def open_gates(extra: list[ExtraRule] = ()) -> Column:
    """True for a finding whose repository has the features its rule's family asks for.

    Expects a finding row joined with its repository's features.
    """
    family_of = FAMILY_OF | {e.rule_id: e.family for e in extra}
    out = F.lit(True)
    for family, predicate in family_gates().items():
        gated = [r for r, f in family_of.items() if f == family]
        out = out & (~F.coalesce(F.col("rule_id").isin(gated), F.lit(False)) | F.coalesce(predicate, F.lit(False)))
    return out
