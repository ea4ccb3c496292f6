"""The audit of many repositories as one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from auditloom.operators import code_rules, features, ingest, reports, route_rules, spec_rules, text_rules
from auditloom.operators.findings import dedup, rank, translate, union_findings, with_defaults
from auditloom.operators.score import score
from auditloom.plans.registry import (
    FAMILY_MODES, FAMILY_OF, RULE_SETS, ExtraRule, Tables, chosen_rules, open_gates,
)
from auditloom.schemas import FINDING_COLUMNS
from auditloom.session import stored


def raw_findings(
    tables: Tables, modes: set[str], tool_reports: DataFrame | None = None, extra_rules: list[ExtraRule] = (),
) -> DataFrame:
    """Bag union of every chosen rule, gated by the features of each repository.

    Rule sets of one gated family only see the repositories it applies to; rules of several
    families that share a pass are gated by one join of their findings.
    """
    wanted = chosen_rules(modes)
    parts = []
    for rule_set in RULE_SETS:
        rules = [r for r in rule_set.rules if r in wanted]
        if rules:
            families = {FAMILY_OF[r] for r in rules}
            own = tables.of_family(families.pop()) if len(families) == 1 else tables
            parts.append(rule_set.find(own, rules))
    parts += [e.find(tables) for e in extra_rules if FAMILY_MODES[e.family] & modes]
    gated = union_findings(*parts).join(tables.features, "repo", "left").filter(open_gates(extra_rules))
    found = gated.select(*FINDING_COLUMNS)
    return found if tool_reports is None else found.unionByName(ingest.tool_findings(tool_reports))


@dataclass
class Audit:
    """Results of an audit; every attribute but the stored findings is lazy."""

    tables: Tables
    modes: set[str]
    findings: DataFrame
    tool_reports: DataFrame | None = None

    @property
    def scores(self) -> DataFrame:
        return score(self.findings, self.tables.files)

    @property
    def ranked(self) -> DataFrame:
        return rank(self.findings)

    @property
    def metrics(self) -> DataFrame:
        return features.repo_metrics(self.tables.files, self.tables.facts)

    def sections(self) -> dict[str, DataFrame | None]:
        """Report sections of the optional families; null for one that did not run."""
        tables = self.tables
        deps, openapi = tables.of_family("deps"), tables.of_family("openapi")

        def ran(family: str) -> bool:
            return bool(FAMILY_MODES[family] & self.modes)

        cycles = self.findings.filter("rule_id = 'FASTAPI-CIRCULAR-DEP'")
        return {
            "dependency_graph": route_rules.dep_metrics(
                deps.routes, deps.code(deps.facts), cycles) if ran("deps") else None,
            "openapi_analysis": spec_rules.spec_metrics(openapi.specs) if ran("openapi") else None,
            "performance_metrics": code_rules.performance_metrics(tables.code(tables.facts)) if ran("performance") else None,
        }

    def reports(self) -> DataFrame:
        """(repo, chunk, json)."""
        return reports.to_report(
            self.findings, self.scores, features=self.tables.features.drop("has_sql"), metrics=self.metrics,
            sections=self.sections(), mode="deep" if "deep" in self.modes else "standard", tools=self.tools(),
        )

    def tools(self) -> DataFrame | None:
        """(repo, tool, available, returncode, note), if tool reports were given."""
        return None if self.tool_reports is None else ingest.tool_summary(self.tables.files, self.tool_reports)

    def sarif(self) -> DataFrame:
        """(repo, chunk, json)."""
        return reports.to_sarif(self.findings)


def audit(
    files: DataFrame, deep: bool = False, families: set[str] = frozenset(), include_tests: bool = False,
    tool_reports: DataFrame | None = None, facts_path: str | None = None, extra_rules: list[ExtraRule] = (),
    lost: DataFrame | None = None,
) -> Audit:
    """Audit every repository in ``files``.

    ``families`` opens single optional families ("deps", "openapi", "performance") without
    the deep mode. ``lost`` is what a scan could not read: each row is a finding. Findings are translated before they are merged, because the title is
    part of their identity; they are stored once, since every report reads them.
    """
    tables = Tables(files, include_tests, facts_path)
    modes = {"standard", *families} | ({"deep"} if deep else set())
    raw = raw_findings(tables, modes, tool_reports, extra_rules)
    if lost is not None:
        raw = raw.unionByName(text_rules.unreadable(lost))
    found = stored(dedup(with_defaults(translate(raw))), "findings")
    return Audit(tables, modes, found, tool_reports)
