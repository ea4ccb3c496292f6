"""Routes, injected dependencies, and the rules over that graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditloom.functions import scopes, text
from auditloom.operators.code_rules import calls, functions
from auditloom.operators.features import is_route_decorator
from auditloom.operators.findings import emit
from auditloom.operators.graph import cycles_per_repo
from auditloom.operators.marks import mark_lines

# Parts of the names of routes that may stay open.
OPEN_ROUTES = ["health", "status", "public", "docs", "openapi"]


def route_functions(facts: DataFrame) -> DataFrame:
    """(repo, path, function, method, line, end_line): one row per route decorator."""
    found = functions(facts).select(
        "repo", "path", F.col("name").alias("function"), F.col("end_lineno").alias("end_line"),
        F.explode(F.filter("items", is_route_decorator)).alias("d"),
    ).filter("d.owner <> ''")
    return found.select(
        "repo", "path", "function", F.upper("d.name").alias("method"), F.col("d.lineno").alias("line"), "end_line"
    )


def routes(facts: DataFrame, lines: DataFrame) -> DataFrame:
    """Routes with ``protected``: a security marker between the decorator and the end.

    The next marker line at or after the decorator decides, found by one ordered scan of
    routes and marker lines per file instead of comparing every route with every marker.
    """
    markers = mark_lines(lines).filter("guard").select(
        "repo", "path", F.col("line_no").alias("at"), F.col("line_no").alias("marker")
    )
    both = route_functions(facts).withColumn("at", F.col("line")).unionByName(markers, allowMissingColumns=True)
    onward = Window.partitionBy("repo", "path").orderBy("at").rangeBetween(0, Window.unboundedFollowing)
    scanned = both.withColumn("next_marker", F.min("marker").over(onward)).filter("function IS NOT NULL")
    return scanned.select(
        "repo", "path", "function", "method", "line",
        F.coalesce(F.col("next_marker") <= F.col("end_line"), F.lit(False)).alias("protected"),
    )


def depends_calls(facts: DataFrame) -> DataFrame:
    """(repo, path, function, dependency) per ``Depends(x)``; unknown parts are null."""
    target = F.try_element_at("items", F.lit(1))
    dependency = F.when(target["kind"] == "Name", target["name"]).when(
        (target["kind"] == "Attribute") & (target["owner"] != ""), F.concat_ws(".", target["owner"], target["name"])
    )
    return calls(facts).filter("name = 'Depends'").select(
        "repo", "path", scopes.nearest_function(F.col("scopes"))["name"].alias("function"),
        dependency.alias("dependency"),
    )


def dep_edges(facts: DataFrame) -> DataFrame:
    """(repo, function, dependency) without repeats."""
    known = depends_calls(facts).filter("function IS NOT NULL AND dependency IS NOT NULL")
    return known.select("repo", "function", "dependency").distinct()


def dep_graph(routes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per function of the dependency graph: routes, and others that only inject.

    ``dependencies`` names, in order, what the function injects.
    """
    degree = edges.groupBy("repo", "function").agg(F.array_sort(F.collect_set("dependency")).alias("dependencies"))
    place = F.struct("path", "line", "method", "protected")
    route_nodes = routes.groupBy("repo", "function").agg(F.min(place).alias("r")).select(
        "repo", "function", F.lit("route").alias("type"), "r.method", F.col("r.path").alias("file"),
        "r.line", "r.protected",
    )
    others = degree.join(route_nodes, ["repo", "function"], "left_anti").select(
        "repo", "function", F.lit("dependency").alias("type")
    )
    nodes = route_nodes.unionByName(others, allowMissingColumns=True)
    return nodes.join(degree, ["repo", "function"], "left").withColumn(
        "dependencies", F.coalesce("dependencies", F.array().cast("array<string>"))
    )


def circular_dependencies(edges: DataFrame) -> DataFrame:
    """One finding per component, naming the step that closes its shortest cycle."""
    graph = edges.select("repo", F.col("function").alias("src"), F.col("dependency").alias("dst"))
    found = cycles_per_repo(graph)
    detail = F.format_string(
        "Circular dependency involving '%s' and '%s'.", F.element_at("cycle", -2), F.element_at("cycle", -1)
    )
    return emit(found, "FASTAPI-CIRCULAR-DEP", detail=detail, file=None)


def unprotected_routes(routes: DataFrame) -> DataFrame:
    exempt = text.contains_any(F.lower("function"), OPEN_ROUTES)
    hits = routes.filter(~F.col("protected") & ~exempt)
    detail = F.format_string(
        "%s route at %s:%d has no detected security mechanism.", F.col("method"), F.col("path"), F.col("line")
    )
    return emit(hits, "FASTAPI-UNPROTECTED-ROUTE", detail=detail, line="line")


def missing_dependencies(facts: DataFrame) -> DataFrame:
    """Plain dependency names that no function of the repository defines."""
    names = dep_edges(facts).filter(F.col("dependency").rlike(r"^[^.]+$")).select(
        "repo", F.col("dependency").alias("name")
    ).distinct()
    defined = functions(facts).select("repo", "name").distinct()
    detail = F.format_string("Dependency '%s' is referenced but not found in the codebase.", F.col("name"))
    return emit(names.join(defined, ["repo", "name"], "left_anti"), "FASTAPI-MISSING-DEP", detail=detail, file=None)


def dep_metrics(routes: DataFrame, facts: DataFrame, cycles: DataFrame) -> DataFrame:
    """(repo, routes_found, dependencies_found, unprotected_routes, dependency_cycles)."""
    names = ["routes_found", "dependencies_found", "unprotected_routes", "dependency_cycles"]
    counted = (
        routes.select("repo", F.lit(names[0]).alias("metric"))
        .unionByName(calls(facts).filter("name = 'Depends'").select("repo", F.lit(names[1]).alias("metric")))
        .unionByName(routes.filter("NOT protected").select("repo", F.lit(names[2]).alias("metric")))
        .unionByName(cycles.select("repo", F.lit(names[3]).alias("metric")))
    )
    return counted.groupBy("repo").agg(*[F.count_if(F.col("metric") == n).alias(n) for n in names])
