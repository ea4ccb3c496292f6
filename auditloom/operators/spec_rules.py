"""Rules over parsed API specifications (``parse_specs``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.operators.findings import emit_by_rule, emit_hits, hit
from auditloom.sources.specs import endpoints


def part(path: str, type_name: str = "variant") -> Column:
    return F.try_variant_get("spec", path, type_name)


def size_of(path: str) -> Column:
    """Number of entries of an object inside the specification, 0 when it is missing."""
    return F.coalesce(F.size(F.map_keys(part(path, "map<string,variant>"))), F.lit(0))


def is_object() -> Column:
    return F.schema_of_variant("spec").startswith("OBJECT")


def version_is_text() -> Column:
    """The version is missing or a string; a number such as 3.0 is neither."""
    kind = F.schema_of_variant(part("$.openapi"))
    return kind.isNull() | (kind == "STRING")


def usable(specs: DataFrame) -> DataFrame:
    return specs.filter("parsed").filter(is_object() & version_is_text())


def document_rules(specs: DataFrame) -> DataFrame:
    """Rules on a whole specification, in one pass: format, shape, version, security."""
    reason = F.when(is_object(), "the version is not a string").otherwise("the document is not an object")
    version = F.coalesce(part("$.openapi", "string"), F.lit(""))
    sound = is_object() & version_is_text()
    checked = F.array(
        F.when(~version.startswith("3."), hit(
            "OPENAPI-OUTDATED-VERSION", detail=F.format_string("OpenAPI version %s may be outdated.", version))),
        F.when(size_of("$.components.securitySchemes") == 0, hit("OPENAPI-NO-SECURITY")),
    )
    unreadable = F.array(hit(
        "OPENAPI-INVALID-FORMAT", detail=F.format_string("Could not parse %s as JSON or YAML.", F.col("name"))))
    unusable = F.array(hit(
        "OPENAPI-ANALYSIS-ERROR", detail=F.format_string("Error analyzing %s: %s", F.col("name"), reason)))
    return emit_hits(specs, F.when(~F.col("parsed"), unreadable).when(~sound, unusable).otherwise(checked))


def spec_findings(specs: DataFrame) -> DataFrame:
    return document_rules(specs).unionByName(endpoint_rules(specs))


def endpoint_rules(specs: DataFrame) -> DataFrame:
    """Missing descriptions and missing response schemas, from one explode."""
    description = F.try_variant_get("details", "$.description", "string")
    ok = F.try_variant_get("details", "$.responses['200']", "variant")
    content = F.try_variant_get("details", "$.responses['200'].content", "map<string,variant>")
    broken = F.array(
        F.when(F.coalesce(description, F.lit("")) == "", F.lit("OPENAPI-MISSING-DESCRIPTION")),
        F.when(ok.isNotNull() & (F.coalesce(F.size(F.map_keys(content)), F.lit(0)) == 0), F.lit("OPENAPI-MISSING-RESPONSE")),
    )
    hits = endpoints(usable(specs)).select(
        "repo", "path", "url", "method", F.explode(F.filter(broken, lambda r: r.isNotNull())).alias("rule")
    )
    name = F.concat_ws(" ", F.upper("method"), "url")
    details = {
        "OPENAPI-MISSING-DESCRIPTION": F.concat(name, F.lit(" is missing a description.")),
        "OPENAPI-MISSING-RESPONSE": F.concat(name, F.lit(" 200 response is missing content schema.")),
    }
    return emit_by_rule(hits, "rule", details, line=None)


def spec_metrics(specs: DataFrame) -> DataFrame:
    """(repo, files, schemas, endpoints, missing descriptions, schemes)."""
    none = F.lit(0)
    description = F.try_variant_get("details", "$.description", "string")
    per_file = usable(specs).select(
        "repo", size_of("$.components.schemas").alias("schemas"), none.alias("endpoints"), none.alias("missing"),
        size_of("$.components.securitySchemes").alias("schemes"),
    )
    per_endpoint = endpoints(usable(specs)).select(
        "repo", none.alias("schemas"), F.lit(1).alias("endpoints"),
        F.when(F.coalesce(description, F.lit("")) == "", 1).otherwise(0).alias("missing"), none.alias("schemes"),
    )
    files = specs.groupBy("repo").agg(F.count("*").alias("openapi_files_found"))
    sums = per_file.unionByName(per_endpoint).groupBy("repo").agg(
        F.sum("schemas").alias("schemas_found"), F.sum("endpoints").alias("endpoints_documented"),
        F.sum("missing").alias("missing_descriptions"), F.sum("schemes").alias("security_schemes"),
    )
    names = ["schemas_found", "endpoints_documented", "missing_descriptions", "security_schemes"]
    return files.join(sums, "repo", "left").select(
        "repo", "openapi_files_found", *[F.coalesce(n, F.lit(0)).alias(n) for n in names]
    )
