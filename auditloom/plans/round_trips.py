"""Tool reports and API specifications written from table rows, to be read back.

Documents are built per block of consecutive keys, so none of them grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENTS_PER_REPORT = 1000
PARTS_PER_SPEC = 50


def report_key() -> Column:
    return F.concat(F.lit("r"), F.floor(F.col("event_id") / EVENTS_PER_REPORT).cast("string"))


def severity_band() -> Column:
    """Names in mixed case, one of them outside the known five."""
    value = F.col("value")
    return F.when(value < 2, "low").when(value < 5, "Medium").when(value < 20, "HIGH").otherwise("severe")


def report_rows(events: DataFrame, tool: str, returncode: Column, item: Column, wrap: str = "%s") -> DataFrame:
    """One report per block of events, its items in order of event id."""
    listed = events.groupBy(report_key().alias("repo")).agg(
        F.array_sort(F.collect_list(F.struct("event_id", item.alias("item")))).alias("listed")
    )
    items = F.to_json(F.transform("listed", lambda e: e["item"]))
    return listed.select(
        "repo", F.lit(tool).alias("tool"), returncode.cast("int").alias("returncode"),
        F.format_string(wrap, items).alias("output"),
    )


def tool_reports(events: DataFrame) -> DataFrame:
    """tool_report(repo, tool, returncode, output) for five tools."""
    number = F.substring("repo", 2, 20).cast("long")
    file = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".py"))
    row = F.get_json_object("props", "$.k").cast("int")
    lint = F.struct(
        F.col("event_type").alias("code"), F.concat(F.lit("value "), F.col("value").cast("string")).alias("message"),
        file.alias("filename"), F.struct(row.alias("row")).alias("location"),
    )
    security = F.struct(
        severity_band().alias("issue_severity"), F.col("event_type").alias("test_name"),
        F.col("props").alias("issue_text"), file.alias("filename"), row.alias("line_number"),
        F.concat(F.lit("B"), F.col("event_id").cast("string")).alias("test_id"),
    )
    vulnerable = F.struct(
        F.concat(F.lit("pkg"), F.col("user_id").cast("string")).alias("name"),
        F.array(F.struct(
            F.concat(F.lit("V"), F.col("event_id").cast("string")).alias("id"),
            F.repeat("props", F.lit(60)).alias("description"),
        )).alias("vulns"),
    )
    errors = events.filter("event_type = 'error'")
    bare = errors.filter(F.floor(F.col("event_id") / EVENTS_PER_REPORT) % 2 == 0)
    wrapped = errors.filter(F.floor(F.col("event_id") / EVENTS_PER_REPORT) % 2 == 1)
    return (
        report_rows(events, "ruff", F.when(number % 3 == 0, 124).otherwise(1), lint)
        .unionByName(report_rows(events, "bandit", F.lit(1), security, '{"results":%s}'))
        .unionByName(report_rows(bare, "pip-audit", F.lit(1), vulnerable))
        .unionByName(report_rows(wrapped, "pip-audit", F.lit(1), vulnerable, '{"dependencies":%s}'))
        .unionByName(report_rows(errors, "pytest", number % 2, F.col("event_id")))
    )


def spec_block() -> Column:
    return F.floor(F.col("p_partkey") / PARTS_PER_SPEC)


def spec_files(part: DataFrame) -> DataFrame:
    """files-like rows (repo, path, name, size, content) with one specification per group.

    A group is the parts of one brand within a block of keys. By block number the text is
    JSON, YAML or broken; the version is current, old, missing or a bare number; and the
    security schemes are present or not.
    """
    key = F.col("p_partkey").cast("string")
    described = F.col("p_size") % 2 == 1
    no_response = F.col("p_partkey") % 5 == 0
    empty_response = F.col("p_partkey") % 3 == 0
    as_json = F.concat(
        F.lit('"/'), key, F.lit('":{"GET":{'),
        F.when(described, F.concat(F.lit('"description":"part '), key, F.lit('",'))).otherwise(""),
        F.lit('"responses":{'),
        F.when(no_response, '"404":{}').when(empty_response, '"200":{}')
        .otherwise('"200":{"content":{"application/json":{}}}'),
        F.lit("}}}"),
    )
    as_yaml = F.concat(
        F.lit("  /"), key, F.lit(":\n    GET:\n"),
        F.when(described, F.concat(F.lit("      description: part "), key, F.lit("\n"))).otherwise(""),
        F.lit("      responses:\n"),
        F.when(no_response, '        200: {}\n').when(empty_response, "        '200': {}\n")
        .otherwise("        '200': {content: {application/json: {}}}\n"),
    )
    grouped = part.groupBy("p_brand", spec_block().alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("p_partkey", as_json.alias("j"), as_yaml.alias("y")))).alias("urls")
    )
    block = F.col("block")
    version = F.when(block % 7 == 0, "").when(block % 5 == 0, "2.0").when(block % 8 == 3, "3").otherwise("3.0.1")
    quoted = F.when(version == "3", version).otherwise(F.concat(F.lit('"'), version, F.lit('"')))
    head_json = F.when(version == "", "").otherwise(F.concat(F.lit('"openapi":'), quoted, F.lit(",")))
    head_yaml = F.when(version == "", "").otherwise(F.concat(F.lit("openapi: "), quoted, F.lit("\n")))
    secured = block % 2 == 1
    json_text = F.concat(
        F.lit("{"), head_json, F.lit('"paths":{'), F.array_join(F.transform("urls", lambda u: u["j"]), ","),
        F.lit('},"components":{"schemas":{"A":{},"B":{}}'),
        F.when(secured, ',"securitySchemes":{"k":{"type":"apiKey"}}').otherwise(""), F.lit("}}"),
    )
    yaml_text = F.concat(
        head_yaml, F.lit("paths:\n"), F.array_join(F.transform("urls", lambda u: u["y"]), ""),
        F.lit("components:\n  schemas:\n    A: {}\n"),
        F.when(secured, "  securitySchemes:\n    k: {type: apiKey}\n").otherwise(""),
    )
    is_yaml = block % 3 == 1
    content = F.when(block % 11 == 6, "{broken: [").when(is_yaml, yaml_text).otherwise(json_text)
    name = F.concat(
        F.lit("OpenAPI-"), block.cast("string"), F.when(is_yaml, ".yaml").otherwise(".json")
    )
    return grouped.select(
        F.col("p_brand").alias("repo"), F.concat(F.lit("spec/"), name).alias("path"), content.alias("content"),
    ).withColumn("size", F.octet_length("content"))
