"""API specifications: selecting the files and reading JSON or YAML as VARIANT."""

from __future__ import annotations

import json
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.dimensions import SPEC_NAMES
from auditloom.functions.text import contains_any
from auditloom.session import spread, stored

# Executors get the functions of this module with the task, so nothing is installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Keys that are not strings in YAML keep a mark, so that no rule takes 200 for "200".
TYPED_KEY = "!"

#: A text that aliases expand beyond so many nodes and so many times what it wrote is invalid: ten
#: aliases of ten aliases, nine levels deep, would fill any worker from a few hundred bytes.
MANY_NODES, MOST_REPEATS = 1_000_000, 100


def select_specs(files: DataFrame) -> DataFrame:
    return files.filter(contains_any(F.lower("name"), SPEC_NAMES))


def parse_specs(files: DataFrame) -> DataFrame:
    """(repo, path, name, spec, parsed): ``spec`` is null where neither format fits.

    JSON is parsed by Spark. Only texts that are not JSON go through the YAML reader,
    a vectorised function that returns JSON text; one that aliases expand a hundredfold counts as
    unreadable. Empty files drop out.
    """
    readable = select_specs(files).filter(F.col("content") != "")
    tried = spread(readable.select("repo", "path", "name", "content")).withColumn("as_json", F.try_parse_json("content"))
    from_yaml = F.try_parse_json(yaml_to_json()(F.when(F.col("as_json").isNull(), F.col("content"))))
    spec = F.coalesce("as_json", from_yaml)
    return tried.withColumn("spec", spec).select(
        "repo", "path", "name", "spec", F.col("spec").isNotNull().alias("parsed")
    )


def yaml_to_json():
    """A pandas function from YAML text to JSON text; null for null or for bad YAML."""

    @F.pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        return texts.map(convert_one, na_action="ignore")

    # Filters of the rules must not be copied below the parse, which would run it twice.
    return convert.asNondeterministic()


def store_specs(specs: DataFrame) -> DataFrame:
    """Parsed specifications as a table in the shared folder: every rule reads the one parse."""
    return stored(specs, "specs")


def convert_one(text: str) -> str | None:
    import yaml  # a worker without it must fail, not call every YAML file invalid

    try:
        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
        value = yaml.load(text, loader)
        written, whole = measure(value)
        if whole > max(MANY_NODES, MOST_REPEATS * written):
            return None
        return json.dumps(string_keys(value), default=str)
    except (yaml.YAMLError, RecursionError, ValueError):
        return None


def measure(value) -> tuple[int, int]:
    """Nodes that a YAML text wrote, and nodes it has once every alias is its own copy.

    Aliases share their container, so each is counted once and its size looked up afterwards:
    the work grows with the text, not with what it expands to. A container within itself has
    no end and counts as a ValueError.
    """
    sizes: dict[int, int | None] = {}
    written = 0

    def size(node) -> int:
        nonlocal written
        if not isinstance(node, dict | list):
            written += 1
            return 1
        if id(node) in sizes:
            if sizes[id(node)] is None:
                raise ValueError("an alias of its own container")
            return sizes[id(node)]
        sizes[id(node)] = None
        written += 1
        total = 1 + sum(map(size, node.values() if isinstance(node, dict) else node))
        sizes[id(node)] = total
        return total

    whole = size(value)
    return written, whole


def string_keys(value):
    if isinstance(value, dict):
        return {k if isinstance(k, str) else f"{TYPED_KEY}{k}": string_keys(v) for k, v in value.items()}
    if isinstance(value, list):
        return [string_keys(v) for v in value]
    return value


def endpoints(specs: DataFrame) -> DataFrame:
    """(repo, path, url, method, details): one row per documented path and method."""
    # The methods that count.
    methods = ["get", "post", "put", "patch", "delete", "options", "head"]
    exploded = specs.sparkSession.sql(
        """
        SELECT s.repo, s.path, u.key AS url, lower(m.key) AS method, m.value AS details
        FROM {specs} s,
             LATERAL variant_explode(try_variant_get(s.spec, '$.paths', 'variant')) u,
             LATERAL variant_explode(u.value) m
        """,
        specs=specs,
    )
    return exploded.filter(F.col("method").isin(methods))
