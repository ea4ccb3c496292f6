"""Repository features, gates and inventory metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.dimensions import LARGE_FILE
from auditloom.operators.marks import mark_files

# Lower-cased file names that set a flag.
FLAG_NAMES = {
    "alembic": ["alembic.ini"],
    "docker": ["dockerfile", "docker-compose.yml", "compose.yml"],
}

FEATURES = [
    "fastapi", "pydantic", "sqlalchemy", "alembic", "jwt", "oauth2", "rbac", "cors", "redis",
    "celery", "docker", "kubernetes", "pytest", "postgresql", "graphql", "openapi",
]

# Decorator attributes that make a function a route.
ROUTE_METHODS = ["get", "post", "put", "patch", "delete", "options", "head", "websocket"]


def detect_stack(files: DataFrame) -> DataFrame:
    """(repo, 16 booleans): one pass over the files, merged per repository.

    Flags are or-ed in each task before the shuffle, so one row per repository and task
    travels, however many files a repository has.
    """
    low_name = F.lower("name")
    tests = {f: F.col(f"flags.{f}") for f in FEATURES if f != "docker"}
    tests["alembic"] = tests["alembic"] | low_name.isin(FLAG_NAMES["alembic"])
    tests["docker"] = low_name.isin(FLAG_NAMES["docker"])
    tests["kubernetes"] = tests["kubernetes"] & F.col("ext").isin(".yaml", ".yml")
    tests["pytest"] = tests["pytest"] | (F.col("is_py") & F.contains(low_name, F.lit("test")))
    tests["openapi"] = tests["openapi"] | F.contains(low_name, F.lit("openapi"))
    marked = mark_files(files)
    return marked.groupBy("repo").agg(*[F.bool_or(tests[f]).alias(f) for f in FEATURES])


def has_sql(files: DataFrame) -> DataFrame:
    """(repo, has_sql): some Python file holds one of the statement words."""
    return mark_files(files).groupBy("repo").agg(F.bool_or("sql_words").alias("has_sql"))


def gate(rows: DataFrame, features: DataFrame, predicate: Column) -> DataFrame:
    """Keep rows of repositories whose features satisfy the predicate."""
    return rows.join(features.filter(predicate).select("repo"), "repo", "left_semi")


def repo_metrics(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Inventory counts per repository."""
    from_files = files.groupBy("repo").agg(
        F.count_if("is_py").alias("python_files"),
        F.count("*").alias("files_scanned"),
        F.count_if("is_dotenv").alias("env_files"),
        F.count_if(F.col("size") > LARGE_FILE).alias("large_files"),
    )
    is_function = F.col("kind").isin("FunctionDef", "AsyncFunctionDef")
    routes = F.size(F.filter("items", is_route_decorator))
    from_facts = facts.groupBy("repo").agg(
        F.count_if(F.col("kind") == "SyntaxError").alias("syntax_errors"),
        F.count_if(is_function).alias("functions"),
        F.count_if(F.col("kind") == "ClassDef").alias("classes"),
        F.sum(F.when(is_function, routes).otherwise(0)).alias("routes"),
        F.count_if(F.col("kind") == "AsyncFunctionDef").alias("async_functions"),
    )
    counts = ["syntax_errors", "functions", "classes", "routes", "async_functions"]
    joined = from_files.join(from_facts, "repo", "left")
    return joined.select(
        "repo", "python_files", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("routes", F.lit(0)).cast("long").alias("decorated_routes"),
        "files_scanned", "env_files", "large_files",
    )


def is_route_decorator(entry: Column) -> Column:
    """A decorator of the form ``x.get(...)``."""
    return (
        (entry["role"] == "decorator") & (entry["kind"] == "Call")
        & entry["owner"].isNotNull() & entry["name"].isin(ROUTE_METHODS)
    )
