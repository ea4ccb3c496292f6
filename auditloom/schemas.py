"""Fixed schemas of the tables that rules read and write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

FINDING_COLUMNS = [
    "repo", "severity", "category", "title", "detail", "file", "line",
    "recommendation", "source", "rule_id", "confidence",
]

FINDINGS = T.StructType(
    [T.StructField(c, T.IntegerType() if c == "line" else T.StringType()) for c in FINDING_COLUMNS]
)

# Two findings are the same when these agree; nulls count as equal.
DEDUP_KEY = ["repo", "severity", "category", "title", "file", "line", "detail", "rule_id"]

# Columns that files may bring along and findings keep: the arrival time in a stream, the digest of a version.
CARRIED = ["arrived", "digest"]


def carried(rows: DataFrame) -> list[str]:
    return [c for c in CARRIED if c in rows.columns]


SCOPE = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("pre", T.IntegerType()),
    T.StructField("field", T.StringType()),
    T.StructField("name", T.StringType()),
])

ITEM = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("owner", T.StringType()),
    T.StructField("op", T.StringType()),
    T.StructField("lineno", T.IntegerType()),
    T.StructField("text", T.StringType()),
])

PARAM = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("annotated", T.BooleanType()),
])

VALUE = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("value", T.StringType()),
])

KWARG = T.StructType([
    T.StructField("kw", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("elts", T.ArrayType(VALUE)),
])

# One row per syntax node. `pre`/`last` is the nested-set interval in visiting order, so
# "x lies inside y" is y.pre < x.pre <= y.last. `scopes` lists the enclosing loops,
# functions and classes from the outside in, with the field the node was reached through.
FACTS = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("pre", T.IntegerType()),
    T.StructField("last", T.IntegerType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("parent", T.IntegerType()),
    T.StructField("parent_kind", T.StringType()),
    T.StructField("parent_name", T.StringType()),
    T.StructField("parent_lineno", T.IntegerType()),
    T.StructField("field", T.StringType()),
    T.StructField("idx", T.IntegerType()),
    T.StructField("kind", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("owner", T.StringType()),
    T.StructField("lineno", T.IntegerType()),
    T.StructField("end_lineno", T.IntegerType()),
    T.StructField("value_kind", T.StringType()),
    T.StructField("value_name", T.StringType()),
    T.StructField("str_len", T.IntegerType()),
    T.StructField("n_elts", T.IntegerType()),
    T.StructField("n_generators", T.IntegerType()),
    T.StructField("op", T.StringType()),
    T.StructField("left_len", T.IntegerType()),
    T.StructField("right_len", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("items", T.ArrayType(ITEM)),
    T.StructField("params", T.ArrayType(PARAM)),
    T.StructField("kwargs", T.ArrayType(KWARG)),
    T.StructField("arg_names", T.ArrayType(T.StringType())),
    T.StructField("modules", T.ArrayType(T.StringType())),
    T.StructField("scopes", T.ArrayType(SCOPE)),
])
