"""Context of a syntax node, read off its chain of enclosing scopes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOOPS = ["For", "While"]
FUNCTIONS = ["FunctionDef", "AsyncFunctionDef"]


def loop_depth(scopes: Column) -> Column:
    """How many `for`/`while` statements surround the node, across function borders."""
    return F.size(F.filter(scopes, lambda s: s["kind"].isin(LOOPS)))


def in_async(scopes: Column) -> Column:
    """Some ancestor is an async function, even with a plain function in between."""
    return F.exists(scopes, lambda s: s["kind"] == "AsyncFunctionDef")


def nearest_function(scopes: Column) -> Column:
    """Innermost enclosing function as a struct, null at module level. Classes do not count."""
    return F.try_element_at(F.filter(scopes, lambda s: s["kind"].isin(FUNCTIONS)), F.lit(-1))


def for_bodies(scopes: Column) -> Column:
    """`pre` of every `for` loop whose body holds the node."""
    inside = F.filter(scopes, lambda s: (s["kind"] == "For") & (s["field"] == "body"))
    return F.transform(inside, lambda s: s["pre"])
