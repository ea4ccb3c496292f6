"""Expressions over repository-relative paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditloom.dimensions import PYTHON_EXTENSIONS, SKIP_DIRS, TEXT_EXTENSIONS

# Directories that hold tests.
TEST_DIRS = ["test", "tests", "testing"]


def parts(path: Column) -> Column:
    return F.split(path, "/")


def base_name(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def extension(name: Column) -> Column:
    """Last suffix with its dot; a leading dot alone makes no suffix."""
    return F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)


def is_dotenv(name: Column) -> Column:
    low = F.lower(name)
    return (low == ".env") | low.startswith(".env.")


def is_python(name: Column) -> Column:
    return extension(name).isin(PYTHON_EXTENSIONS)


def is_text(name: Column) -> Column:
    return F.lower(extension(name)).isin(TEXT_EXTENSIONS) | is_dotenv(name)


def is_test(path: Column) -> Column:
    low_name = F.lower(base_name(path))
    return (
        F.arrays_overlap(F.transform(parts(path), F.lower), F.array(*map(F.lit, TEST_DIRS)))
        | low_name.startswith("test_")
        | low_name.endswith("_test.py")
        | (low_name == "conftest.py")
    )


def in_skipped_dir(path: Column, skip_dirs: list[str] = SKIP_DIRS) -> Column:
    """A directory on the way to the file is pruned; the file's own name does not count."""
    directories = F.slice(parts(path), F.lit(1), F.size(parts(path)) - 1)
    return F.arrays_overlap(directories, F.array(*map(F.lit, skip_dirs)))


def relative_to(path: Column, root: str | Column) -> Column:
    """Strip a leading root; a path outside the root is kept as it is."""
    if isinstance(root, str):
        return F.regexp_replace(path, "^" + re.escape(root.rstrip("/")) + "/+", "")
    below = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(path.startswith(below), F.substr(path, F.length(below) + 1)).otherwise(path)


def glob_regex(pattern: str) -> str:
    """Shell pattern as a regular expression; ``**`` crosses directories, ``*`` does not."""
    out = ""
    for token in re.findall(r"\*\*/?|\*|\?|\[[^\]]*\]|.", pattern):
        if token == "**/":
            out += "(?:.*/)?"
        elif token == "**":
            out += ".*"
        elif token == "*":
            out += "[^/]*"
        elif token == "?":
            out += "[^/]"
        elif token.startswith("["):
            out += token.replace("[!", "[^")
        else:
            out += re.escape(token)
    return "^" + out + "$"
