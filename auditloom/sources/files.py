"""The `files` table: one row per file of every repository."""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator
from functools import partial, reduce
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.dimensions import SKIP_DIRS, SPEC_NAMES
from auditloom.functions import paths
from auditloom.functions.text import contains_any
from auditloom.schemas import carried
from auditloom.session import cut_counting

# Executors get the functions of this module with the task, so nothing is installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BYTES_PER_PARTITION = 128_000_000
BYTES_PER_BATCH = 32_000_000
ROWS_PER_BATCH = 10_000


class Scan(NamedTuple):
    """A scanned tree: its `files`, and (repo, path, reason) of the folders and files that could not be read."""

    files: DataFrame
    lost: DataFrame


def scan_files(
    spark: SparkSession, base: str, repo: str | None = None, skip_dirs: list[str] = SKIP_DIRS,
) -> DataFrame:
    """Read a directory tree as `files`; ``scan`` also tells what could not be read."""
    return scan(spark, base, repo, skip_dirs).files


def scan(
    spark: SparkSession, base: str, repo: str | None = None, skip_dirs: list[str] = SKIP_DIRS,
) -> Scan:
    """Read a directory tree.

    With ``repo`` the whole tree is one repository; without it every first-level
    directory below ``base`` is one. The built-in file sources hide names that start with
    a dot or an underscore, which an audit must see, so the tree is listed by a job of its
    own. Contents are read only of files some rule reads; every other file costs a
    directory entry. A folder or file that may not be read, or goes during the scan, is a row
    of ``lost``; a file's content is empty then. Any other error fails the task, which Spark tries
    again.
    """
    entry = list_tree(spark, base, skip_dirs, keep_first=repo is None).withColumnRenamed("path", "inside")
    if repo is None:
        # A folder of the first level is a repository itself.
        inner = F.contains("inside", F.lit("/"))
        located = entry.filter(inner | (F.col("reason").isNotNull() & (F.col("inside") != ""))).select(
            F.regexp_extract("inside", "^([^/]+)", 1).alias("repo"),
            F.when(inner, F.regexp_replace("inside", "^[^/]+/", "")).otherwise("").alias("path"), "inside", "size", "reason",
        )
    else:
        located = entry.select(F.lit(repo).alias("repo"), F.col("inside").alias("path"), "inside", "size", "reason")
    closed = located.filter("reason IS NOT NULL").select("repo", "path", "reason")
    located = located.filter("reason IS NULL").drop("reason")
    name = paths.base_name(F.col("path"))
    read = paths.is_text(name) | (F.lower(name) == "dockerfile") | contains_any(F.lower(name), SPEC_NAMES)
    total = located.agg(F.sum(F.when(read, F.col("size"))).alias("n")).head()["n"] or 0
    partitions = max(spark.sparkContext.defaultParallelism, total // BYTES_PER_PARTITION)
    readable = located.withColumn("wanted", read).repartition(int(partitions))
    raw = readable.mapInArrow(partial(read_contents, base), "repo string, path string, size long, content binary")
    tried = readable.filter("wanted").mapInArrow(partial(try_open, base), "repo string, path string, reason string")
    return Scan(describe(raw.withColumn("content", as_text(F.col("content")))), closed.unionByName(tried))


def list_tree(
    spark: SparkSession, base: str, skip_dirs: list[str] = SKIP_DIRS, keep_first: bool = False,
) -> DataFrame:
    """(path, size, reason) of every file below ``base``, pruned directories left out.

    ``reason`` is null but for directories that could not be listed.

    ``keep_first`` never prunes the first level, whose names are those of repositories.

    The tree is listed level by level; the directories of a level are spread over all
    tasks, so neither the driver nor one task walks a large repository.
    """
    tasks = spark.sparkContext.defaultParallelism
    level = spark.createDataFrame([("",)], "path string")
    found = []
    n_dirs = 1
    while n_dirs:
        listed = level.repartition(min(tasks, n_dirs)).mapInArrow(
            partial(list_directories, base), "path string, size long, is_dir boolean, reason string"
        )
        kept = listed
        if found or not keep_first:
            kept = listed.filter(~(F.col("is_dir") & paths.base_name(F.col("path")).isin(skip_dirs)))
        kept, n_dirs = cut_counting(kept, F.col("is_dir"))
        found.append(kept.filter("NOT is_dir").select("path", "size", "reason"))
        level = kept.filter("is_dir").select("path")
    return reduce(lambda a, b: a.unionByName(b), found)


def list_directories(base: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One level below each directory; links to directories are not followed, and a directory
    that may not be read or has gone is a row with the reason. Other errors fail the task, so that Spark tries it again."""
    system, root = pa_fs.FileSystem.from_uri(base)
    is_local = isinstance(system, pa_fs.LocalFileSystem)
    for batch in batches:
        for inside in batch.column(0).to_pylist():
            rows = []
            try:
                infos = system.get_file_info(pa_fs.FileSelector(f"{root}/{inside}"))
            except (PermissionError, FileNotFoundError) as error:
                infos = []
                rows.append((inside, 0, False, type(error).__name__))
            for info in infos:
                is_dir = info.type == pa_fs.FileType.Directory
                if not (is_dir and is_local and os.path.islink(info.path)):
                    rows.append((f"{inside}/{info.base_name}".lstrip("/"), info.size or 0, is_dir, None))
            columns = list(zip(*rows)) or [(), (), (), ()]
            types = (pa.string(), pa.int64(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["path", "size", "is_dir", "reason"]
            )


def try_open(base: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(repo, path, reason) of files that cannot be opened; nothing is read of the others."""
    system, root = pa_fs.FileSystem.from_uri(base)
    for batch in batches:
        lost = []
        for row in batch.to_pylist():
            try:
                system.open_input_stream(f"{root}/{row['inside']}").close()
            except (PermissionError, FileNotFoundError) as error:
                lost.append((row["repo"], row["path"], type(error).__name__))
        columns = list(zip(*lost)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["repo", "path", "reason"])


def read_contents(base: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents of wanted files, in batches of bounded size; files that may not be read or have gone
    are empty. Other errors fail the task, so that Spark tries it again."""
    system, root = pa_fs.FileSystem.from_uri(base)
    names = ["repo", "path", "size", "content"]
    types = (pa.string(), pa.string(), pa.int64(), pa.binary())
    rows, held = [], 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    for batch in batches:
        for row in batch.to_pylist():
            content = b""
            if row["wanted"]:
                try:
                    with system.open_input_stream(f"{root}/{row['inside']}") as stream:
                        content = stream.read()
                except (PermissionError, FileNotFoundError):
                    content = b""
            rows.append((row["repo"], row["path"], row["size"], content))
            held += len(content)
            if held >= BYTES_PER_BATCH or len(rows) >= ROWS_PER_BATCH:
                yield flush()
                rows, held = [], 0
    if rows:
        yield flush()


def as_text(raw: Column) -> Column:
    """Bytes to text: bad UTF-8 is replaced, and every newline style becomes one."""
    return F.regexp_replace(F.make_valid_utf8(raw.cast("string")), r"\r\n?", "\n")


def describe(files: DataFrame) -> DataFrame:
    """Add the path-derived columns to (repo, path, size, content)."""
    name = paths.base_name(F.col("path"))
    return files.select(
        "repo",
        "path",
        name.alias("name"),
        paths.extension(name).alias("ext"),
        F.col("size").cast("long").alias("size"),
        "content",
        paths.is_python(name).alias("is_py"),
        paths.is_text(name).alias("is_text"),
        paths.is_dotenv(name).alias("is_dotenv"),
        paths.is_test(F.col("path")).alias("is_test"),
        *carried(files),
    )


def files_from_table(table: DataFrame, repo: Column, path: Column, content: Column) -> DataFrame:
    """Any table with a text column, seen as files."""
    columns = table.select(repo.alias("repo"), path.alias("path"), content.alias("content"))
    return describe(columns.withColumn("size", F.octet_length("content")))


def read_text(files: DataFrame, limit: int) -> DataFrame:
    """Blank the content of files above a limit the caller chooses, so no rule sees it."""
    return files.withColumn("content", F.when(F.col("size") <= limit, F.col("content")).otherwise(""))


def select_python(files: DataFrame) -> DataFrame:
    return files.filter("is_py")


def select_text(files: DataFrame) -> DataFrame:
    return files.filter("is_text")


def heuristic_scope(files: DataFrame, include_tests: bool = False) -> DataFrame:
    """Files the heuristic rules look at: tests only on request."""
    return files if include_tests else files.filter(~F.col("is_test"))


def exclude(files: DataFrame, prefixes: list[str] = (), patterns: list[str] = ()) -> DataFrame:
    """Drop files below any of the path prefixes or matching any of the globs."""
    path = F.col("path")
    tests = [(path == p.rstrip("/")) | path.startswith(p.rstrip("/") + "/") for p in prefixes]
    tests += [path.rlike(paths.glob_regex(p)) for p in patterns]
    if not tests:
        return files
    return files.filter(~reduce(lambda a, b: a | b, tests))


def include(files: DataFrame, prefixes: list[str] = (), patterns: list[str] = ()) -> DataFrame:
    """Keep only files below one of the prefixes or matching one of the globs."""
    path = F.col("path")
    tests = [(path == p.rstrip("/")) | path.startswith(p.rstrip("/") + "/") for p in prefixes]
    tests += [path.rlike(paths.glob_regex(p)) for p in patterns]
    return files.filter(reduce(lambda a, b: a | b, tests)) if tests else files
