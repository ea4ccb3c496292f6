"""Incremental audit: changed files arrive as a stream, with the time of arrival.

The line and text rules have no state, so they run on the stream as they run on a table.
A finding repeated within a window is reported once, and windows are counted when the
watermark passes their end. Where files arrive again and again, ``Versions`` scans every
version once, however often it arrives; arrivals are then joined with findings, not with texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.operators import text_rules
from auditloom.schemas import DEDUP_KEY, FINDING_COLUMNS, FINDINGS


def once_per_window(rows: DataFrame, window: str, *key: str | Column) -> DataFrame:
    """Drop rows whose key was already seen in the same window.

    State is one digest per key; it expires with the watermark.
    """
    start = F.window("arrived", window)["start"]
    digest = F.sha2(F.to_json(F.struct(start.alias("start"), *key)), 256)
    return rows.withColumn("_seen", digest).dropDuplicatesWithinWatermark(["_seen"]).drop("_seen")


def stream_audit(arriving: DataFrame, window: str = "1 hour", lateness: str | None = "2 hours") -> DataFrame:
    """(window_start, repo, severity, n) over a stream of files with an ``arrived`` time.

    Every arrival is scanned where it is read, which needs no state; only findings, never
    texts, pass through the stateful shuffles. A finding that several versions of a file
    share, or that an unchanged file repeats, is counted once per window.

    ``lateness`` None means that the stream has its watermark. It must not be shorter than ``window``: then a repeat within a window always
    falls inside the span the deduplication remembers, and the counts do not depend on
    how the stream was cut into batches.
    """
    timed = arriving if lateness is None else arriving.withWatermark("arrived", lateness)
    return window_counts(text_rules.text_findings(timed), window)


def window_counts(found: DataFrame, window: str) -> DataFrame:
    """(window_start, repo, severity, n) of findings that carry their arrival and a watermark."""
    once = once_per_window(found, window, *DEDUP_KEY)
    counts = once.groupBy(F.window("arrived", window).alias("window"), "repo", "severity").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), "repo", "severity", "n")


VERSION = ["repo", "path", "digest"]
VERSIONS = "repo string, path string, digest string, arrived timestamp, batch long"


class Versions:
    """Versions of files in a folder: when each arrived, and its findings from a single scan.

    A batch is written under its own number, and written anew if the stream runs it again, so a
    lost driver or executor leaves no version half done and none twice. A folder holds
    ``arrivals/batch=N`` (the latest arrival of each version) and ``findings/batch=N``.
    """

    def __init__(self, spark: SparkSession, place: str):
        self.spark, self.place = spark, place

    def arrivals(self) -> DataFrame:
        return self._read("arrivals", VERSIONS)

    def findings(self) -> DataFrame:
        """(digest, and the columns of findings) of all versions."""
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in FINDINGS.fields)
        return self._read("findings", f"digest string, {columns}, batch long").drop("batch")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.place}/{name}"
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", path).parquet(path)

    def add(self, arrived: DataFrame, contents: Callable[[DataFrame], DataFrame], batch: int) -> None:
        """Record ``arrived(repo, path, digest, arrived)`` and scan the versions that are new.

        ``contents`` turns new (repo, path, digest) into files; it is asked for those alone.
        """
        latest = arrived.groupBy(*VERSION).agg(F.max("arrived").alias("arrived"))
        latest.write.mode("overwrite").parquet(f"{self.place}/arrivals/batch={batch}")
        mine = self.arrivals()
        known = mine.filter(F.col("batch") != batch).select(*VERSION)
        fresh = mine.filter(F.col("batch") == batch).select(*VERSION).join(known, VERSION, "left_anti")
        found = text_rules.text_findings(contents(fresh)).select("digest", *FINDING_COLUMNS)
        found.write.mode("overwrite").parquet(f"{self.place}/findings/batch={batch}")

    def open_findings(self) -> DataFrame:
        """Findings of the version that each file arrived with last; a replaced version's are gone.

        Of versions that arrived at the same time the greater digest counts.
        """
        last = self.arrivals().groupBy("repo", F.col("path").alias("file")).agg(F.max(F.struct("arrived", "digest")).alias("last"))
        return last.select("repo", "file", F.col("last.digest").alias("digest")).join(self.findings(), ["repo", "file", "digest"]).drop("digest")


def run_versions(arriving: DataFrame, versions: Versions, contents: Callable[[DataFrame], DataFrame], checkpoint: str) -> None:
    """Take in everything that has arrived on a stream of (repo, path, digest, arrived), and stop."""
    query = (
        arriving.writeStream.foreachBatch(lambda rows, batch: versions.add(rows, contents, batch))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_available(counts: DataFrame, output: str, checkpoint: str) -> None:
    """Process everything that has arrived, append the closed windows to ``output`` and stop."""
    query = (
        counts.writeStream.format("parquet").outputMode("append")
        .option("path", output).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
