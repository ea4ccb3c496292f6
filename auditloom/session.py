"""Session settings and the few places that need to know about the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "auditloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # Plans are built from many small expressions; do not record a stack for each.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session, where driver and executors share one disk, may fall back to a
    temporary folder.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="auditloom-"))
    return context.getCheckpointDir()


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; Hadoop deletes it when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/auditloom-{spark.sparkContext.applicationId}"
    if path not in _to_delete:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(where)
        files.deleteOnExit(where)
        _to_delete.add(path)
    return path


_to_delete: set[str] = set()


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, which readers can prune by column."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget how it was computed."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


#: Steps of a loop that joins its own last result, after which the result becomes a table.
RESIZE_EVERY = 6


def cut_round(df: DataFrame, step: int) -> DataFrame:
    """``cut`` for the given step of a loop in which a result is joined with itself.

    A checkpoint keeps the size that was estimated for its plan, and such a join squares it: after
    some twenty steps the estimate has millions of digits, and planning takes longer than the work.
    A table's size is that of its files, so now and then a step is written as one.
    """
    return stored(df, "round") if step % RESIZE_EVERY == RESIZE_EVERY - 1 else cut(df)


def forget(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` or ``stored`` that nothing reads any more."""
    for table in tables:
        if getattr(table, "stored_at", None):
            drop_path(table.sparkSession, table.stored_at)


def cut_counting(df: DataFrame, counted: Column, step: int = RESIZE_EVERY - 1) -> tuple[DataFrame, int]:
    """``cut_round``, a table unless ``step`` says otherwise, and the number of rows for which ``counted`` holds."""
    seen = Observation()
    table = cut_round(df.observe(seen, F.count_if(counted).alias("n")), step)
    return table, seen.get["n"]


#: Session setting: partitions to deal CPU-heavy scans over; unset, a scan keeps its splits.
SPREAD = "spark.auditloom.partitions"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows over as many partitions as the session's SPREAD setting says, if it is set.

    For small tables in few splits on a machine with many cores. A cluster leaves the
    setting alone and bounds its splits by spark.sql.files.maxPartitionBytes.
    """
    wanted = df.sparkSession.conf.get(SPREAD, None)
    return df.repartition(int(wanted), *keys) if wanted else df
