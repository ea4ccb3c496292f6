"""What the corpus operators share: stored tables, row keys, Arrow passes over texts, gapless numbering."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.textarrays import Texts
from auditloom.session import drop_path, scratch_dir

#: Bytes of one Arrow batch sent to Python, and of one slice that numpy works on. A single
#: longer text makes a longer batch: texts are never cut.
BATCH_BYTES = 4 << 20
SLICE_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the folder that spark.checkpoint.dir names, read again.

    The table survives lost executors and, unlike an RDD checkpoint, can be pruned by column.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df))


def write_table(df: DataFrame) -> str:
    """Write ``df`` below the shared folder and return its path."""
    path = f"{scratch_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table that ``write_table`` made."""
    drop_path(spark, path)


def text_digest(text: Column | str) -> list[Column]:
    """Two independent 64-bit hashes of a text: a 128-bit identity, null like the empty text."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return [F.xxhash64(text), F.xxhash64(F.lit(7), text)]


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes, so that long texts don't gather in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text, one row at least."""
    sizes = np.cumsum(Texts.of(batch.column(column)).lengths())
    start = 0
    while start < batch.num_rows:
        done = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, done + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def add_columns(
    df: DataFrame, fields: list[T.StructField], make: Callable[[Texts], list], text: str = "text",
) -> DataFrame:
    """``df`` with columns that ``make`` computes from the text of each row, in one Arrow pass.

    Columns of ``df`` with the new names must be dropped or renamed before.
    """
    small_batches(df.sparkSession)
    schema = T.StructType([*df.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                made = [pa.array(x) for x in make(Texts.of(part.column(text)))]
                names = [*part.schema.names, *(f.name for f in fields)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names)

    return df.mapInArrow(run, schema)


def numbered(df: DataFrame, within: list[str], order: list[str], name: str, buckets: int = 64) -> DataFrame:
    """Gapless numbers from 0 in each ``within`` group, without a task that holds a whole group.

    Rows are dealt to hash buckets of ``order``; a row's number is its rank in its bucket plus
    the rows of the group's earlier buckets. Equal rows may swap numbers.
    """
    bucket, rank, before = "__bucket", "__rank", "__before"
    dealt = df.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = dealt.groupBy(*within, bucket).agg(F.count("*").alias("__n"))
    # The bucket table has at most ``buckets`` rows a group.
    earlier = Window.partitionBy(*within).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(before, F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    ranked = dealt.withColumn(rank, F.row_number().over(Window.partitionBy(*within, bucket).orderBy(*order)))
    keys = [*within, bucket]
    counts = counts.select(*[F.col(k).alias(f"__c{i}") for i, k in enumerate(keys)], before)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & ranked[k].eqNullSafe(counts[f"__c{i}"])
    return (
        ranked.join(counts, same)
        .withColumn(name, (F.col(rank) - 1 + F.col(before)).cast("long"))
        .drop(bucket, rank, before, *[f"__c{i}" for i in range(len(keys))])
    )


def ranked_globally(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Gapless ranks from 0 over the whole table, by range partitions instead of one sorted task."""
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = store(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    # One row for each range partition.
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return (
        dealt.withColumn("__rank", within).join(counts, "__part")
        .withColumn(name, (F.col("__rank") - 1 + F.col("__before")).cast("long")).drop("__part", "__rank", "__before")
    )
