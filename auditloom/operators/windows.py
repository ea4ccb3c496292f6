"""Ordered scans of long groups.

A plain window sends a whole group to one task. These scans cut every group into
buckets of its own ordering column first, summarise each bucket, pass the summaries
along the group, and finish inside the buckets. A group holding a third of all rows is
then spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditloom.session import stored


def running_sum(
    df: DataFrame, keys: list[str], order: list[str], delta: Column, bucket: Column, name: str
) -> DataFrame:
    """Add the running sum of ``delta`` within each group.

    ``bucket`` must not decrease along ``order`` within a group.
    """
    marked = df.withColumn("_bucket", bucket).withColumn("_delta", delta)
    totals = marked.groupBy(*keys, "_bucket").agg(F.sum("_delta").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys, "_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_carry")
    )
    inside = (
        Window.partitionBy(*keys, "_bucket").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        marked.join(carried, [*keys, "_bucket"])
        .withColumn(name, F.sum("_delta").over(inside) + F.col("_carry"))
        .drop("_bucket", "_delta", "_carry")
    )


# Rows that one task sorts when groups are ranked.
ROWS_PER_RANGE = 250_000


def group_ranks(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Add the rank of each row in its group, from 0, in the given order; equal rows may swap.

    Rows are dealt over ranges of (group, order), as many as the rows need, and sorted there, once.
    A rank is the place in the range, less that of the group's first row, plus the group's rows in
    earlier ranges, so a group of any size is ranked by as many tasks as it has ranges.
    """
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // ROWS_PER_RANGE)
    sorted_ranges = df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    # The id is the range in the upper bits and the place in the range in the lower 33.
    ranged = stored(sorted_ranges.withColumn("_place", F.monotonically_increasing_id()), "ranks").withColumn(
        "_part", F.shiftright("_place", 33))
    # At most one row for each range that a group has rows in.
    counts = ranged.groupBy(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("_at")).agg(
        F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = Window.partitionBy(*[f"_{k}" for k in keys]).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    same = F.col("_part") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return ranged.join(earlier, same).withColumn(
        name, (F.col("_place") - F.col("_first") + F.col("_before")).cast("long")
    ).drop("_place", "_part", "_at", "_n", "_first", "_before", *[f"_{k}" for k in keys])


def carry_forward(
    df: DataFrame, keys: list[str], order: list[str], value: Column, bucket: Column, name: str,
    include_current: bool = True,
) -> DataFrame:
    """Add the latest non-null ``value`` at or before each row (or strictly before it).

    ``bucket`` must not decrease along ``order`` within a group.
    """
    marked = df.withColumn("_bucket", bucket).withColumn("_value", value)
    totals = marked.groupBy(*keys, "_bucket").agg(
        F.max_by(
            F.when(F.col("_value").isNotNull(), F.struct("_value")),
            F.when(F.col("_value").isNotNull(), F.struct(*order)),
        )["_value"].alias("_total")
    )
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys, "_bucket", F.last("_total", ignorenulls=True).over(before).alias("_carry")
    )
    end = Window.currentRow if include_current else -1
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    return (
        marked.join(carried, [*keys, "_bucket"])
        .withColumn(name, F.coalesce(F.last("_value", ignorenulls=True).over(inside), F.col("_carry")))
        .drop("_bucket", "_value", "_carry")
    )


def earlier_than(
    df: DataFrame, starts: DataFrame, keys: list[str], position: str, start_position: str
) -> DataFrame:
    """Rows of ``df`` that come after the first matching row of ``starts``.

    The existence join on "some earlier start" only needs the earliest start per key, so
    the starts are reduced to one row per key before the join.
    """
    first = starts.groupBy(*keys).agg(F.min(start_position).alias("_start"))
    return df.join(first, keys).filter(F.col("_start") < F.col(position)).drop("_start")
