"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import drop_table, store, write_table


def _mins(edges: DataFrame) -> DataFrame:
    """Edges in both directions, each with the least node next to u or u itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # Stored first: a join of plain tables can split a hub with very many edges.
    least = store(both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")))
    return both.join(least, F.col("u") == F.col("k")).select("u", "v", F.least("u", "m").alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u moves to u's least neighbour."""
    return _mins(edges).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours move to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = store(down.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")))
    moved = down.join(least, F.col("u") == F.col("k"))
    return (
        moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        .unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges(u, v)`` that isn't the least of its component.

    Each round is written to the shared folder and the one before deleted; no node's neighbours
    are gathered in one row, so hubs may have any number of them. The number of rounds is
    logarithmic in practice; the loop ends when a round changes nothing.
    """
    spark = edges.sparkSession
    now = write_table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = None
    while True:
        rows = spark.read.schema("u long, v long").parquet(now)
        # Equal edge sets have equal counts and sums of hashes.
        mark = rows.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last or mark[0] == 0:
            return rows.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = mark
        after = write_table(small_star(large_star(rows)))
        drop_table(spark, now)
        now = after
