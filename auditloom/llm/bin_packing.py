"""Shards by best-fit-decreasing bin packing of indivisible groups: equal texts stay together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import numbered, store, text_digest

#: Groups of at least 1 / LARGE of a shard are packed one by one: by their size there are at
#: most shards * LARGE of them. All smaller groups are dealt to PARCELS parcels, packed like groups.
LARGE = 2000
PARCELS = 16384


class CapacityTree:
    """Bins in a balanced (AVL) tree by (remaining capacity, bin)."""

    def __init__(self) -> None:
        self.root = None

    def add(self, key: tuple[int, int]) -> None:
        self.root = self._add(self.root, key)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least capacity of ``size`` or more."""
        node, found = self.root, None
        while node:
            if node[0] >= (size, -1):
                found, node = node[0], node[1]
            else:
                node = node[2]
        if found is not None:
            self.root = self._drop(self.root, found)
        return found

    # A node is [key, left, right, height].
    @staticmethod
    def _height(node) -> int:
        return node[3] if node else 0

    def _balanced(self, node):
        lean = self._height(node[1]) - self._height(node[2])
        if lean > 1:
            if self._height(node[1][1]) < self._height(node[1][2]):
                node[1] = self._turn(node[1], 2, 1)
            return self._turn(node, 1, 2)
        if lean < -1:
            if self._height(node[2][2]) < self._height(node[2][1]):
                node[2] = self._turn(node[2], 1, 2)
            return self._turn(node, 2, 1)
        node[3] = 1 + max(self._height(node[1]), self._height(node[2]))
        return node

    def _turn(self, node, up: int, down: int):
        top = node[up]
        node[up], top[down] = top[down], node
        node[3] = 1 + max(self._height(node[1]), self._height(node[2]))
        top[3] = 1 + max(self._height(top[1]), self._height(top[2]))
        return top

    def _add(self, node, key):
        if not node:
            return [key, None, None, 1]
        side = 1 if key < node[0] else 2
        node[side] = self._add(node[side], key)
        return self._balanced(node)

    def _drop(self, node, key):
        if key != node[0]:
            side = 1 if key < node[0] else 2
            node[side] = self._drop(node[side], key)
            return self._balanced(node)
        if not node[1] or not node[2]:
            return node[1] or node[2]
        low = node[2]
        while low[1]:
            low = low[1]
        node[0] = low[0]
        node[2] = self._drop(node[2], low[0])
        return self._balanced(node)


def best_fit(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """The bin of each size, sizes being in descending order; None if more than ``most`` bins are needed."""
    tree, used, out = CapacityTree(), 0, []
    for size in sizes:
        found = tree.take_tightest(size)
        if found is None:
            if size > capacity or used == most:
                return None
            found, used = (capacity, used), used + 1
        tree.add((found[0] - size, found[1]))
        out.append(found[1])
    return out


def smallest_capacity(sizes: list[int], bins: int) -> tuple[int, list[int]]:
    """The least capacity, to one part in 10^5, at which best fit needs no more than ``bins`` bins."""
    low = max(-(-sum(sizes) // bins), sizes[0]) if sizes else 0
    found = best_fit(sizes, low, bins)
    if found is not None:
        return low, found
    step, grain = max(1, low // 100_000), max(1, low // 100_000)
    while (found := best_fit(sizes, low + step, bins)) is None:
        low, step = low + step, step * 2
    high, best = low + step, found
    while high - low > grain:
        middle = (low + high) // 2
        found = best_fit(sizes, middle, bins)
        if found is None:
            low = middle
        else:
            high, best = middle, found
    return high, best


def shard(docs: DataFrame, shards: int = 8, keep: list[str] | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null), columns ``keep``.

    Rows with equal texts go to one shard, unless they are larger than a whole shard: then they
    are split by doc_id. A null text groups with null texts only; its size is 1, its text_crc32
    null. Slots are gapless from 0 in each shard, by hash of doc_id and text; equal rows may
    swap slots. Other columns are not used; an empty table gives an empty table.
    """
    spark, keep = docs.sparkSession, keep or []
    first, second = text_digest("text")
    rows = store(docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32("text").alias("text_crc32"), first.alias("a"), F.when(F.col("text").isNotNull(), second).alias("b"), *keep,
    ))
    total = rows.agg(F.sum("size")).first()[0] or 0
    whole = max(1, -(-total // shards))
    groups = rows.groupBy("a", "b").agg(F.sum("size").alias("size"))
    # Fewer than ``shards`` groups can be larger than a shard.
    giants = groups.where(F.col("size") > whole).withColumn("pieces", F.ceil(F.col("size") / whole).cast("long") * 16)
    giants = [(g["a"], g["b"], g["pieces"]) for g in giants.collect()]
    split = F.broadcast(spark.createDataFrame(giants, "ga long, gb long, pieces long"))
    piece = F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.col("pieces"))).otherwise(F.lit(0))
    keyed = rows.join(split, F.col("a").eqNullSafe(F.col("ga")) & F.col("b").eqNullSafe(F.col("gb")), "left")
    keyed = keyed.withColumn("piece", piece).drop("ga", "gb", "pieces")
    units = store(keyed.groupBy("a", "b", "piece").agg(F.sum("size").alias("size")))
    limit = max(1, whole // LARGE)
    large = units.where(F.col("size") >= limit).collect()
    parcel = F.pmod(F.xxhash64("a", "b", "piece"), F.lit(PARCELS)).cast("int")
    parcels = units.where(F.col("size") < limit).groupBy(parcel.alias("parcel")).agg(F.sum("size").alias("size")).collect()
    items = [(u["size"], (u["a"], u["b"], u["piece"])) for u in large] + [(p["size"], (p["parcel"],)) for p in parcels]
    items.sort(key=lambda x: (-x[0], len(x[1]), tuple((v is None, v or 0) for v in x[1])))
    _, bins = smallest_capacity([s for s, _ in items], shards)
    placed = [(*k, n) for (_, k), n in zip(items, bins, strict=True)]
    # Both tables are bounded by shards * LARGE and PARCELS.
    large_at = F.broadcast(spark.createDataFrame([p for p in placed if len(p) == 4], "la long, lb long, lp long, large_shard int"))
    parcel_at = F.broadcast(spark.createDataFrame([p for p in placed if len(p) == 2], "parcel int, parcel_shard int"))
    same = F.col("a").eqNullSafe(F.col("la")) & F.col("b").eqNullSafe(F.col("lb")) & (F.col("piece") == F.col("lp"))
    dealt = (
        keyed.join(large_at, same, "left").withColumn("parcel", parcel).join(parcel_at, "parcel", "left")
        .withColumn("shard", F.coalesce("large_shard", "parcel_shard"))
    )
    return numbered(dealt, ["shard"], ["doc_id", "a", "b"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), *keep,
    )
