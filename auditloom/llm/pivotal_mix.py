"""Mixing sources to target weights: pivotal rounding in leaves, residuals combined through a reduction tree."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.common import ranked_globally, small_batches, store, text_digest
from auditloom.llm.textarrays import mix as mix64

#: Mass is counted in 1 / UNIT words, so that sums are exact.
UNIT = 1 << 20
#: Rows a leaf has on average, and groups whose open rows meet in one group of the next level.
LEAF_ROWS = 256
FAN_IN = 64


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: Fraction = Fraction(3, 2), most: int = 2,
) -> DataFrame:
    """(source, source_size, target): weights go round the sources in code point order, null last.

    Targets share ``share`` of all sizes by weight; none exceeds ``most`` times its source's
    size, and what is above is shared again among the others. Sources are never gathered in one
    place: a round asks Spark for three sums.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = ranked_globally(totals, [F.col("source").asc_nulls_last()], "rank")
    cycle = F.array(*[F.lit(w) for w in weights])
    rows = store(ranked.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int"))))
    exact, level, full = Fraction(0), Fraction(0), None
    while True:
        over = F.col("weight") * F.lit(level.numerator).cast("decimal(38,0)") > F.col("source_size") * most * F.lit(level.denominator).cast("decimal(38,0)") if full is not None else F.lit(False)
        got = rows.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(over, F.col("source_size"))).alias("capped"),
            F.sum(F.when(~over, F.col("weight"))).alias("weight"), F.count_if(over).alias("n"),
        ).first()
        if not got["weight"] or got["n"] == full:
            break
        full = got["n"]
        exact = (share * got["all"] - most * (got["capped"] or 0)) / got["weight"]
        # Six digits after the point are kept, so that the comparison stays within decimals.
        level = Fraction(round(exact * 10**6), 10**6)
    target = F.least(F.col("weight") * F.lit(float(exact)), F.col("source_size") * F.lit(float(most)))
    return rows.select("source", "source_size", target.cast("double").alias("target"))


def closing(salt: int):
    """A pass over partitions sorted by source and leaf that rounds the open rows of each group.

    Rows are paired one after another; moving mass up or down with the right odds keeps every
    row's expected mass and, exactly, the sum of all. A row closes at 0 or at its full size; one
    row a group at most stays open. Only that row is carried along, so a group may have any size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the open row of the group that the last batch ended in
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            size = (table["size"].to_numpy() * UNIT).tolist()
            mass = table["mass"].to_numpy().tolist()
            groups = list(zip(table["source"].to_pylist(), table["leaf"].to_pylist(), strict=True))
            draws = ((mix64(table["order"].to_numpy().view(np.uint64) + np.uint64(salt)) >> np.uint64(11)) * 2.0**-53).tolist()
            open_row = np.zeros(len(size), bool)
            left = -1
            for k in range(len(size)):
                if left >= 0 and groups[left] != groups[k]:
                    open_row[left], left = True, -1
                if mass[k] in (0, size[k]):
                    continue
                if left < 0:
                    left = k
                    continue
                up, down = min(size[left] - mass[left], mass[k]), min(mass[left], size[k] - mass[k])
                move = up if draws[k] * (up + down) < down else -down
                mass[left] += move
                mass[k] -= move
                if mass[left] in (0, size[left]):
                    left = -1 if mass[k] in (0, size[k]) else k
            table = table.set_column(table.schema.get_field_index("mass"), "mass", pa.array(mass, pa.int64()))
            held = table.slice(left, 1).combine_chunks().to_batches()[0] if left >= 0 else None
            table = table.append_column("open", pa.array(open_row))
            if left >= 0:
                table = table.filter(pa.array(np.arange(len(size)) != left))
            yield from table.to_batches()
        if held is not None:
            yield from pa.Table.from_batches([held]).append_column("open", pa.array([True])).to_batches()

    return run


def mix(docs: DataFrame, seed: int = 1, keep: list[str] | None = None, **targets) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken, copies and the columns ``keep``.

    ``taken`` is in words: a document enters whole, twice or not at all; in each source one
    document, the root of the source's tree, gives the part that is missing to the target.
    ``copies`` is the number of whole copies, the root's part rounded.

    A null text has size 0 and is taken 0; the null source is a source; repeated rows are drawn
    each; other columns are not used; an empty table gives an empty table. Equal input gives
    equal output, for rows are ordered by hashes and draws are seeded by them.
    """
    keep = keep or []
    order = F.xxhash64(F.lit(seed), "doc_id", "text")
    rows = store(docs.select("doc_id", "source", word_count("text").alias("size"), order.alias("order"), *keep))
    chosen = source_targets(rows.select("source", "size"), **targets).withColumnRenamed("source", "__source")
    joined = rows.join(chosen, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate).cast("long")
    mass = F.round((rate - whole) * F.col("size") * UNIT).cast("long")
    leaves = max(1, rows.count() // LEAF_ROWS)
    todo = joined.select(
        "doc_id", "source", "size", "order", *keep, "source_size", "target", whole.alias("whole"), mass.alias("mass"),
        F.pmod("order", F.lit(leaves)).alias("leaf"),
    )
    schema = f"{todo._jdf.schema().toDDL()}, open boolean"
    small_batches(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done, level = [], 0
    while True:
        dealt = todo.repartition(parts, "source", "leaf").sortWithinPartitions("source", "leaf", "order", "size", "mass")
        step = store(dealt.mapInArrow(closing(seed * 1000 + level), schema))
        if leaves == 1:
            done.append(step)
            break
        done.append(step.where("not open"))
        todo = step.where("open").drop("open").withColumn("leaf", F.floor(F.col("leaf") / FAN_IN).cast("long"))
        leaves, level = -(-leaves // FAN_IN), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    part = F.round(F.col("mass") / UNIT).cast("long")
    return out.select(
        "doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + part).alias("taken"),
        (F.col("whole") + F.when(F.col("size") > 0, F.round(part / F.col("size"))).otherwise(0)).cast("long").alias("copies"),
        *keep,
    )


def mixed(docs: DataFrame, seed: int = 1, **targets) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their columns only.

    Whole documents only: the one of each source that gives a part counts as its rounded copies.
    Null and empty texts have size 0: they enter as often as the whole part of their source's rate
    says. The null source is a source; repeated rows are drawn each; an empty table gives an empty table.
    """
    digest = text_digest("text")[0]
    drawn = mix(docs.withColumn("__key", digest), seed, ["__key"], **targets)
    drawn = drawn.where("copies > 0").groupBy(F.col("doc_id").alias("__id"), "__key").agg(F.collect_list("copies").alias("__copies"))
    columns = [docs[c] for c in docs.columns]
    joined = docs.join(drawn, docs["doc_id"].eqNullSafe(F.col("__id")) & (digest == F.col("__key")))
    # Equal rows share a list of copies: the n-th of them takes the n-th number.
    turn = F.row_number().over(Window.partitionBy(F.coalesce("__id", F.lit(0)), F.col("__id").isNull(), "__key").orderBy("__id"))
    times = F.coalesce(F.get("__copies", F.col("__turn") - 1), F.lit(0))
    return joined.withColumn("__turn", turn).withColumn("__n", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)))).select(*columns)
