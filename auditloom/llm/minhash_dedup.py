"""Near duplicates: universal MinHash, banding, signature and exact verification, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.common import add_columns, store, text_digest
from auditloom.llm.components import components
from auditloom.llm.shingles import minima, shingle_sets
from auditloom.llm.textarrays import Texts, mix

#: 44 bands of 6 minima: a pair at similarity 0.8 is in no common band with odds of 2e-6, one at 0.35 in any with 8 %.
BANDS, ROWS = 44, 6
SEED = 5
#: Minima kept for the signature, 16 bits each.
KEPT = 128
#: Pairs that share fewer of the kept minima are far apart. At a similarity of 0.6, and the more so
#: at 0.8, 51 shared minima or fewer have odds below 1e-5.
NEAR = 52
FIELDS = [
    T.StructField("n_shingles", T.LongType()), T.StructField("set_a", T.LongType()), T.StructField("set_b", T.LongType()),
    T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("signature", T.BinaryType()),
]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def summaries(texts: Texts, size: int) -> list:
    """FIELDS of each text: the set as a 128-bit sum of hashes, band keys, 16 bits of each minimum."""
    values, marks = shingle_sets(texts, size)
    counts = np.diff(marks)
    total = [np.concatenate([[np.uint64(0)], np.cumsum(mix(values + np.uint64(s)), dtype=np.uint64)]) for s in (1, 2)]
    set_a, set_b = (t[marks[1:]] - t[marks[:-1]] for t in total)
    found = minima(values, marks, BANDS * ROWS, SEED)
    keys = np.zeros((len(found), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        keys = mix(keys * np.uint64(31) + found[:, k::ROWS][:, :BANDS])
    full = counts > 0
    offsets = np.concatenate([[0], np.cumsum(full * BANDS)]).astype(np.int32)
    bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(keys.ravel())))
    short = (mix(found[:, :KEPT]) >> np.uint64(48)).astype("<u2")
    rows = iter(short)
    signatures = pa.array([next(rows).tobytes() if f else b"" for f in full], pa.binary())
    return [counts, signed(set_a), signed(set_b), bands, signatures]


def near_signatures(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The pairs (u, v) whose signatures share NEAR minima or more."""
    one, two = (signatures.select(F.col("node").alias(k), F.col("signature").alias(f"s{k}")) for k in "uv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, KEPT) for c in ("su", "sv"))
            keep = pa.array((a == b).sum(axis=1) >= NEAR)
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(keep), batch.column("v").filter(keep)], ["u", "v"])

    return pairs.join(one, "u").join(two, "v").select("u", "v", "su", "sv").mapInArrow(run, "u long, v long")


def sorted_sets(batch: pa.RecordBatch, column: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(column)]


def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    one, two = (sets.select(F.col("node").alias(k), F.col("values").alias(f"s{k}")) for k in "uv")
    return pairs.join(one, "u").join(two, "v").select("u", "v", "su", "sv")


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v, common): exact intersections of full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common = []
            for a, b in zip(sorted_sets(batch, "su"), sorted_sets(batch, "sv"), strict=True):
                both = np.sort(np.concatenate([a, b]), kind="stable")
                common.append(int((both[1:] == both[:-1]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(common, pa.int64())], ["u", "v", "common"])

    return with_sets(pairs, sets).mapInArrow(run, "u long, v long, common long")


def additions(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, hub, shingle): the shingles of u that v, its hub, doesn't have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [np.setdiff1d(a, b, assume_unique=True) for a, b in zip(sorted_sets(batch, "su"), sorted_sets(batch, "sv"), strict=True)]
            where = pa.array(np.repeat(np.arange(len(new)), [len(x) for x in new]))
            shingle = pa.array(signed(np.concatenate([np.zeros(0, np.uint64), *new])))
            yield pa.RecordBatch.from_arrays([batch.column("u").take(where), batch.column("v").take(where), shingle], ["node", "hub", "shingle"])

    return with_sets(pairs, sets).mapInArrow(run, "node long, hub long, shingle long")


class Linker:
    """Finds the links between distinct sets.

    First every node is compared with a hub of each of its buckets only. Nodes that hubs joined
    need no comparison with each other. What is left are pairs of different components in one
    bucket, and the hub tells which of those can be links at all:

    * a node far from the hub can't be linked with a node linked to it (distances obey the
      triangle inequality);
    * if u has a_u shingles that the hub lacks and lacks r_u of the hub's, and v likewise, and u
      and v share c shingles outside of the hub, they differ in a_u + a_v - 2 c + |r_u - r_v|
      shingles or more. So either that is few enough for a link with c = 0, or they share such
      shingles, and these pairs and their c come from a join on them.

    So a large group of copies that differ here and there isn't compared pair by pair.
    """

    def __init__(self, docs: DataFrame, nodes: DataFrame, size: int, percent: int) -> None:
        self.docs, self.nodes, self.size, self.percent = docs, nodes, size, percent
        self.sizes = nodes.select("node", "n_shingles")
        keys = nodes.select("node", F.explode("bands").alias("bucket"))
        shared = keys.groupBy(F.col("bucket").alias("b")).agg(F.count("*").alias("members")).where("members > 1")
        #: (bucket, node, members) of buckets with two nodes or more.
        self.buckets = store(keys.join(shared, F.col("bucket") == F.col("b")).select("bucket", "node", "members"))
        spark = nodes.sparkSession
        self.sets = spark.createDataFrame([], "node long, values binary")
        #: All pairs compared so far; common is null for pairs that are far apart.
        self.tried = spark.createDataFrame([], "u long, v long, common long")

    def compare(self, pairs: DataFrame) -> None:
        """Compare pairs (u < v) by signature and, if they aren't far apart, by their full sets."""
        fresh = store(pairs.distinct().join(self.tried, ["u", "v"], "left_anti"))
        near = store(near_signatures(fresh, self.nodes.select("node", "signature")))
        wanted = near.select(F.col("u").alias("node")).unionByName(near.select(F.col("v").alias("node"))).distinct()
        wanted = store(wanted.join(self.sets, "node", "left_anti"))
        if not wanted.isEmpty():
            self.sets = self.sets.unionByName(self.read_sets(wanted))
        found = store(overlaps(near, self.sets))
        self.tried = self.tried.unionByName(fresh.join(found, ["u", "v"], "left").select("u", "v", "common"))

    def read_sets(self, wanted: DataFrame) -> DataFrame:
        """Full sets of the wanted nodes, from the texts: sets of all other documents are never stored."""
        rows = self.nodes.select("node", F.col("doc_id").alias("__id"), "digest").join(wanted, "node")
        texts = self.docs.select("doc_id", "text").withColumn("__digest", text_digest("text")[0])
        texts = texts.join(rows, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("digest")))
        size = self.size

        def make(found: Texts) -> list:
            values, marks = shingle_sets(found, size)
            return [pa.array([values[a:b].tobytes() for a, b in zip(marks[:-1], marks[1:], strict=True)], pa.binary())]

        sets = add_columns(texts.select("node", "text"), [T.StructField("values", T.BinaryType())], make).drop("text")
        return store(sets.dropDuplicates(["node"]))

    def measured(self) -> DataFrame:
        """``tried`` with the sizes of both sets and whether the pair is a link."""
        one, two = (self.sizes.select(F.col("node").alias(k), F.col("n_shingles").alias(f"n{k}")) for k in "uv")
        union = F.col("nu") + F.col("nv") - F.col("common")
        linked = F.coalesce(100 * F.col("common") >= self.percent * union, F.lit(False))
        return self.tried.join(one, "u").join(two, "v").withColumn("linked", linked)

    def roots(self) -> DataFrame:
        return components(self.measured().where("linked").select("u", "v"))

    def mixed(self, roots: DataFrame) -> DataFrame:
        """(bucket, node, root) of the buckets that hold nodes of two components or more."""
        rows = self.buckets.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
        spread = rows.groupBy(F.col("bucket").alias("b")).agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y")
        return store(rows.join(spread, F.col("bucket") == F.col("b")).select("bucket", "node", "root"))

    @staticmethod
    def hubs(rows: DataFrame, rank: str) -> DataFrame:
        """(b, hub) of each bucket: its node with the highest rank, then by a hash."""
        first = F.min(F.struct(-F.col(rank), F.xxhash64("node"), "node"))
        return rows.groupBy(F.col("bucket").alias("b")).agg(first.alias("first")).select("b", F.col("first.node").alias("hub"))

    @staticmethod
    def ordered(one: str, two: str) -> list:
        return [F.least(one, two).alias("u"), F.greatest(one, two).alias("v")]

    def run(self) -> DataFrame:
        """(node, root) of the components of all links."""
        # The node that meets most others is in the middle of its group.
        fame = self.buckets.groupBy(F.col("node").alias("k")).agg(F.sum("members").alias("fame"))
        famed = self.buckets.join(fame, F.col("node") == F.col("k")).select("bucket", "node", "fame")
        hubs = store(self.hubs(famed, "fame"))
        with_hubs = self.buckets.join(hubs, F.col("bucket") == F.col("b")).where("node <> hub")
        self.compare(with_hubs.select(*self.ordered("node", "hub")))
        roots = store(self.roots())
        rows = self.mixed(roots)
        if not rows.isEmpty():
            self.compare(self.left_pairs(rows, hubs))
            roots = self.roots()
        return roots

    def left_pairs(self, rows: DataFrame, hubs: DataFrame) -> DataFrame:
        """The pairs of different components that the hubs don't rule out."""
        tests = self.measured().select("u", "v", "common", "nu", "nv", "linked")
        both = tests.select(F.col("u").alias("x"), F.col("v").alias("h"), "common", F.col("nu").alias("nx"), F.col("nv").alias("nh"), "linked").unionByName(
            tests.select(F.col("v").alias("x"), F.col("u").alias("h"), "common", F.col("nv").alias("nx"), F.col("nu").alias("nh"), "linked"))
        at_hub = rows.join(hubs, F.col("bucket") == F.col("b")).select("bucket", "node", "root", "hub")
        told = at_hub.join(both, (F.col("node") == F.col("x")) & (F.col("hub") == F.col("h")), "left").join(
            self.sizes.withColumnRenamed("node", "k"), F.col("node") == F.col("k"))
        is_hub = F.col("node") == F.col("hub")
        told = store(told.select(
            "bucket", "node", "root", "hub", F.col("n_shingles").alias("n"),
            F.when(is_hub, 0).otherwise(F.col("nx") - F.col("common")).alias("more"),
            F.when(is_hub, 0).otherwise(F.col("nh") - F.col("common")).alias("less"),
            (is_hub | F.coalesce("linked", F.lit(False))).alias("linked"),
        ))
        u, v = (told.select("bucket", *[F.col(c).alias(f"{c}_{k}") for c in ("node", "root", "n", "more", "less", "linked")]) for k in "uv")
        p = self.percent
        # |difference| <= (1 - t) / (1 + t) (|u| + |v|) for links at similarity t.
        def few(shared):
            difference = F.col("more_u") + F.col("more_v") - 2 * shared + F.abs(F.col("less_u") - F.col("less_v"))
            return (100 + p) * difference <= (100 - p) * (F.col("n_u") + F.col("n_v"))

        known = F.col("more_u").isNotNull() & F.col("more_v").isNotNull()
        apart = (F.col("more_u").isNull() & F.col("linked_v")) | (F.col("more_v").isNull() & F.col("linked_u"))
        sizes = (100 * F.least("n_u", "n_v") >= p * F.greatest("n_u", "n_v"))
        other = (F.col("root_u") != F.col("root_v")) & sizes
        by_number = u.join(v, "bucket").where((F.col("node_u") < F.col("node_v")) & other & ~apart & (~known | few(F.lit(0))))
        # Pairs that share a shingle outside of their hub.
        members = told.where("more > 0").select("node", "hub", "root", "n", "more", "less").distinct()
        shingles = store(additions(members.select(F.col("node").alias("u"), F.col("hub").alias("v")), self.sets))
        several = shingles.groupBy(F.col("hub").alias("h"), F.col("shingle").alias("s")).agg(F.count("*").alias("c")).where("c > 1")
        shingles = shingles.join(several, (F.col("hub") == F.col("h")) & (F.col("shingle") == F.col("s"))).select("node", "hub", "shingle")
        placed = shingles.join(members.select(F.col("node").alias("k"), F.col("hub").alias("h"), "root", "n", "more", "less"), (F.col("node") == F.col("k")) & (F.col("hub") == F.col("h")))
        columns = ("node", "root", "n", "more", "less")
        u, v = (placed.select("hub", "shingle", *[F.col(c).alias(f"{c}_{k}") for c in columns]) for k in "uv")
        # Two sets can't share more shingles outside of the hub than the smaller number of them.
        most = few(F.least("more_u", "more_v"))
        together = u.join(v, ["hub", "shingle"]).where((F.col("node_u") < F.col("node_v")) & other & most)
        shared = together.groupBy("hub", *[f"{c}_{k}" for k in "uv" for c in columns]).agg(F.count("*").alias("shared"))
        by_shingle = shared.where(few(F.col("shared")))
        return by_number.select(F.col("node_u").alias("u"), F.col("node_v").alias("v")).unionByName(
            by_shingle.select(F.col("node_u").alias("u"), F.col("node_v").alias("v")))


def grouped(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Per row: doc_id, digest, n_shingles, root (a number of its component, null without words), component_id.

    Bands and signatures are made for a similarity of 0.8 or more.
    """
    if percent < 80:
        raise ValueError("percent must be at least 80: bands would miss pairs less similar")
    rows = docs.select("doc_id", "text").withColumn("digest", text_digest("text")[0])
    rows = store(add_columns(rows, FIELDS, lambda t: summaries(t, size)).drop("text"))
    worded = rows.where("n_shingles > 0")
    # Equal sets are one node, known by its smallest document.
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("first")
    nodes = worded.groupBy("set_a", "set_b").agg(first, *[F.first(c).alias(c) for c in ("n_shingles", "bands", "signature")])
    nodes = store(nodes.select(
        F.monotonically_increasing_id().alias("node"), "set_a", "set_b", F.col("first.doc_id").alias("doc_id"),
        F.col("first.digest").alias("digest"), "n_shingles", "bands", "signature",
    ))
    roots = Linker(docs, nodes, size, percent).run()
    placed = nodes.select("node", "set_a", "set_b", F.col("doc_id").alias("least")).join(roots, "node", "left")
    placed = store(placed.withColumn("root", F.coalesce("root", "node")))
    # Stored first: a join of plain tables can split a component with very many sets.
    smallest = store(placed.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id")))
    labels = placed.join(smallest, F.col("root") == F.col("r")).select(F.col("set_a").alias("a"), F.col("set_b").alias("b"), "root", "component_id")
    rows = rows.select("doc_id", "digest", "n_shingles", "set_a", "set_b")
    out = rows.join(labels, (F.col("set_a") == F.col("a")) & (F.col("set_b") == F.col("b")) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "digest", "n_shingles", "root", component.alias("component_id"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Texts are linked if the sets of their ``size``-word shingles have
    100 * intersection >= percent * union; links are confirmed on full sets. component_id is the
    smallest doc_id reachable. Texts without words, null included, are linked with nothing and
    kept. A null doc_id counts as larger than all others; rows that repeat a doc_id in one
    component are all kept if it is the smallest. Other columns are not used. Long texts are
    read whole; an empty table gives an empty table.
    """
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return grouped(docs, size, percent).select("doc_id", "n_shingles", "component_id", kept)


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` for each component, that of the smallest doc_id, and all rows without words.

    If rows repeat that doc_id, one of them stays; a null doc_id counts as larger than all others;
    null and empty texts have no words; the columns are those of ``docs``, whatever their names. An
    empty table gives an empty table.
    """
    rows = grouped(docs, size, percent).where("root is not null")
    keys = store(rows.groupBy("root", "doc_id", "digest").agg(F.count("*").alias("n")))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("first")
    winners = keys.groupBy(F.col("root").alias("r")).agg(first)
    judged = keys.join(winners, F.col("root") == F.col("r")).select(
        F.col("doc_id").alias("__id"), F.col("digest").alias("__key"), "n",
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))).alias("wins"),
    )
    judged = store(judged)
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (text_digest(docs["text"])[0] == F.col("__key"))
    again = judged.where("wins and n > 1")
    out = docs.join(judged.where("not wins or n > 1"), same, "left_anti")
    if again.isEmpty():
        return out
    return out.unionByName(docs.join(again.select("__id", "__key"), same).dropDuplicates(["__id", "__key"]).select(docs.columns))
