"""The prefix trie of conversations, from sorted neighbours.

A conversation is one row: a key of one 128-bit digest for each turn, in order, and the turns' sizes.
Equal conversations become one row. Rows are sorted by key over range partitions; the number of
leading turns that neighbours share (their LCP) is the weight of an edge between them. A block of
sorted rows takes its edges in descending weight and unites their ends: what is united at a depth is
one node of that depth, and a merge of several components is a branching node. A block's forest is
contracted to the two paths that its neighbours may share, those of its first and its last row; these
nodes meet by the digest of their path and add up. All other nodes are complete within their block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.common import small_batches, store

#: Characters of a turn's digest in a key.
DIGEST = 32
#: Ids that are joined in one row before their group is hashed.
CHUNK = 4_096
#: Conversations of the contract take up to so many turns, less one, from the one with the next lower id that ends in 00.
SHARED_TURNS, SHARED_IDS = 6, 100


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation as (digest, size), by turn, null first.

    Null role or text is empty. Equal turn numbers go by digest; repeated rows are turns of their
    own. Rows without a conv_id belong to no conversation. A turn takes 60 bytes of its
    conversation's row, however long its text is.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    row = F.struct("turn", digest.alias("digest"), F.length(text).cast("long").alias("size"))
    sorted_rows = F.sort_array(F.collect_list(row))
    return (
        conversations.where("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id"))
        .agg(F.transform(sorted_rows, lambda t: F.struct(t["digest"], t["size"])).alias("turns"))
    )


def rebuild(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) after every conversation c has taken the first h turns of c - c % 100.

    h is the CRC-32 of the decimal c modulo 6; c keeps its own turns after its first h. A
    conversation may be left without turns and stays a row.
    """
    own = store(turns(conversations))
    first = F.col("conv_id") - F.col("conv_id") % SHARED_IDS
    heads = own.where(first == F.col("conv_id")).select(
        F.col("conv_id").alias("first"), F.slice("turns", 1, SHARED_TURNS - 1).alias("head"))
    taken = (F.crc32(F.col("conv_id").cast("string")) % SHARED_TURNS).cast("int")
    empty = F.slice("turns", 1, 0)
    joined = own.withColumns({"first": first, "h": taken}).join(heads, "first", "left")
    return joined.select("conv_id", F.concat(
        F.slice(F.coalesce("head", empty), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1))),
    ).alias("turns"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (path, conv_id) become one row for up to CHUNK ids of a path in this batch."""
    for batch in batches:
        paths, ids = batch.column("path").to_pylist(), batch.column("conv_id").to_pylist()
        rows, start = [], 0
        for k in range(1, len(ids) + 1):
            if k == len(ids) or paths[k] != paths[start] or k - start == CHUNK:
                rows.append({"path": paths[start], "conv_id": ids[start], "n": k - start, "ids": ",".join(map(str, ids[start:k]))})
                start = k
        yield pa.RecordBatch.from_pylist(rows, CHUNKS)


CHUNKS = pa.schema([("path", pa.string()), ("conv_id", pa.int64()), ("n", pa.int64()), ("ids", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks become one row for each path, hashed while they pass."""
    at, first, n, sha = None, None, 0, None
    for batch in batches:
        rows = []
        for path, conv_id, count, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if path != at:
                if sha:
                    rows.append({"path": at, "conv_id": first, "n": n, "ends": sha.hexdigest()})
                at, first, n, sha = path, conv_id, 0, hashlib.sha256()
            sha.update((("," if n else "") + ids).encode())
            n += count
        yield pa.RecordBatch.from_pylist(rows, ENDS)
    if sha:
        yield pa.RecordBatch.from_pylist([{"path": at, "conv_id": first, "n": n, "ends": sha.hexdigest()}], ENDS)


ENDS = pa.schema([("path", pa.string()), ("conv_id", pa.int64()), ("n", pa.int64()), ("ends", pa.string())])


def _parts(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def members(paths: DataFrame) -> DataFrame:
    """(path, conv_id, n, ends) of ``paths(path, conv_id)``: the least id, how many, and the digest of all in order.

    Ids are dealt over range partitions of (path, conv_id) and joined to chunks, so that a path
    with very many ids is sorted by many tasks; one task then hashes its few chunks, in order.
    """
    parts = _parts(paths)
    chunked = paths.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(
        _chunks, "path string, conv_id long, n long, ids string")
    return chunked.repartition(parts, "path").sortWithinPartitions("path", "conv_id").mapInArrow(
        _digests, "path string, conv_id long, n long, ends string")


def shared(a: str, b: str) -> int:
    """Leading turns that two keys share."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    if a[:DIGEST] != b[:DIGEST] or not high:
        return 0
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle * DIGEST] == b[:middle * DIGEST]:
            low = middle
        else:
            high = middle - 1
    return low


def path_ids(key: str) -> list[str]:
    """A digest of every prefix of a key, that of the whole key last."""
    out, so_far = [hashlib.md5().hexdigest()], hashlib.md5()
    for k in range(0, len(key), DIGEST):
        so_far.update(key[k:k + DIGEST].encode())
        out.append(so_far.hexdigest())
    return out


def sums(sizes: list[int]) -> list[int]:
    """Sizes of the first 0, 1, 2, ... turns."""
    out = [0]
    for size in sizes:
        out.append(out[-1] + size)
    return out


class Forest:
    """Union-find over the rows of one sorted block; a component is an interval of rows.

    The arrays hold, for the root of a component (its first row): the last row, the depth of the
    node that the component is, members, least id, children, leaves, the sum of its members' sizes,
    the sizes of its distinct nodes, and the digest of the members that end at the node.
    """

    def __init__(self, rows: list[dict]):
        self.sizes = [sums(r["sizes"]) for r in rows]
        self.keys = [r["key"] for r in rows]
        self.lcp = [-1] + [shared(a, b) for a, b in zip(self.keys, self.keys[1:], strict=False)]
        n = range(len(rows))
        self.parent, self.last = list(n), list(n)
        self.depth = [len(s) - 1 for s in self.sizes]
        self.count, self.least = [r["n"] for r in rows], [r["conv_id"] for r in rows]
        self.children = [0] * len(rows)
        # A row that begins the next one isn't a leaf.
        self.leaves = [0 if i + 1 in n and self.lcp[i + 1] == self.depth[i] else 1 for i in n]
        self.total = [c * s[-1] for c, s in zip(self.count, self.sizes, strict=True)]
        self.distinct = [0] * len(rows)
        self.ends: list[str | None] = [r["ends"] for r in rows]
        #: (first row, last row, depth, members, least id, children, leaves, total, distinct, ends)
        self.nodes: list[tuple] = []

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def rise(self, i: int, depth: int) -> int:
        """Emit the nodes of a component above ``depth``; 1 if there are any."""
        sizes, children, ends = self.sizes[i], self.children[i], self.ends[i]
        if self.depth[i] <= depth:
            return 0
        for d in range(self.depth[i], depth, -1):
            self.distinct[i] += sizes[d] - sizes[d - 1] if d else 0
            self.nodes.append((i, self.last[i], d, self.count[i], self.least[i], children, self.leaves[i], self.total[i], self.distinct[i], ends))
            children, ends = 1, None
        self.depth[i], self.ends[i] = depth, None
        return 1

    def unite(self, left: int, right: int, depth: int) -> None:
        """Merge two neighbouring components into one node of ``depth``."""
        below = self.rise(left, depth), self.rise(right, depth)
        self.children[left] = below[0] or self.children[left]
        self.children[left] += below[1] or self.children[right]
        for values in (self.count, self.leaves, self.total, self.distinct):
            values[left] += values[right]
        self.least[left] = min(self.least[left], self.least[right])
        self.last[left], self.parent[right] = self.last[right], left

    def grow(self) -> list[tuple]:
        """All nodes of the block, deepest merges first, the root last."""
        for i in sorted(range(1, len(self.keys)), key=lambda i: -self.lcp[i]):
            self.unite(self.find(i - 1), self.find(i), self.lcp[i])
        self.rise(0, -1)
        return self.nodes


    def above(self) -> dict[tuple[int, int], tuple[int, int]]:
        """(first row, depth) of the parent of each node but the root, after ``grow``."""
        start, open_rows = [0] * len(self.lcp), []
        for i, lcp in enumerate(self.lcp):
            # The component that holds row i at depth lcp begins at the last row that shares less.
            while open_rows and self.lcp[open_rows[-1]] >= lcp:
                open_rows.pop()
            start[i] = open_rows[-1] if open_rows else 0
            open_rows.append(i)
        return {(a, d): (a if self.lcp[a] < d - 1 else start[a], d - 1) for a, _, d, *_ in self.nodes if d}


FIELDS = (
    ("kind", "string"), ("part", "long"), ("block", "long"), ("path", "string"), ("parent_path", "string"), ("conv_id", "long"),
    ("depth", "long"), ("parent_conv_id", "long"), ("n_convs", "long"), ("n_children", "long"), ("n_leaves", "long"),
    ("total", "long"), ("distinct", "long"), ("before", "long"), ("ends_sha256", "string"), ("key", "string"), ("sizes", "array<long>"),
)
ARROW = {"string": pa.string(), "long": pa.int64(), "array<long>": pa.list_(pa.int64())}
#: Closed nodes are complete; open ones may go on in other blocks; a border row has a block's first or last key.
CLOSED, OPEN, FIRST, LAST = "closed", "open", "first", "last"


def ddl(names: list[str]) -> str:
    return ", ".join(f"{n} {dict(FIELDS)[n]}" for n in names)


def arrow(names: list[str]) -> pa.Schema:
    return pa.schema([(n, ARROW[dict(FIELDS)[n]]) for n in names])


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes and borders of each Arrow batch of rows that are sorted by key."""
    part, block, schema = TaskContext.get().partitionId(), 0, arrow([n for n, _ in FIELDS])
    for batch in batches:
        rows = batch.to_pylist()
        if not rows:
            continue
        end, forest = len(rows) - 1, Forest(rows)
        nodes = forest.grow()
        above, least = forest.above(), {(a, d): conv_id for a, _, d, _, conv_id, *_ in nodes}
        # The path of a node with the first or the last row of the block, and of no other.
        border = [path_ids(rows[0]["key"]), path_ids(rows[-1]["key"])]
        paths = {(a, d): border[a != 0][d] for a, b, d, *_ in nodes if a == 0 or b == end}
        out = [{"kind": k, "part": part, "block": block, "key": r["key"], "sizes": r["sizes"]} for k, r in ((FIRST, rows[0]), (LAST, rows[-1]))]
        for a, _, d, count, conv_id, children, leaves, total, distinct, ends in nodes:
            over = above.get((a, d))
            out.append({
                "kind": OPEN if (a, d) in paths else CLOSED, "path": paths.get((a, d)), "parent_path": paths.get(over),
                "conv_id": conv_id, "depth": d, "parent_conv_id": least.get(over), "n_convs": count, "n_children": children,
                "n_leaves": leaves, "total": total, "distinct": distinct, "before": forest.sizes[a][d - 1] if d else 0, "ends_sha256": ends,
            })
        yield pa.RecordBatch.from_pylist(out, schema)
        block += 1


SUMS = ["path", "depth", "n_children", "n_leaves", "distinct"]


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a block counted again of the path that its first row shares with the block before."""
    schema = arrow(SUMS)
    for batch in batches:
        out = []
        for before, key, sizes in zip(*(batch.column(n).to_pylist() for n in ("before", "key", "sizes")), strict=True):
            both, so_far = shared(before, key), sums(sizes)
            ended = both * DIGEST == len(before)
            for d, path in enumerate(path_ids(key[:both * DIGEST])):
                out.append({
                    "path": path, "depth": d, "n_children": -1 if d < both else 0, "n_leaves": -1 if ended else 0,
                    "distinct": (so_far[d - 1] if d else 0) - so_far[both],
                })
        yield pa.RecordBatch.from_pylist(out, schema)


def borders(forests: DataFrame) -> DataFrame:
    """(before, key, sizes): the last key before each block, and the block's first one."""
    ends = forests.where(F.col("kind") == LAST).select("part", "block", F.col("key").alias("last"))
    starts = forests.where(F.col("kind") == FIRST).select("part", "block", "key", "sizes")
    inside = ends.select("part", (F.col("block") + 1).alias("block"), F.col("last").alias("before"))
    # One row for each range partition that isn't empty.
    closing = ends.groupBy("part").agg(F.max_by("last", "block").alias("last"))
    across = closing.select("part", F.lit(0).cast("long").alias("block"), F.lag("last").over(Window.orderBy("part")).alias("before"))
    return starts.join(inside.unionByName(across.where("before is not null")), ["part", "block"]).select("before", "key", "sizes")


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of the prefix trie of ``conversations(conv_id, turns)``, as ``rebuild`` and ``turns`` make them.

    Returns conv_id (the least member), depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves, saved_tokens (what its subtree saves if each node's last text is kept
    once for all its members) and ends_sha256 (of the members that end at the node). Conversations
    without turns are members of the root alone. An empty table has no nodes, not even a root. Ids
    must differ.
    """
    small_batches(conversations.sparkSession)
    key = F.array_join(F.transform("turns", lambda t: t["digest"]), "")
    rows = store(conversations.select("conv_id", F.md5(key).alias("path"), key.alias("key"), F.transform("turns", lambda t: t["size"]).alias("sizes")))
    distinct = rows.groupBy("path").agg(F.first("key").alias("key"), F.first("sizes").alias("sizes"))
    sequences = store(distinct.join(members(rows.select("path", "conv_id")), "path").select("key", "sizes", "conv_id", "n", "ends"))
    ranged = sequences.repartitionByRange(_parts(rows), "key").sortWithinPartitions("key")
    forests = store(ranged.mapInArrow(_forests, ddl([n for n, _ in FIELDS])))
    again = borders(forests).mapInArrow(_corrections, ddl(SUMS))
    parts = forests.where(F.col("kind") == OPEN).unionByName(again, allowMissingColumns=True)
    # A row for each block at most for a path that many blocks share: summed before it is dealt out.
    merged = store(parts.groupBy("path", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.max("parent_path").alias("parent_path"), F.max("before").alias("before"), F.max("ends_sha256").alias("ends_sha256"),
        *[F.sum(n).alias(n) for n in ("n_convs", "n_children", "n_leaves", "total", "distinct")],
    ))
    closed = forests.where(F.col("kind") == CLOSED)
    known = merged.select(F.col("path").alias("parent_path"), F.col("conv_id").alias("parent"))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "total", "distinct", "before", "ends_sha256"]
    whole = closed.where("parent_path is null").select(names)
    touching = closed.where("parent_path is not null").drop("parent_conv_id").join(known, "parent_path").withColumnRenamed("parent", "parent_conv_id").select(names)
    joined = merged.join(known, "parent_path", "left").withColumnRenamed("parent", "parent_conv_id").select(names)
    return whole.unionByName(touching).unionByName(joined).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("total") - F.col("n_convs") * F.col("before") - F.col("distinct")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
