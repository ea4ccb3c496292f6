"""Ranked lexical search over bit-sliced Bloom signatures.

The index is a table of blocks. A block holds documents of similar length: a bit matrix with a
column for each document and a row for each hash value, stored row by row (a slice is the bitmap of one
row over all documents of the block), the block's terms with the number of its documents that hold
each, and the texts, in columns of their own. A document sets the bits of (term, level) for every
level that its count of the term reaches, so the ANDed slices of a term and a level tell which
documents may hold the term so often: never too few. Weighted sums of these bitmaps bound every
document's score from above. Documents whose bound is below the score that the best ``top`` surely
reach are excluded; all others are scored exactly from their whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.common import slices, small_batches, store
from auditloom.llm.fm_decontam import words_of
from auditloom.llm.textarrays import Texts, mix

#: Bytes of text in a block, unless a single text is longer.
SHARD_BYTES = 4 << 20
#: Bits for each (term, level) of a block's fullest document, and bits that each one sets.
BITS, HASHES = 10, 3
#: Documents of up to so many (term, level) share the shortest signatures; lengths then double.
LEAST_ENTRIES = 64
#: Items of one pass over the index, and bytes of their texts, unless one item is longer.
ITEMS, ITEM_BYTES = 1_000, 8 << 20
#: Numbers in one matrix of terms by documents.
CELLS = 1 << 21
#: Documents with the highest bounds that are scored first, for each result wanted.
PROBES = 2

INDEX = T.StructType([
    T.StructField("doc_id", T.ArrayType(T.LongType())), T.StructField("terms", T.ArrayType(T.LongType())),
    T.StructField("width", T.LongType()), T.StructField("slices", T.BinaryType()),
    T.StructField("vocabulary", T.BinaryType()), T.StructField("holders", T.BinaryType()),
    T.StructField("text", T.ArrayType(T.StringType())),
])
FOUND = T.StructType([
    T.StructField("item", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType()),
])


def level_starts(most: int) -> np.ndarray:
    """Counts at which the levels begin, 1, 2, 3, 5, 9, ..., up to ``most``."""
    out = [1, 2]
    while out[-1] < most:
        out.append(2 * out[-1] - 1)
    return np.array([x for x in out if x <= max(most, 1)], np.int64)


def slice_rows(keys: np.ndarray, level: int, width: int) -> np.ndarray:
    """The HASHES slices of each term at a level, as (terms, HASHES)."""
    seed = mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    out = [(mix(seed + np.uint64(k)) % np.uint64(width)).astype(np.int64) for k in range(HASHES)]
    return np.stack(out, axis=1)


def term_counts(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms as (text, hash, count), by text, and the number of words of each text."""
    words, hashes = words_of(texts)
    owner = words.owner()
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(fresh)
    return owner[at], hashes[at], np.diff(np.append(at, len(owner))), words.counts()


def signatures(doc: np.ndarray, keys: np.ndarray, counts: np.ndarray, docs: int, width: int) -> np.ndarray:
    """The bit matrix (width, bytes of a slice) of documents 0 to ``docs`` - 1."""
    bits = np.zeros((width, -(-docs // 8) * 8), bool)
    for level, start in enumerate(level_starts(int(counts.max(initial=1)))):
        there = counts >= start
        rows = slice_rows(keys[there], level, width)
        for k in range(HASHES):
            bits[rows[:, k], doc[there]] = True
    return np.packbits(bits, axis=1, bitorder="little")


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", SHARD_BYTES):
            doc, keys, counts, sizes = term_counts(Texts.of(part.column("text")))
            entries = np.zeros(part.num_rows, np.int64)
            for start in level_starts(int(counts.max(initial=1))):
                entries += np.bincount(doc[counts >= start], minlength=part.num_rows)
            kind = np.ceil(np.log2(np.maximum(entries, LEAST_ENTRIES))).astype(np.int64)
            kind[entries == 0] = -1
            for k in np.unique(kind[kind >= 0]):
                chosen = np.flatnonzero(kind == k)
                mine = kind[doc] == k
                place = np.searchsorted(chosen, doc[mine])
                width = BITS * int(entries[chosen].max())
                known, holders = np.unique(keys[mine], return_counts=True)
                matrix = signatures(place, keys[mine], counts[mine], len(chosen), width)
                yield pa.RecordBatch.from_pylist([{
                    "doc_id": part.column("doc_id").take(pa.array(chosen)).to_pylist(), "terms": sizes[chosen].tolist(),
                    "width": width, "slices": matrix.tobytes(), "vocabulary": known.tobytes(),
                    "holders": holders.astype(np.int32).tobytes(), "text": part.column("text").take(pa.array(chosen)).to_pylist(),
                }], ARROW_INDEX)


ARROW_INDEX = pa.schema([
    ("doc_id", pa.list_(pa.int64())), ("terms", pa.list_(pa.int64())), ("width", pa.int64()), ("slices", pa.binary()),
    ("vocabulary", pa.binary()), ("holders", pa.binary()), ("text", pa.list_(pa.string())),
])
ARROW_FOUND = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


@dataclass
class Index:
    """The stored blocks with the number of documents that have a term and of all their terms."""

    blocks: DataFrame
    documents: int
    terms: int


def build(docs: DataFrame) -> Index:
    """Index whole texts of ``docs(doc_id, text)``; further columns are not read.

    Every row is a document of its own, repeated rows and null ids included. Null and empty texts
    and texts without a term are in no block. Long texts get blocks with longer signatures.
    """
    small_batches(docs.sparkSession)
    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_index, INDEX)
    blocks = store(made.withColumn("block", F.monotonically_increasing_id()))
    total = blocks.select(F.size("doc_id").alias("n"), F.aggregate("terms", F.lit(0).cast("long"), lambda a, x: a + x).alias("t"))
    documents, terms = total.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    return Index(blocks, documents, terms)


@dataclass
class Wanted:
    """The terms of a bounded set of items: item i has terms[marks[i]:marks[i + 1]] of the vocabulary."""

    vocabulary: np.ndarray
    terms: np.ndarray
    marks: np.ndarray
    weights: np.ndarray
    least: np.ndarray  # a score that the best documents of the item reach together
    documents: int
    corpus_terms: int

    @classmethod
    def of(cls, texts: list[list[str]], index: Index) -> Wanted:
        """Items of one or more texts each; a term counts once in an item."""
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        doc, keys, _, _ = term_counts(Texts.of(pa.array([t for ts in texts for t in ts], pa.string())))
        vocabulary, symbol = np.unique(keys, return_inverse=True)
        pairs = np.unique(np.stack([owner[doc], symbol.reshape(-1)], axis=1), axis=0) if len(keys) else np.zeros((0, 2), np.int64)
        marks = np.searchsorted(pairs[:, 0], np.arange(len(texts) + 1))
        wanted = cls(vocabulary, pairs[:, 1], marks, np.zeros(len(vocabulary), np.int64), np.ones(len(texts), np.int64), index.documents, index.terms)
        holders = wanted.holders(index.blocks)
        wanted.weights[:] = [math.floor(1000 * math.log((2 * index.documents + 2) / (2 * int(df) + 1))) if df else 0 for df in holders]
        return wanted

    def holders(self, blocks: DataFrame) -> np.ndarray:
        """Documents that hold each term: sums over the blocks' own counts."""
        vocabulary = self.vocabulary

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(vocabulary), np.int64)
            for batch in batches:
                for known, counts in zip(batch.column("vocabulary"), batch.column("holders"), strict=True):
                    mine, there = within(vocabulary, np.frombuffer(known.as_py(), np.uint64))
                    total[mine] += np.frombuffer(counts.as_py(), np.int32)[there]
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

        out = np.zeros(len(vocabulary), np.int64)
        # A row for each term of the bounded vocabulary.
        for row in blocks.select("vocabulary", "holders").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
            out[row.term] = row.n
        return out

    def loads(self, sizes: np.ndarray) -> np.ndarray:
        """The length factor m of documents with so many terms."""
        return np.array([50 + (50 * int(n) * self.documents) // self.corpus_terms for n in sizes], np.int64)

    def totals(self, parts: np.ndarray, present: np.ndarray) -> np.ndarray:
        """Scores (items, documents) of what each present term gives each document, as integers."""
        place = np.full(len(self.vocabulary) + 1, -1)
        place[present] = np.arange(len(present))
        out = np.zeros((len(self.marks) - 1, parts.shape[1]), np.int64)
        for item, (a, b) in enumerate(zip(self.marks[:-1], self.marks[1:], strict=True)):
            mine = place[self.terms[a:b]]
            mine = mine[mine >= 0]
            if len(mine):
                out[item] = self.weights[present[mine]] @ parts[mine]
        return out


def within(vocabulary: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of equal values in two sorted arrays."""
    at = np.minimum(np.searchsorted(known, vocabulary), max(len(known) - 1, 0))
    mine = np.flatnonzero(known[at] == vocabulary) if len(known) else np.zeros(0, np.int64)
    return mine, at[mine]


def gain(counts: np.ndarray, loads: np.ndarray) -> np.ndarray:
    """What a unit of weight gives for so many occurrences: it grows with the count."""
    return (1_000_000_000 * counts) // (1_000 * counts + 20 * loads)


@dataclass
class Block:
    """One row of the index, without its texts."""

    sizes: np.ndarray
    width: int
    matrix: np.ndarray
    known: np.ndarray

    @classmethod
    def of(cls, sizes: list[int], width: int, bits: bytes, known: bytes) -> Block:
        return cls(np.array(sizes, np.int64), width, np.frombuffer(bits, np.uint8).reshape(width, -1), np.frombuffer(known, np.uint64))

    def bounds(self, wanted: Wanted) -> Iterator[tuple[int, np.ndarray]]:
        """First document and upper bounds (items, documents) of parts of the block."""
        present, _ = within(wanted.vocabulary, self.known)
        keys, loads = wanted.vocabulary[present], wanted.loads(self.sizes)
        step = max(8, CELLS // max(1, len(present)) // 8 * 8)
        for first in range(0, len(self.sizes), step):
            sizes, load = self.sizes[first:first + step], loads[first:first + step]
            parts = np.zeros((len(present), len(sizes)), np.int64)
            starts, alive = level_starts(int(sizes.max()) + 1), np.arange(len(present))
            may = np.ones((len(present), len(sizes)), bool)
            for level, start in enumerate(starts):
                rows = slice_rows(keys[alive], level, self.width)
                bits = self.matrix[rows[:, 0], first // 8:(first + step) // 8]
                for k in range(1, HASHES):
                    bits = bits & self.matrix[rows[:, k], first // 8:(first + step) // 8]
                may = may & np.unpackbits(bits, axis=1, count=len(sizes), bitorder="little").astype(bool)
                # A count on this level is below the next one, and at most the document's terms.
                most = np.minimum(starts[level + 1] - 1 if level + 1 < len(starts) else sizes, sizes)
                parts[alive] = np.where(may, gain(np.maximum(most, 1), load)[None, :], parts[alive])
                left = may.any(axis=1)
                alive, may = alive[left], may[left]
                if not len(alive):
                    break
            yield first, wanted.totals(parts, present)


def exact(texts: pa.Array, sizes: np.ndarray, wanted: Wanted) -> Iterator[tuple[int, np.ndarray]]:
    """First document and exact scores (items, documents) of parts of the given whole texts."""
    doc, keys, counts, _ = term_counts(Texts.of(texts))
    at = np.minimum(np.searchsorted(wanted.vocabulary, keys), len(wanted.vocabulary) - 1)
    mine = wanted.vocabulary[at] == keys
    doc, at, counts = doc[mine], at[mine], counts[mine]
    loads, marks = wanted.loads(sizes), np.searchsorted(doc, np.arange(len(sizes) + 1))
    present, place = np.unique(at, return_inverse=True)
    step = max(1, CELLS // max(1, len(present)))
    for first in range(0, len(sizes), step):
        a, b = marks[first], marks[min(first + step, len(sizes))]
        parts = np.zeros((len(present), min(step, len(sizes) - first)), np.int64)
        parts[place.reshape(-1)[a:b], doc[a:b] - first] = gain(counts[a:b], loads[doc[a:b]])
        yield first, wanted.totals(parts, present)


def best_bounds(blocks: DataFrame, wanted: Wanted, most: int) -> DataFrame:
    """(item, block, place): the documents with the highest bounds of each item; reads no texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.of(row["terms"], row["width"], row["slices"], row["vocabulary"])
                for first, bounds in block.bounds(wanted):
                    few = min(most, bounds.shape[1])
                    top = np.argpartition(-bounds, few - 1, axis=1)[:, :few]
                    item, column = np.repeat(np.arange(len(bounds)), few), top.reshape(-1)
                    value = bounds[item, column]
                    some = value > 0
                    yield pa.RecordBatch.from_arrays([
                        pa.array(item[some]), pa.array(np.full(int(some.sum()), row["block"])), pa.array(column[some] + first), pa.array(value[some]),
                    ], ["item", "block", "place", "bound"])

    found = blocks.select("block", "terms", "width", "slices", "vocabulary").mapInArrow(run, "item long, block long, place long, bound long")
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "block", "place")
    return found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).select("item", "block", "place")


def scored(row: dict, places: np.ndarray, chosen: np.ndarray, wanted: Wanted, top: int) -> Iterator[pa.RecordBatch]:
    """Exact scores of the documents at ``places``, for the (item, document) that are chosen.

    Only an item's first ``top`` of them can be among its best: by score, equal scores by id, null last.
    """
    ids = [row["doc_id"][p] for p in places]
    order = np.array([(i is None, i or 0) for i in ids], np.int64).reshape(-1, 2)
    texts = pa.array([row["text"][p] for p in places], pa.string())
    sizes = np.array(row["terms"], np.int64)[places]
    for first, scores in exact(texts, sizes, wanted):
        end = first + scores.shape[1]
        good = chosen[:, first:end] & (scores >= wanted.least[:, None])
        out: list[tuple[int, int | None, int]] = []
        for item in np.flatnonzero(good.any(axis=1)):
            at = np.flatnonzero(good[item])
            by = np.lexsort((order[first + at, 1], order[first + at, 0], -scores[item, at]))[:top]
            out += [(int(item), ids[first + at[k]], int(scores[item, at[k]])) for k in by]
        columns = zip(*out, strict=True) if out else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=ARROW_FOUND)


def probe(blocks: DataFrame, probes: DataFrame, wanted: Wanted, top: int) -> np.ndarray:
    """The least score of an item's best ``top`` among the probes: the whole corpus reaches it too."""
    # At most PROBES * top rows an item of a bounded set of items.
    asked = F.broadcast(probes.groupBy("block").agg(F.collect_list(F.struct("item", "place")).alias("asked")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pairs = np.array([(p["item"], p["place"]) for p in row["asked"]], np.int64)
                places, column = np.unique(pairs[:, 1], return_inverse=True)
                chosen = np.zeros((len(wanted.marks) - 1, len(places)), bool)
                chosen[pairs[:, 0], column.reshape(-1)] = True
                yield from scored(row, places, chosen, wanted, top)

    found = blocks.join(asked, "block").select("doc_id", "terms", "text", "asked").mapInArrow(run, FOUND)
    ranked = found.withColumn("k", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))).where(F.col("k") == top)
    least = wanted.least.copy()
    for r in ranked.select("item", "score").collect():
        least[r.item] = max(1, r.score)
    return least


def survivors(blocks: DataFrame, wanted: Wanted, top: int) -> DataFrame:
    """(item, doc_id, score): exact scores of all documents whose bound reaches the item's least."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.of(row["terms"], row["width"], row["slices"], row["vocabulary"])
                chosen = np.concatenate([b >= wanted.least[:, None] for _, b in block.bounds(wanted)], axis=1)
                places = np.flatnonzero(chosen.any(axis=0))
                if len(places):
                    yield from scored(row, places, chosen[:, places], wanted, top)

    return blocks.select("doc_id", "terms", "width", "slices", "vocabulary", "text").mapInArrow(run, FOUND)


def item_sets(items: DataFrame) -> Iterator[dict]:
    """The items in bounded sets, {item_id: its texts}: rows of one id stay together."""
    out: dict = {}
    size = 0
    for row in items.select("item_id", "text").orderBy("item_id").toLocalIterator():
        if row.item_id not in out and (len(out) >= ITEMS or size >= ITEM_BYTES):
            yield out
            out, size = {}, 0
        out.setdefault(row.item_id, []).append(row.text)
        size += len(row.text or "")
    if out:
        yield out


def search(index: Index, items: DataFrame, top: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` documents with a score above 0.

    Rows of ``items`` with the same item_id are one item; null is an id like any other. A null,
    empty or wordless item, and every item on an empty index, has no rows. Equal scores rank by
    ascending doc_id, null last; equal rows of documents may swap. The items pass over the index in
    sets of bounded size, and no pair of an item and a document is listed unless its bound admits it.
    """
    spark = index.blocks.sparkSession
    small_batches(spark)
    id_type = items.schema["item_id"].dataType
    out = spark.createDataFrame([], T.StructType([T.StructField("item_id", id_type), *FOUND.fields[1:]]))
    for part in item_sets(items):
        wanted = Wanted.of(list(part.values()), index)
        if not len(wanted.vocabulary) or not index.documents:
            continue
        wanted.least = probe(index.blocks, store(best_bounds(index.blocks, wanted, PROBES * top)), wanted, top)
        names = F.broadcast(spark.createDataFrame(list(enumerate(part)), T.StructType([FOUND.fields[0], T.StructField("item_id", id_type)])))
        out = out.unionByName(survivors(index.blocks, wanted, top).join(names, "item").select("item_id", "doc_id", "score"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
