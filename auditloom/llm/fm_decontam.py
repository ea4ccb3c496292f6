"""Benchmark decontamination: an FM-index for each shard of documents answers the benchmark's windows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.common import add_columns, slices, small_batches, store, text_digest
from auditloom.llm.fm_index import FMIndex
from auditloom.llm.shingles import LOWER
from auditloom.llm.textarrays import Pieces, Texts, byte_table

#: Bytes of ASCII letters and digits and of all code points above 127.
ITEM_BYTES = byte_table(range(48, 58)) | byte_table(range(97, 123)) | byte_table(range(128, 256))
#: Bytes of text in a shard, and of benchmark text that is sent to the executors at a time.
SHARD_BYTES = 1 << 20
BLOCK_BYTES = 8 << 20


def item_pieces(texts: Texts) -> Pieces:
    """Words of texts; an upper-case letter counts as its lower-case one."""
    return texts.pieces(ITEM_BYTES[LOWER[texts.data]])


def words_of(texts: Texts) -> tuple[Pieces, np.ndarray]:
    """Words of lower-cased texts and their hashes."""
    words = item_pieces(texts)
    return words, texts.hashes(words, LOWER[texts.data])


@dataclass
class Phrases:
    """Distinct windows of a block of items, in symbols of the block's own vocabulary."""

    vocabulary: np.ndarray  # sorted word hashes; symbol k + 1 is vocabulary[k]
    patterns: np.ndarray
    lengths: np.ndarray
    marks: np.ndarray  # items of pattern i: items[marks[i]:marks[i + 1]]
    items: list

    @classmethod
    def of(cls, items: list[tuple], size: int) -> Phrases:
        words, hashes = words_of(Texts.of(pa.array([t for _, t in items], pa.string())))
        vocabulary, symbols = np.unique(hashes, return_inverse=True)
        found: dict[tuple, set] = {}
        for (item, _), a, b in zip(items, words.marks[:-1], words.marks[1:], strict=True):
            row = (symbols[a:b] + 1).tolist()
            for i in range(max(len(row) - size, 0) + 1 if row else 0):
                found.setdefault(tuple(row[i:i + size]), set()).add(item)
        patterns, lengths = np.zeros((len(found), size), np.int64), np.zeros(len(found), np.int64)
        marks, named = [0], []
        for k, (window, ids) in enumerate(found.items()):
            patterns[k, :len(window)], lengths[k] = window, len(window)
            named += sorted(i for i in ids if i is not None)
            marks.append(len(named))
        return cls(vocabulary, patterns, lengths, np.array(marks), named)


def shard_hits(texts: Texts, phrases: Phrases) -> tuple[dict[int, set], dict[int, list]]:
    """Items and merged spans [start, end) of words, for each text with an occurrence of a window.

    Words outside the vocabulary become separators, and stretches of known words shorter than
    the shortest window are left out of the index: no window can lie there.
    """
    words, hashes = words_of(texts)
    at = np.searchsorted(phrases.vocabulary, hashes)
    at[at == len(phrases.vocabulary)] = 0
    symbols = np.where(phrases.vocabulary[at] == hashes, at + 1, 0)
    owner = words.owner()
    run = np.cumsum(np.concatenate([[True], (symbols[1:] == 0) | (symbols[:-1] == 0) | (owner[1:] != owner[:-1])])) if len(symbols) else symbols
    long = np.flatnonzero((np.bincount(run)[run] >= phrases.lengths.min()) & (symbols > 0)) if len(symbols) else symbols
    if not len(long):
        return {}, {}
    # One separator between stretches; place maps index positions to words.
    gap = np.cumsum(np.concatenate([[0], run[long][1:] != run[long][:-1]]))
    line = np.zeros(len(long) + int(gap[-1]), np.int64)
    place = np.zeros(len(line), np.int64)
    line[np.arange(len(long)) + gap] = symbols[long]
    place[np.arange(len(long)) + gap] = long
    index = FMIndex(line, len(phrases.vocabulary))
    low, high = index.search(phrases.patterns, phrases.lengths)
    hit = np.flatnonzero(low < high)
    sizes = high[hit] - low[hit]
    rows = np.repeat(low[hit] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    pattern = np.repeat(hit, sizes)
    start = place[index.locate(rows)]
    text = owner[start]
    first = start - words.marks[text]
    items: dict[int, set] = {}
    for t, p in np.unique(np.column_stack([text, pattern]), axis=0).tolist() if len(text) else []:
        items.setdefault(t, set()).update(phrases.items[phrases.marks[p]:phrases.marks[p + 1]])
    spans: dict[int, list] = {}
    order = np.lexsort((first, text))
    for t, a, b in zip(text[order].tolist(), first[order].tolist(), (first + phrases.lengths[pattern])[order].tolist(), strict=True):
        have = spans.setdefault(t, [])
        if have and a <= have[-1][1]:
            have[-1][1] = max(have[-1][1], b)
        else:
            have.append([a, b])
    return items, spans


HITS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("digest", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])


def phrase_blocks(benchmark: DataFrame, size: int) -> Iterator[Phrases]:
    """The windows of the benchmark, in blocks of about BLOCK_BYTES of its text."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + total // BLOCK_BYTES
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        phrases = Phrases.of([tuple(r) for r in block.collect()], size)
        if len(phrases.lengths):
            yield phrases


def find_hits(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """(doc_id, digest, items, spans): a row for each document and block of items that meet.

    The benchmark passes in blocks, so that what is sent to the executors doesn't grow with it;
    every block meets all documents.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select("doc_id", "text").withColumn("digest", text_digest("text")[0])
    out = spark.createDataFrame([], HITS)
    for phrases in phrase_blocks(benchmark, size):
        sent = spark.sparkContext.broadcast(phrases)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text", SHARD_BYTES):
                    items, spans = shard_hits(Texts.of(part.column("text")), sent.value)
                    hit = sorted(spans)
                    yield pa.RecordBatch.from_arrays([
                        part.column("doc_id").take(pa.array(hit, pa.int64())), part.column("digest").take(pa.array(hit, pa.int64())),
                        pa.array([sorted(items.get(t, ())) for t in hit], pa.list_(pa.string())),
                        pa.array([[{"start": a, "end": b} for a, b in spans[t]] for t in hit], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    ], HITS.names)

        out = out.unionByName(store(rows.mapInArrow(run, HITS)))
    return out


def merged_hits(hits: DataFrame) -> DataFrame:
    """(id, key, items, n_hit): one row a document, blocks and overlapping spans merged."""
    words = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"] - 1)))
    return hits.groupBy(F.col("doc_id").alias("id"), F.col("digest").alias("key")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.size(F.array_distinct(F.flatten(F.collect_list(words)))).cast("long").alias("n_hit"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is ``size`` consecutive words of an item; an item of fewer words, but not none, is
    one window. Null texts have no words. Items without id count for n_hit only; rows that
    repeat an item_id are one item; rows that repeat a document get its result each; other
    columns are not used. Long texts are read whole; an empty benchmark hits nothing, and an empty
    table of documents gives an empty table.
    """
    found = merged_hits(find_hits(docs, benchmark, size))
    rows = docs.select("doc_id", "text", text_digest("text")[0].alias("digest"))
    rows = add_columns(rows, [T.StructField("n_words", T.LongType())], lambda t: [item_pieces(t).counts()]).drop("text")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("key"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return rows.join(found, same, "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The rows of ``docs`` without any occurrence of a window, with their columns only.

    Each block of the benchmark filters what the block before left: no text is shuffled. Null and
    empty texts stay; repeated rows stay or go each; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    for phrases in phrase_blocks(benchmark, size):
        sent = spark.sparkContext.broadcast(phrases)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text", SHARD_BYTES):
                    _, spans = shard_hits(Texts.of(part.column("text")), sent.value)
                    yield part.filter(pa.array([t not in spans for t in range(part.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
