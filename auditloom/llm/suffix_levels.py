"""Repeated passages: a logarithmic family of sparse suffix arrays, merge-scanned batch by batch.

Every string of LENGTH bytes holds an anchor: the first position with the least hash of a GRAM in
its first REACH positions. Anchors depend on nothing but the string, so equal strings have equal
anchors, and from an anchor on they share LENGTH - REACH + 1 bytes (the depth) at least. A suffix array therefore needs the
suffixes at anchors only, in the order of that many bytes: eight bytes as they are, then a
fingerprint of all. Suffixes that meet in a merge scan are exact candidates: no repeated string is
missed. The exact check compares, for these anchors, blocks of windows and then, where a block is
neither repeated as a whole nor free of repeats, single windows, by 64-bit hashes that Spark counts.

Passages of words go the same way: a text is then the sequence of its words' hashes, a string is
WORDS of them in a row, and what counts is that another text has it too. Both laws share the
arrays, the levels and the exact check.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.common import drop_table, slices, small_batches, store, text_digest, write_table
from auditloom.llm.textarrays import BASE, BYTE_VALUES, INVERSE, Texts, mix, powers

#: Bytes of a string that counts as repeated, positions an anchor may have in it, bytes hashed for choosing it.
LENGTH, REACH, GRAM = 400, 177, 24
#: Words of a passage that counts as shared: more than 50.
WORDS = 51
#: Windows in a block.
BLOCK = 32
#: Batches a table is indexed in; batch sizes are equal, so levels merge like binary counting.
BATCHES = 4
#: Partitions that equal beginnings are dealt to.
SPLIT = 16
#: A position in a key that holds hash and position; longer texts are read in overlapping parts.
PLACE_BITS = 22

ARRAY = "head long, print long, node long, at long, low int, high int, law int"


class Law(NamedTuple):
    """What a string is: ``length`` units, an anchor in its first ``reach``, chosen by ``gram`` of them."""

    number: int
    length: int
    reach: int
    gram: int

    @property
    def depth(self) -> int:
        """Units that equal strings share from their anchor on."""
        return self.length - self.reach + 1


#: Passages of words: an anchor in the first 44 of 51 words, chosen by three of them.
IN_BYTES, IN_WORDS = Law(0, LENGTH, REACH, GRAM), Law(1, WORDS, 44, 3)


class Hasher:
    """Hashes of substrings of one text, given as bytes or as hashes of words."""

    def __init__(self, data: np.ndarray) -> None:
        self.data, self.inverse = data, powers(INVERSE, len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        values = BYTE_VALUES[data] if data.dtype == np.uint8 else data
        np.cumsum(values * powers(BASE, len(data)), out=self.total[1:])

    def part(self, start: int, end: int) -> Hasher:
        """The hasher of data[start:end]; equal substrings keep equal hashes."""
        part = object.__new__(Hasher)
        part.data, part.inverse, part.total = self.data[start:end], self.inverse[start:end + 1], self.total[start:end + 1]
        return part

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.total[ends] - self.total[starts]) * self.inverse[starts])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, hasher: Hasher, law: Law = IN_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, first window, last window) of each anchor; window starts that share it are consecutive."""
    windows = len(data) - law.length + 1
    if windows <= 0:
        return (np.zeros(0, np.int64),) * 3
    part = (1 << PLACE_BITS) - law.length
    chosen = []
    for begin in range(0, windows, part):
        end = min(begin + part, windows)
        at = np.arange(begin, end - 1 + law.reach)
        key = hasher.of(at, at + law.gram) >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS) | (at - begin).astype(np.uint64)
        chosen.append((sliding_min(key, law.reach) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64) + begin)
    anchor = np.concatenate(chosen)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    return anchor[first], first, np.append(first[1:], windows) - 1


def blocks(hasher: Hasher, at: np.ndarray, low: np.ndarray, high: np.ndarray, law: Law = IN_BYTES) -> dict[str, np.ndarray]:
    """The blocks of windows of the given anchors.

    Block j of an anchor has the windows that begin 32 j to 32 j + 31 bytes before it. ``core`` is
    the hash of what all of them share, ``whole`` of what all that lie in the text cover.
    """
    first, last = (at - high) // BLOCK, (at - low) // BLOCK
    n = last - first + 1
    k = np.repeat(np.arange(len(at)), n)
    j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[k]
    a, b = at[k] - BLOCK * j - BLOCK + 1, at[k] - BLOCK * j
    core = mix(hasher.of(np.maximum(b, 0), a + law.length) + j.astype(np.uint64))
    left, right = np.maximum(a, 0), np.minimum(b, len(hasher.data) - law.length)
    clip = ((left - a) * BLOCK + (b - right)).astype(np.uint64)
    whole = mix(hasher.of(left, right + law.length) + core + clip)
    return {"core": core.view(np.int64), "whole": whole.view(np.int64), "at": at[k], "low": low[k], "high": high[k],
            "j": j, "first": left, "last": right}


def lists(column: pa.ListArray, names: list[str]) -> Iterator[list[np.ndarray]]:
    """The fields of each row's list of structs as arrays."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    marks, values = column.offsets.to_numpy(), column.values
    fields = [values.field(n).to_numpy(zero_copy_only=False) for n in names]
    for a, b in zip(marks[:-1], marks[1:], strict=True):
        yield [f[a:b] for f in fields]


def bytes_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    texts = Texts.of(batch.column("text"))
    return [texts.data[a:b] for a, b in zip(texts.offsets[:-1], texts.offsets[1:], strict=True)]


def hashers(batch: pa.RecordBatch, laws: tuple[Law, ...]) -> dict[Law, list[Hasher]]:
    """For each law the hasher of each text: of its bytes, or of the hashes of its words."""
    texts = Texts.of(batch.column("text"))
    whole, out = Hasher(texts.data), {}
    for law in laws:
        over, marks = whole, texts.offsets
        if law == IN_WORDS:
            words = texts.words()
            over, marks = Hasher(whole.of(words.starts, words.ends)), words.marks
        out[law] = [over.part(a, b) for a, b in zip(marks[:-1].tolist(), marks[1:].tolist(), strict=True)]
    return out


def emit(rows: list[list[np.ndarray]], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = [np.concatenate(c) if c else np.zeros(0) for c in (zip(*rows, strict=True) if rows else [[] for _ in kinds])]
    return pa.RecordBatch.from_arrays([pa.array(c, kind, safe=False) if len(c) else pa.array([], kind) for c, (_, kind) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])


def suffix_arrays(texts: DataFrame, laws: tuple[Law, ...] = (IN_BYTES,)) -> DataFrame:
    """ARRAY rows of the anchors of ``texts(node, text)``; a passage of words begins with its first word's hash."""
    kinds = [("head", pa.int64()), ("print", pa.int64()), ("node", pa.int64()), ("at", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("law", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for law, over in hashers(part, laws).items():
                    for node, hasher in zip(part.column("node").to_pylist(), over, strict=True):
                        data = hasher.data
                        at, low, high = anchors(data, hasher, law)
                        if len(at):
                            if law == IN_BYTES:
                                eight = np.lib.stride_tricks.sliding_window_view(data, 8)[at]
                                head = np.ascontiguousarray(eight).view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)
                            else:
                                head = data[at]
                            rows.append([head.view(np.int64), hasher.of(at, at + law.depth).view(np.int64), np.full(len(at), node), at, low - at, high - at, np.full(len(at), law.number)])
                yield emit(rows, kinds)

    return texts.mapInArrow(run, ARRAY)


class Levels:
    """Suffix arrays in the shared folder; level k holds 2^k batches."""

    def __init__(self, spark) -> None:
        self.spark = spark
        self.paths: dict[int, list[str]] = {}
        self.matches: list[DataFrame] = []

    def files(self) -> list[str]:
        return [path for level in self.paths.values() for path in level]

    def read(self, path: str) -> DataFrame:
        return self.spark.read.schema(ARRAY).parquet(path)

    @staticmethod
    def in_order(rows: DataFrame) -> DataFrame:
        """Each partition is sorted, without repeated rows; suffixes that share their law's depth meet in SPLIT partitions at most.

        A passage that very many texts share would otherwise fill one partition.
        """
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.withColumn("split", F.pmod("node", F.lit(SPLIT))).repartition(parts, "head", "print", "split")
        # Equal rows are in one partition already: no second shuffle.
        return dealt.distinct().sortWithinPartitions("head", "print").drop("split")

    def insert(self, batch: DataFrame) -> None:
        """Index a batch: merge levels of equal size, sort the batch, scan it against every level."""
        self.merge()
        path = write_table(self.in_order(batch))
        rows = self.read(path).withColumn("new", F.lit(1))
        for level in self.files():
            rows = rows.unionByName(self.read(level).withColumn("new", F.lit(0)))
        keys = rows.groupBy("head", "print").agg(
            F.count("*").alias("n"), F.max("new").alias("new"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.max("law").alias("law"))
        found = keys.where(f"new = 1 and n > 1 and (law = {IN_BYTES.number} or lo < hi)")
        self.matches.append(store(found.select("head", "print")))
        self.paths.setdefault(0, []).append(path)

    def merge(self) -> None:
        """Make one level of two of equal size, smallest first; the last batch needs none after it."""
        size = 0
        while len(self.paths.get(size, [])) > 1:
            pair = self.paths.pop(size)
            merged = write_table(self.in_order(self.read(pair[0]).unionByName(self.read(pair[1]))))
            for path in pair:
                drop_table(self.spark, path)
            size += 1
            self.paths.setdefault(size, []).append(merged)

    def suffixes(self) -> DataFrame:
        """All suffixes that match another."""
        rows = self.spark.createDataFrame([], ARRAY)
        for path in self.files():
            rows = rows.unionByName(self.read(path))
        keys = self.matches[0]
        for more in self.matches[1:]:
            keys = keys.unionByName(more)
        # Stored first: a join of plain tables can split a key that very many suffixes share.
        return rows.join(store(keys.distinct()), ["head", "print"], "left_semi")

    def drop(self) -> None:
        for path in self.files():
            drop_table(self.spark, path)


def block_rows(marked: DataFrame, laws: tuple[Law, ...] = (IN_BYTES,)) -> DataFrame:
    """The blocks of ``marked(node, text, weight, anchors)``."""
    kinds = [(n, pa.int64()) for n in ("core", "whole", "node", "weight", "at", "low", "high", "j", "first", "last", "law")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for law, over in hashers(part, laws).items():
                    lead = zip(part.column("node").to_pylist(), part.column("weight").to_pylist(), over, lists(part.column("anchors"), ["at", "low", "high", "law"]), strict=True)
                    for node, weight, hasher, (at, low, high, kind) in lead:
                        mine = kind == law.number
                        if mine.any():
                            at, low, high = at[mine], low[mine], high[mine]
                            found = blocks(hasher, at, at + low, at + high, law)
                            n = len(found["core"])
                            found |= {"node": np.full(n, node), "weight": np.full(n, weight), "law": np.full(n, law.number)}
                            rows.append([found[k] for k, _ in kinds])
                yield emit(rows, kinds)

    return marked.mapInArrow(run, ", ".join(f"{n} long" for n, _ in kinds))


def window_rows(marked: DataFrame, laws: tuple[Law, ...] = (IN_BYTES,)) -> DataFrame:
    """(window, node, weight, at, law): each window of ``marked(node, text, ranges)`` where ranges have first, last, weight, law."""
    kinds = [("window", pa.int64()), ("node", pa.int64()), ("weight", pa.int64()), ("at", pa.int64()), ("law", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for law, over in hashers(part, laws).items():
                    for node, hasher, (first, last, weight, kind) in zip(part.column("node").to_pylist(), over, lists(part.column("ranges"), ["first", "last", "weight", "law"]), strict=True):
                        mine = kind == law.number
                        if mine.any():
                            first, weight = first[mine], weight[mine]
                            n = last[mine] - first + 1
                            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
                            rows.append([hasher.of(at, at + law.length).view(np.int64), np.full(len(at), node), np.repeat(weight, n), at, np.full(len(at), law.number)])
                yield emit(rows, kinds)

    return marked.mapInArrow(run, ", ".join(f"{n} long" for n, _ in kinds))


def removal(data: bytes, first: np.ndarray, last: np.ndarray) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal removed runs of bytes, and what is left, for ranges of window starts."""
    runs: list[list[int]] = []
    for a, b in sorted(zip(first.tolist(), (last + LENGTH).tolist(), strict=True)):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    left, end = [], 0
    for a, b in runs:
        left.append(data[end:a])
        end = b
    return [(a, b) for a, b in runs], b"".join([*left, data[end:]])


def covered(first: np.ndarray, last: np.ndarray, length: int) -> int:
    """Units that the strings of ``length`` units in ranges of window starts cover."""
    n = end = 0
    for a, b in sorted(zip(first.tolist(), (last + length).tolist(), strict=True)):
        n += max(0, b - max(a, end))
        end = max(end, b)
    return n


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def repeated_spans(docs: DataFrame, batches: int = BATCHES, words: bool = False) -> DataFrame:
    """A row for each distinct text with removed bytes or, with ``words``, shared words; a, b are its digest.

    Columns: a, b, n_removed, n_spans, kept_sha256, spans, n_shared_words, whole; of texts that occur twice,
    which are ``whole``, only the words are counted.
    """
    spark = docs.sparkSession
    small_batches(spark)
    laws = (IN_BYTES, IN_WORDS) if words else (IN_BYTES,)
    a, b = text_digest("text")
    # WORDS words take so many bytes at least.
    least = min(LENGTH, 2 * WORDS - 1) if words else LENGTH
    long = docs.select("text").where(F.octet_length("text") >= least).withColumns({"a": a, "b": b})
    # A text that occurs twice is removed whole; once it stays as a partner of others.
    weights = store(long.groupBy("a", "b").agg(F.count("*").alias("weight")))
    # Equal texts are in one batch; digests of whole texts are then made for that batch only.
    batch = F.pmod(F.xxhash64(F.octet_length("text"), F.substring("text", 1, 64)), F.lit(batches))
    keyed = long.select(F.xxhash64("a", "b").alias("node"), "text", batch.alias("batch"), "a", "b")
    levels = Levels(spark)
    for k in range(batches):
        # Equal texts give equal suffixes with equal positions: one of each is indexed.
        levels.insert(suffix_arrays(keyed.where(F.col("batch") == k).select("node", "text"), laws))
    found = store(levels.suffixes().select("node", "at", "low", "high", "law"))
    levels.drop()
    per_text = found.groupBy(F.col("node").alias("n")).agg(F.collect_list(F.struct("at", "low", "high", "law")).alias("anchors"))
    weight = weights.select(F.xxhash64("a", "b").alias("w"), "weight")
    if words:
        # The words of a text that occurs twice are shared whatever its anchors; counting them takes its text.
        none = F.array().cast("array<struct<at:bigint,low:int,high:int,law:int>>")
        per_text = weight.join(per_text, F.col("n") == F.col("w"), "left").where("weight > 1 or n is not null").select(
            F.col("w").alias("n"), F.coalesce("anchors", none).alias("anchors"), "weight")
    else:
        per_text = per_text.join(weight, F.col("n") == F.col("w")).drop("w")
    texts = keyed.join(per_text, F.col("node") == F.col("n")).select("node", "a", "b", "text", "weight", "anchors")
    # Which of several equal rows stays doesn't matter; the long columns aren't part of the key.
    marked = store(texts.dropDuplicates(["node"]))
    rows = store(block_rows(marked, laws))

    # Bytes are repeated if their string begins anywhere else, words are shared if another text has their passage.
    many = F.when(F.col("law") == IN_BYTES.number, F.col("total") > 1).otherwise((F.col("lo") < F.col("hi")) | (F.col("most") > 1))
    count = [F.sum("weight").alias("total"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.max("weight").alias("most"), F.max("law").alias("law")]
    sums = rows.groupBy("core", "whole").agg(*count, F.min(F.struct("node", "at", "j")).alias("lead")).withColumn("many", many)
    cores = sums.groupBy(F.col("core").alias("c")).agg(F.count("*").alias("kinds"))
    sums = sums.join(cores, F.col("core") == F.col("c")).select(
        F.col("core").alias("x"), F.col("whole").alias("y"), "many", "lead", "kinds").where("many or kinds > 1")
    judged = store(rows.join(sums, (F.col("core") == F.col("x")) & (F.col("whole") == F.col("y"))).select(
        "node", "at", "low", "high", "j", "first", "last", "many", "law",
        ((F.col("kinds") > 1) & (~F.col("many") | (F.col("lead") == F.struct("node", "at", "j")))).alias("open"),
    ))
    sure = judged.where("many").select("node", "first", "last", "law")
    own_first = F.greatest("low", F.col("at") - BLOCK * F.col("j") - (BLOCK - 1))
    own_last = F.least("high", F.col("at") - BLOCK * F.col("j"))
    ranges = judged.where("open").select(
        F.col("node").alias("n"), F.struct(
            own_first.alias("first"), own_last.alias("last"), F.when(F.col("many"), F.lit(2)).otherwise(F.lit(1)).alias("weight"), "law").alias("r"))
    ranges = ranges.groupBy("n").agg(F.collect_list("r").alias("ranges"))
    windows = store(window_rows(marked.select("node", "text").join(ranges, F.col("node") == F.col("n")).select("node", "text", "ranges"), laws))
    twice = windows.groupBy(F.col("window").alias("w")).agg(*count).where(many).select("w")
    single = windows.where("weight = 1").join(twice, F.col("window") == F.col("w")).select("node", F.col("at").alias("first"), F.col("at").alias("last"), "law")
    starts = sure.unionByName(single).groupBy(F.col("node").alias("n")).agg(F.collect_list(F.struct("first", "last", "law")).alias("ranges"))
    cut = marked.where("weight = 1").select("node", "a", "b", "text").join(starts, F.col("node") == F.col("n")).select("a", "b", "text", "ranges")

    schema = T.StructType([
        T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("spans", SPANS),
        T.StructField("n_shared_words", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, (first, last, law) in zip(bytes_of(batch), lists(batch.column("ranges"), ["first", "last", "law"]), strict=True):
                mine = law == IN_BYTES.number
                spans, kept = removal(data.tobytes(), first[mine], last[mine])
                n_words = covered(first[~mine], last[~mine], WORDS)
                out.append((len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": s, "end": e} for s, e in spans], n_words))
            cols = list(zip(*out, strict=True)) if out else [[], [], [], [], []]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], schema.names)

    none = F.lit(None)
    copies = weights.where("weight > 1").select("a", "b", none.cast("long").alias("n"))
    if words:
        n = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
        copies = marked.where("weight > 1").select("a", "b", F.when(n >= WORDS, n).otherwise(0).cast("long").alias("n"))
    return cut.mapInArrow(run, schema).withColumn("whole", F.lit(False)).unionByName(copies.select(
        "a", "b", none.cast("long").alias("n_removed"), none.cast("long").alias("n_spans"), none.cast("string").alias("kept_sha256"),
        none.cast(SPANS).alias("spans"), F.col("n").alias("n_shared_words"), F.lit(True).alias("whole")))


def repeated_passages(docs: DataFrame, batches: int = BATCHES, words: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans; with ``words`` n_shared_words too.

    A byte is removed if a string of LENGTH bytes that covers it begins anywhere else in the
    table too, in the same text included. A word (of any bytes but ASCII white space) is shared if
    a passage of WORDS words that covers it stands in another document too, whatever its length
    in bytes and the space between the words; shared words are counted, not removed. Texts are
    judged as they came in; null counts as empty; rows that repeat a text are separate documents;
    other columns are not used. Long texts are read whole; an empty table gives an empty table.
    """
    a, b = text_digest("text")
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = docs.select(
        "doc_id", a.alias("ra"), b.alias("rb"), n_bytes.alias("n_bytes"),
        F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("own"))
    found = store(repeated_spans(docs, batches, words))
    whole = F.coalesce("whole", F.lit(False)) & (F.col("n_bytes") >= LENGTH)
    out = rows.join(found, (F.col("ra") == F.col("a")) & (F.col("rb") == F.col("b")), "left").select(
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "own")).alias("kept_sha256"),
        F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))).otherwise(
            F.coalesce("spans", F.array().cast(SPANS))).alias("spans"),
        F.coalesce("n_shared_words", F.lit(0)).cast("long").alias("n_shared_words"),
    )
    return out if words else out.drop("n_shared_words")
