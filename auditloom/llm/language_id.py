"""Language identification by compression: the language whose dictionary makes a text smallest.

Every language has a zstandard raw-content dictionary of pieces of its labelled texts. A text is
encoded once with each dictionary, in blocks that know nothing of each other, so that a text's own
repetitions don't hide the dictionary and memory doesn't grow with the text. All of its blocks count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.common import small_batches

#: Bounds of the training sample: distinct texts of a language, bytes of its dictionary, and languages.
SAMPLE_TEXTS = 2_000
DICTIONARY_BYTES = 1 << 18
MOST_LANGUAGES = 512
PIECE_BYTES = 256
BLOCK_BYTES = 2_048
LEVEL = 3
#: A winner that saves less than this share of the runner-up's bytes is rejected.
MARGIN = 0.01
#: Bytes saved that multiply the odds of a language by e.
SCALE = 2.0
UNKNOWN = "und"

#: ASCII without letters becomes blanks; other bytes stay.
BLANKED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def canonical(text: str) -> bytes:
    """Lower-cased words with a blank between; ASCII characters that aren't letters part words.

    Equal words in a row count once: they would be encoded as their own copies in any language.
    """
    words = text.lower().encode("utf-8", "replace").translate(BLANKED).split()
    return b" ".join(w for k, w in enumerate(words) if not k or w != words[k - 1])


def pieces(data: bytes, size: int = PIECE_BYTES) -> list[bytes]:
    """The whole data in parts of ``size`` bytes, the last one shorter."""
    return [data[i:i + size] for i in range(0, len(data), size)]


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows that no dictionary may learn from; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    """Dictionaries by language, those with most labelled rows first."""

    dictionaries: dict[str, bytes] = field(default_factory=dict)

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for data in self.dictionaries.values():
            known = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False))
        return out


def sizes(text: str, compressors: list[zstandard.ZstdCompressor]) -> list[int]:
    """Bytes of the whole text under each dictionary."""
    blocks = pieces(canonical(text), BLOCK_BYTES)
    return [sum(len(c.compress(b)) for b in blocks) for c in compressors]


def decide(encoded: list[int]) -> tuple[int, float, float]:
    """Index of the smallest size (the first of equal ones), its probability, and its margin."""
    found = np.array(encoded, float)
    best = int(found.argmin())
    score = 1.0 / float(np.exp((found[best] - found) / SCALE).sum())
    others = np.delete(found, best)
    return best, score, float((others.min() - found[best]) / others.min()) if len(others) else 1.0


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            made = sorted(set(pieces(canonical(text.as_py()))))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(made), pa.string()), pa.array(made, pa.binary())], ["lang", "piece"])


def fit(
    docs: DataFrame, texts: int = SAMPLE_TEXTS, size: int = DICTIONARY_BYTES, languages: int = MOST_LANGUAGES,
) -> Model:
    """Dictionaries from rows of ``docs(doc_id, text, lang)`` that aren't held out and have a language.

    The sample is bounded: of each language the ``texts`` distinct texts with the least hashes, of
    their pieces ``size`` bytes, again by least hash. Copies count once, so no group of copies fills
    a dictionary. Null or empty texts teach nothing; a language with no text has no dictionary; an
    empty table gives an empty model. More than ``languages`` languages are an error, not a cut.
    """
    small_batches(docs.sparkSession)
    known = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "lang", "text", F.xxhash64("text").alias("h"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages + 1).collect()
    if len(counts) > languages:
        raise ValueError(f"more than {languages} languages")
    least = Window.partitionBy("lang").orderBy("h")
    chosen = known.select("lang", "h").distinct().withColumn("k", F.row_number().over(least)).where(F.col("k") <= texts)
    # At most ``languages`` times ``texts`` rows: no text is shuffled to find the chosen ones, and each
    # task keeps one of the copies that it has seen.
    sample = known.join(F.broadcast(chosen.select("lang", "h")), ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.first("text").alias("text"))
    cut = sample.select("lang", "text").mapInArrow(_cut_texts, "lang string, piece binary").distinct()
    first = Window.partitionBy("lang").orderBy(F.xxhash64("piece"), "piece")
    kept = cut.withColumn("k", F.row_number().over(first)).where(F.col("k") <= size // PIECE_BYTES)
    parts: dict[str, list] = {}
    # At most ``languages`` times ``size`` bytes.
    for row in kept.collect():
        parts.setdefault(row.lang, []).append((row.k, bytes(row.piece)))
    return Model({r.lang: b" ".join(p for _, p in sorted(parts[r.lang])) for r in counts if r.lang in parts})


RESULT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType()), T.StructField("accepted", T.BooleanType()),
])


def identify(docs: DataFrame, model: Model, margin: float = MARGIN) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, margin, accepted) for each row of ``docs``.

    ``lang_pred`` is the best language, ``score`` its probability, and ``accepted`` tells if it
    saves at least ``margin`` of the runner-up's bytes; a caller who wants no guesses reads the
    accepted rows. Equal sizes go to the language with more labelled rows. Null texts and texts
    without a letter, and all texts under an empty model, are ``und`` with score 0, not accepted.
    Whole texts are encoded, however long; repeated rows get a row each; an empty table gives no
    rows; further columns of ``docs`` are not read.
    """
    small_batches(docs.sparkSession)
    names = list(model.dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for batch in batches:
            found = []
            for text in batch.column("text"):
                text = text.as_py()
                if text is None or not names or not any(map(str.isalpha, text)):
                    found.append((UNKNOWN, 0.0, 0.0, False))
                    continue
                best, score, lead = decide(sizes(text, compressors))
                found.append((names[best], score, lead, lead >= margin))
            columns = list(zip(*found, strict=True)) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out")]
                + [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.float64(), pa.bool_()), strict=True)],
                RESULT.names,
            )

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(run, RESULT)
