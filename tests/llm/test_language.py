"""Dictionaries and sizes against zstandard itself, held-out accuracy, odd rows."""

import zlib

import pytest
import zstandard

from auditloom.llm import language_id
from auditloom.llm.language_id import Model, canonical, identify

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return language_id.fit(docs)


def plain_sizes(text, model):
    """Encode every block on its own, without anything shared between calls."""
    out = {}
    data = canonical(text)
    for lang, dictionary in model.dictionaries.items():
        known = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        size = 0
        for i in range(0, len(data), language_id.BLOCK_BYTES):
            known.precompute_compress(level=language_id.LEVEL)
            made = zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=known, write_content_size=False, write_dict_id=False)
            block = made.compress(data[i:i + language_id.BLOCK_BYTES])
            size += len(block)
            back = zstandard.ZstdDecompressor(dict_data=known).decompress(block, max_output_size=language_id.BLOCK_BYTES)
            assert back == data[i:i + language_id.BLOCK_BYTES]
        out[lang] = size
    return out


def test_learns_each_language_within_its_bounds(docs, model):
    assert set(model.dictionaries) == {"en", "de", "fr", "es"} and next(iter(model.dictionaries)) == "en"
    assert all(0 < len(d) <= language_id.DICTIONARY_BYTES * 1.01 for d in model.dictionaries.values())
    assert language_id.fit(docs).dictionaries == model.dictionaries


def test_held_out_rows_teach_nothing(docs, model):
    seen = docs.withColumn("text", language_id.F.when(language_id.held_out(), language_id.F.lit("völlig anders")).otherwise(language_id.F.col("text")))
    assert language_id.fit(seen).dictionaries == model.dictionaries


def test_predictions_are_the_smallest_sizes(docs, model):
    texts = {r.doc_id: r.text for r in docs.where("doc_id % 25 = 3").collect()}
    for r in identify(docs.where("doc_id % 25 = 3"), model).collect():
        sizes = plain_sizes(texts[r.doc_id], model)
        assert r.lang_pred == min(sizes, key=sizes.get) and 0 <= r.score <= 1
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_held_out_accuracy(docs, model):
    got = {r.doc_id: r for r in identify(docs, model).collect()}
    held = [(r.lang, got[r.doc_id]) for r in docs.collect() if r.lang and got[r.doc_id].held_out]
    assert len(held) > 200 and sum(lang == r.lang_pred for lang, r in held) >= 0.97 * len(held)
    sure = [(lang, r) for lang, r in held if r.accepted]
    assert sum(lang == r.lang_pred for lang, r in sure) >= 0.985 * len(sure)


def test_margin_rejects(docs, model):
    wide = identify(docs, model, margin=0.5).where("accepted").count()
    assert 0 <= wide < identify(docs, model, margin=0.0).where("accepted").count()


def test_odd_texts(spark, odd_docs, no_docs, model):
    rows = {(r.doc_id, r.lang_pred, round(r.score, 9)) for r in identify(odd_docs, model).collect()}
    assert identify(odd_docs, model).count() == odd_docs.count()
    by_text = {t: [x for x in rows if x[0] == i] for i, t in [(r.doc_id, r.text) for r in odd_docs.collect()] if i is not None and i != 3}
    for text in (None, "", " ", "#*$%&|<> ! |", "😀 😀 😀 😀"):
        assert [x[1:] for x in by_text[text]] == [("und", 0.0)]
    assert by_text["é"][0][1] in model.dictionaries
    assert identify(no_docs, model).count() == 0
    empty = language_id.fit(no_docs.selectExpr("doc_id", "text", "'x' AS lang"))
    assert not empty.dictionaries and {r.lang_pred for r in identify(odd_docs, empty).collect()} == {"und"}


def test_hot_copies_and_null_languages(spark):
    """Copies count once; null languages, ids and texts teach nothing; one long text and further columns do no harm."""
    rows = [(i, "hello there my friend", "en", 1) for i in range(2_000)] + [(5_000 + i, f"wort{i} über dem baum", "de", 1) for i in range(50)]
    rows += [(9_000, None, "de", 1), (9_001, "und noch", None, 1), (None, "kein", "de", 1), (9_003, "lang " * 100_000, "de", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = language_id.fit(frame, size=1 << 12)
    assert list(model.dictionaries) == ["en", "de"] and len(model.dictionaries["en"]) < 40
    assert all(len(d) <= (1 << 12) + 16 for d in model.dictionaries.values())
    got = {r.doc_id: r.lang_pred for r in identify(frame, model).collect()}
    assert got[0] == "en" and got[5_001] == "de"
    with pytest.raises(ValueError):
        language_id.fit(frame, languages=1)
