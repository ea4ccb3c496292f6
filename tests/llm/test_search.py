"""Ranked search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from auditloom.llm import bit_slices
from auditloom.llm.bit_slices import Block, Wanted, build, search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWERED))


def plain(docs, items, top=50):
    counted = [(i, Counter(words(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    many, terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(words(text))
    out = []
    for item, ts in asked.items():
        found = []
        for i, c, n in counted:
            m = 50 + (50 * n * many) // terms
            score = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts & c.keys())
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def got(spark, docs, items, top=50):
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS terms", "'x' AS item", "2L AS score")
    asked = spark.createDataFrame(items, "item_id string, text string").selectExpr("*", "1 AS rank")
    return sorted((tuple(r) for r in search(build(frame), asked, top).collect()), key=str)


def corpus(seed, n, vocabulary=60):
    rng = random.Random(seed)
    pick = lambda: f"w{int(rng.paretovariate(0.7)) % vocabulary}"
    return [(i, " ".join(pick() for _ in range(rng.choice([1, 5, 30, 400])))) for i in range(n)], [(str(i), " ".join(pick() for _ in range(6))) for i in range(12)]


@pytest.mark.parametrize("seed", range(2))
def test_random_corpora(spark, seed, monkeypatch):
    docs, items = corpus(seed, 300)
    assert got(spark, docs, items, 7) == plain(docs, items, 7)


def test_sets_of_items_and_copies(spark, monkeypatch):
    """Items pass in several sets; ties among many copies rank by id."""
    monkeypatch.setattr(bit_slices, "ITEMS", 5)
    docs, items = corpus(5, 150)
    docs += [(1000 - k, "w1 w2 w3 rare rare") for k in range(300)]
    items += [("t", "rare w3"), ("t", "W1"), (None, "w2 Rare"), ("empty", ""), ("none", None), ("absent", "zzz")]
    assert got(spark, docs, items, 20) == plain(docs, items, 20)


def test_odd_texts(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    items = [("a", "the cat sat"), ("b", "é 日本 語 x"), ("c", "word one a xx"), ("d", "null id same")]
    asked = spark.createDataFrame(items, "item_id string, text string")
    assert sorted((tuple(r) for r in search(build(odd_docs), asked).collect()), key=str) == plain(rows, items)
    assert search(build(no_docs), asked).count() == 0
    assert search(build(odd_docs), asked.limit(0)).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert sorted((tuple(r) for r in search(build(docs), items).collect()), key=str) == want


def test_bounds_are_never_below_scores():
    """Signatures overestimate: every bound is at least the exact score, and few are far above."""
    docs, items = corpus(9, 400, vocabulary=3_000)
    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "text": t} for i, t in docs])
    rows = [r for b in bit_slices._index(iter([batch])) for r in b.to_pylist()]
    assert sorted(i for r in rows for i in r["doc_id"]) == sorted(i for i, t in docs if words(t))
    keys = bit_slices.term_counts(bit_slices.Texts.of(pa.array([t for _, t in items])))
    vocabulary, symbol = np.unique(keys[1], return_inverse=True)
    wanted = Wanted(vocabulary, symbol, np.searchsorted(keys[0], np.arange(len(items) + 1)), np.full(len(vocabulary), 700), np.ones(len(items), np.int64), 400, 40_000)
    loose = total = 0
    for r in rows:
        block = Block.of(r["terms"], r["width"], r["slices"], r["vocabulary"])
        bounds = np.concatenate([b for _, b in block.bounds(wanted)], axis=1)
        scores = np.concatenate([s for _, s in bit_slices.exact(pa.array(r["text"]), block.sizes, wanted)], axis=1)
        assert (bounds >= scores).all()
        loose, total = loose + int((bounds > 1.5 * scores + 1).sum()), total + bounds.size
    assert loose < 0.3 * total
