"""The FM-index against plain search; contamination against plain windows."""

import hashlib
import random
import re

import numpy as np
import pytest

from auditloom.llm import fm_decontam
from auditloom.llm.fm_index import FMIndex, WaveletMatrix, suffix_array


@pytest.mark.parametrize("seed", range(6))
def test_index_finds_all_occurrences(seed):
    rng = np.random.default_rng(seed)
    top = [1, 2, 3, 8, 40, 100][seed]
    line = rng.integers(0, top + 1, 500)
    assert suffix_array(line).tolist() == sorted(range(500), key=lambda i: line[i:].tolist())
    wavelet = WaveletMatrix(line, top)
    for c in range(top + 1):
        at = np.arange(501)
        assert wavelet.rank(np.full(501, c), at).tolist() == [0, *np.cumsum(line == c).tolist()]
    index = FMIndex(line, top, sample=5)
    patterns = np.zeros((60, 4), np.int64)
    lengths = rng.integers(1, 5, 60)
    for k, n in enumerate(lengths):
        patterns[k, :n] = rng.integers(1, top + 1, n)
    low, high = index.search(patterns, lengths)
    for k, n in enumerate(lengths):
        want = [i for i in range(500 - n + 1) if (line[i:i + n] == patterns[k, :n]).all()]
        assert sorted(index.locate(np.arange(low[k], high[k])).tolist()) == want if want else low[k] >= high[k]


def item_words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def plain(docs, items, size=10):
    windows = {}
    for i, t in items:
        w = item_words(t)
        for k in range(max(len(w) - size, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[k:k + size]), set()).add(i)
    lengths = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w, hit, found = item_words(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                ids = windows.get(tuple(w[k:k + n]))
                if ids:
                    hit |= set(range(k, k + n))
                    found |= ids
        ids = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(docs, benchmark):
    return sorted((tuple(r) for r in fm_decontam.contamination(docs, benchmark).collect()), key=str)


def test_documents(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "benchmark"))
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in items.collect()])
    assert run(docs, items) == want and sum(r[5] for r in want) > 10


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_planted_windows_and_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(fm_decontam, "BLOCK_BYTES", block)
    rng = random.Random(2)
    vocabulary = ["a", "b", "Ça", "dé", "x1"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 9, 10, 11, 14])))) for i in range(5, 17)]
    items = [(i, t) for i, t in items if len(t.split()) > 2] + [(3, items[0][1] + " b b a Ça x1 dé dé a a"), (3, None), (None, "a dé a dé x1 x1 x1"), (4, ""), (40, "zz ; !")]
    docs = []
    for d in range(200):
        words = [rng.choice([*vocabulary, "other"]) for _ in range(rng.randrange(60))]
        if d % 3 == 0:
            words[rng.randrange(len(words) + 1):0] = (rng.choice(items)[1] or "").split()
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(words).upper() if d % 2 else " ".join(words)))
    docs += [(None, "a dé a dé x1 x1 x1"), (7, None), (8, ""), (9, docs[9][1])]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert run(table, spark.createDataFrame(items, "item_id long, text string")) == plain(docs, items)


def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "日本"), (3, None)], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert run(odd_docs, items) == plain(rows, [tuple(r) for r in items.collect()])
    assert run(no_docs, items) == []
    assert not any(r[5] for r in run(odd_docs, items.limit(0)))
    kept = fm_decontam.clean(odd_docs, items)
    assert kept.columns == odd_docs.columns and kept.count() == len(rows) - sum(r[5] for r in run(odd_docs, items))
