"""Repeated passages against a plain search of all 400-byte strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from auditloom.llm import suffix_levels
from auditloom.llm.suffix_levels import LENGTH, Hasher, anchors


def plain(rows):
    data = [(d, (t or "").encode()) for d, t in rows]
    many = Counter()
    for _, x in data:
        many.update(hash(x[i:i + LENGTH]) for i in range(len(x) - LENGTH + 1))
    out = []
    for d, x in data:
        gone = np.zeros(len(x) + 1, bool)
        end = 0
        for i in range(len(x) - LENGTH + 1):
            if many[hash(x[i:i + LENGTH])] > 1:
                gone[max(i, end):i + LENGTH] = True
                end = i + LENGTH
        kept = bytes(b for b, g in zip(x, gone, strict=False) if not g)
        n_spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(x) else 0
        out.append((d, len(x), int(gone[:-1].sum()), n_spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(docs):
    return sorted((tuple(r) for r in suffix_levels.repeated_passages(docs).drop("spans").collect()), key=str)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    assert run(docs) == want and sum(r[2] > 0 for r in want) > 5


def prose(rng, n):
    return "".join(rng.choice("abcdeé \n") for _ in range(n))


@pytest.mark.parametrize("seed", range(3))
def test_planted_passages(spark, seed):
    rng = random.Random(seed)
    shared = [prose(rng, n) for n in (330, 395, 399, 400, 401, 420, 600, 1500)]
    rows = []
    for d in range(70):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            s = rng.choice(shared)
            a, b = sorted((rng.randrange(len(s)), rng.randrange(len(s)))) if rng.random() < 0.5 else (0, len(s))
            parts += [prose(rng, rng.choice([0, 1, 30, 200])), s[a:b]]
        rows.append((d, "".join([*parts, prose(rng, rng.choice([0, 50]))])))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, rows[5][1][:-1]), (103, "z" * 401), (104, "y" * 400), (105, "ab" * 400), (106, "x" * 399)]
    assert run(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == plain(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text if r.text is None or len(r.text) < 10_000 else r.text[:3000]) for r in odd_docs.collect()]
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)
    assert run(no_docs) == []
    assert suffix_levels.repeated_passages(odd_docs).where("n_bytes > 100000").first().n_removed == 200_000


def test_anchors_depend_on_the_string_only():
    rng = np.random.default_rng(4)
    inner = rng.integers(0, 3, 400).astype(np.uint8)
    found = set()
    for k in range(20):
        data = np.concatenate([rng.integers(0, 3, 37 * k), inner, rng.integers(0, 3, 11 * k)]).astype(np.uint8)
        at, low, high = anchors(data, Hasher(data))
        start = 37 * k
        mine = (low <= start) & (start <= high)
        assert mine.sum() == 1 and 0 <= at[mine][0] - start < suffix_levels.REACH
        found.add(int(at[mine][0] - start))
    assert len(found) == 1


def test_long_texts_are_read_in_parts(monkeypatch):
    rng = np.random.default_rng(5)
    data = rng.integers(0, 4, 9000).astype(np.uint8)
    whole = anchors(data, Hasher(data))
    monkeypatch.setattr(suffix_levels, "PLACE_BITS", 11)
    cut = anchors(data, Hasher(data))
    # Fewer hash bits are compared, so anchors may differ; their windows must not.
    assert cut[1][0] == 0 and cut[2][-1] == whole[2][-1] and (cut[1][1:] == cut[2][:-1] + 1).all()


def plain_words(rows):
    """Words in passages of 51 words that another document has too."""
    data = [(d, (t or "").encode().split()) for d, t in rows]
    holders = {}
    for k, (_, w) in enumerate(data):
        for i in range(len(w) - 50):
            holders.setdefault(tuple(w[i:i + 51]), set()).add(k)
    out = []
    for d, w in data:
        shared = set()
        for i in range(len(w) - 50):
            if len(holders[tuple(w[i:i + 51])]) > 1:
                shared.update(range(i, i + 51))
        out.append((d, len(shared)))
    return sorted(out, key=str)


def word_prose(rng, n):
    return [rng.choice(["a", "bé", "cde", "of", "the"]) + str(rng.randrange(30)) for _ in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_passages_of_words_below_400_bytes(spark, seed):
    rng = random.Random(seed)
    shared = [word_prose(rng, n) for n in (40, 50, 51, 52, 60, 70, 90, 300)]
    rows = []
    for d in range(70):
        words = []
        for _ in range(rng.randrange(1, 4)):
            s = rng.choice(shared)
            a, b = sorted((rng.randrange(len(s)), rng.randrange(len(s)))) if rng.random() < 0.3 else (0, len(s))
            words += word_prose(rng, rng.choice([0, 1, 5, 80])) + s[a:b]
        rows.append((d, "".join(w + rng.choice([" ", "\n", " \t"]) for w in words)))
    own = word_prose(rng, 55)
    own_twice = " ".join([*own, *word_prose(rng, 9), *own, "end"])
    fresh = word_prose(rng, 60)
    rows += [(100, rows[3][1]), (101, " ".join(word_prose(rng, 200))), (102, own_twice), (103, "x " * 60), (104, "x " * 61 + "y"),
             (105, " ".join(["p", *fresh])), (106, " ".join([*fresh, "q"])), (107, None), (108, " ".join(fresh[:50])), (109, "z " * 90), (110, "z " * 51 + "w"),
             (111, "r " * 70 + "s"), (112, " ".join(fresh[:52])), (113, " ".join(fresh[:52])), (114, "k " * 50), (115, "k " * 50)]
    got = suffix_levels.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), words=True).drop("spans")
    want = dict(plain_words(rows))
    assert sorted(((r.doc_id, r.n_shared_words) for r in got.collect()), key=str) == sorted(want.items(), key=str)
    assert sorted((tuple(r) for r in got.drop("n_shared_words").collect()), key=str) == plain(rows)
    # Passages shared by two documents, but of fewer than 400 bytes: nothing is removed, the words are counted.
    assert {r.n_removed for r in got.where("doc_id in (105, 106)").collect()} == {0} and want[105] == want[106] == 60
    assert want[102] == want[111] == want[114] == 0 and want[103] == 60 and want[112] == 52


def test_query_counts_shared_words(spark, odd_docs, tmp_path):
    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    from auditloom.llm.queries import QUERIES

    got = QUERIES["op3_suffix_levels"](spark, str(tmp_path))
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted(((r.doc_id, r.n_shared_words) for r in got.collect()), key=str) == plain_words(rows)
