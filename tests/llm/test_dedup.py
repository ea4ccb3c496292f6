"""Near duplicates against all pairs of small tables; components on paths, stars and random graphs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from auditloom.llm import minhash_dedup
from auditloom.llm.components import components
from auditloom.llm.shingles import shingle_sets
from auditloom.llm.textarrays import Texts


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1))


def plain_components(rows, size=2, percent=80):
    """Sorted (doc_id, n_shingles, component_id, kept) by comparing every pair."""
    sets = [plain_set(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)), d == least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def run(docs, **how):
    return sorted((tuple(r) for r in minhash_dedup.near_duplicates(docs, **how).collect()), key=str)


def test_documents_equal_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = plain_components([(r.doc_id, r.text) for r in docs.collect()])
    assert run(docs, size=2) == want
    assert any(not r[3] for r in want)


def test_near_copies_around_the_limit(spark):
    rng = random.Random(3)
    rows = []
    for base in range(12):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 6, 12, 40, 120]))]
        for _ in range(14):
            copy = [w if rng.random() > 0.05 else f"x{rng.randrange(9)}" for w in words]
            rows.append((len(rows), " ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert run(docs, size=2) == plain_components(rows)


def test_chain_links_reach_the_smallest(spark):
    words = [f"a{i}" for i in range(100)]
    rows = []
    for k in range(9):
        rows.append((100 - k, " ".join(words)))
        words[10 * k + 3] = f"b{k}"
        words[10 * k + 8] = f"c{k}"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = run(docs, size=2)
    assert got == plain_components(rows) and {r[2] for r in got} == {92}


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got, want = run(odd_docs, size=2), plain_components(rows)
    fix = [(d, n, d if n == 0 else c, (d == c) if n else True) for d, n, c, _ in want]  # without words: linked with nothing
    assert got == sorted(fix, key=str)
    assert run(no_docs, size=2) == []
    assert len(run(odd_docs, size=5)) == len(rows)


@pytest.mark.parametrize("size", [1, 2, 5])
def test_shingles_equal_plain_sets(odd_docs, size):
    texts = [r.text for r in odd_docs.collect()]
    _, marks = shingle_sets(Texts.of(pa.array(texts)), size)
    assert np.diff(marks).tolist() == [len(plain_set(t, size)) for t in texts]


@pytest.mark.parametrize("kind", ["path", "star", "random", "loops"])
def test_components(spark, kind):
    rng = random.Random(kind)
    n = 60
    edges = {
        "path": [(i, i + 1) for i in range(n)], "star": [(7, i) for i in range(n)],
        "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(35)], "loops": [(i, i) for i in range(5)],
    }[kind]
    label = list(range(n + 1))
    for _ in label:
        for u, v in edges:
            label[u] = label[v] = min(label[u], label[v])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert [got.get(i, i) for i in range(n + 1)] == label


def test_percent_below_the_bands_is_refused(no_docs):
    for find in (minhash_dedup.near_duplicates, minhash_dedup.drop_near_duplicates):
        with pytest.raises(ValueError, match="at least 80"):
            find(no_docs, percent=79)
