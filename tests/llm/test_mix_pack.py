"""Bin packing against a plain best fit and the laws of shards; mixing against its targets."""

import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from auditloom.llm import bin_packing, pivotal_mix


def plain_best_fit(sizes, capacity):
    left, out = [], []
    for s in sizes:
        fits = [(r, b) for b, r in enumerate(left) if r >= s]
        if fits:
            b = min(fits)[1]
        else:
            b = len(left)
            left.append(capacity)
        left[b] -= s
        out.append(b)
    return out


@pytest.mark.parametrize("seed", range(8))
def test_best_fit_equals_plain(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.randrange(1, 60) for _ in range(400)), reverse=True)
    assert bin_packing.best_fit(sizes, 100) == plain_best_fit(sizes, 100)
    assert bin_packing.best_fit(sizes, 59 if sizes[0] < 59 else 58) is None or sizes[0] <= 59


def test_tree_stays_balanced():
    tree = bin_packing.CapacityTree()
    for i in range(1000):
        tree.add((i, i))
    assert tree.root[3] <= 14
    for i in range(0, 1000, 2):
        assert tree.take_tightest(i) == (i, i)
    assert tree.take_tightest(0) == (1, 1) and tree.take_tightest(1000) is None and tree.root[3] <= 13


def check_shards(docs, got, even):
    texts = {r.doc_id: r.text for r in docs.collect()}
    sizes, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        text = texts[r.doc_id]
        assert r.size == len((text or "").encode()) + 1 and r.law == "bytes" and r.grown_shard is None
        assert r.text_crc32 == (None if text is None else zlib.crc32(text.encode()))
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        where[text].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
    assert len(got) == docs.count()
    if even:
        assert all(len(s) == 1 for s in where.values())
        assert max(sizes.values()) - min(sizes.values()) <= 0.002 * sum(sizes.values())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_shards_of_documents(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    check_shards(docs, bin_packing.shard(docs).collect(), True)


def test_parcels_and_giants(spark):
    rows = [(i, "same text" * 20) for i in range(3000)] + [(3000 + i, f"t{i}") for i in range(40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = bin_packing.shard(docs).collect()
    check_shards(docs, got, False)
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert max(sizes.values()) <= 1.02 * sum(sizes.values()) / 8


def test_odd_shards(spark, odd_docs, no_docs):
    got = bin_packing.shard(odd_docs).collect()
    assert len(got) == odd_docs.count() and bin_packing.shard(no_docs).collect() == []
    assert bin_packing.shard(odd_docs).groupBy("shard", "slot").count().where("count > 1").isEmpty()


def plain_targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = Fraction(3, 2) * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        if not free:
            break
        level = (total - 2 * sum(sizes[s] for s in capped)) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    return {s: float(2 * sizes[s] if s in capped else weight[s] * level) for s in names}


def check_mix(rows, got):
    sizes = Counter()
    for s, text in rows:
        sizes[s] += len((text or "").split())
    want, taken = plain_targets(sizes), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    whole = Counter(r.source for r in got if r.size and r.taken % r.size)
    assert all(n <= 1 for n in whole.values())


def test_mix_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = pivotal_mix.mix(docs, keep=["lang"]).join(docs.select("doc_id", "source"), "doc_id").collect()
    check_mix([(r.source, r.text) for r in docs.collect()], got)


def test_mix_with_many_levels_and_a_null_source(spark, monkeypatch):
    monkeypatch.setattr(pivotal_mix, "LEAF_ROWS", 8)
    monkeypatch.setattr(pivotal_mix, "FAN_IN", 4)
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a", "a", "a", "b", "Z", "é", None]), "w " * rng.randrange(40)) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = pivotal_mix.mix(docs).collect()
    again = pivotal_mix.mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    source = {i: s for i, s, _ in rows}
    class Row:
        def __init__(self, r):
            self.__dict__.update(r.asDict(), source=source[r.doc_id])
    check_mix([(s, t) for _, s, t in rows], [Row(r) for r in got])


def test_expected_copies_are_the_rate(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], "w " * (1 + i % 5)) for i in range(400)], "doc_id long, source string, text string")
    total = Counter()
    for seed in range(6):
        for r in pivotal_mix.mix(docs, seed=seed).collect():
            total[r.size] += r.taken / r.size / 6
    assert all(abs(total[s] / 80 - 1.5) < 0.25 for s in range(1, 6))


def test_odd_mix(spark, odd_docs, no_docs):
    from pyspark.sql import functions as F

    docs = odd_docs.withColumn("source", F.lit(None).cast("string")).withColumn("target", F.lit("clash"))
    got = pivotal_mix.mix(docs).collect()
    assert len(got) == docs.count() and all(r.taken == 0 for r in got if r.size == 0)
    assert pivotal_mix.mix(docs.limit(0)).collect() == []
    blank = spark.createDataFrame([(1, "x", None), (2, "y", " ")], "doc_id long, source string, text string")
    assert [r.taken for r in pivotal_mix.mix(blank).collect()] == [0, 0]
