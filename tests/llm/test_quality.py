"""Statistics against plain Python, the rule learner, the classifier on held-out rows."""

import re
from collections import Counter

import numpy as np
import pytest

from auditloom.llm import kernel_classifier, quality_rules
from auditloom.llm.stats import measure
from auditloom.llm.textarrays import Texts

import pyarrow as pa

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF_DIR = "/root/testdata/sf0.001"


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    many, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if many[w] > 1:
            hit |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_base_counts_of_odd_texts(spark, odd_docs):
    got = quality_rules.judge(odd_docs, quality_rules.DecisionList(())).collect()
    want = [(r.doc_id, *plain_counts(r.text)) for r in odd_docs.collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(want, key=key)
    for r in got:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed)


def test_base_counts_of_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:6] for r in quality_rules.judge(docs, quality_rules.DecisionList(())).collect()}
    assert got == {r.doc_id: plain_counts(r.text) for r in docs.collect()}


def test_features_are_finite():
    features = measure(Texts.of(pa.array([None, "", " ", "a b", "!!!"])))[1]
    assert all(np.isfinite(v).all() for v in features.values())


def test_learner_finds_planted_conjunction():
    rng = np.random.default_rng(1)
    values = {c: rng.random(3000) for c in quality_rules.FEATURES}
    bad = (values["upper_share"] > 0.7) & (values["echo_share"] < 0.4)
    rules = quality_rules.learn(values, bad, np.arange(3000) % 3 == 0)
    verdict = np.logical_or.reduce([r.holds(values) for r in rules.rules])
    assert (verdict == bad).mean() > 0.98 and len(rules.rules) < 8
    assert "reject if" in str(rules)


def test_expression_equals_rules(spark):
    first = quality_rules.Rule((quality_rules.Condition("a", True, 0.5), quality_rules.Condition("b", False, 0.25)))
    second = quality_rules.Rule((quality_rules.Condition("b", True, 0.9),))
    rows = spark.createDataFrame([(0.6, 0.2), (0.6, 0.95), (0.4, 0.1), (0.5, 0.25)], "a double, b double")
    got = rows.select(quality_rules.DecisionList((first, second)).number().alias("n")).collect()
    assert [r.n for r in got] == [1, 2, 0, 1]


@pytest.mark.parametrize("quality", [[], [0, 0, 0], [1, 1, None]])
def test_one_sided_labels_give_no_rules(spark, odd_docs, quality):
    labels = spark.createDataFrame([(i, q) for i, q in enumerate(quality)], "doc_id long, quality int")
    assert quality_rules.fit(odd_docs, labels).rules == ()


def test_rules_reject_junk_and_keep_the_rest(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    got = quality_rules.judge(docs, quality_rules.fit(docs, labels)).join(labels, "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in got if r.quality == 1], [r.kept for r in got if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_classifier_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    got = kernel_classifier.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 500 and sum(r.predicted == r.quality for r in got) > 0.97 * len(got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_classifier_on_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 0), (4, 1), (5, None), (99, 1), (None, 0), (4, 1)], "doc_id long, quality int")
    got = kernel_classifier.classify(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert kernel_classifier.classify(no_docs, labels).collect() == []
    assert {r.score for r in kernel_classifier.classify(odd_docs, labels.limit(0)).collect()} == {0.5}
    assert quality_rules.judge(no_docs, quality_rules.fit(no_docs, labels)).collect() == []


def test_isotonic_is_monotone_and_pools():
    x = np.arange(6.0)
    knots, levels = kernel_classifier.isotonic(x, np.array([0.0, 3, 1, 2, 9, 10]), np.full(6, 10.0))
    assert (np.diff(levels) >= 0).all() and len(knots) == 4


def plain_isotonic(at, share, n):
    """Pool neighbouring cells until the shares of ones rise strictly."""
    blocks = [[[x], [s], [k]] for x, s, k in zip(at, share, n, strict=True)]
    mean = lambda b: np.dot(b[1], b[2]) / sum(b[2])
    while True:
        bad = next((i for i in range(len(blocks) - 1) if mean(blocks[i]) >= mean(blocks[i + 1]) - 1e-12), None)
        if bad is None:
            break
        blocks[bad] = [a + b for a, b in zip(blocks[bad], blocks.pop(bad + 1), strict=True)]
    knots = [np.dot(b[0], b[2]) / sum(b[2]) for b in blocks]
    levels = []
    for b in blocks:
        total, extra = sum(b[2]), min(1.0, sum(b[2]) / 100)
        levels.append((mean(b) * total + extra) / (total + 2 * extra))
    return np.array(knots), np.maximum.accumulate(levels)


def test_classifier_equals_plain_numpy(spark):
    """Moments, Z'Z, Z'y, ridge, calibration and scores from matrices of all labelled rows at once."""
    from zlib import crc32

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: (r.score, r.predicted, r.held_out) for r in kernel_classifier.classify(docs, labels).collect()}

    stats = kernel_classifier.measured(docs).collect()
    x = np.array([[float(r[c]) for c in kernel_classifier.FEATURES] for r in stats])
    label = {r.doc_id: r.quality for r in labels.collect() if crc32(str(r.doc_id).encode()) % 3 != 1}
    train = np.array([r.doc_id in label for r in stats])
    y = np.array([label[r.doc_id] for r in stats if r.doc_id in label], float)

    rounded = np.rint(np.minimum(x[train], 1e4) * 65536) / 65536
    mean, scale = rounded.mean(axis=0), rounded.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    rng = np.random.default_rng(17)
    weights, phase = rng.normal(0, 1 / 4.0, (x.shape[1], 128)), rng.uniform(0, 2 * np.pi, 128)
    z = np.sqrt(2) * np.cos(np.clip((x - mean) / scale, -8, 8) @ weights + phase)
    z = np.column_stack([np.ones(len(z)), np.rint(z * kernel_classifier.UNIT) / kernel_classifier.UNIT])
    penalty = np.full(129, 1e-4 * train.sum())
    penalty[0] = 1e-9 * train.sum()
    beta = np.linalg.solve(z[train].T @ z[train] + np.diag(penalty), z[train].T @ y)
    raw = z @ beta
    low, high, cells = kernel_classifier.CELL_LOW, kernel_classifier.CELL_HIGH, kernel_classifier.CELLS
    cell = np.rint((np.clip(raw[train], low, high) - low) / (high - low) * cells).astype(int)
    used, place, n = np.unique(cell, return_inverse=True, return_counts=True)
    share = np.bincount(place, weights=y) / n
    knots, levels = plain_isotonic(used / cells * (high - low) + low, share, n)
    want = np.interp(raw, knots, levels)
    # A raw score on the edge of a cell may fall to either side of it.
    close = np.array([abs(got[r.doc_id][0] - w) < 1e-3 for r, w in zip(stats, want, strict=True)])
    assert close.mean() > 0.99
    for r in stats:
        score, predicted, held = got[r.doc_id]
        assert predicted == (score >= 0.5) and held == (crc32(str(r.doc_id).encode()) % 3 == 1)
