"""Each stage against a plain version on its own input, and the whole run."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from auditloom.llm import fm_decontam, kernel_classifier, minhash_dedup, pivotal_mix
from auditloom.llm.common import store, table
from tests.llm.test_decontam import plain as plain_contamination
from tests.llm.test_dedup import plain_components

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF_DIR, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = store(stage(spark, docs, SF_DIR))
        out.append((name, docs, after))
        docs = after
    return out


def ids(docs):
    return sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_columns_and_names(stages):
    assert [n for n, *_ in stages] == [n for n, _ in corpus_pipeline.STAGES] and len(stages) == 5
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and after.count() > 0


def test_quality_stage(spark, stages):
    _, before, after = stages[0]
    scores = kernel_classifier.classify(before, table(spark, SF_DIR, "labels"))
    assert ids(after) == ids(scores.where("predicted = 1"))
    labelled = before.join(table(spark, SF_DIR, "labels"), "doc_id")
    kept = set(ids(after))
    good = [r.doc_id in kept for r in labelled.where("quality = 1").collect()]
    bad = [r.doc_id in kept for r in labelled.where("quality = 0").collect()]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_near_duplicate_stage(stages):
    _, before, after = stages[1]
    want = plain_components([(r.doc_id, r.text) for r in before.collect()], size=5)
    assert ids(after) == sorted(d for d, n, c, kept in want if kept or not n) and after.count() < before.count()


def test_decontamination_stage(spark, stages):
    _, before, after = stages[2]
    items = [tuple(r) for r in table(spark, SF_DIR, "benchmark").collect()]
    want = plain_contamination([(r.doc_id, r.text) for r in before.collect()], items)
    assert ids(after) == sorted(r[0] for r in want if not r[5]) and after.count() < before.count()


def test_mix_stage(stages):
    _, before, after = stages[3]
    texts = {r.doc_id: (r.text, r.source) for r in before.collect()}
    rows = after.collect()
    assert all(texts[r.doc_id] == (r.text, r.source) for r in rows) and max(Counter(ids(after)).values()) <= 2
    targets = pivotal_mix.source_targets(before.select("source", pivotal_mix.word_count("text").alias("size"))).collect()
    got, largest = Counter(), Counter()
    for r in rows:
        got[r.source] += len(r.text.split())
    for text, source in texts.values():
        largest[source] = max(largest[source], len(text.split()))
    assert all(abs(got[t.source] - t.target) <= largest[t.source] for t in targets)


def test_shard_stage(stages):
    _, before, after = stages[4]
    assert ids(after) == ids(before)
    assert after.groupBy("text_crc32", "size").agg(F.countDistinct("shard").alias("n")).where("n > 1").isEmpty()
    assert after.groupBy("shard", "slot").count().where("count > 1").isEmpty()


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, SF_DIR)
    assert got.columns == stages[-1][2].columns and got.count() == stages[-1][2].count()


def test_stages_on_odd_rows(spark, odd_docs, no_docs, tmp_path):
    names = dict(doc_id="doc_id", text="text", lang="score", source="score", n_chars="n_words")
    odd = odd_docs.select(*[F.col(v).alias(k) for k, v in names.items()], F.lit(1).alias("copies"), F.lit("x").alias("digest"))
    spark.createDataFrame([(1, "the cat sat on the mat")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(4, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd, odd.limit(0)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, docs, str(tmp_path))
            assert after.count() <= 2 * n
            if name != "sharding":
                assert after.columns == docs.columns


def test_one_row_of_repeated_rows_stays(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (7, "A b c d e f"), (None, "a b c d e f"), (8, None), (8, None), (9, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, (r.doc_id for r in minhash_dedup.drop_near_duplicates(docs).collect()))) == ["5", "8", "8", "9"]


def test_hit_documents_are_the_contaminated_ones(spark):
    docs, items = (table(spark, SF_DIR, n) for n in ("documents", "benchmark"))
    want = ids(fm_decontam.contamination(docs, items).where("not contaminated"))
    assert ids(fm_decontam.clean(docs, items)) == want
