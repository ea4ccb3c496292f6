"""From raw documents to shards: each stage reads the table that the stage before it wrote.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. Every
stage works on whole texts, however long, keeps the columns of documents, whatever else they are called,
and makes an empty table of an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditloom.llm import bin_packing, fm_decontam, kernel_classifier, minhash_dedup, pivotal_mix
from auditloom.llm.common import store, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the kernel classifier accepts; null texts count as empty, repeated rows are decided each."""
    return kernel_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more; texts without words stay."""
    return minhash_dedup.drop_near_duplicates(docs, size=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark; null and empty texts stay."""
    return fm_decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target mix takes them; the null source is a source like any other."""
    return pivotal_mix.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each document of the mix; copies of a document share its shard, null texts count as empty."""
    return bin_packing.shard(docs)


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mix of sources", mix),
    ("sharding", shard),
]

#: The classifier learns and the mix draws at random: SQL can't express the rows of run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table of documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
