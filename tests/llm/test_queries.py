"""Every numbered query runs on whole tables with its contract's columns; those with SQL equal it."""

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from auditloom.llm.queries import ORACLES, QUERIES
from tools.check_oracle import TABLES, rows_of

SF_DIR = "/root/testdata/sf0.001"

# Columns that the contracts name, in words of each contract.
COLUMNS = {
    "op1": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op2": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op3": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op4": "doc_id size text_crc32 law shard slot grown_shard",
    "op5": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op6": "doc_id n_shingles component_id kept",
    "op7": "doc_id size source_size target taken",
    "op8": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op9": "doc_id canon_sha256 licence n_notices notices",
    "op10": "doc_id held_out score predicted",
    "op11": "doc_id held_out lang_pred score",
    "op12": "item_id rank doc_id score",
    "op13": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
}
#: Queries with a row for each document.
BY_DOCUMENT = sorted(n for n in QUERIES if n.split("_")[0] not in ("op12", "op13"))


def test_all_queries_and_the_pipeline_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == set(COLUMNS)
    assert set(QUERIES) | {"pipeline"} <= set(queries()) and set(ORACLES) <= set(oracle_sql())


@pytest.mark.parametrize("name", BY_DOCUMENT)
def test_columns_and_one_row_per_document(spark, name):
    frame = queries()[name](spark, SF_DIR)
    named = COLUMNS[name.split("_")[0]].split()
    assert frame.columns[:len(named)] == named
    ids = sorted(r.doc_id for r in frame.select("doc_id").collect())
    assert ids == sorted(r.doc_id for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id").collect())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    frame = queries()[name](spark, SF_DIR)
    result = db.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(frame.columns) == sorted(columns)
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == rows_of(columns, result.fetchall())
