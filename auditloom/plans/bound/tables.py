"""Operators on the columns of driver tables, checked against plain SQL."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions import paths, text
from auditloom.operators import features, text_rules, windows
from auditloom.operators import findings as ff
from auditloom.operators.code_rules import big_groups
from auditloom.operators.marks import first_word, word_flags
from auditloom.operators.reports import CHUNK, to_report, to_sarif
from auditloom.operators.score import score
from auditloom.plans.bound.base import (
    DOC_FILES_SQL, DOC_FINDINGS_SQL, DOC_LINES_SQL, HARDCODED_SQL, any_case, bind, document_files,
    document_findings, score_sql, secret_rows_sql, table,
)
from auditloom.plans.expected import literal
from auditloom.session import cut, scratch_dir, spread
from auditloom.sources.files import exclude, files_from_table, heuristic_scope, include, read_text, scan_files
from auditloom.sources.lines import to_lines

# --- Sources -----------------------------------------------------------------------------

PAGE_PATH_SQL = r"regexp_replace(regexp_replace(url, '^https?://[^/]+/', ''), '[?#].*$', '')"


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, root, path): every url as a path below its site."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    root = F.regexp_extract("url", r"^(https?://[^/]+)", 1)
    inside = paths.relative_to(F.col("url"), root)
    return pages.select("page_id", root.alias("root"), F.regexp_replace(inside, "[?#].*$", "").alias("path"))


@bind("s1_pruned_directories", f"""
    SELECT page_id, path FROM (SELECT page_id, {PAGE_PATH_SQL} AS path FROM pages)
    WHERE NOT list_has_any(list_slice(string_split(path, '/'), 1, -2), ['de', 'fr', 'build'])
""")
def pruned_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = page_paths(spark, sf_dir)
    return pages.filter(~paths.in_skipped_dir(F.col("path"), ["de", "fr", "build"])).select("page_id", "path")


def write_tree(base: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Write (path, text) rows as files below ``base``; returns how many."""
    system, root = pa_fs.FileSystem.from_uri(base)
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
            system.create_dir(f"{root}/{path}".rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(f"{root}/{path}") as stream:
                stream.write(content.encode())
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])


@bind("s1_scanned_tree", """
    SELECT source AS repo, CASE WHEN doc_id % 5 = 0 THEN '.hidden' ELSE 'src' END || '/m' || doc_id || '.py' AS path,
           strlen(text) AS size, sha256(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS digest
    FROM documents WHERE doc_id % 5 < 3
""")
def scanned_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as a directory tree with pruned folders in it, and scanned again."""
    base = f"{scratch_dir(spark)}/tree-{uuid.uuid4()}"
    base = base if "://" in base or base.startswith("file:") else f"file://{base}"
    folders = F.array(*map(F.lit, [".hidden", "src", "src", "node_modules/x", "src/build"]))
    path = F.concat_ws(
        "/", "source", F.get(folders, (F.col("doc_id") % 5).cast("int")), F.concat(F.lit("m"), F.col("doc_id").cast("string"), F.lit(".py")))
    rows = table(spark, sf_dir, "documents").select(path.alias("path"), "text")
    rows.mapInArrow(partial(write_tree, base), "n long").agg(F.sum("n")).collect()
    return scan_files(spark, base).select("repo", "path", "size", F.sha2("content", 256).alias("digest"))


@bind("s2_bounded_text", """
    SELECT doc_id, length(CASE WHEN strlen(text) <= 2000 THEN text ELSE '' END) AS n FROM documents
""")
def bounded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded = read_text(document_files(spark, sf_dir), limit=2_000)
    return bounded.select(
        F.regexp_extract("path", r"^(\d+)", 1).cast("long").alias("doc_id"), F.length("content").cast("long").alias("n")
    )


@bind("s4_lines_per_document", f"""
    SELECT repo, file, count(*) AS n_lines, max(line_no) AS last_line, CAST(sum(length(line)) AS BIGINT) AS n_chars
    FROM ({DOC_LINES_SQL}) GROUP BY repo, file
""")
def lines_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = to_lines(document_files(spark, sf_dir))
    return lines.groupBy("repo", F.col("path").alias("file")).agg(
        F.count("*").alias("n_lines"), F.max("line_no").alias("last_line"),
        F.sum(F.length("line")).alias("n_chars"),
    )


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files, some of them under test-like names."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    inside = F.regexp_replace(paths.relative_to(F.col("url"), F.regexp_extract("url", r"^(https?://[^/]+)", 1)), "[?#].*$", "")
    renamed = F.when(F.col("page_id") % 7 == 0, F.regexp_replace(inside, "^en/", "Tests/")).when(
        F.col("page_id") % 7 == 1, F.regexp_replace(inside, "/([^/]*)$", "/test_$1")
    ).otherwise(inside)
    named = pages.select(F.concat_ws("/", renamed, F.concat(F.col("page_id").cast("string"), F.lit(".py"))).alias("path"), "html", "page_id")
    plain = F.when(F.col("page_id") % 7 == 1, F.regexp_replace("path", "/(\\d+)\\.py$", "/test_$1.py")).otherwise(F.col("path"))
    return files_from_table(named, F.lit("site"), plain, F.col("html"))


@bind("s5_test_paths", rf"""
    SELECT path, NOT is_test AS in_scope FROM (
        SELECT path, list_has_any([lower(p) for p in string_split(path, '/')], ['test', 'tests', 'testing'])
                     OR page_id % 7 = 1 AS is_test
        FROM (SELECT page_id, CASE page_id % 7
                  WHEN 0 THEN regexp_replace(inside, '^en/', 'Tests/') || '/' || page_id || '.py'
                  WHEN 1 THEN regexp_replace(inside, '/([^/]*)$', '/test_\1') || '/test_' || page_id || '.py'
                  ELSE inside || '/' || page_id || '.py' END AS path
              FROM (SELECT page_id, {PAGE_PATH_SQL} AS inside FROM pages)))
""")
def scoped_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = page_files(spark, sf_dir)
    scoped = heuristic_scope(files).select("path", F.lit(True).alias("in_scope"))
    tests = files.filter("is_test").select("path", F.lit(False).alias("in_scope"))
    return scoped.unionByName(tests)


@bind("s8_relative_paths", f"SELECT page_id, {PAGE_PATH_SQL} AS path FROM pages")
def relative_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_paths(spark, sf_dir).select("page_id", "path")


# --- Features ----------------------------------------------------------------------------

# Sixteen words of the documents' four languages.
WORDS = {
    "w_" + w: [f" {w} "] for w in (
        "the", "and", "with", "from", "les", "des", "une", "que", "und", "der", "das", "nicht", "los", "las", "para", "con",
    )
}


@bind("d1_word_flags", "SELECT source AS repo, " + ", ".join(
    f"bool_or(contains(lower(text), {literal(words[0])})) AS {flag}" for flag, words in WORDS.items()
) + " FROM documents GROUP BY source")
def document_word_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = word_flags(F.lower("content"), WORDS)
    return document_files(spark, sf_dir).groupBy("repo").agg(*[F.bool_or(t).alias(f) for f, t in flags.items()])


@bind("d2_gated_documents", f"""
    SELECT doc_id FROM documents WHERE source IN (
        SELECT source FROM documents WHERE regexp_matches(text, {any_case(HARDCODED_SQL)}))
""")
def gated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of sources in which some document holds a secret."""
    documents = table(spark, sf_dir, "documents")
    hit = text.has_hardcoded_secret(F.col("text"))
    flags = spread(documents.select("source", "text")).groupBy(F.col("source").alias("repo")).agg(F.bool_or(hit).alias("secret"))
    rows = documents.select("doc_id", F.col("source").alias("repo"))
    return features.gate(rows, flags, F.col("secret")).select("doc_id")


# --- Text rules --------------------------------------------------------------------------


@bind("t1_secrets_in_documents", f"""
    SELECT repo, file, line_no AS line FROM ({DOC_LINES_SQL}) WHERE regexp_matches(line, {any_case(HARDCODED_SQL)})
""")
def secrets_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = to_lines(document_files(spark, sf_dir))
    return text_rules.line_rules(lines, ["secrets"]).select("repo", "file", "line")


def all_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, conversation turns and pages as one table of files."""
    turns = spread(table(spark, sf_dir, "conversations"))
    turn_path = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit(".py"))
    pages = spread(table(spark, sf_dir, "pages"))
    page_path = F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".py"))
    return (
        document_files(spark, sf_dir)
        .unionByName(files_from_table(turns, F.lit("conversations"), turn_path, F.col("text")))
        .unionByName(files_from_table(pages, F.lit("pages"), page_path, F.col("html")))
    )


ALL_FILES_SQL = DOC_FILES_SQL + """
    UNION ALL SELECT 'conversations', 'c' || conv_id || '/' || turn || '.py', text FROM conversations
    UNION ALL SELECT 'pages', 'p' || page_id || '.py', html FROM pages
"""


@bind("t2_r1_secret_scan_all_texts", f"""
    SELECT repo, label AS title, count(*) AS n, min(file) AS first_file FROM ({secret_rows_sql(ALL_FILES_SQL)}) GROUP BY ALL
""")
def secret_scan_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text_rules.file_findings(all_texts(spark, sf_dir), ["SEC-SECRET-SCAN"])
    return found.groupBy("repo", "title").agg(F.count("*").alias("n"), F.min("file").alias("first_file"))


@bind("t4_large_documents", f"""
    SELECT repo, file, 'Taille approximative: ' || format('{{:.1f}}', strlen(text) / 1000000) || ' MB.' AS detail
    FROM ({DOC_FILES_SQL}) WHERE strlen(text) > 4000
""")
def large_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_rules.large_files(document_files(spark, sf_dir), 4_000).select("repo", "file", "detail")


STATEMENTS = ["", "  SELECT  a\n FROM t", " insert   into t", "; Update t SET a = 1", " delete from t", " please update"]
STATEMENT_SQL = "CASE doc_id % 6 " + " ".join(
    f"WHEN {i} THEN " + literal(s).replace("\n", "' || chr(10) || '") for i, s in enumerate(STATEMENTS)
) + " END"
FOLDED_SQL = rf"regexp_replace(lower(text || {STATEMENT_SQL}), '\s+', ' ', 'g')"


@bind("t7_looks_like_sql", rf"""
    SELECT doc_id, regexp_matches(s, '\bselect\b.+\bfrom\b') OR regexp_matches(s, '\binsert\s+into\b')
                   OR regexp_matches(s, '\bupdate\b.+\bset\b') OR regexp_matches(s, '\bdelete\s+from\b') AS is_sql
    FROM (SELECT doc_id, {FOLDED_SQL} AS s FROM documents)
""")
def sql_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document, with a statement or something like it appended."""
    added = F.element_at(F.array(*map(F.lit, STATEMENTS)), (F.col("doc_id") % 6 + 1).cast("int"))
    seeded = F.concat("text", added)
    return table(spark, sf_dir, "documents").select("doc_id", text.looks_like_sql(seeded).alias("is_sql"))


@bind("t14_first_word_in_documents", """
    SELECT doc_id, CASE WHEN contains(lower(text), ' über ') THEN ' über ' WHEN contains(lower(text), ' para ') THEN ' para '
                        WHEN contains(lower(text), ' dans ') THEN ' dans ' WHEN contains(lower(text), ' of ') THEN ' of '
                   END AS word
    FROM documents WHERE (contains(source, '1') OR contains(source, '7')) AND word IS NOT NULL
""")
def first_word_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    word = first_word(F.col("source"), F.col("text"), ["1", "7"], [" über ", " para ", " dans ", " of "])
    return documents.select("doc_id", word.alias("word")).filter("word IS NOT NULL")


URL_WORDS = ["en", "fr", "page", "html", "4", "7"]


@bind("t15_mixed_url_words", f"""
    SELECT page_id, array_to_string([w for w in {URL_WORDS!r} if contains(lower(url), w)], ', ') AS words
    FROM pages WHERE len([w for w in {URL_WORDS!r} if contains(lower(url), w)]) > 1
""")
def mixed_url_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.words_found(F.lower("url"), URL_WORDS)
    return table(spark, sf_dir, "pages").select("page_id", found.alias("found")).filter(F.size("found") > 1).select(
        "page_id", F.array_join("found", ", ").alias("words")
    )


@bind("t16_first_matching_line", f"""
    SELECT repo, file, min(line_no) AS line FROM ({DOC_LINES_SQL})
    WHERE contains(line, ' of ') OR contains(line, ' la ') OR contains(line, ' und ') GROUP BY repo, file
""")
def first_matching_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = to_lines(document_files(spark, sf_dir))
    first = text_rules.first_matching_line(lines, text.contains_any(F.col("line"), [" of ", " la ", " und "]))
    return first.select("repo", F.col("path").alias("file"), F.col("line_no").alias("line"))


# --- Ordered scans on events and orders -----------------------------------------------------


@bind("c1_running_depth", """
    SELECT event_id, CAST(sum(CASE event_type WHEN 'view' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END)
        OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth
    FROM events
""")
def running_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views opened minus purchases so far, per user."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    delta = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "purchase", -1).otherwise(0)
    summed = windows.running_sum(
        events, ["user_id"], ["ts", "event_id"], delta.cast("long"), F.date_trunc("day", "ts"), "depth"
    )
    return summed.select("event_id", "depth")


@bind("c3_latest_earlier_order", """
    SELECT o_orderkey, prev_key FROM (
        SELECT o_orderkey, o_orderdate, lag(o_orderkey) OVER w AS prev_key, lag(o_orderdate) OVER w AS prev_date
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
    WHERE prev_date >= o_orderdate - INTERVAL 30 DAY
""")
def latest_earlier_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order the customer's order before it, if at most 30 days older."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    carried = windows.carry_forward(
        orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], F.struct("o_orderdate", "o_orderkey"),
        F.date_trunc("quarter", "o_orderdate"), "prev", include_current=False,
    )
    recent = F.col("prev.o_orderdate") >= F.col("o_orderdate") - F.expr("INTERVAL 30 DAYS")
    return carried.filter(recent).select("o_orderkey", F.col("prev.o_orderkey").alias("prev_key"))


@bind("a12_errors_after_signup", """
    SELECT e.user_id, e.event_id FROM events e WHERE e.event_type = 'error' AND EXISTS (
        SELECT 1 FROM events s WHERE s.event_type = 'signup' AND s.user_id = e.user_id AND s.ts < e.ts)
""")
def errors_after_signup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    found = windows.earlier_than(
        events.filter("event_type = 'error'"), events.filter("event_type = 'signup'"), ["user_id"], "ts", "ts"
    )
    return found.select("user_id", "event_id")


@bind("a23_first_purchase_per_signup", """
    SELECT user_id, signup_id, arg_min(event_id, (ts, event_id)) AS purchase_id FROM (
        SELECT *, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS)
            OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS signup_id
        FROM events)
    WHERE event_type = 'purchase' AND signup_id IS NOT NULL GROUP BY user_id, signup_id
""")
def first_purchase_per_signup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    signup = F.when(F.col("event_type") == "signup", F.col("event_id"))
    carried = windows.carry_forward(
        events, ["user_id"], ["ts", "event_id"], signup, F.date_trunc("day", "ts"), "signup_id"
    )
    purchases = carried.filter("event_type = 'purchase' AND signup_id IS NOT NULL")
    return purchases.groupBy("user_id", "signup_id").agg(F.min(F.struct("ts", "event_id")).alias("first")).select(
        "user_id", "signup_id", F.col("first.event_id").alias("purchase_id")
    )


@bind("a30_big_orders", """
    SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS total FROM lineitem
    GROUP BY l_orderkey HAVING count(*) > 5 OR sum(l_quantity) > 150
""")
def big_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    return big_groups(lines, ["l_orderkey"], F.col("l_quantity"), 5, 150)


@bind("a34_g10_customers_without_urgent_order", """
    SELECT c_custkey FROM customer WHERE c_custkey NOT IN (
        SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
""")
def without_urgent_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(urgent, "c_custkey", "left_anti")


@bind("i6_suppliers_in_debt_per_nation", """
    SELECT n_name, coalesce(s_name, 'none') AS supplier FROM nation
    LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal < 0
""")
def suppliers_in_debt(spark: SparkSession, sf_dir: str) -> DataFrame:
    debtors = table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_nationkey").alias("n_nationkey"), "s_name")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return nations.join(debtors, "n_nationkey", "left").select("n_name", F.coalesce("s_name", F.lit("none")).alias("supplier"))


# --- Findings algebra ------------------------------------------------------------------------


@bind("r2_defaults", f"""
    SELECT repo, file, rule_id, coalesce(CASE WHEN severity = 'LOW' THEN 'LOW' END, 'MEDIUM') AS confidence,
           CASE WHEN severity = 'HIGH' THEN '' ELSE recommendation END AS recommendation, source,
           CAST(NULL AS INTEGER) AS line
    FROM ({DOC_FINDINGS_SQL})
""")
def defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with columns missing or partly null, filled in."""
    partial = document_findings(spark, sf_dir).drop("source", "line").withColumns({
        "confidence": F.when(F.col("severity") == "LOW", "LOW"),
        "recommendation": F.when(F.col("severity") != "HIGH", F.col("recommendation")),
    })
    return ff.with_defaults(partial).select("repo", "file", "rule_id", "confidence", "recommendation", "source", "line")


@bind("r3_dedup_findings", f"SELECT DISTINCT repo, severity, title, file, line, detail, rule_id, 'HIGH' AS confidence FROM ({DOC_FINDINGS_SQL})")
def dedup_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding three times with different certainty; the most certain one stays."""
    found = document_findings(spark, sf_dir)
    copies = found.withColumn("confidence", F.explode(F.array(F.lit("LOW"), F.lit("HIGH"), F.lit("MEDIUM"))))
    return ff.dedup(copies).select("repo", "severity", "title", "file", "line", "detail", "rule_id", "confidence")


@bind("r3_exact_copies", "SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY text")
def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per distinct text. Copies are merged by digest, so no text is shuffled."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return documents.groupBy(F.sha2("text", 256).alias("digest")).agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("n")
    ).select("doc_id", "n")


@bind("r4_part_type_labels", """
    SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'Économique' WHEN 'STANDARD' THEN 'Ordinaire' ELSE p_type END AS p_type
    FROM part
""")
def part_type_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = {"ECONOMY": "Économique", "STANDARD": "Ordinaire"}
    return ff.translate(table(spark, sf_dir, "part").select("p_partkey", "p_type"), {"p_type": labels})


RANK_SQL = """
    CASE severity WHEN 'CRITICAL' THEN 10 WHEN 'HIGH' THEN 7 WHEN 'MEDIUM' THEN 4 WHEN 'LOW' THEN 2 ELSE 0 END DESC,
    category, file, coalesce(line, 0), rule_id, title, detail
"""


@bind("r5_ranked_findings", f"""
    SELECT repo, file, line, rule_id, title FROM ({DOC_FINDINGS_SQL}) ORDER BY repo, {RANK_SQL}
""")
def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ff.rank(document_findings(spark, sf_dir)).select("repo", "file", "line", "rule_id", "title")


def all_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("repo")).distinct()


@bind("r6_document_scores", score_sql(
    f"SELECT DISTINCT * FROM ({DOC_FINDINGS_SQL}) WHERE rule_id IN ('SEC-SECRET-SCAN', 'SEC-HARDCODED-SECRET')"))
def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every source from the secrets in its documents, clean sources included."""
    files = document_files(spark, sf_dir)
    found = text_rules.text_findings(files, ["secrets"])
    return score(ff.dedup(ff.with_defaults(found)), all_sources(spark, sf_dir))


@bind("r6_scores_all_severities", score_sql(DOC_FINDINGS_SQL))
def scores_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(document_findings(spark, sf_dir), all_sources(spark, sf_dir))


@bind("r7_gate_status", f"""
    SELECT repo, bool_or(severity IN ('CRITICAL', 'HIGH')) AS failed FROM ({DOC_FINDINGS_SQL}) GROUP BY repo
""")
def gate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ff.gate_status(document_findings(spark, sf_dir), "HIGH")


@bind("r8_severity_pivot", f"""
    SELECT repo, count(*) FILTER (severity = 'CRITICAL') AS CRITICAL, count(*) FILTER (severity = 'HIGH') AS HIGH,
           count(*) FILTER (severity = 'MEDIUM') AS MEDIUM, count(*) FILTER (severity = 'LOW') AS LOW,
           count(*) FILTER (severity = 'INFO') AS INFO
    FROM ({DOC_FINDINGS_SQL}) GROUP BY repo
""")
def severity_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ff.severity_pivot(document_findings(spark, sf_dir))


PRIORITIES = {
    "1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "unspecified", "5-LOW": "low",
}


@bind("r8_order_priority_pivot", "SELECT o_custkey, " + ", ".join(
    f"count(*) FILTER (o_orderpriority = {literal(v)}) AS {n}" for v, n in PRIORITIES.items()
) + " FROM orders GROUP BY o_custkey")
def order_priority_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ff.count_pivot(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", PRIORITIES)


@bind("r9_priority_list", f"""
    SELECT repo, file, line, rule_id, title, CAST(rank AS INTEGER) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY repo ORDER BY {RANK_SQL}) AS rank
        FROM ({DOC_FINDINGS_SQL}) WHERE severity IN ('CRITICAL', 'HIGH') AND confidence <> 'LOW')
    WHERE rank <= 10
""")
def priority_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ff.priorities(document_findings(spark, sf_dir)).select("repo", "file", "line", "rule_id", "title", "rank")


@bind("r9_top_orders_per_nation", """
    SELECT c_nationkey, o_orderkey, CAST(rank AS INTEGER) AS rank FROM (
        SELECT c_nationkey, o_orderkey,
               row_number() OVER (PARTITION BY c_nationkey ORDER BY o_totalprice DESC, o_orderkey) AS rank
        FROM orders JOIN customer ON o_custkey = c_custkey)
    WHERE rank <= 10
""")
def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    nations = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    joined = orders.join(nations, "c_custkey").select("c_nationkey", "o_orderkey", "o_totalprice")
    top = ff.top_per_group(joined, ["c_nationkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 10)
    return top.select("c_nationkey", "o_orderkey", "rank")


@bind("r10_report_head", f"""
    SELECT repo, file, line, rule_id, title FROM (
        SELECT *, row_number() OVER (PARTITION BY repo ORDER BY {RANK_SQL}) AS rank FROM ({DOC_FINDINGS_SQL}))
    WHERE rank <= 30
""")
def report_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ff.head(document_findings(spark, sf_dir), 30).select("repo", "file", "line", "rule_id", "title")


@bind("r11_health_band", f"""
    SELECT s.repo, s.score, coalesce(actionable, 0) AS actionable, coalesce(total, 0) AS total,
           CASE WHEN coalesce(any_critical, false) OR score < 50 THEN 'critical'
                WHEN coalesce(any_high, false) OR score < 80 THEN 'warn' ELSE 'ok' END AS band
    FROM ({score_sql(DOC_FINDINGS_SQL)}) s LEFT JOIN (
        SELECT repo, count(*) FILTER (severity IN ('CRITICAL', 'HIGH', 'MEDIUM')) AS actionable, count(*) AS total,
               bool_or(severity = 'CRITICAL') AS any_critical, bool_or(severity = 'HIGH') AS any_high
        FROM ({DOC_FINDINGS_SQL}) GROUP BY repo) c ON s.repo = c.repo
""")
def health_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut(document_findings(spark, sf_dir))
    return ff.health_band(found, score(found, all_sources(spark, sf_dir)))


@bind("r13_json_reports", f"""
    SELECT s.repo, s.score, coalesce(n, 0) AS n_findings, coalesce(n_lines, 0) AS n_lines
    FROM ({score_sql(DOC_FINDINGS_SQL)}) s
    LEFT JOIN (SELECT repo, count(*) AS n, count(line) AS n_lines FROM ({DOC_FINDINGS_SQL}) GROUP BY repo) f ON s.repo = f.repo
""")
def json_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of at most about 20 findings per document, read back and added up."""
    found = cut(document_findings(spark, sf_dir))
    documents = to_report(found, score(found, all_sources(spark, sf_dir)), size=20)
    parsed = documents.select(F.from_json(
        "json", "project string, score int, findings array<struct<line:int>>").alias("r"))
    lines = F.size(F.filter("r.findings", lambda f: f["line"].isNotNull()))
    return parsed.groupBy(F.col("r.project").alias("repo")).agg(
        F.max("r.score").alias("score"), F.sum(F.size("r.findings")).alias("n_findings"), F.sum(lines).alias("n_lines")
    )


# Every line of an order as a finding: three repositories of a third of all rows each.
LINE_FINDINGS_SQL = """
    SELECT l_returnflag AS repo, CASE l_linenumber % 4 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' ELSE 'INFO' END AS severity,
           l_linestatus AS category, 's' || l_suppkey AS file, CAST(l_partkey AS INTEGER) AS line,
           l_orderkey || '-' || l_linenumber AS rule_id
    FROM lineitem
"""


def line_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of an order as a finding."""
    n = F.col("l_linenumber") % 4
    text_of = lambda c: F.col(c).cast("string")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("repo"),
        F.when(n == 0, "CRITICAL").when(n == 1, "LOW").when(n == 2, "MEDIUM").otherwise("INFO").alias("severity"),
        F.col("l_linestatus").alias("category"), F.lit("line").alias("title"), F.lit("of an order").alias("detail"),
        F.concat(F.lit("s"), text_of("l_suppkey")).alias("file"), F.col("l_partkey").cast("int").alias("line"),
        F.lit("").alias("recommendation"), F.lit("orders").alias("source"),
        F.concat(text_of("l_orderkey"), F.lit("-"), text_of("l_linenumber")).alias("rule_id"), F.lit("HIGH").alias("confidence"),
    )


WHOLE_ORDER_SQL = f"""
    SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY
               CASE severity WHEN 'CRITICAL' THEN 10 WHEN 'MEDIUM' THEN 4 WHEN 'LOW' THEN 2 ELSE 0 END DESC,
               category, file, line, rule_id) - 1 AS rank, rule_id, file, line
    FROM ({LINE_FINDINGS_SQL})
"""


@bind("r13_report_order", WHOLE_ORDER_SQL)
def report_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON reports of 5,000 findings each, read back one after another."""
    found = line_findings(spark, sf_dir)
    documents = to_report(found, found.groupBy("repo").agg(F.count("*").alias("score")))
    parsed = documents.select("repo", "chunk", F.from_json(
        "json", "findings array<struct<rule_id:string,file:string,line:int>>").alias("r"))
    listed = parsed.select("repo", "chunk", F.posexplode("r.findings").alias("at", "f"))
    return listed.select("repo", (F.col("chunk").cast("long") * CHUNK + F.col("at")).alias("rank"), "f.rule_id", "f.file", "f.line")


# A SARIF location has no line 0.
@bind("r12_sarif_order", f"SELECT repo, rank, rule_id, file, nullif(line, 0) AS line FROM ({WHOLE_ORDER_SQL})")
def sarif_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SARIF logs of 5,000 findings each, read back one after another."""
    place = "struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>"
    log = f"runs array<struct<results:array<struct<ruleId:string,locations:array<{place}>>>>>"
    parsed = to_sarif(line_findings(spark, sf_dir)).select("repo", "chunk", F.from_json("json", log).alias("log"))
    listed = parsed.select("repo", "chunk", F.posexplode(F.col("log.runs")[0]["results"]).alias("at", "f"))
    where = F.col("f.locations")[0]["physicalLocation"]
    return listed.select(
        "repo", (F.col("chunk").cast("long") * CHUNK + F.col("at")).alias("rank"), F.col("f.ruleId").alias("rule_id"),
        where["artifactLocation"]["uri"].alias("file"), where["region"]["startLine"].alias("line"),
    )


@bind("r14_search", f"""
    SELECT repo, file, line, rule_id FROM ({DOC_FINDINGS_SQL})
    WHERE severity = 'MEDIUM' AND confidence = 'MEDIUM' AND contains(lower(file || ':' || line), '7.py')
""")
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ff.search(document_findings(spark, sf_dir), "7.PY", "MEDIUM", "MEDIUM")
    return found.select("repo", "file", "line", "rule_id")


@bind("r15_excluded_paths", f"""
    SELECT path FROM (SELECT {PAGE_PATH_SQL} AS path FROM pages)
    WHERE NOT (path = 'fr' OR starts_with(path, 'fr/')) AND NOT regexp_matches(path, '^(.*/)?[^/]*[.]html$')
          AND NOT regexp_matches(path, '^en/9[^/]*$')
""")
def excluded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exclude(page_paths(spark, sf_dir), ["fr"], ["**/*.html", "en/9*"]).select("path")


@bind("r15_included_paths", f"""
    SELECT path FROM (SELECT {PAGE_PATH_SQL} AS path FROM pages)
    WHERE starts_with(path, 'de/') OR regexp_matches(path, '^en/[0-4][^/]$')
""")
def included_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return include(page_paths(spark, sf_dir), ["de/"], ["en/[0-4]?"]).select("path")
