"""Rules on the seeded corpus: one file per document, hand-labelled expectations."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions import scopes
from auditloom.operators import code_rules as code
from auditloom.operators import features, model_rules, reports, text_rules
from auditloom.operators.findings import dedup, translate, with_defaults
from auditloom.operators.score import score
from auditloom.plans.audit import audit
from auditloom.plans.bound.base import any_case, bind, score_sql, table
from auditloom.plans.expected import (
    PATH_SQL, findings_sql, labelled_sql, literal, per_template_sql, sums_sql, values,
)
from auditloom.plans.seeded import seeded_files
from auditloom.session import scratch_dir
from auditloom.sources.facts import extract_facts, store_facts, syntax_errors
from auditloom.sources.files import describe, heuristic_scope, select_python, select_text
from auditloom.sources.lines import to_lines

SHOWN = ["repo", "rule_id", "severity", "confidence", "file", "line", "detail"]


def corpus(spark: SparkSession, sf_dir: str, with_text: bool = True) -> DataFrame:
    return seeded_files(table(spark, sf_dir, "documents"), with_text)


def facts_of(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """Facts of the whole corpus, of the node kinds a rule names."""
    return extract_facts(corpus(spark, sf_dir), list(kinds) or None)


def on_facts(name: str, rule: Callable[[DataFrame], DataFrame], kinds: list[str], *rules: str):
    """Bind a rule that combines nodes; it reads the facts more than once, so they are stored."""
    bind(name, findings_sql(*rules))(
        lambda spark, sf: rule(store_facts(facts_of(spark, sf, *kinds))).select(*SHOWN)
    )


def on_nodes(name: str, *rules: str):
    """Bind single-node rules: one pass over the facts they ask for."""
    kinds = sorted({kind for rule in rules for kind in code.NODE_RULES[rule].kinds})
    bind(name, findings_sql(*rules))(
        lambda spark, sf: code.node_findings(facts_of(spark, sf, *kinds), list(rules)).select(*SHOWN)
    )


def on_files(name: str, *rules: str):
    """Bind file rules, on the programs and the documents' own text."""
    bind(name, findings_sql(*rules))(
        lambda spark, sf: text_rules.file_findings(corpus(spark, sf), list(rules)).select(*SHOWN)
    )


def on_lines(name: str, rule: Callable[[DataFrame], DataFrame], *rules: str):
    """Bind line rules, on the programs and the documents' own text."""
    bind(name, findings_sql(*rules))(
        lambda spark, sf: rule(to_lines(select_python(corpus(spark, sf)))).select(*SHOWN)
    )


FUNCTIONS = ["FunctionDef", "AsyncFunctionDef"]

# --- Sources -----------------------------------------------------------------------------


@bind("s3_python_and_text_files", f"""
    SELECT source AS repo, count(*) AS n_files,
           count(*) FILTER (doc_id % 33 NOT IN (6, 32)) AS n_python,
           count(*) FILTER (doc_id % 33 <> 6) AS n_text
    FROM documents GROUP BY source
""")
def python_and_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus(spark, sf_dir).select("repo", "path", "is_py", "is_text")
    python = select_python(files).groupBy("repo").agg(F.count("*").alias("n_python"))
    text = select_text(files).groupBy("repo").agg(F.count("*").alias("n_text"))
    everything = files.groupBy("repo").agg(F.count("*").alias("n_files"))
    return everything.join(python, "repo", "left").join(text, "repo", "left").select(
        "repo", "n_files", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_python", "n_text")]
    )


@bind("s7_dotenv_files", "SELECT source AS repo, 'd' || doc_id || '/.env.production' AS path "
      "FROM documents WHERE doc_id % 33 = 32")
def dotenv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).filter("is_dotenv").select("repo", "path")


# How many nodes of each kind the programs hold, counted by hand from their text.
NODE_COUNTS = [
    (0, "ImportFrom", 1), (0, "Assign", 1), (0, "FunctionDef", 1), (0, "BinOp", 2),
    (1, "SyntaxError", 1),
    (2, "FunctionDef", 1), (2, "Call", 1),
    (3, "Assign", 1), (3, "Call", 2), (3, "JoinedStr", 1),
    (4, "FunctionDef", 1), (4, "Assign", 1), (4, "Call", 1), (4, "JoinedStr", 1),
    (5, "AsyncFunctionDef", 1), (5, "Call", 1),
    (7, "FunctionDef", 1), (7, "Assign", 1), (7, "ListComp", 1), (7, "Call", 1),
    (8, "FunctionDef", 1), (8, "Assign", 1), (8, "For", 1), (8, "Call", 1), (8, "BinOp", 1),
    (9, "FunctionDef", 1), (9, "Assign", 2), (9, "For", 1), (9, "Call", 1), (9, "BinOp", 1),
    (10, "ClassDef", 1), (10, "FunctionDef", 3),
    (11, "FunctionDef", 1), (11, "JoinedStr", 1),
    (12, "Import", 1), (12, "Call", 1),
    (13, "Assign", 1), (13, "Call", 2),
    (14, "Call", 1),
    (15, "FunctionDef", 1), (15, "Assign", 82),
    (16, "Call", 2), (16, "JoinedStr", 1),
    (17, "Call", 1), (17, "BinOp", 1),
    (18, "AsyncFunctionDef", 2),
    (19, "AsyncFunctionDef", 1), (19, "Await", 1), (19, "Call", 1),
    (20, "AsyncFunctionDef", 1), (20, "Call", 1),
    (21, "AsyncFunctionDef", 1), (21, "With", 1), (21, "Call", 1),
    (22, "Assign", 2), (22, "ListComp", 1), (22, "DictComp", 1),
    (23, "For", 1), (23, "While", 1), (23, "Assign", 2), (23, "Call", 3),
    (24, "Assign", 1),
    (25, "ClassDef", 1), (25, "FunctionDef", 16),
    (26, "ClassDef", 1), (26, "AnnAssign", 3), (26, "FunctionDef", 1),
    (27, "ClassDef", 1), (27, "AnnAssign", 1),
    (28, "FunctionDef", 3), (28, "Call", 4),
    (29, "FunctionDef", 1), (29, "Call", 1),
    (30, "Assign", 1), (30, "Call", 1),
    (31, "Assign", 1),
]


@bind("s6_facts_by_kind", f"""
    SELECT d.source AS repo, e.kind, CAST(sum(e.n) AS BIGINT) AS n_nodes, count(DISTINCT d.doc_id) AS n_files
    FROM documents d JOIN {values(NODE_COUNTS, 'e(template, kind, n)')} ON d.doc_id % 33 = e.template
    GROUP BY ALL
""")
def facts_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = extract_facts(corpus(spark, sf_dir))
    per_file = facts.groupBy("repo", "kind", "path").agg(F.count("*").alias("n"))
    return per_file.groupBy("repo", "kind").agg(F.sum("n").alias("n_nodes"), F.count("*").alias("n_files"))


@bind("s6_module_level_nodes", """
    SELECT source AS repo, count(*) AS n_modules, min(text_lines) AS min_text_lines FROM (
        SELECT source, len(string_split(text, chr(10))) AS text_lines FROM documents
        WHERE doc_id % 33 NOT IN (1, 6, 32))
    GROUP BY source
""")
def module_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every parsable file has one module node that spans all others (all node kinds kept)."""
    files = corpus(spark, sf_dir)
    facts = facts_of(spark, sf_dir)
    spans = facts.groupBy("repo", "path").agg(
        F.max(F.when(F.col("kind") == "Module", F.col("last"))).alias("last"), F.max("pre").alias("pre")
    ).filter("last = pre")
    texts = files.select(
        "repo", "path", F.size(F.filter(F.split("content", "\n"), lambda l: l.startswith("# "))).alias("n")
    )
    fixed = F.regexp_extract("path", r"(\d+)", 1).cast("long") % 33
    # One program starts with a comment line of its own.
    return spans.join(texts, ["repo", "path"]).groupBy("repo").agg(
        F.count("*").alias("n_modules"),
        F.min(F.col("n") - F.when(fixed == 31, 1).otherwise(0)).cast("long").alias("min_text_lines"),
    )


# --- Features ----------------------------------------------------------------------------

# Which programs set which flag; flags not listed are set by none.
FLAGS = {"fastapi": [0], "jwt": [14], "cors": [13], "docker": [6], "openapi": [30]}


@bind("d1_detect_stack", "SELECT source AS repo, " + ", ".join(
    f"bool_or(doc_id % 33 IN ({', '.join(map(str, FLAGS[f]))})) AS {f}" if f in FLAGS else f"false AS {f}"
    for f in features.FEATURES
) + " FROM documents GROUP BY source")
def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.detect_stack(corpus(spark, sf_dir))


@bind("d3_has_sql", "SELECT source AS repo, bool_or(doc_id % 33 IN (4, 11, 16, 17, 31)) AS has_sql "
      "FROM documents GROUP BY source")
def sql_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.has_sql(corpus(spark, sf_dir))


def counts_of(*kinds: str) -> dict[int, int]:
    out: dict[int, int] = {}
    for template, kind, n in NODE_COUNTS:
        if kind in kinds:
            out[template] = out.get(template, 0) + n
    return out


@bind("d4_repo_metrics", sums_sql({
    "python_files": {t: 1 for t in range(33) if t not in (6, 32)},
    "syntax_errors": counts_of("SyntaxError"),
    "functions": counts_of(*FUNCTIONS),
    "classes": counts_of("ClassDef"),
    "routes": {28: 3},
    "async_functions": counts_of("AsyncFunctionDef"),
    "decorated_routes": {28: 3},
    "files_scanned": {t: 1 for t in range(33)},
    "env_files": {32: 1},
    "large_files": {},
}))
def repo_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus(spark, sf_dir)
    return features.repo_metrics(files, facts_of(spark, sf_dir, *FUNCTIONS, "ClassDef", "SyntaxError"))


# --- Text rules --------------------------------------------------------------------------

on_lines("t1_hardcoded_secrets_in_code", lambda lines: text_rules.line_rules(lines, ["secrets"]),
         "SEC-HARDCODED-SECRET")
on_files("t2_secret_scan_in_code", "SEC-SECRET-SCAN")
on_files("t3_env_files", "SEC-ENV-FILE")
on_files("t5_docker_without_user", "DOCKER-NONROOT")
on_files("t6_docker_remote_add", "DOCKER-REMOTE-ADD")
on_lines("t8_t9_t10_sql_lines", lambda lines: text_rules.line_rules(lines, ["sql"]),
         "SQL-INJECTION-PATTERN", "SQL-INJECTION-FSTRING", "SQL-INJECTION-FORMAT")
on_lines("t11_t12_t13_disabled_docs", lambda lines: text_rules.line_rules(lines, ["docs"]),
         "FASTAPI-OPENAPI-DISABLED", "FASTAPI-DOCS-DISABLED", "FASTAPI-REDOC-DISABLED")
on_files("t14_clean_architecture", "ARCH-CLEAN-VIOLATION")
on_files("t15_mixed_concerns", "ARCH-MIXED-CONCERNS")
on_lines("t16_database_in_api", text_rules.database_in_api, "ARCH-DB-IN-API")
on_files("t_all_file_rules", "SEC-SECRET-SCAN", "SEC-ENV-FILE", "REPO-LARGE-FILE", "DOCKER-NONROOT",
         "DOCKER-REMOTE-ADD", "ARCH-CLEAN-VIOLATION", "ARCH-MIXED-CONCERNS")

# The .format rule has no program of its own: put one before each document's first word.
FORMATTED = 'q = "SELECT a FROM t WHERE b = {}".format(b)'


@bind("t10_format_lines", f"""
    SELECT source AS repo, doc_id || '.py' AS file, r.rule_id, CAST(1 AS INTEGER) AS line
    FROM documents, (VALUES ('SQL-INJECTION-PATTERN'), ('SQL-INJECTION-FORMAT')) r(rule_id) WHERE doc_id % 5 = 0
""")
def format_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from auditloom.plans.bound.base import document_files

    files = document_files(spark, sf_dir)
    fifth = F.regexp_extract("path", r"(\d+)", 1).cast("long") % 5 == 0
    seeded = files.withColumn("content", F.when(fifth, F.concat(F.lit(FORMATTED + "\n# "), F.col("content"))).otherwise(F.col("content")))
    return text_rules.line_rules(to_lines(seeded), ["sql"]).select("repo", "file", "rule_id", "line")


# --- Contexts ----------------------------------------------------------------------------


@bind("c1_loop_depth", per_template_sql(
    [(8, "append", 5, 1), (9, "query", 4, 1), (23, "sorted", 2, 1), (23, "list", 4, 1), (23, "range", 4, 1)],
    ["name", "line", "loop_depth"]))
def loop_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    depth = scopes.loop_depth(F.col("scopes"))
    return facts_of(spark, sf_dir, "Call").select(
        "repo", F.col("path").alias("file"), "name", F.col("lineno").alias("line"), depth.alias("loop_depth")
    ).filter("loop_depth > 0")


@bind("c2_calls_in_async", per_template_sql(
    [(5, "sleep", 3), (19, "sleep", 2), (20, "fetch_all", 2), (21, "connect", 2)], ["name", "line"]))
def calls_in_async(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts_of(spark, sf_dir, "Call").filter(scopes.in_async(F.col("scopes"))).select(
        "repo", F.col("path").alias("file"), "name", F.col("lineno").alias("line")
    )


@bind("c3_nearest_function", per_template_sql(
    [(2, "eval", "compute"), (4, "strip", "dropped"), (5, "sleep", "pause"), (7, "get", "labels"), (8, "append", "evens"),
     (9, "query", "stock_of"), (19, "sleep", "a"), (20, "fetch_all", "a"), (21, "connect", "a"),
     (28, "get", "read_a"), (28, "get", "health"), (28, "get", "read_b"), (28, "Security", "read_b"),
     (29, "Depends", "f")], ["name", "function"]))
def nearest_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts_of(spark, sf_dir, "Call").select(
        "repo", F.col("path").alias("file"), "name",
        scopes.nearest_function(F.col("scopes"))["name"].alias("function"),
    ).filter("function IS NOT NULL")


# --- Code rules --------------------------------------------------------------------------

on_nodes("a1_syntax_errors", "PY-SYNTAX")
on_nodes("a2_long_functions", "PY-LONG-FUNCTION")
on_nodes("a3_untyped_parameters", "PY-UNTYPED")
on_nodes("a4_dynamic_code", "SEC-EVAL")
on_nodes("a5_shell_calls", "SEC-SHELL")
on_nodes("a6_debug_mode", "PROD-DEBUG")
on_nodes("a7_cors_wildcard", "API-CORS-WILDCARD")
on_nodes("a8_unsigned_tokens", "AUTH-JWT-NONE")


@bind("a1_syntax_error_table", per_template_sql([(1, "'(' was never closed", 1)], ["msg", "line"]))
def syntax_error_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax_errors(facts_of(spark, sf_dir, "SyntaxError")).select(
        "repo", F.col("path").alias("file"), "msg", F.col("lineno").alias("line")
    )


@bind("a9_route_decorators", per_template_sql(
    [(28, "read_a", "get"), (28, "health", "get"), (28, "read_b", "get")], ["function", "method"]))
def route_decorators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts_of(spark, sf_dir, *FUNCTIONS).select(
        "repo", F.col("path").alias("file"), F.col("name").alias("function"),
        F.explode(F.filter("items", features.is_route_decorator)).alias("d"),
    ).select("repo", "file", "function", F.col("d.name").alias("method"))


@bind("a11_sensitive_definitions", per_template_sql([(3, "api_token")], ["name"]))
def sensitive_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.sensitive_definitions(facts_of(spark, sf_dir, "Assign", "FunctionDef")).select(
        "repo", F.col("path").alias("file"), "name"
    )


@bind("a11_dataflow_metrics", sums_sql(
    {"sensitive_vars_found": {3: 1}, "potential_leaks": {3: 2}}, keep_zero=False))
def dataflow_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.dataflow_metrics(store_facts(facts_of(spark, sf_dir, "Assign", "FunctionDef", "Call")))


on_facts("a12_a13_dataflow_leaks", code.leaks, ["Assign", "FunctionDef", "Call"],
         "DATAFLOW-LOGGING-LEAK", "DATAFLOW-PRINT-LEAK")
on_nodes("a14_text_fstrings", "SQLALCHEMY-FSTRING-TEXT")
on_nodes("a15_concat_execute", "SQL-CONCAT-EXECUTE")
on_nodes("a16_fstring_sql", "SQL-INJECTION-FSTRING-KEYWORDS")


@bind("a17_sql_metrics", sums_sql(
    {"sql_statements_found": {4: 1, 16: 2, 17: 2}, "potential_injections": {4: 3, 16: 4, 17: 1}}, keep_zero=False))
def sql_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = to_lines(select_python(corpus(spark, sf_dir)))
    facts = store_facts(facts_of(spark, sf_dir, "Call", "JoinedStr"))
    found = (
        text_rules.line_rules(lines, ["sql"]).unionByName(code.node_findings(facts, [
            "SQLALCHEMY-FSTRING-TEXT", "SQL-CONCAT-EXECUTE", "SQL-INJECTION-FSTRING-KEYWORDS"]))
    )
    return code.sql_metrics(lines, facts, found)


on_nodes("a18_nested_async", "ASYNC-NESTED-FUNCTION")
on_nodes("a19_blocking_await", "ASYNC-BLOCKING-AWAIT")
on_nodes("a20_blocking_io", "ASYNC-BLOCKING-IO")


@bind("a21_a22_unawaited", findings_sql("ASYNC-MISSING-AWAIT", "ASYNC-CONTEXT-MANAGER"))
def unawaited(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = to_lines(select_python(corpus(spark, sf_dir)))
    return code.unawaited(facts_of(spark, sf_dir, "Call", "With"), lines).select(*SHOWN)


on_facts("a23_queries_in_loops", code.queries_in_loops, ["Call"], "PERF-N-PLUS-ONE")
on_nodes("a24_allocations_in_loops", "PERF-LIST-IN-LOOP")
on_nodes("a25_expensive_in_loops", "PERF-EXPENSIVE-IN-LOOP")
on_nodes("a26_list_comprehensions", "PERF-COMPLEX-COMPREHENSION")
on_nodes("a27_dict_comprehensions", "PERF-COMPLEX-DICT-COMP")
on_nodes("a28_large_literals", "PERF-LARGE-DATA-STRUCTURE")


@bind("a29_performance_metrics", sums_sql({
    "n_plus_one_patterns": {9: 1}, "expensive_loops": {23: 2}, "redundant_calculations": {},
    "large_data_structures": {24: 1}, "inefficient_algorithms": {22: 2},
}, keep_zero=False))
def performance_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["Call", "For", "While", "BinOp", "Assign", "ListComp", "DictComp"]
    return code.performance_metrics(store_facts(facts_of(spark, sf_dir, *kinds)))


on_facts("a30_god_classes", code.god_classes, FUNCTIONS, "ARCH-GOD-CLASS")

MODEL_KINDS = ["ClassDef", "AnnAssign", *FUNCTIONS]
on_facts("a31_a33_a36_model_fields", model_rules.field_rules, MODEL_KINDS, "PYDANTIC-UNTYPED-FIELD",
         "PYDANTIC-MUTABLE-DEFAULT", "PYDANTIC-OPTIONAL-NO-DEFAULT")
on_facts("a32_custom_init", model_rules.custom_init, MODEL_KINDS, "PYDANTIC-CUSTOM-INIT")
on_facts("a34_unvalidated_secrets", model_rules.unvalidated_secrets, MODEL_KINDS,
         "PYDANTIC-SENSITIVE-NO-VALIDATOR")
on_nodes("a35_odd_bases", "PYDANTIC-NO-BASEMODEL")


@bind("a31_untyped_fields", """
    SELECT source AS repo, doc_id || '.py' AS file, CAST(2 AS INTEGER) AS line,
           'Field ''a' || doc_id || ''' in model ''M'' has no type annotation.' AS detail
    FROM documents WHERE doc_id % 3 = 0
""")
def untyped_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model field annotated with a literal ``...`` in every third document."""
    from auditloom.plans.seeded import comments

    ident = F.col("doc_id").cast("string")
    kind = F.when(F.col("doc_id") % 3 == 0, "...").otherwise("int")
    body = F.concat(F.lit("class M(BaseModel):\n    a"), ident, F.lit(": "), kind, F.lit(" = 1\n"), comments())
    files = describe(table(spark, sf_dir, "documents").select(
        F.col("source").alias("repo"), F.concat(ident, F.lit(".py")).alias("path"), body.alias("content")
    ).withColumn("size", F.octet_length("content")))
    facts = store_facts(extract_facts(files, ["ClassDef", "AnnAssign"]))
    return model_rules.field_rules(facts).filter("rule_id = 'PYDANTIC-UNTYPED-FIELD'").select(
        "repo", "file", "line", "detail"
    )


@bind("a37_model_metrics", sums_sql({
    "pydantic_models_found": {26: 1, 27: 1}, "models_with_validators": {}, "models_with_config": {},
    "untyped_fields": {}, "models_with_aliases": {},
}, keep_zero=False))
def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus(spark, sf_dir)
    return model_rules.model_metrics(store_facts(facts_of(spark, sf_dir, *MODEL_KINDS)), to_lines(select_python(files)))


on_nodes("a_all_node_rules", *code.NODE_RULES)

# --- Whole audits ------------------------------------------------------------------------

# Repositories of five consecutive documents, so that scores differ.
SMALL_REPO_SQL = "'r' || (doc_id // 5)"

# Features each rule's family asks for, by the programs that set them.
GATED = {
    "sql": (["SQL-INJECTION-PATTERN", "SQL-INJECTION-FSTRING", "SQLALCHEMY-FSTRING-TEXT", "SQL-CONCAT-EXECUTE",
             "SQL-INJECTION-FSTRING-KEYWORDS"], [4, 11, 16, 17, 31]),
    "deps": (["FASTAPI-UNPROTECTED-ROUTE", "FASTAPI-MISSING-DEP"], [0]),
    "openapi": (["FASTAPI-OPENAPI-DISABLED", "FASTAPI-DOCS-DISABLED", "FASTAPI-REDOC-DISABLED"], [0, 30]),
    "pydantic": (["PYDANTIC-CUSTOM-INIT", "PYDANTIC-MUTABLE-DEFAULT", "PYDANTIC-SENSITIVE-NO-VALIDATOR",
                  "PYDANTIC-OPTIONAL-NO-DEFAULT", "PYDANTIC-NO-BASEMODEL"], [-1]),
}
ALWAYS = [
    "PY-SYNTAX", "SEC-EVAL", "SEC-SHELL", "SEC-HARDCODED-SECRET", "SEC-SECRET-SCAN", "PROD-DEBUG",
    "API-CORS-WILDCARD", "DOCKER-REMOTE-ADD",
]


def audit_sql(rules: list[str] | None = None, families: list[str] = tuple(GATED)) -> str:
    """Expected findings of an audit of the small repositories, with the gates applied."""
    flags = ", ".join(
        f"bool_or(doc_id % 33 IN ({', '.join(map(str, templates))})) AS has_{name}"
        for name, (_, templates) in GATED.items()
    )
    open_gates = " AND ".join(
        f"(rule_id NOT IN ({', '.join(literal(r) for r in names)}) OR has_{family})"
        for family, (names, _) in GATED.items()
    )
    return f"""
        SELECT f.repo, f.rule_id, f.severity, f.confidence, f.file, f.line, '' AS title FROM (
            SELECT {SMALL_REPO_SQL} AS repo, rule_id, severity, confidence,
                   CASE WHEN rule_id = 'FASTAPI-MISSING-DEP' THEN NULL ELSE {PATH_SQL} END AS file,
                   CAST(line AS INTEGER) AS line
            FROM ({labelled_sql(rules)})
            -- The line rules skip files that don't parse.
            WHERE rule_id <> 'SEC-HARDCODED-SECRET' OR doc_id % 33 <> 1) f
        JOIN (SELECT {SMALL_REPO_SQL} AS repo, {flags} FROM documents GROUP BY ALL) g ON f.repo = g.repo
        WHERE {open_gates}
    """


def small_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.regexp_extract("path", r"(\d+)", 1).cast("long")
    files = corpus(spark, sf_dir)
    return files.withColumn("repo", F.concat(F.lit("r"), F.floor(number / 5).cast("string")))


@bind("audit_deep_findings", f"SELECT repo, rule_id, severity, confidence, file, line FROM ({audit_sql()})")
def deep_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(small_repos(spark, sf_dir), deep=True).ranked.select(
        "repo", "rule_id", "severity", "confidence", "file", "line"
    )


@bind("audit_deep_scores", score_sql(audit_sql(), f"SELECT DISTINCT {SMALL_REPO_SQL} AS repo FROM documents"))
def deep_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(small_repos(spark, sf_dir), deep=True).scores


PERFORMANCE = [
    "PERF-N-PLUS-ONE", "PERF-LIST-IN-LOOP", "PERF-EXPENSIVE-IN-LOOP", "PERF-COMPLEX-COMPREHENSION",
    "PERF-COMPLEX-DICT-COMP", "PERF-LARGE-DATA-STRUCTURE",
]


@bind("audit_performance_only", f"SELECT repo, rule_id, file, line FROM ({audit_sql(ALWAYS + PERFORMANCE)})")
def performance_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(small_repos(spark, sf_dir), families={"performance"}).findings.select(
        "repo", "rule_id", "file", "line"
    )


@bind("audit_standard_reports", f"""
    SELECT s.repo, s.score, coalesce(n, 0) AS n_findings
    FROM ({score_sql(audit_sql(ALWAYS), f"SELECT DISTINCT {SMALL_REPO_SQL} AS repo FROM documents")}) s
    LEFT JOIN (SELECT repo, count(*) AS n FROM ({audit_sql(ALWAYS)}) GROUP BY repo) f ON s.repo = f.repo
""")
def standard_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON reports of a standard audit, read back."""
    documents = audit(small_repos(spark, sf_dir)).reports()
    parsed = documents.select("repo", F.from_json(
        "json", "project string, score int, findings array<struct<rule_id:string>>").alias("r"))
    return parsed.filter("r.project = repo").groupBy("repo").agg(
        F.max("r.score").alias("score"), F.sum(F.size("r.findings")).alias("n_findings")
    )


@bind("r12_sarif_levels", f"""
    SELECT repo, rule_id, CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'error'
                               WHEN severity = 'MEDIUM' THEN 'warning' ELSE 'note' END AS level,
           count(*) AS n, count(file) AS n_located, count(line) AS n_lines
    FROM ({findings_sql(*ALWAYS, 'ASYNC-NESTED-FUNCTION', 'FASTAPI-MISSING-DEP', 'PY-UNTYPED')})
    GROUP BY ALL
""")
def sarif_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SARIF logs written and read back."""
    from auditloom.operators import route_rules

    files = corpus(spark, sf_dir)
    facts = store_facts(extract_facts(files, [*FUNCTIONS, "Call", "SyntaxError"]))
    found = (
        code.node_findings(facts, [
            "PY-SYNTAX", "SEC-EVAL", "SEC-SHELL", "PROD-DEBUG", "API-CORS-WILDCARD", "ASYNC-NESTED-FUNCTION",
            "PY-UNTYPED"])
        .unionByName(text_rules.line_rules(to_lines(select_python(files)), ["secrets"]))
        .unionByName(text_rules.file_findings(files, ["SEC-SECRET-SCAN", "DOCKER-REMOTE-ADD"]))
        .unionByName(route_rules.missing_dependencies(facts))
    )
    place = f"{scratch_dir(spark)}/reports-{uuid.uuid4()}"
    reports.write_findings(dedup(with_defaults(found)), f"{place}/findings")
    reports.write_documents(reports.to_sarif(spark.read.parquet(f"{place}/findings")), f"{place}/sarif")
    logs = spark.read.parquet(f"{place}/sarif")
    result = (
        "struct<ruleId:string,level:string,locations:array<struct<physicalLocation:"
        "struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>>"
    )
    parsed = logs.select("repo", F.from_json("json", f"runs array<struct<results:array<{result}>>>").alias("log"))
    results = parsed.select("repo", F.explode(F.col("log.runs")[0]["results"]).alias("r"))
    place = F.col("r.locations")[0]["physicalLocation"]
    return results.groupBy("repo", F.col("r.ruleId").alias("rule_id"), F.col("r.level").alias("level")).agg(
        F.count("*").alias("n"), F.count(place["artifactLocation"]["uri"]).alias("n_located"),
        F.count(place["region"]["startLine"]).alias("n_lines"),
    )


@bind("r4_translated_findings", f"""
    SELECT repo, rule_id, file, line,
           CASE rule_id WHEN 'FASTAPI-DOCS-DISABLED' THEN 'Documentation FastAPI'
                        WHEN 'FASTAPI-REDOC-DISABLED' THEN 'Documentation FastAPI' ELSE 'Sécurité FastAPI' END AS category,
           CASE rule_id WHEN 'FASTAPI-DOCS-DISABLED' THEN 'Interface Swagger désactivée'
                        WHEN 'FASTAPI-REDOC-DISABLED' THEN 'Interface ReDoc désactivée'
                        ELSE 'OpenAPI documentation disabled' END AS title
    FROM ({findings_sql('FASTAPI-OPENAPI-DISABLED', 'FASTAPI-DOCS-DISABLED', 'FASTAPI-REDOC-DISABLED')})
""")
def translated_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = to_lines(select_python(corpus(spark, sf_dir)))
    return translate(text_rules.line_rules(lines, ["docs"])).select(
        "repo", "rule_id", "file", "line", "category", "title"
    )
