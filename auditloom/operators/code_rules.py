"""Rules over the facts table.

Most rules are decided by one node row, whose nested columns already hold what the rule
compares; those are listed in ``NODE_RULES`` and all run in one pass. The others combine
nodes of a file by aggregates or equi-joins.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import paths, scopes, text
from auditloom.operators.findings import emit, emit_by_rule, emit_hits, hit
from auditloom.operators.marks import mark_lines
from auditloom.operators.rules_catalog import BLOCKING_DOTTED_ADVICE, RULES
from auditloom.operators.windows import earlier_than

FUNCTIONS = tuple(scopes.FUNCTIONS)

# Call names each rule looks for.
DYNAMIC_CODE = ["eval", "exec"]
PROCESS_CALLS = ["run", "Popen", "call", "check_call", "check_output"]
TOKEN_CALLS = ["decode", "encode"]
LOG_METHODS = ["info", "debug", "warning", "error", "critical"]
EXECUTE_CALLS = ["execute", "executemany"]
AWAITED_BLOCKING = ["sleep", "open", "input", "print"]
BLOCKING_DOTTED = ["open", "input", "time.sleep", "requests.get", "requests.post"]
BLOCKING_BARE = ["open", "read", "write", "input", "print", "sleep"]
AWAITABLE_WORDS = [
    "fetch", "get", "post", "put", "delete", "execute", "query", "read", "write", "send", "receive",
]
ASYNC_CONTEXTS = ["connect", "session", "transaction", "pool"]
QUERY_METHODS = [
    "query", "execute", "scalar", "scalars", "find_one", "fetchone", "fetchall", "first", "one",
    "one_or_none",
]
DATABASE_ROOTS = ["db", "session", "database", "connection", "conn", "cursor"]
QUERY_ANYWHERE = ["query", "execute", "scalars"]
EXPENSIVE_CALLS = [
    "deepcopy", "copy.deepcopy", "pickle.dumps", "json.dumps", "xml.etree.ElementTree",
    "re.compile", "sorted", "list.sort",
]

# Bases that make a class a model, in any case.
MODEL_BASES = r"(?iu)BaseModel|pydantic"

# Large allocations in the text of a loop body.
LARGE_ALLOCATIONS = [r"list\(range\([1-9]\d{5,}\)\)", r"\[[^\]]*\]\s*\*\s*[1-9]\d{5,}"]

# Thresholds.
LONG_FUNCTION = 80
SHOWN_PARAMS = 8
SENSITIVE_LENGTH = 8
MANY_GENERATORS = 2
MANY_ELEMENTS = 50
MANY_METHODS = 15
MANY_LINES = 300
LONG_OPERAND = 20


def functions(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("kind").isin(scopes.FUNCTIONS))


def calls(facts: DataFrame) -> DataFrame:
    return facts.filter("kind = 'Call'")


def is_bare() -> Column:
    """The callee is a plain name."""
    return F.col("name").isNotNull() & F.col("owner").isNull()


def is_method() -> Column:
    """The callee is an attribute of something."""
    return F.col("name").isNotNull() & F.col("owner").isNotNull()


def keyword(name: str) -> Column:
    """The last keyword argument of that name as a struct, or null."""
    return F.try_element_at(F.filter("kwargs", lambda k: k["kw"] == name), F.lit(-1))


def is_true(argument: Column) -> Column:
    return (argument["type"] == "bool") & (argument["value"] == "True")


# --- Rules on a single node ---------------------------------------------------------------


@dataclass(frozen=True)
class NodeRule:
    """A rule that one node row decides alone. Columns are built when the rule is used."""

    kinds: tuple[str, ...]
    broken: Callable[[], Column]
    detail: Callable[[], Column] | None = None
    confidence: str = "MEDIUM"
    advice: Callable[[], Column] | None = None
    times: Callable[[], Column] | None = None  # findings per node, one if not given


def span() -> Column:
    return F.col("end_lineno") - F.col("lineno")


def unannotated() -> Column:
    bare = F.filter("params", lambda p: ~p["annotated"] & ~p["name"].isin("self", "cls"))
    return F.transform(bare, lambda p: p["name"])


def has_unsigned_token() -> Column:
    chosen = F.coalesce(keyword("algorithm"), keyword("algorithms"))
    alone = F.array(F.struct(*[chosen[c].alias(c) for c in ("kind", "type", "value")]))
    values = F.when(chosen["kind"].isin("List", "Tuple"), chosen["elts"]).otherwise(alone)
    return F.exists(values, lambda v: (v["kind"] == "Constant") & (F.lower(v["value"]) == "none"))


def first_item() -> Column:
    return F.try_element_at("items", F.lit(1))


def dotted_name() -> Column:
    """``f`` or ``x.f`` when the callee is that simple, else null."""
    return F.when(is_bare(), F.col("name")).when(
        is_method() & (F.col("owner") != ""), F.concat_ws(".", "owner", "name")
    )


def is_dotted_blocking() -> Column:
    return F.coalesce(dotted_name().isin(BLOCKING_DOTTED), F.lit(False))


def is_blocking(exact: bool = False) -> Column:
    """A blocking call in async code. A bare name also matches when a listed name ends with
    it; ``exact`` asks for the whole name."""
    listed = F.col("name").isin(BLOCKING_BARE)
    matches = listed if exact else listed | text.ends_with_any(BLOCKING_BARE, F.col("name"))
    return scopes.in_async(F.col("scopes")) & (is_dotted_blocking() | (is_bare() & matches))


def is_expensive(exact: bool = False) -> Column:
    listed = F.col("name").isin(EXPENSIVE_CALLS)
    return is_bare() & (listed if exact else listed | text.ends_with_any(EXPENSIVE_CALLS, F.col("name")))


def is_model() -> Column:
    """The list of bases mentions the model base."""
    return (F.col("kind") == "ClassDef") & F.col("text").rlike(MODEL_BASES)


def is_in_loop() -> Column:
    return scopes.loop_depth(F.col("scopes")) > 0


def describe(pattern: str, *columns: str | Callable[[], Column]) -> Callable[[], Column]:
    """A detail text with columns filled in."""
    return lambda: F.format_string(pattern, *[F.col(c) if isinstance(c, str) else c() for c in columns])


NODE_RULES: dict[str, NodeRule] = {
    "PY-SYNTAX": NodeRule(("SyntaxError",), lambda: F.lit(True), lambda: F.col("text")),
    "PY-LONG-FUNCTION": NodeRule(
        FUNCTIONS, lambda: span() > LONG_FUNCTION,
        describe("`%s` s'étend sur environ %d lignes.", "name", span)),
    "PY-UNTYPED": NodeRule(
        FUNCTIONS, lambda: F.size(unannotated()) > 0,
        describe("`%s` contient des paramètres sans annotation: %s.", "name",
                 lambda: F.array_join(F.slice(unannotated(), 1, SHOWN_PARAMS), ", "))),
    "SEC-EVAL": NodeRule(
        ("Call",), lambda: is_bare() & F.col("name").isin(DYNAMIC_CODE), describe("%s() détecté.", "name")),
    "SEC-SHELL": NodeRule(
        ("Call",), lambda: is_method() & F.col("name").isin(PROCESS_CALLS)
        & F.exists("kwargs", lambda k: (k["kw"] == "shell") & is_true(k))),
    "PROD-DEBUG": NodeRule(("Call",), lambda: (F.col("name") == "FastAPI") & is_true(keyword("debug"))),
    "API-CORS-WILDCARD": NodeRule(("Call",), lambda: F.exists(
        keyword("allow_origins")["elts"], lambda e: (e["type"] == "str") & (e["value"] == "*"))),
    "AUTH-JWT-NONE": NodeRule(("Call",), lambda: F.col("name").isin(TOKEN_CALLS) & has_unsigned_token()),
    "SQLALCHEMY-FSTRING-TEXT": NodeRule(
        ("Call",), lambda: is_method() & (F.col("name") == "text"),
        times=lambda: F.size(F.filter("items", lambda a: a["kind"] == "JoinedStr"))),
    "SQL-CONCAT-EXECUTE": NodeRule(
        ("Call",), lambda: is_bare() & F.col("name").isin(EXECUTE_CALLS)
        & (first_item()["kind"] == "BinOp") & (first_item()["op"] == "Add")),
    "SQL-INJECTION-FSTRING-KEYWORDS": NodeRule(("JoinedStr",), lambda: text.looks_like_sql(F.col("text"))),
    "ASYNC-NESTED-FUNCTION": NodeRule(
        ("AsyncFunctionDef",), lambda: scopes.nearest_function(F.col("scopes"))["kind"] == "AsyncFunctionDef",
        describe("La fonction async `%s` est recréée à chaque appel de sa fonction parente.", "name"),
        confidence="LOW"),
    "ASYNC-BLOCKING-AWAIT": NodeRule(
        ("Await",), lambda: (first_item()["kind"] == "Call") & first_item()["owner"].isNull()
        & first_item()["name"].isin(AWAITED_BLOCKING),
        describe("Blocking function '%s' is being awaited.", lambda: first_item()["name"])),
    "ASYNC-BLOCKING-IO": NodeRule(
        ("Call",), is_blocking,
        lambda: F.when(
            is_dotted_blocking(), F.format_string("Blocking call '%s' used in an async function.", dotted_name())
        ).otherwise(F.format_string("Blocking I/O function '%s' called in async function.", F.col("name"))),
        advice=lambda: F.when(is_dotted_blocking(), BLOCKING_DOTTED_ADVICE).otherwise(
            RULES["ASYNC-BLOCKING-IO"].recommendation)),
    "PERF-LIST-IN-LOOP": NodeRule(
        ("For", "While"), lambda: F.col("text").rlike("(?U)" + "|".join(LARGE_ALLOCATIONS)), confidence="HIGH"),
    "PERF-EXPENSIVE-IN-LOOP": NodeRule(
        ("Call",), lambda: is_expensive() & is_in_loop(),
        describe("Expensive function '%s' called inside a loop.", "name")),
    "PERF-COMPLEX-COMPREHENSION": NodeRule(("ListComp",), lambda: F.col("n_generators") > MANY_GENERATORS),
    "PERF-COMPLEX-DICT-COMP": NodeRule(("DictComp",), lambda: F.col("n_generators") > MANY_GENERATORS),
    "PERF-LARGE-DATA-STRUCTURE": NodeRule(
        ("Assign",), lambda: F.col("value_kind").isin("List", "Dict", "Set", "Tuple")
        & (F.col("n_elts") > MANY_ELEMENTS),
        describe("Data structure with %d elements defined inline.", "n_elts")),
    "PYDANTIC-NO-BASEMODEL": NodeRule(
        ("ClassDef",), lambda: is_model() & ~F.exists(
            "items", lambda b: (b["role"] == "base") & (b["name"] == "BaseModel")),
        describe("Class '%s' doesn't appear to inherit from BaseModel.", "name")),
}


def node_hits(rule_id: str, rule: NodeRule, no_tests: bool) -> Column:
    """The hits of one rule on a node row, an empty array where it is kept."""
    found = F.array(hit(
        rule_id, detail=rule.detail() if rule.detail else None, line=F.col("lineno"),
        confidence=rule.confidence, recommendation=rule.advice() if rule.advice else None,
    ))
    if rule.times is not None:
        found = F.flatten(F.array_repeat(found, rule.times()))
    broken = F.col("kind").isin(list(rule.kinds)) & rule.broken()
    if no_tests:
        broken = broken & ~paths.is_test(F.col("path"))
    return F.when(broken, found).otherwise(F.array())


def node_findings(
    facts: DataFrame, rules: list[str] = tuple(NODE_RULES), skip_tests: list[str] = ()
) -> DataFrame:
    """Any number of single-node rules in one pass over the facts; some of them not on tests.

    Only rows of the kinds the rules name are read, nothing is joined or shuffled.
    """
    kinds = sorted({kind for rule in rules for kind in NODE_RULES[rule].kinds})
    hits = [node_hits(rule, NODE_RULES[rule], rule in skip_tests) for rule in rules]
    return emit_hits(facts.filter(F.col("kind").isin(kinds)), F.concat(*hits))


# --- Rules that combine nodes ---------------------------------------------------------------


def sensitive_definitions(facts: DataFrame) -> DataFrame:
    """(repo, path, name, pre): text constants and plain parameters named like secrets.

    Assignments and parameters come out of one scan.
    """
    targets = F.transform(F.filter("items", lambda t: t["kind"] == "Name"), lambda t: t["name"])
    params = F.transform(F.filter("params", lambda p: p["kind"] == "plain"), lambda p: p["name"])
    defining = facts.filter(
        (F.col("kind") == "FunctionDef")
        | ((F.col("kind") == "Assign") & (F.col("str_len") > SENSITIVE_LENGTH))
    )
    names = F.when(F.col("kind") == "Assign", targets).otherwise(params)
    return defining.select("repo", "path", F.explode(names).alias("name"), "pre").filter(
        text.is_sensitive_name(F.col("name"))
    )


def leaks(facts: DataFrame) -> DataFrame:
    """Sensitive names passed to logging or print after their definition in the file.

    Only names that look sensitive can match, so both sides shrink to a handful of rows
    per file before the one equi-join; "defined earlier" needs only the first definition.
    """
    logged = is_method() & F.col("name").isin(LOG_METHODS)
    printed = is_bare() & (F.col("name") == "print")
    used = calls(facts).filter(logged | printed).select(
        "repo", "path", "pre", "lineno",
        F.when(logged, "DATAFLOW-LOGGING-LEAK").otherwise("DATAFLOW-PRINT-LEAK").alias("rule"),
        F.explode("arg_names").alias("name"),
    ).filter(text.is_sensitive_name(F.col("name")))
    found = earlier_than(used, sensitive_definitions(facts), ["repo", "path", "name"], "pre", "pre")
    subject = F.concat(F.lit("Variable '"), F.col("name"), F.lit("' appears to contain sensitive data and is being "))
    details = {
        "DATAFLOW-LOGGING-LEAK": F.concat(subject, F.lit("passed to logging function.")),
        "DATAFLOW-PRINT-LEAK": F.concat(subject, F.lit("printed.")),
    }
    return emit_by_rule(found, "rule", details, line="lineno")


def dataflow_metrics(facts: DataFrame) -> DataFrame:
    """(repo, sensitive_vars_found, potential_leaks)."""
    counted = sensitive_definitions(facts).select("repo", F.lit(1).alias("s"), F.lit(0).alias("p")).unionByName(
        leaks(facts).select("repo", F.lit(0).alias("s"), F.lit(1).alias("p"))
    )
    return counted.groupBy("repo").agg(
        F.sum("s").alias("sensitive_vars_found"), F.sum("p").alias("potential_leaks")
    )


def sql_metrics(lines: DataFrame, facts: DataFrame, sql_findings: DataFrame) -> DataFrame:
    """(repo, sql_statements_found, potential_injections)."""
    statement_calls = calls(facts).filter(
        (is_method() & (F.col("name") == "text")) | (is_bare() & F.col("name").isin(EXECUTE_CALLS))
    )
    one, none = F.lit(1), F.lit(0)
    counted = (
        mark_lines(lines).filter("is_sql").select("repo", one.alias("s"), none.alias("p"))
        .unionByName(statement_calls.select("repo", one.alias("s"), none.alias("p")))
        .unionByName(sql_findings.select("repo", none.alias("s"), one.alias("p")))
    )
    return counted.groupBy("repo").agg(
        F.sum("s").alias("sql_statements_found"), F.sum("p").alias("potential_injections")
    )


def unawaited(facts: DataFrame, lines: DataFrame) -> DataFrame:
    """Calls that look awaitable, and context managers that look asynchronous, on source
    lines that neither await nor open asynchronously.

    Suspects of both kinds meet the few lines that hold either phrase in one join on file
    and line number.
    """
    method_call = (
        (F.col("kind") == "Call") & is_method() & ~is_dotted_blocking()
        & text.contains_any(F.lower("name"), AWAITABLE_WORDS)
    )
    opened = F.filter("items", lambda i: (
        (i["kind"] == "Call") & i["owner"].isNull() & text.contains_any(F.lower(i["name"]), ASYNC_CONTEXTS)
    ))
    names = F.when(method_call, F.array("name")).when(
        F.col("kind") == "With", F.transform(opened, lambda i: i["name"])
    )
    suspects = facts.filter(F.col("kind").isin("Call", "With") & scopes.in_async(F.col("scopes"))).select(
        "repo", "path", "lineno", F.explode(names).alias("name"),
        F.when(F.col("kind") == "Call", "ASYNC-MISSING-AWAIT").otherwise("ASYNC-CONTEXT-MANAGER").alias("rule"),
    )
    excused = mark_lines(lines).filter("awaits OR async_with").select(
        "repo", "path", F.col("line_no").alias("lineno"), "awaits", "async_with"
    )
    excuse = F.when(F.col("rule") == "ASYNC-MISSING-AWAIT", F.col("awaits")).otherwise(F.col("async_with"))
    hits = suspects.join(excused, ["repo", "path", "lineno"], "left").filter(~F.coalesce(excuse, F.lit(False)))
    details = {
        "ASYNC-MISSING-AWAIT": F.format_string(
            "Function call '%s' in async function may need await.", F.col("name")),
        "ASYNC-CONTEXT-MANAGER": F.format_string("Context manager '%s' may need 'async with'.", F.col("name")),
    }
    return emit_by_rule(hits, "rule", details, line="lineno")


def queries_in_loops(facts: DataFrame) -> DataFrame:
    """For each `for` loop the first database call in its body, breadth first.

    Each such call knows the loops around it, so the rule is an aggregate per loop.
    """
    method, root = F.lower("name"), F.lower("owner")
    known_root = root.isin(DATABASE_ROOTS)
    queries = calls(facts).filter(is_method()).filter(
        method.isin(QUERY_METHODS) & (known_root | method.isin(QUERY_ANYWHERE))
    )
    per_loop = queries.select(
        "repo", "path", F.explode(scopes.for_bodies(F.col("scopes"))).alias("loop"),
        F.struct(
            "depth", "pre", "lineno", method.alias("method"), root.alias("root"), known_root.alias("known")
        ).alias("call"),
    ).groupBy("repo", "path", "loop").agg(F.min("call").alias("call"))
    shown_root = F.when(F.col("call.root") == "", F.lit("objet")).otherwise(F.col("call.root"))
    detail = F.format_string(
        "L'appel base de données `%s.%s()` est exécuté dans une boucle.", shown_root, F.col("call.method")
    )
    return emit(
        per_loop, "PERF-N-PLUS-ONE", detail=detail, line="call.lineno",
        confidence=F.when(F.col("call.known"), "HIGH").otherwise("MEDIUM"),
    )


def performance_metrics(facts: DataFrame) -> DataFrame:
    """Five counts per repository."""
    metric_of = {
        "PERF-N-PLUS-ONE": "n_plus_one_patterns",
        "PERF-EXPENSIVE-IN-LOOP": "expensive_loops",
        "PERF-LIST-IN-LOOP": "expensive_loops",
        "PERF-LARGE-DATA-STRUCTURE": "large_data_structures",
        "PERF-COMPLEX-COMPREHENSION": "inefficient_algorithms",
        "PERF-COMPLEX-DICT-COMP": "inefficient_algorithms",
        "redundant": "redundant_calculations",
    }
    single = [rule for rule in metric_of if rule in NODE_RULES]
    counted = (
        node_findings(facts, single).select("repo", "rule_id")
        .unionByName(queries_in_loops(facts).select("repo", "rule_id"))
        .unionByName(redundant_calculations(facts).select("repo", F.lit("redundant").alias("rule_id")))
    )
    names = dict.fromkeys(metric_of.values())
    return counted.groupBy("repo").agg(*[
        F.count_if(F.col("rule_id").isin([r for r, m in metric_of.items() if m == name])).alias(name)
        for name in names
    ])


def redundant_calculations(facts: DataFrame) -> DataFrame:
    """Arithmetic with a long left side in a loop, or a long right side anywhere."""
    in_loop = scopes.loop_depth(F.col("scopes")) > 0
    long_left, long_right = F.col("left_len") > LONG_OPERAND, F.col("right_len") > LONG_OPERAND
    return facts.filter((F.col("kind") == "BinOp") & ((in_loop & long_left) | long_right)).select("repo", "path", "pre")


def big_groups(rows: DataFrame, keys: list[str], size: Column, max_rows: int, max_size: float) -> DataFrame:
    """Groups with more rows than one limit or a larger total than another."""
    totals = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(size).alias("total"))
    return totals.filter((F.col("n") > max_rows) | (F.col("total") > max_size))


def god_classes(facts: DataFrame) -> DataFrame:
    """Classes with many direct methods or many lines in them."""
    methods = functions(facts).filter("parent_kind = 'ClassDef' AND field = 'body'")
    keys = ["repo", "path", "parent", "parent_name", "parent_lineno"]
    hits = big_groups(methods, keys, F.col("end_lineno") - F.col("lineno"), MANY_METHODS, MANY_LINES)
    detail = F.format_string(
        "Class '%s' has %d methods and ~%d lines.", F.col("parent_name"), F.col("n"), F.col("total")
    )
    return emit(hits, "ARCH-GOD-CLASS", detail=detail, line="parent_lineno")
