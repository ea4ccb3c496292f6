"""The parse job against direct use of the ast module."""

import ast
import inspect
import textwrap

from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa
import pytest
from pyspark.sql.pandas.types import to_arrow_schema

from auditloom.schemas import FACTS
from auditloom.sources import facts
from auditloom.sources.facts import (
    LONG_TEXT, MARKERS, RULE_KINDS, extract_facts, file_facts, imports, number_nodes, store_facts,
)

SOURCES = [inspect.getsource(m) for m in (ast, inspect, textwrap)]


def children(node):
    return [c for c in ast.iter_child_nodes(node) if not isinstance(c, MARKERS)]


def walk(tree):
    """Breadth first, as ast.walk, without position-less markers."""
    return [n for n in ast.walk(tree) if not isinstance(n, MARKERS)]


@pytest.mark.parametrize("source", SOURCES)
def test_numbers_follow_visiting_order(source):
    tree = ast.parse(source)
    nodes = number_nodes(tree)
    assert [n["pre"] for n in nodes] == list(range(len(nodes)))
    order = []

    def visit(node):
        order.append(node)
        for child in children(node):
            visit(child)

    visit(tree)
    assert [n["node"] for n in nodes] == order
    by_level = sorted(nodes, key=lambda n: (n["depth"], n["pre"]))
    assert [n["node"] for n in by_level] == walk(tree)


@pytest.mark.parametrize("source", SOURCES)
def test_intervals_hold_exactly_the_subtree(source):
    nodes = number_nodes(ast.parse(source))
    for entry in nodes[::37]:
        inside = {id(n) for n in walk(entry["node"])}
        assert {id(n["node"]) for n in nodes[entry["pre"]:entry["last"] + 1]} == inside


def test_names_in_arguments():
    rows = [r for r in file_facts("print(a, f(b)(c), k=d)\n", frozenset(["Call"])) if r["name"] == "print"]
    assert rows[0]["arg_names"] == ["a", "b", "c", "f"]


TERMS = st.recursive(
    st.sampled_from(["a", "bb", "long_name_here", "1", "f(x)", "'text of some length'"]),
    lambda inner: st.tuples(inner, st.sampled_from("+-*/%"), inner).map(lambda t: f"({t[0]} {t[1]} {t[2]})"),
    max_leaves=12,
)


@given(TERMS)
@settings(max_examples=200, deadline=None)
def test_operand_lengths_equal_direct_unparsing(term):
    source = f"x = {term}\n"
    rows = {r["pre"]: r for r in file_facts(source, frozenset(["BinOp"]))}
    for entry in number_nodes(ast.parse(source)):
        node = entry["node"]
        if isinstance(node, ast.BinOp) and isinstance(node.op, (ast.Add, ast.Sub, ast.Mult, ast.Div)):
            for side in ("left", "right"):
                want = min(len(ast.unparse(getattr(node, side))), LONG_TEXT)
                assert rows[entry["pre"]][side + "_len"] == want


def test_long_chains_do_not_fail():
    source = "x = " + " + ".join(["value"] * 3000) + "\n"
    rows = list(file_facts(source, frozenset(["BinOp", "SyntaxError"])))
    assert {r["kind"] for r in rows} <= {"BinOp", "SyntaxError"} and rows


@pytest.mark.parametrize("source", ["def broken(\n", "x = '\0'\n", "(" * 5000 + ")" * 5000])
def test_any_parse_failure_is_a_row(source):
    assert [r["kind"] for r in file_facts(source, None)] == ["SyntaxError"]


def test_facts_table_equals_direct_parse(spark, make_files, tmp_path):
    files = make_files({("r", f"m{i}.py"): s for i, s in enumerate(SOURCES)} | {("r", "notes.txt"): "x = 1\n"})
    facts = store_facts(extract_facts(files, None), str(tmp_path / "facts"))
    got = {(r["path"], r["kind"]): r["count"] for r in facts.groupBy("path", "kind").count().collect()}
    want = {}
    for i, source in enumerate(SOURCES):
        for node in walk(ast.parse(source)):
            key = (f"m{i}.py", type(node).__name__)
            want[key] = want.get(key, 0) + 1
    assert got == want
    modules = {(r["path"], r["module"]) for r in imports(facts).collect()}
    assert ("m2.py", "re") in modules


def test_stored_facts_are_read_by_kind(spark, make_files, tmp_path):
    facts = store_facts(extract_facts(make_files({("r", "a.py"): SOURCES[2]}), RULE_KINDS), str(tmp_path / "facts"))
    plan = facts.filter("kind = 'Call'").select("name")._jdf.queryExecution().explainString(
        facts.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(kind,Call)" in plan and "ReadSchema: struct<kind:string,name:string>" in plan


POISON = [
    "f(x=0x" + "f" * 5000 + ")\n",
    "for i in r:\n    y = z + 0x" + "f" * 5000 + "\n",
    "while 0x" + "f" * 5000 + ":\n    y = g(1)\n",
    'f(a="\\udc80")\n',
    'x = f"\\ud800{a}"\n',
]


@pytest.mark.parametrize("source", POISON)
def test_odd_constants_do_not_end_the_job(spark, make_files, source):
    files = make_files({("r", "odd.py"): source, ("r", "good.py"): "eval(1)\n"})
    rows = extract_facts(files, None).collect()
    assert any(r["path"] == "good.py" and r["name"] == "eval" for r in rows)
    assert any(r["path"] == "odd.py" for r in rows)


def test_batches_stay_small():
    """Facts leave in small batches, also those of long texts, and a batch of texts goes before the next one comes."""
    schema = to_arrow_schema(FACTS)
    wide = pa.schema([("repo", pa.string()), ("path", pa.string()), ("content", pa.string())])
    many, long = "f(1)\n" * 5_000, "for i in r:\n" + "    x = 'some words of a text'\n" * 20_000
    held, base = [], pa.total_allocated_bytes()

    def batches():
        for contents in ([many] * 3, [], [long] * 20):
            held.append(pa.total_allocated_bytes() - base)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (["r"] * len(contents), ["p"] * len(contents), contents)], schema=wide)

    sizes, chars = [], []
    for out in facts.fact_batches(batches(), frozenset(["Call", "For"]), schema):
        sizes.append(out.num_rows)
        chars.append(out.column("text").nbytes)
        del out
    assert sum(sizes) == 15_000 + 20 and max(sizes) <= 2_000
    assert max(chars) < 6_000_000
    assert max(held) < 20_000
