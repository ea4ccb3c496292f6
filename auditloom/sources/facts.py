"""The parse job: each Python file is parsed once and becomes rows of syntax facts.

This is the only place where Python code touches file contents. It knows nothing about
rules: it turns a file into a table of nodes, and every rule is a DataFrame plan over
that table. One file's facts are bounded by the file, and
they are handed to Spark in small batches.
"""

from __future__ import annotations

import ast
import sys
import uuid
import warnings
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from auditloom.schemas import FACTS
from auditloom.session import scratch_dir, spread

# Executors get the functions of this module with the task, so nothing is installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A batch of facts ends after so many rows or, as one row may hold a long text, so many characters.
ROWS_PER_BATCH = 2_000
CHARS_PER_BATCH = 4_000_000
LONG_TEXT = 21  # an expression text of this length counts as "more than 20"

ROW_GROUP_BYTES = 16_000_000
SCOPE_NODES = (
    ast.For, ast.AsyncFor, ast.While, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef,
)
# Operators and expression contexts carry no position and no children.
MARKERS = (ast.expr_context, ast.operator, ast.boolop, ast.unaryop, ast.cmpop)

# The node kinds that any rule reads; the parse job can be asked for fewer, or for all.
RULE_KINDS = [
    "FunctionDef", "AsyncFunctionDef", "ClassDef", "Call", "Await", "With", "For", "While",
    "ListComp", "DictComp", "Assign", "AnnAssign", "BinOp", "JoinedStr", "Import", "ImportFrom",
    "SyntaxError",
]


def extract_facts(files: DataFrame, kinds: list[str] | None = RULE_KINDS) -> DataFrame:
    """Facts of every Python file of ``files``; ``kinds=None`` keeps every node."""
    readable = files.filter(
        F.col("is_py") & (F.col("content") != "")
    ).select("repo", "path", "content")
    wanted = None if kinds is None else frozenset(kinds)
    schema = to_arrow_schema(FACTS)
    return spread(readable).mapInArrow(lambda batches: fact_batches(batches, wanted, schema), FACTS)


def fact_batches(
    batches: Iterable[pa.RecordBatch], wanted: frozenset[str] | None, schema: pa.Schema
) -> Iterator[pa.RecordBatch]:
    """Batches of facts for batches of (repo, path, content)."""
    warnings.simplefilter("ignore")
    pending: list[dict] = []
    chars = 0
    for batch in batches:
        for repo, path, content in zip(*(batch.column(i) for i in range(3))):
            key = {"repo": repo.as_py(), "path": path.as_py()}
            for fact in file_facts(content.as_py(), wanted):
                pending.append(key | fact)
                chars += len(fact.get("text") or "")
                if len(pending) >= ROWS_PER_BATCH or chars >= CHARS_PER_BATCH:
                    yield to_batch(pending, schema)
                    pending, chars = [], 0
        # A batch of texts goes before the next one comes, also from the allocator.
        batch = repo = path = content = None
        pa.default_memory_pool().release_unused()
    if pending:
        yield to_batch(pending, schema)


def store_facts(facts: DataFrame, path: str | None = None) -> DataFrame:
    """Keep facts so that many rules can share one parse.

    A Parquet table at ``path`` or else in the session's shared folder, one file per task
    and sorted by node kind inside each file: a rule then reads only the row groups and
    pages of its kinds and only the columns it names, and nothing had to be shuffled.
    """
    spark = facts.sparkSession
    place = path or f"{scratch_dir(spark)}/facts-{uuid.uuid4()}"
    sorted_facts = facts.sortWithinPartitions("kind")
    sorted_facts.write.mode("overwrite").option("parquet.block.size", ROW_GROUP_BYTES).parquet(place)
    return spark.read.schema(FACTS).parquet(place)


def to_batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([to_array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def to_array(values: list, kind: pa.DataType) -> pa.Array:
    try:
        return pa.array(values, type=kind)
    except UnicodeEncodeError:
        return pa.array([encodable(v) for v in values], type=kind)


def encodable(value: object) -> object:
    """The value with lone surrogates, which no UTF-8 holds, as question marks."""
    if isinstance(value, str):
        return value if value.isascii() else value.encode("utf-8", "replace").decode("utf-8")
    if isinstance(value, dict):
        return {k: encodable(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return type(value)(encodable(v) for v in value)
    return value


def file_facts(source: str, wanted: frozenset[str] | None) -> Iterator[dict]:
    """Rows for one file; any failure of parsing or reading the tree is itself a fact."""
    try:
        yield from tree_facts(source, wanted)
    except Exception as failure:  # one odd file must not end the job for all others
        yield failure_row(f"{type(failure).__name__}: {failure}", None)


def tree_facts(source: str, wanted: frozenset[str] | None) -> Iterator[dict]:
    """Rows for one file; any parse failure is itself a fact."""
    try:
        tree = ast.parse(source)
    except SyntaxError as failure:
        yield failure_row(failure.msg, failure.lineno)
        return
    except (ValueError, RecursionError, MemoryError) as failure:
        yield failure_row(str(failure), None)
        return
    nodes = number_nodes(tree)
    names = [(n["pre"], n["node"].id) for n in nodes if isinstance(n["node"], ast.Name)]
    name_positions = [pre for pre, _ in names]
    lengths = operand_lengths(nodes) if wanted is None or "BinOp" in wanted else {}
    for entry in nodes:
        node, parent = entry["node"], entry["parent_node"]
        kind = type(node).__name__
        if wanted is not None and kind not in wanted:
            continue
        row = {c: entry[c] for c in ("pre", "last", "depth", "parent", "field", "idx")}
        row.update(
            kind=kind,
            parent_kind=type(parent).__name__ if parent is not None else None,
            parent_name=getattr(parent, "name", None),
            parent_lineno=getattr(parent, "lineno", None),
            lineno=getattr(node, "lineno", None),
            end_lineno=getattr(node, "end_lineno", None),
            scopes=entry["scopes"],
        )
        row.update(details(node))
        if kind == "Call" and node.args:
            lo, hi = node.args[0]._pre, nodes[node.args[-1]._pre]["last"]
            used = names[bisect_left(name_positions, lo):bisect_right(name_positions, hi)]
            row["arg_names"] = sorted({name for _, name in used})
        if entry["pre"] in lengths:
            row["left_len"], row["right_len"] = lengths[entry["pre"]]
        yield row


def operand_lengths(nodes: list[dict]) -> dict[int, tuple[int, int]]:
    """Text lengths of both operands of every arithmetic operation, by position.

    Inner operations come first: a long one makes every operation around it long, so no
    text is built twice.
    """
    lengths = {}
    long_positions: list[int] = []
    for entry in reversed(nodes):
        node = entry["node"]
        if isinstance(node, ast.BinOp) and isinstance(node.op, (ast.Add, ast.Mult, ast.Sub, ast.Div)):
            sides = tuple(
                text_length(child, nodes[child._pre]["last"], long_positions) for child in (node.left, node.right)
            )
            lengths[entry["pre"]] = sides
            if LONG_TEXT in sides:
                long_positions.append(-entry["pre"])
    return lengths


def failure_row(msg: str, lineno: int | None) -> dict:
    return {"pre": 0, "last": 0, "depth": 0, "kind": "SyntaxError", "text": msg, "lineno": lineno}


def number_nodes(tree: ast.AST) -> list[dict]:
    """Nodes in visiting order with their interval, place under the parent and scopes."""
    nodes: list[dict] = []
    todo = [(tree, None, None, None, 0, ())]
    while todo:
        node, parent, field, idx, depth, scopes = todo.pop()
        node._pre = len(nodes)
        nodes.append({
            "node": node, "pre": node._pre, "last": node._pre, "depth": depth,
            "parent": None if parent is None else parent._pre, "parent_node": parent,
            "field": field, "idx": idx, "scopes": scopes,
        })
        children = []
        for name, value in ast.iter_fields(node):
            below = scopes
            if isinstance(node, SCOPE_NODES):
                below = scopes + ((type(node).__name__, node._pre, name, getattr(node, "name", None)),)
            members = value if isinstance(value, list) else [value]
            for position, child in enumerate(members):
                if isinstance(child, ast.AST) and not isinstance(child, MARKERS):
                    children.append((child, node, name, position, depth + 1, below))
        todo.extend(reversed(children))
    for entry in reversed(nodes):
        if entry["parent"] is not None:
            owner = nodes[entry["parent"]]
            owner["last"] = max(owner["last"], entry["last"])
    return nodes


def callee(func: ast.AST) -> tuple[str | None, str | None]:
    """(name, owner): owner is null for a bare name and '' for a computed object."""
    if isinstance(func, ast.Name):
        return func.id, None
    if isinstance(func, ast.Attribute):
        return func.attr, func.value.id if isinstance(func.value, ast.Name) else ""
    return None, ""


def item(role: str, node: ast.AST) -> tuple:
    """A child worth seeing from its parent's row, in the order of the ITEM struct."""
    name = owner = op = text = None
    if isinstance(node, ast.Call):
        name, owner = callee(node.func)
        first = node.args[0] if node.args else None
        if isinstance(first, ast.Constant) and isinstance(first.value, str):
            text = first.value
    elif isinstance(node, (ast.Name, ast.Attribute)):
        name, owner = callee(node)
    elif isinstance(node, ast.BinOp):
        op = type(node.op).__name__
    return role, type(node).__name__, name, owner, op, getattr(node, "lineno", None), text


def constant(node: ast.AST) -> tuple[str, str | None, str | None]:
    """(kind, type, value) of an argument; type and value only for constants."""
    if not isinstance(node, ast.Constant):
        return type(node).__name__, None, None
    return "Constant", type(node.value).__name__, printed(node.value)


def printed(value: object) -> str:
    """A constant as text; integers beyond Python's limit for decimal digits as hexadecimal."""
    try:
        return str(value)
    except ValueError:
        return hex(value)


def size_of(node: ast.AST | None) -> int | None:
    if isinstance(node, (ast.List, ast.Set, ast.Tuple)):
        return len(node.elts)
    if isinstance(node, ast.Dict):
        return len(node.keys)
    if isinstance(node, ast.Call):
        return len(node.args) + len(node.keywords)
    return None


def unparse(node: ast.AST | list) -> str | None:
    try:
        return ast.unparse(node)
    except (RecursionError, MemoryError, ValueError):
        return None


def text_length(node: ast.AST, last: int, long_positions: list[int]) -> int:
    """Length of the expression's text, counted up to LONG_TEXT.

    ``long_positions`` holds the negated positions of inner operations already known to
    be long, in ascending order; with one inside, the text need not be built again.
    """
    at = bisect_left(long_positions, -last)
    if at < len(long_positions) and -long_positions[at] >= node._pre:
        return LONG_TEXT
    text = unparse(node)
    return LONG_TEXT if text is None else min(len(text), LONG_TEXT)


def details(node: ast.AST) -> dict:
    """Columns that only some kinds of node fill."""
    match node:
        case ast.FunctionDef() | ast.AsyncFunctionDef():
            groups = (
                ("posonly", node.args.posonlyargs), ("plain", node.args.args),
                ("kwonly", node.args.kwonlyargs),
            )
            return {
                "name": node.name,
                "params": [(a.arg, g, a.annotation is not None) for g, args in groups for a in args],
                "items": [item("decorator", d) for d in node.decorator_list],
            }
        case ast.ClassDef():
            return {
                "name": node.name,
                "items": [item("base", b) for b in node.bases],
                "text": ", ".join(unparse(b) or "" for b in [*node.bases, *node.keywords]),
            }
        case ast.Call():
            name, owner = callee(node.func)
            keywords = []
            for kw in node.keywords:
                if kw.arg:
                    elts = kw.value.elts if isinstance(kw.value, (ast.List, ast.Tuple)) else None
                    keywords.append((kw.arg, *constant(kw.value), elts and [constant(e) for e in elts]))
            return {
                "name": name, "owner": owner, "kwargs": keywords,
                "items": [item("arg", a) for a in node.args],
            }
        case ast.Await():
            return {"items": [item("value", node.value)]}
        case ast.With():
            return {"items": [item("context", i.context_expr) for i in node.items]}
        case ast.For() | ast.While():
            return {"text": unparse(node.body)}
        case ast.ListComp() | ast.DictComp():
            return {"n_generators": len(node.generators)}
        case ast.Assign() | ast.AnnAssign():
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            value = node.value
            is_text = isinstance(value, ast.Constant) and isinstance(value.value, str)
            return {
                "name": targets[0].id if isinstance(targets[0], ast.Name) else None,
                "items": [item("target", t) for t in targets],
                "text": unparse(node.annotation) if isinstance(node, ast.AnnAssign) else None,
                "value_kind": type(value).__name__ if value is not None else None,
                "value_name": callee(value.func)[0] if isinstance(value, ast.Call) else None,
                "str_len": len(value.value) if is_text else None,
                "n_elts": size_of(value),
            }
        case ast.BinOp():
            return {"op": type(node.op).__name__}
        case ast.JoinedStr():
            parts = [v.value for v in node.values if isinstance(v, ast.Constant)]
            return {"text": "".join(p for p in parts if isinstance(p, str))}
        case ast.Import():
            return {"modules": [a.name for a in node.names]}
        case ast.ImportFrom():
            return {"name": node.module, "modules": [node.module] if node.module else []}
        case ast.Name():
            return {"name": node.id}
        case ast.Attribute():
            name, owner = callee(node)
            return {"name": name, "owner": owner}
    return {}


def imports(facts: DataFrame) -> DataFrame:
    """(repo, path, module) for every imported module name."""
    statements = facts.filter(F.col("kind").isin("Import", "ImportFrom"))
    return statements.select("repo", "path", F.explode("modules").alias("module"))


def syntax_errors(facts: DataFrame) -> DataFrame:
    return facts.filter("kind = 'SyntaxError'").select(
        "repo", "path", F.col("text").alias("msg"), "lineno"
    )
