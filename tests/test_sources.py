"""Scanning directories, splitting lines, classifying paths, reading specifications."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from auditloom.dimensions import SKIP_DIRS
from auditloom.functions import paths, text
from auditloom.operators import spec_rules, text_rules
from auditloom.sources import files as file_source
from auditloom.sources.files import describe, read_text, scan_files
from auditloom.sources.lines import to_lines
from auditloom.sources.specs import parse_specs


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    contents = {
        "one/a.py": b"x = 1\r\ny = 2\rz = 3\n", "one/.env": b"KEY=1\n", "one/_private/__init__.py": b"p\n",
        "one/bad.py": b"s = '\xff\xfe'\n", "one/image.png": b"\x89PNG", "one/venv/lib.py": b"no\n",
        "one/src/dist": b"a file, not a directory\n", "two/.github/ci.yml": b"on: push\n", "two/node_modules/x/y.js": b"no\n",
        "build/c.py": b"the repository is called build\n",
    }
    for path, data in contents.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
    (root / "one/loop").symlink_to(root / "one", target_is_directory=True)
    return root


def test_scan_keeps_hidden_names_and_prunes_directories(spark, tree):
    rows = {(r["repo"], r["path"]): r for r in scan_files(spark, str(tree)).collect()}
    assert set(rows) == {
        ("one", "a.py"), ("one", ".env"), ("one", "_private/__init__.py"), ("one", "bad.py"), ("one", "image.png"),
        ("one", "src/dist"), ("two", ".github/ci.yml"), ("build", "c.py"),
    }
    assert rows["one", "a.py"]["content"] == "x = 1\ny = 2\nz = 3\n" and rows["one", "a.py"]["size"] == 19
    assert "�" in rows["one", "bad.py"]["content"]
    assert rows["one", "image.png"]["content"] == "" and rows["one", "image.png"]["size"] == 4
    assert rows["one", ".env"]["is_dotenv"] and rows["one", ".env"]["is_text"]


def test_scan_of_one_repository(spark, tree):
    got = {r["path"] for r in scan_files(spark, str(tree / "two"), repo="t").collect()}
    assert got == {".github/ci.yml"}


def test_lines_equal_splitlines(make_files, spark):
    texts = ["", "\n", "a", "a\n", "a\n\n", "\na", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g h i\r\nj\rk", "x\r\n\r\ny\n\n"]
    files = make_files({("r", f"{i}.py"): t for i, t in enumerate(texts)})
    got = {}
    for r in to_lines(files).collect():
        got.setdefault(r["path"], {})[r["line_no"]] = r["line"]
    for i, t in enumerate(texts):
        assert [got.get(f"{i}.py", {}).get(n + 1) for n in range(len(got.get(f"{i}.py", {})))] == t.splitlines()


def test_text_limit(spark):
    rows = [("r", "a.py", 100, "x"), ("r", "b.py", 101, "x")]
    files = read_text(describe(spark.createDataFrame(rows, "repo string, path string, size long, content string")), limit=100)
    assert {r["path"]: r["content"] for r in files.collect()} == {"a.py": "x", "b.py": ""}


@pytest.mark.parametrize("path, test, dotenv, python, is_text", [
    ("tests/a.py", True, False, True, True), ("Testing/a.txt", True, False, False, False), ("a/test_x.js", True, False, False, False),
    ("a/x_test.py", True, False, True, True), ("conftest.py", True, False, True, True), ("contest.py", False, False, True, True),
    (".env", False, True, False, True), (".ENV.local", False, True, False, True), ("prod.env", False, False, False, True),
    ("a.PY", False, False, False, True), ("x/.env/y.pyi", False, False, True, True), ("environment", False, False, False, False),
])
def test_path_classes(spark, path, test, dotenv, python, is_text):
    name = paths.base_name(F.lit(path))
    row = spark.range(1).select(paths.is_test(F.lit(path)), paths.is_dotenv(name), paths.is_python(name), paths.is_text(name)).head()
    assert tuple(row) == (test, dotenv, python, is_text)


def test_pruned_names_count_only_as_directories(spark):
    rows = spark.createDataFrame([(f"{d}/x.py",) for d in SKIP_DIRS] + [(d,) for d in SKIP_DIRS] + [("Build/x.py",)], "path string")
    kept = {r["path"] for r in rows.filter(~paths.in_skipped_dir(F.col("path"))).collect()}
    assert kept == set(SKIP_DIRS) | {"Build/x.py"}


def test_unicode_classes(spark, make_files):
    files = make_files({("r", "a.py"): "paſsword = 'abcdefgh'\nselect x FROM y\nSELECTION from\n"})
    lines = to_lines(files)
    assert [r["line"] for r in text_rules.line_rules(lines, ["secrets"]).collect()] == [1]
    assert [r["line_no"] for r in lines.filter(text.looks_like_sql(F.col("line"))).collect()] == [2]


def test_large_file_size_is_rounded_like_a_printed_number(spark):
    rows = [("r", f"f{n}", n, "") for n in (50_000_000, 50_250_000, 50_350_000, 1_234_567_890)]
    files = describe(spark.createDataFrame(rows, "repo string, path string, size long, content string"))
    got = {r["file"]: r["detail"] for r in text_rules.large_files(files).collect()}
    assert got == {
        f"f{n}": f"Taille approximative: {n / 1_000_000:.1f} MB." for n in (50_250_000, 50_350_000, 1_234_567_890)
    }


def test_specifications_in_both_formats(make_files):
    files = make_files({
        ("r", "openapi.json"): '{"openapi": "3.0.0"}', ("r", "my-Swagger.yaml"): "openapi: 3.0\n", ("r", "API-DOCS"): "{a: [",
        ("r", "openapi-empty.json"): "", ("r", "other.json"): "{}",
    })
    got = {r["path"]: r["parsed"] for r in parse_specs(files).collect()}
    assert got == {"openapi.json": True, "my-Swagger.yaml": True, "API-DOCS": False}


def test_expanding_aliases_are_a_finding(make_files):
    """Nine levels of ten aliases: an invalid specification, not a dead worker; shared parts stay readable."""
    levels = ["l0: &l0 [x, x, x, x, x, x, x, x, x, x]"] + [f"l{k}: &l{k} [{', '.join([f'*l{k - 1}'] * 10)}]" for k in range(1, 10)]
    shared = "openapi: 3.0.0\nx: &ok\n  '200': {description: fine}\npaths:\n" + "".join(
        f"  /p{k}: {{get: {{summary: s, responses: *ok}}}}\n" for k in range(300))
    files = make_files({
        ("r", "openapi.yaml"): "openapi: 3.0.0\n" + "\n".join(levels), ("r", "swagger.yaml"): shared, ("r", "api-docs.yaml"): "openapi: 3.0.0\na: &a [*a]\n",
    })
    specs = parse_specs(files)
    assert {r["path"]: r["parsed"] for r in specs.collect()} == {"openapi.yaml": False, "swagger.yaml": True, "api-docs.yaml": False}
    invalid = spec_rules.document_rules(specs).filter("rule_id = 'OPENAPI-INVALID-FORMAT'")
    assert {r["file"] for r in invalid.collect()} == {"openapi.yaml", "api-docs.yaml"}


def test_large_texts_and_specifications_are_read(spark, make_files):
    from auditloom.plans.audit import audit

    source = "# " + "x" * 6_000_000 + "\neval(code)\n"
    spec = '{"openapi": "3.1.0", "paths": {"/a": {"get": {"responses": {"200": {}}, "summary": "' + "y" * 12_000_000 + '"}}}}'
    found = audit(make_files({("r", "big.py"): source, ("r", "openapi.json"): spec}), deep=True).findings
    rules = {r["rule_id"] for r in found.collect()}
    assert {"SEC-EVAL", "OPENAPI-MISSING-DESCRIPTION", "OPENAPI-MISSING-RESPONSE"} <= rules


@pytest.mark.parametrize("error, passes", [(PermissionError, True), (FileNotFoundError, True), (OSError, False), (TimeoutError, False), (ConnectionResetError, False)])
def test_passing_errors_fail_the_task(monkeypatch, error, passes):
    class Store:
        def get_file_info(self, _):
            raise error("no")

        def open_input_stream(self, _):
            raise error("no")

    fake = type("Fs", (), {"FileSystem": type("F", (), {"from_uri": staticmethod(lambda _: (Store(), "/x"))}), "LocalFileSystem": int, "FileSelector": str})
    monkeypatch.setattr(file_source, "pa_fs", fake)
    listed = file_source.list_directories("x", iter([pa.RecordBatch.from_pylist([{"path": "a"}])]))
    read = file_source.read_contents("x", iter([pa.RecordBatch.from_pylist([{"repo": "r", "path": "a", "size": 1, "inside": "a", "wanted": True}])]))
    if passes:
        assert [b.to_pylist() for b in listed] == [[{"path": "a", "size": 0, "is_dir": False, "reason": error.__name__}]]
        assert [b.column(3).to_pylist() for b in read] == [[b""]]
        tried = file_source.try_open("x", iter([pa.RecordBatch.from_pylist([{"repo": "r", "path": "a", "inside": "a"}])]))
        assert [b.to_pylist() for b in tried] == [[{"repo": "r", "path": "a", "reason": error.__name__}]]
    else:
        for batches in (listed, read):
            with pytest.raises(error):
                list(batches)


def test_what_a_scan_cannot_read_is_a_finding(spark, tmp_path):
    """A file that is gone when it is opened: an empty file, a row of lost, and a finding of the audit."""
    from auditloom.plans.audit import audit

    (tmp_path / "shop" / "src").mkdir(parents=True)
    (tmp_path / "shop" / "src" / "a.py").write_text("eval(x)\n")
    (tmp_path / "shop" / "src" / "gone.py").write_text("eval(y)\n")
    scanned = file_source.scan(spark, f"file://{tmp_path}")
    # Listed, and deleted before any content is read.
    (tmp_path / "shop" / "src" / "gone.py").unlink()
    assert [tuple(r) for r in scanned.lost.collect()] == [("shop", "src/gone.py", "FileNotFoundError")]
    assert {r["path"]: r["content"] for r in scanned.files.collect()} == {"src/a.py": "eval(x)\n", "src/gone.py": ""}
    found = {(r["rule_id"], r["file"], r["detail"]) for r in audit(scanned.files, lost=scanned.lost).findings.collect()}
    assert ("SCAN-UNREADABLE", "src/gone.py", "Not read: FileNotFoundError.") in found


def test_cheap_tests_before_patterns_lose_no_text(spark):
    """Texts that a pattern takes pass the cheap test before it, also by letters that only fold to ASCII."""
    from auditloom.operators.marks import WHOLE_WORDS, whole_word

    letters = spark.createDataFrame([(chr(n),) for n in range(0x80, 0x20000) if not 0xD800 <= n < 0xE000], "c string")
    folding = {r["c"] for r in letters.filter(F.col("c").rlike("^(?iuU)(" + "|".join("abcdefghijklmnopqrstuvwxyz") + ")$")).collect()}
    assert folding == set(text.FOLDED)
    texts = ["select", "x SELECT y", "ſelect", "SELECTİON", "İnsert a", "ınsert", "deleted", "édelete", "", "updat",
             "no", None, "role", "roles", "a role.", "jose", "josef", "pyjwt", "is_admin", "épsycopg", "asyncpgé", "postgresql"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    pattern = text.ANY_CASE + text.SQL_WORDS
    got = rows.select("t", text.has_sql_words(F.col("t")).alias("got"), F.col("t").rlike(pattern).alias("want")).collect()
    assert [(r["t"], r["got"]) for r in got] == [(r["t"], r["want"]) for r in got] and sum(bool(r["got"]) for r in got) == 5
    for words in WHOLE_WORDS.values():
        want = F.col("t").rlike(rf"(?U)\b({'|'.join(words)})\b")
        got = rows.select("t", whole_word(F.col("t"), words).alias("got"), want.alias("want")).collect()
        assert [(r["t"], r["got"]) for r in got] == [(r["t"], r["want"]) for r in got]
    assert "contains(" in rows.select(text.has_sql_words(F.col("t")))._jdf.queryExecution().toString().lower()


def test_comments_of_all_line_breaks(spark):
    from auditloom.plans.seeded import comments

    texts = ["a", "a\nb", "a\r\nb", "a\rb", "\r\r\n\n\r", "", None]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(
        comments().alias("got"), F.concat(F.lit("# "), F.regexp_replace("text", r"\r\n|\r|\n", "\n# "), F.lit("\n")).alias("want")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_plain_values_become_arrays_unchecked(monkeypatch):
    """Only a column that holds a lone surrogate is looked at value by value."""
    from auditloom.sources import facts

    seen = []
    plain = facts.encodable
    monkeypatch.setattr(facts, "encodable", lambda v: seen.append(v) or plain(v))
    schema = pa.schema([("a", pa.string()), ("b", pa.string()), ("c", pa.list_(pa.string()))])
    rows = [{"a": "x", "b": "\ud800", "c": ["y"]}, {"a": "é", "c": None}]
    assert facts.to_batch(rows, schema).to_pylist() == [{"a": "x", "b": "?", "c": ["y"]}, {"a": "é", "b": None, "c": None}]
    assert seen == ["\ud800", None]
