"""Cycles of many random graphs at once, against brute force."""

import random
from collections import deque

import pytest

from auditloom.operators import graph

random.seed(5)


def random_graphs():
    graphs = {}
    for i in range(12):
        n = random.randint(2, 9)
        names = [f"n{k}" for k in range(n)]
        graphs[f"g{i}"] = {(random.choice(names), random.choice(names)) for _ in range(random.randint(1, 2 * n))}
    graphs["ring"] = {(f"r{k:02d}", f"r{(k + 1) % 19:02d}") for k in range(19)}
    graphs["chain"] = {(f"c{k}", f"c{k + 1}") for k in range(7)}
    graphs["two rings"] = {("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("e", "e")}
    return graphs


GRAPHS = random_graphs()


def shortest_path(edges, start, goal):
    """Shortest non-empty walk from start to goal, smallest node names first on ties."""
    best, todo = {}, deque()
    for nxt in sorted(b for a, b in edges if a == start):
        if nxt not in best:
            best[nxt] = [start, nxt]
            todo.append(nxt)
    while todo:
        node = todo.popleft()
        if node == goal:
            return best[node]
        for nxt in sorted(b for a, b in edges if a == node):
            if nxt not in best:
                best[nxt] = best[node] + [nxt]
                todo.append(nxt)
    return best.get(goal)


def components(edges):
    nodes = {x for e in edges for x in e}
    on_cycle = {n for n in nodes if shortest_path(edges, n, n)}
    mutual = {
        n: min(m for m in on_cycle if m == n or (shortest_path(edges, n, m) and shortest_path(edges, m, n)))
        for n in on_cycle
    }
    return mutual


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(g, a, b) for g, es in GRAPHS.items() for a, b in es]
    return spark.createDataFrame(rows, "repo string, src string, dst string").repartition(4)


def test_components(edges):
    got = {(r["g"], r["node"]): r["root"] for r in graph.cyclic_components(edges.withColumnRenamed("repo", "g")).collect()}
    want = {(g, n): root for g, es in GRAPHS.items() for n, root in components(es).items()}
    assert got == want


def test_shortest_cycles(edges):
    got = {(r["repo"], r["root"]): r["cycle"] for r in graph.cycles_per_repo(edges).collect()}
    want = {(g, root): shortest_path(es, root, root) for g, es in GRAPHS.items() for root in set(components(es).values())}
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    assert got == want


def long_graphs(n=1000):
    name = lambda i: f"n{i:05d}"
    return {
        # A ring with a chord: the shortest way takes the chord.
        "chord": {(name(i), name((i + 1) % n)) for i in range(n)} | {(name(100), name(700))},
        # No cycle, but a fork at every node.
        "ladder": {(name(i), name(i + j)) for i in range(n) for j in (1, 2)},
        # Components of two nodes in a row, smallest names first: each reaches all that follow.
        "pairs": {(name(i), name(i + 1)) for i in range(n - 1)} | {(name(i + 1), name(i)) for i in range(0, n, 2)},
        # Two rings that share a node, with chains that lead in and out.
        "eight": {(name(i), name(i + 1)) for i in range(n - 1)} | {(name(500), name(200)), (name(800), name(500))},
    }


def test_long_graphs_take_few_jobs(spark, monkeypatch):
    jobs = [0]
    for function in ("stored", "cut_counting", "cut_round"):
        real = getattr(graph, function)
        monkeypatch.setattr(graph, function, lambda *a, real=real: (jobs.__setitem__(0, jobs[0] + 1), real(*a))[1])
    rows = [(g, a, b) for g, es in long_graphs().items() for a, b in es]
    found = graph.cycles_per_repo(spark.createDataFrame(rows, "repo string, src string, dst string").repartition(4))
    got = {(r["repo"], r["root"]): r["cycle"] for r in found.collect()}
    name = lambda i: f"n{i:05d}"
    want = {("pairs", name(i)): [name(i), name(i + 1), name(i)] for i in range(0, 1000, 2)}
    want["chord", name(0)] = [name(i % 1000) for i in (*range(101), *range(700, 1001))]
    want["eight", name(200)] = [name(i) for i in (*range(200, 501), 200)]
    assert got == want
    # A search step by step would take a thousand jobs and more.
    assert jobs[0] < 250


def count_rounds(monkeypatch):
    rounds = [0]
    for function in ("stored", "cut_counting", "cut_round"):
        real = getattr(graph, function)
        monkeypatch.setattr(graph, function, lambda *a, real=real: (rounds.__setitem__(0, rounds[0] + 1), real(*a))[1])
    return rounds


def test_ladders_take_few_turns(spark, monkeypatch):
    """Ways without cycles fall apart at both ends and in several places a turn."""
    rounds = count_rounds(monkeypatch)
    rows = [(f"g{g}", f"n{i:03d}", f"n{i + j:03d}") for g in range(60) for i in range(200) for j in (1, 2)]
    rows += [("back", f"n{i:03d}", f"n{i + j:03d}") for i in range(200) for j in (1, 2)] + [("back", "n150", "n050")]
    found = graph.cyclic_components(spark.createDataFrame(rows, "g string, src string, dst string").repartition(4))
    assert {tuple(r) for r in found.collect()} == {("back", f"n{i:03d}", "n050") for i in range(50, 151)}
    assert rounds[0] < 80


def test_swept_links_find_the_same(edges, monkeypatch):
    monkeypatch.setattr(graph, "SWEPT_LINKS", 1)
    got = {(r["g"], r["node"]): r["root"] for r in graph.cyclic_components(edges.withColumnRenamed("repo", "g")).collect()}
    assert got == {(g, n): root for g, es in GRAPHS.items() for n, root in components(es).items()}


def test_edges_without_graph_or_end(spark):
    """Repeats count once; edges without a graph count as loops only, edges without an end not at all."""
    rows = [("g", "a", "b"), ("g", "b", "a"), ("g", "b", "a"), ("g", None, "a"), ("g", "b", None), ("g", None, None),
            (None, "a", "b"), (None, "b", "a"), (None, "c", "c"), ("h", "a", "a"), ("h", "a", "b")]
    edges = spark.createDataFrame(rows, "repo string, src string, dst string")
    got = sorted((str(r["repo"]), r["root"], r["cycle"]) for r in graph.cycles_per_repo(edges).collect())
    assert got == [("None", "c", ["c", "c"]), ("g", "a", ["a", "b", "a"]), ("h", "a", ["a", "a"])]


def test_longest_prefix(spark):
    rows = spark.createDataFrame([("r", "a.b.c"), ("r", "a.bc"), ("r", "x"), ("s", "a.b")], "repo string, name string")
    index = spark.createDataFrame(
        [("r", "a", "A"), ("r", "a.b", "AB"), ("s", "a", "SA"), ("r", "a.b.c.d", "LONG")], "repo string, module string, path string"
    )
    got = {(r["repo"], r["name"]): (r["module"], r["path"]) for r in graph.longest_prefix(rows, ["repo"], "name", index, "module").collect()}
    assert got == {("r", "a.b.c"): ("a.b", "AB"), ("r", "a.bc"): ("a", "A"), ("s", "a.b"): ("a", "SA")}


def test_module_index_keeps_one_file_per_module(make_files):
    files = make_files({("r", p): "x" for p in ("a/__init__.py", "a/b.py", "a/b.pyi", "c.txt", "__init__.py")})
    got = {(r["module"], r["path"]) for r in graph.module_index(files).collect()}
    assert got == {("a", "a/__init__.py"), ("a.b", "a/b.pyi"), ("", "__init__.py")}
