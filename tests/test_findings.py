"""The algebra of findings on skewed random data, against plain Python."""

import json
import random
import re
from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from pyspark.sql import functions as F

from auditloom.operators import findings as ff
from auditloom.operators import windows
from auditloom.operators.reports import to_report, to_sarif
from auditloom.operators.score import score
from auditloom.schemas import DEDUP_KEY, FINDINGS

random.seed(11)
WEIGHT = {"CRITICAL": "15", "HIGH": "8", "MEDIUM": "3", "LOW": "0.5", "INFO": "0"}
RANK = {"CRITICAL": 10, "HIGH": 7, "MEDIUM": 4, "LOW": 2, "INFO": 0}
SURE = {"HIGH": "1", "MEDIUM": "0.65", "LOW": "0.3"}


def random_findings(n=3000):
    """A third of all rows belong to one repository, and many are exact copies."""
    rows = []
    for _ in range(n):
        repo = random.choice(["hot"] * 3 + [f"r{i}" for i in range(6)])
        rule = random.choice([None, "R1", "R2", "R3"])
        rows.append((
            repo, random.choice(list(WEIGHT)), random.choice(["A", "B"]), random.choice(["T one", "T/two"]),
            random.choice(["d1", "d2"]), random.choice([None, "f1", "f2"]), random.choice([None, 1, 2, 30]),
            random.choice(["", "fix"]), random.choice(["s1", "s2"]), rule, random.choice(list(SURE)),
        ))
    return rows


ROWS = random_findings()
COLUMNS = FINDINGS.fieldNames()


@pytest.fixture(scope="module")
def findings(spark):
    return spark.createDataFrame(ROWS, FINDINGS).repartition(5)


def order(row):
    r = dict(zip(COLUMNS, row))
    return (-RANK[r["severity"]], r["category"], r["file"] or "", r["line"] or 0, r["rule_id"] is not None, r["rule_id"] or "",
            r["title"], r["detail"], r["recommendation"], r["source"], r["confidence"])


def python_scores(rows):
    out = {}
    for repo in {r[0] for r in rows}:
        groups = {}
        for row in sorted((r for r in rows if r[0] == repo), key=order):
            groups.setdefault(row[9] or row[3] or "unknown", []).append(row)
        penalty = sum(
            Decimal(WEIGHT[g[0][1]]) * Decimal(SURE[g[0][10]]) * (1 + Decimal("0.15") * min(4, len(g) - 1))
            for g in groups.values()
        )
        out[repo] = int(max(0, min(100, (100 - penalty).quantize(Decimal(1), ROUND_HALF_EVEN))))
    return out


def test_dedup_is_idempotent_and_keeps_the_surest(findings):
    once = ff.dedup(findings)
    rows = [tuple(r) for r in once.collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, (tuple(r) for r in ff.dedup(once).collect())))
    at = [COLUMNS.index(c) for c in DEDUP_KEY]
    groups = {}
    for row in ROWS:
        groups.setdefault(tuple(row[i] for i in at), []).append(row)
    want = {k: min(g, key=lambda r: (-float(SURE[r[10]]), r[8], r[7]))[7:11:3] for k, g in groups.items()}
    assert {tuple(r[i] for i in at): r[7:11:3] for r in rows} == want


def test_union_order_does_not_matter(findings):
    a, b = findings.filter("severity = 'HIGH'"), findings.filter("severity <> 'HIGH'")
    left = ff.dedup(ff.union_findings(a, b)).collect()
    right = ff.dedup(ff.union_findings(b, a)).collect()
    assert sorted(map(repr, left)) == sorted(map(repr, right))


def test_scores(findings, spark):
    repos = spark.createDataFrame([(r,) for r in {row[0] for row in ROWS} | {"clean"}], "repo string")
    got = {r["repo"]: r["score"] for r in score(findings, repos).collect()}
    assert got == python_scores(ROWS) | {"clean": 100}
    few = spark.createDataFrame([ROWS[0], ROWS[1]], FINDINGS)
    assert all(0 <= r["score"] <= 100 for r in score(few, repos).collect())


def test_half_points_round_to_even(spark):
    # 2.5 points: five LOW rules at HIGH confidence; 100 - 2.5 rounds to 98, not 97.
    rows = [("r", "LOW", "A", "t", "d", None, None, "", "s", f"R{i}", "HIGH") for i in range(5)]
    found = spark.createDataFrame(rows, FINDINGS)
    assert score(found, found).head()["score"] == 98


def test_top_per_group_of_a_hot_group(findings):
    got = {}
    for r in ff.head(findings, 40).collect():
        got.setdefault(r["repo"], []).append((r["rank"], order(tuple(r)[:11])))
    for repo, rows in got.items():
        want = sorted(order(r) for r in ROWS if r[0] == repo)[:40]
        assert [k for _, k in sorted(rows)] == want


def test_gate_and_search(findings):
    status = {r["repo"]: r["failed"] for r in ff.gate_status(findings.filter("severity IN ('LOW', 'INFO')"), "MEDIUM").collect()}
    assert not any(status.values())
    assert all(r["failed"] for r in ff.gate_status(findings, "INFO").collect())
    n = ff.search(findings, "F1:30", "HIGH", "LOW").count()
    assert n == sum(r[1] == "HIGH" and r[10] == "LOW" and r[5] == "f1" and r[6] == 30 for r in ROWS)


def test_reports_lose_nothing_when_split(findings, spark):
    kept = ff.dedup(findings)
    want = {r["repo"]: r["count"] for r in kept.groupBy("repo").count().collect()}
    repos = spark.createDataFrame([(r,) for r in [*want, "clean"]], "repo string")
    logs = to_sarif(kept, size=50).collect()
    got = {}
    for row in logs:
        run = json.loads(row["json"])["runs"][0]
        assert {r["ruleId"] for r in run["results"]} == {r["id"] for r in run["tool"]["driver"]["rules"]}
        got[row["repo"]] = got.get(row["repo"], 0) + len(run["results"])
    assert got == want
    assert max(sum(r["repo"] == "hot" for r in logs), 0) > 1
    counts = {}
    for row in to_report(kept, score(kept, repos), size=50).collect():
        report = json.loads(row["json"])
        counts[row["repo"]] = counts.get(row["repo"], 0) + len(report["findings"])
    assert counts == want | {"clean": 0}


def test_rule_names_from_titles(spark):
    rows = [("r", "LOW", "A", "Tést a/b " + "x" * 100, "d", "f", 0, "", "s", None, "LOW")]
    run = json.loads(to_sarif(spark.createDataFrame(rows, FINDINGS)).head()["json"])["runs"][0]
    assert run["results"][0]["ruleId"] == ("t-st-a-b-" + "x" * 100)[:80]
    assert run["results"][0]["level"] == "note" and run["tool"]["driver"]["rules"][0]["help"]["text"] == "d"
    assert "region" not in run["results"][0]["locations"][0]["physicalLocation"]


def test_ordered_scans_of_a_hot_group(spark):
    rows = []
    for i in range(2000):
        key = random.choice(["hot", "hot", "k1", "k2"])
        rows.append((key, i, random.choice([1, -1, 0]), random.choice([None, i])))
    df = spark.createDataFrame(rows, "k string, pos int, delta int, mark int").repartition(4)
    bucket = F.floor(F.col("pos") / 100)
    sums = {r["pos"]: r["s"] for r in windows.running_sum(df, ["k"], ["pos"], F.col("delta"), bucket, "s").collect()}
    at = {r["pos"]: r["m"] for r in windows.carry_forward(df, ["k"], ["pos"], F.col("mark"), bucket, "m").collect()}
    before = {r["pos"]: r["m"] for r in windows.carry_forward(
        df, ["k"], ["pos"], F.col("mark"), bucket, "m", include_current=False).collect()}
    total, last = {}, {}
    for key, pos, delta, mark in rows:
        assert before[pos] == last.get(key)
        total[key] = total.get(key, 0) + delta
        last[key] = pos if mark is not None else last.get(key)
        assert sums[pos] == total[key] and at[pos] == last[key]


def plan_of(df, capsys) -> str:
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_report_lists_are_joined_by_chunk(findings, spark, capsys):
    """A repository's lists meet its score chunk by chunk: never all of them in one task."""
    scores = findings.groupBy("repo").agg(F.count("*").alias("score"))
    plan = plan_of(to_report(findings, scores, size=50), capsys)
    assert re.search(r"Join \[repo#\d+, chunk#\d+\]", plan)
    assert "collect_list" not in plan.split("Join [repo#")[0]


def test_sarif_rules_come_from_the_chunk(findings, capsys):
    """Results and rules of a log are one aggregate over one sort: nothing is joined but the ranks."""
    assert len(re.findall(r"Join", plan_of(to_sarif(findings, size=50), capsys))) == 1


def test_ranges_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(windows, "ROWS_PER_RANGE", 20)
    rows = [("hot" if i % 3 else None, f"{i * 7919 % 2000:04d}") for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, v string").repartition(4)
    ranked = windows.group_ranks(df, ["k"], [F.desc("v")], "rank")
    assert ranked.inputFiles() and len(ranked.inputFiles()) > 50
    for key in ("hot", None):
        got = sorted((r["rank"], r["v"]) for r in ranked.collect() if r["k"] == key)
        assert got == list(enumerate(sorted((v for k, v in rows if k == key), reverse=True)))


def test_rules_take_their_first_finding(spark):
    rows = [("r", "LOW", "A", f"t{i}", f"d{i}", f"f{9 - i}", i, "", "s", f"R{i % 3}", "LOW") for i in range(9)]
    rows += [(None, *rows[0][1:]), ("r", "LOW", "A", None, "none", "f", 0, "", "s", None, "LOW")]
    logs = to_sarif(spark.createDataFrame(rows, FINDINGS)).collect()
    assert [r["repo"] for r in logs] == ["r"]
    run = json.loads(logs[0]["json"])["runs"][0]
    names = [(r.get("id"), r.get("name"), r["help"]["text"]) for r in run["tool"]["driver"]["rules"]]
    assert names == [(None, None, "none"), ("R0", "t6", "d6"), ("R1", "t7", "d7"), ("R2", "t8", "d8")]
    assert [r["message"]["text"] for r in run["results"]] == ["none"] + [f"d{i}" for i in range(8, -1, -1)]
