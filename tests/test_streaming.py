"""The stream gives the same counts however the arrivals are cut into batches."""

import datetime as dt
import random

from pyspark.sql import functions as F

from auditloom.operators import text_rules
from auditloom.schemas import DEDUP_KEY
from auditloom.sources.files import describe
from auditloom.streaming.incremental import Versions, run_available, run_versions, stream_audit

random.seed(3)
START = dt.datetime(2024, 1, 1)
CONTENTS = [
    'token = "abcdefghij"\n', 'token = "abcdefghij"\n# edited\n', "x = 1\n",
    'q = f"SELECT a FROM t WHERE b = {c}"\n', "app = FastAPI(docs_url=None)\n",
]
SCHEMA = "arrived timestamp, repo string, path string, size long, content string"


def test_stream_equals_batch_for_closed_windows(spark, tmp_path):
    rows = []
    for i in range(300):
        minute = i * 2 + random.randint(0, 20)
        content = random.choice(CONTENTS)
        repo = random.choice(["hot", "hot", "cold"])
        rows.append((START + dt.timedelta(minutes=minute), repo, f"m{random.randint(0, 3)}.py", len(content), content))
    source = tmp_path / "arrivals"
    for i in range(0, 300, 60):
        spark.createDataFrame(rows[i:i + 60], SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    counts = stream_audit(describe(stream), "1 hour", "2 hours")
    run_available(counts, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = {(r["window_start"], r["repo"], r["severity"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    batch = text_rules.text_findings(describe(spark.createDataFrame(rows, SCHEMA)))
    window = F.window("arrived", "1 hour")["start"]
    once = batch.withColumn("w", window).select("w", *DEDUP_KEY).distinct()
    latest = max(r[0] for r in rows) - dt.timedelta(hours=2)
    want = {
        (r["w"], r["repo"], r["severity"]): r["count"] for r in once.groupBy("w", "repo", "severity").count().collect()
        if r["w"] + dt.timedelta(hours=1) <= latest
    }
    assert want and got == want


def test_versions_are_scanned_once_and_replaced(spark, tmp_path):
    """Arrivals in five batches, repeats among them: new versions alone are read, and only a file's last one counts."""
    rows = []
    for i in range(200):
        content = random.choice(CONTENTS)
        rows.append((START + dt.timedelta(minutes=i), random.choice(["hot", "hot", "cold"]), f"m{random.randint(0, 3)}.py", len(content), content))
    frame = spark.createDataFrame(rows, SCHEMA)
    source, asked = tmp_path / "arrivals", []
    for i in range(0, 200, 40):
        spark.createDataFrame(rows[i:i + 40], SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
    texts = frame.select("content").distinct().withColumn("digest", F.sha2("content", 256))

    def contents(fresh):
        asked.extend((r.repo, r.path, r.digest) for r in fresh.collect())
        return describe(fresh.join(texts, "digest").withColumn("size", F.length("content")))

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    versions = Versions(spark, str(tmp_path / "versions"))
    run_versions(stream.withColumn("digest", F.sha2("content", 256)), versions, contents, str(tmp_path / "checkpoint"))
    assert len(asked) == len(set(asked)) == len({(r[1], r[2], r[4]) for r in rows})
    last = {(r[1], r[2]): r for r in rows}
    want = text_rules.text_findings(describe(spark.createDataFrame(list(last.values()), SCHEMA)))
    key = ["repo", "file", "line", "rule_id", "title"]
    listed = lambda found: sorted((tuple(r) for r in found.select(key).collect()), key=str)
    assert listed(versions.open_findings()) == listed(want) and listed(want)

    # A batch that runs again after a failure changes nothing.
    again = frame.withColumn("digest", F.sha2("content", 256)).filter("arrived >= timestamp'2024-01-01 02:40:00'")
    versions.add(again, contents, 4)
    assert listed(versions.open_findings()) == listed(want)


def test_no_arrivals(spark, tmp_path):
    assert Versions(spark, str(tmp_path)).open_findings().count() == 0
