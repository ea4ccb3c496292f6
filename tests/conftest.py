import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from auditloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("auditloom-tests", "local[8]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "6g",
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_files(spark):
    """files from {(repo, path): content}."""
    from auditloom.sources.files import describe

    def build(contents: dict[tuple[str, str], str]):
        rows = [(repo, path, len(text.encode()), text) for (repo, path), text in contents.items()]
        return describe(spark.createDataFrame(rows, "repo string, path string, size long, content string"))

    return build
