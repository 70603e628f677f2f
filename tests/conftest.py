from __future__ import annotations

import os
import sys
import textwrap

import pytest
from pyspark.sql import SparkSession

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

from auditloom.session import configure  # noqa: E402
from auditloom.streaming.ratelimit import STATE_STORE  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .config("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture
def source(spark):
    """Files of one snapshot, from a dict of path and text."""
    def make(files: dict[str, str], repo: str = "o/r", sha: str = "c" * 40):
        rows = [(repo, sha, path, textwrap.dedent(text)) for path, text in files.items()]
        return spark.createDataFrame(
            rows, "repo string, commit_sha string, file_path string, content string"
        )
    return make
