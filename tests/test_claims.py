"""Claims on commits."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from auditloom.operators import claims
from auditloom.schemas import CLAIMS
from auditloom.sources import commits

START = datetime(2024, 5, 1, tzinfo=timezone.utc)
TTL = 100


def at(seconds):
    return START + timedelta(seconds=seconds)


def batch(spark, rows):
    return spark.createDataFrame(
        [(i, repo, sha, at(t)) for i, repo, sha, t in rows],
        "analysis_id string, repository_id string, commit_sha string, created_at timestamp",
    )


def take(spark, table, job, rows, now, ended=(), fresh=()):
    done = spark.createDataFrame([(i,) for i in ended], "analysis_id string")
    known = spark.createDataFrame(list(fresh), "repository_id string, commit_sha string")
    out = claims.take(batch(spark, rows), table, job, known, done, F.lit(at(now)), TTL).collect()
    return {r.analysis_id: (r.decision, r.holder) for r in out}


def test_one_run_holds_a_commit(spark, tmp_path):
    table = str(tmp_path / "claims")
    first = [("b", "r", "1", 5), ("a", "r", "1", 5), ("c", "r", "1", 9), ("d", "r", "2", 1), ("e", "s", "1", 1),
             ("n", "r", None, 1), ("m", "r", None, 1)]
    want = {"a": ("run", "a"), "b": ("wait", "a"), "c": ("wait", "a"), "d": ("run", "d"), "e": ("reuse", None),
            "n": ("run", "n"), "m": ("run", "m")}
    for _ in range(2):  # a repeated batch decides as before and claims once
        assert take(spark, table, "1", first, 10, fresh=[("s", "1"), ("s", "1")]) == want
    assert commits.committed(spark, table, CLAIMS).count() == 2
    second = [("f", "r", "1", 20), ("g", "r", "2", 20), ("h", "r", "3", 20)]
    assert take(spark, table, "2", second, 30, ended=["d"]) == {
        "f": ("wait", "a"), "g": ("run", "g"), "h": ("run", "h")}
    # a died: its claim of second 10 holds below second 110
    assert take(spark, table, "3", [("i", "r", "1", 100)], 109) == {"i": ("wait", "a")}
    assert take(spark, table, "4", [("j", "r", "1", 101), ("k", "r", "2", 101)], 110) == {
        "j": ("run", "j"), "k": ("wait", "g")}
    assert take(spark, table, "5", [("l", "r", "1", 200)], 200, fresh=[("r", "1")]) == {"l": ("reuse", None)}
    assert take(spark, table, "6", [], 300) == {}


def test_claims_of_an_unpublished_batch_hold_nothing(spark, tmp_path):
    table = str(tmp_path / "claims")
    rows = batch(spark, [("a", "r", "1", 5)]).select("analysis_id", *claims.COMMIT, F.col("created_at").alias("claimed_at"))
    commits.stage(rows, table)
    assert take(spark, table, "1", [("b", "r", "1", 6)], 10) == {"b": ("run", "b")}
