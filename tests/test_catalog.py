from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from auditloom import schemas
from auditloom.functions import paths
from auditloom.operators import catalog

NOW = datetime(2024, 5, 1, tzinfo=timezone.utc)


@pytest.mark.parametrize("url, good", [
    ("https://github.com/q/z", True),
    ("https://github.com/tool-makers/wrench.py", True),
    ("https://github.com/9lives/cat_flap-2", True),
    ("https://github.com/tool-makers/wrench/", True),
    ("\t https://github.com/tool-makers/wrench/// ", True),
    ("https://github.com/" + "a" * 39 + "/" + "r" * 100, True),
    ("HTTP://github.com/tool-makers/wrench", False),
    ("https://codeberg.org/tool-makers/wrench", False),
    ("https://github.com/tool-makers", False),
    ("https://mirror.test/https://github.com/tool-makers/wrench", False),
    ("   ", False),
    (None, False),
    ("data:text/plain,wrench", False),
    ("https://github.com/tool-makers/../wrench", False),
    ("https://github.com/tool-/wrench", False),
    ("https://github.com/" + "a" * 40 + "/wrench", False),
    ("https://github.com/tool-makers/" + "r" * 101, False),
])
def test_url(spark, url, good):
    row = spark.createDataFrame([(url,)], "u string").select(
        paths.normalize_url(F.col("u")).alias("n")
    ).select("n", paths.is_repository_url(F.col("n")).alias("ok"),
             paths.full_name(F.col("n")).alias("name")).first()
    assert row.ok == good
    if good:
        assert not row.n.endswith("/")
        assert row.name == "/".join(row.n.split("/")[-2:])


def test_register(spark):
    requests = spark.createDataFrame([
        ("q1", "u1", "https://github.com/o/a/", NOW + timedelta(hours=1)),
        ("q2", "u2", "https://github.com/o/a", NOW),
        ("q3", "u1", "https://github.com/o/known", NOW),
        ("q4", "u1", "ftp://x", NOW),
        ("q5", "u1", "https://github.com/o/b", NOW),
    ], "request_id string, owner_id string, url string, requested_at timestamp")
    known = spark.createDataFrame([("https://github.com/o/known",)], "github_url string")
    decided = catalog.register_repositories(requests, known)
    assert {r.request_id: r.outcome for r in decided.collect()} == {
        "q1": "already_registered", "q2": "registered", "q3": "already_registered",
        "q4": "invalid_url", "q5": "registered",
    }
    new = catalog.new_repositories(decided)
    assert {(r.owner_id, r.full_name, r.default_branch, r.is_active) for r in new.collect()} == {
        ("u2", "o/a", "main", True), ("u1", "o/b", "main", True),
    }
    assert [f.name for f in new.schema] == schemas.REPOSITORIES.names
    assert catalog.register_repositories(requests, new).filter("outcome = 'registered'").collect()[0][
        "github_url"] == "https://github.com/o/known"


def test_unique_emails(spark):
    rows = spark.createDataFrame(
        [("a@x", 2, "late"), ("a@x", 1, "first"), ("b@x", 1, "known")], "email string, at int, n string"
    )
    known = spark.createDataFrame([("b@x",)], "email string")
    assert [r.n for r in catalog.first_of_key(rows, "email", ["at"], known).collect()] == ["first"]
    found = catalog.exists_all(known, "email", rows).collect()
    assert {(r.email, r.found) for r in found} == {("a@x", False), ("b@x", True)}


@pytest.mark.parametrize("commit, ref", [
    (None, "HEAD"), ("a" * 40, "a" * 40), ("ABC1234", "ABC1234"), ("abc123", None),
    ("g" * 10, None), ("a" * 41, None), ("abcdef1\n", None), ("", None),
])
def test_commit(spark, commit, ref):
    row = spark.createDataFrame([(commit,)], "c string").select(
        catalog.requested_commit(F.col("c")).alias("c")
    ).first().c
    assert (row.ref, row.is_valid) == (ref, ref is not None)


def test_resolve(spark):
    repositories = spark.createDataFrame([("r1", "dev")], "id string, default_branch string")
    refs = spark.createDataFrame(
        [("r1", "dev", "d" * 40), ("r1", "v1", "e" * 40)], "repository_id string, ref string, sha string"
    )
    wanted = ["HEAD", "v1", "nope", "F" * 40]
    requests = spark.createDataFrame(
        [(str(i), "r1", ref) for i, ref in enumerate(wanted)], "id string, repository_id string, ref string"
    )
    got = catalog.resolve_commits(requests, refs, repositories).orderBy("id").collect()
    assert [r.resolved_sha for r in got] == ["d" * 40, "e" * 40, None, "f" * 40]


def test_reuse_window(spark):
    ages = [-1, 0, 86_399, 86_400]
    analyses = spark.createDataFrame(
        [("r", str(a), "completed", NOW - timedelta(seconds=a)) for a in ages]
        + [("r", "failed", "failed", NOW), ("r", "running", "running", None)],
        "repository_id string, commit_sha string, status string, completed_at timestamp",
    )
    fresh = catalog.fresh_results(analyses, F.lit(NOW))
    split = catalog.split_by_reuse(analyses, fresh).collect()
    assert {r.commit_sha for r in split if r.decision == "reuse"} == {"0", "86399"}
    assert len(split) == 6


def test_lifecycle(spark):
    at = [NOW + timedelta(seconds=i) for i in range(3)]
    events = spark.createDataFrame([
        ("a", "r", "c", "manual", "completed", at[2], None),
        ("a", "r", "c", "manual", "pending", at[0], None),
        ("a", "r", "c", "manual", "running", at[1], None),
        ("b", "r", "c", "manual", "pending", at[0], None),
        ("b", "r", "c", "manual", "running", at[0], None),
        ("c", "r", "c", "manual", "failed", at[1], "e" * 2000),
    ], schemas.ANALYSIS_EVENTS)
    state = {r.analysis_id: r for r in catalog.run_state(events).collect()}
    assert [state[k].status for k in "abc"] == ["completed", "running", "failed"]
    assert state["a"].completed_at - state["a"].started_at == timedelta(seconds=1)
    assert len(state["c"].error_message) == 1000
    checked = catalog.check_updates(events, events.filter("status = 'pending'")).collect()
    assert {r.analysis_id for r in checked if not r.is_known} == {"c"}


@pytest.mark.parametrize("error, count, status", [
    (None, 0, "completed"), ("x", 0, "failed"), ("x", 1, "completed"), (None, 5, "completed"),
])
def test_terminal(spark, error, count, status):
    row = spark.createDataFrame([(error, count)], "e string, n int").select(
        catalog.terminal_status(F.col("e"), F.col("n"))
    ).first()
    assert row[0] == status


def test_size_guard(spark):
    files = spark.createDataFrame(
        [("a", "c", 60), ("a", "c", 50), ("b", "c", 100), ("n", "c", None)],
        "repo string, commit_sha string, size_bytes long",
    )
    got = {r.repo: r.is_too_large for r in catalog.guard_size(files, 100).collect()}
    assert got == {"a": True, "b": False, "n": False}


def test_cascade(spark):
    users = spark.createDataFrame([("u1",), ("u2",)], "id string")
    repositories = spark.createDataFrame([("r1", "u1"), ("r2", "u2")], "id string, owner_id string")
    analyses = spark.createDataFrame([("a1", "r1"), ("a2", "r2")], "id string, repository_id string")
    found = spark.createDataFrame([("f1", "a1"), ("f2", "a2")], "id string, analysis_id string")
    left = catalog.delete_users(users.filter("id = 'u1'"), users, repositories, analyses, found)
    assert [[r.id for r in t.collect()] for t in left] == [["u2"], ["r2"], ["a2"], ["f2"]]


def test_details_keep_empty_runs(spark):
    analyses = spark.createDataFrame([("a1", "x"), ("a2", "y")], "id string, status string")
    report = spark.createDataFrame([("a1", 1, "t")], "analysis_id string, position int, title string")
    rows = catalog.analysis_details(analyses, report).collect()
    assert {(r.analysis_id, r.status, r.title) for r in rows} == {("a1", "x", "t"), ("a2", "y", None)}


def test_lookup_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "repositories")
    spark.createDataFrame([("r1", "u1")], "id string, owner_id string").write.parquet(path)
    hit = catalog.lookup(spark.read.parquet(path), "id", "r1")
    assert hit.count() == 1
    plan = hit._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,r1)" in plan
