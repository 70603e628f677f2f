from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from auditloom import schemas
from auditloom.operators import catalog
from auditloom.plans.audit import audit, runs_to_audit

NOW = datetime(2024, 5, 1, tzinfo=timezone.utc)
VULNERABLE = '''
PASSWORD = 'correct-horse-9'

def cancel(order: int) -> None:
    """Cancels an order."""
    try:
        db.execute(f"DELETE FROM orders WHERE n = {order}")
    except:
        return
'''
CLEAN = 'def half(n: float) -> float:\n    """Half of it."""\n    return n / 2\n'


def run_audit(spark, targets=None):
    sha = {name: name * 40 for name in "abc"}
    files = [
        ("o/one", sha["a"], "src/vulnerable.py", VULNERABLE),
        ("o/one", sha["a"], "src/clean.py", CLEAN),
        ("o/one", sha["a"], "venv/x.py", VULNERABLE),
        ("o/one", sha["a"], "bad.py", "def ("),
        ("o/big", sha["b"], "src/clean.py", CLEAN * 100),
        ("o/unasked", sha["a"], "src/vulnerable.py", VULNERABLE),
    ]
    source = spark.createDataFrame(
        [(r, c, p, bytearray(t.encode()), len(t)) for r, c, p, t in files], schemas.SOURCE_FILES
    )
    runs = spark.createDataFrame([
        ("a1", "r1", "o/one", sha["a"]), ("a2", "r1", "o/one", sha["a"]),
        ("a3", "r2", "o/big", sha["b"]), ("a4", "r1", "o/one", sha["c"]),
        ("a5", "r1", "o/one", None),
    ], "analysis_id string, repository_id string, repo string, commit_sha string")
    item = {
        "category": "architecture", "severity": "medium", "title": "T", "description": "d",
        "file_path": "src/vulnerable.py", "recommendation": "r", "line_start": 2,
    }
    same_place = {**item, "severity": "high", "title": "U"}
    answer = json.dumps({"findings": [item, same_place, {}], "summary": "S"})
    answers = spark.createDataFrame(
        [("o/one", sha["a"], answer, 120)],
        "repo string, commit_sha string, raw_content string, tokens_used long",
    )
    return audit(
        runs, source, answers, F.lit(NOW), F.lit(NOW + timedelta(seconds=2.5)),
        max_snapshot_bytes=5000, targets=targets,
    )


def test_audit(spark):
    done = run_audit(spark)
    found = done.findings.collect()
    assert {(r.analysis_id, r.rule_id) for r in found} == {
        (run, rule) for run in ("a1", "a2") for rule in ("SEC-001", "AST-S001", "AST-S002", "LLM-001")
    }
    assert [f.name for f in done.findings.schema] == schemas.STORED_FINDINGS.names
    assert len({r.id for r in found}) == 8
    assert {r.title for r in found if r.rule_id == "LLM-001"} == {"U"}

    metrics = {r.analysis_id: r for r in done.metrics.collect()}
    first = metrics["a1"]
    assert (first.total_findings, first.critical_count, first.high_count) == (4, 2, 2)
    assert (first.static_count, first.review_count, first.discarded) == (3, 2, 1)
    assert (first.files_analyzed, first.tokens_used, first.summary) == (3, 120, "S")
    assert (first.status, first.duration_seconds) == ("completed", 2.5)
    assert {k: r.status for k, r in metrics.items()} == {
        "a1": "completed", "a2": "completed", "a3": "failed", "a4": "failed", "a5": "failed",
    }
    assert metrics["a3"].error_message.startswith("repository too large")
    assert metrics["a4"].error_message == "no files for this commit"
    assert metrics["a5"].error_message == "unknown ref"

    events = done.events.withColumn("triggered_by", F.lit("manual"))
    state = {r.analysis_id: r.status for r in catalog.run_state(events).collect()}
    assert state == {k: r.status for k, r in metrics.items()}


def test_targets_only(spark):
    targets = spark.createDataFrame(
        [("o/one", "a" * 40, "venv/x.py"), ("o/one", "a" * 40, "bad.py")],
        "repo string, commit_sha string, file_path string",
    )
    done = run_audit(spark, targets)
    assert {r.file_path for r in done.findings.filter("rule_id <> 'LLM-001'").collect()} == {"venv/x.py"}
    assert {r.files_analyzed for r in done.metrics.filter("analysis_id = 'a1'").collect()} == {2}


def test_new_push_is_not_answered_from_an_old_result(spark):
    repositories = spark.createDataFrame([("r1", "main")], "id string, default_branch string")
    done = spark.createDataFrame(
        [("r1", "d" * 40, "completed", NOW)],
        "repository_id string, commit_sha string, status string, completed_at timestamp",
    )
    requests = spark.createDataFrame([("q1", "r1", "HEAD")], "id string, repository_id string, ref string")

    def todo(head, **more):
        refs = spark.createDataFrame([("r1", "main", head)], "repository_id string, ref string, sha string")
        return runs_to_audit(requests, refs, repositories, done, F.lit(NOW), **more).collect()

    assert todo("d" * 40) == []
    assert [r.commit_sha for r in todo("e" * 40)] == ["e" * 40]
    assert [r.commit_sha for r in todo("d" * 40, reuse=False)] == ["d" * 40]
