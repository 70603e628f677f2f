from __future__ import annotations

import hashlib
import hmac
import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from auditloom import schemas
from auditloom.functions.signature import hmac_sha256
from auditloom.operators import catalog, webhooks
from auditloom.operators.review import RESPONSES
from auditloom.plans.audit import audit_batches
from auditloom.sources.tables import stream_table
from auditloom.streaming.webhooks import queue_webhooks

SECRET = b"s3cret"
NOW = datetime(2024, 5, 1, tzinfo=timezone.utc)
KNOWN = "https://github.com/o/r"
SHA = "a" * 40


def sign(body: bytes, secret=SECRET) -> str:
    return "sha256=" + hmac.new(secret, body, hashlib.sha256).hexdigest()


def push(url=KNOWN, after=SHA, **more) -> bytes:
    return json.dumps({"repository": {"html_url": url}, "after": after, **more}).encode()


def pull(sha=SHA) -> bytes:
    return json.dumps({"repository": {"html_url": KNOWN}, "pull_request": {"head": {"sha": sha}}}).encode()


CASES = [
    # body, event, signature (None: a good one), outcome
    (push(), "push", None, "queued"),
    (pull(), "pull_request", None, "queued"),
    (push(), "push", "", "signature_missing"),
    (push(), "push", "sha256", "signature_malformed"),
    (push(), "push", "sha1=abc", "signature_malformed"),
    (push(), "push", "sha256=a=b", "signature_malformed"),
    (push(), "push", "sha256=00", "signature_wrong"),
    (b"{bad", "ping", None, "ignored_event"),
    (b"{bad", None, None, "ignored_event"),
    (b"{bad", "push", None, "invalid_json"),
    (b"", "push", None, "invalid_json"),
    (b'{"a":1}}', "push", None, "invalid_json"),
    (b'{"a":"\xff"}', "push", None, "invalid_json"),
    (b"[]", "push", None, "invalid_payload"),
    (b'{"repository":null}', "push", None, "invalid_payload"),
    (b'{"repository":[1]}', "push", None, "invalid_payload"),
    (b"{}", "push", None, "no_repository_url"),
    (b'{"repository":{"html_url":""}}', "push", None, "no_repository_url"),
    (push(after="0" * 40), "push", None, "branch_deleted"),
    (push(url="https://github.com/x/y"), "push", None, "unregistered"),
    (push(after=None), "push", None, "missing_commit"),
    (b'{"repository":{"html_url":"https://github.com/o/r"}}', "pull_request", None, "missing_commit"),
    (b'{"repository":{"html_url":"https://github.com/o/r"},"pull_request":3}', "pull_request", None,
     "invalid_payload"),
]


def deliveries(spark, cases):
    rows = [
        (i, bytearray(body), event, sign(body) if signature is None else signature,
         NOW + timedelta(minutes=i))
        for i, (body, event, signature, _) in enumerate(cases)
    ]
    return spark.createDataFrame(rows, schemas.WEBHOOKS)


@pytest.fixture(scope="module")
def repositories(spark):
    return spark.createDataFrame(
        [("r1", "u1", KNOWN, "o/r", "main", True, NOW)], schemas.REPOSITORIES
    )


def test_outcomes(spark, repositories):
    routed = webhooks.route(deliveries(spark, CASES), repositories, SECRET).orderBy("event_id")
    assert [r.outcome for r in routed.collect()] == [c[3] for c in CASES]
    missing = deliveries(spark, CASES[:1]).withColumn("signature", F.lit(None).cast("string"))
    assert webhooks.route(missing, repositories, SECRET).first().outcome == "signature_missing"


@pytest.mark.parametrize("secret", [b"", b"k", b"x" * 64, b"y" * 100])
def test_hmac(spark, secret):
    bodies = [b"", b"abc", bytes(range(256)) * 5]
    rows = spark.createDataFrame([(bytearray(b),) for b in bodies], "b binary")
    got = [r[0] for r in rows.select(hmac_sha256(F.col("b"), secret)).collect()]
    assert got == [hmac.new(secret, b, hashlib.sha256).hexdigest() for b in bodies]


def test_stream(spark, repositories, tmp_path):
    source = str(tmp_path / "in")
    batch = deliveries(spark, CASES)
    queue = str(tmp_path / "queue")
    audited = []

    def run(folder="queue", **more):
        stream = spark.readStream.schema(schemas.WEBHOOKS).parquet(source)
        queue_webhooks(
            stream, lambda: repositories, SECRET, str(tmp_path / folder),
            str(tmp_path / f"cp-{folder}"), once=True, **more,
        ).awaitTermination()

    batch.filter("event_id < 1").write.mode("append").parquet(source)
    run(on_runs=lambda runs, number: audited.append(runs.count()))
    batch.filter("event_id >= 1").write.mode("append").parquet(source)
    run(on_runs=lambda runs, number: audited.append(runs.count()))
    assert audited == [1, 1]

    want = webhooks.queued_analyses(webhooks.route(batch, repositories, SECRET))
    rows = spark.read.parquet(queue).select(want.columns)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, want.collect()))
    assert {r.triggered_by for r in rows.collect()} == {"webhook"}

    done = spark.createDataFrame(
        [("r1", SHA, "completed", NOW - timedelta(hours=1))],
        "repository_id string, commit_sha string, status string, completed_at timestamp",
    )
    run("reused", analyses=lambda: done)
    assert spark.read.parquet(str(tmp_path / "reused")).count() == 0


def test_redelivery(spark, repositories, tmp_path):
    """A second delivery of the same body runs again unless the window is set."""
    same = [CASES[0], CASES[0]]
    deliveries(spark, same).write.parquet(str(tmp_path / "webhooks"))
    for folder, window, count in [("all", None, 2), ("once", "1 hour", 1)]:
        stream = stream_table(spark, str(tmp_path), "webhooks")
        queue_webhooks(
            stream, lambda: repositories, SECRET, str(tmp_path / folder),
            str(tmp_path / f"cp-{folder}"), redelivery_window=window, once=True,
        ).awaitTermination()
        assert spark.read.parquet(str(tmp_path / folder)).count() == count


def test_webhook_to_findings(spark, repositories, tmp_path):
    """A push is queued, audited and stored; a repeated batch stores nothing twice."""
    source = spark.createDataFrame(
        [("o/r", SHA, "src/a.py", bytearray(b"from os import *\n"), 17)], schemas.SOURCE_FILES
    )
    answers = spark.createDataFrame([], RESPONSES)
    run = audit_batches(lambda: source, lambda: answers, str(tmp_path / "out"), lambda: NOW)
    deliveries(spark, CASES[:3]).write.parquet(str(tmp_path / "webhooks"))
    queue_webhooks(
        stream_table(spark, str(tmp_path), "webhooks"), lambda: repositories, SECRET,
        str(tmp_path / "queue"), str(tmp_path / "cp"), on_runs=run, once=True,
    ).awaitTermination()
    queued = spark.read.parquet(str(tmp_path / "queue"))
    run(queued.drop("batch"), 0)

    found = spark.read.parquet(str(tmp_path / "out" / "findings")).collect()
    assert sorted(r.rule_id for r in found) == ["AST-Q001"] * 2
    events = spark.read.parquet(str(tmp_path / "out" / "analysis_events"))
    states = catalog.run_state(events).collect()
    assert {r.analysis_id for r in states} == {r.analysis_id for r in queued.collect()}
    assert [r.status for r in states] == ["completed"] * 2
    metrics = spark.read.parquet(str(tmp_path / "out" / "run_metrics")).collect()
    assert [(r.total_findings, r.files_analyzed) for r in metrics] == [(1, 1)] * 2
