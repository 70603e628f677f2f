from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from auditloom import fixed, schemas
from auditloom.operators import catalog
from auditloom.streaming.lifecycle import fold, run_steps_stream

START = datetime(2024, 5, 1, tzinfo=timezone.utc)
LIMIT = 60


def table(spark, steps):
    rows = [
        (run, "r", "c", "t", status, None if at is None else START + timedelta(seconds=at), note)
        for run, status, at, note in steps
    ]
    return spark.createDataFrame(rows, schemas.ANALYSIS_EVENTS)


def seconds(rows):
    return sorted(
        (r.analysis_id, (r.event_ts.astimezone(timezone.utc) - START).total_seconds(), r.status,
         r.error_message or "", r.accepted)
        for r in rows
    )


def steps_of(spark, steps, as_of):
    at = F.lit(START + timedelta(seconds=as_of))
    return seconds(catalog.run_steps(table(spark, steps), at, LIMIT).collect())


def test_legal_and_illegal_steps(spark):
    steps = [
        ("a", "pending", 0, None), ("a", "running", 5, None), ("a", "completed", 65, None),
        ("a", "failed", 66, "late"), ("a", "completed", 65, None),
        ("b", "running", 0, None), ("b", "pending", 1, None), ("b", "completed", 2, None), ("b", "failed", 3, "x"),
        ("b", "running", 4, None),
        ("c", "pending", 0, None), ("c", "running", 1, None),
        ("d", "pending", 0, None), ("d", "running", 1, None), ("d", "completed", 62, None),
        ("e", "pending", 0, None), ("e", "running", 0, None), ("e", "completed", 0, None),
        ("f", "lost", 0, None), ("f", None, 0, None), ("f", "pending", None, None), (None, "pending", 0, None),
    ]
    assert steps_of(spark, steps, 100) == [
        ("a", 0, "pending", "", True), ("a", 5, "running", "", True), ("a", 65, "completed", "", True),
        ("a", 66, "failed", "late", False),
        ("b", 0, "running", "", False), ("b", 1, "pending", "", True), ("b", 2, "completed", "", False),
        ("b", 3, "failed", "x", True), ("b", 4, "running", "", False),
        ("c", 0, "pending", "", True), ("c", 1, "running", "", True), ("c", 61, "timeout", "", True),
        ("d", 0, "pending", "", True), ("d", 1, "running", "", True), ("d", 61, "timeout", "", True),
        ("d", 62, "completed", "", False),
        ("e", 0, "completed", "", True), ("e", 0, "pending", "", True), ("e", 0, "running", "", True),
    ]
    assert [s for s in steps_of(spark, steps, 60) if s[2] == "timeout"] == []
    assert steps_of(spark, [], 60) == []


def drawn(runs=40, seed=3):
    draw = random.Random(seed)
    return [
        (f"r{run}", draw.choice(fixed.STATUSES[:4]), draw.randrange(200), draw.choice([None, "x", "y"]))
        for run in range(runs) for _ in range(draw.randrange(9))
    ] + [(f"r{run}", "pending", draw.randrange(40), None) for run in range(runs)]


def test_batch_equals_fold(spark):
    steps, until = drawn(), 180
    expected = []
    for run in {s[0] for s in steps}:
        own = sorted(
            {(at, fixed.STATUSES.index(status), status, note) for r, status, at, note in steps if r == run and at <= until},
            key=lambda s: (*s[:2], s[3] is not None, s[3] or ""),
        )
        _, _, out = fold(None, 0, own, until, LIMIT)
        expected += [(run, at, status, note or "", accepted) for status, at, note, accepted in out]
    got = steps_of(spark, steps, until)
    assert got == sorted(expected)
    assert {s[2] for s in got if s[4]} == set(fixed.STATUSES)


def test_stream_equals_batch(spark, tmp_path):
    """Events come out of order by up to the delay, in several batches; the last one moves time on."""
    steps = [s for s in drawn(12, 8)]
    draw = random.Random(1)
    steps.sort(key=lambda s: s[2] + draw.randrange(30))
    source = str(tmp_path / "in")
    batches = [steps[i::1][:20] for i in range(0, len(steps), 20)] + [[("end", "pending", 1000, None)]]
    for batch in batches:
        table(spark, batch).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schemas.ANALYSIS_EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        run_steps_stream(stream, "100 seconds", LIMIT).writeStream.format("parquet")
        .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).withColumn("event_ts", F.timestamp_micros("event_us"))
    assert seconds(out.collect()) == steps_of(spark, steps, 900)
    assert any(s[2] == "timeout" for s in steps_of(spark, steps, 900))
