from __future__ import annotations

import random
from collections import deque
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditloom import fixed
from auditloom.operators import ratelimit
from auditloom.streaming.ratelimit import rate_limit_stream

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
POLICIES = [("/a", "GET", 3, 60), ("/a", "POST", 2, 60), ("/b", "GET", 1, 10)]
LOG = "event_id long, route string, method string, path string, client_ip string, ts timestamp"


def some_log(n=1500, seed=3, hot=0.4):
    """Quiet clients, one that never stops, a route and a method without a policy."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        if draw.random() < hot:
            path, client, second = "/a", "hot", draw.uniform(0, 2000)
        else:
            path = draw.choice(["/a", "/b", "/free"])
            client = draw.choice([None, *(f"c{i}" for i in range(8))])
            second = draw.choice([draw.uniform(0, 4000), 60 * draw.randrange(60)])
        method = draw.choice(["GET", "POST", "OPTIONS"]) if path == "/a" else "GET"
        rows.append((i, path, method, path, client, START + timedelta(seconds=round(second, 3))))
    return rows


def one_by_one(rows):
    """Sequential reading: keep accepted times per path and client."""
    rules = {(r, m): (n, w) for r, m, n, w in POLICIES}
    lists, out = {}, {}
    for event, route, method, path, client, ts in sorted(rows, key=lambda r: (r[5], r[0])):
        if (route, method) not in rules:
            out[event] = (True, None)
            continue
        limit, window = rules[route, method]
        now = round((ts - START).total_seconds() * 1_000_000)
        times = [t for t in lists.get((path, client), []) if now - t < window * 1_000_000]
        if len(times) >= limit:
            out[event] = (False, (window * 1_000_000 - (now - times[0])) // 1_000_000)
        else:
            times.append(now)
            out[event] = (True, None)
        lists[path, client] = times
    return out


def decisions(df):
    return {r.event_id: (r.accepted, r.retry_after) for r in df.collect()}


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 30), st.sampled_from([1, 2, 3])), min_size=1, max_size=60),
    st.lists(st.integers(1, 59), max_size=3),
)
def test_fold(requests, cuts):
    """Any split into batches gives what a loop over single requests gives."""
    requests = sorted(requests, key=lambda r: r[0])
    ts = np.array([t * 500_000 for t, _ in requests], np.int64)
    limits = np.array([n for _, n in requests], np.int64)
    window = 3_000_000
    times, want = [], []
    for now, limit in zip(ts.tolist(), limits.tolist()):
        times = [t for t in times if now - t < window]
        ok = len(times) < limit
        want.append((ok, -1 if ok else (window - (now - times[0])) // 1_000_000))
        times += [now] * ok
    kept, got = deque(), []
    bounds = sorted({0, len(ts), *(c for c in cuts if c < len(ts))})
    for low, high in zip(bounds, bounds[1:]):
        part = slice(low, high)
        accepted, wait = ratelimit.decide_run(
            ts[part], limits[part], window, np.zeros(high - low, bool), kept
        )
        got += zip(accepted.tolist(), wait.tolist())
    assert got == want
    assert len(kept) <= 3


@pytest.mark.parametrize("slice_rows, seed", [(ratelimit.SLICE_ROWS, 3), (150, 3), (7, 4)])
def test_batch(spark, slice_rows, seed):
    rows = some_log(150 if slice_rows == 7 else 1500, seed)
    got = decisions(ratelimit.rate_limit(spark.createDataFrame(rows, LOG), POLICIES, slice_rows))
    want = one_by_one(rows)
    assert got == want
    assert 0 < sum(not ok for ok, _ in want.values()) < len(want)


def test_a_window_larger_than_a_slice(spark):
    """Many requests in one window, even in one tick, are spread over slices."""
    draw = random.Random(5)
    at = [round(draw.choice([10, 10.001, draw.uniform(0, 130)]), 3) for _ in range(120)]
    rows = [
        (i, "/a", draw.choice(["GET", "POST"]), "/a", "hot", START + timedelta(seconds=s))
        for i, s in enumerate(at)
    ]
    got = decisions(ratelimit.rate_limit(spark.createDataFrame(rows, LOG), POLICIES, 15))
    assert got == one_by_one(rows)


def test_small_arrow_batches(spark):
    """State goes over batch borders."""
    rows = some_log(800, 9, hot=0.9)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 7)
    try:
        got = decisions(ratelimit.rate_limit(spark.createDataFrame(rows, LOG), POLICIES))
    finally:
        spark.conf.set(name, before)
    assert got == one_by_one(rows)


def test_quiet_clients_need_no_python(spark):
    rows = [(i, "/a", "GET", "/a", f"c{i % 50}", START + timedelta(seconds=200 * i)) for i in range(200)]
    log = spark.createDataFrame(rows, LOG)
    timed = ratelimit.apply_policies(log, POLICIES).select(
        "path", "client_ip", "lowest",
        F.floor(F.unix_seconds("ts") / 60).alias("cell"),
    )
    assert ratelimit._busy_cells(timed).count() == 0
    assert all(ok for ok, _ in decisions(ratelimit.rate_limit(log, POLICIES)).values())


def test_policies():
    assert len(fixed.ROUTE_POLICIES) == 10
    with pytest.raises(ValueError, match="different windows"):
        ratelimit.policy_table(None, [("/a", "GET", 1, 10), ("/a", "POST", 1, 20)])
    with pytest.raises(ValueError, match="1 or more"):
        ratelimit.policy_table(None, [("/a", "GET", 0, 10)])


def test_stream_equals_batch_over_a_restart(spark, tmp_path):
    rows = sorted(some_log(500), key=lambda r: (r[5], r[0]))
    source, out = str(tmp_path / "log"), str(tmp_path / "out")

    def run():
        log = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(source)
        query = (
            rate_limit_stream(log, POLICIES).writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        )
        query.awaitTermination()

    for part in range(2):
        low, high = part * 250, (part + 1) * 250
        spark.createDataFrame(rows[low:high], LOG).coalesce(1).write.mode("append").parquet(source)
        run()
    assert decisions(spark.read.parquet(out)) == one_by_one(rows)


def test_a_busy_client_is_decided_in_parallel(spark):
    """Most slices of a client that is never quiet are decided twice at most, and as one by one."""
    draw = random.Random(11)
    rows, at = [], 0.0
    for i in range(900):
        at += draw.choice([0.5, 1, 2, 30]) if i % 60 else 90
        rows.append((i, "/a", draw.choice(["GET", "POST"]), "/a", "hot", START + timedelta(seconds=at)))
    rounds = []
    plain, ratelimit._decide = ratelimit._decide, lambda *r, **k: rounds.append(r) or plain(*r, **k)
    try:
        got = decisions(ratelimit.rate_limit(spark.createDataFrame(rows, LOG), POLICIES, 40))
    finally:
        ratelimit._decide = plain
    assert got == one_by_one(rows)
    assert len(rounds) < 12  # slices: 900 / 40


def test_decisions_stand_from_where_states_meet():
    """A second round stops folding once it holds what the first one held."""
    ts = np.sort(np.random.default_rng(3).integers(0, 10_000, 400))
    limits = np.full(400, 4)
    window, none = 100, np.zeros(400, bool)
    was, waits = ratelimit.decide_run(ts, limits, window, none, deque())
    seeds = np.array([-90, -50, -10])
    want = ratelimit.decide_run(ts, limits, window, none, deque(seeds.tolist()))
    fold = ratelimit._Fold()
    got = fold.decide(
        np.r_[seeds, ts], np.r_[[4, 4, 4], limits], window, np.r_[[ratelimit.SEED] * 3, np.zeros(400, int)],
        np.r_[none[:3], was], np.r_[[-1] * 3, waits],
    )
    assert fold.met and (got[0][3:] == want[0]).all() and (got[1][3:] == want[1]).all()
