"""Sliding-window limiter over a request log.

A request is accepted while its path and client have fewer than `limit` accepted requests in
the last `window` seconds; rejected ones use no quota. That makes the decision depend on
earlier decisions, but only over one window. The log is therefore cut into cells of one window's
length:

* A cell that together with the cell before it holds no more than `limit` requests accepts them
  all. Most clients never leave this case, which needs counts only and stays in the JVM.
* The other cells form chains. Each chain starts from a cell whose accepted requests are known,
  so chains are independent, also those of one busy client.
* A long chain is cut into slices of time, which all begin at once, as if nothing had been accepted
  before. Then each is handed the accepted requests that the slice before it ended with. Where those
  differ from what it began with it is decided again, up to the point where both ways hold the same
  requests; from there on its first decisions stand. This repeats until nothing differs, so no task gets
  much more than a slice's worth of one client, and slices wait for each other only while a difference lasts.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditloom import fixed
from auditloom.session import cut

MICROS = 1_000_000
# Requests of one client and path that one task takes at a time
SLICE_ROWS = 50_000_000
# A slice ends with a whole tick: a second, or less for short windows
_TICKS_PER_WINDOW = 64
_BROADCAST_POLICIES = 10_000
_CLIENT = ["path", "client_ip"]

Policy = tuple[str, str, int, int]


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def policy_table(spark: SparkSession, policies: Sequence[Policy]) -> DataFrame:
    """Policies as rows. Methods of one route share their list of times, hence one window."""
    windows: dict[str, int] = {}
    lowest: dict[str, int] = {}
    for route, _, limit, window in policies:
        if windows.setdefault(route, window) != window:
            raise ValueError(f"policies of {route} have different windows")
        if limit < 1:
            raise ValueError(f"the limit of {route} is {limit}; it must be 1 or more")
        lowest[route] = min(limit, lowest.get(route, limit))
    rows = ", ".join(
        f"({_quoted(route)}, {_quoted(method)}, {limit}L, {window}L, {lowest[route]}L)"
        for route, method, limit, window in policies
    )
    return spark.sql(
        f"SELECT * FROM VALUES {rows} AS p(route, method, max_requests, window_s, lowest)"
    )


def apply_policies(log: DataFrame, policies: Sequence[Policy]) -> DataFrame:
    """Requests with their client and policy; those of routes without one are not limited."""
    table = policy_table(log.sparkSession, policies)
    if len(policies) <= _BROADCAST_POLICIES:
        table = F.broadcast(table)
    known = log.withColumn("client_ip", F.coalesce("client_ip", F.lit(fixed.DEFAULT_CLIENT)))
    return known.join(table, ["route", "method"], "left")


def decide_run(
    ts: np.ndarray, limits: np.ndarray, window: int, seeds: np.ndarray, kept: deque[int],
) -> tuple[np.ndarray, np.ndarray]:
    """Decide time-ordered requests of one client. `kept` holds accepted times and is updated.

    Returns accepted flags and, for rejected requests, the seconds to wait (else -1). Rejected
    stretches are skipped by binary search, so the work follows the accepted requests.
    """
    times, at_most, known = ts.tolist(), limits.tolist(), seeds.tolist()
    n = len(times)
    changes = (np.flatnonzero(limits[1:] != limits[:-1]) + 1).tolist()
    accepted = np.ones(n, bool)
    oldest: list[int] = []
    lengths: list[int] = []
    i = 0
    while i < n:
        now = times[i]
        while kept and now - kept[0] >= window:
            kept.popleft()
        if known[i] or len(kept) < at_most[i]:
            kept.append(now)
            i += 1
            continue
        # nothing changes until the oldest time leaves the window or the limit differs
        same = bisect_right(changes, i)
        stop = changes[same] if same < len(changes) else n
        end = bisect_left(times, kept[0] + window, i, stop)
        accepted[i:end] = False
        oldest.append(kept[0])
        lengths.append(end - i)
        i = end
    wait = np.full(n, -1, np.int64)
    rejected = np.flatnonzero(~accepted)
    held_since = np.repeat(np.array(oldest, np.int64), lengths)
    wait[rejected] = (window - (ts[rejected] - held_since)) // MICROS
    return accepted, wait


class _Fold:
    """The state of one slice: accepted times in the window now, and by the decisions of the round before."""

    def __init__(self) -> None:
        self.kept: deque[int] = deque()
        self.old: deque[int] = deque()
        self.met = False

    def decide(
        self, ts: np.ndarray, limits: np.ndarray, window: int, seeds: np.ndarray, was: np.ndarray, waits: np.ndarray,
    ) -> tuple[np.ndarray, np.ndarray]:
        """Decide again window by window until both states are the same; what `was` decided stands from there."""
        n, times = len(ts), ts.tolist()
        accepted, wait = was.copy(), waits.copy()
        i = 0
        while i < n and not self.met:
            end = max(bisect_left(times, times[i] + window, i), i + 1)
            now = np.flatnonzero(seeds[i:end] != OLD_SEED) + i
            accepted[now], wait[now] = decide_run(ts[now], limits[now], window, seeds[now] == SEED, self.kept)
            self.old.extend(ts[i:end][(seeds[i:end] == OLD_SEED) | (seeds[i:end] == REQUEST) & was[i:end]].tolist())
            for state in (self.kept, self.old):
                while state and times[end - 1] - state[0] >= window:
                    state.popleft()
            self.met = seeds[end - 1] == REQUEST and self.kept == self.old  # seeds come before requests
            i = end
        return accepted, wait


def _decide_batches(batches: Iterator[pa.RecordBatch], first: bool) -> Iterator[pa.RecordBatch]:
    """Fold sorted batches; the state is one slice's accepted times, at most `limit` of them.

    In the `first` round there is nothing to compare with.
    """
    fold = _Fold()
    last: tuple | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = [batch.column(c) for c in _SLICE]
        change = np.zeros(batch.num_rows, bool)
        for column in keys:
            change[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(change)
        bounds = [0, *starts.tolist(), batch.num_rows]
        ts, limits, windows, seeds = (
            batch.column(c).to_numpy() for c in ("at", "max_requests", "window_us", "seed")
        )
        was = batch.column("was").fill_null(False).to_numpy(zero_copy_only=False)
        waits = batch.column("waited").fill_null(-1).to_numpy()
        accepted, wait = np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows, np.int64)
        for low, high in zip(bounds, bounds[1:]):
            here = tuple(column[low].as_py() for column in keys)
            if here != last:
                fold, last = _Fold(), here
            part, window = slice(low, high), int(windows[low])
            if first:
                accepted[part], wait[part] = decide_run(
                    ts[part], limits[part], window, seeds[part] == SEED, fold.kept
                )
            else:
                accepted[part], wait[part] = fold.decide(
                    ts[part], limits[part], window, seeds[part], was[part], waits[part]
                )
        rows = pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in _WAITING), batch.column("slice"),
             pa.array(accepted), pa.array(wait, mask=wait < 0)],
            names=[*_WAITING, "slice", "accepted", "retry_after"],
        )
        yield rows.filter(pa.array(seeds == REQUEST))


#: What a row is: a request to decide, an accepted one before the slice, or one that the last round held there.
REQUEST, SEED, OLD_SEED = 0, 1, 2
_SLICE = [*_CLIENT, "chain", "slice"]
_WAITING = ["event_id", *_CLIENT, "chain", "at", "max_requests", "window_us"]
_DECIDED = (
    "event_id long, path string, client_ip string, chain long, at long, max_requests long, "
    "window_us long, slice long, accepted boolean, retry_after long"
)


def _busy_cells(limited: DataFrame) -> DataFrame:
    """Cells that need decisions in order, with their chain and size."""
    by_time = Window.partitionBy(*_CLIENT).orderBy("cell")
    counted = limited.groupBy(*_CLIENT, "cell").agg(
        F.count("*").alias("n"), F.min("lowest").alias("lowest")
    )
    # a window over cells, not requests: a client has at most one row per window of time
    after_previous = F.lag("cell").over(by_time) == F.col("cell") - 1
    before = F.when(after_previous, F.lag("n").over(by_time)).otherwise(0)
    marked = counted.withColumn("follows", F.coalesce(after_previous, F.lit(False))).withColumn(
        "busy", F.col("n") + before > F.col("lowest")
    )
    next_busy = (F.lead("cell").over(by_time) == F.col("cell") + 1) & F.lead("busy").over(by_time)
    chained = marked.withColumn("leads", ~F.col("busy") & F.coalesce(next_busy, F.lit(False)))
    starts = F.when(F.col("leads") | ~F.col("follows"), F.col("cell"))
    return chained.filter(F.col("busy") | F.col("leads")).select(
        *_CLIENT, "cell", "n",
        F.max(starts).over(by_time.rowsBetween(Window.unboundedPreceding, 0)).alias("chain"),
    )


def _slices(waiting: DataFrame, slice_rows: int) -> DataFrame:
    """Slice of each tick of each chain, numbered without gaps."""
    chain = [*_CLIENT, "chain"]
    earlier = Window.partitionBy(*chain).orderBy("tick").rowsBetween(
        Window.unboundedPreceding, -1
    )
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    ticks = waiting.groupBy(*chain, "tick").agg(F.count("*").alias("n"))
    share = ticks.select(*chain, "tick", F.floor(before / F.lit(slice_rows)).alias("share"))
    number = F.dense_rank().over(Window.partitionBy(*chain).orderBy("share"))
    return share.select(*chain, "tick", number.cast("long").alias("slice"))


def rate_limit(
    log: DataFrame,
    policies: Sequence[Policy] = tuple(fixed.ROUTE_POLICIES),
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Decision per request of a log: event_id, path, client_ip, accepted, retry_after.

    `log` has event_id, route, method, path, client_ip and ts. Requests of one client and path
    share their quota over all methods; equal times are taken in order of event_id.
    """
    timed = apply_policies(log, policies).select(
        "event_id", *_CLIENT, "max_requests", "lowest",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        (F.col("window_s") * MICROS).alias("window_us"),
    ).withColumn("cell", F.floor(F.col("at") / F.col("window_us")))
    cells = cut(_busy_cells(timed.filter(F.col("max_requests").isNotNull())))
    longest = cells.groupBy(*_CLIENT, "chain").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]

    # few cells are busy: mostly the log itself is not shuffled
    marked = timed.join(cells.drop("n"), [*_CLIENT, "cell"], "left")
    free = marked.filter(F.col("chain").isNull()).select(
        "event_id", *_CLIENT,
        F.lit(True).alias("accepted"), F.lit(None).cast("long").alias("retry_after"),
    )
    waiting = marked.filter(F.col("chain").isNotNull()).select(*_WAITING)
    if (longest or 0) <= slice_rows:
        decided = _decide(_requests(waiting.withColumn("slice", F.lit(0).cast("long"))))
    else:
        decided = _decide_slices(waiting, slice_rows)
    return free.unionByName(decided.select("event_id", *_CLIENT, "accepted", "retry_after"))


def _requests(rows: DataFrame, seed: int = REQUEST) -> DataFrame:
    """Rows as a fold takes them, without decisions of an earlier round."""
    return rows.select(
        *_WAITING, "slice", F.lit(seed).alias("seed"), F.lit(None).cast("boolean").alias("was"),
        F.lit(None).cast("long").alias("waited"),
    )


def _handed_on(decided: DataFrame, seeds: DataFrame | None) -> DataFrame:
    """What slices end with, as the seeds of the next: no more than a policy's limit for each."""
    held = decided.filter("accepted").select(*_WAITING, "slice")
    if seeds is not None:  # a slice can be shorter than the window
        held = held.unionByName(seeds)
    ends = held.groupBy(*_SLICE).agg(F.max("at").alias("end"))
    return held.join(ends, _SLICE).filter(F.col("at") > F.col("end") - F.col("window_us")).select(
        *_WAITING, (F.col("slice") + 1).alias("slice")
    )


def _signatures(seeds: DataFrame) -> DataFrame:
    """One number per slice; equal for equal seeds."""
    name = F.xxhash64("event_id", "at").cast("decimal(38,0)")
    return seeds.groupBy(*_SLICE).agg(F.sum(name).alias("sum"), F.count("*").alias("held"))


def _decide_slices(waiting: DataFrame, slice_rows: int) -> DataFrame:
    """Decide all slices at once, then again those that were handed something else than they began with."""
    tick = F.least(F.lit(MICROS), F.ceil(F.col("window_us") / _TICKS_PER_WINDOW))
    ticked = waiting.withColumn("tick", F.floor(F.col("at") / tick))
    sliced = ticked.join(_slices(ticked, slice_rows), [*_CLIENT, "chain", "tick"]).drop("tick")
    decided = cut(_decide(_requests(sliced)))
    slices = cut(decided.select(*_SLICE).distinct())

    def next_of(rows: DataFrame, seeds: DataFrame | None) -> DataFrame:
        return cut(_handed_on(rows, seeds).join(slices, _SLICE, "left_semi"))

    seeds, handed = None, next_of(decided, None)
    while True:
        given = _signatures(handed)
        if seeds is not None:
            same = _signatures(seeds).join(given, [*_SLICE, "sum", "held"])
            dropped = _signatures(seeds).join(given, _SLICE, "left_anti")
            given = given.join(same, _SLICE, "left_anti").unionByName(dropped)
        changed = cut(given.select(*_SLICE))
        if changed.head() is None:
            return decided
        again = decided.join(changed, _SLICE, "left_semi").select(
            *_WAITING, "slice", F.lit(REQUEST).alias("seed"), F.col("accepted").alias("was"),
            F.coalesce("retry_after", F.lit(-1)).alias("waited"),
        ).unionByName(_requests(handed.join(changed, _SLICE, "left_semi"), SEED))
        if seeds is not None:
            again = again.unionByName(_requests(seeds.join(changed, _SLICE, "left_semi"), OLD_SEED))
        redone = cut(_decide(again, first=False))
        decided = decided.join(changed, _SLICE, "left_anti").unionByName(redone)
        after = changed.withColumn("slice", F.col("slice") + 1)
        fresh = next_of(redone, handed.join(changed, _SLICE, "left_semi"))
        seeds, handed = handed, handed.join(after, _SLICE, "left_anti").unionByName(fresh)


def _decide(rows: DataFrame, first: bool = True) -> DataFrame:
    placed = rows.repartition(*_SLICE)
    ordered = placed.sortWithinPartitions(*_SLICE, "at", "event_id", "seed")
    return ordered.mapInArrow(lambda batches: _decide_batches(batches, first), _DECIDED)
