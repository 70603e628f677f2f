"""The run lifecycle on a stream: steps in order of time, illegal ones refused, overdue runs ended."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from auditloom import fixed

STEPS = "analysis_id string, status string, event_us long, error_message string, accepted boolean"
MICROS = 1_000_000


def fold(
    status: str | None, started: int, steps: list[tuple], until: int, limit: int,
) -> tuple[str | None, int, list[tuple]]:
    """State after `steps` (`at, rank, status, note`, sorted), and what became of each.

    A running run gets a timeout `limit` after its start, unless it ended by then; `until` is how far
    time has come.
    """
    out = []
    for at, _, wanted, note in [*steps, (until, 0, None, None)]:
        overdue = started + limit
        if status == "running" and (overdue < at or wanted is None and overdue == at):
            status = "timeout"
            out.append((status, overdue, None, True))
        if wanted is None:
            break
        accepted = wanted in fixed.NEXT_STATUSES.get(status, ())
        out.append((wanted, at, note, accepted))
        if accepted:
            status = wanted
            started = at if wanted == "running" else started
    return status, started, out


class _Lifecycle(StatefulProcessor):
    """Keeps a run's state, and its events until the watermark has passed them."""

    def __init__(self, limit: int, retention: int) -> None:
        self._limit, self._retention = limit, retention

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("state", "status string, started long, ended long")
        self._ahead = handle.getListState("ahead", "at long, rank int, status string, note string")

    def _wake(self, at: int) -> None:
        self._handle.registerTimer(-(-at // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            notes = [None if pd.isna(n) else n for n in frame["error_message"]]
            columns = (frame["at"].tolist(), frame["rank"].tolist(), frame["status"].tolist(), notes)
            self._ahead.appendList(list(zip(*columns)))
            for at in set(columns[0]):
                self._wake(at)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = {tuple(step) for step in self._ahead.get()} if self._ahead.exists() else set()
        due = sorted((s for s in waiting if s[0] <= until), key=lambda s: (*s[:2], s[3] is not None, s[3] or ""))
        before = self._state.get() if self._state.exists() else (None, 0, 0)
        status, started, out = fold(before[0], int(before[1]), due, until, self._limit)
        if len(due) < len(waiting):
            self._ahead.put(list(waiting.difference(due)))
        elif waiting:
            self._ahead.clear()
        if (status, started) != (before[0], int(before[1])):
            ended = next((at for _, at, _, ok in reversed(out) if ok), 0)
            self._state.update((status, started, ended))
            if status == "running":
                self._wake(started + self._limit)
            elif status not in fixed.NEXT_STATUSES:
                self._wake(ended + self._retention)
        elif status is not None and status not in fixed.NEXT_STATUSES:
            if int(before[2]) + self._retention <= until and not self._ahead.exists():
                self._state.clear()
        if out:
            frame = pd.DataFrame(out, columns=["status", "event_us", "error_message", "accepted"])
            frame.insert(0, "analysis_id", key[0])
            yield frame
        else:
            yield pd.DataFrame()

    def close(self) -> None:
        pass


def run_steps_stream(
    events: DataFrame, delay: str, limit_seconds: int = fixed.RUN_SECONDS,
    retention_seconds: int = 7 * 86_400,
) -> DataFrame:
    """`catalog.run_steps` on a stream of events, up to where the watermark has come.

    Events may come in any order within `delay`; Spark drops and counts later ones. A run keeps its events
    of that time and one row of state, which goes `retention_seconds` after its end; from then on only a
    new `pending` would be taken again. Needs the RocksDB state store. Events without a
    time, a run or a known status do not take part.
    """
    known = F.array(*map(F.lit, fixed.STATUSES))
    timed = events.withWatermark("event_ts", delay).select(
        "analysis_id", "status", "error_message", "event_ts",
        F.unix_micros(F.col("event_ts").cast("timestamp")).alias("at"),
        F.array_position(known, F.col("status")).cast("int").alias("rank"),
    ).filter("analysis_id IS NOT NULL AND event_ts IS NOT NULL AND rank > 0")
    return timed.groupBy("analysis_id").transformWithStateInPandas(
        statefulProcessor=_Lifecycle(limit_seconds * MICROS, retention_seconds * MICROS),
        outputStructType=STEPS, outputMode="Append", timeMode="EventTime",
    )
