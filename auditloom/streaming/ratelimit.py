"""The limiter on a stream: state per client is at most `limit` times."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from auditloom import fixed
from auditloom.operators.ratelimit import MICROS, Policy, apply_policies, decide_run

DECISIONS = (
    "event_id long, path string, client_ip string, accepted boolean, retry_after long"
)
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Limiter(StatefulProcessor):
    """Keeps one client's accepted times of the last window."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._times = handle.getListState("accepted", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # a batch reaches its client unordered
        frame = pd.concat(list(rows)).sort_values(["at", "event_id"], ignore_index=True)
        kept = deque(int(t[0]) for t in self._times.get()) if self._times.exists() else deque()
        limits = frame["max_requests"].to_numpy("int64")
        accepted, wait = decide_run(
            frame["at"].to_numpy("int64"), limits, int(frame["window_us"].iloc[0]),
            np.zeros(len(frame), bool), kept,
        )
        if kept:
            self._times.put([(t,) for t in kept])
        yield pd.DataFrame({
            "event_id": frame["event_id"],
            "path": key[0],
            "client_ip": key[1],
            "accepted": accepted,
            "retry_after": pd.Series(wait, dtype="Int64").mask(wait < 0),
        })

    def close(self) -> None:
        pass


def rate_limit_stream(
    log: DataFrame, policies: Sequence[Policy] = tuple(fixed.ROUTE_POLICIES),
) -> DataFrame:
    """Decisions for a stream of requests that arrives in time order.

    Needs the RocksDB state store (`spark.sql.streaming.stateStore.providerClass`). The source's
    rate option bounds what one client can have in a batch. Requests without a policy pass and
    are not counted.
    """
    timed = apply_policies(log, policies).select(
        "event_id", "path", "client_ip", "max_requests",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        (F.col("window_s") * MICROS).alias("window_us"),
    )
    decided = timed.filter("max_requests IS NOT NULL").groupBy("path", "client_ip")
    limited = decided.transformWithStateInPandas(
        statefulProcessor=_Limiter(), outputStructType=DECISIONS,
        outputMode="Append", timeMode="None",
    )
    # neither state nor quota
    free = timed.filter("max_requests IS NULL").select(
        "event_id", "path", "client_ip", F.lit(True).alias("accepted"),
        F.lit(None).cast("long").alias("retry_after"),
    )
    return limited.unionByName(free)
