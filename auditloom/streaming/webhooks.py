"""Webhook stream to queued runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from auditloom.operators import catalog, webhooks


def queue_webhooks(
    deliveries: DataFrame,
    repositories: Callable[[], DataFrame],
    secret: bytes,
    queue_path: str,
    checkpoint: str,
    analyses: Callable[[], DataFrame] | None = None,
    redelivery_window: str | None = None,
    on_runs: Callable[[DataFrame, int], None] | None = None,
    once: bool = False,
) -> StreamingQuery:
    """Verify, route and queue deliveries; each batch goes to its own folder.

    `repositories` and `analyses` are called per batch, so new registrations and results count.
    With `analyses`, commits with a result younger than a day at `received_at` of the batch's
    latest delivery are not queued again. A batch that is repeated after a failure overwrites its
    folder, so nothing is queued twice. A redelivery by the sender runs again unless
    `redelivery_window` is given. `on_runs` gets the queued runs of a batch, to audit them.
    """
    if redelivery_window is not None:
        deliveries = deliveries.withWatermark(
            "received_at", redelivery_window
        ).dropDuplicatesWithinWatermark(["body", "event"])

    def queue(batch: DataFrame, number: int) -> None:
        routed = webhooks.route(batch, repositories(), secret)
        runs = webhooks.queued_analyses(routed)
        if analyses is not None:
            as_of = batch.agg(F.max("received_at")).first()[0]
            fresh = catalog.fresh_results(analyses(), F.lit(as_of))
            split = catalog.split_by_reuse(runs, fresh)
            runs = split.filter(F.col("decision") == "run").drop("decision")
        folder = f"{queue_path}/batch={number}"
        runs.write.mode("overwrite").parquet(folder)
        if on_runs is not None:
            on_runs(batch.sparkSession.read.schema(runs.schema).parquet(folder), number)

    writer = deliveries.writeStream.foreachBatch(queue).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
