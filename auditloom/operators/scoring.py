"""Review requests sent through a ledger: what was paid for once is not sent again.

The ledger is a folder on a store that all executors share. A task notes each request before it sends it
(`sent`) and writes the answer as it comes (`answers`), one small file each, named by a hash of the
request. So answers outlive a lost executor, a failed job and a new session.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom import fixed
from auditloom.operators.review import RESPONSES, Scorer
from auditloom.schemas import SNAPSHOT_KEY
from auditloom.session import cut

#: Errors of requests that were not sent, or whose answer is lost
OVER_BUDGET, OUT_OF_TIME, NO_ANSWER = "over budget", "out of time", "sent before, no answer"
ANSWERS = T.StructType([T.StructField("key", T.StringType()), *RESPONSES.fields])
_OWN = [name for name in RESPONSES.names if name not in SNAPSHOT_KEY]


def keyed(requests: DataFrame) -> DataFrame:
    """Requests with the `key` that names them in the ledger; a changed text is another request."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in (*SNAPSHOT_KEY, "request")]
    return requests.withColumn("key", F.sha2(F.concat_ws("\n", *parts), 256))


def answers(spark: SparkSession, ledger: str) -> DataFrame:
    """All answers so far; none where nothing was sent yet."""
    try:
        return spark.read.schema(ANSWERS).json(f"{ledger}/answers/*")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ANSWERS)


def affordable(waiting: DataFrame, tokens: int, answer_tokens: int) -> DataFrame:
    """`key` of the requests, by order of key, that `tokens` pay for, each with an answer of `answer_tokens`.

    Running sums in 4,096 ranges of the key, shifted by what the ranges before cost. Texts do not move.
    """
    cost = F.ceil(F.length("request") / F.lit(fixed.CHARS_PER_TOKEN)) + answer_tokens
    priced = waiting.select("key", F.substring("key", 1, 3).alias("part"), F.coalesce(cost, F.lit(0)).alias("cost"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over 4,096 rows at most
    parts = priced.groupBy("part").agg(F.sum("cost").alias("whole")).select(
        "part", F.coalesce(F.sum("whole").over(before), F.lit(0)).alias("before")
    )
    within = Window.partitionBy("part").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    spent = priced.withColumn("own", F.sum("cost").over(within)).join(F.broadcast(parts), "part")
    return spent.filter(F.col("before") + F.col("own") <= tokens).select("key")


class _Ledger:
    """The ledger's files, as a task sees them."""

    def __init__(self, folder: str) -> None:
        plain = folder.removeprefix("file:") if folder.startswith("file:/") else folder
        self._store, self._root = fs.FileSystem.from_uri("/" + plain.lstrip("/") if "://" not in plain else plain)

    def _path(self, kind: str, key: str) -> str:
        return f"{self._root}/{kind}/{key[:2]}/{key}.json"

    def has(self, kind: str, key: str) -> bool:
        return self._store.get_file_info(self._path(kind, key)).type == fs.FileType.File

    def read(self, key: str) -> dict:
        with self._store.open_input_stream(self._path("answers", key)) as file:
            return json.loads(file.read())

    def write(self, kind: str, key: str, row: dict) -> None:
        """The file appears whole: it is written beside its folder, then renamed."""
        path, draft = self._path(kind, key), f"{self._root}/drafts/{kind}-{key}-{time.time_ns()}"
        for folder in (path.rsplit("/", 1)[0], draft.rsplit("/", 1)[0]):
            self._store.create_dir(folder, recursive=True)
        with self._store.open_output_stream(draft) as file:
            file.write(json.dumps(row).encode())
        self._store.move(draft, path)

    def forget(self, key: str) -> None:
        self._store.delete_file(self._path("sent", key))


def _send(ledger: _Ledger, one: pd.DataFrame, scorer: Scorer, resend: bool) -> dict:
    """The answer to one request: from the ledger, else from the scorer."""
    key, own = one["key"].iloc[0], {c: one[c].iloc[0] for c in SNAPSHOT_KEY}
    failed = {**own, "key": key, "raw_content": None, "tokens_used": 0, "model": None}
    if ledger.has("answers", key):
        return ledger.read(key)
    if ledger.has("sent", key) and not resend:
        return {**failed, "error": NO_ANSWER}
    ledger.write("sent", key, own)
    try:
        scored = scorer(one.drop(columns="key")).iloc[0]
        raw, model = (None if pd.isna(scored[c]) else str(scored[c]) for c in ("raw_content", "model"))
        used = None if pd.isna(scored["tokens_used"]) else int(scored["tokens_used"])
    except Exception as error:  # no answer was had: a later call may send it again
        ledger.forget(key)
        return {**failed, "error": f"{type(error).__name__}: {error}"[: fixed.ERROR_CHARS]}
    row = {**own, "key": key, "raw_content": raw, "tokens_used": used, "model": model, "error": None}
    ledger.write("answers", key, row)
    return row


def review_resumable(
    requests: DataFrame, scorer: Scorer, ledger: str, token_budget: int | None = None,
    seconds: float | None = None, answer_tokens: int = 0, resend: bool = False,
    senders: int | None = None,
) -> DataFrame:
    """`review.review` that takes up where an earlier call, or a task that died, left off.

    Each request goes to the scorer alone, and only if the ledger has no answer to it; equal requests go
    once. One that was sent by a task that died before the answer came may have been paid for: it has the
    error `NO_ANSWER` and is sent again only with `resend`. One whose scorer raised has that as its error
    and is sent again by the next call. Requests beyond `token_budget` (this call's, by order of key), or
    not begun within `seconds`, have the errors `OVER_BUDGET` and `OUT_OF_TIME` and stay for the next call.
    Answers are had when the call returns. `senders` tasks (the session's default parallelism, if not given)
    send, however few bytes the requests have. Spark must not run a task twice at once (`spark.speculation`),
    and one call at a time uses a ledger.
    """
    spark = requests.sparkSession
    if spark.sparkContext.getConf().get("spark.speculation", "false").lower() == "true":
        raise ValueError("spark.speculation would send requests twice")
    until = None if seconds is None else time.time() + seconds
    wanted = cut(keyed(requests.select(*SNAPSHOT_KEY, "request")))
    known = answers(spark, ledger).select("key", *_OWN)
    waiting = wanted.dropDuplicates(["key"]).join(known.select("key"), "key", "left_anti")
    chosen = waiting
    if token_budget is not None:
        waiting = cut(waiting)
        chosen = waiting.join(affordable(waiting, token_budget, answer_tokens), "key", "left_semi")

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files = _Ledger(ledger)
        for batch in batches:
            rows = []
            for i in range(len(batch)):
                one = batch.iloc[i : i + 1]
                if until is not None and time.time() > until and not files.has("answers", one["key"].iloc[0]):
                    own = {c: one[c].iloc[0] for c in (*SNAPSHOT_KEY, "key")}
                    rows.append({**own, "raw_content": None, "tokens_used": 0, "model": None, "error": OUT_OF_TIME})
                else:
                    rows.append(_send(files, one, scorer, resend))
            frame = pd.DataFrame(rows, columns=ANSWERS.names)
            yield frame.astype({"tokens_used": "Int64"})

    earlier = cut(known)  # before more answers come
    spread = chosen.repartition(senders or spark.sparkContext.defaultParallelism, "key")
    sent = cut(spread.select(*SNAPSHOT_KEY, "request", "key").mapInPandas(send, ANSWERS)).select("key", *_OWN)
    given = wanted.join(earlier.unionByName(sent).withColumn("given", F.lit(True)), "key", "left")
    return given.select(
        *SNAPSHOT_KEY, "raw_content",
        F.when(F.col("given"), F.col("tokens_used")).otherwise(F.lit(0)).cast("long").alias("tokens_used"),
        "model", F.when(F.col("given"), F.col("error")).otherwise(F.lit(OVER_BUDGET)).alias("error"),
    )
