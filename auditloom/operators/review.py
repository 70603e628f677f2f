"""Review requests: choose files, clean them, assemble one request per snapshot."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom import fixed
from auditloom.functions.paths import is_reviewed, safe_path
from auditloom.functions.text import nfkc, truncate
from auditloom.schemas import SNAPSHOT_KEY

RESPONSES = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("commit_sha", T.StringType()),
    T.StructField("raw_content", T.StringType()),
    T.StructField("tokens_used", T.LongType()),
    T.StructField("model", T.StringType()),
    T.StructField("error", T.StringType()),
])


def pick_files(files: DataFrame, limit: int = fixed.REVIEW_FILES,
               file_chars: int = fixed.REVIEW_FILE_CHARS) -> DataFrame:
    """The largest reviewable files of each snapshot, by bytes, with `place` 1 to `limit`.

    Content is cut before the shuffle. The rank filter lets Spark keep `limit` rows per snapshot
    and map task, so a large repository does not reach one reducer whole.
    """
    by_size = Window.partitionBy(*SNAPSHOT_KEY).orderBy(F.col("size_bytes").desc(), "file_path")
    return (
        files.filter(is_reviewed(F.col("file_path")) & F.col("content").isNotNull())
        .select(*SNAPSHOT_KEY, "file_path", "size_bytes",
                truncate(F.col("content"), file_chars).alias("content"))
        .withColumn("place", F.row_number().over(by_size))
        .filter(F.col("place") <= limit)
    )


def redact(df: DataFrame, column: str = "content", hits: str = "redactions") -> DataFrame:
    """Replace every injection phrase, pattern after pattern; `hits` counts patterns found."""
    found = F.lit(0)
    for i, pattern in enumerate(fixed.REDACT_PATTERNS):
        hit = F.col(f"_hit{i}")
        df = df.withColumn(f"_hit{i}", F.col(column).rlike(pattern))
        replaced = F.regexp_replace(column, pattern, fixed.REDACTED)
        df = df.withColumn(column, F.when(hit, replaced).otherwise(F.col(column)))
        found = found + hit.cast("int")
    return df.withColumn(hits, found).drop(*[f"_hit{i}" for i in range(len(fixed.REDACT_PATTERNS))])


def within_budget(picked: DataFrame, max_chars: int = fixed.REVIEW_MAX_CHARS) -> DataFrame:
    """Cut and redact each picked file, then keep files until the snapshot's budget is used.

    The file that crosses the budget stays. Files whose safe paths are equal become one: the
    first place, the last content.
    """
    cleaned = redact(
        picked.withColumn("safe_path", safe_path(F.col("file_path")))
        .withColumn("content", truncate(F.col("content"), max_chars))
    )
    before = (
        Window.partitionBy(*SNAPSHOT_KEY).orderBy("place")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    used = F.coalesce(F.sum(F.char_length("content")).over(before), F.lit(0))
    kept = cleaned.withColumn("chars_before", used).filter(
        F.col("chars_before") < max_chars * fixed.REVIEW_BUDGET_FACTOR
    )
    return kept.groupBy(*SNAPSHOT_KEY, "safe_path").agg(
        F.min("place").alias("place"),
        F.max_by("content", "place").alias("content"),
        F.min("chars_before").alias("chars_before"),
        F.sum("redactions").alias("redactions"),
    )


def _fill(template: str, **columns: Column) -> Column:
    """Concatenate a format's fixed parts and columns."""
    parts, rest = [], template
    while "{" in rest:
        head, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        parts += [F.lit(head), columns[name]]
    return F.concat(*parts, F.lit(rest))


def review_requests(kept: DataFrame) -> DataFrame:
    """One request text per snapshot: header, a block per file in order, footer.

    `kept` comes from `within_budget`, so a snapshot has a handful of short files.
    """
    block = _fill(fixed.REQUEST_FILE, path=F.col("safe_path"), content=F.col("content"))
    files = F.array_sort(F.collect_list(F.struct("place", block.alias("block"))))
    return kept.groupBy(*SNAPSHOT_KEY).agg(files.alias("files")).select(
        *SNAPSHOT_KEY,
        F.size("files").alias("file_count"),
        F.concat(
            _fill(fixed.REQUEST_HEADER, repo=F.col("repo")),
            F.array_join(F.transform("files", lambda f: f["block"]), ""),
            F.lit(fixed.REQUEST_FOOTER),
        ).alias("request"),
    )


def reject_unsafe(code: Column, max_tokens: int = fixed.PROMPT_MAX_TOKENS) -> Column:
    """Struct of the normalized, shortened code and whether an injection phrase rejects it."""
    text = nfkc(F.coalesce(code, F.lit("")))
    unsafe = F.lit(False)
    for pattern in fixed.REJECT_PATTERNS:
        unsafe = unsafe | text.rlike(pattern)
    limit = max_tokens * fixed.CHARS_PER_TOKEN
    short = F.when(
        F.char_length(text) > limit,
        F.concat(truncate(text, limit), F.lit(fixed.TRUNCATION_MARK)),
    ).otherwise(text)
    return F.struct(F.when(~unsafe, short).alias("code"), unsafe.alias("is_rejected"))


Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def review(requests: DataFrame, scorer: Scorer) -> DataFrame:
    """Send requests to the caller's scorer, batch by batch.

    The scorer takes a frame with repo, commit_sha and request and adds raw_content, tokens_used
    and model. The requests of a batch that raises are sent one by one; one that raises alone has
    a row with its `error` and no content, so its snapshot keeps its static findings.
    """
    names = RESPONSES.names

    def scored(batch: pd.DataFrame) -> pd.DataFrame:
        return scorer(batch).assign(error=None)[names]

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                yield scored(batch)
                continue
            except Exception:
                pass
            for i in range(len(batch)):
                one = batch.iloc[i : i + 1]
                try:
                    yield scored(one)
                except Exception as error:
                    text = f"{type(error).__name__}: {error}"[: fixed.ERROR_CHARS]
                    yield one.assign(raw_content=None, tokens_used=0, model=None, error=text)[names]

    return requests.select(*SNAPSHOT_KEY, "request").mapInPandas(send, RESPONSES)
