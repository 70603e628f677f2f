"""Findings of all analyzers: union, dedup, counts, stored form."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom import fixed
from auditloom.functions.slots import marked
from auditloom.functions.text import severity_rank, truncate
from auditloom.schemas import FINDING_BODY, SNAPSHOT_KEY, STORED_FINDINGS
from auditloom.sources import commits

#: Folders of the findings table, and files that a job writes before its rows are dealt by folder first.
PARTS = 256
FILES = 4 * PARTS
_DEDUP_KEY = ["file_path", "line_start", "rule_id"]


def union_findings(parts: Sequence[DataFrame]) -> DataFrame:
    """All findings of all analyzers, duplicates included."""
    return reduce(DataFrame.unionByName, parts)


def _best_first() -> list[Column]:
    return [severity_rank(F.col("severity")).alias("_rank"), F.col("source_rank"), F.col("seq")]


def dedup(findings: DataFrame, run_key: Sequence[str] = SNAPSHOT_KEY) -> DataFrame:
    """One finding per run, file, line and rule: the most severe, on a tie the first seen.

    The filter on the first row lets Spark drop all but one row of a key in each map task, so
    many copies of one key never meet in one reducer.
    """
    window = Window.partitionBy(*run_key, *_DEDUP_KEY).orderBy(*_best_first())
    ranked = findings.withColumn("_place", F.row_number().over(window))
    return ranked.filter(F.col("_place") == 1).drop("_place")


def dedup_in_order(findings: DataFrame, run_key: Sequence[str] = SNAPSHOT_KEY) -> DataFrame:
    """`dedup` with the place of the first sighting in `first_rank` and `first_seq`.

    A key's place in the output is that of its first finding, also when a later one is kept.
    """
    key = [*run_key, *_DEDUP_KEY]
    payload = [c for c in findings.columns if c not in {*key, "source_rank", "seq"}]
    best = findings.groupBy(*key).agg(
        F.min(F.struct(*_best_first(), *payload)).alias("best"),
        F.min(F.struct("source_rank", "seq")).alias("first"),
    )
    return best.select(
        *key,
        "best.source_rank", "best.seq", *[f"best.{c}" for c in payload],
        F.col("first.source_rank").alias("first_rank"),
        F.col("first.seq").alias("first_seq"),
    )


def severity_counts() -> list[Column]:
    return [
        F.count("*").alias("total_findings"),
        F.count_if(F.col("severity") == "critical").alias("critical_count"),
        F.count_if(F.col("severity") == "high").alias("high_count"),
    ]


def run_counts(kept: DataFrame, run_key: Sequence[str] = SNAPSHOT_KEY) -> DataFrame:
    """Total, critical and high findings per run, after dedup."""
    return kept.groupBy(*run_key).agg(*severity_counts())


def counts_of_raw(findings: DataFrame, run_key: Sequence[str] = SNAPSHOT_KEY) -> DataFrame:
    """All counts per run from raw findings, in one pass.

    The severity that dedup keeps is the least rank of a key, so no finding's text is moved: a
    hash aggregate per key, then one per run.
    """
    is_review = F.col("analyzer") == "review"
    keys = findings.groupBy(*run_key, *_DEDUP_KEY).agg(
        F.min(severity_rank(F.col("severity"))).alias("rank"),
        F.count_if(~is_review).alias("static"),
        F.count_if(is_review).alias("review"),
    )
    return keys.groupBy(*run_key).agg(
        F.count("*").alias("total_findings"),
        F.count_if(F.col("rank") == 0).alias("critical_count"),
        F.count_if(F.col("rank") == 1).alias("high_count"),
        F.sum("static").alias("static_count"),
        F.sum("review").alias("review_count"),
    )


def analyzer_counts(findings: DataFrame, run_key: Sequence[str] = SNAPSHOT_KEY) -> DataFrame:
    """Static and review findings per run, before dedup."""
    is_review = F.col("analyzer") == "review"
    return findings.groupBy(*run_key).agg(
        F.count_if(~is_review).alias("static_count"),
        F.count_if(is_review).alias("review_count"),
    )


def most_files(analyzed: DataFrame, run_key: Sequence[str] = SNAPSHOT_KEY) -> DataFrame:
    """Files analyzed per run: the most that any analyzer reports, not their sum."""
    return analyzed.groupBy(*run_key).agg(F.max("files_analyzed").alias("files_analyzed"))


def duration_seconds(start: Column, end: Column) -> Column:
    """Seconds between two timestamps, with two decimals."""
    micros = F.unix_micros(end) - F.unix_micros(start)
    return F.round(micros / F.lit(1_000_000.0), 2)


def finding_id(*key: str) -> Column:
    """The same key always gives the same id, so a repeated write can be told apart."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def stored_form(kept: DataFrame, run_key: Sequence[str] = ("analysis_id",)) -> DataFrame:
    """Rows of the findings table: title and path cut to the column width."""
    body = {c: F.col(c) for c in FINDING_BODY.names}
    body["title"] = truncate(body["title"], fixed.TITLE_CHARS)
    body["file_path"] = truncate(body["file_path"], fixed.PATH_CHARS)
    visible = F.col("is_false_positive") if "is_false_positive" in kept.columns else F.lit(False)
    return kept.select(
        finding_id(*run_key, *_DEDUP_KEY).alias("id"),
        *run_key,
        *[c.alias(n) for n, c in body.items()],
        visible.alias("is_false_positive"),
    )


#: The findings table as it is stored: folders by a hash of the run's id.
_PLACED = T.StructType([*STORED_FINDINGS.fields, T.StructField("part", T.IntegerType())])


def _folder(run: str = "analysis_id") -> Column:
    """The folder of a run's rows."""
    return F.pmod(F.crc32(F.col(run).cast("binary")), F.lit(PARTS)).cast("int")


def dealt_by_folder(findings: DataFrame, run_key: Sequence[str] = ("analysis_id",)) -> DataFrame:
    """Findings with their folder as `part`, shuffled so that a task has few folders and few tasks a folder.

    `dedup` by `part` and `run_key` follows without another shuffle, and rows that are appended then go to
    few files. Tasks are cut by the whole key of a finding, so one large run is dealt to many.
    """
    return findings.withColumn("part", _folder(run_key[0])).repartitionByRange("part", *run_key, *_DEDUP_KEY)


def _without(rows: DataFrame, known: DataFrame, by: str | None = None, deal_all: bool = False) -> DataFrame:
    """The `rows` whose id is not in `known` (one column, `id`); only rows that may be there are shuffled.

    Those, or with `deal_all` all rows, are dealt `by` a column afterwards.
    """
    split = marked(rows, known, "id")
    new = split.filter("NOT _met").drop("_met")
    others = split.filter("_met").drop("_met").join(known, "id", "left_anti")
    if by is not None:
        others = others.hint("rebalance", by)
        new = new.hint("rebalance", by) if deal_all else new
    return new.unionByName(others)


def append_findings(stored: DataFrame, path: str, job: str | None = None) -> bool:
    """Commit a job's rows to the table at `path`; whether this call did.

    Readers (`read_findings`) see all rows of a job or none. A job that was committed before adds nothing,
    and rows that another job has committed are told by their id and not added twice. A run's rows always
    go to the same of `PARTS` folders, so only the folders of the job's runs are read. Without a name
    a job is one of its own.
    """
    spark = stored.sparkSession
    if job is not None and commits.is_committed(spark, path, job):
        return False
    placed = stored.select(*STORED_FINDINGS.names, _folder().alias("part"))
    tasks = placed.select("part", F.spark_partition_id().alias("task")).distinct().groupBy("part").count().collect()
    known = commits.committed(spark, path, _PLACED).filter(F.col("part").isin([r["part"] for r in tasks]))  # at most PARTS
    many = sum(r["count"] for r in tasks) > FILES  # as each task writes a file in each folder
    fresh = _without(placed, known.select("id"), "part", many)
    return commits.commit(fresh, path, job or uuid.uuid4().hex, ["part"])


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """The committed rows of the findings table at `path`."""
    return commits.committed(spark, path, _PLACED).select(*STORED_FINDINGS.names)


def compact_findings(spark: SparkSession, path: str) -> int:
    """Merge the committed jobs' files, one file per folder; how many jobs there were."""
    return commits.compact(spark, path, _PLACED, ["part"])
