"""Appends as commits: a job's rows become visible with its manifest row, all at once.

A table is a folder with `staged`, one folder of rows per attempt, and `_log/manifest`, one small file per
published attempt. A reader takes the folders that the manifest names and no others, so an attempt that was
killed between files, or is still writing, shows nothing. Publishing writes a single file, which Spark
renames into place. Where a job was published twice, by a repeat that raced the first, one
attempt counts: the least by name. All goes through Spark's readers and writers, so any shared store will do.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.session import packed

MANIFEST = T.StructType([
    T.StructField("job", T.StringType()), T.StructField("part", T.StringType()),
    T.StructField("replaces", T.ArrayType(T.StringType())),
])

#: The name of a folder of rows without a value.
_NONE = "__HIVE_DEFAULT_PARTITION__"


def manifest(spark: SparkSession, table: str) -> DataFrame:
    """`job, part, replaces` of the attempts that count; none where nothing was published yet."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{table}/_log/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)
    first = rows.groupBy("job").agg(F.min_by(F.struct("part", "replaces"), "part").alias("r")).select("job", "r.*")
    gone = first.select(F.explode("replaces").alias("part"))
    return first.join(gone, "part", "left_anti").select(*MANIFEST.names)


def stage(rows: DataFrame, table: str, by: Sequence[str] = (), dense: bool = False) -> str:
    """Write rows where no reader looks, `dense` for few and large files; the name of the attempt."""
    part = uuid.uuid4().hex
    (packed(rows.write) if dense else rows.write).partitionBy(*by).parquet(f"{table}/staged/attempt={part}")
    return part


def publish(spark: SparkSession, table: str, job: str, part: str, replaces: Sequence[str] = ()) -> None:
    """Make a staged attempt visible, in place of those it `replaces`."""
    row = spark.createDataFrame([(job, part, list(replaces))], MANIFEST)
    row.coalesce(1).write.mode("append").parquet(f"{table}/_log/manifest")


def is_committed(spark: SparkSession, table: str, job: str) -> bool:
    """Whether an attempt of `job` counts; merged jobs are no longer known by name."""
    return manifest(spark, table).filter(F.col("job") == job).head() is not None


def commit(rows: DataFrame, table: str, job: str, by: Sequence[str] = ()) -> bool:
    """Append the rows of `job`, once however often it is repeated; whether this call did."""
    spark = rows.sparkSession
    if is_committed(spark, table, job):
        return False
    publish(spark, table, job, stage(rows, table, by))
    return True


def committed(spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
    """The published rows; `schema` includes the columns that folders are named by.

    The driver holds a name per job since the last `compact`.
    """
    parts = sorted(r["part"] for r in manifest(spark, table).select("part").collect())
    if not parts:
        return spark.createDataFrame([], schema)
    whole = T.StructType([*schema.fields, T.StructField("attempt", T.StringType())])
    reader = spark.read.schema(whole).option("basePath", f"{table}/staged")
    return reader.parquet(*(f"{table}/staged/attempt={p}" for p in parts)).drop("attempt")


def _folder_by_folder(rows: DataFrame, by: Sequence[str], folders: Sequence[Row] | None = None) -> DataFrame:
    """The rows of a table that is stored `by` these columns, each folder's in one partition, without a shuffle.

    With `folders`, rows of these only.
    """
    if folders is None:
        folders = rows.select(*by).distinct().collect()
    parts = [
        rows.filter(reduce(and_, (F.col(c).eqNullSafe(F.lit(f[c])) for c in by))).coalesce(1) for f in folders
    ]
    while len(parts) > 1:  # pairs, as a chain of unions is analysed anew with every link
        parts = [reduce(DataFrame.unionByName, parts[i : i + 2]) for i in range(0, len(parts), 2)]
    return parts[0] if parts else rows


def _escaped(value: str) -> str:
    """A folder's value as Spark reads it: ASCII signs by their numbers, letters of any script as they are."""
    return re.sub(r"[\x00-\x2C/\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]", lambda sign: f"%{ord(sign[0]):02X}", value)


def _stage_folders(rows: DataFrame, table: str, by: Sequence[str]) -> str:
    """Write rows of a table that is stored `by` these columns, each folder in one task, without shuffle and sort.

    A folder is a small job of its own, as one plan of all folders takes the driver longer than the rows take.
    """
    part, tasks = uuid.uuid4().hex, rows.sparkSession.sparkContext.defaultParallelism
    texts = [F.col(c).cast("string") for c in by]
    folders = rows.select(F.struct(*by).alias("values"), F.array(*texts).alias("texts")).distinct().collect()
    if not folders:
        return stage(rows, table, by)

    def write(folder: Row) -> None:
        own = _folder_by_folder(rows, by, [folder["values"]]).drop(*by)
        name = "/".join(f"{c}={_escaped(v) if v else _NONE}" for c, v in zip(by, folder["texts"]))
        packed(own.write).parquet(f"{table}/staged/attempt={part}/{name}")

    with ThreadPoolExecutor(min(tasks, 64)) as pool:
        list(pool.map(write, folders))
    return part


def compact(spark: SparkSession, table: str, schema: T.StructType, by: Sequence[str] = ()) -> int:
    """Rewrite all published attempts as one; how many there were.

    Readers see the old ones or the new one. Old folders stay for readers that began earlier. One
    compaction runs at a time; a repeated one of the same attempts counts once.
    """
    parts = sorted(r["part"] for r in manifest(spark, table).select("part").collect())
    if len(parts) > 1:
        rows = committed(spark, table, schema)
        job = "compact " + hashlib.sha256(" ".join(parts).encode()).hexdigest()
        publish(spark, table, job, _stage_folders(rows, table, by) if by else stage(rows, table, dense=True), parts)
    return len(parts)
