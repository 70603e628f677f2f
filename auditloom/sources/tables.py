"""The entity tables, read with their declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditloom import schemas

TABLES = {
    "source_files": schemas.SOURCE_FILES,
    "users": schemas.USERS,
    "repositories": schemas.REPOSITORIES,
    "analyses": schemas.ANALYSES,
    "analysis_events": schemas.ANALYSIS_EVENTS,
    "findings": schemas.STORED_FINDINGS,
    "webhooks": schemas.WEBHOOKS,
    "api_requests": schemas.REQUEST_LOG,
}


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def stream_table(spark: SparkSession, root: str, name: str, files_per_batch: int = 100) -> DataFrame:
    """The same table as a stream of its new files; a batch takes a bounded number of them."""
    reader = spark.readStream.schema(TABLES[name]).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{root}/{name}")
