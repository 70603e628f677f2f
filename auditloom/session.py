"""Session settings and the lineage cut that survives lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

import auditloom

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # joins of facts to a keyed side rely on this to split a hot key over many tasks
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # whole files travel to Python: bound a batch by bytes, too
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
    # as in Python, the last of two equal JSON keys wins
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators need and send functions along with the tasks.

    All settings can change at run time, and executors need no installed copy of this package.
    """
    cloudpickle.register_pickle_by_value(auditloom)
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def _shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder; a temporary one, gone at the end, only where all is one process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="auditloom-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the checkpoint folder."""
    return f"{_shared_folder(spark)}/{name}-{uuid.uuid4()}"


def packed(writer: DataFrameWriter) -> DataFrameWriter:
    """A writer that packs hashes and texts to about half of what the default leaves; for large files."""
    return writer.option("compression", "zstd").option("parquet.compression.codec.zstd.level", 1)


def cut(df: DataFrame, dense: bool = False) -> DataFrame:
    """Write `df` as Parquet to the checkpoint folder now and go on from the written copy.

    Later readers read only the columns they use. `dense` is for copies of large columns.
    """
    path = scratch(df.sparkSession, "cut")
    (packed(df.write) if dense else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
