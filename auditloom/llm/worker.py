"""What Python workers need: small batches, and state that outlives a task."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import SparkSession

from auditloom.session import configure

#: Rows of a batch that goes to Python; a bound of memory, results do not depend on it.
BATCH_ROWS = 2000

_HOLDER = "auditloom_worker_state"
_RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ready(spark: SparkSession) -> SparkSession:
    """The engine's settings, with batches small enough for whole documents and their arrays."""
    configure(spark).conf.set(_RECORDS, BATCH_ROWS)
    return spark


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of at most `rows` rows for what runs inside, where rows are large."""
    before = spark.conf.get(_RECORDS)
    spark.conf.set(_RECORDS, rows)
    try:
        yield
    finally:
        spark.conf.set(_RECORDS, before)


def kept(name: str, make):
    """What `make()` returned when this Python process first asked for `name`.

    Functions travel by value, so globals of a module start anew with each task; this does not.
    """
    holder = sys.modules.setdefault(_HOLDER, types.ModuleType(_HOLDER)).__dict__
    if name not in holder:
        holder[name] = make()
    return holder[name]


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def given_back(run: Run) -> Run:
    """`run`, a function for `mapInArrow`; memory that it no longer uses goes back when its task ends.

    A worker serves many tasks. Else it holds the most that any of them needed, beside the executor's heap.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
        if trim is not None:
            trim(0)

    return whole
