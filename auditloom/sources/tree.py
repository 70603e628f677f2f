"""Source trees on a file system all executors can read: `<root>/<owner>/<name>/<commit>/...`.

Spark's own file sources skip names that start with `_`, and with them every `__init__.py`.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom import fixed
from auditloom.functions.paths import is_scanned
from auditloom.functions.text import decode_source
from auditloom.schemas import FILE_KEY, SNAPSHOT_KEY, SOURCE_FILES
from auditloom.session import cut

#: `abs_path` is in the file system's own bytes; null where the file must not or cannot be read.
LISTING = (
    "repo string, commit_sha string, file_path string, abs_path binary, size_bytes long, error string"
)
_BATCH_BYTES = 16 * 1024 * 1024


def _folders(path: bytes) -> list[bytes]:
    with os.scandir(path) as entries:
        return sorted(e.name for e in entries if e.is_dir(follow_symlinks=False))


def _text(name: bytes) -> str:
    return name.decode("utf-8", "replace")


def _tops(owners: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The files and folders at the top of each snapshot of each owner."""
    for batch in owners:
        for owner in batch.column(0).to_pylist():
            for name in _folders(owner):
                for commit in _folders(os.path.join(owner, name)):
                    base = os.path.join(owner, name, commit)
                    tops = sorted(t for t in os.listdir(base) if _text(t) not in fixed.IGNORED_DIRS)
                    repo = f"{_text(os.path.basename(owner))}/{_text(name)}"
                    yield pa.RecordBatch.from_pydict({
                        "repo": pa.array([repo] * len(tops), pa.string()),
                        "commit_sha": pa.array([_text(commit)] * len(tops), pa.string()),
                        "base": pa.array([base] * len(tops), pa.binary()),
                        "top": pa.array(tops, pa.binary()),
                    })


def _files(top: bytes) -> Iterator[bytes]:
    if os.path.islink(top) or not os.path.isdir(top):
        yield top
        return
    for folder, folders, names in os.walk(top):
        folders[:] = [f for f in folders if _text(f) not in fixed.IGNORED_DIRS]
        for name in names:
            yield os.path.join(folder, name)


def _described(path: bytes, base: bytes) -> tuple[bytes | None, int, str | None]:
    """Path to read, size and error. A link is followed only to a file of its own snapshot."""
    try:
        found = os.lstat(path)
        if stat.S_ISLNK(found.st_mode):
            real, home = os.path.realpath(path), os.path.realpath(base)
            if os.path.commonpath([real, home]) != home:
                return None, 0, "link leaves the snapshot"
            found = os.stat(real)
        if not stat.S_ISREG(found.st_mode):
            return None, 0, "not a file"
        return path, found.st_size, None
    except OSError as error:
        return None, 0, error.strerror or type(error).__name__


def _walk(tops: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tops:
        for repo, commit, base, top in zip(*(c.to_pylist() for c in batch.columns)):
            rows = []
            for path in _files(os.path.join(base, top)):
                name = _text(os.path.relpath(path, base)).replace(os.sep, "/")
                rows.append((repo, commit, name, *_described(path, base)))
            kinds = (pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)],
                ["repo", "commit_sha", "file_path", "abs_path", "size_bytes", "error"],
            )


def list_files(spark: SparkSession, root: str, tasks: int = 1000) -> DataFrame:
    """All files below `root` outside ignored folders, with size or error.

    The driver lists the owners only. Snapshots' top-level entries are then dealt to `tasks` tasks, so
    a large snapshot is walked by many.
    """
    path = os.fsencode(root)
    owners = spark.createDataFrame([(os.path.join(path, o),) for o in _folders(path)], "owner binary")
    tops = owners.repartition(tasks, "owner").mapInArrow(
        _tops, "repo string, commit_sha string, base binary, top binary"
    )
    return tops.repartition(tasks, "base", "top").mapInArrow(_walk, LISTING)


def list_tree(spark: SparkSession, root: str, tasks: int = 1000) -> DataFrame:
    """Files to audit below `root`."""
    return list_files(spark, root, tasks).filter(is_scanned(F.col("file_path")))


def snapshot_bytes(listing: DataFrame) -> DataFrame:
    """`size_bytes` of each whole snapshot, from a listing of all its files."""
    return listing.groupBy(*SNAPSHOT_KEY).agg(F.sum("size_bytes").alias("size_bytes"))


def read_contents(listing: DataFrame, partitions: int | None = None) -> DataFrame:
    """Add the bytes of each listed file; null for one that cannot be read, which an audit counts.

    Paths are spread over tasks by hash, so a large snapshot is read by many. Each file is read once:
    the result is a written copy.
    """
    count = partitions or 4 * listing.sparkSession.sparkContext.defaultParallelism
    names = SOURCE_FILES.names

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            held = 0
            for row in batch.to_pylist():
                row["content"] = None
                try:
                    if row["abs_path"] is not None:
                        with open(row["abs_path"], "rb") as file:
                            row["content"] = file.read()
                except OSError:
                    pass
                rows.append({n: row[n] for n in names})
                held += len(row["content"] or b"")
                if held > _BATCH_BYTES:
                    yield _arrow(rows)
                    rows, held = [], 0
            if rows:
                yield _arrow(rows)

    placed = listing.repartition(count, *FILE_KEY)
    return cut(placed.mapInArrow(load, SOURCE_FILES))


def _arrow(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"content": pa.binary(), "size_bytes": pa.int64()}
    return pa.RecordBatch.from_pylist(
        rows, pa.schema([(n, kinds.get(n, pa.string())) for n in SOURCE_FILES.names])
    )


def decoded(files: DataFrame) -> DataFrame:
    """Source files with text in `content`."""
    return files.withColumn("content", decode_source(F.col("content")))


def scanned(files: DataFrame) -> DataFrame:
    """Of all files of a table, those to audit."""
    return files.filter(is_scanned(F.col("file_path")))


def targeted(files: DataFrame, targets: DataFrame) -> DataFrame:
    """Python files named in `targets` (file key), ignored folders included."""
    wanted = files.filter(F.col("file_path").endswith(fixed.SOURCE_SUFFIX))
    return wanted.join(targets.select(*FILE_KEY), FILE_KEY, "left_semi")
