"""Analyzers as plug-ins: any function from source files to findings."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from auditloom import fixed
from auditloom.operators.facts import extract_facts
from auditloom.operators.findings import union_findings
from auditloom.operators.rules import STATIC_ANALYZER, rule_findings
from auditloom.operators.secrets import SECRET_ANALYZER, secret_findings
from auditloom.schemas import FILE_KEY, FINDING_BODY, FINDINGS, SNAPSHOT_KEY

Analyze = Callable[[DataFrame], DataFrame]
FindInFile = Callable[[str, str], Iterable[dict[str, Any]]]

#: Findings and, in the same table, what failed: `error` is null for a finding.
TAGGED = T.StructType([
    *FINDINGS.fields, T.StructField("phase", T.StringType()), T.StructField("error", T.StringType()),
])
_TAGGED_ARROW = to_arrow_schema(TAGGED)
_BODY_ARROW = to_arrow_schema(FINDING_BODY)


@dataclass(frozen=True)
class Analyzer:
    """A name and a function; findings of equal severity keep the order of analyzers."""

    name: str
    analyze: Analyze


def python_analyzer(
    max_lines: int = fixed.MAX_FUNCTION_LINES, max_complexity: int = fixed.MAX_COMPLEXITY,
) -> Analyzer:
    """The eight syntax rules with their thresholds."""
    return Analyzer(
        STATIC_ANALYZER, lambda files: rule_findings(extract_facts(files), max_lines, max_complexity)
    )


def default_analyzers() -> list[Analyzer]:
    return [python_analyzer(), Analyzer(SECRET_ANALYZER, secret_findings)]


def file_analyzer(name: str, find: FindInFile) -> Analyzer:
    """An analyzer from a function of one file's path and text that gives findings as dictionaries.

    It runs where the files are, batch by batch. A file that it raises on becomes an error row;
    what it found in the others stays.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file in batch.to_pylist():
                key = {c: file[c] for c in FILE_KEY}
                try:
                    found = [{c: one.get(c) for c in FINDING_BODY.names} for one in find(file["file_path"], file["content"])]
                    part = [{**key, **{k: v for k, v in one.items() if k != "file_path"}} for one in found]
                    pa.Table.from_pylist(part, schema=_BODY_ARROW)  # a value of a wrong type is this file's error
                except Exception as error:
                    part = [{**key, "phase": "file", "error": f"{type(error).__name__}: {error}"}]
                rows += [{"analyzer": name, "source_rank": 0, "seq": i, **one} for i, one in enumerate(part)]
            yield pa.RecordBatch.from_pylist(rows, schema=_TAGGED_ARROW)

    return Analyzer(name, lambda files: files.select(*FILE_KEY, "content").mapInArrow(run, TAGGED))


def check_schema(findings: DataFrame, name: str) -> DataFrame:
    """The findings columns in order, then `phase` and `error`; an error that names what an analyzer got wrong."""
    given = {f.name: f.dataType for f in findings.schema.fields}
    wrong = [f.name for f in FINDINGS.fields if given.get(f.name) != f.dataType]
    if wrong:
        raise TypeError(f"analyzer {name}: missing or mistyped columns {wrong}")
    return (findings if "error" in given else without_errors(findings)).select(*TAGGED.names)


def without_errors(findings: DataFrame) -> DataFrame:
    """Findings with the columns of the error channel, empty."""
    none = F.lit(None).cast("string")
    return findings.select(*FINDINGS.names, none.alias("phase"), none.alias("error"))


def analyze(files: DataFrame, analyzers: list[Analyzer]) -> DataFrame:
    """What all analyzers give: findings, and an error row for each thing that failed (`TAGGED`).

    An analyzer that fails to build its plan has one error row per snapshot (phase `plan`) and no
    findings; one that fails on a file has a row for the file (phase `file`). The others are not touched.
    """
    snapshots = files.select(*SNAPSHOT_KEY).distinct()
    parts = []
    for rank, analyzer in enumerate(analyzers):
        try:
            found = check_schema(analyzer.analyze(files), analyzer.name)
        except Exception as error:
            given = {
                "analyzer": F.lit(analyzer.name), "seq": F.lit(0).cast("long"), "phase": F.lit("plan"),
                "error": F.lit(f"{type(error).__name__}: {error}"), **{c: F.col(c) for c in SNAPSHOT_KEY},
            }
            found = snapshots.select(*(
                given.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in TAGGED.fields
            ))
        parts.append(found.withColumn("source_rank", F.lit(rank)))
    if not parts:
        return files.sparkSession.createDataFrame([], TAGGED)
    return union_findings(parts)


def findings_of(analyzed: DataFrame) -> DataFrame:
    return analyzed.filter("error IS NULL").select(*FINDINGS.names)


def errors_of(analyzed: DataFrame) -> DataFrame:
    """`repo, commit_sha, file_path, analyzer, source_rank, phase, error`; no path if all files are concerned."""
    return analyzed.filter("error IS NOT NULL").select(*FILE_KEY, "analyzer", "source_rank", "phase", "error")


def run_analyzers(files: DataFrame, analyzers: list[Analyzer]) -> DataFrame:
    """Findings of all analyzers; `analyze` gives the errors as well."""
    return findings_of(analyze(files, analyzers))
