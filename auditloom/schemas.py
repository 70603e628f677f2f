"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

from auditloom import fixed

_S, _I, _L, _B, _TS = (
    T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.TimestampType(),
)


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


SNAPSHOT_KEY = ["repo", "commit_sha"]
FILE_KEY = [*SNAPSHOT_KEY, "file_path"]

SOURCE_FILES = _table(
    ("repo", _S), ("commit_sha", _S), ("file_path", _S),
    ("content", T.BinaryType()), ("size_bytes", _L),
)

FACTS = _table(
    ("repo", _S), ("commit_sha", _S), ("file_path", _S),
    ("kind", _S), ("seq", _L), ("line", _I), ("end_line", _I),
    ("name", _S), ("fn_name", _S), ("module", _S),
    ("is_bare", _B), ("has_doc", _B),
    ("missing_params", T.ArrayType(_S)), ("has_return", _B),
    ("complexity", _I), ("arg0_kind", _S), ("parse_status", _S),
)

FINDING_BODY = _table(
    ("category", _S), ("severity", _S), ("title", _S), ("description", _S),
    ("file_path", _S), ("line_start", _I), ("line_end", _I),
    ("rule_id", _S), ("recommendation", _S),
)
FINDINGS = T.StructType(
    _table(
        ("repo", _S), ("commit_sha", _S), ("analyzer", _S), ("source_rank", _I), ("seq", _L),
    ).fields
    + FINDING_BODY.fields
)

USERS = _table(("id", _S), ("email", _S), ("is_active", _B), ("is_superuser", _B))
REPOSITORIES = _table(
    ("id", _S), ("owner_id", _S), ("github_url", _S), ("full_name", _S),
    ("default_branch", _S), ("is_active", _B), ("created_at", _TS),
)
ANALYSES = _table(
    ("id", _S), ("repository_id", _S), ("commit_sha", _S), ("status", _S),
    ("triggered_by", _S), ("created_at", _TS), ("started_at", _TS), ("completed_at", _TS),
    ("duration_seconds", T.DoubleType()), ("total_findings", _I), ("critical_count", _I),
    ("high_count", _I), ("error_message", _S),
)
ANALYSIS_EVENTS = _table(
    ("analysis_id", _S), ("repository_id", _S), ("commit_sha", _S), ("triggered_by", _S),
    ("status", _S), ("event_ts", _TS), ("error_message", _S),
)
CLAIMS = _table(
    ("analysis_id", _S), ("repository_id", _S), ("commit_sha", _S), ("claimed_at", _TS),
)
STORED_FINDINGS = T.StructType(
    _table(("id", _S), ("analysis_id", _S)).fields
    + FINDING_BODY.fields
    + _table(("is_false_positive", _B)).fields
)
WEBHOOKS = _table(
    ("event_id", _L), ("body", T.BinaryType()), ("event", _S), ("signature", _S),
    ("received_at", _TS),
)
REQUEST_LOG = _table(
    ("event_id", _L), ("route", _S), ("method", _S), ("path", _S), ("client_ip", _S),
    ("ts", _TS),
)

SEVERITY_RANK = {name: rank for rank, name in enumerate(fixed.SEVERITIES)}
STATUS_RANK = {name: rank for rank, name in enumerate(fixed.STATUSES)}
