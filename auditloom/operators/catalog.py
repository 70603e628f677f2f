"""Users, repositories, analyses and findings: registration, lookups, listings, lifecycle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom import fixed
from auditloom.functions.paths import full_name, is_repository_url, normalize_url
from auditloom.functions.text import severity_rank, truncate
from auditloom.operators.ordering import PIECE_ROWS, number_rows
from auditloom.schemas import FINDING_BODY

REPOSITORY_FIELDS = [
    "id", "github_url", "full_name", "default_branch", "is_active", "created_at",
]
ANALYSIS_FIELDS = [
    "id", "repository_id", "commit_sha", "status", "triggered_by", "started_at", "completed_at",
    "duration_seconds", "total_findings", "critical_count", "high_count", "error_message",
    "created_at",
]
FINDING_FIELDS = ["id", *FINDING_BODY.names, "is_false_positive"]


def public(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The columns a caller may see."""
    return df.select(*fields)


# Lookups -------------------------------------------------------------------------

def lookup(df: DataFrame, column: str, value: object) -> DataFrame:
    """Row with this id, email or URL; empty when there is none."""
    return df.filter(F.col(column) == value)


def lookup_all(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Each wanted key with its row; the row's columns are null when there is none."""
    return keys.select(column).distinct().join(df, column, "left")


def exists_all(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Each wanted key and whether the table holds it."""
    known = df.select(column).distinct().withColumn("found", F.lit(True))
    wanted = keys.select(column).distinct()
    return wanted.join(known, column, "left").fillna(False, ["found"])


def active_repositories(repositories: DataFrame) -> DataFrame:
    return repositories.filter("is_active")


def newest_first(created: str = "created_at", key: str = "id") -> list[Column]:
    """An order, latest first; rows without a time come last."""
    back = -F.unix_micros(F.col(created).cast("timestamp"))
    return [F.coalesce(back, F.lit(2**63 - 1)), F.col(key)]


def visible_analyses(analyses: DataFrame, repositories: DataFrame) -> DataFrame:
    """Analyses with the `owner_id` that may read them."""
    owners = repositories.select(F.col("id").alias("repository_id"), "owner_id", "full_name")
    return analyses.join(owners, "repository_id")


# Findings of a run ---------------------------------------------------------------

def visible_findings(findings: DataFrame) -> DataFrame:
    return findings.filter(~F.col("is_false_positive"))


def report_order() -> list[Column]:
    """An order: most severe first, then by place in the source, findings without a line first."""
    return [
        severity_rank(F.col("severity")), F.col("file_path"),
        F.col("line_start"), F.col("rule_id"),
    ]


def prioritized_report(
    kept: DataFrame,
    run_key: Sequence[str] = ("analysis_id",),
    sized_by: DataFrame | None = None,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Visible findings of deduplicated runs with their `position` in the report."""
    return number_rows(
        visible_findings(kept), run_key, report_order(),
        sized_by=sized_by, piece_rows=piece_rows,
    )


def analysis_details(analyses: DataFrame, report: DataFrame) -> DataFrame:
    """Each analysis with its reported findings, one row per finding.

    A run without findings gives one row with null finding columns. Rows stay flat: a nested
    list would gather a large run in one row. The inner join lets a run with very many findings
    be split over tasks; runs without any are added from the distinct run ids.
    """
    with_any = report.select("analysis_id").distinct()
    found = report.join(
        analyses.withColumnRenamed("id", "analysis_id"), "analysis_id"
    )
    none = analyses.withColumnRenamed("id", "analysis_id").join(
        with_any, "analysis_id", "left_anti"
    )
    return found.unionByName(none, allowMissingColumns=True)


# Registration --------------------------------------------------------------------

def register_repositories(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """Decide registrations: registered, already_registered or invalid_url.

    `requests` has request_id, owner_id, url and requested_at. A URL belongs to its first
    request. Each URL is reduced to one row before any join, and losers are found by their own
    request id, so one URL with very many requests meets no other row more than once.
    """
    checked = requests.withColumn("github_url", normalize_url(F.col("url"))).withColumn(
        "_ok", is_repository_url(F.col("github_url"))
    )
    winners = (
        checked.filter("_ok").groupBy("github_url")
        .agg(F.min(F.struct("requested_at", "request_id")).alias("w"))
        .join(existing.select("github_url").distinct(), "github_url", "left_anti")
        .select(F.col("w.request_id").alias("request_id"), F.lit(True).alias("_won"))
    )
    return checked.join(winners, "request_id", "left").select(
        "request_id", "owner_id", "github_url",
        F.when(F.col("_ok"), full_name(F.col("github_url"))).alias("full_name"),
        "requested_at",
        F.when(~F.col("_ok"), "invalid_url")
        .when(F.col("_won"), "registered")
        .otherwise("already_registered").alias("outcome"),
    )


def new_repositories(decided: DataFrame) -> DataFrame:
    """Rows to append to the repositories table."""
    return decided.filter(F.col("outcome") == "registered").select(
        F.sha2("github_url", 256).alias("id"), "owner_id", "github_url", "full_name",
        F.lit(fixed.DEFAULT_BRANCH).alias("default_branch"),
        F.lit(True).alias("is_active"),
        F.col("requested_at").alias("created_at"),
    )


def first_of_key(rows: DataFrame, key: str, order: Sequence[str], existing: DataFrame) -> DataFrame:
    """The first row of each key that the table does not hold: unique emails, unique URLs."""
    rest = [c for c in rows.columns if c not in {key, *order}]
    first = rows.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("r"))
    return first.join(existing.select(key).distinct(), key, "left_anti").select(key, "r.*")


# Requests for a run --------------------------------------------------------------

def requested_commit(commit: Column) -> Column:
    """Struct of the ref to audit and whether the given commit is acceptable."""
    ok = commit.isNull() | commit.rlike(fixed.COMMIT_PATTERN)
    ref = F.coalesce(F.nullif(commit, F.lit("")), F.lit(fixed.DEFAULT_REF))
    return F.struct(F.when(ok, ref).alias("ref"), ok.alias("is_valid"))


def resolve_commits(requests: DataFrame, refs: DataFrame, repositories: DataFrame) -> DataFrame:
    """Add `resolved_sha`: HEAD means the default branch, a full SHA stands for itself.

    Null where the ref is unknown; such a run fails.
    """
    branch = repositories.select(F.col("id").alias("repository_id"), "default_branch")
    wanted = F.when(F.col("ref") == fixed.DEFAULT_REF, F.col("default_branch")).otherwise(
        F.col("ref")
    )
    known = refs.select(
        "repository_id", F.col("ref").alias("_ref"), F.col("sha").alias("_sha")
    )
    named = requests.join(branch, "repository_id", "left").withColumn("_ref", wanted)
    return named.join(known, ["repository_id", "_ref"], "left").select(
        *requests.columns,
        F.when(F.col("_ref").rlike(fixed.FULL_SHA_PATTERN), F.lower("_ref"))
        .otherwise(F.col("_sha")).alias("resolved_sha"),
    )


def fresh_results(analyses: DataFrame, as_of: Column,
                  seconds: int = fixed.REUSE_SECONDS) -> DataFrame:
    """Repository and commit pairs with a completed run of the last `seconds`."""
    age = F.unix_micros(as_of) - F.unix_micros("completed_at")
    return analyses.filter(
        (F.col("status") == "completed") & (age >= 0) & (age < seconds * 1_000_000)
    ).select("repository_id", "commit_sha").distinct()


def split_by_reuse(requests: DataFrame, fresh: DataFrame) -> DataFrame:
    """Add `decision`: reuse a fresh result or run."""
    marked = fresh.withColumn("_fresh", F.lit(True))
    return requests.join(marked, ["repository_id", "commit_sha"], "left").select(
        *requests.columns,
        F.when(F.col("_fresh"), "reuse").otherwise("run").alias("decision"),
    )


def guard_size(files: DataFrame, limit_bytes: int = fixed.MAX_SNAPSHOT_BYTES) -> DataFrame:
    """Size of every snapshot and whether it may run; an unknown size passes."""
    sizes = files.groupBy("repo", "commit_sha").agg(F.sum("size_bytes").alias("total_bytes"))
    return sizes.withColumn(
        "is_too_large", F.coalesce(F.col("total_bytes") > limit_bytes, F.lit(False))
    )


# Lifecycle -----------------------------------------------------------------------

def created_events(requests: DataFrame) -> DataFrame:
    """First event of each new run: pending."""
    return requests.select(
        "analysis_id", "repository_id", "commit_sha", "triggered_by",
        F.lit("pending").alias("status"),
        F.col("created_at").alias("event_ts"),
        F.lit(None).cast("string").alias("error_message"),
    )


def terminal_status(error: Column, finding_count: Column) -> Column:
    """A run fails when it has an error and no findings."""
    return F.when(error.isNotNull() & (finding_count == 0), "failed").otherwise("completed")


def check_updates(updates: DataFrame, known: DataFrame) -> DataFrame:
    """Status updates with `is_known`: an update for an unknown run is an error."""
    ids = known.select("analysis_id").distinct().withColumn("is_known", F.lit(True))
    return updates.join(ids, "analysis_id", "left").fillna(False, ["is_known"])


def run_state(events: DataFrame) -> DataFrame:
    """Latest state of every run, from its events in any order."""
    rank = F.array_position(F.array(*map(F.lit, fixed.STATUSES)), F.col("status"))
    done = F.col("status").isin("completed", "failed", "timeout")
    latest = F.max(F.struct("event_ts", rank.alias("rank"), "status", "error_message"))
    started = F.min(F.when(F.col("status") == "running", F.col("event_ts")))
    return events.groupBy("analysis_id").agg(
        latest.alias("last"),
        F.min(F.when(F.col("status") == "pending", F.col("event_ts"))).alias("created_at"),
        started.alias("started_at"),
        F.max(F.when(done, F.col("event_ts"))).alias("completed_at"),
    ).select(
        "analysis_id", F.col("last.status").alias("status"),
        "created_at", "started_at", "completed_at",
        truncate(F.col("last.error_message"), fixed.ERROR_CHARS).alias("error_message"),
    )


def run_steps(
    events: DataFrame, as_of: Column, limit_seconds: int = fixed.RUN_SECONDS,
) -> DataFrame:
    """Every distinct event up to `as_of` with `accepted`, and a `timeout` for each overdue run.

    Steps count in order of time, ties in order of status. A run becomes pending, then running, then ends;
    a pending one may fail at once (`fixed.NEXT_STATUSES`). Any other step is refused and changes
    nothing. A run that has not ended `limit_seconds` after its start times out then, and what comes
    later is refused. Events without a time, a run or a known status do not take part. One
    shuffle by run; `streaming.lifecycle` gives the same rows on a stream.
    """
    known = F.array(*map(F.lit, fixed.STATUSES))
    order = F.struct("event_ts", F.array_position(known, F.col("status")).alias("rank"), "error_message")
    steps = (
        events.select("analysis_id", "status", F.col("event_ts").cast("timestamp").alias("event_ts"), "error_message")
        .filter("analysis_id IS NOT NULL").filter(F.col("event_ts") <= as_of).distinct()
        .withColumn("at", order).filter("at.rank > 0")
    )
    run = Window.partitionBy("analysis_id")

    def first(test: str) -> Column:
        return F.min(F.when(F.expr(test), F.col("at"))).over(run)

    limit = F.make_dt_interval(secs=F.lit(limit_seconds))
    overdue = F.expr("deadline IS NOT NULL AND (ended IS NULL OR ended.event_ts > deadline)")
    met = (
        steps.withColumn("created", first("status = 'pending'"))
        .withColumns({
            "started": first("at > created AND status = 'running'"),
            "broken": first("at > created AND status = 'failed'"),
        })
        .withColumn("started", F.expr("CASE WHEN broken IS NULL OR started < broken THEN started END"))
        .withColumn("ended", first("at > started AND status IN ('completed', 'failed', 'timeout')"))
        .withColumn("ended", F.expr("CASE WHEN started IS NULL THEN broken ELSE ended END"))
        .withColumn("deadline", F.col("started.event_ts") + limit)
        .withColumn("deadline", F.when(F.col("deadline") <= as_of, F.col("deadline")))
        .withColumn("overdue", overdue)
    )
    accepted = F.expr(
        "at = created OR coalesce(at = started, false) OR coalesce(NOT overdue AND at = ended, false)"
    )
    own = F.struct("status", "event_ts", "error_message", F.coalesce(accepted, F.lit(False)).alias("accepted"))
    late = F.struct(
        F.lit("timeout").alias("status"), F.col("deadline").alias("event_ts"),
        F.lit(None).cast("string").alias("error_message"), F.lit(True).alias("accepted"),
    )
    rows = F.when(F.expr("overdue AND at = started"), F.array(own, late)).otherwise(F.array(own))
    return met.select("analysis_id", F.inline(rows))


def delete_users(
    doomed: DataFrame, users: DataFrame, repositories: DataFrame, analyses: DataFrame,
    findings: DataFrame,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What stays of the four tables after users (`id`) go with all that hangs on them."""
    gone_users = doomed.select(F.col("id").alias("owner_id")).distinct()
    gone_repositories = repositories.join(gone_users, "owner_id", "left_semi").select(
        F.col("id").alias("repository_id")
    )
    gone_analyses = analyses.join(gone_repositories, "repository_id", "left_semi").select(
        F.col("id").alias("analysis_id")
    )
    return (
        users.join(gone_users.withColumnRenamed("owner_id", "id"), "id", "left_anti"),
        repositories.join(gone_users, "owner_id", "left_anti"),
        analyses.join(gone_repositories, "repository_id", "left_anti"),
        findings.join(gone_analyses, "analysis_id", "left_anti"),
    )
