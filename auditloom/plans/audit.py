"""The whole audit of many runs as one job, and the incremental form of it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom import fixed
from auditloom.functions.text import truncate
from auditloom.operators import catalog, findings, responses, rules
from auditloom.operators.analyzers import Analyzer, analyze, errors_of, findings_of, without_errors
from auditloom.operators.facts import extract_facts
from auditloom.operators.secrets import SECRET_ANALYZER, secret_findings
from auditloom.schemas import FILE_KEY, SNAPSHOT_KEY
from auditloom.session import cut
from auditloom.sources.tree import decoded, scanned, targeted

RUN_FIELDS = ["analysis_id", "repository_id", "repo", "commit_sha"]


@dataclass(frozen=True)
class Audit:
    """What one job gives: rows for the findings and event tables, metrics per run, analyzers' errors."""

    findings: DataFrame
    metrics: DataFrame
    events: DataFrame
    errors: DataFrame


def audit(
    runs: DataFrame,
    source_files: DataFrame,
    review_responses: DataFrame,
    started_at: Column,
    finished_at: Column | Callable[[], Column],
    max_lines: int = fixed.MAX_FUNCTION_LINES,
    max_complexity: int = fixed.MAX_COMPLEXITY,
    more_analyzers: tuple[Analyzer, ...] = (Analyzer(SECRET_ANALYZER, secret_findings),),
    max_snapshot_bytes: int = fixed.MAX_SNAPSHOT_BYTES,
    targets: DataFrame | None = None,
    snapshot_sizes: DataFrame | None = None,
) -> Audit:
    """Audit all `runs` (analysis_id, repository_id, repo, commit_sha) together.

    Snapshots are audited once however many runs ask for them; contents are not shuffled where
    Spark broadcasts the wanted snapshots. Every file is parsed once: facts are written before rules
    and counters read them. A file without content counts as failed. A run whose commit has no files, or too many
    bytes, fails. With `targets` (file keys) only those files are audited.
    `snapshot_sizes` (`size_bytes` per snapshot or file) gives the guard the whole snapshots, where
    `source_files` has the audited files only.
    """
    wanted = runs.select(*SNAPSHOT_KEY).distinct()
    sizes = source_files if snapshot_sizes is None else snapshot_sizes
    sizes = sizes.select(*SNAPSHOT_KEY, "size_bytes")
    guard = cut(catalog.guard_size(
        sizes.join(wanted, SNAPSHOT_KEY, "left_semi"), max_snapshot_bytes
    ))
    allowed = guard.filter(~F.col("is_too_large")).select(*SNAPSHOT_KEY)
    kept_files = source_files.join(allowed, SNAPSHOT_KEY, "left_semi")
    python = decoded(
        scanned(kept_files) if targets is None else targeted(kept_files, targets)
    )

    facts = cut(extract_facts(python))
    static = [without_errors(rules.rule_findings(facts, max_lines, max_complexity))]
    analyzed = rules.files_analyzed(facts)
    if more_analyzers:
        static.append(
            analyze(python, list(more_analyzers))
            .withColumn("source_rank", F.col("source_rank") + 1)
        )
        read = python.select(*FILE_KEY).groupBy(*SNAPSHOT_KEY)
        analyzed = analyzed.unionByName(read.agg(F.count("*").alias("files_analyzed")))

    parsed = cut(responses.parse_responses(
        review_responses.join(allowed, SNAPSHOT_KEY, "left_semi")
    ))
    review_rank = len(more_analyzers) + 1
    found = findings.union_findings(
        [*static, without_errors(responses.review_findings(parsed, review_rank))]
    )
    tagged = cut(found)  # the stored rows, the counts and the errors read it
    found, failed = findings_of(tagged), errors_of(tagged)
    kept = findings.dedup(found)

    counts = findings.counts_of_raw(found)
    unread = rules.files_failed(facts)
    metrics = _metrics(runs, guard, counts, findings.most_files(analyzed), unread, parsed, failed)
    # by now the files are parsed and all findings written
    ended_at = finished_at() if callable(finished_at) else finished_at
    metrics = metrics.withColumn(
        "duration_seconds", findings.duration_seconds(started_at, ended_at)
    )
    owned = kept.join(runs.select("analysis_id", *SNAPSHOT_KEY), SNAPSHOT_KEY)
    return Audit(
        findings=findings.stored_form(owned),
        metrics=metrics,
        events=_events(metrics, started_at, ended_at),
        errors=failed,
    )


def _metrics(
    runs: DataFrame, guard: DataFrame, counts: DataFrame, analyzed: DataFrame,
    unread: DataFrame, parsed: DataFrame, errors: DataFrame,
) -> DataFrame:
    """One row per run. Each side is one row per snapshot before it is joined."""
    failed = F.count_if(F.col("error").isNotNull()) if "error" in parsed.columns else F.lit(0)
    review = parsed.groupBy(*SNAPSHOT_KEY).agg(
        failed.cast("long").alias("failed_reviews"),
        F.sum(F.coalesce("tokens_used", F.lit(0))).alias("tokens_used"),
        F.sum("discarded").alias("discarded"),
        F.max("summary").alias("summary"),
    )
    broken = errors.groupBy(*SNAPSHOT_KEY).agg(F.countDistinct("analyzer").alias("failed_analyzers"))
    joined = runs.select(*RUN_FIELDS).join(guard, SNAPSHOT_KEY, "left")
    for side in (counts, analyzed, unread, review, broken):
        joined = joined.join(side, SNAPSHOT_KEY, "left")
    error = (
        F.when(F.col("commit_sha").isNull(), "unknown ref")
        .when(F.col("is_too_large").isNull(), "no files for this commit")
        .when(F.col("is_too_large"), F.concat(
            F.lit("repository too large: "), F.col("total_bytes").cast("string"), F.lit(" bytes")
        ))
    )
    numbers = [
        "total_findings", "critical_count", "high_count", "static_count", "review_count",
        "files_analyzed", "tokens_used", "discarded", "failed_files", "failed_reviews",
        "failed_analyzers",
    ]
    counted = joined.fillna(0, numbers).fillna("", ["summary"]).withColumn("error_message", error)
    return counted.select(
        *RUN_FIELDS, *numbers, "summary",
        truncate(F.col("error_message"), fixed.ERROR_CHARS).alias("error_message"),
        catalog.terminal_status(F.col("error_message"), F.col("total_findings")).alias("status"),
    )


def _events(metrics: DataFrame, started_at: Column, finished_at: Column) -> DataFrame:
    """Lifecycle events to append: running, then completed or failed."""
    steps = F.array(
        F.struct(F.lit("running").alias("status"), started_at.alias("event_ts"),
                 F.lit(None).cast("string").alias("error_message")),
        F.struct(F.col("status"), finished_at.alias("event_ts"), F.col("error_message")),
    )
    return metrics.select(
        "analysis_id", "repository_id", "commit_sha", F.inline(steps)
    )


def runs_to_audit(
    requests: DataFrame, refs: DataFrame, repositories: DataFrame, analyses: DataFrame,
    as_of: Column, reuse: bool = True,
) -> DataFrame:
    """Resolve requested refs and keep what has no fresh result (`reuse=False` keeps all).

    Resolving comes first, so a new push is never answered with the old commit's result.
    """
    resolved = catalog.resolve_commits(requests, refs, repositories)
    named = resolved.withColumn("commit_sha", F.col("resolved_sha")).drop("resolved_sha")
    if not reuse:
        return named
    split = catalog.split_by_reuse(named, catalog.fresh_results(analyses, as_of))
    return split.filter(F.col("decision") == "run").drop("decision")


def write_audit(done: Audit, root: str, job: str) -> None:
    """Store a job's results; a repeated job replaces or finds its own rows.

    Findings are committed as a whole. The terminal events come last: a run counts as completed when its
    findings are there.
    """
    findings.append_findings(done.findings, f"{root}/findings", job)
    done.metrics.write.mode("overwrite").parquet(f"{root}/run_metrics/job={job}")
    done.events.write.mode("overwrite").parquet(f"{root}/analysis_events/job={job}")


def audit_batches(
    source_files: Callable[[], DataFrame],
    review_responses: Callable[[], DataFrame],
    root: str,
    now: Callable[[], datetime],
) -> Callable[[DataFrame, int], None]:
    """A function that audits each batch of queued runs, for `streaming.queue_webhooks`."""
    def run(queued: DataFrame, number: int) -> None:
        started = now()
        runs = queued.withColumn("repo", F.col("full_name"))
        done = audit(
            runs, source_files(), review_responses(), F.lit(started), lambda: F.lit(now()),
        )
        write_audit(done, root, f"webhooks-{number}")

    return run
