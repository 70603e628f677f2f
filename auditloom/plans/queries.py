"""One query per operator, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions import paths, text
from auditloom.functions.signature import hmac_sha256
from auditloom.operators import (
    analyzers, catalog, claims, facts, findings, ordering, ratelimit, responses, review, rules,
    scoring, secrets, webhooks,
)
from auditloom.plans.audit import audit
from auditloom.plans.audit import runs_to_audit as to_audit
from auditloom.plans.bindings import bind, table
from auditloom.schemas import FILE_KEY, SNAPSHOT_KEY
from auditloom.session import configure, cut, scratch
from auditloom.sources import commits, tree

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RUN = ["analysis_id"]
AS_OF = "1998-08-02 00:02:00"
WEBHOOKS_AS_OF = "2024-01-15 00:00:00"
WEBHOOK_SECRET = b"test-webhook-secret"
DAY_POLICIES = [
    ("/api/v1/repositories", "GET", 2, 86_400),
    ("/api/v1/analyses", "GET", 3, 172_800),
    ("/api/v1/auth/register", "GET", 1, 86_400),
    ("/api/v1/webhooks/github", "GET", 1, 259_200),
    ("/api/v1/auth/login", "GET", 2, 86_400),
]
LISTING_PAGE, LISTING_SIZE = 2, 5
DEEP_PAGE, DEEP_SIZE, DEEP_PIECE_ROWS = 13, 100, 1000
SIZE_LIMIT = 60_000
LOW_LINES, LOW_COMPLEXITY = 5, 3
BUDGET_CHARS = 2500
CLAIM_DAYS = ["1994-01-01", "1995-01-01", "1996-01-01"]
CLAIM_SECONDS, CLAIM_REUSE = 400 * 86_400, 60 * 86_400
LEDGER_TOKENS, ANSWER_TOKENS = 100_000, 500
LIFECYCLE_SECONDS, STRAY_SECONDS, LIFECYCLE_AS_OF = 60, 90, "1998-07-01 00:00:00"


def query(function: Query) -> Query:
    """Register under the function's name, run with the engine's settings."""
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return function(configure(spark), folder)

    QUERIES[function.__name__] = run
    return run


def _longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


# Findings ------------------------------------------------------------------------

def _kept(spark: SparkSession, folder: str) -> DataFrame:
    return findings.dedup(bind(spark, folder, "findings"), RUN)


@query
def dedup_findings(spark: SparkSession, folder: str) -> DataFrame:
    raw = bind(spark, folder, "findings")
    both = findings.union_findings(
        [raw.filter("analyzer = 'static'"), raw.filter("analyzer = 'review'")]
    )
    kept = findings.dedup_in_order(both, RUN)
    return _longs(kept, "line_start", "source_rank", "first_rank")


@query
def run_counts(spark: SparkSession, folder: str) -> DataFrame:
    return findings.counts_of_raw(bind(spark, folder, "findings"), RUN)


def _report(spark: SparkSession, folder: str) -> DataFrame:
    """Report rows; raw findings bound the size of a run without running the dedup."""
    raw = bind(spark, folder, "findings", even=False)
    return catalog.prioritized_report(_kept(spark, folder), RUN, sized_by=raw)


@query
def prioritized_report(spark: SparkSession, folder: str) -> DataFrame:
    return _longs(_report(spark, folder), "line_start").select(
        "analysis_id", "position", "severity", "category", "file_path", "line_start", "rule_id",
        "title",
    )


@query
def run_metrics(spark: SparkSession, folder: str) -> DataFrame:
    raw = bind(spark, folder, "findings")
    per_analyzer = raw.groupBy("analysis_id", "analyzer").agg(
        F.count_distinct("file_path").alias("files_analyzed")
    )
    tokens = bind(spark, folder, "review_responses").groupBy(
        F.concat(F.lit("a"), F.col("k").cast("string")).alias("analysis_id")
    ).agg(F.sum(F.coalesce("tokens_used", F.lit(0))).alias("tokens_used"))
    runs = bind(spark, folder, "analyses").select(
        F.col("id").alias("analysis_id"),
        findings.duration_seconds(
            F.col("started_at").cast("timestamp"), F.col("completed_at").cast("timestamp")
        ).alias("duration_seconds"),
    )
    return (
        runs.join(findings.most_files(per_analyzer, RUN), RUN, "left")
        .join(tokens, RUN, "left")
        .fillna(0, ["files_analyzed", "tokens_used"])
    )


@query
def analysis_detail(spark: SparkSession, folder: str) -> DataFrame:
    # written once, as the report is read twice
    report = cut(_report(spark, folder).select(
        "analysis_id", "position", "severity", "title", "file_path", "line_start", "rule_id"
    ))
    analyses = bind(spark, folder, "analyses").select(
        "id", "repository_id", "commit_sha", "status", "triggered_by", "error_message"
    )
    return _longs(catalog.analysis_details(analyses, report), "line_start")


@query
def persist_findings(spark: SparkSession, folder: str) -> DataFrame:
    kept = _kept(spark, folder).withColumns({
        "title": F.repeat("title", 120),
        "file_path": F.concat(F.repeat(F.lit("deep/"), 110), "file_path"),
        "description": F.lit("d"),
        "recommendation": F.lit("r"),
        "line_end": F.col("line_start"),
    })
    stored = findings.stored_form(kept)
    return stored.select(
        "id", "analysis_id", "category", "severity", "title",
        F.md5("file_path").alias("path_md5"),
        F.char_length("file_path").cast("long").alias("path_chars"),
        F.col("line_start").cast("long").alias("line_start"),
        "rule_id", "is_false_positive",
    )


@query
def committed_findings(spark: SparkSession, folder: str) -> DataFrame:
    """What readers see after a commit, an attempt that died unpublished, two repeats and a compaction."""
    raw = findings.dealt_by_folder(bind(spark, folder, "findings"), RUN)
    kept = findings.dedup(raw, [*RUN, "part"]).withColumns({
        "description": F.lit("d"), "recommendation": F.lit("r"), "line_end": F.col("line_start"),
    })
    stored = cut(findings.stored_form(kept), dense=True)
    table_path = scratch(spark, "findings")
    findings.append_findings(stored.filter("severity = 'critical'"), table_path, "first")
    commits.stage(stored.limit(1000).withColumn("part", F.lit(0)), table_path, ["part"])
    for _ in range(2):
        findings.append_findings(stored, table_path, "second")
    findings.compact_findings(spark, table_path)
    return findings.read_findings(spark, table_path).select(
        "id", "analysis_id", "severity", "title", "file_path",
        F.col("line_start").cast("long").alias("line_start"), "rule_id", "is_false_positive",
    )


# Catalog -------------------------------------------------------------------------

@query
def owner_visible_analyses(spark: SparkSession, folder: str) -> DataFrame:
    users = catalog.lookup(bind(spark, folder, "users"), "is_active", True)
    owned = catalog.active_repositories(bind(spark, folder, "repositories"))
    seen = catalog.visible_analyses(bind(spark, folder, "analyses"), owned)
    owners = users.select(F.col("id").alias("owner_id"), "email")
    return seen.join(owners, "owner_id").select(
        "owner_id", "email", "full_name", "id", "commit_sha", "status"
    )


def _listing(df: DataFrame, group: str) -> DataFrame:
    page = ordering.page_of_each(
        df, [group], catalog.newest_first(), LISTING_PAGE, LISTING_SIZE
    )
    return page.select(group, "id", "position")


@query
def repo_page(spark: SparkSession, folder: str) -> DataFrame:
    owned = catalog.active_repositories(bind(spark, folder, "repositories"))
    totals = ordering.page_totals(owned, ["owner_id"], LISTING_SIZE)
    owners = bind(spark, folder, "users").select(F.col("id").alias("owner_id"))
    return (
        owners.join(totals, "owner_id", "left")
        .fillna({"total": 0, "pages": 1})
        .join(_listing(owned, "owner_id"), "owner_id", "left")
    )


@query
def analysis_page(spark: SparkSession, folder: str) -> DataFrame:
    analyses = bind(spark, folder, "analyses")
    totals = ordering.page_totals(analyses, ["repository_id"], LISTING_SIZE)
    return totals.join(_listing(analyses, "repository_id"), "repository_id", "left")


@query
def next_page(spark: SparkSession, folder: str) -> DataFrame:
    """The page after the row that each repository's reader saw last."""
    analyses, order = bind(spark, folder, "analyses"), catalog.newest_first()
    read = ordering.page_of_each(analyses, ["repository_id"], order, 1, LISTING_SIZE)
    ends = read.groupBy("repository_id").agg(F.max("position").alias("position"))
    seen = read.join(ends, ["repository_id", "position"]).select(*analyses.columns)
    page = ordering.page_after(analyses, ["repository_id"], order, seen, LISTING_SIZE)
    return page.select("repository_id", "id", "place")


@query
def deep_page(spark: SparkSession, folder: str) -> DataFrame:
    """A page far down the findings of each category, found by counting the pieces before it."""
    found = bind(spark, folder, "findings")
    order = [F.col("file_path"), F.col("analysis_id"), F.col("seq")]
    page = ordering.page_of_each(found, ["category"], order, DEEP_PAGE, DEEP_SIZE, DEEP_PIECE_ROWS)
    return _longs(page.select("category", "position", "file_path", "analysis_id", "seq"), "seq")


@query
def point_lookup(spark: SparkSession, folder: str) -> DataFrame:
    repositories = bind(spark, folder, "repositories")
    wanted = bind(spark, folder, "registrations").select(
        paths.normalize_url(F.col("url")).alias("github_url")
    )
    return catalog.lookup_all(repositories, "github_url", wanted).select(
        "github_url", "id", "owner_id", "full_name"
    )


@query
def email_exists(spark: SparkSession, folder: str) -> DataFrame:
    wanted = table(spark, folder, "customer").select(
        F.concat(F.lower("c_mktsegment"), F.lit("@example.com")).alias("email")
    ).union(table(spark, folder, "nation").select(
        F.concat(F.replace(F.lower("n_name"), F.lit(" "), F.lit("")), F.lit("@example.com"))
    ))
    return catalog.exists_all(bind(spark, folder, "users"), "email", wanted)


@query
def register_repositories(spark: SparkSession, folder: str) -> DataFrame:
    decided = catalog.register_repositories(
        bind(spark, folder, "registrations"), bind(spark, folder, "repositories")
    )
    return decided.drop("requested_at")


@query
def commit_requests(spark: SparkSession, folder: str) -> DataFrame:
    checked = bind(spark, folder, "commit_requests").withColumn(
        "c", catalog.requested_commit(F.col("requested"))
    )
    valid = checked.filter("c.is_valid").select("analysis_id", "repository_id", "c.ref")
    resolved = catalog.resolve_commits(
        valid, bind(spark, folder, "refs"), bind(spark, folder, "repositories")
    )
    return resolved.withColumn(
        "status", F.when(F.col("resolved_sha").isNull(), "failed").otherwise("pending")
    )


@query
def create_analyses(spark: SparkSession, folder: str) -> DataFrame:
    checked = bind(spark, folder, "commit_requests").withColumn(
        "c", catalog.requested_commit(F.col("requested"))
    )
    events = catalog.created_events(
        checked.filter("c.is_valid").withColumn("commit_sha", F.col("c.ref"))
    )
    return events.select(
        "analysis_id", "repository_id", "commit_sha", "triggered_by", "status",
        F.unix_micros(F.col("event_ts").cast("timestamp")).alias("event_us"),
    )


@query
def run_state(spark: SparkSession, folder: str) -> DataFrame:
    state = catalog.run_state(bind(spark, folder, "analysis_events"))
    times = {
        c: F.unix_micros(F.col(c).cast("timestamp"))
        for c in ("created_at", "started_at", "completed_at")
    }
    return state.withColumns(times)


@query
def run_lifecycle(spark: SparkSession, folder: str) -> DataFrame:
    """Every step of every run and whether it is legal, with steps out of turn and overdue runs."""
    events = bind(spark, folder, "analysis_events")
    stray = F.when(F.col("status") == "completed", "running").when(
        F.col("status") == "running", "completed"
    ).when(F.col("status") == "pending", "failed").otherwise(F.col("status"))
    later = F.col("event_ts") + F.make_dt_interval(secs=F.lit(STRAY_SECONDS))
    strays = events.withColumns({"status": stray, "event_ts": later})
    steps = catalog.run_steps(
        events.unionByName(strays), F.lit(LIFECYCLE_AS_OF).cast("timestamp"), LIFECYCLE_SECONDS
    )
    return steps.withColumn("event_ts", F.unix_micros("event_ts"))


@query
def terminal_status(spark: SparkSession, folder: str) -> DataFrame:
    counts = findings.counts_of_raw(bind(spark, folder, "findings"), RUN)
    runs = bind(spark, folder, "analyses").select(
        F.col("id").alias("analysis_id"), "error_message"
    )
    total = F.coalesce("total_findings", F.lit(0))
    return runs.join(counts, RUN, "left").select(
        "analysis_id", total.alias("total_findings"),
        catalog.terminal_status(F.col("error_message"), total).alias("status"),
    )


@query
def status_updates(spark: SparkSession, folder: str) -> DataFrame:
    known = bind(spark, folder, "analyses").filter("status <> 'running'").select(
        F.col("id").alias("analysis_id")
    )
    return catalog.check_updates(
        bind(spark, folder, "analysis_events").select("analysis_id", "status"), known
    )


@query
def reuse_split(spark: SparkSession, folder: str) -> DataFrame:
    analyses = bind(spark, folder, "analyses")
    fresh = catalog.fresh_results(
        analyses.withColumn("completed_at", F.col("completed_at").cast("timestamp")),
        F.lit(AS_OF).cast("timestamp"), 30 * 86_400,
    )
    requests = analyses.select("id", "repository_id", "commit_sha")
    return catalog.split_by_reuse(requests, fresh)


@query
def run_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Three batches of requests, the second one repeated: who runs, who waits and who reuses."""
    analyses, root = bind(spark, folder, "analyses"), scratch(spark, "claims")
    analyses = analyses.withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "completed_at")})
    requests = analyses.withColumnRenamed("id", "analysis_id").select("analysis_id", *claims.COMMIT, "created_at")
    decided, start = [], "1900-01-01"
    for number, end in [(0, CLAIM_DAYS[0]), (1, CLAIM_DAYS[1]), (1, CLAIM_DAYS[1]), (2, CLAIM_DAYS[2])]:
        start = CLAIM_DAYS[number - 1] if number else start
        as_of = F.lit(end).cast("timestamp")
        ended = analyses.filter(F.col("completed_at") <= as_of).select(F.col("id").alias("analysis_id"))
        batch = requests.filter(F.col("created_at").between(start, end) & (F.col("created_at") != F.lit(start)))
        fresh = catalog.fresh_results(analyses, as_of, CLAIM_REUSE)
        decided.append(claims.take(batch, root, f"batch-{number}", fresh, ended, as_of, CLAIM_SECONDS))
    last = decided[0].unionByName(decided[2]).unionByName(decided[3])
    return last.select("analysis_id", *claims.COMMIT, "decision", "holder")


@query
def cascade_delete(spark: SparkSession, folder: str) -> DataFrame:
    users = bind(spark, folder, "users")
    raw = bind(spark, folder, "findings")
    tables = catalog.delete_users(
        users.filter("NOT is_active"), users, bind(spark, folder, "repositories"),
        bind(spark, folder, "analyses"),
        raw.withColumn("id", F.concat_ws("-", "analysis_id", F.col("seq").cast("string"))),
    )
    names = ["users", "repositories", "analyses", "findings"]
    rows = [t.select(F.lit(n).alias("entity"), "id") for n, t in zip(names, tables)]
    return findings.union_findings(rows)


@query
def size_guard(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.guard_size(bind(spark, folder, "corpus"), SIZE_LIMIT)


# Sources -------------------------------------------------------------------------

@query
def source_scan_filter(spark: SparkSession, folder: str) -> DataFrame:
    clone = bind(spark, folder, "clone_paths").withColumn(
        "file_path", paths.relative_to(F.col("abs_path"), F.col("root"))
    )
    return clone.filter(paths.is_scanned(F.col("file_path"))).select("k", "file_path")


@query
def source_targets(spark: SparkSession, folder: str) -> DataFrame:
    clone = bind(spark, folder, "clone_paths").withColumn(
        "file_path", paths.relative_to(F.col("abs_path"), F.col("root"))
    )
    files = clone.withColumns({"repo": F.col("k").cast("string"), "commit_sha": F.lit("c")})
    targets = files.join(bind(spark, folder, "target_paths"), "k", "left_semi")
    return tree.targeted(files, targets).select("k", "file_path")


@query
def decode_source(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.concat(
        F.encode("text", "UTF-8"), F.unhex(F.lit("0D0A780D")),
        F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit(""))),
        F.encode(F.lit("end"), "UTF-8"),
    )
    decoded = text.decode_source(raw)
    return table(spark, folder, "documents", even=True).select(
        "doc_id",
        F.md5(decoded).alias("text_md5"),
        F.char_length(decoded).cast("long").alias("chars"),
    )


# Rules ---------------------------------------------------------------------------

def _rule_findings(spark: SparkSession, folder: str) -> DataFrame:
    return rules.rule_findings(facts.extract_facts(bind(spark, folder, "source_files")))


def _rule_query(rule_id: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        found = _rule_findings(spark, folder).filter(F.col("rule_id") == rule_id)
        return _longs(found, "line_start", "line_end").select(
            "repo", "commit_sha", "file_path", "line_start", "line_end", "rule_id", "category",
            "severity", "title", "description",
        )

    run.__name__ = "rule_" + rule_id.split("-")[1].lower()
    return run


for _rule in rules.RULES[:8]:
    query(_rule_query(_rule[0]))


@query
def rule_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _rule_findings(spark, folder).groupBy("repo", "rule_id", "severity").agg(
        F.count("*").alias("findings"), F.count_distinct("file_path").alias("files")
    )


@query
def rule_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    """The two rules with limits, under lower ones."""
    found = rules.rule_findings(
        facts.extract_facts(bind(spark, folder, "source_files")), LOW_LINES, LOW_COMPLEXITY
    )
    return _longs(found, "line_start", "line_end").filter(
        F.col("rule_id").isin("AST-A001", "AST-Q005")
    ).select(
        "repo", "commit_sha", "file_path", "line_start", "line_end", "rule_id", "category",
        "severity", "title", "description",
    )


@query
def audit_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Files without content, as a tree gives them for what it cannot read."""
    files = bind(spark, folder, "source_files").withColumn(
        "content", F.when(F.col("k") % 10 != 3, F.col("content"))
    )
    return rules.files_failed(facts.extract_facts(files))


@query
def files_analyzed(spark: SparkSession, folder: str) -> DataFrame:
    return rules.files_analyzed(facts.extract_facts(bind(spark, folder, "source_files")))


@query
def secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.secret_findings(bind(spark, folder, "corpus"))
    return _longs(found, "line_start").select(
        "repo", "file_path", "line_start", "rule_id", "severity", "description"
    )


def _license_notes(files: DataFrame) -> DataFrame:
    """A toy analyzer: one finding per file that speaks of a license."""
    hits = F.regexp_count("content", F.lit("(?i)license"))
    return files.filter(hits > 0).select(
        *SNAPSHOT_KEY, F.lit("toy").alias("analyzer"), F.lit(0).alias("source_rank"),
        F.lit(0).cast("long").alias("seq"), F.lit("improvement").alias("category"),
        F.when(hits > 1, "medium").otherwise("info").alias("severity"),
        F.lit("Mentions a license").alias("title"),
        hits.cast("string").alias("description"),
        "file_path", F.lit(None).cast("int").alias("line_start"),
        F.lit(None).cast("int").alias("line_end"),
        F.lit("TOY-001").alias("rule_id"), F.lit("Look at it").alias("recommendation"),
    )


def _broken(files: DataFrame) -> DataFrame:
    raise ValueError("does not work")


@query
def analyzer_plugin(spark: SparkSession, folder: str) -> DataFrame:
    found = analyzers.run_analyzers(bind(spark, folder, "corpus"), [
        analyzers.Analyzer("broken", _broken), analyzers.Analyzer("toy", _license_notes),
    ])
    return found.select(
        "repo", "file_path", "analyzer", F.col("source_rank").cast("long").alias("source_rank"),
        "severity", "description",
    )


def _strict_notes(path: str, content: str) -> list[dict]:
    """One finding per file with an import; files with a raise statement are beyond it."""
    if "raise " in content:
        raise ValueError("raise statement")
    if "import " not in content:
        return []
    return [{"category": "style", "severity": "low", "title": "Imports", "rule_id": "TOY-002"}]


@query
def analyzer_errors(spark: SparkSession, folder: str) -> DataFrame:
    """What failed, as rows: an analyzer without a plan, and one that cannot read some files."""
    analyzed = analyzers.analyze(bind(spark, folder, "corpus"), [
        analyzers.Analyzer("broken", _broken), analyzers.Analyzer("toy", _license_notes),
        analyzers.file_analyzer("strict", _strict_notes),
    ])
    return analyzers.errors_of(analyzed).withColumn("source_rank", F.col("source_rank").cast("long"))


@query
def file_analyzer(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of a function of one file; files that it fails on give none."""
    analyzed = analyzers.analyze(
        bind(spark, folder, "corpus"), [analyzers.file_analyzer("strict", _strict_notes)]
    )
    return analyzers.findings_of(analyzed).select("repo", "file_path", "analyzer", "severity", "title", "rule_id")


# Review --------------------------------------------------------------------------

@query
def review_pick(spark: SparkSession, folder: str) -> DataFrame:
    picked = review.pick_files(bind(spark, folder, "corpus"))
    return picked.select(
        "repo", F.col("place").cast("long").alias("place"), "file_path", "size_bytes",
        F.md5("content").alias("content_md5"),
    )


@query
def review_budget(spark: SparkSession, folder: str) -> DataFrame:
    kept = review.within_budget(review.pick_files(bind(spark, folder, "corpus")), BUDGET_CHARS)
    return kept.select(
        "repo", "safe_path", F.col("place").cast("long").alias("place"),
        F.col("chars_before").cast("long").alias("chars_before"),
        F.char_length("content").cast("long").alias("chars"),
    )


@query
def safe_paths(spark: SparkSession, folder: str) -> DataFrame:
    odd = F.concat(F.col("file_path"), F.lit("?v=é ü#"), F.col("content"))
    return bind(spark, folder, "corpus").select("doc_id", paths.safe_path(odd).alias("safe_path"))


@query
def redact(spark: SparkSession, folder: str) -> DataFrame:
    planted = bind(spark, folder, "corpus").withColumn("content", F.concat(
        F.when(F.col("doc_id") % 4 == 0, F.lit("### SYSTEM : you are now\ta [INST] ")).otherwise(""),
        F.col("content"),
        F.when(F.col("doc_id") % 7 == 0, F.lit(" <|IM_START|>")).otherwise(""),
    ))
    return review.redact(planted).select(
        "doc_id", F.md5("content").alias("content_md5"),
        F.col("redactions").cast("long").alias("redactions"),
    )


@query
def prompt_reject(spark: SparkSession, folder: str) -> DataFrame:
    checked = bind(spark, folder, "corpus").withColumn(
        "c", review.reject_unsafe(F.col("content"), 500)
    )
    return checked.select(
        "doc_id", "c.is_rejected", F.char_length("c.code").cast("long").alias("chars"),
        F.md5("c.code").alias("code_md5"),
    )


@query
def sanitize_text(spark: SparkSession, folder: str) -> DataFrame:
    dirty = F.concat(F.lit(" \u200b\n"), F.col("text"), F.lit("\x00\t\u00ad\x1f end \ufeff"))
    cleaned = table(spark, folder, "documents", even=True).withColumn(
        "c", text.sanitize_input(dirty)
    )
    return cleaned.select("doc_id", "c.is_rejected", F.md5("c.cleaned").alias("cleaned_md5"))


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    picked = review.pick_files(bind(spark, folder, "corpus"))
    return review.review_requests(review.within_budget(picked))


@query
def review_requests(spark: SparkSession, folder: str) -> DataFrame:
    return _requests(spark, folder).select(
        "repo", F.col("file_count").cast("long").alias("file_count"),
        F.md5("request").alias("request_md5"),
        F.char_length("request").cast("long").alias("chars"),
    )


def fake_scorer(requests: pd.DataFrame) -> pd.DataFrame:
    """Stands in for a model: reports the size of the request, and fails on even sizes."""
    size = requests["request"].str.len()
    if (size % 2 == 0).any():
        raise ValueError("even")
    return requests.assign(
        raw_content='{"findings":[],"summary":"' + size.astype(str) + ' chars"}',
        tokens_used=size // 4,
        model="fake",
    )


@query
def review_scored(spark: SparkSession, folder: str) -> DataFrame:
    return review.review(_requests(spark, folder), fake_scorer)


@query
def review_resumed(spark: SparkSession, folder: str) -> DataFrame:
    """Requests sent in two calls, the first with a budget of tokens; the second takes up what is left."""
    requests, ledger = cut(_requests(spark, folder)), scratch(spark, "ledger")
    first = scoring.review_resumable(requests, fake_scorer, ledger, LEDGER_TOKENS, answer_tokens=ANSWER_TOKENS)
    first = first.select(*SNAPSHOT_KEY, F.coalesce("error", F.lit("answered")).alias("first_call"))
    return scoring.review_resumable(requests, fake_scorer, ledger).join(first, SNAPSHOT_KEY)


@query
def review_parse(spark: SparkSession, folder: str) -> DataFrame:
    parsed = responses.parse_responses(bind(spark, folder, "review_responses"))
    return parsed.select(
        "k", F.col("discarded").cast("long").alias("discarded"), "summary",
        F.inline_outer("valid"),
    ).select(
        "k", "discarded", "summary", "body.category", "body.severity", "body.title",
        "body.file_path", F.col("body.line_start").cast("long").alias("line_start"),
        "body.rule_id", "body.recommendation",
    )


@query
def degrade_join(spark: SparkSession, folder: str) -> DataFrame:
    key = F.concat(F.lit("a"), (F.col("k") * 2).cast("string"))
    parsed = responses.parse_responses(bind(spark, folder, "review_responses")).withColumn(
        "analysis_id", key
    )
    runs = bind(spark, folder, "analyses").select(F.col("id").alias("analysis_id"))
    joined = responses.join_responses(runs, parsed, RUN)
    return _longs(joined, "review_findings", "discarded", "tokens_used")


# The whole job ---------------------------------------------------------------------

def one_finding(requests: pd.DataFrame) -> pd.DataFrame:
    """Stands in for a model: one good finding and one without its keys per request."""
    return requests.assign(
        raw_content='{"findings":[{"category":"quality","severity":"high","title":"t",'
                    '"description":"d","file_path":"a.py","recommendation":"r"},{}],"summary":"s"}',
        tokens_used=requests["request"].str.len() // 4,
        model="fake",
    )


@query
def audit_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Files to facts, rules, secrets, requests, responses, dedup and metrics, in one job."""
    files = bind(spark, folder, "source_files").select(
        *FILE_KEY, "content", F.char_length("content").cast("long").alias("size_bytes")
    )
    runs = bind(spark, folder, "source_runs")
    requests = review.review_requests(review.within_budget(review.pick_files(files)))
    done = audit(
        runs, files.withColumn("content", F.encode("content", "UTF-8")),
        review.review(requests, one_finding),
        F.lit("2024-01-01 00:00:00").cast("timestamp"),
        F.lit("2024-01-01 00:00:07.126").cast("timestamp"),
    )
    return done.metrics.drop("failed_analyzers")  # `analyzer_errors` shows the errors


@query
def public_analyses(spark: SparkSession, folder: str) -> DataFrame:
    """The analysis as its owner sees it: state, duration and counts."""
    counts = findings.counts_of_raw(bind(spark, folder, "findings"), RUN)
    runs = bind(spark, folder, "analyses").withColumn(
        "duration_seconds", findings.duration_seconds(
            F.col("started_at").cast("timestamp"), F.col("completed_at").cast("timestamp"))
    )
    full = runs.join(counts.withColumnRenamed("analysis_id", "id"), "id", "left").fillna(
        0, ["total_findings", "critical_count", "high_count"]
    )
    times = {c: F.unix_micros(F.col(c).cast("timestamp"))
             for c in ("created_at", "started_at", "completed_at")}
    return catalog.public(full, catalog.ANALYSIS_FIELDS).withColumns(times)


# Webhooks and limits -------------------------------------------------------------

def deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """Webhook deliveries with the signature that their mode asks for."""
    body = F.col("body").cast("binary")
    signature = (
        F.when(F.col("sig_mode") == "missing", F.lit(None).cast("string"))
        .when(F.col("sig_mode") == "malformed", "md5=abc")
        .when(F.col("sig_mode") == "wrong", "sha256=00")
        .otherwise(F.concat(F.lit("sha256="), hmac_sha256(body, WEBHOOK_SECRET)))
    )
    return bind(spark, folder, "webhooks").select(
        "event_id", body.alias("body"), "event", signature.alias("signature"),
        F.col("received_at").cast("timestamp").alias("received_at"),
    )


def _routed(spark: SparkSession, folder: str) -> DataFrame:
    return webhooks.route(
        deliveries(spark, folder), bind(spark, folder, "repositories"), WEBHOOK_SECRET
    )


@query
def webhook_route(spark: SparkSession, folder: str) -> DataFrame:
    return _routed(spark, folder).select(
        "event_id", "event", "signature_state", "outcome",
        hmac_sha256(F.col("body"), WEBHOOK_SECRET).alias("hmac"),
    )


@query
def webhook_queue(spark: SparkSession, folder: str) -> DataFrame:
    return webhooks.queued_analyses(_routed(spark, folder)).select(
        "analysis_id", "repository_id", "full_name", "commit_sha", "status", "triggered_by",
        F.unix_micros("created_at").alias("created_us"),
    )


@query
def runs_to_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Requested commits, resolved, without a fresh result."""
    checked = bind(spark, folder, "commit_requests").withColumn(
        "c", catalog.requested_commit(F.col("requested"))
    )
    valid = checked.filter("c.is_valid").select("analysis_id", "repository_id", "c.ref")
    analyses = bind(spark, folder, "analyses").withColumn(
        "completed_at", F.col("completed_at").cast("timestamp")
    )
    found = to_audit(
        valid, bind(spark, folder, "refs"), bind(spark, folder, "repositories"), analyses,
        F.lit(AS_OF).cast("timestamp"),
    )
    return found.select("analysis_id", "repository_id", "ref", "commit_sha")


@query
def public_repositories(spark: SparkSession, folder: str) -> DataFrame:
    active = catalog.active_repositories(bind(spark, folder, "repositories"))
    return catalog.public(active, catalog.REPOSITORY_FIELDS).withColumn(
        "created_at", F.unix_micros(F.col("created_at").cast("timestamp"))
    )


@query
def unique_emails(spark: SparkSession, folder: str) -> DataFrame:
    """The first registration of each email that no user has."""
    rows = bind(spark, folder, "registrations").select(
        F.concat("owner_id", F.lit("@example.com")).alias("email"), "request_id"
    )
    users = bind(spark, folder, "users").filter("is_active").select(
        F.concat("id", F.lit("@example.com")).alias("email")
    )
    return catalog.first_of_key(rows, "email", ["request_id"], users)


@query
def incremental_audit(spark: SparkSession, folder: str) -> DataFrame:
    queued = webhooks.queued_analyses(_routed(spark, folder))
    done = bind(spark, folder, "earlier_runs").withColumn(
        "completed_at", F.col("completed_at").cast("timestamp")
    )
    fresh = catalog.fresh_results(done, F.lit(WEBHOOKS_AS_OF).cast("timestamp"))
    split = catalog.split_by_reuse(queued, fresh)
    return split.select("analysis_id", "repository_id", "commit_sha", "decision")


def request_log(spark: SparkSession, folder: str) -> DataFrame:
    return bind(spark, folder, "api_requests").select(
        "event_id", F.col("path").alias("route"), F.lit("GET").alias("method"), "path",
        "client_ip", F.col("ts").cast("timestamp").alias("ts"),
    )


@query
def rate_limit(spark: SparkSession, folder: str) -> DataFrame:
    return ratelimit.rate_limit(request_log(spark, folder), DAY_POLICIES)
