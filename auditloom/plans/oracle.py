"""The same results in plain SQL, for checking `queries` with another engine."""

from __future__ import annotations

import hashlib

from auditloom import fixed
from auditloom.operators import secrets
from auditloom.operators.rules import RULES
from auditloom.plans import queries as q
from auditloom.plans.bindings import with_bindings

ORACLE: dict[str, str] = {}

RANK = (
    "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 "
    "WHEN 'low' THEN 3 ELSE 4 END"
)
KEPT = f"""
kept AS (
  SELECT * FROM (
    SELECT *,
      row_number() OVER (PARTITION BY analysis_id, file_path, line_start, rule_id
                         ORDER BY {RANK}, source_rank, seq) AS rn,
      first_value(source_rank) OVER (PARTITION BY analysis_id, file_path, line_start, rule_id
                                     ORDER BY source_rank, seq) AS first_rank,
      first_value(seq) OVER (PARTITION BY analysis_id, file_path, line_start, rule_id
                             ORDER BY source_rank, seq) AS first_seq
    FROM findings) AS ranked
  WHERE rn = 1)"""
REPORT = f"""
report AS (
  SELECT *, row_number() OVER (PARTITION BY analysis_id
    ORDER BY {RANK}, file_path, line_start NULLS FIRST, rule_id) AS position
  FROM kept WHERE NOT is_false_positive)"""


def add(name: str, query: str, *names: str, steps: str = "") -> None:
    """Register `query` after the bindings `names` and further expressions `steps`."""
    if not names:
        ORACLE[name] = (f"WITH {steps}\n" if steps else "") + query
        return
    text = with_bindings("", *names).rstrip()
    ORACLE[name] = text + (",\n" + steps if steps else "") + "\n" + query


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Findings ------------------------------------------------------------------------

add("dedup_findings", """
SELECT analysis_id, file_path, cast(line_start AS bigint) AS line_start, rule_id,
       cast(source_rank AS bigint) AS source_rank, seq, analyzer, category, severity, title,
       is_false_positive, cast(first_rank AS bigint) AS first_rank, first_seq
FROM kept""", "findings", steps=KEPT)

add("run_counts", """
SELECT analysis_id, c.total_findings, c.critical_count, c.high_count, r.static_count, r.review_count
FROM (SELECT analysis_id, count(*) AS total_findings,
             count(*) FILTER (severity = 'critical') AS critical_count,
             count(*) FILTER (severity = 'high') AS high_count
      FROM kept GROUP BY analysis_id) AS c
JOIN (SELECT analysis_id, count(*) FILTER (analyzer = 'static') AS static_count,
             count(*) FILTER (analyzer = 'review') AS review_count
      FROM findings GROUP BY analysis_id) AS r USING (analysis_id)""", "findings", steps=KEPT)

add("prioritized_report", """
SELECT analysis_id, position, severity, category, file_path,
       cast(line_start AS bigint) AS line_start, rule_id, title
FROM report""", "findings", steps=KEPT + "," + REPORT)

add("run_metrics", """
SELECT a.id AS analysis_id,
       round((epoch_us(a.completed_at) - epoch_us(a.started_at)) / 1000000.0, 2) AS duration_seconds,
       coalesce(f.n, 0) AS files_analyzed, cast(coalesce(t.tokens, 0) AS bigint) AS tokens_used
FROM analyses AS a
LEFT JOIN (SELECT analysis_id, max(n) AS n FROM
            (SELECT analysis_id, analyzer, count(DISTINCT file_path) AS n
             FROM findings GROUP BY analysis_id, analyzer) AS per_analyzer
           GROUP BY analysis_id) AS f ON f.analysis_id = a.id
LEFT JOIN (SELECT k, sum(tokens_used) AS tokens FROM review_responses GROUP BY k) AS t
       ON a.id = concat('a', cast(t.k AS string))""", "findings", "analyses", "review_responses")

add("analysis_detail", """
SELECT a.id AS analysis_id, a.repository_id, a.commit_sha, a.status, a.triggered_by,
       a.error_message, r.position, r.severity, r.title, r.file_path,
       cast(r.line_start AS bigint) AS line_start, r.rule_id
FROM analyses AS a LEFT JOIN report AS r ON r.analysis_id = a.id""",
    "findings", "analyses", steps=KEPT + "," + REPORT)

add("persist_findings", """
SELECT sha256(concat(analysis_id, chr(31), repeat('deep/', 110), file_path, chr(31),
                     coalesce(cast(line_start AS string), ''), chr(31), rule_id)) AS id,
       analysis_id, category, severity, substr(repeat(title, 120), 1, 300) AS title,
       md5(substr(concat(repeat('deep/', 110), file_path), 1, 500)) AS path_md5,
       least(length(concat(repeat('deep/', 110), file_path)), 500) AS path_chars,
       cast(line_start AS bigint) AS line_start, rule_id, is_false_positive
FROM kept""", "findings", steps=KEPT)

add("committed_findings", """
SELECT sha256(concat(analysis_id, chr(31), file_path, chr(31),
                     coalesce(cast(line_start AS string), ''), chr(31), rule_id)) AS id,
       analysis_id, severity, substr(title, 1, 300) AS title, substr(file_path, 1, 500) AS file_path,
       cast(line_start AS bigint) AS line_start, rule_id, is_false_positive
FROM kept""", "findings", steps=KEPT)

# Catalog -------------------------------------------------------------------------

add("owner_visible_analyses", """
SELECT r.owner_id, u.email, r.full_name, a.id, a.commit_sha, a.status
FROM analyses AS a JOIN repositories AS r ON a.repository_id = r.id
JOIN users AS u ON r.owner_id = u.id
WHERE u.is_active AND r.is_active""", "users", "repositories", "analyses")

_FIRST = (q.LISTING_PAGE - 1) * q.LISTING_SIZE + 1
_LAST = q.LISTING_PAGE * q.LISTING_SIZE

add("repo_page", f"""
SELECT u.id AS owner_id, coalesce(t.n, 0) AS total,
       greatest(cast(ceil(coalesce(t.n, 0) / {q.LISTING_SIZE}.0) AS bigint), 1) AS pages,
       p.id, p.position
FROM users AS u
LEFT JOIN (SELECT owner_id, count(*) AS n FROM repositories WHERE is_active GROUP BY owner_id) AS t
       ON t.owner_id = u.id
LEFT JOIN (SELECT * FROM (SELECT owner_id, id, row_number() OVER (PARTITION BY owner_id
             ORDER BY created_at DESC, id) AS position FROM repositories WHERE is_active) AS n
           WHERE position BETWEEN {_FIRST} AND {_LAST}) AS p ON p.owner_id = u.id""",
    "users", "repositories")

add("analysis_page", f"""
SELECT t.repository_id, t.n AS total,
       greatest(cast(ceil(t.n / {q.LISTING_SIZE}.0) AS bigint), 1) AS pages, p.id, p.position
FROM (SELECT repository_id, count(*) AS n FROM analyses GROUP BY repository_id) AS t
LEFT JOIN (SELECT * FROM (SELECT repository_id, id, row_number() OVER (PARTITION BY repository_id
             ORDER BY created_at DESC, id) AS position FROM analyses) AS n
           WHERE position BETWEEN {_FIRST} AND {_LAST}) AS p USING (repository_id)""", "analyses")

add("next_page", f"""
SELECT repository_id, id, position - {q.LISTING_SIZE} AS place
FROM (SELECT repository_id, id, row_number() OVER (PARTITION BY repository_id
        ORDER BY created_at DESC, id) AS position FROM analyses) AS n
WHERE position > {q.LISTING_SIZE} AND position <= 2 * {q.LISTING_SIZE}""", "analyses")

add("deep_page", f"""
SELECT category, position, file_path, analysis_id, seq
FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY file_path, analysis_id, seq) AS position
      FROM findings) AS n
WHERE position BETWEEN {(q.DEEP_PAGE - 1) * q.DEEP_SIZE + 1} AND {q.DEEP_PAGE * q.DEEP_SIZE}""", "findings")

_NORMAL = "rtrim(trim(url), '/')"
add("point_lookup", f"""
SELECT w.github_url, r.id, r.owner_id, r.full_name
FROM (SELECT DISTINCT {_NORMAL} AS github_url FROM registrations) AS w
LEFT JOIN repositories AS r USING (github_url)""", "registrations", "repositories")

add("email_exists", """
SELECT email, email IN (SELECT email FROM users) AS found
FROM (SELECT concat(lower(c_mktsegment), '@example.com') AS email FROM customer
      UNION SELECT concat(replace(lower(n_name), ' ', ''), '@example.com') FROM nation) AS w""",
    "users")

_URL = quoted(fixed.URL_PATTERN.removeprefix("(?d)"))
add("register_repositories", f"""
SELECT c.request_id, c.owner_id, c.github_url,
       CASE WHEN ok THEN concat(split_part(github_url, '/', 4), '/', split_part(github_url, '/', 5)) END AS full_name,
       CASE WHEN NOT ok THEN 'invalid_url'
            WHEN place = 1 AND github_url NOT IN (SELECT github_url FROM repositories) THEN 'registered'
            ELSE 'already_registered' END AS outcome
FROM (SELECT *, row_number() OVER (PARTITION BY github_url ORDER BY requested_at, request_id) AS place
      FROM (SELECT *, {_NORMAL} AS github_url, regexp_matches({_NORMAL}, {_URL}) AS ok
            FROM registrations) AS checked) AS c""", "registrations", "repositories")

_VALID = "(requested IS NULL OR regexp_full_match(requested, '[0-9a-fA-F]{7,40}'))"
add("commit_requests", f"""
SELECT *, CASE WHEN resolved_sha IS NULL THEN 'failed' ELSE 'pending' END AS status
FROM (SELECT c.analysis_id, c.repository_id, coalesce(c.requested, 'HEAD') AS ref,
             CASE WHEN length(c.requested) = 40 THEN lower(c.requested) ELSE refs.sha END AS resolved_sha
      FROM commit_requests AS c
      LEFT JOIN refs ON refs.repository_id = c.repository_id
                    AND refs.ref = coalesce(c.requested, 'main')
      WHERE {_VALID}) AS resolved""", "commit_requests", "refs")

add("runs_to_audit", f"""
SELECT analysis_id, repository_id, ref, sha AS commit_sha
FROM (SELECT c.analysis_id, c.repository_id, coalesce(c.requested, 'HEAD') AS ref,
             CASE WHEN length(c.requested) = 40 THEN lower(c.requested) ELSE refs.sha END AS sha
      FROM commit_requests AS c
      LEFT JOIN refs ON refs.repository_id = c.repository_id
                    AND refs.ref = coalesce(c.requested, 'main')
      WHERE {_VALID}) AS resolved
WHERE NOT EXISTS (
  SELECT 1 FROM analyses AS f
  WHERE f.repository_id = resolved.repository_id AND f.commit_sha = resolved.sha
    AND f.status = 'completed' AND f.completed_at <= timestamp '{q.AS_OF}'
    AND f.completed_at > timestamp '{q.AS_OF}' - interval '1' day)""",
    "commit_requests", "refs", "analyses")

add("public_repositories", """
SELECT id, github_url, full_name, default_branch, is_active, epoch_us(created_at) AS created_at
FROM repositories WHERE is_active""", "repositories")

add("unique_emails", """
SELECT concat(owner_id, '@example.com') AS email, min(request_id) AS request_id
FROM registrations WHERE owner_id NOT IN (SELECT id FROM users WHERE is_active)
GROUP BY owner_id""", "registrations", "users")

add("create_analyses", f"""
SELECT analysis_id, repository_id, coalesce(requested, 'HEAD') AS commit_sha, triggered_by,
       'pending' AS status, epoch_us(created_at) AS event_us
FROM commit_requests WHERE {_VALID}""", "commit_requests")

add("run_state", f"""
SELECT analysis_id, arg_max(status, event_ts) AS status,
       min(epoch_us(event_ts)) FILTER (status = 'pending') AS created_at,
       min(epoch_us(event_ts)) FILTER (status = 'running') AS started_at,
       max(epoch_us(event_ts)) FILTER (status IN ('completed', 'failed')) AS completed_at,
       substr(max(error_message), 1, {fixed.ERROR_CHARS}) AS error_message
FROM analysis_events GROUP BY analysis_id""", "analysis_events")

def _claim_batch(number: int) -> str:
    """One batch's decisions (`d0`, `d1`, ..) from the claims of the batches before it."""
    start, end = (["1900-01-01"] + q.CLAIM_DAYS)[number], q.CLAIM_DAYS[number]
    live = " UNION ALL ".join(
        f"SELECT repository_id, commit_sha, analysis_id FROM d{b} WHERE decision = 'run' AND"
        f" epoch(timestamp '{end}') - epoch(timestamp '{q.CLAIM_DAYS[b]}') < {q.CLAIM_SECONDS}"
        f" AND analysis_id NOT IN (SELECT id FROM analyses WHERE completed_at <= timestamp '{end}')"
        for b in range(number)
    ) or "SELECT repository_id, commit_sha, id AS analysis_id FROM analyses WHERE false"
    return f"""
f{number} AS (SELECT DISTINCT repository_id, commit_sha FROM analyses WHERE status = 'completed'
  AND completed_at <= timestamp '{end}' AND epoch(timestamp '{end}') - epoch(completed_at) < {q.CLAIM_REUSE}),
l{number} AS (SELECT repository_id, commit_sha, min(analysis_id) AS holder FROM ({live}) AS c GROUP BY ALL),
d{number} AS (
  SELECT analysis_id, repository_id, commit_sha,
         CASE WHEN fresh THEN 'reuse' WHEN first = analysis_id THEN 'run' ELSE 'wait' END AS decision,
         CASE WHEN NOT fresh THEN first END AS holder
  FROM (SELECT a.id AS analysis_id, a.repository_id, a.commit_sha, f.commit_sha IS NOT NULL AS fresh,
               coalesce(l.holder, first_value(a.id) OVER (
                 PARTITION BY a.repository_id, a.commit_sha ORDER BY a.created_at, a.id)) AS first
        FROM analyses AS a LEFT JOIN f{number} AS f USING (repository_id, commit_sha)
        LEFT JOIN l{number} AS l USING (repository_id, commit_sha)
        WHERE a.created_at > timestamp '{start}' AND a.created_at <= timestamp '{end}') AS r)"""


add("run_claims", "SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2", "analyses",
    steps=",".join(map(_claim_batch, range(3))))

add("run_lifecycle", f"""
SELECT analysis_id, status, epoch_us(event_ts) AS event_ts, error_message,
       coalesce(n = c, false) OR coalesce(n = s, false) OR coalesce(s IS NULL AND n = b, false)
         OR coalesce(n = e AND NOT overdue, false) AS accepted
FROM steps JOIN judged USING (analysis_id)
UNION ALL
SELECT analysis_id, 'timeout', epoch_us(deadline), NULL, true FROM judged WHERE overdue""",
    "analysis_events", steps=f"""
steps AS (
  SELECT *, row_number() OVER (
    PARTITION BY analysis_id ORDER BY event_ts,
    list_position(['pending', 'running', 'completed', 'failed'], status), error_message NULLS FIRST) AS n
  FROM (SELECT DISTINCT * FROM (
    SELECT analysis_id, status, event_ts, error_message FROM analysis_events
    UNION ALL
    SELECT analysis_id, CASE status WHEN 'completed' THEN 'running' WHEN 'running' THEN 'completed'
                                    WHEN 'pending' THEN 'failed' ELSE status END,
           event_ts + interval '{q.STRAY_SECONDS}' second, error_message FROM analysis_events) AS every
    WHERE event_ts <= TIMESTAMP '{q.LIFECYCLE_AS_OF}') AS due),
created AS (SELECT analysis_id, min(n) FILTER (status = 'pending') AS c FROM steps GROUP BY analysis_id),
begun AS (
  SELECT analysis_id, c, min(n) FILTER (n > c AND status = 'running') AS s,
         min(n) FILTER (n > c AND status = 'failed') AS b
  FROM steps JOIN created USING (analysis_id) GROUP BY analysis_id, c),
started AS (SELECT analysis_id, c, b, CASE WHEN b IS NULL OR s < b THEN s END AS s FROM begun),
ended AS (
  SELECT analysis_id, c, b, s, min(n) FILTER (n > s AND status IN ('completed', 'failed')) AS e,
         min(event_ts) FILTER (n = s) + interval '{q.LIFECYCLE_SECONDS}' second AS deadline
  FROM steps JOIN started USING (analysis_id) GROUP BY analysis_id, c, b, s),
judged AS (
  SELECT a.*, deadline <= TIMESTAMP '{q.LIFECYCLE_AS_OF}'
              AND (z.event_ts IS NULL OR z.event_ts > deadline) AS overdue
  FROM ended AS a LEFT JOIN steps AS z ON z.analysis_id = a.analysis_id AND z.n = a.e)""")

add("terminal_status", """
SELECT a.id AS analysis_id, coalesce(n, 0) AS total_findings,
       CASE WHEN a.error_message IS NOT NULL AND coalesce(n, 0) = 0 THEN 'failed' ELSE 'completed' END AS status
FROM analyses AS a
LEFT JOIN (SELECT analysis_id, count(*) AS n FROM kept GROUP BY analysis_id) AS c
       ON c.analysis_id = a.id""", "findings", "analyses", steps=KEPT)

add("status_updates", """
SELECT e.analysis_id, e.status,
       e.analysis_id IN (SELECT id FROM analyses WHERE status <> 'running') AS is_known
FROM analysis_events AS e""", "analysis_events", "analyses")

add("reuse_split", f"""
SELECT a.id, a.repository_id, a.commit_sha,
       CASE WHEN EXISTS (
         SELECT 1 FROM analyses AS f
         WHERE f.repository_id = a.repository_id AND f.commit_sha = a.commit_sha
           AND f.status = 'completed' AND f.completed_at <= timestamp '{q.AS_OF}'
           AND f.completed_at > timestamp '{q.AS_OF}' - interval '30' day)
       THEN 'reuse' ELSE 'run' END AS decision
FROM analyses AS a""", "analyses")

add("cascade_delete", """
SELECT 'users' AS entity, id FROM users WHERE is_active
UNION ALL SELECT 'repositories', id FROM live_repositories
UNION ALL SELECT 'analyses', id FROM live_analyses
UNION ALL SELECT 'findings', concat(analysis_id, '-', cast(seq AS string)) FROM findings
          WHERE analysis_id NOT IN (SELECT id FROM analyses WHERE id NOT IN (SELECT id FROM live_analyses))""",
    "users", "repositories", "analyses", "findings", steps="""
live_repositories AS (SELECT id FROM repositories
  WHERE owner_id NOT IN (SELECT id FROM users WHERE NOT is_active)),
live_analyses AS (SELECT id FROM analyses
  WHERE repository_id NOT IN (SELECT id FROM repositories
                              WHERE id NOT IN (SELECT id FROM live_repositories)))""")

add("size_guard", f"""
SELECT repo, commit_sha, cast(sum(size_bytes) AS bigint) AS total_bytes,
       sum(size_bytes) > {q.SIZE_LIMIT} AS is_too_large
FROM corpus GROUP BY repo, commit_sha""", "corpus")

# Sources -------------------------------------------------------------------------

_RELATIVE = "substr(abs_path, length(root) + 2)"
_IGNORED = "[" + ", ".join(map(quoted, fixed.IGNORED_DIRS)) + "]"
add("source_scan_filter", f"""
SELECT k, {_RELATIVE} AS file_path FROM clone_paths
WHERE abs_path LIKE '%.py' AND NOT list_has_any(string_split({_RELATIVE}, '/'), {_IGNORED})""",
    "clone_paths")

add("source_targets", f"""
SELECT k, {_RELATIVE} AS file_path FROM clone_paths
WHERE abs_path LIKE '%.py' AND k IN (SELECT k FROM target_paths)""",
    "clone_paths", "target_paths")

add("decode_source", """
SELECT doc_id, md5(t) AS text_md5, length(t) AS chars
FROM (SELECT doc_id, replace(replace(raw, concat(chr(13), chr(10)), chr(10)), chr(13), chr(10)) AS t
      FROM (SELECT doc_id, concat(text, chr(13), chr(10), 'x', chr(13),
                   CASE WHEN doc_id % 3 = 0 THEN chr(65533) ELSE '' END, 'end') AS raw
            FROM documents) AS planted) AS decoded""")

# Rules ---------------------------------------------------------------------------

# Lines of the generated files, from the knobs alone
_LAYOUT = """
layout AS (
  SELECT *, def + doc + s AS steps_end, def + doc + s + tmp + ifs AS ifs_end,
         def + doc + s + tmp + ifs + 4 * tr + ex AS last_line
  FROM (SELECT k, s, repo, commit_sha, file_path, concat('f_', cast(k AS string)) AS fn,
               1 + cast(k % 13 = 0 AS int) AS def, cast(k % 2 = 0 AS int) AS doc,
               cast(k % 5 = 0 AS int) AS tmp, cast(k % 15 AS int) AS ifs,
               cast(k % 7 = 0 AS int) AS tr, cast(k % 11 = 0 AS int) AS ex
        FROM source_files WHERE k % 97 <> 0) AS knobs)"""
_LENGTH = "last_line - def + 1"
_COMPLEXITY = "1 + ifs + tr"
# rule: condition, first line, last line, name, detail, limit
_EXPECTED = {
    "AST-Q001": ("k % 13 = 0", "1", "1", "''", "'os'", "''"),
    "AST-A001": (f"{_LENGTH} > 20", "def", "last_line", "fn", _LENGTH, "20"),
    "AST-Q002": ("doc = 0", "def", "last_line", "fn", "''", "''"),
    "AST-Q003": ("k % 3 <> 0", "def", "last_line", "fn",
                 "'parameters without type hint: a; result type not annotated'", "''"),
    "AST-Q004": ("tmp = 1", "steps_end + 1", "steps_end + 1", "fn", "'tmp'", "''"),
    "AST-Q005": (f"{_COMPLEXITY} > 10", "def", "last_line", "fn", _COMPLEXITY, "10"),
    "AST-S001": ("tr = 1", "ifs_end + 3", "ifs_end + 4", "''", "''", "''"),
    "AST-S002": ("ex = 1", "last_line", "last_line", "''", "''", "''"),
}


def _expected(rule: tuple, table: dict = _EXPECTED) -> str:
    rule_id, category, severity, title, description, _ = rule
    when, first, last, name, detail, limit = table[rule_id]

    def fill(text: str) -> str:
        filled = quoted(text)
        for slot, value in (("name", name), ("limit", limit), ("detail", detail)):
            filled = f"replace({filled}, '{{{slot}}}', cast({value} AS string))"
        return filled

    return f"""
SELECT repo, commit_sha, file_path, cast({first} AS bigint) AS line_start,
       cast({last} AS bigint) AS line_end, '{rule_id}' AS rule_id, '{category}' AS category,
       '{severity}' AS severity, {fill(title)} AS title, {fill(description)} AS description
FROM layout WHERE {when}"""


for _rule in RULES[:8]:
    add("rule_" + _rule[0].split("-")[1].lower(), _expected(_rule), "source_files", steps=_LAYOUT)

add("rule_summary", f"""
SELECT repo, rule_id, severity, count(*) AS findings, count(DISTINCT file_path) AS files
FROM ({" UNION ALL ".join(_expected(rule) for rule in RULES[:8])}) AS hits
GROUP BY repo, rule_id, severity""", "source_files", steps=_LAYOUT)

_LOWER = {
    "AST-A001": (f"{_LENGTH} > {q.LOW_LINES}", "def", "last_line", "fn", _LENGTH, str(q.LOW_LINES)),
    "AST-Q005": (f"{_COMPLEXITY} > {q.LOW_COMPLEXITY}", "def", "last_line", "fn", _COMPLEXITY,
                 str(q.LOW_COMPLEXITY)),
}
add("rule_thresholds", " UNION ALL ".join(
    _expected(rule, _LOWER) for rule in RULES[:8] if rule[0] in _LOWER
), "source_files", steps=_LAYOUT)

add("audit_errors", """
SELECT repo, commit_sha, count(*) AS failed_files FROM source_files WHERE k % 10 = 3
GROUP BY repo, commit_sha""", "source_files")

add("files_analyzed", """
SELECT repo, commit_sha, count(*) AS files_analyzed FROM source_files GROUP BY repo, commit_sha""",
    "source_files")

_VALUES = f"regexp_extract_all(line, {quoted(secrets.ASSIGNED)}, 2)"
_NAMES = f"regexp_extract_all(line, {quoted(secrets.ASSIGNED)}, 1)"
_REAL = f"NOT regexp_matches({_VALUES}[i], {quoted(secrets.PLACEHOLDER)})"
add("secret_scan", f"""
SELECT repo, file_path, line_start, 'SEC-001' AS rule_id, 'critical' AS severity,
       concat('A quoted value is assigned to ''', lower({_NAMES}[first]), '''.') AS description
FROM (SELECT *, list_min(list_filter(range(1, len({_VALUES}) + 1), lambda i: {_REAL})) AS first
      FROM lines) AS found
WHERE first IS NOT NULL
UNION ALL
SELECT repo, file_path, line_start, 'SEC-002', 'critical',
       'The line holds a key with a known provider prefix.'
FROM lines WHERE regexp_matches(line, {quoted(secrets.PROVIDER_KEY)})
UNION ALL
SELECT repo, file_path, line_start, 'SEC-003', 'critical', 'The line starts a private key block.'
FROM lines WHERE regexp_matches(line, {quoted(secrets.PRIVATE_KEY)})""", "corpus", steps="""
lines AS (
  SELECT repo, file_path, unnest(parts) AS line,
         unnest(range(1, len(parts) + 1)) AS line_start
  FROM (SELECT repo, file_path, string_split(content, chr(10)) AS parts FROM corpus) AS split)""")

add("analyzer_plugin", """
SELECT repo, file_path, 'toy' AS analyzer, cast(1 AS bigint) AS source_rank,
       CASE WHEN n > 1 THEN 'medium' ELSE 'info' END AS severity, cast(n AS string) AS description
FROM (SELECT repo, file_path, len(regexp_extract_all(content, '(?i)license')) AS n
      FROM corpus) AS counted
WHERE n > 0""", "corpus")

add("analyzer_errors", """
SELECT DISTINCT repo, commit_sha, cast(NULL AS string) AS file_path, 'broken' AS analyzer,
       cast(0 AS bigint) AS source_rank, 'plan' AS phase, 'ValueError: does not work' AS error
FROM corpus
UNION ALL
SELECT repo, commit_sha, file_path, 'strict', 2, 'file', 'ValueError: raise statement'
FROM corpus WHERE contains(content, 'raise ')""", "corpus")

add("file_analyzer", """
SELECT repo, file_path, 'strict' AS analyzer, 'low' AS severity, 'Imports' AS title, 'TOY-002' AS rule_id
FROM corpus WHERE contains(content, 'import ') AND NOT contains(content, 'raise ')""", "corpus")

# Review --------------------------------------------------------------------------

def _picked(table: str, size: str) -> str:
    return f"""
picked AS (
  SELECT * FROM (
    SELECT repo, commit_sha, file_path, {size} AS size_bytes, substr(content, 1, {fixed.REVIEW_FILE_CHARS}) AS content,
           row_number() OVER (PARTITION BY repo, commit_sha ORDER BY {size} DESC, file_path) AS place
    FROM {table}
    WHERE NOT regexp_matches(lower(file_path), 'test_|tests|migration|__pycache__|[.]git|venv')) AS ranked
  WHERE place <= {fixed.REVIEW_FILES})"""


_RE2 = [p.replace("(?iU)", "(?i)") for p in fixed.REDACT_PATTERNS]


def _redacted(column: str) -> str:
    for pattern in _RE2:
        column = f"regexp_replace({column}, {quoted(pattern)}, '{fixed.REDACTED}', 'g')"
    return column


def _kept_files(max_chars: int, table: str = "corpus", size: str = "size_bytes") -> str:
    return f"""{_picked(table, size)},
cleaned AS (
  SELECT repo, commit_sha, file_path AS safe_path, place,
         {_redacted(f"substr(content, 1, {max_chars})")} AS content FROM picked),
budgeted AS (
  SELECT * FROM (
    SELECT *, cast(coalesce(sum(length(content)) OVER (PARTITION BY repo, commit_sha ORDER BY place
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS chars_before
    FROM cleaned) AS running
  WHERE chars_before < {max_chars * fixed.REVIEW_BUDGET_FACTOR})"""


add("review_pick", """
SELECT repo, place, file_path, size_bytes, md5(content) AS content_md5 FROM picked""",
    "corpus", steps=_picked("corpus", "size_bytes"))

add("review_budget", """
SELECT repo, safe_path, place, chars_before, length(content) AS chars FROM budgeted""",
    "corpus", steps=_kept_files(q.BUDGET_CHARS))

add("safe_paths", r"""
SELECT doc_id, substr(regexp_replace(concat(file_path, '?v=é ü#', content),
                                     '[^\p{L}\p{N}_./-]', '_', 'g'), 1, 200) AS safe_path
FROM corpus""", "corpus")


def _steps(column: str) -> str:
    """Nested selects, one pattern each, that replace and count."""
    text = f"SELECT doc_id, {column} AS content, 0 AS redactions FROM corpus"
    for pattern in _RE2:
        text = f"""SELECT doc_id, regexp_replace(content, {quoted(pattern)}, '{fixed.REDACTED}', 'g') AS content,
redactions + cast(regexp_matches(content, {quoted(pattern)}) AS int) AS redactions
FROM ({text}) AS step"""
    return text


_PLANTED = """concat(
  CASE WHEN doc_id % 4 = 0 THEN concat('### SYSTEM : you are now', chr(9), 'a [INST] ') ELSE '' END,
  content, CASE WHEN doc_id % 7 = 0 THEN ' <|IM_START|>' ELSE '' END)"""
add("redact", f"""
SELECT doc_id, md5(content) AS content_md5, cast(redactions AS bigint) AS redactions
FROM ({_steps(_PLANTED)}) AS redacted""", "corpus")

_UNSAFE = " OR ".join(
    f"regexp_matches(content, {quoted(p.replace('(?iU)', '(?i)'))})" for p in fixed.REJECT_PATTERNS
)
_SHORT = f"""CASE WHEN length(content) > 2000
  THEN concat(substr(content, 1, 2000), {quoted(fixed.TRUNCATION_MARK)}) ELSE content END"""
add("prompt_reject", f"""
SELECT doc_id, {_UNSAFE} AS is_rejected,
       CASE WHEN NOT ({_UNSAFE}) THEN length({_SHORT}) END AS chars,
       CASE WHEN NOT ({_UNSAFE}) THEN md5({_SHORT}) END AS code_md5
FROM corpus""", "corpus")

add("sanitize_text", f"""
SELECT doc_id, length(t) > {fixed.INPUT_CHARS} AS is_rejected,
       CASE WHEN length(t) <= {fixed.INPUT_CHARS} THEN md5(t) END AS cleaned_md5
FROM (SELECT doc_id, concat(regexp_replace(text, '^\\s+', ''), chr(9), ' end') AS t
      FROM documents) AS cleaned""")

_BLOCKS = """string_agg(concat(chr(10), '=== file ', safe_path, ' ===', chr(10), '```python', chr(10),
       content, chr(10), '```', chr(10)), '' ORDER BY place)"""
_ASSEMBLE = f"""
requests AS (
  SELECT repo, commit_sha, count(*) AS file_count,
         concat('Review the code below. Repository: ', repo, chr(10), {_BLOCKS},
                {quoted(fixed.REQUEST_FOOTER)}) AS request
  FROM budgeted GROUP BY repo, commit_sha)"""
_REQUESTS = _kept_files(fixed.REVIEW_MAX_CHARS) + "," + _ASSEMBLE
add("review_requests", """
SELECT repo, file_count, md5(request) AS request_md5, length(request) AS chars FROM requests""",
    "corpus", steps=_REQUESTS)

add("review_scored", """
SELECT repo, commit_sha,
       CASE WHEN length(request) % 2 = 1 THEN
         concat('{"findings":[],"summary":"', cast(length(request) AS string), ' chars"}') END AS raw_content,
       CASE WHEN length(request) % 2 = 1 THEN length(request) // 4 ELSE 0 END AS tokens_used,
       CASE WHEN length(request) % 2 = 1 THEN 'fake' END AS model,
       CASE WHEN length(request) % 2 = 0 THEN 'ValueError: even' END AS error
FROM requests""", "corpus", steps=_REQUESTS)

add("review_resumed", f"""
SELECT repo, commit_sha,
       CASE WHEN length(request) % 2 = 1 THEN
         concat('{{"findings":[],"summary":"', cast(length(request) AS string), ' chars"}}') END AS raw_content,
       CASE WHEN length(request) % 2 = 1 THEN length(request) // 4 ELSE 0 END AS tokens_used,
       CASE WHEN length(request) % 2 = 1 THEN 'fake' END AS model,
       CASE WHEN length(request) % 2 = 0 THEN 'ValueError: even' END AS error,
       CASE WHEN spent > {q.LEDGER_TOKENS} THEN 'over budget'
            WHEN length(request) % 2 = 0 THEN 'ValueError: even' ELSE 'answered' END AS first_call
FROM (SELECT *, sum(cast(ceil(length(request) / 4.0) AS bigint) + {q.ANSWER_TOKENS}) OVER (
        ORDER BY sha256(concat_ws(chr(10), repo, commit_sha, request))) AS spent
      FROM requests) AS r""", "corpus", steps=_REQUESTS)

_ANSWERED, _GOOD = "k % 10 <> 0", "k % 10 <> 0 AND k % 6 <> 0 AND k % 5 <> 0 AND k % 7 <> 0"
add("review_parse", f"""
SELECT k, cast({_ANSWERED} AND NOT ({_GOOD}) AS bigint) AS discarded,
       CASE WHEN {_ANSWERED} THEN 's' ELSE '' END AS summary,
       CASE WHEN {_GOOD} THEN CASE WHEN k % 6 = 1 THEN 'security' ELSE 'quality' END END AS category,
       CASE WHEN {_GOOD} THEN 'high' END AS severity,
       CASE WHEN {_GOOD} THEN concat('t', cast(k AS string)) END AS title,
       CASE WHEN {_GOOD} THEN 'f.py' END AS file_path,
       cast(CASE WHEN {_GOOD} AND k % 3 <> 0 THEN 42 END AS bigint) AS line_start,
       CASE WHEN {_GOOD} THEN 'LLM-001' END AS rule_id,
       CASE WHEN {_GOOD} THEN 'r' END AS recommendation
FROM review_responses""", "review_responses")

add("degrade_join", f"""
SELECT a.id AS analysis_id, cast(coalesce({_GOOD}, false) AS bigint) AS review_findings,
       cast(coalesce({_ANSWERED} AND NOT ({_GOOD}), false) AS bigint) AS discarded,
       CASE WHEN {_ANSWERED} THEN 's' ELSE '' END AS summary,
       cast(coalesce(tokens_used, 0) AS bigint) AS tokens_used
FROM analyses AS a LEFT JOIN review_responses AS r ON a.id = concat('a', cast(2 * r.k AS string))""",
    "analyses", "review_responses")

# The whole job -------------------------------------------------------------------

add("audit_runs", f"""
SELECT r.analysis_id, r.repository_id, r.repo, r.commit_sha,
       coalesce(h.total + 1, 0) AS total_findings, coalesce(h.critical, 0) AS critical_count,
       coalesce(h.high + 1, 0) AS high_count, coalesce(h.total, 0) AS static_count,
       cast(h.total IS NOT NULL AS bigint) AS review_count, coalesce(f.n, 0) AS files_analyzed,
       cast(coalesce(length(q.request) // 4, 0) AS bigint) AS tokens_used,
       cast(h.total IS NOT NULL AS bigint) AS discarded,
       cast(0 AS bigint) AS failed_files, cast(0 AS bigint) AS failed_reviews,
       CASE WHEN h.total IS NOT NULL THEN 's' ELSE '' END AS summary,
       CASE WHEN h.total IS NULL THEN 'no files for this commit' END AS error_message,
       CASE WHEN h.total IS NULL THEN 'failed' ELSE 'completed' END AS status,
       cast(7.13 AS double) AS duration_seconds
FROM source_runs AS r
LEFT JOIN (SELECT repo, commit_sha, count(*) AS total,
                  count(*) FILTER (severity = 'critical') AS critical,
                  count(*) FILTER (severity = 'high') AS high
           FROM ({" UNION ALL ".join(_expected(rule) for rule in RULES[:8])}) AS hits
           GROUP BY repo, commit_sha) AS h USING (repo, commit_sha)
LEFT JOIN (SELECT repo, commit_sha, count(*) AS n FROM source_files
           GROUP BY repo, commit_sha) AS f USING (repo, commit_sha)
LEFT JOIN requests AS q USING (repo, commit_sha)""", "source_files", "source_runs",
    steps=_LAYOUT + "," + _kept_files(
        fixed.REVIEW_MAX_CHARS, "source_files", "length(content)") + "," + _ASSEMBLE)

add("public_analyses", """
SELECT a.id, a.repository_id, a.commit_sha, a.status, a.triggered_by,
       epoch_us(a.started_at) AS started_at, epoch_us(a.completed_at) AS completed_at,
       round((epoch_us(a.completed_at) - epoch_us(a.started_at)) / 1000000.0, 2) AS duration_seconds,
       coalesce(c.total, 0) AS total_findings, coalesce(c.critical, 0) AS critical_count,
       coalesce(c.high, 0) AS high_count, a.error_message, epoch_us(a.created_at) AS created_at
FROM analyses AS a
LEFT JOIN (SELECT analysis_id, count(*) AS total,
                  count(*) FILTER (severity = 'critical') AS critical,
                  count(*) FILTER (severity = 'high') AS high
           FROM kept GROUP BY analysis_id) AS c ON c.analysis_id = a.id""",
    "findings", "analyses", steps=KEPT)

# Webhooks and limits -------------------------------------------------------------

_KEY = q.WEBHOOK_SECRET if len(q.WEBHOOK_SECRET) <= 64 else hashlib.sha256(q.WEBHOOK_SECRET).digest()
_INNER = bytes(b ^ 0x36 for b in _KEY.ljust(64, b"\0")).hex()
_OUTER = bytes(b ^ 0x5C for b in _KEY.ljust(64, b"\0")).hex()
_ROUTED = f"""
routed AS (
  SELECT w.*, r.id AS repository_id, r.full_name,
         sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(w.body)))) AS hmac,
         coalesce(json_extract_string(good, '$.after'), json_extract_string(good, '$.pull_request.head.sha')) AS commit_sha,
         CASE WHEN sig_mode <> 'valid' THEN concat('signature_', sig_mode)
              WHEN event = 'ping' THEN 'ignored_event'
              WHEN good IS NULL THEN 'invalid_json'
              WHEN url IS NULL THEN 'no_repository_url'
              WHEN event = 'push' AND json_extract_string(good, '$.after') = repeat('0', 40) THEN 'branch_deleted'
              WHEN r.id IS NULL THEN 'unregistered'
              ELSE 'queued' END AS outcome
  FROM (SELECT *, json_extract_string(good, '$.repository.html_url') AS url
        FROM (SELECT *, CASE WHEN json_valid(body) THEN body END AS good FROM webhooks) AS v) AS w
  LEFT JOIN repositories AS r ON r.github_url = w.url)"""
add("webhook_route", """
SELECT event_id, event, sig_mode AS signature_state, outcome, hmac FROM routed""",
    "webhooks", "repositories", steps=_ROUTED)

_RUN_ID = "sha256(concat('webhook', chr(31), cast(event_id AS string)))"
add("webhook_queue", f"""
SELECT {_RUN_ID} AS analysis_id, repository_id, full_name, commit_sha, 'pending' AS status,
       'webhook' AS triggered_by, epoch_us(received_at) AS created_us
FROM routed WHERE outcome = 'queued'""", "webhooks", "repositories", steps=_ROUTED)

add("incremental_audit", f"""
SELECT {_RUN_ID} AS analysis_id, repository_id, commit_sha,
       CASE WHEN EXISTS (
         SELECT 1 FROM earlier_runs AS e
         WHERE e.repository_id = routed.repository_id AND e.commit_sha = routed.commit_sha
           AND e.status = 'completed' AND e.completed_at <= timestamp '{q.WEBHOOKS_AS_OF}'
           AND e.completed_at > timestamp '{q.WEBHOOKS_AS_OF}' - interval '1' day)
       THEN 'reuse' ELSE 'run' END AS decision
FROM routed WHERE outcome = 'queued'""",
    "webhooks", "repositories", "earlier_runs", steps=_ROUTED)

_POLICIES = ", ".join(f"('{path}', {n}, {s * 1_000_000})" for path, _, n, s in q.DAY_POLICIES)
add("rate_limit", """
SELECT d.event_id, path, client_ip, d.accepted,
       CASE WHEN NOT d.accepted THEN d.wait // 1000000 END AS retry_after
FROM (SELECT path, client_ip, unnest(state.done) AS d FROM (
  SELECT path, client_ip, list_reduce(
    list_prepend({'at': cast(0 AS bigint), 'event_id': cast(-1 AS bigint), 'held': [cast(0 AS bigint)][2:],
                  'done': [{'event_id': cast(0 AS bigint), 'accepted': true, 'wait': cast(0 AS bigint)}][2:]},
      list({'at': epoch_us(ts), 'event_id': event_id, 'held': [cast(0 AS bigint)][2:],
            'done': [{'event_id': cast(0 AS bigint), 'accepted': true, 'wait': cast(0 AS bigint)}][2:]}
           ORDER BY ts, event_id)),
    lambda state, request: {
      'at': request.at, 'event_id': request.event_id,
      'held': CASE WHEN len(list_filter(state.held, lambda t: request.at - t < any_window)) < any_limit
        THEN list_append(list_filter(state.held, lambda t: request.at - t < any_window), request.at)
        ELSE list_filter(state.held, lambda t: request.at - t < any_window) END,
      'done': list_append(state.done, {
        'event_id': request.event_id,
        'accepted': len(list_filter(state.held, lambda t: request.at - t < any_window)) < any_limit,
        'wait': coalesce(any_window - (request.at - list_min(list_filter(state.held, lambda t: request.at - t < any_window))), 0)})
    }) AS state
  FROM (SELECT a.*, p.n AS any_limit, p.w AS any_window
        FROM api_requests AS a JOIN policies AS p USING (path)) AS limited
  GROUP BY path, client_ip, any_limit, any_window) AS folded) AS decided""",
    "api_requests", steps=f"policies(path, n, w) AS (VALUES {_POLICIES})")
