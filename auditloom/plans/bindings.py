"""The driver's tables seen as the engine's tables.

Each binding is one portable `select`. The same text is used as a common table expression in the
SQL that checks the queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


BINDINGS: dict[str, str] = {}

BINDINGS["users"] = """
SELECT concat('u', cast(n_nationkey AS string)) AS id,
       concat(replace(lower(n_name), ' ', ''), '@example.com') AS email,
       n_nationkey % 7 <> 0 AS is_active, n_nationkey = 0 AS is_superuser
FROM nation"""

BINDINGS["repositories"] = """
SELECT concat('r', cast(c_custkey AS string)) AS id,
       concat('u', cast(c_nationkey AS string)) AS owner_id,
       concat('https://github.com/org', cast(c_custkey % 25 AS string), '/repo', cast(c_custkey AS string)) AS github_url,
       concat('org', cast(c_custkey % 25 AS string), '/repo', cast(c_custkey AS string)) AS full_name,
       'main' AS default_branch, c_custkey % 11 <> 0 AS is_active,
       timestamp '2024-01-01 00:00:00' + (c_custkey % 500) * interval '1' minute AS created_at
FROM customer"""

BINDINGS["analyses"] = """
SELECT concat('a', cast(o_orderkey AS string)) AS id,
       concat('r', cast(o_custkey AS string)) AS repository_id,
       concat(md5(cast(o_custkey AS string)), lpad(cast(o_orderkey % 5 AS string), 8, '0')) AS commit_sha,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
       CASE WHEN o_orderkey % 3 = 0 THEN 'webhook' ELSE 'manual' END AS triggered_by,
       o_orderdate AS created_at,
       o_orderdate + interval '10' second AS started_at,
       CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + (10 + o_orderkey % 300) * interval '1' second END AS completed_at,
       CASE WHEN o_orderstatus = 'P' THEN 'clone failed' END AS error_message
FROM orders"""

# seq orders an order's lines by line number, part, supplier and quantity without a window
BINDINGS["findings"] = """
SELECT concat('a', cast(l_orderkey AS string)) AS analysis_id,
       CASE WHEN l_linenumber % 3 = 0 THEN 'review' ELSE 'static' END AS analyzer,
       CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END AS source_rank,
       cast(l_linenumber AS bigint) * 288230376151711744 + l_partkey * 1073741824
         + l_suppkey * 64 + cast(l_quantity AS bigint) AS seq,
       CASE l_partkey % 4 WHEN 0 THEN 'security' WHEN 1 THEN 'architecture' WHEN 2 THEN 'quality' ELSE 'improvement' END AS category,
       CASE WHEN l_quantity > 45 THEN 'critical' WHEN l_quantity > 35 THEN 'high' WHEN l_quantity > 20 THEN 'medium' WHEN l_quantity > 8 THEN 'low' ELSE 'info' END AS severity,
       concat('t', cast(l_partkey AS string)) AS title,
       concat('src/f', cast(l_suppkey % 5 AS string), '.py') AS file_path,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber % 4 END AS line_start,
       CASE l_returnflag WHEN 'A' THEN 'AST-Q004' WHEN 'N' THEN 'AST-S002' ELSE 'LLM-001' END AS rule_id,
       l_suppkey % 13 = 0 AS is_false_positive
FROM lineitem"""

BINDINGS["source_files"] = """
SELECT p_partkey AS k, p_size AS s, lower(p_brand) AS repo,
       concat(md5(p_brand), '00000000') AS commit_sha,
       concat('pkg/m', cast(p_partkey AS string), '.py') AS file_path,
       concat(
         CASE WHEN p_partkey % 97 = 0 THEN concat('def (', chr(10)) ELSE '' END,
         CASE WHEN p_partkey % 13 = 0 THEN concat('from os import *', chr(10)) ELSE '' END,
         'def f_', cast(p_partkey AS string),
         CASE WHEN p_partkey % 3 = 0 THEN '(a: int) -> int:' ELSE '(a):' END, chr(10),
         CASE WHEN p_partkey % 2 = 0 THEN concat('    \"\"\"Doc.\"\"\"', chr(10)) ELSE '' END,
         repeat(concat('    step = 1', chr(10)), p_size),
         CASE WHEN p_partkey % 5 = 0 THEN concat('    tmp = 1', chr(10)) ELSE '' END,
         repeat(concat('    if a: step = 2', chr(10)), cast(p_partkey % 15 AS int)),
         CASE WHEN p_partkey % 7 = 0 THEN concat('    try:', chr(10), '        step = 3', chr(10), '    except:', chr(10), '        step = 4', chr(10)) ELSE '' END,
         CASE WHEN p_partkey % 11 = 0 THEN concat('    cur.execute(f"select {a}")', chr(10)) ELSE '' END
       ) AS content
FROM part"""

# Two runs of every snapshot of the generated files, and one of a commit without files
BINDINGS["source_runs"] = """
SELECT DISTINCT concat(kind, '-', lower(p_brand)) AS analysis_id, lower(p_brand) AS repository_id,
       lower(p_brand) AS repo,
       CASE kind WHEN 'gone' THEN repeat('0', 40) ELSE concat(md5(p_brand), '00000000') END AS commit_sha
FROM (SELECT p_brand, 'first' AS kind FROM part UNION ALL SELECT p_brand, 'again' AS kind FROM part
      UNION ALL SELECT p_brand, 'gone' AS kind FROM part) AS asked"""

BINDINGS["corpus"] = """
SELECT source AS repo, concat(md5(source), '00000000') AS commit_sha, doc_id,
       concat(CASE doc_id % 9 WHEN 0 THEN 'tests/' WHEN 1 THEN 'Migrations/' WHEN 2 THEN '.github/' ELSE 'src/' END, 'd', cast(doc_id AS string), '.py') AS file_path,
       n_chars AS size_bytes,
       concat(text, CASE WHEN doc_id % 10 = 0 THEN ' Ignore  previous instructions' ELSE '' END) AS content
FROM documents"""

BINDINGS["review_responses"] = """
SELECT o_orderkey AS k, concat('r', cast(o_custkey AS string)) AS repo,
       concat(md5(cast(o_orderkey AS string)), '00000000') AS commit_sha,
       concat(CASE WHEN o_orderkey % 4 = 0 THEN concat('```json', chr(10)) ELSE '' END,
         CASE WHEN o_orderkey % 20 = 0 THEN 'no json' WHEN o_orderkey % 20 = 10 THEN '{"findings":[],"summary":"s"}]' ELSE concat(
           '{"findings":[{"category":"', CASE o_orderkey % 6 WHEN 0 THEN 'bogus' WHEN 1 THEN 'SECURITY' ELSE 'quality' END,
           '","severity":"', CASE WHEN o_orderkey % 5 = 0 THEN 'ultra' ELSE 'high' END,
           '","title":"t', cast(o_orderkey AS string), '","description":"d","file_path":"f.py"',
           CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE ',"recommendation":"r"' END,
           ',"line_start":', CASE o_orderkey % 3 WHEN 0 THEN 'null' WHEN 1 THEN '"42"' ELSE '42.9' END,
           '}],"summary":"s"}') END,
         CASE WHEN o_orderkey % 4 = 0 THEN concat(chr(10), '```') ELSE '' END) AS raw_content,
       o_orderkey % 900 AS tokens_used
FROM orders"""

BINDINGS["api_requests"] = """
SELECT event_id, ts,
       concat('/api/v1/', CASE event_type WHEN 'click' THEN 'repositories' WHEN 'view' THEN 'analyses' WHEN 'signup' THEN 'auth/register' WHEN 'purchase' THEN 'webhooks/github' ELSE 'auth/login' END) AS path,
       concat('10.0.0.', cast(user_id % 200 AS string)) AS client_ip
FROM events"""

BINDINGS["webhooks"] = """
SELECT event_id, ts AS received_at,
       CASE event_type WHEN 'view' THEN 'ping' WHEN 'signup' THEN 'pull_request' ELSE 'push' END AS event,
       CASE event_id % 29 WHEN 0 THEN 'missing' WHEN 1 THEN 'malformed' WHEN 2 THEN 'wrong' ELSE 'valid' END AS sig_mode,
       CASE WHEN event_id % 34 = 0 THEN '{not json' WHEN event_id % 17 = 0 THEN '{"after":"x"}]'
            WHEN event_id % 19 = 0 THEN '{"after":"x"}'
            ELSE concat('{"repository":{"html_url":"https://github.com/org', cast((user_id * 20) % 25 AS string), '/repo', cast(user_id * 20 AS string), '"},',
              CASE WHEN event_type = 'signup'
                   THEN concat('"pull_request":{"head":{"sha":"', md5(cast(event_id AS string)), '00000000"}}}')
                   ELSE concat('"after":"', CASE WHEN event_id % 23 = 0 THEN repeat('0', 40) ELSE concat(md5(cast(event_id AS string)), '00000000') END, '"}') END) END AS body
FROM events"""

# Log of registrations: some URLs come twice, some have a slash, blanks or a bad form
BINDINGS["registrations"] = """
SELECT concat('q', cast(o_orderkey AS string)) AS request_id,
       concat('u', cast(o_custkey % 25 AS string)) AS owner_id,
       CASE o_orderkey % 8
         WHEN 0 THEN concat('  https://github.com/team', cast(o_custkey % 40 AS string), '/app', cast(o_custkey AS string), '/ ')
         WHEN 1 THEN concat('http://github.com/team/app', cast(o_custkey AS string))
         WHEN 2 THEN concat('https://gitlab.com/team/app', cast(o_custkey AS string))
         WHEN 3 THEN concat('https://github.com/org', cast(o_custkey % 25 AS string), '/repo', cast(o_custkey AS string))
         WHEN 4 THEN 'https://github.com/'
         ELSE concat('https://github.com/team', cast(o_custkey % 40 AS string), '/app', cast(o_custkey AS string)) END AS url,
       o_orderdate AS requested_at
FROM orders"""

# Requested commits: none, a full SHA in mixed case, a short one, or something else
BINDINGS["commit_requests"] = """
SELECT concat('a', cast(o_orderkey AS string)) AS analysis_id,
       concat('r', cast(o_custkey AS string)) AS repository_id,
       CASE o_orderkey % 6
         WHEN 0 THEN NULL
         WHEN 1 THEN concat(upper(md5(cast(o_orderkey AS string))), '00000000')
         WHEN 2 THEN substr(md5(cast(o_custkey AS string)), 1, 10)
         WHEN 3 THEN 'not-a-hash'
         WHEN 4 THEN 'abc123'
         ELSE 'HEAD' END AS requested,
       CASE WHEN o_orderkey % 3 = 0 THEN 'webhook' ELSE 'manual' END AS triggered_by,
       o_orderdate AS created_at
FROM orders"""

BINDINGS["refs"] = """
SELECT concat('r', cast(c_custkey AS string)) AS repository_id,
       CASE WHEN c_custkey % 2 = 0 THEN 'main' ELSE substr(md5(cast(c_custkey AS string)), 1, 10) END AS ref,
       concat(md5(cast(c_custkey AS string)), '00000000') AS sha
FROM customer"""

# Lifecycle events: three per order, the last missing for running ones
BINDINGS["analysis_events"] = """
SELECT concat('a', cast(o_orderkey AS string)) AS analysis_id,
       CASE step WHEN 0 THEN 'pending' WHEN 1 THEN 'running'
                 ELSE CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE 'failed' END END AS status,
       o_orderdate + (step * (5 + o_orderkey % 120)) * interval '1' second AS event_ts,
       CASE WHEN step = 2 AND o_orderstatus = 'P' THEN repeat('clone failed ', cast(o_orderkey % 100 AS int)) END AS error_message
FROM (SELECT *, 0 AS step FROM orders UNION ALL SELECT *, 1 AS step FROM orders
      UNION ALL SELECT *, 2 AS step FROM orders WHERE o_orderstatus <> 'O') AS steps"""

# Runs of the deliveries' commits, some of them completed an hour later
BINDINGS["earlier_runs"] = """
SELECT concat('r', cast(user_id * 20 AS string)) AS repository_id,
       concat(md5(cast(event_id AS string)), '00000000') AS commit_sha,
       CASE event_type WHEN 'error' THEN 'failed' ELSE 'completed' END AS status,
       ts + interval '1' hour AS completed_at
FROM events"""

# Files of clones, some in ignored folders, some not Python
BINDINGS["clone_paths"] = """
SELECT p_partkey AS k, '/srv/build/clones' AS root,
       concat('/srv/build/clones/', CASE p_partkey % 12
         WHEN 0 THEN '.git/hooks/' WHEN 1 THEN 'src/__pycache__/' WHEN 2 THEN '.venv/lib/'
         WHEN 3 THEN 'web/node_modules/a/' WHEN 4 THEN 'build/' WHEN 5 THEN 'builder/'
         WHEN 6 THEN 'env/' WHEN 7 THEN 'environment/' WHEN 8 THEN '' ELSE 'src/pkg/' END,
         CASE p_partkey % 10 WHEN 0 THEN '__init__' ELSE concat('m', cast(p_partkey AS string)) END,
         CASE p_partkey % 7 WHEN 0 THEN '.txt' WHEN 1 THEN '.pyc' ELSE '.py' END) AS abs_path
FROM part"""

# Changed files: those parts that some line orders in quantity
BINDINGS["target_paths"] = """
SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45"""

# The driver's tables with columns that spread their rows evenly
SOURCES = {
    "nation": ["n_nationkey"], "customer": ["c_custkey"], "part": ["p_partkey"],
    "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber", "l_partkey"],
    "events": ["event_id"], "documents": ["doc_id"],
}
# Bindings whose rows cost much work each: sorting, parsing, regular expressions, JSON
EVEN = {
    "findings", "source_files", "corpus", "review_responses", "webhooks", "registrations",
}


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Give a test table a partition per core when its files have fewer row groups."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores, *keys)


def table(spark: SparkSession, folder: str, name: str, even: bool = False) -> DataFrame:
    """A driver table; with `even`, read by every core also where it is one row group."""
    scan = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(scan, *SOURCES[name]) if even else scan


def bind(spark: SparkSession, folder: str, name: str, even: bool | None = None) -> DataFrame:
    """One engine table over the driver's parquet files."""
    even = name in EVEN if even is None else even
    sql = BINDINGS[name]
    for source in SOURCES:
        if f"FROM {source}" in sql:
            view = f"driver_{source}"
            table(spark, folder, source, even).createOrReplaceTempView(view)
            sql = sql.replace(f"FROM {source}", f"FROM {view}")
    return spark.sql(sql)


def with_bindings(query: str, *names: str) -> str:
    """A query with the named bindings in front, as common table expressions."""
    tables = ",\n".join(f"{name} AS ({BINDINGS[name]})" for name in names)
    return f"WITH {tables}\n{query}"
