"""Claims on commits: while one run audits a commit, other requests for it wait or reuse.

A claim is a row (`schemas.CLAIMS`) in a table of commits. It holds until its run has ended, or for a time to
live, so a run that died blocks nobody for longer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom import fixed
from auditloom.schemas import CLAIMS
from auditloom.session import cut
from auditloom.sources import commits

COMMIT = ["repository_id", "commit_sha"]


def live_claims(claims: DataFrame, ended: DataFrame, as_of: Column,
                seconds: int = fixed.RUN_SECONDS) -> DataFrame:
    """The claim that holds each commit at `as_of`: neither `ended` (`analysis_id`) nor older than `seconds`."""
    age = F.unix_micros(as_of) - F.unix_micros("claimed_at")
    young = claims.filter((age >= 0) & (age < seconds * 1_000_000))
    held = young.join(ended.select("analysis_id").distinct(), "analysis_id", "left_anti")
    first = held.groupBy(*COMMIT).agg(F.min(F.struct("claimed_at", "analysis_id")).alias("c"))
    return first.select(*COMMIT, F.col("c.analysis_id").alias("holder"))


def decide(requests: DataFrame, live: DataFrame, fresh: DataFrame) -> DataFrame:
    """Add `decision` and `holder` (the run that audits the commit; null for reuse).

    reuse: the commit is in `fresh`; wait: another run holds it; run: this one does. Of the requests for a
    free commit the first by `created_at` and `analysis_id` runs. A request without a known commit
    runs and holds nothing. Requests are reduced to one row per commit before any join, so a commit
    asked for very often meets one row.
    """
    asked = requests.groupBy(*COMMIT).agg(
        F.min(F.struct(F.col("created_at").cast("timestamp"), "analysis_id")).alias("first")
    )
    state = (
        asked.join(live, COMMIT, "left")
        .join(fresh.select(*COMMIT).distinct().withColumn("_fresh", F.lit(True)), COMMIT, "left")
        .select(*COMMIT, "_fresh", F.coalesce("holder", F.col("first.analysis_id")).alias("_holder"))
        .filter("repository_id IS NOT NULL AND commit_sha IS NOT NULL")
    )
    rest = [c for c in requests.columns if c not in ("decision", "holder")]
    own = F.col("_holder").isNull() | (F.col("_holder") == F.col("analysis_id"))
    return requests.join(state, COMMIT, "left").select(
        *rest,
        F.when(F.col("_fresh"), "reuse").when(own, "run").otherwise("wait").alias("decision"),
        F.when(F.col("_fresh").isNull(), F.coalesce("_holder", "analysis_id")).alias("holder"),
    )


def take(
    requests: DataFrame, table: str, job: str, fresh: DataFrame, ended: DataFrame, as_of: Column,
    seconds: int = fixed.RUN_SECONDS,
) -> DataFrame:
    """Decide a batch of requests and commit the claims of those that run.

    The claims are there before the first run starts. A repeated `job` finds its own claims and decides
    as before. One batch at a time decides.
    """
    spark = requests.sparkSession
    live = live_claims(commits.committed(spark, table, CLAIMS), ended, as_of, seconds)
    decided = cut(decide(requests, live, fresh))
    taken = decided.filter("decision = 'run' AND repository_id IS NOT NULL AND commit_sha IS NOT NULL")
    new = taken.join(live.select(F.col("holder").alias("analysis_id")), "analysis_id", "left_anti")
    commits.commit(
        new.select("analysis_id", *COMMIT, as_of.cast("timestamp").alias("claimed_at")), table, job
    )
    return decided
