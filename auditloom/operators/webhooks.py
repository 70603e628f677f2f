"""Webhook deliveries: verify, route, queue. Row-wise but for one join, so batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom import fixed
from auditloom.functions import json
from auditloom.functions.signature import signature_state


def read_payloads(deliveries: DataFrame, secret: bytes) -> DataFrame:
    """Add the signature's state and what the body says: url, commit and any early outcome."""
    text = F.col("body").cast("string")
    repository = json.field(F.col("_doc"), "repository")
    pull = json.field(F.col("_doc"), "pull_request")
    head = json.field(pull, "head")
    is_push = F.col("event") == "push"

    def broken(value):
        return value.isNotNull() & ~json.is_object(value)

    read = (
        deliveries.withColumn("signature_state",
                              signature_state(F.col("body"), F.col("signature"), secret))
        .withColumn("_doc", json.parse(F.when(F.is_valid_utf8(text), text)))
        .withColumn("github_url", F.try_variant_get(repository, "$.html_url", "string"))
        .withColumn("commit_sha", F.when(is_push, F.try_variant_get(F.col("_doc"), "$.after",
                                                                    "string"))
                    .otherwise(F.try_variant_get(head, "$.sha", "string")))
    )
    outcome = (
        F.when(F.col("signature_state") != "valid",
               F.concat(F.lit("signature_"), F.col("signature_state")))
        .when(~F.coalesce(F.col("event").isin(fixed.ROUTED_EVENTS), F.lit(False)), "ignored_event")
        .when(F.col("_doc").isNull(), "invalid_json")
        .when(~json.is_object(F.col("_doc")) | broken(repository), "invalid_payload")
        .when(F.coalesce(F.col("github_url"), F.lit("")) == "", "no_repository_url")
        .when(is_push & (F.col("commit_sha") == fixed.DELETED_BRANCH_SHA), "branch_deleted")
        .when(~is_push & (broken(pull) | broken(head)), "invalid_payload")
    )
    return read.withColumn("_early", outcome).drop("_doc")


def route(deliveries: DataFrame, repositories: DataFrame, secret: bytes) -> DataFrame:
    """Each delivery with its `outcome`; `queued` ones also have a repository and commit."""
    known = repositories.select(
        F.col("github_url"), F.col("id").alias("repository_id"), "full_name"
    )
    joined = read_payloads(deliveries, secret).join(known, "github_url", "left")
    outcome = (
        F.when(F.col("_early").isNotNull(), F.col("_early"))
        .when(F.col("repository_id").isNull(), "unregistered")
        .when(F.col("commit_sha").isNull(), "missing_commit")
        .otherwise("queued")
    )
    return joined.withColumn("outcome", outcome).drop("_early")


def queued_analyses(routed: DataFrame) -> DataFrame:
    """One pending run per accepted delivery; the id follows from the delivery's."""
    return routed.filter(F.col("outcome") == "queued").select(
        F.sha2(F.concat_ws("\x1f", F.lit("webhook"), F.col("event_id").cast("string")), 256)
        .alias("analysis_id"),
        "repository_id", "full_name", "commit_sha",
        F.lit("pending").alias("status"),
        F.lit("webhook").alias("triggered_by"),
        F.col("received_at").alias("created_at"),
    )
