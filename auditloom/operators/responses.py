"""Review responses: clean, parse, validate, normalize. One pass, no shuffle."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom import fixed
from auditloom.functions import json
from auditloom.functions.text import SPACE, strip, truncate
from auditloom.schemas import FINDING_BODY, FINDINGS, SNAPSHOT_KEY

REVIEW_ANALYZER = "review"


def clean_response(raw: Column) -> Column:
    """Strip white space and code fences at the start and end of lines."""
    text = strip(raw)
    opened = F.regexp_replace(text, rf"(?mdU)^```(?:json)?{SPACE}*", "")
    closed = F.regexp_replace(opened, rf"(?mdU){SPACE}*```$", "")
    return F.when(text.contains("```"), closed).otherwise(text)


_OPTIONAL = ["line_start", "line_end", "rule_id"]
_TEXTS = {
    "title": fixed.TITLE_CHARS, "description": fixed.TEXT_CHARS, "file_path": fixed.PATH_CHARS,
    "recommendation": fixed.TEXT_CHARS,
}


def _members(item: Column) -> Column:
    """The wanted members of one item as variants; all null where it is no object."""
    return F.struct(*[json.field(item, n).alias(n) for n in [*fixed.RESPONSE_KEYS, *_OPTIONAL]])


def _read(members: Column) -> Column:
    """Texts and numbers of one item, and whether no required key is missing."""
    rule = truncate(json.as_text(members["rule_id"]), fixed.RULE_CHARS)
    values = {n: truncate(json.as_text(members[n]), c) for n, c in _TEXTS.items()}
    values |= {n: F.lower(json.as_text(members[n])) for n in ("category", "severity")}
    values |= {n: json.as_int(members[n]) for n in ("line_start", "line_end")}
    values["rule_id"] = F.coalesce(rule, F.lit(fixed.DEFAULT_REVIEW_RULE))
    return F.struct(*[values[n].alias(n) for n in FINDING_BODY.names])


def _is_valid(body: Column) -> Column:
    required = [body[n].isNotNull() for n in fixed.RESPONSE_KEYS]
    allowed = [body["category"].isin(fixed.CATEGORIES), body["severity"].isin(fixed.SEVERITIES)]
    return reduce(and_, [*required, *allowed])


def parse_responses(responses: DataFrame, raw: str = "raw_content") -> DataFrame:
    """Add `valid` (array of findings with their place), `discarded` and `summary`.

    Everything stays within the response's row, whose size the model's token limit bounds.
    """
    found = json.field(F.col("_doc"), "findings")
    usable = json.is_object(F.col("_doc")) & (found.isNull() | json.is_list(found))
    items = F.when(usable, F.coalesce(
        F.try_variant_get(found, "$", "array<variant>"), F.array().cast("array<variant>")
    ))
    summary = F.coalesce(json.as_text(json.field(F.col("_doc"), "summary")), F.lit(""))
    # each step reads a member once; later steps use its value
    bodies = F.transform(F.transform("_items", _members), _read)
    numbered = F.transform(
        "_bodies", lambda b, i: F.struct(i.cast("long").alias("seq"), b.alias("body"))
    )
    valid = F.filter(numbered, lambda n: _is_valid(n["body"]))
    nothing = F.array().cast(T.ArrayType(T.StructType(
        [T.StructField("seq", T.LongType()), T.StructField("body", FINDING_BODY)]
    )))
    return (
        responses.withColumn("_doc", json.parse(clean_response(F.col(raw))))
        .withColumn("_items", items)
        .withColumn("_bodies", bodies)
        .withColumn("valid", F.coalesce(valid, nothing))
        .withColumn("discarded", F.coalesce(F.size("_items"), F.lit(0)) - F.size("valid"))
        .withColumn("summary", F.when(F.col("_items").isNotNull(),
                                      truncate(summary, fixed.SUMMARY_CHARS)).otherwise(""))
        .drop("_doc", "_items", "_bodies")
    )


def review_findings(parsed: DataFrame, source_rank: int = 2) -> DataFrame:
    """Valid findings of parsed responses, as rows."""
    return parsed.select(*SNAPSHOT_KEY, F.inline("valid")).select(
        *SNAPSHOT_KEY,
        F.lit(REVIEW_ANALYZER).alias("analyzer"),
        F.lit(source_rank).alias("source_rank"),
        "seq", "body.*",
    ).select(*FINDINGS.names)


def join_responses(runs: DataFrame, parsed: DataFrame, key: list[str]) -> DataFrame:
    """Runs with what their review gave; no response means nothing found, nothing used."""
    columns = parsed.select(
        *key, F.size("valid").alias("review_findings"), "discarded", "summary", "tokens_used"
    )
    return runs.join(columns, key, "left").fillna(
        {"review_findings": 0, "discarded": 0, "summary": "", "tokens_used": 0}
    )
