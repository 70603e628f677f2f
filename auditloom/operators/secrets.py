"""Hard-coded secrets, line by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.operators.rules import build_findings
from auditloom.schemas import FILE_KEY

SECRET_ANALYZER = "secrets"

# Our own patterns
ASSIGNED = (
    r"(?i)(password|passwd|pwd|secret|api_key|token)[\"']?\s*(?::\s*[A-Za-z_][\w.,| \[\]]*)?"
    r"[:=]\s*[\"']([^\"'\s]{4,})[\"']"
)
PROVIDER_KEY = (
    r"\b(AKIA[0-9A-Z]{16}|ghp_[0-9A-Za-z]{36}|sk_live_[0-9A-Za-z]{16,}"
    r"|xox[bp]-[0-9A-Za-z-]{10,}|AIza[0-9A-Za-z_-]{35})\b"
)
PRIVATE_KEY = r"-----BEGIN ([A-Z]+ )?PRIVATE KEY-----"
PLACEHOLDER = r"(?i)example|changeme|placeholder|^<.*>$|^\$\{.*\}$|^[x*]+$"


def secret_findings(files: DataFrame, source_rank: int = 1) -> DataFrame:
    """One finding per line and rule.

    A cheap test of the whole text comes first, so only suspect files are split into lines.
    """
    suspect = F.col("content").rlike(f"{ASSIGNED}|{PROVIDER_KEY}|{PRIVATE_KEY}")
    split = F.when(suspect, F.split("content", "\n"))
    lines = files.select(
        *FILE_KEY, F.posexplode_outer(split).alias("pos", "line")
    ).filter(F.col("pos").isNotNull())
    line = F.col("line")
    values = F.regexp_extract_all(line, F.lit(ASSIGNED), F.lit(2))
    names = F.regexp_extract_all(line, F.lit(ASSIGNED), F.lit(1))
    real = F.filter(
        F.arrays_zip(names.alias("name"), values.alias("value")),
        lambda pair: ~pair["value"].rlike(PLACEHOLDER),
    )

    def hit(order: int, rule_id: str, when: Column, name: Column) -> Column:
        return F.when(when, F.struct(
            F.lit(rule_id).alias("rule_id"),
            (F.col("pos").cast("long") * 4 + order).alias("seq"),
            name.alias("name"),
        ))

    hits = F.array(
        hit(0, "SEC-001", F.size(real) > 0, F.lower(F.get(real, F.lit(0))["name"])),
        hit(1, "SEC-002", line.rlike(PROVIDER_KEY), F.lit("")),
        hit(2, "SEC-003", line.rlike(PRIVATE_KEY), F.lit("")),
    )
    number = (F.col("pos") + 1).cast("int")
    rows = lines.select(
        *FILE_KEY,
        number.alias("line_start"), number.alias("line_end"),
        F.lit("").alias("detail"), F.lit("").alias("limit"),
        F.inline(F.filter(hits, lambda h: h.isNotNull())),
    )
    return build_findings(rows, SECRET_ANALYZER, source_rank)
