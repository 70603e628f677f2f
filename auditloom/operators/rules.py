"""Static rules over syntax facts, and the table of rule texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom import fixed
from auditloom.operators.facts import ASSIGN_SLOT, SLOT
from auditloom.schemas import FILE_KEY, FINDINGS

STATIC_ANALYZER = "python_rules"

# rule, category, severity, title, description, recommendation
RULES = [
    ("AST-Q001", "quality", "medium", "Wildcard import",
     "'from {detail} import *' hides which names the module uses.",
     "Import the needed names from '{detail}' one by one."),
    ("AST-A001", "architecture", "medium", "Function '{name}' is too long ({detail} lines)",
     "Function '{name}' has {detail} lines, above the limit of {limit}.",
     "Split it into smaller functions with one task each."),
    ("AST-Q002", "quality", "low", "Function '{name}' has no docstring",
     "Public function '{name}' is not documented.",
     "Describe its purpose, parameters and result in a docstring."),
    ("AST-Q003", "quality", "low", "Function '{name}' lacks type hints",
     "In '{name}': {detail}.",
     "Annotate every parameter and the result."),
    ("AST-Q004", "quality", "low", "Generic variable name '{detail}'",
     "Variable '{detail}' in function '{name}' says little about its content.",
     "Give '{detail}' a name that tells what it holds."),
    ("AST-Q005", "quality", "high", "Function '{name}' is too complex ({detail})",
     "Function '{name}' has a cyclomatic complexity of {detail}, above the limit of {limit}.",
     "Move branches to helper functions or a dispatch table."),
    ("AST-S001", "security", "high", "Bare except",
     "'except:' also catches SystemExit and KeyboardInterrupt and can hide errors.",
     "Name the exception types to catch."),
    ("AST-S002", "security", "critical", "SQL built from strings",
     "A query is built with an f-string, + or %, which allows SQL injection.",
     "Pass values as query parameters."),
    ("SEC-001", "security", "critical", "Hard-coded credential",
     "A quoted value is assigned to '{name}'.",
     "Read the value from the environment or a secret store."),
    ("SEC-002", "security", "critical", "Provider access key in source",
     "The line holds a key with a known provider prefix.",
     "Revoke the key and keep its successor in a secret store."),
    ("SEC-003", "security", "critical", "Private key in source",
     "The line starts a private key block.",
     "Replace the key pair and keep the private key out of the repository."),
]
RULE_FIELDS = [
    "rule_id", "category", "severity",
    "title_template", "description_template", "recommendation_template",
]


def rule_dimension(spark: SparkSession) -> DataFrame:
    """The rule table: a fixed handful of rows, so it can always be broadcast."""
    rows = ", ".join(
        "(" + ", ".join("'" + value.replace("'", "\\'") + "'" for value in rule) + ")"
        for rule in RULES
    )
    return spark.sql(f"SELECT * FROM VALUES {rows} AS rules({', '.join(RULE_FIELDS)})")


def _hit(
    rule_id: str,
    when: Column,
    slot: int = 0,
    name: Column | None = None,
    detail: Column | None = None,
    limit: int | None = None,
) -> Column:
    """Struct for a rule that holds on a fact, null otherwise."""
    text = F.lit("")
    return F.when(when, F.struct(
        F.lit(rule_id).alias("rule_id"),
        (F.col("seq") + slot * SLOT).alias("seq"),
        (text if name is None else name).alias("name"),
        (text if detail is None else detail.cast("string")).alias("detail"),
        F.lit("" if limit is None else str(limit)).alias("limit"),
    ))


def _rule_hits(max_lines: int, max_complexity: int) -> list[Column]:
    kind, name, fn_name = F.col("kind"), F.col("name"), F.col("fn_name")
    is_function = kind == "function"
    length = F.col("end_line") - F.col("line") + 1
    missing = F.col("missing_params")
    no_return = ~F.col("has_return") & (name != "__init__")
    hints = F.concat_ws(
        "; ",
        F.when(F.size(missing) > 0,
               F.concat(F.lit("parameters without type hint: "), F.concat_ws(", ", missing))),
        F.when(no_return, F.lit("result type not annotated")),
    )
    complexity = F.col("complexity")
    return [
        _hit("AST-Q001", (kind == "import_from") & (name == "*"), detail=F.col("module")),
        _hit("AST-A001", is_function & (length > max_lines), 0, name, length, max_lines),
        _hit("AST-Q002", is_function & ~name.startswith("_") & ~F.col("has_doc"), 1, name),
        _hit("AST-Q003", is_function & ((F.size(missing) > 0) | no_return), 2, name, hints),
        # the fact's own seq already sits in ASSIGN_SLOT, between Q003 and Q005
        _hit("AST-Q004", (kind == "assign") & name.isin(fixed.GENERIC_NAMES), 0, fn_name, name),
        _hit("AST-Q005", is_function & (complexity > max_complexity), ASSIGN_SLOT + 1,
             name, complexity, max_complexity),
        _hit("AST-S001", (kind == "handler") & F.col("is_bare")),
        _hit("AST-S002", (kind == "call") & name.isin(fixed.SQL_METHODS)
             & F.col("arg0_kind").isin(fixed.SQL_TEXT_KINDS)),
    ]


def build_findings(hits: DataFrame, analyzer: str, source_rank: int) -> DataFrame:
    """Attach the rule texts to hits (file key, seq, rule_id, line_start, line_end, name, ...)."""
    def fill(template: str) -> Column:
        text = template
        for slot in ("name", "limit", "detail"):
            text = f"replace({text}, '{{{slot}}}', {slot})"
        return F.expr(text)

    rules = rule_dimension(hits.sparkSession)
    return hits.join(F.broadcast(rules), "rule_id").select(
        "repo", "commit_sha",
        F.lit(analyzer).alias("analyzer"),
        F.lit(source_rank).alias("source_rank"),
        "seq", "category", "severity",
        fill("title_template").alias("title"),
        fill("description_template").alias("description"),
        "file_path", "line_start", "line_end", "rule_id",
        fill("recommendation_template").alias("recommendation"),
    ).select(*FINDINGS.names)


def rule_findings(
    facts: DataFrame,
    max_lines: int = fixed.MAX_FUNCTION_LINES,
    max_complexity: int = fixed.MAX_COMPLEXITY,
    source_rank: int = 0,
) -> DataFrame:
    """Findings of all eight rules in one pass over the facts."""
    hits = F.filter(F.array(*_rule_hits(max_lines, max_complexity)), lambda hit: hit.isNotNull())
    rows = facts.filter(F.col("kind") != "file").select(
        *FILE_KEY,
        F.col("line").alias("line_start"),
        F.col("end_line").alias("line_end"),
        F.inline(hits),
    )
    return build_findings(rows, STATIC_ANALYZER, source_rank)


def files_analyzed(facts: DataFrame) -> DataFrame:
    """Files that count as analyzed, per snapshot: parsed ones and those with a syntax error."""
    files = facts.filter((F.col("kind") == "file") & (F.col("parse_status") != "error"))
    return files.groupBy("repo", "commit_sha").agg(F.count("*").alias("files_analyzed"))


def files_failed(facts: DataFrame) -> DataFrame:
    """Files per snapshot that could not be read or parsed for another reason than their syntax."""
    failed = facts.filter((F.col("kind") == "file") & (F.col("parse_status") == "error"))
    return failed.groupBy("repo", "commit_sha").agg(F.count("*").alias("failed_files"))
