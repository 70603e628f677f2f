"""Quality rules as a ledger of failure bits, policies over the bits, and their ablations.

Every rule is evaluated once per document. The ledger keeps its measurements and one bit per failed
rule; a policy is a mask of bits, so a new policy version or an ablation never reads a text again.
Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space, the symbols that are counted, the length of a repeat window.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Policy:
    """A version and the names of the rules that reject a document."""

    version: str
    rules: tuple[str, ...]


def rules() -> dict[str, Column]:
    """Name to failure test, in the order of the bits. Append only: bits are stored."""
    words = F.col("n_words")
    return {
        "few_words": words < 20,
        "repeats": 100 * F.col("n_repeat_words") > 30 * words,
        "symbols": 10 * F.col("n_symbols") > words,
        "repeated_lines": 2 * F.col("n_dup_lines") > F.col("n_lines"),
        "long_words": F.col("word_chars") > 15 * words,
        "short_words": F.col("word_chars") < 2 * words,
    }


BASE = ("few_words", "repeats")
POLICIES = {
    "v1": Policy("v1", BASE),
    "v2": Policy("v2", (*BASE, "symbols", "repeated_lines", "long_words", "short_words")),
}


def _bound(value: Column, then) -> Column:
    """`then(value)` with `value` computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _repeated(windows: Column) -> Column:
    """Words that windows found twice or more cover, from the windows' hashes in order."""
    def covered(at: Column) -> Column:
        gaps = F.transform(
            F.slice(at, 2, F.size(at)),
            lambda p, i: F.least(p - F.element_at(at, i + 1), F.lit(WINDOW)),
        )
        return F.when(F.size(at) == 0, 0).otherwise(
            F.aggregate(gaps, F.lit(WINDOW), lambda total, gap: total + gap)
        )

    def positions(ordered: Column) -> Column:
        last = F.size(ordered) - 1
        same = lambda i, j: F.get(ordered, i)["h"] == F.get(ordered, j)["h"]
        kept = F.filter(
            ordered,
            lambda e, i: ((i > 0) & same(i, F.greatest(i - 1, F.lit(0))))
            | ((i < last) & same(i, F.least(i + 1, last))),
        )
        return F.array_sort(F.transform(kept, lambda e: e["p"]))

    placed = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(
        _bound(F.array_sort(placed), lambda x: _bound(positions(x), covered))
    )


def measure(docs: DataFrame) -> DataFrame:
    """`docs` with the columns of `MEASURES` (long), replacing columns of these names.

    A null or empty text has no words and no lines. A line counts if it has a word, and is a
    duplicate if it equals an earlier one. Repeated rows are measured each for itself.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))

    def joined(hashes: Column, ahead: int) -> Column:
        """Hash of each hash and the one `ahead` places on: of twice as many words."""
        return F.transform(
            F.slice(hashes, 1, F.greatest(F.size(hashes) - ahead, F.lit(0))),
            lambda h, i: F.xxhash64(h, F.get(hashes, i + ahead)),
        )

    def windows(w: Column) -> Column:
        single = F.transform(w, lambda x: F.xxhash64(x))
        return _bound(single, lambda one: _bound(joined(one, 1), lambda two: _bound(
            joined(two, 2), lambda four: joined(four, 4))))

    long = lambda c: c.cast("long")
    by_words = _bound(words, lambda w: F.struct(
        long(F.size(w)).alias("n_words"),
        long(F.length(F.array_join(w, ""))).alias("word_chars"),
        long(_bound(windows(w), _repeated)).alias("n_repeat_words"),
    ))
    by_lines = _bound(lines, lambda x: F.struct(
        long(F.size(x)).alias("n_lines"),
        long(F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
    ))
    found = F.struct(
        by_words.alias("w"), by_lines.alias("l"),
        long(F.regexp_count(text, F.lit(SYMBOLS))).alias("n_symbols"),
    )
    plain = docs.drop(*MEASURES, "_m")
    return plain.select("*", F.explode(F.array(found)).alias("_m")).select(
        *plain.columns, "_m.w.n_words", "_m.w.word_chars", "_m.n_symbols", "_m.l.n_lines",
        "_m.l.n_dup_lines", "_m.w.n_repeat_words",
    )


def ledger(docs: DataFrame, tests: Mapping[str, Column] | None = None) -> DataFrame:
    """`measure(docs)` with `failed` (long): bit i is set if rule i fails."""
    tests = rules() if tests is None else tests
    bits = [F.when(test, F.lit(1 << i)).otherwise(0) for i, test in enumerate(tests.values())]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return measure(docs).withColumn("failed", total.cast("long"))


def mask(names, tests: Mapping[str, Column] | None = None) -> int:
    order = list(rules() if tests is None else tests)
    return sum(1 << order.index(name) for name in names)


def apply_policy(entries: DataFrame, policy: Policy) -> DataFrame:
    """Ledger entries with `policy_version` and `kept`: no rule of the policy failed."""
    rejected = F.col("failed").bitwiseAND(F.lit(mask(policy.rules)))
    return entries.withColumns({"policy_version": F.lit(policy.version), "kept": rejected == 0})


def ablations(entries: DataFrame, policies=tuple(POLICIES.values())) -> DataFrame:
    """Per policy and rule: `n_failed`, and `n_only`, the documents it alone rejects.

    The ledger is reduced to one row per pattern of bits first (at most 2 to the number of rules).
    """
    patterns = entries.groupBy("failed").count()
    masks = F.array(*(
        F.struct(
            F.lit(p.version).alias("policy_version"), F.lit(name).alias("rule"),
            F.lit(mask(p.rules)).cast("long").alias("m"),
            F.lit(mask([name])).cast("long").alias("bit"),
        )
        for p in policies for name in p.rules
    ))
    hit = F.col("failed").bitwiseAND(F.col("x.m"))
    only = F.when(hit == F.col("x.bit"), F.col("count")).otherwise(0)
    some = F.when(hit.bitwiseAND(F.col("x.bit")) != 0, F.col("count")).otherwise(0)
    return (
        patterns.select("*", F.explode(masks).alias("x"))
        .groupBy("x.policy_version", "x.rule")
        .agg(F.sum(some).alias("n_failed"), F.sum(only).alias("n_only"))
    )
