"""Mix sources to target weights with hash thresholds found in nested histograms.

Sizes are summed by source and hash bucket. The bucket in which a source's budget runs out is split
again by the next bits, so a threshold is found without sorting, and a smaller budget always takes
a subset of what a larger one takes. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.session import cut

#: The bits of a document's hash and those that one histogram tells apart.
HASH_BITS, LEVEL_BITS = 60, 12
WORDS = r"[^\x20\x09-\x0D]+"
#: Weights by the rank of a source, repeating.
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def hashed(key: Column) -> Column:
    """60 bits of the md5 of a key's text; a null key hashes as an empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """`source, source_size, target` from rows of `source, size`.

    Sources share `share` of all sizes by weight. A target ends at `most` times its source's size,
    and what is left over goes to the others by weight. With the sources in the order of cap by
    weight, all before some place are capped and the rest share evenly; that place is computed,
    not iterated. The window holds one row per source.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sources.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    )
    weight = F.element_at(
        F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights)).cast("int") + 1
    )
    capped = ranked.withColumns({"w": weight, "cap": most * F.col("source_size")})
    everywhere = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("w"), "rank").rowsBetween(
        Window.unboundedPreceding, -1
    )
    before = lambda c: F.coalesce(F.sum(c).over(order), F.lit(0.0))
    level = (share * F.sum("source_size").over(everywhere) - before("cap")) / (
        F.sum("w").over(everywhere) - before("w")
    )
    # the level of the first source whose cap is not below it; all are capped if there is none
    first = F.min(F.when(F.col("cap") / F.col("w") >= F.col("level"),
                         F.struct(F.col("cap") / F.col("w"), "rank", "level"))).over(everywhere)
    shared = F.coalesce(first["level"] * F.col("w"), F.col("cap"))
    return capped.withColumn("level", level).select(
        "source", F.col("source_size").cast("long"), F.least("cap", shared).alias("target")
    )


def thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """`source, budget_id, threshold`: rows of `sizes` with `h` below it fill the budget.

    `sizes` has `source, size, h`; `budgets` has `source, budget_id, budget` (double). Each level
    sums the rows of the boundary buckets only, by their next bits. The row (rows, if hashes
    are equal) on the boundary is taken if the total is then nearer to the budget. A budget of the
    whole source or more gets a threshold above all hashes.
    """
    state = budgets.select(
        "source", "budget_id", F.col("budget").alias("rest"), F.lit(0).cast("long").alias("prefix"),
        F.lit(True).alias("open"),
    )
    by_bucket = Window.partitionBy("source", "budget_id").orderBy("bucket")
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        above = shift + LEVEL_BITS
        inside = (
            sizes.alias("d")
            .join(state.filter("open").alias("s"), F.expr("d.source <=> s.source"))
            .filter(F.shiftright("d.h", above) == F.col("s.prefix") if above < HASH_BITS else F.lit(True))
        )
        bucket = F.shiftright("d.h", shift)
        histogram = inside.groupBy("s.source", "budget_id", "rest", bucket.alias("bucket")).agg(
            F.sum("d.size").alias("sum")
        )
        reached = histogram.withColumn("upto", F.sum("sum").over(by_bucket)).filter(
            F.col("upto") > F.col("rest")
        )
        boundary = reached.groupBy("source", "budget_id").agg(
            F.min_by(F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("sum")).alias("rest"),
                              "sum"), "bucket").alias("b")
        )
        found = (
            state.alias("s").join(
                boundary.alias("n"),
                F.expr("s.source <=> n.source AND s.budget_id = n.budget_id"), "left",
            )
        )
        still = F.col("s.open") & F.col("n.b").isNotNull()
        ended = F.col("s.open") & F.col("n.b").isNull()
        prefix = F.when(still, F.col("n.b.bucket")).when(
            ended, F.shiftleft(F.col("s.prefix") + 1, LEVEL_BITS)  # all of this bucket fits
            if above < HASH_BITS else F.lit(1 << LEVEL_BITS)
        ).otherwise(F.shiftleft("s.prefix", LEVEL_BITS))
        if shift == 0:  # one hash is left in the bucket
            nearer = still & (2 * F.col("n.b.rest") >= F.col("n.b.sum"))
            prefix = prefix + nearer.cast("long")
        state = cut(found.select(
            "s.source", "s.budget_id", prefix.alias("prefix"), still.alias("open"),
            F.when(still, F.col("n.b.rest")).otherwise(F.col("s.rest")).alias("rest"),
        ))
    return state.select("source", "budget_id", F.col("prefix").alias("threshold"))


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """`docs` with `size, source_size, target, copies, taken`; own columns of these names are replaced.

    Each document is taken `floor(target / source_size)` times, and once more if its hash is below
    the threshold for the rest. A null or empty text has size 0; a source without words has target
    0. Rows with equal `doc_id` have equal hashes and are taken alike. Null sources are one source. All
    other columns are kept, whatever their names.
    """
    replaced = ("size", "source_size", "target", "copies", "taken")
    own = [c for c in docs.columns if c not in replaced]
    sized = docs.select(
        F.struct(*own).alias("own"), F.col("source").alias("source"),
        words(F.col("text")).alias("size"), hashed(F.col("doc_id")).alias("h"),
    )
    narrow = cut(sized.select("source", "size", "h"))
    goal = cut(targets(narrow, weights, share, most))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
    goal = goal.withColumn("whole", F.coalesce(whole, F.lit(0)))
    rest = goal.select(
        "source", F.lit(0).alias("budget_id"),
        (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"),
    )
    limit = thresholds(narrow, rest).select("source", "threshold")
    plan = goal.alias("g").join(limit.alias("t"), F.expr("g.source <=> t.source")).select(
        F.col("g.source").alias("planned"), "source_size", "target", "whole", "threshold"
    )
    copies = F.col("whole") + (F.col("h") < F.col("threshold")).cast("long")
    return (
        sized.join(F.broadcast(plan) if _few(plan) else plan, F.expr("source <=> planned"))
        .withColumn("copies", F.when(F.col("source_size") > 0, copies).otherwise(0))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select(*(F.col("own").getField(c).alias(c) for c in own), *replaced)
    )


def repeated(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """The rows of `docs` as the mix takes them: none, one or several of each."""
    kept = F.struct(*docs.columns)  # whole, as the mix replaces some columns
    mixed = mix(docs.select("doc_id", "text", "source", kept.alias("_row")), weights, share, most)
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return mixed.filter("copies > 0").select("_row", times.alias("_time")).select("_row.*")


def _few(plan: DataFrame, rows: int = 10_000) -> bool:
    """Whether a table with a row per source is safe to broadcast (under a megabyte)."""
    return len(plan.take(rows + 1)) <= rows
