"""URL filters: explicit rules first, then a path-template tree judged by labelled purity.

Per host, a path segment whose values hardly repeat becomes a wildcard. Branches of the resulting
tree whose labels do not differ from their parent's share its evidence; a template is rejected if
the smoothed share of good labels in its class is low. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.session import cut

#: From this segment on, the rest of a path that shares its node with no other path is one wildcard, as no
#: branches part there; a segment is variable if at its place there are `MIN_VALUES` values or more with under `MIN_REPEATS` pages on average.
DEPTH, MIN_VALUES, MIN_REPEATS = 6, 8, 5
#: Branches differ beyond this z score; weight of the corpus in smoothing; least purity.
DIFFERENT, SMOOTHING, MIN_PURITY = 3.0, 10.0, 0.5
#: Ranges of the share of bad labels within which branches that differ from their parent merge.
BINS = 5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"://([^/?#]*)([^?#]*)"

Rule = tuple[str, str, str]  # verdict, host, path


def host_of(url: Column) -> Column:
    """From the first `://` to `/`, `?`, `#` or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without a `://`."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def matched(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """The rule of the longest text that fits, as a struct of `verdict, rule`, or null.

    Among equally long ones the first by text wins.
    """
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(name + start).alias("rule"))).otherwise(found)
    return found


def templates(paths: DataFrame) -> DataFrame:
    """`host, path, nodes` for rows of `host, path, n`, where `nodes` are the tree's nodes from the root.

    A wildcard keeps the extension of its segment. One pass per level over the distinct paths, until none
    has a further segment; from `DEPTH` on, only over those that have one.
    """
    segments = F.split(F.regexp_replace("path", "^/", ""), "/")
    deepest = paths.agg(F.max(F.size(segments)).alias("most")).first()["most"] or 0
    done = []
    state = paths.select(
        "host", "path", "n", segments.alias("segments"), F.array(F.lit("")).alias("nodes"),
    )
    for level in range(1, deepest + 1):
        if level >= DEPTH:
            state = cut(state)
            done.append(state.filter(F.size("segments") < level))
            state = state.filter(F.size("segments") >= level)
            if state.isEmpty():
                break
        here = F.get("segments", F.lit(level - 1))
        node = F.element_at("nodes", -1)
        placed = state.withColumns({"node": node, "here": here})
        values = placed.filter("here IS NOT NULL").groupBy("host", "node", "here").agg(
            F.sum("n").alias("n"), F.count("*").alias("paths")
        )
        variable = (F.col("k") >= MIN_VALUES) & (F.col("n") < MIN_REPEATS * F.col("k"))
        alone = (F.col("paths") == 1) & F.lit(level >= DEPTH)
        kinds = (
            values.groupBy("host", "node")
            .agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("paths").alias("paths"))
            .select("host", "node", variable.alias("variable"), alone.alias("alone"))
            .filter("variable OR alone")
        )
        wild = F.concat(F.lit("*"), F.regexp_extract("here", r"\.[A-Za-z0-9]{1,5}$", 0))
        named = F.when(F.col("variable"), wild).otherwise(F.col("here"))
        rest = F.col("alone") & (F.size("segments") > level)
        named = F.when(rest, F.lit("**")).otherwise(named)
        state = placed.join(kinds, ["host", "node"], "left").select(
            "host", "path", "n",
            F.when(rest, F.slice("segments", 1, level)).otherwise(F.col("segments")).alias("segments"),
            F.when(F.col("here").isNull(), F.col("nodes")).otherwise(
                F.concat("nodes", F.array(F.concat("node", F.lit("/"), named)))
            ).alias("nodes"),
        )
    for part in done:
        state = state.unionByName(part)
    return cut(state.select("host", "path", "nodes"))


def judged_templates(counts: DataFrame) -> DataFrame:
    """`host, path, template, class_node, purity` for rows of `host, path, n, n_good, n_bad`.

    From the root down, a node joins its parent's class unless its share of bad labels differs from
    that class's beyond `DIFFERENT`; such siblings form a class for each of `BINS` ranges of their
    smoothed share. A class's purity is the share of good labels, smoothed by `SMOOTHING` labels of
    the corpus' share.
    """
    tree = templates(counts)
    leaves = cut(
        tree.alias("t").join(counts.alias("c"), ["host", "path"])
        .groupBy("host", "nodes").agg(F.sum("n_good").alias("good"), F.sum("n_bad").alias("bad"))
    )
    corpus = leaves.agg(
        F.coalesce((F.sum("good") + 1) / (F.sum("good") + F.sum("bad") + 2), F.lit(1.0)).alias("p")
    ).first()["p"]
    corpus = 1.0 if corpus is None else float(corpus)
    nodes = cut(
        leaves.select("host", "good", "bad", F.posexplode("nodes").alias("level", "node"), "nodes")
        .withColumn("parent", F.when(F.col("level") > 0, F.get("nodes", F.col("level") - 1)))
        .groupBy("host", "level", "parent", "node")
        .agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    )

    def rate(good: Column, bad: Column) -> Column:
        return (bad + SMOOTHING * (1 - corpus)) / (good + bad + SMOOTHING)

    known = nodes.filter("level = 0").select(
        "host", "node", F.col("node").alias("class_node"),
        rate(F.col("good"), F.col("bad")).alias("rate"),
    )
    classes = known
    deepest = nodes.agg(F.max("level").alias("most")).first()["most"] or 0
    for level in range(1, deepest + 1):
        children = nodes.filter(F.col("level") == level)
        parents = known.select(
            "host", F.col("node").alias("parent"), F.col("class_node").alias("above"),
            F.col("rate").alias("p"),
        )
        n = F.col("good") + F.col("bad")
        apart = F.abs(F.col("bad") - n * F.col("p")) > DIFFERENT * F.sqrt(
            n * F.col("p") * (1 - F.col("p"))
        )
        own = rate(F.col("good"), F.col("bad"))
        side = F.least(F.floor(own * BINS), F.lit(BINS - 1))
        judged = cut(children.join(parents, ["host", "parent"]).withColumn(
            "class_node",
            F.when(apart, F.concat("parent", F.lit("#"), side)).otherwise(F.col("above")),
        ).withColumn("apart", F.coalesce(apart, F.lit(False))))
        merged = judged.filter("apart").groupBy("host", "class_node").agg(
            rate(F.sum("good"), F.sum("bad")).alias("rate")
        )
        known = cut(judged.join(merged, ["host", "class_node"], "left").select(
            "host", "node", "class_node", F.when(F.col("apart"), F.col("rate")).otherwise(F.col("p")).alias("rate"),
        ))
        classes = classes.unionByName(known)
    placed = leaves.withColumn("node", F.element_at("nodes", -1)).join(
        classes.select("host", "node", "class_node"), ["host", "node"]
    )
    good, bad = F.sum("good"), F.sum("bad")
    purity = placed.groupBy("host", "class_node").agg(
        ((good + SMOOTHING * corpus) / (good + bad + SMOOTHING)).alias("purity")
    )
    template = placed.join(purity, ["host", "class_node"]).select(
        "host", F.col("node").alias("template"), "class_node", "purity"
    )
    return tree.select("host", "path", F.element_at("nodes", -1).alias("template")).join(
        template, ["host", "template"]
    )


def judge(pages: DataFrame, rules: Sequence[Rule], label: Column | str = "label") -> DataFrame:
    """`pages` with `host, path, rule, template, class_node, purity, verdict`; such columns are replaced.

    `label` is true (good), false (bad) or null for each row. Rules decide first; where none fits,
    `block` if the template's class has a purity below `MIN_PURITY`, else `allow`. A null url
    has an empty host and path, as has one without `://`; repeated urls count once per row. An
    empty table gives an empty result.
    """
    names = ("host", "path", "rule", "template", "class_node", "purity", "verdict", "_rule", "_label")
    flag = F.col(label) if isinstance(label, str) else label
    plain = pages.withColumn("_label", flag.cast("boolean"))
    plain = plain.drop(*(n for n in names if n != "_label"))
    parsed = plain.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    counts = cut(parsed.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.count_if(F.col("_label")).alias("n_good"),
        F.count_if(~F.col("_label")).alias("n_bad"),
    ))
    rule = matched(rules, F.col("host"), F.col("path"))
    verdict = F.when(F.col("_rule").isNotNull(), F.col("_rule.verdict")).when(
        F.col("purity") < MIN_PURITY, "block"
    ).otherwise("allow")
    return (
        parsed.join(judged_templates(counts), ["host", "path"], "left")
        .withColumn("_rule", rule)
        .select(
            *(c for c in plain.columns if c != "_label"), "host", "path",
            F.col("_rule.rule").alias("rule"), "template", "class_node", "purity",
            verdict.alias("verdict"),
        )
    )
