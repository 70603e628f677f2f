"""Near duplicates by Jaccard similarity of word n-grams, joined on adaptive multi-match prefixes.

All n-grams are ordered by how often they occur, rare ones first. Two documents that are similar enough
share at least `l` n-grams among the first `n - required + l` of each, for any `l`. Each document
chooses the `l` with the least estimated cost: a longer prefix is looked up more often, but asks for
more shared n-grams before a pair is verified. N-grams that occur once never travel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions.slots import marked
from auditloom.llm.components import components
from auditloom.llm.words import (
    Shared, distinct, hash_words, mix, of_windows, sequences, shared_names, steps,
)
from auditloom.llm.worker import given_back
from auditloom.session import cut

#: Words of an n-gram, least similarity in percent, required matches a document can choose from.
WORDS, PERCENT, MATCHES = 5, 75, (1, 2, 4, 8, 16)
#: Estimated cost of verifying a pair, per n-gram, against 1 for a look-up; occurrences assumed for
#: an n-gram that is shared, but not heavy.
VERIFY_COST, LIGHT = 0.1, 3.0
#: Classes that one task compares with as many others.
BLOCK = 512

_U = np.uint64


def ngram_sets(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, one after another, and how many each has.

    ASCII capitals count as small letters. A text with fewer words than an n-gram has one for all of
    them, and one without words none.
    """
    hashes, counts = hash_words(column, fold=True)
    grams, owner, _ = of_windows(hashes, counts, words)
    first = np.cumsum(counts) - counts
    for n in range(1, words):
        short = np.flatnonzero(counts == n)
        if len(short):
            whole = sequences(hashes, n, seed=100 + n)[first[short]]
            grams, owner = np.concatenate([grams, whole]), np.concatenate([owner, short])
    if len(owner) and np.any(owner[1:] < owner[:-1]):
        order = np.argsort(owner, kind="stable")
        grams, owner = grams[order], owner[order]
    return distinct(grams, np.bincount(owner, minlength=len(counts)))


def choose_prefix(ranks: np.ndarray, percent: int = PERCENT) -> tuple[int, np.ndarray]:
    """Required matches and the places of the prefix's shared n-grams, from each n-gram's rank.

    Rank 0 is an n-gram that occurs once: it fills the prefix, but is not needed in it. Higher ranks
    are 1 plus the logarithm of the number of occurrences.
    """
    n = len(ranks)
    spare = n - -(-percent * n // 100)
    alone = int(np.count_nonzero(ranks == 0))
    if alone > spare:
        return 1, np.zeros(0, np.int64)
    order = np.argsort(ranks, kind="stable")
    often = np.where(ranks[order] > 1, np.exp2(ranks[order].astype(np.float64) - 1), LIGHT)
    often[:alone] = 0
    upto = np.cumsum(often)
    best, chosen = np.inf, 1
    for matches in MATCHES:
        if spare + matches > n:
            break
        looked_up = upto[spare + matches - 1]
        cost = looked_up + VERIFY_COST * n * looked_up / matches
        if cost < best:
            best, chosen = cost, matches
    return chosen, order[alone : spare + chosen]


PREFIXES = "doc_id long, n long, cls long, matches int, popular double, grams array<long>, ngrams binary"


def prefixes(docs: DataFrame, shared: Shared, words: int, percent: int) -> DataFrame:
    """One row of `PREFIXES` per document.

    `cls` names the set (null for an empty one); `grams` and `ngrams`, the whole set, are null
    where the prefix shows that no other document can be similar.
    """
    table = docs.sparkSession.sparkContext.broadcast((shared.bits, shared.levels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Shared(*table.value)
        for batch in batches:
            for step in steps(batch, 1):
                grams, sizes = ngram_sets(step.column(1), words)
                ranks = np.where(known.contains(grams), known.level(grams) + np.uint8(1), np.uint8(0))
                ends = np.cumsum(sizes)
                mixed = np.zeros(len(grams) + 1, np.uint64)
                np.cumsum(mix(grams ^ _U(0x5851F42D4C957F2D)), out=mixed[1:])
                cls = mix(mixed[ends] - mixed[ends - sizes] + sizes.astype(np.uint64)).view(np.int64)
                matches, popular = np.ones(len(sizes), np.int32), np.zeros(len(sizes))
                places, sets = [], []
                for i, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist())):
                    if a < b:
                        matches[i], at = choose_prefix(ranks[a:b], percent)
                    if a < b and len(at):
                        popular[i] = ranks[a:b].mean()
                        places.append(grams[a:b][at].view(np.int64).tolist())
                        sets.append(grams[a:b].tobytes())
                    else:
                        places.append(None)
                        sets.append(None)
                yield pa.RecordBatch.from_arrays([
                    step.column(0), pa.array(sizes, pa.int64()), pa.array(cls, mask=sizes == 0),
                    pa.array(matches), pa.array(popular), pa.array(places, pa.list_(pa.int64())),
                    pa.array(sets, pa.binary()),
                ], ["doc_id", "n", "cls", "matches", "popular", "grams", "ngrams"])

    return docs.mapInArrow(given_back(run), PREFIXES)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The `pairs` (`a, b`) whose sets (`cls, n, ngrams`) are similar enough."""
    left = sets.select(F.col("cls").alias("a"), F.col("ngrams").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("ngrams").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= percent * (len(both) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    whole = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return cut(whole.mapInArrow(given_back(run), "a long, b long"))


def _alike(percent: int, one: str, other: str):
    """Whether two sizes allow the similarity."""
    return F.expr(f"100 * least({one}, {other}) >= {percent} * greatest({one}, {other})")


def _leaders(postings: DataFrame, percent: int) -> DataFrame:
    """`a, b`: each class `b` with the leader `a` it shares most n-grams with.

    The leader of an n-gram is the class with the most popular n-grams that has it. Only one row per
    n-gram is looked up, so a hot n-gram costs as much as its rows.
    """
    order = F.struct("popular", "cls", "component", "n")
    leader = postings.groupBy("gram").agg(F.max(order).alias("top"), F.count("*").alias("k"))
    met = (
        postings.alias("p").join(leader.filter("k > 1").alias("l"), "gram")
        .filter("p.component <> l.top.component")
        .filter(_alike(percent, "p.n", "l.top.n"))
        .groupBy(F.col("p.cls").alias("b"), F.col("l.top.cls").alias("a")).count()
    )
    return met.groupBy("b").agg(F.max_by("a", F.struct("count", "a")).alias("a")).select("a", "b")


def _overlaps(own: list[np.ndarray], others: list[np.ndarray]):
    """For each set of `own`, how many grams it shares with each of `others`."""
    sizes = np.array([len(x) for x in others], np.int64)
    grams = np.concatenate(others)
    member = np.repeat(np.arange(len(others)), sizes)
    order = np.argsort(grams, kind="stable")
    grams, member = grams[order], member[order]
    for x in own:
        low, high = np.searchsorted(grams, x, "left"), np.searchsorted(grams, x, "right")
        count = high - low
        spot = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        yield np.bincount(member[np.repeat(low, count) + spot], minlength=len(others)), sizes


def _links_by_leader(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between classes of one leader that are still in different components.

    `placed` has `cls, component, leader`. Only classes outside the leader's component ask; they are
    compared with all of their leader's classes, in blocks of at most about `BLOCK` each.
    """
    main = placed.filter("cls = leader").select("leader", F.col("component").alias("main"))
    asked = placed.join(main, "leader").withColumn("asks", F.col("component") != F.col("main"))
    sizes = asked.groupBy("leader").agg(
        F.count("*").alias("k"), F.count_if("asks").alias("o")
    ).filter("o > 0").select(
        "leader", F.ceil(F.col("k") / BLOCK).cast("int").alias("parts"),
        F.ceil(F.col("o") / BLOCK).cast("int").alias("turns"),
    )
    spread = asked.join(sizes, "leader").withColumns({
        "part": F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"),
        "turn": F.pmod(F.xxhash64("cls", F.lit(1)), F.col("turns")).cast("int"),
    })
    count = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    kind = "array<struct<part: int, turn: int, asks: boolean>>"
    compared = F.transform(count("turns"), lambda t: F.struct("part", t, F.lit(False))).cast(kind)
    asking = F.transform(count("parts"), lambda p: F.struct(p, "turn", F.lit(True))).cast(kind)
    some = F.when(F.col("asks"), F.concat(compared, asking)).otherwise(compared)
    roles = spread.select("leader", "cls", "component", F.inline(some))
    rows = roles.join(sets.select("cls", "ngrams"), "cls")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        asks = group["asks"].to_numpy(bool)
        read = lambda x: [np.frombuffer(b, np.uint64) for b in x["ngrams"]]
        one, other = group[asks], group[~asks]
        a, b = [], []
        if len(one) and len(other):
            cls, component = other["cls"].to_numpy(), other["component"].to_numpy()
            for own, home, x, (common, sizes) in zip(
                one["cls"], one["component"], read(one), _overlaps(read(one), read(other))
            ):
                hit = (100 * common >= percent * (len(x) + sizes - common)) & (component != home)
                _, first = np.unique(component[hit], return_index=True)
                b += cls[hit][first].tolist()  # one link into each component suffices
                a += [own] * len(first)
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return cut(rows.groupBy("leader", "part", "turn").applyInPandas(run, "a long, b long"))


def link_classes(reps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """`id, component` of all linked classes; `reps` has one row per class with a prefix.

    Classes are first linked to the leader with which they share most n-grams, a linear round. Classes of
    one leader that are then still in different components are compared in blocks, and those of
    different leaders are joined by the n-grams of their prefixes. So no link is lost, while a large
    group of copies is not expanded into its pairs.
    """
    grams = reps.select("cls", "n", "matches", "popular", F.explode("grams").alias("gram"))
    led = cut(_leaders(grams.withColumn("component", F.col("cls")), percent))
    links = verified(led, reps, percent)
    found = components(links).withColumnRenamed("id", "cls")
    placed = cut(
        reps.select("cls").join(found, "cls", "left")
        .join(led.select(F.col("b").alias("cls"), F.col("a").alias("leader")), "cls", "left")
        .select("cls", F.coalesce("component", "cls").alias("component"),
                F.coalesce("leader", "cls").alias("leader"))
    )
    # a leader belongs to its own classes, too
    own = placed.unionByName(
        placed.filter("cls <> leader").withColumn("leader", F.col("cls"))
    )
    own = own.join(placed.select("leader").distinct(), "leader", "left_semi")
    links = links.unionByName(_links_by_leader(own, reps, percent))
    postings = cut(grams.join(placed, "cls"))
    several = postings.groupBy("gram").agg(
        F.min("component").alias("a"), F.max("component").alias("b"),
        F.min("leader").alias("x"), F.max("leader").alias("y"),
    ).filter("a <> b AND x <> y").select("gram")
    open_ = postings.join(several, "gram")
    pairs = (
        open_.alias("a").join(open_.alias("b"), "gram")
        .filter("a.cls < b.cls AND a.component <> b.component AND a.leader <> b.leader")
        .filter(_alike(percent, "a.n", "b.n"))
        .groupBy(F.col("a.cls").alias("a"), F.col("b.cls").alias("b"))
        .agg(F.count("*").alias("k"), F.min(F.least("a.matches", "b.matches")).alias("least"))
        .filter("k >= least").select("a", "b")
    )
    return components(links.unionByName(verified(pairs, reps, percent)))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """`doc_id, n_shingles, class_id, component_id` for each row of `docs` (`doc_id, text`).

    Documents with equal sets form a class; classes link when 100 times their common n-grams are
    `percent` times those of either or more. `component_id` is the least `doc_id` reachable. An empty
    set (null text, no words) links with nothing and has its own `doc_id`; repeated rows and
    ids are rows of one class; null ids are never least unless alone. Other columns are ignored.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = shared_names(
        plain.select("text"), lambda step: ngram_sets(step.column(0), words)[0]
    )
    base = cut(prefixes(plain, shared, words, percent))
    reps = cut(base.filter("grams IS NOT NULL").drop("doc_id").dropDuplicates(["cls"]))
    found = link_classes(reps, percent).withColumnRenamed("id", "cls")
    classes = base.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("first"))
    joined = classes.join(found, "cls", "left").withColumn(
        "component", F.coalesce("component", "cls")
    )
    least = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    named = cut(joined.join(least, "component").select("cls", "component_id"))
    return base.select("doc_id", "n", "cls").join(named, "cls", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("cls").alias("class_id"),
        F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        .alias("component_id"),
    )


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs` that are the first of their component, by `doc_id` (null last).

    Rows without words are components of their own and stay. Of rows equal in `doc_id` and `text` one
    stays. All columns are kept.
    """
    keyed = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    rows = keyed.select(F.col("_row").alias("doc_id"), "text")
    found = near_duplicates(rows, words, percent).select(
        F.col("doc_id").alias("_row"), "component_id"
    )
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    ids = keyed.select("_row", "doc_id").groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"), F.count("*").alias("times")
    )
    members = cut(found.distinct().join(ids, "_row"))
    first = members.groupBy("component_id").agg(F.min_by("_row", order).alias("_row"))
    # rows that go or come several times; all others stay where they are
    touched = cut(
        members.join(first.select("_row", F.lit(True).alias("stays")), "_row", "left")
        .filter("stays IS NULL OR times > 1")
        .select("_row", F.col("stays").isNotNull().alias("stays"), (F.col("times") > 1).alias("several"))
    )
    split = marked(keyed, touched.select("_row"), "_row")
    met = split.filter("_met").join(touched, "_row", "left").filter(F.coalesce("stays", F.lit(True)))
    if not touched.filter("stays AND several").isEmpty():
        met = met.dropDuplicates(["_row"])
    return split.filter("NOT _met").unionByName(met.select(*split.columns)).select(*docs.columns)
