"""Benchmark decontamination: a broadcast hash set of the items' word windows meets all document windows.

Only DataFrame functions. An item's words are cut into windows of ten (a shorter item is one window). Every
window of a document is hashed, and a join with the windows' hashes leaves the hits, which are then verified
word by word. What is left moves once, by document. The windows are broadcast while they are few; beyond
that Spark joins both sides by hash.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.session import cut

#: Fixed value: what a word is, once A-Z are lower-cased.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fixed value: what stands between words, A-Z as they are.
OTHER = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
#: Words of a window; windows and bytes of them that are broadcast at most.
WINDOW, BROADCAST_WINDOWS, BROADCAST_BYTES = 10, 400_000, 64 << 20


def words(text: Column) -> Column:
    """The words of a text with A-Z lower-cased; none of a null."""
    folded = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(F.regexp_extract_all(folded, F.lit(WORDS), F.lit(0)), F.array().cast("array<string>"))


def _name(of: Column, start: Column, size: int) -> Column:
    """Hash of `size` words from a place on. Single items are read: a slice would copy the text's words."""
    return F.xxhash64(*(F.get(of, start + j) for j in range(size)))


def _names(of: Column, size: int) -> Column:
    """Hashes of all windows of `size` words, by their place; none if there are fewer words."""
    places = F.when(F.size(of) >= size, F.sequence(F.lit(0), F.size(of) - size))
    return F.coalesce(F.transform(places, lambda i: _name(of, i, size)), F.array().cast("array<bigint>"))


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """`name, words, window, items`: a hash, its window's words and the sorted ids of the items with it.

    Null ids are not listed; an item without words has no window.
    """
    own = F.col("own")
    items = benchmark.select("item_id", words(F.col("text")).alias("own")).filter(F.size("own") > 0)
    length = F.least(F.size(own), F.lit(size))
    placed = items.select(
        F.col("item_id").cast("string").alias("item"), own, length.alias("words"),
        F.explode(F.sequence(F.lit(0), F.size(own) - length)).alias("place"),
    )
    # at most as many ids as the benchmark has items
    found = placed.select("item", "words", F.slice("own", F.col("place") + 1, F.col("words")).alias("window")).groupBy(
        "words", "window"
    ).agg(F.array_sort(F.collect_set("item")).alias("items"))
    name = F.coalesce(*(F.when(F.col("words") == n, _name(F.col("window"), F.lit(0), n)) for n in range(1, size + 1)))
    return found.select(name.alias("name"), "words", "window", "items")


def _covered(found: DataFrame, size: int) -> DataFrame:
    """`found` with `spans`: the disjoint places (`low` to below `high`) that `hits` (`start, words`) cover.

    Each step is a column of its own, so that none is made again for every element of the next.
    """
    def longest(x: Column, i: Column) -> Column:
        return (i == F.size("ordered") - 1) | (F.get("ordered", i + 1)["start"] != x["start"])

    def span(x: Column, i: Column) -> Column:
        # only the `size - 1` starts before can reach this far
        before = [F.get("longest", i - j) for j in range(1, size)]
        reach = F.greatest(F.lit(0), F.lit(0), *(b["start"] + b["words"] for b in before))
        low = F.greatest(x["start"], reach)
        return F.struct(low.alias("low"), F.greatest(low, x["start"] + x["words"]).alias("high"))

    return (
        found.withColumn("ordered", F.array_sort("hits"))
        .withColumn("longest", F.filter("ordered", longest))
        .withColumn("spans", F.transform("longest", span))
        .withColumn("spans", F.filter("spans", lambda s: s["high"] > s["low"]))
    )


def scan(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """`doc_id, text_md5, n_words, spans, items, n_rows`: one row for all rows with equal id and text.

    `spans` are the disjoint places (`low` to below `high`, from 0) of the words inside any occurrence of
    an item's window, `items` the sorted ids of the items with occurring windows. Texts are told apart by
    their MD5 (128 bits).
    """
    known = cut(item_windows(benchmark, size))
    bound = known.agg(
        F.count("*").alias("n"), F.sum(F.length(F.to_json(F.struct("window", "items")))).alias("bytes"),
        F.collect_set("words").alias("sizes"),  # `size` values at most
    ).first()
    sizes = sorted(bound["sizes"])
    if bound["n"] <= BROADCAST_WINDOWS and (bound["bytes"] or 0) <= BROADCAST_BYTES:
        known = F.broadcast(known)
    own = F.col("own")
    split = docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), words(F.col("text")).alias("own"))
    names = [_names(own, n) for n in sizes]
    none = F.array(F.lit(None).cast("long"))  # one row that stays for each document
    # the lists are never empty; an inner explode would be preceded by a filter that makes them twice
    placed = split.withColumn("names", F.concat(*names, none)).select(
        "doc_id", "text_md5", "own", F.size("own").alias("n_words"), F.posexplode_outer("names").alias("place", "name")
    )
    before, start, same = F.lit(0), F.lit(None).cast("int"), F.lit(False)
    for n in sizes:  # windows of one size follow those of the smaller ones
        own_size, at = F.col("words") == n, F.col("place") - before
        start = F.when(own_size, at).otherwise(start)
        equal = F.lit(True)
        for j in range(n):
            equal &= F.get(own, at + j) == F.get("window", F.lit(j))
        same |= own_size & equal
        before = before + F.greatest(F.col("n_words") - n + 1, F.lit(0))
    met = placed.join(known, "name", "left").filter(F.col("name").isNull() | same).withColumn("start", start)
    hit = F.when(F.col("name").isNotNull(), F.struct("start", "words"))
    found = met.groupBy("doc_id", "text_md5").agg(
        F.first("n_words").alias("n_words"), F.count(F.when(F.col("name").isNull(), 1)).alias("n_rows"),
        F.collect_set(hit).alias("hits"), F.collect_set("items").alias("lists"),
    )
    return _covered(found, size).select(
        "doc_id", "text_md5", "n_words", "spans",
        F.array_sort(F.array_distinct(F.flatten("lists"))).alias("items"), "n_rows",
    )


def report(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """`doc_id, n_words, n_hit, n_items, items_sha256, contaminated` for each row of `docs`.

    A null or empty text has no words, a repeated row is counted like its equals, an empty benchmark hits
    nothing; other columns are ignored. Very long texts are whole rows: their windows become rows
    one at a time and only hits are gathered.
    """
    n_hit = F.aggregate("spans", F.lit(0), lambda a, s: a + s["high"] - s["low"])
    return scan(docs, benchmark, size).withColumn(
        "row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows")))
    ).select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, whole: bool = False, size: int = WINDOW) -> DataFrame:
    """`docs` without the hit words, each with what separates it from the next, or without hit documents.

    Clean rows stay as they are, all columns are kept. With `whole`, a document with a hit goes; without,
    one of hit words only keeps what stands before its first word.
    """
    found = scan(docs, benchmark, size).filter(F.size("spans") > 0).select("doc_id", "text_md5", "spans")
    row = F.struct(*docs.columns).alias("row")  # whole, so that no name clashes
    keyed = docs.select(F.col("doc_id").alias("own_id"), F.md5(F.col("text").cast("binary")).alias("own_md5"), row)
    same = F.expr("own_id <=> doc_id AND own_md5 <=> text_md5")
    if whole:
        return keyed.join(found, same, "left_anti").select("row.*")
    text = F.col("row.text")
    tokens = F.regexp_extract_all(text, F.lit(f"[^{OTHER}]+[{OTHER}]*"), F.lit(0))
    lead = F.regexp_extract(text, f"^[{OTHER}]*", 0)
    joined = keyed.join(found, same, "left").withColumn("tokens", tokens)

    def stays(s: Column, i: Column) -> Column:
        before = F.coalesce(F.get("spans", i - 1)["high"], F.lit(0))
        return F.concat(F.array_repeat(F.lit(True), s["low"] - before), F.array_repeat(F.lit(False), s["high"] - s["low"]))

    joined = joined.withColumn("stay", F.flatten(F.transform("spans", stays)))  # words after the last span stay
    kept = F.filter("tokens", lambda t, i: F.coalesce(F.get("stay", i), F.lit(True)))
    cleaned = F.when(F.col("spans").isNull(), text).otherwise(F.concat(lead, F.array_join(kept, "")))
    return joined.select(*(
        (cleaned if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns
    ))
