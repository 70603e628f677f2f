"""Connected components of links as Spark rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.session import cut


def components(links: DataFrame) -> DataFrame:
    """`id, component` for every end of `links` (`a, b`, long): the least id reachable.

    Large-star and small-star steps in turn (Kiveris et al. 2014): each replaces links by links to a
    smaller neighbour and keeps what is connected, until all links are stars. A step is an aggregate
    that combines before it moves and a join that can split a hot id; what a step made is written
    to the checkpoint folder. Loops and repeated links do not matter; null ends are left out.
    """
    edges = cut(
        links.select(F.col("a").cast("long"), F.col("b").cast("long"))
        .filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("k"), F.least("a", "m").alias("m")
        )
        # large star: every larger neighbour of k goes to the least of k's neighbourhood
        large = edges.join(least, F.col("b") == F.col("k")).filter("a <> m").select(
            F.col("a"), F.col("m").alias("b")
        ).distinct()
        large = cut(large)
        # small star: all smaller neighbours of a, and a itself, go to the least of them
        smallest = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        joined = large.join(smallest, F.col("a") == F.col("k"))
        small = joined.select(
            F.explode(F.array(
                F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                F.struct(F.col("a"), F.col("m").alias("b")),
            )).alias("e")
        ).select("e.a", "e.b").filter("a <> b").distinct()
        edges = cut(small)
        now = edges.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    ends = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return ends.unionByName(roots)
