"""Appends that become visible as a whole."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.sources import commits

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("part", T.IntegerType())])


def rows(spark, low, high):
    return spark.range(low, high).select("id", (F.col("id") % 3).cast("int").alias("part"))


def ids(spark, table):
    return sorted(r.id for r in commits.committed(spark, table, SCHEMA).collect())


def test_readers_see_whole_jobs(spark, tmp_path):
    table = str(tmp_path / "t")
    assert ids(spark, table) == []
    commits.stage(rows(spark, 0, 5), table, ["part"])  # died before it was published
    assert ids(spark, table) == []
    assert commits.commit(rows(spark, 0, 5), table, "a", ["part"])
    assert not commits.commit(rows(spark, 0, 5), table, "a", ["part"])
    assert commits.commit(rows(spark, 5, 9), table, "b", ["part"])
    assert commits.commit(rows(spark, 0, 0), table, "empty", ["part"])
    assert ids(spark, table) == list(range(9))
    assert commits.committed(spark, table, SCHEMA).filter("part = 1").count() == 3


def test_a_failing_write_shows_nothing(spark, tmp_path):
    table = str(tmp_path / "t")
    bad = rows(spark, 0, 100).withColumn("id", F.when(F.col("id") == 99, F.raise_error(F.lit("killed")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="killed"):
        commits.commit(bad.repartition(4), table, "a", ["part"])
    assert ids(spark, table) == []
    assert commits.commit(rows(spark, 0, 100), table, "a", ["part"])
    assert ids(spark, table) == list(range(100))


def test_racing_repeats_count_once(spark, tmp_path):
    table = str(tmp_path / "t")
    for part in [commits.stage(rows(spark, 0, 4), table), commits.stage(rows(spark, 0, 4), table)]:
        commits.publish(spark, table, "a", part)
    assert ids(spark, table) == [0, 1, 2, 3]


def test_compaction(spark, tmp_path):
    table = str(tmp_path / "t")
    for i in range(4):
        commits.commit(rows(spark, 10 * i, 10 * i + 3), table, f"job {i}", ["part"])
    before = ids(spark, table)
    assert commits.compact(spark, table, SCHEMA, ["part"]) == 4
    assert commits.manifest(spark, table).count() == 1 and ids(spark, table) == before
    assert commits.compact(spark, table, SCHEMA, ["part"]) == 1
    # merged jobs are still known by name only to their rows' ids; a new job goes on top
    assert commits.commit(rows(spark, 100, 102), table, "later", ["part"])
    assert ids(spark, table) == [*before, 100, 101]


def test_compaction_of_odd_folders(spark, tmp_path):
    """Folders named by nulls, blanks and signs, of several columns; one file each afterwards; nothing at all."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("k", T.StringType()), T.StructField("n", T.IntegerType())])
    table, names = str(tmp_path / "t"), ["a b", "x/y=z%20", None, "é:*", "plain"]
    odd = spark.createDataFrame([(i, names[i % 5], None if i % 3 == 0 else i % 3) for i in range(60)], schema)
    for i in range(2):
        commits.commit(odd.filter(F.col("id") % 2 == i).repartition(3), table, f"job {i}", ["k", "n"])
    assert commits.compact(spark, table, schema, ["k", "n"]) == 2
    left = commits.committed(spark, table, schema)
    assert sorted(map(str, left.collect())) == sorted(map(str, odd.collect()))
    assert len(left.inputFiles()) == odd.select("k", "n").distinct().count()
    empty = str(tmp_path / "e")
    for i in range(2):
        commits.commit(odd.limit(0), empty, f"job {i}", ["k", "n"])
    assert commits.compact(spark, empty, schema, ["k", "n"]) == 2
    assert commits.committed(spark, empty, schema).count() == 0
