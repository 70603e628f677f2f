"""Rows that may have a known key, and what is shuffled of them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from auditloom.functions import slots
from auditloom.llm import ngram_join
from auditloom.llm.worker import ready
from auditloom.operators import findings
from auditloom.sources import commits


@pytest.mark.parametrize("bits", [6, 8, 27])
def test_known_keys_are_met(spark, monkeypatch, bits):
    monkeypatch.setattr(slots, "SLOT_BITS", bits)
    rows = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("id"), F.col("id").alias("n"))
    rows = rows.unionByName(rows.limit(1).withColumn("id", F.lit(None).cast("string")))
    known = rows.filter("n % 3 = 0 AND id IS NOT NULL").select("id")
    met = {r.n for r in slots.marked(rows, known, "id").filter("_met").collect()}
    assert met >= set(range(0, 3000, 3)) and (bits < 27 or len(met) < 1100)
    left = findings._without(rows, known).collect()
    assert sorted(r.n for r in left if r.id is not None) == [n for n in range(3000) if n % 3]
    assert sum(r.id is None for r in left) == 1  # a null id is equal to none


def test_a_folder_is_compacted_without_a_shuffle(spark, tmp_path):
    table, schema = str(tmp_path / "t"), "id long, part int"
    for job in "ab":
        own = spark.range(40).select("id", F.when(F.col("id") > 4, F.col("id") % 3).cast("int").alias("part"))
        commits.commit(own.repartition(4), table, job, ["part"])
    rows = commits.committed(spark, table, spark.createDataFrame([], schema).schema)
    merged = commits._folder_by_folder(rows, ["part"])
    assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString()
    placed = merged.select("part", F.spark_partition_id().alias("p")).distinct().collect()
    assert len(placed) == len({r.part for r in placed}) == 4  # a null part is one, too
    assert sorted(r.id for r in merged.collect()) == sorted([*range(40)] * 2)
    commits.compact(spark, table, rows.schema, ["part"])
    files = commits.committed(spark, table, rows.schema).inputFiles()
    assert len(files) == 4


@pytest.mark.parametrize("bits", [6, 27])
def test_near_duplicates_go_and_other_rows_stay(spark, monkeypatch, bits):
    monkeypatch.setattr(slots, "SLOT_BITS", bits)
    ready(spark)
    text = lambda n: " ".join(f"w{n * 1000 + i}" for i in range(60))
    rows = [(i, text(i), f"x{i}") for i in range(40)]
    near = [(100 + i, text(i) + " more", "near") for i in range(0, 40, 4)]
    odd = [(None, text(0), "none"), (7, None, "null"), (8, "", "empty"), (5, text(5), "x5")]
    docs = spark.createDataFrame(rows + near + odd, "doc_id long, text string, own string")
    kept = ngram_join.drop_near_duplicates(docs)
    want = rows + [(7, None, "null"), (8, "", "empty")]
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, spark.createDataFrame(want, docs.schema).collect()))
    assert kept.columns == docs.columns
