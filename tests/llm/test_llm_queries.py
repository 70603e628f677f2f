"""Every training-data query against its SQL, and the pipeline stage by stage."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline
from auditloom.llm.queries import ORACLE, QUERIES
from check_oracle import database, difference

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, connection, name):
    assert difference(QUERIES[name](spark, FOLDER), connection, ORACLE[name]) is None


def test_names():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(corpus_pipeline.cut(stage(spark, tables[-1], FOLDER)))
    assert all(t.columns == columns for t in tables[:-1])
    ids = [{r.doc_id for r in t.select("doc_id").distinct().collect()} for t in tables]
    assert all(b <= a for a, b in zip(ids, ids[1:])) and ids[4] == ids[5]
    counts = [t.count() for t in tables]
    assert counts[0] > counts[1] > counts[3] > 0 and counts[3] == len(ids[3])
    assert corpus_pipeline.run(spark, FOLDER).count() == counts[-1]
