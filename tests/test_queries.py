"""Every registered query against its SQL."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from check_oracle import database, difference

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = entry.QUERIES, entry.ORACLE

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    return database(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, connection, name):
    assert difference(QUERIES[name](spark, FOLDER), connection, ORACLE[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
