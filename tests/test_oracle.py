"""Every registered query against its SQL twin on the smallest tables."""

import os
import re

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.QUERIES, entry.SQL


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        problem = compare(spark, con, name, QUERIES[name], SQL[name], SF)
        assert problem in (None, "empty result"), problem
    else:
        assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["item_id", "doc_id", "score", "rank"] and rows.count() > 0


def test_names():
    assert not [n for n in QUERIES if "pipeline" in n or re.match(r"op\d", n)]
    assert set(SQL) <= set(QUERIES)
