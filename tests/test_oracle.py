"""Every registered query against its SQL twin, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from checks import oracle, queries
from checks.compare import compare, connect

QUERIES, TWINS = queries.registered(), oracle.statements()


def test_twins_belong_to_queries():
    assert set(TWINS) <= set(QUERIES) <= set(entry.queries())
    assert set(QUERIES) - set(TWINS) == {"search_ann", "search_ann_stored"}


@pytest.fixture(scope="module")
def con(small_tables):
    return connect(small_tables)


@pytest.mark.skipif(bool(os.environ.get("SHELFMARK_QUICK")), reason="quick run")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, small_tables, name):
    good, line = compare(spark, con, small_tables, name, QUERIES[name], TWINS.get(name))
    assert good, line


def test_entry(spark):
    assert entry.entry(spark).count() > 0
