"""Every registered query against its SQL on the smallest driver tables."""

import os

import pytest

import __spark_entry__ as entry
from earmark.plans import registry
from tests.oracle import compare, connect

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = registry.QUERIES, registry.ORACLES      # imported with the entry; others have tests of their own


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, note = compare(spark, con, SF_DIR, QUERIES[name], SQL.get(name))
    assert ok is not False, note


def test_entry(spark):
    assert entry.entry(spark).count() == 5
