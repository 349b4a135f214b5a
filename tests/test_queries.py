"""All registered queries of the library against DuckDB; the training-data operators have tests of their own."""

import os
import re

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences

SF_DIR = "/root/testdata/sf0.001"
OTHER = re.compile(r"op\d+_|pipeline$")
QUERIES = {n: q for n, q in entry.queries().items() if not OTHER.match(n)}
SQL = {n: s for n, s in entry.oracle_sql().items() if not OTHER.match(n)}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, name):
    assert differences(spark, connect(SF_DIR), SF_DIR, name, QUERIES[name], SQL[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
