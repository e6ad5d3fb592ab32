"""Every registered query against its SQL counterpart on the smallest tables."""

import pytest

from histomesh.checks import catalogue
from tools.run_checks import compare, oracle_connection

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF_DIR)
    if name in catalogue.SQL:
        assert compare(df, con, catalogue.SQL[name]) == ""
    else:
        assert df.count() > 0


def test_every_sql_has_a_query():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.queries()) >= set(catalogue.QUERIES)
