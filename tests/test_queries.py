"""Every registered query against its SQL in DuckDB, or for rows where SQL can't express it."""

import oracle
import pytest

from quillspark.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        assert oracle.compare(spark, con, name, QUERIES[name], SQL[name]) == ""
    else:
        assert QUERIES[name](spark, oracle.DATA).limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
