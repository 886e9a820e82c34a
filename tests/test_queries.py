"""Every query with an exact SQL form gives the same rows as DuckDB, on the smallest tables."""

import duckdb
import pytest

from quern.plans.registry import ORACLE_SQL, QUERIES
from tools.compare import differ

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "lineitem orders customer part supplier events documents embeddings labels conversations benchmark".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, con, name):
    assert differ(QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE_SQL[name]).df()) == ""


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
