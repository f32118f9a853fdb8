"""Every registered query against its SQL twin on the smallest data set."""

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from check_twins import TABLES, normal

QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_twin(spark, sf, con, name):
    got = QUERIES[name](spark, sf).toPandas()
    want = con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
