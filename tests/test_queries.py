"""Every registered query that has SQL against DuckDB on the same tables."""

import math

import duckdb
import pytest

from markerlake import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    return f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_rows_equal_those_of_sql(spark, duck, small, name):
    got = queries.QUERIES[name](spark, small)
    found = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(got.columns) == sorted(names)
    want = sorted(tuple(plain(r[names.index(c)]) for c in got.columns) for r in found.fetchall())
    assert sorted(tuple(map(plain, r)) for r in got.collect()) == want


def test_entry_is_complete():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries.QUERIES) <= set(entry.queries())
