"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import math

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, abs_tol=2e-6)
    return a == b


def engine_queries():
    from varspark.queries import ORACLE

    return sorted(ORACLE)


@pytest.mark.parametrize("name", engine_queries())
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert columns == sorted(names)
    key = lambda r: tuple((x is None, "" if isinstance(x, float) else str(x)) for x in r) + tuple(x for x in r if isinstance(x, float))
    left = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    order = [names.index(c) for c in columns]
    right = sorted((tuple(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i] for i in order) for r in result.fetchall()), key=key)
    assert len(left) == len(right)
    for x, y in zip(left, right, strict=True):
        assert all(map(same, x, y)), (x, y)


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_every_query_without_sql_runs(spark):
    from varspark.queries import ORACLE, QUERIES

    for name in sorted(QUERIES.keys() - ORACLE.keys()):
        assert QUERIES[name](spark, SF).count() > 0, name
