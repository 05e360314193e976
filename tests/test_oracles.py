"""Every registered query against its SQL twin in DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from skriva.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES | registry.FIXED))
def test_query(spark, duck, name):
    df = (registry.QUERIES | registry.FIXED)[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    twins = registry.ORACLES | registry.FIXED_ORACLES
    if name not in twins:
        assert rows
        return
    result = duck.execute(twins[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert rows == sorted(tuple(cell(r[names.index(c)]) for c in columns) for r in result.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
