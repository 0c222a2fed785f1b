"""Every registered query of the engine against DuckDB on the smallest tables."""

import glob
import os

import pytest

from factloom.plans import surrogate

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def text(value):
    if value is None:
        return "\0"
    return f"{value:.6g}" if isinstance(value, float) else str(value)


@pytest.mark.skipif(not glob.glob(f"{SF}/*.parquet"), reason="no test tables")
@pytest.mark.parametrize("name", sorted(surrogate.ORACLE_SQL))
def test_equals_the_oracle(spark, duck, name):
    found = surrogate.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    own = sorted(tuple(text(r[c]) for c in columns) for r in found.collect())
    result = duck.execute(surrogate.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert own == sorted(tuple(text(r[i]) for i in at) for r in result.fetchall())


def test_queries_without_an_oracle_have_rows(spark):
    for name in set(surrogate.QUERIES) - set(surrogate.ORACLE_SQL):
        assert surrogate.QUERIES[name](spark, SF).count() > 0
