"""Every registered query of the library against its SQL, at the smallest scale."""

import os

import duckdb
import pytest

from verdata.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def norm(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(([norm(v) for v in r] for r in df.select(*cols).collect()), key=str)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    want = sorted(([norm(v) for v in r] for r in duck.sql("SELECT " + ", ".join(f'"{c}"' for c in cols) + f" FROM ({sql}) x").fetchall()), key=str)
    assert got == want
