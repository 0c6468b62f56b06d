"""All registered queries of the reference operators against DuckDB, at the smallest scale."""

import glob
import math
import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def names():
    from cirrus.plans import atlas_queries, frame_queries, more_queries, queries, surface_queries  # noqa: F401
    from cirrus.plans.registry import ORACLES

    return sorted(ORACLES)


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(float(value), 5) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


@pytest.mark.parametrize("name", names())
def test_query_equals_its_sql(spark, duck, name):
    from cirrus.plans.registry import ORACLES, QUERIES

    df = QUERIES[name](spark, SF)
    expected = duck.execute(ORACLES[name])
    columns = [c[0] for c in expected.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    got = sorted(([plain(r[c]) for c in order] for r in df.collect()), key=repr)
    want = sorted(([plain(dict(zip(columns, r))[c]) for c in order] for r in expected.fetchall()), key=repr)
    assert got == want
