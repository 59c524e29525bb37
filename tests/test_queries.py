"""Every query of the library against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from vellum.plans import queries as Q
from vellum.sources.tables import TABLES

FOLDER = os.environ.get("VELLUM_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def canonical(v):
    if isinstance(v, float):
        return round(v, 5)
    return tuple(map(canonical, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_rows(spark, duck, name):
    df = Q.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(canonical(r[c]) for c in columns) for r in df.collect()), key=repr)
    want = duck.sql(Q.SQL[name])
    at = {c: i for i, c in enumerate(want.columns)}
    assert sorted(at) == columns
    assert got == sorted((tuple(canonical(r[at[c]]) for c in columns) for r in want.fetchall()), key=repr)
