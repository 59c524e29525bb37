"""The registered queries: one for each operator, and the same rows as their SQL on the smallest tables."""

import os

import duckdb
import pytest

from vellum.llm import registry

FOLDER = os.environ.get("VELLUM_TABLES", "/root/testdata/sf0.001")


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    want = con.sql(registry.ORACLE_SQL[name])
    at = {c: i for i, c in enumerate(want.columns)}
    assert sorted(at) == columns
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[at[c]] for c in columns) for r in want.fetchall()), key=repr)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_every_document_has_a_row(spark, name):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = registry.QUERIES[name](spark, FOLDER).select("doc_id").cache()
    assert out.count() == documents.count() and documents.join(out, "doc_id", "left_anti").isEmpty()
