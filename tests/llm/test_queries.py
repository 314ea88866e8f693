"""The registered queries against their SQL, on real rows."""

import duckdb
import pytest
from tidemesh.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    df = queries.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    columns = sorted(df.columns)
    want = con.execute(queries.oracle_sql()[name]).fetchdf()
    assert sorted(want.columns) == columns
    assert sorted(tuple(r) for r in df.select(*columns).collect()) == sorted(tuple(r) for r in want[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_returns_every_document(spark, name):
    ids = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in queries.queries()[name](spark, SF).select("doc_id").collect()} == ids
