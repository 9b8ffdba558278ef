"""Queries against their SQL on the smallest tables, and the pipeline as a whole."""

import duckdb
import pytest
from corpus_pipeline import STAGES, run
from voltlake.llm import oracles, queries


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_sql(spark, small_tables, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{small_tables}/{t}.parquet')")
    want = con.execute(oracles.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, small_tables).toPandas()
    columns = sorted(want.columns)
    rows = lambda df: sorted(tuple(str(v) if v == v and v is not None else "" for v in r) for r in df[columns].astype(object).itertuples(index=False))
    assert sorted(got.columns) == columns and rows(got) == rows(want)


def test_every_query_is_there():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)} and len(STAGES) == 5


def test_pipeline(spark, small_tables):
    out = run(spark, small_tables).toPandas()
    assert out.groupby(["doc_id", "doc_tokens"]).length.sum().reset_index().eval("length == doc_tokens").all()
    assert 100 < out.doc_id.nunique() < 200
