"""Every query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest
from voltlake.plans import catalog, oracle

FREE = {"component_outliers", "linear_predictions", "electrode_fit"}


def normal(v):
    if v is None or v is pd.NA or v != v:
        return None
    return float(v) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)


def rows(df, columns):
    return sorted((tuple(map(normal, r)) for r in df[columns].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(oracle.ORACLES))
def test_sql(spark, small_tables, name):
    con = duckdb.connect()
    for t in ("events", "part"):
        con.execute(f"create view {t} as select * from read_parquet('{small_tables}/{t}.parquet')")
    want = con.execute(oracle.ORACLES[name]).df()
    got = catalog.QUERIES[name](spark, small_tables).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)


def test_all_have_sql():
    assert set(catalog.QUERIES) - set(oracle.ORACLES) == FREE


def test_outliers(spark, small_tables):
    got = catalog.component_outliers(spark, small_tables).toPandas()
    assert len(got) == got.vec_id.nunique() and (got.error >= 0).all() and 0 < got.outside.mean() < 1


def test_linear(spark, small_tables):
    got = catalog.linear_predictions(spark, small_tables).toPandas()
    assert got.prediction.notna().all() and got.prediction.std() > 0.05


def test_electrodes(spark, small_tables):
    got = catalog.electrode_fit(spark, small_tables).toPandas()
    assert len(got) >= 10 and (got.error <= 0.005).all()
    assert all((got[p] - got[f"true_{p}"]).abs().max() < 0.02 for p in ("lli", "q_pe", "q_ne"))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
