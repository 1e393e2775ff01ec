"""Every registered query of the library against its SQL in DuckDB."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from sievework.plans import catalog

DATA = os.environ.get("SIEVEWORK_TEST_DATA", "/root/testdata/sf0.001")


def same(mine, ref):
    assert sorted(mine.columns) == sorted(ref.columns)
    key = sorted(mine.columns)

    def rows(df):
        return sorted(tuple("null" if pd.isna(v) else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in df[key].astype(object).itertuples(index=False))

    assert rows(mine) == rows(ref)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    mine = catalog.QUERIES[name](spark, DATA).toPandas()
    if name in catalog.ORACLES:
        same(mine, con.execute(catalog.ORACLES[name]).df())


def test_truncate_of_texts_without_words(spark, tmp_path):
    """A sum over no words is null in SQL."""
    rows = [(1, ""), (2, " \t\n "), (3, None), (4, "a bb"), (5, " ccc " * 150)]
    spark.createDataFrame([(i, t, "src0") for i, t in rows], "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    mine = catalog.QUERIES["t_truncate"](spark, str(tmp_path)).toPandas()
    same(mine, c.execute(catalog.ORACLES["t_truncate"]).df())
    assert {r.doc_id: r.total for r in mine.itertuples() if r.doc_id > 3} == {4: 3, 5: 300}
