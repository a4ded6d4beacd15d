"""Every query with a statement against DuckDB on the smallest tables; the others must run."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from veriframe.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(df):
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return None
        return f"{float(v):.9g}" if isinstance(v, int | float) or hasattr(v, "dtype") else str(v)

    return Counter(tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    if name not in catalog.ORACLE_SQL:
        assert len(got.columns) > 0
        return
    want = duck.execute(catalog.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_statements_belong_to_queries():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
