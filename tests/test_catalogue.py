"""Every query with SQL against DuckDB on the smallest tables; the rest must run."""

import os

import duckdb
import pandas as pd
import pytest

from inkwell.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canon(df: pd.DataFrame) -> list[str]:
    def value(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return None
        return round(float(v), 8) if not isinstance(v, (str, bool)) and hasattr(v, "__float__") else v

    return sorted(repr([value(v) for v in row]) for row in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name in catalogue.SQL:
        want = duck.sql(catalogue.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canon(got) == canon(want)
