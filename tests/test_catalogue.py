"""Every query with SQL, against DuckDB on the smallest tables; skipped where those aren't there."""

import math
import os

import duckdb
import pandas as pd
import pytest

from newsloom.plans import catalogue

SF = "/root/testdata/sf0.001"


def cell(x):
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and math.isnan(x):
        return ""
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        x = round(x, 5)
        return str(int(x)) if x == int(x) else str(x)
    return str(x)


def rows(df):
    return sorted(tuple(cell(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_fetch_report_counts_every_month_and_form(spark, duck):
    want = duck.execute("SELECT count(*) FROM news_cache JOIN news_sources USING (source_name)").fetchone()[0]
    assert catalogue.QUERIES["failure_severity"](spark, SF).first()["articles"] == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_html_clean_takes_every_row(spark, duck):
    assert catalogue.QUERIES["html_clean"](spark, SF).count() == duck.execute("SELECT count(*) FROM news_cache").fetchone()[0]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
