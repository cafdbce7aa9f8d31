import os

import duckdb
import pytest

from newsloom.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got = queries.QUERIES[name](spark, SF)
    assert sorted(tuple(r) for r in got.select(*sorted(got.columns)).collect()) == sorted(c.execute(f"SELECT {', '.join(sorted(got.columns))} FROM ({queries.ORACLES[name]})").fetchall())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > (-1 if name == "p5_limits" else 0)  # so few rows show no limits
