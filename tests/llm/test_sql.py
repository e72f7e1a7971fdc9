"""Every SQL of the training-data queries against Spark on the smallest tables."""

import duckdb
import pytest

from panelspark.llm.registry import ORACLE, QUERIES
from tools.check import TABLES, canon

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    exp = con.execute(ORACLE[name]).df()
    got = QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(exp.columns) and len(exp)
    assert canon(got) == canon(exp)
