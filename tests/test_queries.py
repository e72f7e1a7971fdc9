"""Registered queries against their SQL on the smallest tables, and properties of their plans."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402
from panelspark.sources import tables as tb  # noqa: E402
from tools.check import TABLES, canon  # noqa: E402

SF = "/root/testdata/sf0.001"
SOME = ["p1_invert_quote", "p10_monthly_panel", "r3_asof_fill_lag", "q5_audit", "s7_split_fields", "w2_momentum", "x1_rank_buckets_wide", "x3_top_bottom_legs",
        "x6_cross_stats_wide", "b7_monthly_strategy", "b6_simple_book", "m3_monthly_stats", "p21_cost_scenarios", "g10_contribution_table", "z9_look_ahead_check"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_matches_sql(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    exp = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(exp.columns)
    assert canon(got) == canon(exp)


def test_flagship_runs(spark):
    out = entry.entry(spark)
    assert out.count() > 50 and {"month_end", "ret", "wealth", "drawdown"} <= set(out.columns)


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_scan_reads_only_needed_columns_and_pushes_filters(spark):
    p = plan(tb.quotes_daily(spark, SF))
    assert "l_orderkey" not in p.split("== Physical Plan ==")[1]
    q = tb.table(spark, SF, "orders").filter("o_totalprice > 100000").select("o_orderkey")
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,100000.0)]" in plan(q)


@pytest.mark.parametrize("name", ["s20_daily_panel", "p12_expand_samples", "j7_interval_tags", "j10_parameter_grid", "z6_lag_stress", "x3_top_bottom_legs_wide", "m19_comparison_table"])
def test_no_cross_join_is_planned(spark, name):
    p = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
