"""Panels built from the star-schema tables.

Sums run over integer micro-units, so a cell does not depend on the order of its rows.  Every
panel is one map-side-combined aggregation; join strategy is left to the optimizer, which
broadcasts a dimension only below its size threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.stats import div
from panelspark.session import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micro(c: Column, scale: float = 1e6) -> Column:
    return F.floor(c * F.lit(scale) + F.lit(0.5))


def asset_code(nationkey: Column) -> Column:
    return F.concat(F.lit("N"), F.lpad(nationkey.cast("string"), 2, "0"))


def _quote_aggs() -> list[Column]:
    price = micro(F.col("l_extendedprice") / F.col("l_quantity"))
    n = F.count(F.lit(1)) * F.lit(1e6)
    return [
        (F.sum(price) / n).alias("mid"),
        (F.min(price) / F.lit(1e6)).alias("bid"),
        (F.max(price) / F.lit(1e6)).alias("ask"),
        ((F.sum(micro(F.col("l_discount"))) - F.sum(micro(F.col("l_tax")))) / n).alias("points"),
    ]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate"]
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return (
        table(spark, sf_dir, "lineitem")
        .select(*cols)
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .withColumn("date", F.to_date("l_shipdate"))
    )


def quotes_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, asset, mid, bid, ask, points."""
    agg = _lines(spark, sf_dir).groupBy("date", "s_nationkey").agg(*_quote_aggs())
    return agg.select("date", asset_code(F.col("s_nationkey")).alias("asset"), "mid", "bid", "ask", "points")


def quotes_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """month_end, asset, mid, bid, ask, points over all lines of the month."""
    agg = (
        _lines(spark, sf_dir)
        .groupBy(F.last_day("date").alias("month_end"), "s_nationkey")
        .agg(*_quote_aggs())
    )
    return agg.select("month_end", asset_code(F.col("s_nationkey")).alias("asset"), "mid", "bid", "ask", "points")


def wide_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """month_end, asset (part key), mid, bid, ask, points: a universe that grows with the data."""
    cols = ["l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate"]
    return (
        table(spark, sf_dir, "lineitem")
        .select(*cols)
        .groupBy(F.last_day(F.to_date("l_shipdate")).alias("month_end"), F.col("l_partkey").alias("asset"))
        .agg(*_quote_aggs())
    )


def orders_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """month_end, asset, value: a second series per asset (filter signal, rate leg, indicator)."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (
        table(spark, sf_dir, "orders")
        .select("o_custkey", "o_orderdate", "o_totalprice")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.last_day(F.to_date("o_orderdate")).alias("month_end"), "c_nationkey")
        .agg((F.sum(micro(F.col("o_totalprice"), 100.0)) / (F.count(F.lit(1)) * F.lit(100.0))).alias("value"))
        .select("month_end", asset_code(F.col("c_nationkey")).alias("asset"), "value")
    )


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, value: average order value per day, one market-wide indicator."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.to_date("o_orderdate").alias("date"))
        .agg((F.sum(micro(F.col("o_totalprice"), 100.0)) / (F.count(F.lit(1)) * F.lit(100.0))).alias("value"))
    )


def events_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, asset (user id), value: a sparse panel."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.to_date("ts").alias("date"), F.col("user_id").alias("asset"))
        .agg((F.sum(micro(F.col("value"), 100.0)) / (F.count(F.lit(1)) * F.lit(100.0))).alias("value"))
    )


def conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset, bucket, invert, point_scale: the convention dimension (one row per nation)."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        asset_code(F.col("n_nationkey")).alias("asset"),
        F.col("r_name").alias("bucket"),
        (F.col("n_nationkey") % 3 == 0).alias("invert"),
        F.when(F.col("n_nationkey") % 2 == 0, 0.01).otherwise(0.02).alias("point_scale"),
    )


def long_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, ticker, field, value: spot tickers quote mid/bid/ask, ``1M`` tickers quote points."""
    q = quotes_daily(spark, sf_dir)
    spot = q.select(
        "date",
        F.concat("asset", F.lit(" Curncy")).alias("ticker"),
        F.expr("stack(3, 'PX_LAST', mid, 'PX_BID', bid, 'PX_ASK', ask) as (field, value)"),
    )
    fwd = q.select(
        "date",
        F.concat("asset", F.lit("1M Curncy")).alias("ticker"),
        F.lit("PX_LAST").alias("field"),
        F.col("points").alias("value"),
    )
    return spot.unionByName(fwd)


def option_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset, foreign_is_base, option_pair."""
    code = asset_code(F.col("n_nationkey"))
    base = F.col("n_nationkey") % 4 == 0
    return table(spark, sf_dir, "nation").select(
        code.alias("asset"),
        base.alias("foreign_is_base"),
        F.when(base, F.concat(code, F.lit("USD"))).otherwise(F.concat(F.lit("USD"), code)).alias("option_pair"),
    )


def option_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, ticker, field, value: five one-month option measures per pair derived from the quotes."""
    q = quotes_daily(spark, sf_dir).join(option_pairs(spark, sf_dir), "asset")
    stacked = F.expr(
        "stack(5, 'V', ask - bid, '25R', points * 100, '25B', points * 10, '10R', points * 200, '10B', points * 20)"
        " as (code, value)"
    )
    return q.select("date", "option_pair", stacked).select(
        "date",
        F.concat("option_pair", "code", F.lit("1M Curncy")).alias("ticker"),
        F.lit("PX_LAST").alias("field"),
        "value",
    )


def wide_monthly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """month_end, asset, signal, ret over the growing universe (ret = next month's forward return)."""
    from panelspark.operators.convert import next_month_return

    p = wide_universe(spark, sf_dir).select(
        "month_end", "asset", F.col("mid").alias("spot"), (F.col("mid") + F.col("points") / F.lit(0.01)).alias("fwd")
    )
    p = next_month_return(p)
    return p.select(
        "month_end",
        "asset",
        (div(F.col("spot"), F.col("fwd")) - 1).alias("signal"),
        F.col("realized").alias("ret"),
    )
