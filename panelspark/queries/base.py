"""Spark-side twins of the shared panels."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.stats import div
from panelspark.operators import book, convert, costs, holdings
from panelspark.operators.cross_section import adaptive_leg_size, divided_leg_size, equal_leg_weights
from panelspark.session import checkpoint_dir, cut_lineage
from panelspark.sources import tables

# thirds: legs of the 25-name panel stay large enough for weights to differ under the cap
BUCKETS = 3
LEG_SIZE = divided_leg_size(BUCKETS)


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return convert.daily_panel(tables.quotes_daily(spark, sf), tables.conventions(spark, sf))


def monthly(spark: SparkSession, sf: str) -> DataFrame:
    q = convert.convert_quotes(tables.quotes_monthly(spark, sf), tables.conventions(spark, sf))
    q = q.select("month_end", "asset", "bucket", "spot", "fwd", (F.col("ask") - F.col("bid")).alias("spread"), "points")
    return convert.next_month_return(q).withColumn("carry_signal", div(F.col("spot"), F.col("fwd")) - 1)


def landing(spark: SparkSession) -> str:
    """A new folder for files that a query writes and reads back, where driver and executors both see it."""
    return f"{checkpoint_dir(spark)}/landed-{uuid.uuid4().hex}"


def tracks(spark: SparkSession, sf: str) -> DataFrame:
    """date, track, ret: equal-weight daily return per bucket and overall."""
    p = daily(spark, sf).filter("xret is not null")
    both = p.withColumn("track", F.explode(F.array("bucket", F.lit("ALL"))))
    return both.groupBy("date", "track").agg(F.avg("xret").alias("ret"))


def staged_daily(spark: SparkSession, sf: str) -> DataFrame:
    """The daily panel written once to the checkpoint folder: books read it several times."""
    return cut_lineage(daily(spark, sf))


def point_sides(panel: DataFrame) -> DataFrame:
    """Dense quotes with bid and ask points (half a hundred-thousandth of the spread each side)."""
    half = (F.col("ask") - F.col("bid")) / F.lit(1e5)
    return panel.withColumn("points_bid", F.col("points") - half).withColumn("points_ask", F.col("points") + half)


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly panel once per named sample."""
    from panelspark.queries.convert import SAMPLES

    return convert.expand_samples(monthly(spark, sf), SAMPLES)


def sample_books(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly equal-weight legs per sample: strategy, month_end, asset, weight, basket, k, n, realized."""
    s = samples(spark, sf).withColumnRenamed("sample", "strategy")
    return equal_leg_weights(s, ["strategy", "month_end"], "carry_signal", adaptive_leg_size, "realized")


def unit_book(spark: SparkSession, sf: str, **kw) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Daily panel, rebalance weights of the sorted book (staged), and the label in force on each date."""
    p = staged_daily(spark, sf)
    reb = cut_lineage(book.sorted_book(p, n_buckets=BUCKETS, **kw))
    return p, reb, cut_lineage(holdings.steps(reb, p))


def unit_weights(spark: SparkSession, sf: str, **kw) -> DataFrame:
    """Daily unit weights in full."""
    _, reb, by_date = unit_book(spark, sf, **kw)
    return holdings.day_weights(reb, by_date)


def target_book(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Daily panel, rebalance weights, steps with the volatility target's scalar, unit returns."""
    p, reb, by_date = unit_book(spark, sf)
    unit = cut_lineage(holdings.day_returns(holdings.held(reb), by_date, p))
    return p, reb, cut_lineage(holdings.targeted(unit, by_date)), unit


def spreads(panel: DataFrame) -> DataFrame:
    return costs.filled_spreads(costs.half_spreads(point_sides(panel)))
