"""Where a book's return and risk come from: per asset, group, year, condition."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.config import ANN_DAYS, LONG_BASKET, MONTHS_PER_YEAR, SHORT_BASKET
from panelspark.functions.calendar import densify_books
from panelspark.functions.stats import div
from panelspark.operators.performance import compounded_stats

Keys = Sequence[str]


def contributions(weights: DataFrame, panel: DataFrame, ret: str = "xret", spot: str = "sret", date: str = "date") -> DataFrame:
    """weight x return per asset and date, split into the spot part and the carry part."""
    p = panel.select(date, "asset", ret, spot)
    w = F.col("weight")
    return weights.join(p, [date, "asset"], "left").select(
        date, "asset", "weight", (w * F.col(ret)).alias("contrib"), (w * F.col(spot)).alias("spot_part"), (w * (F.col(ret) - F.col(spot))).alias("carry_part"))


def attribution(contrib: DataFrame, date: str = "date", periods: int = ANN_DAYS) -> DataFrame:
    """Totals, annual means, share of profit, covariance share of variance, long/short frequency.

    The mean of an asset runs over its live rows; covariance pairs them with the book's return.
    """
    book = contrib.groupBy(date).agg(F.coalesce(F.sum("contrib"), F.lit(0.0)).alias("_book"))
    tot = book.agg(F.sum("_book").alias("_total"), F.var_samp("_book").alias("_var"))
    total, var = tot.select("_total").scalar(), tot.select("_var").scalar()
    years = F.lit(float(periods))
    live = F.when(F.col("weight").isNotNull(), 1.0)
    return contrib.join(book, date).groupBy("asset").agg(
        F.sum("contrib").alias("contrib_total"), (F.avg("contrib") * years).alias("contrib_ann"), div(F.sum("contrib"), total).alias("share_of_pnl"),
        (F.avg("carry_part") * years).alias("carry_part_ann"), (F.avg("spot_part") * years).alias("spot_part_ann"),
        div(F.covar_samp("contrib", "_book"), var).alias("risk_share"), F.avg("weight").alias("avg_weight"),
        F.avg((F.col("weight") > 0).cast("double")).alias("pct_long"), F.avg((F.col("weight") < 0).cast("double")).alias("pct_short"))


def group_attribution(per_asset: DataFrame, groups: DataFrame, group: str = "bucket") -> DataFrame:
    return per_asset.join(groups.select("asset", group), "asset").groupBy(group).agg(
        F.sum("contrib_ann").alias("contrib_ann"), F.sum("share_of_pnl").alias("share_of_pnl"), F.sum("risk_share").alias("risk_share"))


def yearly_attribution(contrib: DataFrame, groups: DataFrame, group: str = "bucket", date: str = "date") -> DataFrame:
    return contrib.join(groups.select("asset", group), "asset").groupBy(group, F.year(date).alias("year")).agg(F.sum("contrib").alias("contrib"))


def month_flags(weights: DataFrame, returns: DataFrame, windows: Sequence[tuple[str, str, str]], keys: Keys = ("strategy",), month: str = "month_end", worst: int = 10) -> DataFrame:
    """Flag each row's month: up, down, among the worst, inside a named window (the last one wins)."""
    w = Window.partitionBy(*keys).orderBy(F.col("gross_return").asc(), F.col(month).asc())
    flags = returns.select(*keys, month, "gross_return").withColumn("_r", F.row_number().over(w))
    flags = flags.select(*keys, month, (F.col("gross_return") > 0).alias("up"), (F.col("gross_return") < 0).alias("down"), (F.col("_r") <= worst).alias("worst"))
    crisis = F.lit("")
    for n, a, b in windows:
        crisis = F.when(F.col(month).between(F.lit(a).cast("date"), F.lit(b).cast("date")), n).otherwise(crisis)
    return weights.join(flags, [*keys, month], "left").withColumn("crisis", crisis)


def contribution_table(flagged: DataFrame, keys: Keys = ("strategy",)) -> DataFrame:
    """Contribution per asset in total, on average, by kind of month and by side."""
    c = F.col("contribution")
    part = lambda cond, name: F.coalesce(F.sum(F.when(cond, c)), F.lit(0.0)).alias(name)
    return flagged.groupBy(*keys, "asset").agg(
        F.sum(c).alias("total"), F.avg(c).alias("monthly_avg"), (F.avg(c) * MONTHS_PER_YEAR).alias("annualised"),
        part(F.col("up"), "up_months"), part(F.col("down"), "down_months"), part(F.col("worst"), "worst_months"),
        part(F.col("basket") == LONG_BASKET, "long_side"), part(F.col("basket") == SHORT_BASKET, "short_side"))


def crisis_contributions(flagged: DataFrame, keys: Keys = ("strategy",)) -> DataFrame:
    return flagged.filter("crisis <> ''").groupBy(*keys, "asset", "crisis").agg(F.sum("contribution").alias("contribution"))


def standalone(panel: DataFrame, ret: str = "realized", month: str = "month_end") -> DataFrame:
    """Every asset as its own compounded track."""
    return compounded_stats(panel, ["asset"], month, ret, MONTHS_PER_YEAR, initial=True)


def composition(weights: DataFrame, keys: Keys = ("strategy",), warn_at: float = 0.40) -> DataFrame:
    """Selection rates, average weight, concentration warning per asset."""
    s = weights.groupBy(*keys, "asset").agg(
        F.avg((F.col("basket") == LONG_BASKET).cast("double")).alias("long_rate"), F.avg((F.col("basket") == SHORT_BASKET).cast("double")).alias("short_rate"), F.avg("weight").alias("avg_weight"))
    return s.withColumn("concentrated", F.greatest("long_rate", "short_rate") >= warn_at)


def selection_frequency(weights: DataFrame, keys: Keys = ("strategy",), month: str = "month_end", window: int = 36, min_periods: int = 12) -> DataFrame:
    """Trailing share of months an asset is long (short), on a grid where an absent month counts as not held."""
    keys = list(keys)
    grid = densify_books(weights.select(*keys, "asset", month, "basket"), keys, month)
    flag = lambda b: F.coalesce((F.col("basket") == b).cast("double"), F.lit(0.0))
    w = Window.partitionBy(*keys, "asset").orderBy(month).rowsBetween(-(window - 1), 0)
    ok = F.count(F.lit(1)).over(w) >= min_periods
    return grid.select(*keys, "asset", month, F.when(ok, F.avg(flag(LONG_BASKET)).over(w)).alias("long_share"), F.when(ok, F.avg(flag(SHORT_BASKET)).over(w)).alias("short_share"))
