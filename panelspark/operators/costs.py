"""Turnover, half-spreads, cost models and round-trip costs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.config import ANN_DAYS, LONG_BASKET, SHORT_BASKET
from panelspark.functions.calendar import densify_books, densify_monthly, forward_fill, period_label
from panelspark.functions.stats import div

Keys = Sequence[str]


def weight_changes(weights: DataFrame, keys: Keys = (), date: str = "date", w0: bool = True) -> DataFrame:
    """Add ``prev`` and ``dw``; with ``w0`` the first row of a series trades from 0."""
    w = Window.partitionBy(*keys, "asset").orderBy(date)
    cur = F.coalesce("weight", F.lit(0.0))
    prev = F.lag(cur).over(w)
    prev = F.coalesce(prev, F.lit(0.0)) if w0 else prev
    return weights.withColumn("weight", cur).withColumn("prev", prev).withColumn("dw", F.col("weight") - F.col("prev"))


def mean_abs_turnover(weights: DataFrame, keys: Keys = (), date: str = "date") -> DataFrame:
    """Average absolute weight change over the assets of a date."""
    return weight_changes(weights, keys, date, w0=False).groupBy(*keys, date).agg(F.avg(F.abs("dw")).alias("turnover"))


def daily_turnover(weights: DataFrame, keys: Keys = (), date: str = "date", w0: bool = True) -> DataFrame:
    return weight_changes(weights, keys, date, w0).groupBy(*keys, date).agg(F.coalesce(F.sum(F.abs("dw")), F.lit(0.0)).alias("turnover"), F.sum(F.abs("weight")).alias("gross"))


def period_turnover(weights: DataFrame, keys: Keys = (), date: str = "date", freq: str = "M", inception: bool = True) -> DataFrame:
    """One-sided turnover per period averaged from the first live period on."""
    d = daily_turnover(weights, keys, date, w0=inception)
    p = d.groupBy(*keys, period_label(F.col(date), freq).alias("label")).agg((F.sum("turnover") / 2).alias("one_sided"), F.sum("gross").alias("_g"))
    first = p.filter("_g > 0").groupBy(*keys, *([] if keys else [F.lit(0).alias("_k")])).agg(F.min("label").alias("_first"))
    if keys:
        j = p.join(first, list(keys))
    else:
        j = p.withColumn("_k", F.lit(0)).join(first, "_k")
    return j.filter(F.col("label") >= F.col("_first")).groupBy(*keys).agg(F.avg("one_sided").alias("turnover"), F.count(F.lit(1)).alias("periods"))


def asset_turnover(weights: DataFrame, keys: Keys = (), date: str = "date") -> DataFrame:
    return weight_changes(weights, keys, date).groupBy(*keys, "asset").agg(F.sum(F.abs("dw")).alias("turnover"))


def rebalancing_trades(weights: DataFrame, keys: Keys = (), month: str = "month_end") -> DataFrame:
    """Trades against last month's weights on the book's own month grid (absent = 0 weight)."""
    # each name is followed from its first month on; earlier months hold no weight and trade nothing
    return weight_changes(densify_books(weights, keys, month, full=False), keys, month)


def monthly_rebalancing(trades: DataFrame, keys: Keys = (), month: str = "month_end") -> DataFrame:
    """Turnover and roll notional per month with a 12-month average (at least 6)."""
    m = trades.groupBy(*keys, month).agg(F.sum(F.abs("dw")).alias("turnover"), F.sum(F.abs("weight")).alias("roll_notional"))
    ks = list(keys) or [F.lit(0)]
    w = Window.partitionBy(*ks).orderBy(month).rowsBetween(-11, 0)
    return m.withColumn("turnover_12m", F.when(F.count("turnover").over(w) >= 6, F.avg("turnover").over(w)))


def asset_activity(trades: DataFrame, keys: Keys = ()) -> DataFrame:
    """Trading activity per asset over the rows that carry a basket."""
    t = trades.filter("basket is not null")
    return t.groupBy(*keys, "asset").agg(
        F.sum(F.abs("dw")).alias("total_traded"), F.avg(F.abs("dw")).alias("avg_traded"), F.sum((F.abs("dw") > 1e-12).cast("long")).alias("months_traded"),
        F.avg((F.col("basket") == LONG_BASKET).cast("double")).alias("long_rate"), F.avg((F.col("basket") == SHORT_BASKET).cast("double")).alias("short_rate"))


def half_spreads(quotes: DataFrame, winsor_q: float = 0.99, limit: int = 5) -> DataFrame:
    """Relative half-spreads of the outright and of the points on a dense panel.

    Needs mid, bid, ask, points_bid, points_ask, point_scale.  Crossed quotes clip to 0, each asset
    is winsorised at its own quantile (one series per group), gaps fill up to ``limit`` rows.
    """
    sc = F.col("point_scale")
    f_bid = F.col("bid") + div(F.col("points_bid"), sc)
    f_ask = F.col("ask") + div(F.col("points_ask"), sc)
    f_mid = F.col("mid") + div(F.col("points_bid") + F.col("points_ask"), 2 * sc)
    zero = F.lit(0.0)
    up = lambda c: F.when(c.isNotNull(), F.greatest(c, zero))
    h = quotes.select("date", "asset", up(div(f_ask - f_bid, 2 * f_mid)).alias("hs_out"), up(div(div(F.col("points_ask") - F.col("points_bid"), sc), 2 * F.col("mid"))).alias("hs_pts"))
    cap = h.groupBy("asset").agg(F.percentile("hs_out", winsor_q).alias("_co"), F.percentile("hs_pts", winsor_q).alias("_cp"))
    h = h.join(cap, "asset")
    for c, k in (("hs_out", "_co"), ("hs_pts", "_cp")):
        h = h.withColumn(c, F.when(F.col(c).isNotNull(), F.least(c, k)))
    return forward_fill(h.drop("_co", "_cp"), ["hs_out", "hs_pts"], limit=limit)


def spread_table(hs: DataFrame) -> DataFrame:
    """Median half-spreads per asset in basis points."""
    return hs.groupBy("asset").agg((F.percentile("hs_out", 0.5) * 1e4).alias("outright_bp"), (F.percentile("hs_pts", 0.5) * 1e4).alias("points_bp"))


def filled_spreads(hs: DataFrame) -> DataFrame:
    """Forward-filled without limit, then the asset's median where nothing came before."""
    f = forward_fill(hs, ["hs_out", "hs_pts"])
    med = f.groupBy("asset").agg(F.percentile("hs_out", 0.5).alias("_mo"), F.percentile("hs_pts", 0.5).alias("_mp"))
    return f.join(med, "asset").select("date", "asset", F.coalesce("hs_out", "_mo").alias("hs_out"), F.coalesce("hs_pts", "_mp").alias("hs_pts"))


def missing_spreads(weights: DataFrame, hs: DataFrame) -> DataFrame:
    """Assets of the book without any spread series; must be empty before costing."""
    return weights.select("asset").distinct().join(hs.select("asset").distinct(), "asset", "left_anti")


def roundtrip_cost(weights: DataFrame, hs: DataFrame, keys: Keys = (), date: str = "date") -> DataFrame:
    """Cost per date: changed notional crosses the outright; on trade days kept notional rolls at the points spread.

    ``hs`` comes from :func:`filled_spreads`.
    """
    ch = weight_changes(weights, keys, date).join(hs, [date, "asset"], "left")
    roll = F.sum(F.least(F.abs("weight"), F.abs("prev")) * F.col("hs_pts"))
    g = ch.groupBy(*keys, date).agg(F.sum(F.abs("dw") * F.col("hs_out")).alias("_t"), roll.alias("_r"), F.sum(F.abs("dw")).alias("_dw"))
    zero = F.lit(0.0)
    return g.select(*keys, date, (F.coalesce("_t", zero) + F.when(F.col("_dw") > 0, F.coalesce("_r", zero)).otherwise(zero)).alias("cost"))


def zero_cost_unit_return(weight: Column) -> Column:
    return F.col("rx")


def bid_ask_unit_return(weight: Column) -> Column:
    """Gross for a flat cell, the long leg for a long one, the short leg for a short one."""
    return F.when(weight > 0, F.col("rx_net_long")).when(weight < 0, F.col("rx_net_short")).otherwise(F.col("rx"))


def cost_drag(costs: DataFrame, keys: Keys = ()) -> DataFrame:
    return costs.groupBy(*keys).agg((F.avg("cost") * ANN_DAYS).alias("annual_drag"))
