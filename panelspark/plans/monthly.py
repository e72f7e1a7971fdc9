"""Monthly strategy end to end: legs, returns, baskets, wealth, and its filtered variants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.config import LONG_BASKET, SHORT_BASKET
from panelspark.functions.stats import div
from panelspark.operators.cross_section import adaptive_leg_size, apply_filter, assign_legs, capped_leg_size, equal_leg_weights
from panelspark.operators.performance import monthly_stats, wealth_curve


def names(basket: str):
    return F.array_join(F.sort_array(F.collect_list(F.when(F.col("basket") == basket, F.col("asset")))), ", ")


def strategy_frame(weights: DataFrame, keys: Sequence[str] = ("strategy",), ret: str = "realized", month: str = "month_end", with_names: bool = False) -> DataFrame:
    """One row per (strategy, month): return, notional, concentration, leg size, baskets."""
    w = F.col("weight")
    hhi = F.sum(w * w)
    text = [names(LONG_BASKET).alias("long_basket"), names(SHORT_BASKET).alias("short_basket")] if with_names else []
    return weights.groupBy(*keys, month).agg(
        F.sum(w * F.col(ret)).alias("gross_return"), F.sum(F.abs(w)).alias("roll_notional"), hhi.alias("hhi"), div(F.lit(1.0), hhi).alias("effective_n"),
        F.max("k").alias("leg_size"), F.max("n").alias("n_universe"), *text)


def book_sums(weights: DataFrame, keys: Sequence[str] = ("strategy",), month: str = "month_end") -> DataFrame:
    w = F.col("weight")
    return weights.groupBy(*keys, month).agg(
        F.sum(F.when(w > 0, w)).alias("gross_long"), F.sum(F.when(w < 0, w)).alias("gross_short"), F.sum(w).alias("net"), F.sum(F.abs(w)).alias("gross"))


def filtered_strategy(df: DataFrame, variant: str, lam: float = 0.0, gam: float = 0.0, scale_target: float | None = None, vol_unit: float = 100.0, risk: DataFrame | None = None, splits: int = 1) -> DataFrame:
    """Filter, sort, weigh, then scale the month by option volatility (never above 1) and by a risk scale."""
    f = apply_filter(df, variant, lam=lam, gam=gam, splits=splits).drop("n", "k")
    w = equal_leg_weights(f, ["month_end"], "score", adaptive_leg_size, "realized", splits=splits)
    a = F.abs("weight")
    m = w.groupBy("month_end").agg(
        F.sum(F.col("weight") * F.col("realized")).alias("gross_return"), F.sum(a).alias("roll_notional"), F.max("n").alias("n_universe"),
        div(F.sum(F.col("atm_vol") * a), F.sum(a)).alias("avg_vol"), div(F.sum(F.col("bad_skew25") * a), F.sum(a)).alias("avg_skew"))
    one = F.lit(1.0)
    if scale_target is not None:
        m = m.withColumn("option_vol_scale", F.coalesce(F.least(div(F.lit(scale_target), F.nullif(F.col("avg_vol") / vol_unit, F.lit(0.0))), one), one))
    else:
        m = m.withColumn("option_vol_scale", one)
    if risk is not None:
        m = m.join(risk.select("month_end", "risk_scale"), "month_end", "left").withColumn("risk_scale", F.coalesce("risk_scale", one))
    else:
        m = m.withColumn("risk_scale", one)
    both = F.col("option_vol_scale") * F.col("risk_scale")
    return m.withColumn("gross_return", F.col("gross_return") * both).withColumn("roll_notional", F.col("roll_notional") * F.abs(both))


def monthly_strategy(df: DataFrame, signal: str, ret: str, name: str = "strategy", leg_size=adaptive_leg_size, exclude: Sequence[str] = (), start: str | None = None, weight_cap: float | None = None, lookback: int = 12, splits: int = 1) -> DataFrame:
    """Monthly long/short track of a universe without ``exclude`` from ``start`` on, no weight above ``weight_cap`` (legs grow to
    1/cap names): return, notional, sizes, wealth, drawdown and the wealth change over ``lookback`` months."""
    if exclude:
        df = df.filter(~F.col("asset").isin(list(exclude)))
    if start:
        df = df.filter(F.col("month_end") >= F.lit(start).cast("date"))
    size = leg_size if weight_cap is None else capped_leg_size(leg_size, weight_cap)
    w = equal_leg_weights(df, ["month_end"], signal, size, ret, splits=splits)
    m = w.groupBy("month_end").agg(F.sum(F.col("weight") * F.col(ret)).alias("ret"), F.sum(F.abs("weight")).alias("roll_notional"), F.max("n").alias("n_universe"), F.max("k").alias("leg_size"))
    return wealth_curve(m.withColumn("track", F.lit(name)), date="month_end", lookback=lookback)


def carry_track(panel: DataFrame, signal: str, ret: str, leg_size=adaptive_leg_size, splits: int = 1) -> DataFrame:
    """Monthly long/short return with wealth and drawdown: the minimum end-to-end slice."""
    w = equal_leg_weights(panel, ["month_end"], signal, leg_size, ret, splits=splits)
    m = w.groupBy("month_end").agg(F.sum(F.col("weight") * F.col(ret)).alias("ret"), F.max("n").alias("n_universe"), F.max("k").alias("leg_size"))
    return wealth_curve(m.withColumn("track", F.lit("carry")), date="month_end")


def carry_card(panel: DataFrame, signal: str, ret: str, leg_size=adaptive_leg_size, splits: int = 1) -> DataFrame:
    """Performance card of :func:`carry_track`."""
    return monthly_stats(carry_track(panel, signal, ret, leg_size, splits).select("track", "month_end", "ret"))
