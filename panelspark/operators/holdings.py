"""Sparse holdings: what a book holds at a rebalance label, and when that label is in force.

A book of daily weights says the same thing every day between two rebalances. Here it stays in two small tables: ``held`` (keys, label,
asset, weight; names with a weight only) and ``steps`` (keys, date, label, and after a volatility target its scalar), one row per scenario
and calendar date. Then

* a day's return is the sum over held names, times the scalar: a target needs no second pass over the assets;
* weights change only on dates on which the label or the scalar does, so trades and costs join the held names of the label before and
  after such a date, and nothing in between; a name that is not held any more gets one exit row;
* an execution delay moves the dates of ``steps``; pairs of label and date that several delays share are priced once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.config import ANN_DAYS, LAG_DAYS
from panelspark.functions.calendar import calendar_index
from panelspark.functions.stats import div
from panelspark.operators.book import effective_labels, target_scalar
from panelspark.session import cut_lineage

Keys = Sequence[str]


def held(rebal: DataFrame) -> DataFrame:
    """The names of a rebalance table that carry weight."""
    return rebal.filter(F.coalesce(F.col("weight"), F.lit(0.0)) != 0)


def steps(rebal: DataFrame, dates: DataFrame, keys: Keys = (), lag: int = 1) -> DataFrame:
    """(keys, date, label): the label in force on each calendar date that has one. ``rebal`` may hold names without weight."""
    return effective_labels(dates, rebal, keys, "date", lag).filter("label is not null").select(*keys, "date", "label")


def day_weights(rebal: DataFrame, by_date: DataFrame, keys: Keys = ()) -> DataFrame:
    """Daily weights in full, for those who want to see them; a date without a scalar yet has NULL weights."""
    w = F.col("weight") * F.col("scalar") if "scalar" in by_date.columns else F.col("weight")
    return rebal.join(by_date, [*keys, "label"]).select(*keys, "date", "asset", w.alias("weight"))


def day_returns(names: DataFrame, by_date: DataFrame, panel: DataFrame, keys: Keys = (), ret: str = "xret", absent: DataFrame | None = None) -> DataFrame:
    """(keys, date, ret) of the unit book on every date of ``by_date``: NULL where no asset has a return, 0 where only assets that are not
    held have one; ``absent`` (keys, asset) are assets outside the scenario's universe."""
    prices = panel.filter(F.col(ret).isNotNull()).select("date", "asset", ret)
    sums = names.join(by_date.select(*keys, "date", "label"), [*keys, "label"]).join(prices, ["date", "asset"]).groupBy(*keys, "date").agg(F.sum(F.col("weight") * F.col(ret)).alias("_sum"))
    out = by_date.select(*keys, "date").join(sums, [*keys, "date"], "left")
    if absent is None:
        live = prices.select("date").distinct().withColumn("_live", F.lit(0.0))
        return out.join(live, "date", "left").select(*keys, "date", F.coalesce("_sum", "_live").alias("ret"))
    out = cut_lineage(out)
    live = out.filter("_sum is null").select(*keys, "date").join(prices, "date").join(absent, [*keys, "asset"], "left_anti").select(*keys, "date").distinct()
    return out.join(live.withColumn("_live", F.lit(0.0)), [*keys, "date"], "left").select(*keys, "date", F.coalesce("_sum", "_live").alias("ret"))


def targeted(unit: DataFrame, by_date: DataFrame, keys: Keys = (), **target) -> DataFrame:
    """``by_date`` with the scalar that brings the unit book to its volatility target (NULL before its first value)."""
    return by_date.join(target_scalar(unit, by_date, keys, **target), [*keys, "date"])


def trades(names: DataFrame, by_date: DataFrame, keys: Keys = ()) -> DataFrame:
    """(keys, date, asset, weight, prev) of held names on the dates on which weights can change."""
    s = F.coalesce("scalar", F.lit(0.0)) if "scalar" in by_date.columns else F.lit(1.0)
    w = Window.partitionBy(*keys or [F.lit(0)]).orderBy("date")  # one row per scenario and calendar date
    moves = by_date.select(*keys, "date", "label", s.alias("_s")).withColumns({"_label0": F.lag("label").over(w), "_s0": F.lag("_s").over(w)})
    moves = moves.filter(F.col("_label0").isNull() | (F.col("label") != F.col("_label0")) | (F.col("_s") != F.col("_s0")))
    now = names.join(moves.select(*keys, "date", "label", "_s"), [*keys, "label"]).select(*keys, "date", "asset", (F.col("weight") * F.col("_s")).alias("weight"), F.lit(0.0).alias("prev"))
    then = names.join(moves.select(*keys, "date", F.col("_label0").alias("label"), F.col("_s0").alias("_s")), [*keys, "label"]).select(*keys, "date", "asset", F.lit(0.0).alias("weight"), (F.col("weight") * F.col("_s")).alias("prev"))
    return now.unionByName(then).groupBy(*keys, "date", "asset").agg(F.sum("weight").alias("weight"), F.sum("prev").alias("prev"))


def trade_costs(moved: DataFrame, by_date: DataFrame, spreads: DataFrame, keys: Keys = ()) -> DataFrame:
    """Round-trip cost per date: changed notional crosses the outright, kept notional rolls at the points spread where anything changed;
    0 on dates without a trade."""
    zero, dw = F.lit(0.0), F.abs(F.col("weight") - F.col("prev"))
    c = moved.join(spreads, ["date", "asset"], "left").groupBy(*keys, "date").agg(
        F.sum(dw * F.col("hs_out")).alias("_t"), F.sum(F.least(F.abs("weight"), F.abs("prev")) * F.col("hs_pts")).alias("_r"), F.sum(dw).alias("_dw"))
    cost = F.coalesce("_t", zero) + F.when(F.col("_dw") > 0, F.coalesce("_r", zero)).otherwise(zero)
    return by_date.select(*keys, "date").join(c.select(*keys, "date", cost.alias("cost")), [*keys, "date"], "left").withColumn("cost", F.coalesce("cost", zero))


def tracks(names: DataFrame, by_date: DataFrame, unit: DataFrame, spreads: DataFrame | None, keys: Keys = ()) -> DataFrame:
    """(keys, date, gross, cost, net) of a book from its unit returns."""
    s = F.col("scalar") if "scalar" in by_date.columns else F.lit(1.0)
    g = by_date.join(unit, [*keys, "date"]).select(*keys, "date", (F.col("ret") * s).alias("gross"))
    if spreads is None:
        return g.withColumn("cost", F.lit(0.0)).withColumn("net", F.col("gross"))
    c = trade_costs(trades(names, by_date, keys), by_date, spreads, keys)
    return g.join(c, [*keys, "date"]).withColumn("net", F.col("gross") - F.col("cost"))


def contributions(names: DataFrame, by_date: DataFrame, panel: DataFrame, keys: Keys = (), ret: str = "xret", spot: str = "sret") -> DataFrame:
    """weight x return per held asset and date, split into the spot part and the carry part."""
    w = F.col("weight")
    days = day_weights(names, by_date, keys).filter("weight is not null")
    return days.join(panel.select("date", "asset", ret, spot), ["date", "asset"], "left").select(
        *keys, "date", "asset", "weight", (w * F.col(ret)).alias("contrib"), (w * F.col(spot)).alias("spot_part"), (w * (F.col(ret) - F.col(spot))).alias("carry_part"))


def idle_contributions(rebal: DataFrame, by_date: DataFrame) -> DataFrame:
    """A 0 for each asset, label and year in which the asset is in the table (NULL where there is no scalar yet), so that sums by group and
    year know of assets that are not held."""
    on = F.col("scalar").isNotNull() if "scalar" in by_date.columns else F.lit(True)
    years = by_date.groupBy("label", F.year("date")).agg(F.min("date").alias("date"), F.max(F.when(on, 0.0)).alias("contrib"))
    return rebal.select("label", "asset").join(years.select("label", "date", "contrib"), "label").select("date", "asset", "contrib")


def attribution(contrib: DataFrame, rebal: DataFrame, by_date: DataFrame, unit: DataFrame, panel: DataFrame, ret: str = "xret", spot: str = "sret", periods: int = ANN_DAYS) -> DataFrame:
    """Totals, annual means, share of profit, covariance share of variance, long/short frequency per asset of ``rebal``.

    Sums come from held rows; what an idle day adds is a 0, so means and covariances only need to know how many days an asset was in the
    table with a return, and the book's return on them: one pass over the panel against the calendar.
    """
    s = F.col("scalar") if "scalar" in by_date.columns else F.lit(1.0)
    book = by_date.join(unit, "date").select("date", "label", s.isNotNull().alias("_on"), F.coalesce(F.col("ret") * s, F.lit(0.0)).alias("_book"))
    tot = book.agg(F.sum("_book").alias("_total"), F.var_samp("_book").alias("_var"))
    total, var = tot.select("_total").scalar(), tot.select("_var").scalar()
    on = book.filter("_on")
    rows = rebal.select("label", "asset").join(on.groupBy("label").agg(F.count(F.lit(1)).alias("_n")), "label", "left").groupBy("asset").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_rows"))
    has, spots = F.col(ret).isNotNull(), F.col(spot).isNotNull()
    one = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
    days = panel.select("date", "asset", ret, spot).join(on, "date").join(rebal.select("label", "asset"), ["label", "asset"], "left_semi")
    days = days.groupBy("asset").agg(one(has).alias("_nc"), one(spots).alias("_ns"), one(has & spots).alias("_ncc"), F.sum(F.when(has, F.col("_book"))).alias("_sb"))
    mine = contrib.join(on.select("date", "_book"), "date").groupBy("asset").agg(
        F.sum("contrib").alias("_c"), F.sum("spot_part").alias("_s"), F.sum("carry_part").alias("_cc"), F.sum(F.col("contrib") * F.col("_book")).alias("_cb"),
        F.sum("weight").alias("_w"), one(F.col("weight") > 0).alias("_long"), one(F.col("weight") < 0).alias("_short"))
    j = rows.join(days, "asset", "left").join(mine, "asset", "left").fillna(0.0, ["_nc", "_ns", "_ncc", "_sb", "_c", "_s", "_cc", "_cb", "_w", "_long", "_short"])
    years, n = F.lit(float(periods)), F.col("_rows").cast("double")
    when = lambda count, c: F.when(F.col(count) > 0, c)
    covariance = div(F.col("_cb") - div(F.col("_c") * F.col("_sb"), F.col("_nc")), F.col("_nc") - 1)
    return j.select(
        "asset", when("_nc", F.col("_c")).alias("contrib_total"), div(F.col("_c") * years, F.col("_nc")).alias("contrib_ann"), when("_nc", div(F.col("_c"), total)).alias("share_of_pnl"),
        div(F.col("_cc") * years, F.col("_ncc")).alias("carry_part_ann"), div(F.col("_s") * years, F.col("_ns")).alias("spot_part_ann"), div(covariance, var).alias("risk_share"),
        div(F.col("_w"), n).alias("avg_weight"), div(F.col("_long"), n).alias("pct_long"), div(F.col("_short"), n).alias("pct_short"))


def delayed(by_date: DataFrame, lags: Sequence[int] = LAG_DAYS) -> DataFrame:
    """One scenario per extra delay: the steps of a single book, so many calendar rows later."""
    cal = calendar_index(by_date)
    fan = by_date.join(cal, "date").withColumn("_lag", F.explode(F.array(*[F.lit(int(k)) for k in lags]))).withColumn("t", F.col("t") + F.col("_lag")).drop("date")
    return fan.join(cal, "t").withColumn("scenario", F.col("_lag").cast("string")).drop("t", "_lag")


def delayed_tracks(names: DataFrame, by_date: DataFrame, panel: DataFrame, spreads: DataFrame, lags: Sequence[int] = LAG_DAYS, ret: str = "xret") -> DataFrame:
    """Tracks of :func:`delayed` books of one held table; each pair of label and date is priced once, however many delays meet it."""
    late = delayed(by_date, lags)
    live = panel.filter(F.col(ret).isNotNull())
    pairs = late.select("date", "label").distinct()
    sums = names.join(pairs, "label").join(live.select("date", "asset", ret), ["date", "asset"]).groupBy("date", "label").agg(F.sum(F.col("weight") * F.col(ret)).alias("_sum"))
    unit = late.join(sums, ["date", "label"], "left").join(live.select("date").distinct().withColumn("_live", F.lit(0.0)), "date", "left").select("scenario", "date", F.coalesce("_sum", "_live").alias("ret"))
    s = F.col("scalar") if "scalar" in by_date.columns else F.lit(1.0)
    g = late.join(unit, ["scenario", "date"]).select("scenario", "date", (F.col("ret") * s).alias("gross"))
    fanned = names.withColumn("scenario", F.explode(F.array(*[F.lit(str(int(k))) for k in lags])))
    return g.join(trade_costs(trades(fanned, late, ["scenario"]), late, spreads, ["scenario"]), ["scenario", "date"]).withColumn("net", F.col("gross") - F.col("cost"))
