"""Many variants of a book in one job, and the checks on top of them.

The reference point of every scenario is the rebalance table (one row per label and asset): it is
computed once and fanned out, so trailing windows and source scans never repeat per scenario.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.config import ANN_DAYS, COST_MULTIPLES, LAG_DAYS
from panelspark.functions.calendar import calendar_index
from panelspark.functions.stats import div
from panelspark.operators import holdings
from panelspark.operators.book import book_from_table, book_returns
from panelspark.operators.costs import roundtrip_cost
from panelspark.operators.cross_section import divided_leg_size
from panelspark.operators.performance import annual_ratio
from panelspark.session import cut_lineage

KEY = ["scenario"]


def fan_out(tab: DataFrame, names: Sequence[str]) -> DataFrame:
    """One copy of the table per scenario name (a literal list unrolled per row)."""
    return tab.withColumn("scenario", F.explode(F.array(*[F.lit(n) for n in names])))


def leave_one_out(tab: DataFrame, base: str = "base") -> DataFrame:
    """``base`` and one ``ex_<asset>`` scenario per asset of the table."""
    names = tab.agg(F.sort_array(F.collect_set("asset")).alias("a")).scalar()
    out = tab.withColumn("_x", F.explode(F.concat(F.array(F.lit("")), names))).filter("_x <> asset")
    return out.withColumn("scenario", F.when(F.col("_x") == "", base).otherwise(F.concat(F.lit("ex_"), "_x"))).drop("_x")


def drop_top(tab: DataFrame, order: DataFrame, most: int = 5) -> DataFrame:
    """Scenario k leaves out the k first assets of ``order`` (asset, rank)."""
    ks = fan_out(tab, [f"drop_{k}" for k in range(most + 1)]).withColumn("_k", F.substring("scenario", 6, 9).cast("int"))
    return ks.join(order.select("asset", "rank"), "asset", "left").filter(F.coalesce(F.col("rank"), F.lit(1 << 30)) > F.col("_k")).drop("_k", "rank")


def run_books(tab: DataFrame, panel: DataFrame, spreads: DataFrame | None, leg_size: Callable[[Column], Column] = divided_leg_size(5), keys: Sequence[str] = ("scenario",),
              weighting: str = "inv_vol", cap: float = 0.40, absent: DataFrame | None = None, **target) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(held names, steps, tracks) of all scenarios of a rebalance table: gross, cost, net per date."""
    keys = list(keys)
    reb = cut_lineage(book_from_table(tab, keys=keys, leg_size=leg_size, weighting=weighting, cap=cap, zeros=False))
    return target_tracks(reb, panel, spreads, keys, absent, **target)


def target_tracks(reb: DataFrame, panel: DataFrame, spreads: DataFrame | None, keys: Sequence[str] = ("scenario",), absent: DataFrame | None = None, **target) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(held names, steps, tracks) of staged held names, brought to a volatility target."""
    by_date = cut_lineage(holdings.steps(reb, panel, keys))
    unit = cut_lineage(holdings.day_returns(reb, by_date, panel, keys, absent=absent))
    by_date = cut_lineage(holdings.targeted(unit, by_date, keys, **target))
    return reb, by_date, holdings.tracks(reb, by_date, unit, spreads, keys)


def tracks_of(weights: DataFrame, panel: DataFrame, spreads: DataFrame | None, keys: Sequence[str] = ("scenario",)) -> DataFrame:
    g = book_returns(weights, panel, keys, out="gross")
    if spreads is None:
        return g.withColumn("cost", F.lit(0.0)).withColumn("net", F.col("gross"))
    c = roundtrip_cost(weights, spreads, keys)
    return g.join(c, [*keys, "date"], "left").withColumn("net", F.col("gross") - F.col("cost"))


def ratio_table(tracks: DataFrame, keys: Sequence[str] = ("scenario",)) -> DataFrame:
    return tracks.groupBy(*keys).agg(annual_ratio("gross").alias("gross_sharpe"), annual_ratio("net").alias("net_sharpe"), F.count("net").alias("n_days"))


def against_base(table: DataFrame, value: str = "net_sharpe", base: str = "base") -> DataFrame:
    """Difference of every scenario from the base scenario."""
    b = table.filter(F.col("scenario") == base).select(F.col(value).alias("_b")).scalar()
    return table.withColumn("delta", F.col(value) - b)


def common_window(tracks: DataFrame, base: DataFrame, value: str = "net") -> DataFrame:
    """Rows inside the live span of the base track."""
    s = base.filter(F.col(value).isNotNull()).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    return tracks.filter(F.col("date").between(s.select("a").scalar(), s.select("b").scalar()))


def cost_stress(tracks: DataFrame, multiples: Sequence[float] = COST_MULTIPLES) -> DataFrame:
    """Net Sharpe and annual drag per spread multiple; cost is linear in spreads, so one cost run serves all."""
    m = tracks.withColumn("multiple", F.explode(F.array(*[F.lit(float(x)) for x in multiples])))
    m = m.withColumn("_n", F.col("gross") - F.col("cost") * F.col("multiple")).withColumn("_c", F.when(F.col("gross").isNotNull(), F.col("cost") * F.col("multiple")))
    return m.groupBy("multiple").agg(annual_ratio("_n").alias("net_sharpe"), (F.avg("_c") * ANN_DAYS).alias("annual_drag"))


def break_even(stress: DataFrame) -> DataFrame:
    """Smallest tested multiple without a positive net Sharpe (NULL when all stay positive)."""
    return stress.agg(F.min(F.when(F.col("net_sharpe") <= 0, F.col("multiple"))).alias("break_even"), F.max("multiple").alias("largest_tested"))


def delay(weights: DataFrame, lags: Sequence[int] = LAG_DAYS) -> DataFrame:
    """Weights shifted by each extra delay, as scenarios.  The shift is a lookup on the calendar of
    the weights, not a window over every asset."""
    cal = calendar_index(weights)
    fan = weights.join(cal, "date").withColumn("lag", F.explode(F.array(*[F.lit(int(k)) for k in lags]))).withColumn("t", F.col("t") + F.col("lag")).drop("date")
    return fan.join(cal, "t").select(F.col("lag").cast("string").alias("scenario"), "date", "asset", "weight")


def reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, tol: float) -> DataFrame:
    """Rows where two result tables disagree by ``tol`` or more, or where one side is missing; empty = passed."""
    j = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), list(keys), "full_outer")
    bad = F.col("_a").isNull() != F.col("_b").isNull()
    return j.withColumn("abs_diff", F.abs(F.col("_a") - F.col("_b"))).filter(bad | (F.col("abs_diff") >= tol))


def look_ahead(fn: Callable[[DataFrame], DataFrame], panel: DataFrame, cut: str, date: str = "date", digits: int = 10) -> DataFrame:
    """Rows of ``fn(panel up to cut)`` missing from ``fn(panel)`` up to the cut; empty = no look-ahead."""
    until = F.col(date) <= F.lit(cut).cast("date")

    def rounded(df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})

    early = rounded(fn(panel.filter(until)))
    full = rounded(fn(panel)).filter(until)
    return early.exceptAll(full).withColumn("side", F.lit("early")).unionByName(full.exceptAll(early).withColumn("side", F.lit("full")))
