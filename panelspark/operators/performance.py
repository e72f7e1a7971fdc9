"""Return-track statistics.  A track is ``(track, date, ret)``; tracks may also be scenarios or assets.

Order-free moments use one map-side-combined aggregation.  Wealth, drawdown and
autocorrelation need order; their windows hold one track each, bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.config import ANN_DAYS, MONTHS_PER_YEAR
from panelspark.functions import rolling as roll
from panelspark.functions.calendar import period_label
from panelspark.functions.stats import div, gated, kurt_agg, positive_only, rows_frame, share, skew_agg

Keys = Sequence[str]


def annual_growth(ret: str, periods: int) -> Column:
    """Compounded annual return; NULL once wealth is not positive."""
    return F.pow(positive_only(F.product(1 + F.col(ret))), F.lit(float(periods)) / F.count(ret)) - 1


def wealth_curve(tracks: DataFrame, keys: Keys = ("track",), date: str = "date", ret: str = "ret", initial: bool = False, lookback: int | None = None) -> DataFrame:
    """Wealth, running peak and drawdown; ``initial`` lets the peak start at wealth 1."""
    w = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    out = tracks.withColumn("wealth", F.product(1 + F.col(ret)).over(w))
    peak = F.max("wealth").over(w)
    out = out.withColumn("peak", F.greatest(peak, F.lit(1.0)) if initial else peak)
    out = out.withColumn("drawdown", div(F.col("wealth"), F.col("peak")) - 1)
    if lookback:
        o = Window.partitionBy(*keys).orderBy(date)
        out = out.withColumn("trailing_return", div(F.col("wealth"), F.lag("wealth", lookback).over(o)) - 1)
    return out


def max_drawdown(tracks: DataFrame, keys: Keys = ("track",), date: str = "date", ret: str = "ret", initial: bool = False) -> DataFrame:
    live = tracks.filter(F.col(ret).isNotNull())
    return wealth_curve(live, keys, date, ret, initial).groupBy(*keys).agg(F.min("drawdown").alias("max_drawdown"))


def max_drawdown_of_nav(nav: DataFrame, keys: Keys = ("track",), date: str = "date", value: str = "nav") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    d = nav.withColumn("_d", div(F.col(value), F.max(value).over(w)) - 1)
    return d.groupBy(*keys).agg(F.min("_d").alias("max_drawdown"))


def cash_nav(tracks: DataFrame, cash: DataFrame, keys: Keys = ("track",), date: str = "date") -> DataFrame:
    """Compounded value of return plus cash rate; periods without a rate earn none."""
    w = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return tracks.join(cash.select(date, "rate"), date, "left").withColumn(
        "nav", F.product(1 + F.col("ret") + F.coalesce("rate", F.lit(0.0))).over(w))


def summary_stats(tracks: DataFrame, keys: Keys = ("track",), date: str = "date", ret: str = "ret", benchmark: DataFrame | None = None,
                  min_obs: int = 120, periods: int = ANN_DAYS) -> DataFrame:
    """The full arithmetic statistics table of daily tracks."""
    keys = list(keys)
    live = tracks.filter(F.col(ret).isNotNull()).select(*keys, date, F.col(ret).alias("r"))
    order = Window.partitionBy(*keys).orderBy(date)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    curve = live.withColumn("_w", F.product(1 + F.col("r")).over(upto)).withColumn("_prev", F.lag("r").over(order))
    curve = curve.withColumn("_dd", div(F.col("_w"), F.max("_w").over(upto)) - 1)
    years = F.lit(float(periods))
    base = curve.groupBy(*keys).agg(
        F.min(date).alias("start"), F.max(date).alias("end"), F.count("r").alias("n_days"),
        (F.avg("r") * years).alias("ann_return"), (F.stddev_samp("r") * F.sqrt(years)).alias("ann_vol"), F.var_samp("r").alias("daily_variance"),
        skew_agg("r").alias("skew"), kurt_agg("r").alias("excess_kurtosis"), F.min("_dd").alias("max_drawdown"),
        F.percentile("r", 0.05).alias("_q05"), F.percentile("r", 0.01).alias("_q01"),
        F.avg((F.col("r") > 0).cast("double")).alias("hit_rate"), F.max("r").alias("best_day"), F.min("r").alias("worst_day"),
        F.corr("r", "_prev").alias("autocorr_1d"), annual_growth("r", periods).alias("cagr"),
        (F.sqrt(F.avg(F.pow(F.least("r", F.lit(0.0)), 2))) * F.sqrt(years)).alias("_down"),
    ).filter(F.col("n_days") >= min_obs)
    tail = live.join(base.select(*keys, "_q05", "_q01"), keys).groupBy(*keys).agg(
        (-F.avg(F.when(F.col("r") <= F.col("_q05"), F.col("r")))).alias("cvar_95"),
        (-F.avg(F.when(F.col("r") <= F.col("_q01"), F.col("r")))).alias("cvar_99"))
    out = base.join(tail, keys).withColumns({
        "sharpe": div(F.col("ann_return"), positive_only(F.col("ann_vol"))),
        "var_95": -F.col("_q05"), "var_99": -F.col("_q01"),
        "sortino": div(F.col("ann_return"), positive_only(F.col("_down"))),
        "calmar": div(F.col("cagr"), F.abs("max_drawdown")),
    }).drop("_q05", "_q01", "_down")
    if benchmark is not None:
        act = live.join(benchmark.select(date, F.col("ret").alias("_b")), date).withColumn("_a", F.col("r") - F.col("_b"))
        ir = act.groupBy(*keys).agg(div(F.avg("_a") * years, positive_only(F.stddev_samp("_a") * F.sqrt(years))).alias("info_ratio"))
        out = out.join(ir, keys, "left")
    return out


def compounded_stats(tracks: DataFrame, keys: Keys = ("track",), date: str = "date", ret: str = "ret", periods: int = ANN_DAYS,
                     initial: bool = False, turnover: str | None = None) -> DataFrame:
    """Statistics on the compounded return: Sharpe, Sortino, Calmar, hit rate, extremes, turnover."""
    keys = list(keys)
    live = tracks.filter(F.col(ret).isNotNull())
    curve = wealth_curve(live, keys, date, ret, initial)
    years = F.lit(float(periods))
    aggs = [
        F.count(ret).alias("observations"), annual_growth(ret, periods).alias("annual_return"),
        (F.stddev_samp(ret) * F.sqrt(years)).alias("annual_volatility"),
        (F.stddev_samp(F.when(F.col(ret) < 0, F.col(ret))) * F.sqrt(years)).alias("_down"),
        F.min("drawdown").alias("maximum_drawdown"), F.avg((F.col(ret) > 0).cast("double")).alias("hit_rate"),
        skew_agg(ret).alias("skewness"), F.max(ret).alias("best"), F.min(ret).alias("worst"), (F.product(1 + F.col(ret)) - 1).alias("final_return"),
    ]
    if turnover:
        aggs.append((F.avg(F.coalesce(turnover, F.lit(0.0))) * years).alias("annual_turnover"))
    return curve.groupBy(*keys).agg(*aggs).withColumns({
        "sharpe": div(F.col("annual_return"), positive_only(F.col("annual_volatility"))),
        "sortino": div(F.col("annual_return"), positive_only(F.col("_down"))),
        "calmar": F.when(F.col("maximum_drawdown") < 0, div(F.col("annual_return"), F.abs("maximum_drawdown"))),
    }).drop("_down")


def monthly_stats(tracks: DataFrame, keys: Keys = ("track",), date: str = "month_end", ret: str = "ret", initial: bool = False) -> DataFrame:
    """Monthly performance card."""
    s = compounded_stats(tracks, keys, date, ret, MONTHS_PER_YEAR, initial)
    return s.select(*keys, F.col("observations").alias("months"), "annual_return", "annual_volatility", "sharpe",
                    F.col("maximum_drawdown").alias("max_drawdown"), "skewness", "hit_rate",
                    F.col("best").alias("best_month"), F.col("worst").alias("worst_month"), "final_return")


def annual_ratio(ret: str, periods: int = ANN_DAYS) -> Column:
    """Arithmetic Sharpe as an aggregate."""
    return div(F.avg(ret) * F.sqrt(F.lit(float(periods))), positive_only(F.stddev_samp(ret)))


def short_card(tracks: DataFrame, keys: Keys = ("track",), date: str = "date", ret: str = "ret", periods: int = ANN_DAYS) -> DataFrame:
    """Return %, vol %, Sharpe, drawdown %, hit % and count."""
    live = tracks.filter(F.col(ret).isNotNull())
    years = F.lit(float(periods))
    return wealth_curve(live, keys, date, ret).groupBy(*keys).agg(
        (F.avg(ret) * years * 100).alias("ann_return_pct"), (F.stddev_samp(ret) * F.sqrt(years) * 100).alias("ann_vol_pct"),
        annual_ratio(ret, periods).alias("sharpe"), (F.min("drawdown") * 100).alias("max_drawdown_pct"),
        (F.avg((F.col(ret) > 0).cast("double")) * 100).alias("hit_rate_pct"), F.count(ret).alias("n_days"))


def resample_returns(tracks: DataFrame, freq: str, keys: Keys = ("track",), date: str = "date", ret: str = "ret") -> DataFrame:
    """Sum, compounded product, count and mean per calendar period."""
    return tracks.groupBy(*keys, period_label(F.col(date), freq).alias("label")).agg(
        F.sum(ret).alias("total"), (F.product(1 + F.col(ret)) - 1).alias("compounded"), F.count(ret).alias("n"), F.avg(ret).alias("mean"))


def yearly_performance(tracks: DataFrame, keys: Keys = ("track",), date: str = "month_end", ret: str = "ret", periods: int = MONTHS_PER_YEAR) -> DataFrame:
    """Compounded return, volatility, Sharpe, hit rate and drawdown per calendar year."""
    t = tracks.filter(F.col(ret).isNotNull()).withColumn("year", F.year(date))
    ks = [*keys, "year"]
    vol = F.stddev_samp(ret) * F.sqrt(F.lit(float(periods)))
    return wealth_curve(t, ks, date, ret, initial=True).groupBy(*ks).agg(
        F.count(ret).alias("n"), (F.product(1 + F.col(ret)) - 1).alias("annual_return"), vol.alias("annual_volatility"),
        div(F.product(1 + F.col(ret)) - 1, positive_only(vol)).alias("sharpe"),
        F.avg((F.col(ret) > 0).cast("double")).alias("hit_rate"), F.min("drawdown").alias("max_drawdown"))


def extreme_periods(tracks: DataFrame, k: int = 10, keys: Keys = ("track",), date: str = "month_end", ret: str = "ret") -> DataFrame:
    """Worst and best k periods of each track."""
    live = tracks.filter(F.col(ret).isNotNull())
    lo = Window.partitionBy(*keys).orderBy(F.col(ret).asc(), F.col(date).asc())
    hi = Window.partitionBy(*keys).orderBy(F.col(ret).desc(), F.col(date).asc())
    worst = live.withColumn("rank", F.row_number().over(lo)).filter(F.col("rank") <= k).withColumn("side", F.lit("worst"))
    best = live.withColumn("rank", F.row_number().over(hi)).filter(F.col("rank") <= k).withColumn("side", F.lit("best"))
    return worst.unionByName(best).select(*keys, "side", "rank", date, ret)


def tag_windows(df: DataFrame, windows: Sequence[tuple[str, str, str]], date: str = "month_end", name: str = "window") -> DataFrame:
    """One copy of a row per named date window holding it (ends inclusive).  Unrolls a short literal
    list instead of planning a range join."""
    hits = [F.when(F.col(date).between(F.lit(a).cast("date"), F.lit(b).cast("date")), F.lit(n)) for n, a, b in windows]
    return df.withColumn(name, F.explode(F.array_compact(F.array(*hits))))


def tag_phases(df: DataFrame, windows: Sequence[tuple[str, str, str]], before: int = 3, date: str = "month_end") -> DataFrame:
    """One copy of a row per window and phase: ``during``, or ``pre`` for the ``before`` months ahead of its first. Windows may overlap: a
    month can be before one and inside another."""
    hits = []
    for n, a, b in windows:
        start, month = F.lit(a).cast("date"), F.last_day(date)
        for phase, hit in (("pre", (month < F.last_day(start)) & (month >= F.last_day(F.add_months(start, -before)))), ("during", F.col(date).between(start, F.lit(b).cast("date")))):
            hits.append(F.when(hit, F.struct(F.lit(n).alias("window"), F.lit(phase).alias("phase"))))
    return df.withColumn("_hit", F.explode(F.array_compact(F.array(*hits)))).select(*df.columns, "_hit.window", "_hit.phase")


def phase_averages(df: DataFrame, values: Sequence[str], windows: Sequence[tuple[str, str, str]], keys: Keys = ("track",), before: int = 3, date: str = "month_end") -> DataFrame:
    """Averages of each value ahead of and inside each window, their difference, and the number of months."""
    t = tag_phases(df, windows, before, date)
    when = lambda p, c: F.when(F.col("phase") == p, c)
    out = t.groupBy(*keys, "window").agg(
        *[F.countDistinct(when(p, F.col(date))).alias(f"n_{p}") for p in ("pre", "during")], *[F.avg(when(p, F.col(v))).alias(f"{v}_{p}") for v in values for p in ("pre", "during")])
    return out.withColumns({f"{v}_change": F.col(f"{v}_during") - F.col(f"{v}_pre") for v in values})


def window_stats(tracks: DataFrame, windows: Sequence[tuple[str, str, str]], keys: Keys = ("track",), date: str = "month_end", ret: str = "ret") -> DataFrame:
    """Compounded return, average, worst period and its date per named window."""
    t = tag_windows(tracks.filter(F.col(ret).isNotNull()), windows, date)
    ks = [*keys, "window"]
    return wealth_curve(t, ks, date, ret, initial=True).groupBy(*ks).agg(
        F.count(ret).alias("n"), (F.product(1 + F.col(ret)) - 1).alias("window_return"), F.avg(ret).alias("avg_return"),
        F.min(ret).alias("worst"), F.min(F.struct(F.col(ret), F.col(date)))[date].alias("worst_date"), F.min("drawdown").alias("max_drawdown"))


def modal_value(df: DataFrame, keys: Keys, value: str, out: str = "modal") -> DataFrame:
    """Most frequent value per key; ties go to the smaller value."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v")))["v"].alias(out))


def split_stats(tracks: DataFrame, cuts: Sequence[str], keys: Keys = ("track",), date: str = "date", ret: str = "ret") -> DataFrame:
    """Short statistics between cut dates; both ends of a segment belong to it."""
    bounds = ["1900-01-01", *cuts, "2999-12-31"]
    segs = [(f"s{i}", a, b) for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:]))]
    t = tag_windows(tracks.filter(F.col(ret).isNotNull()), segs, date, "segment")
    ks = [*keys, "segment"]
    years = F.lit(float(ANN_DAYS))
    return wealth_curve(t, ks, date, ret).groupBy(*ks).agg(
        F.min(date).alias("start"), F.max(date).alias("end"), F.count(ret).alias("n_days"), (F.avg(ret) * years).alias("ann_return"),
        (F.stddev_samp(ret) * F.sqrt(years)).alias("ann_vol"), annual_ratio(ret).alias("sharpe"), F.min("drawdown").alias("max_dd"))


def conditional_stats(df: DataFrame, keys: Keys = ("track",), cond: str = "regime", ret: str = "ret", periods: int = ANN_DAYS) -> DataFrame:
    """Statistics by condition with an ``All`` row and the share of the total return."""
    live = df.filter(F.col(ret).isNotNull() & F.col(cond).isNotNull())
    years = F.lit(float(periods))
    both = live.withColumn(cond, F.explode(F.array(F.col(cond), F.lit("All"))))
    s = both.groupBy(*keys, cond).agg(
        F.count(ret).alias("n"), (F.avg(ret) * years).alias("ann_return"), (F.stddev_samp(ret) * F.sqrt(years)).alias("ann_vol"),
        annual_ratio(ret, periods).alias("sharpe"), skew_agg(ret).alias("skew"), F.avg((F.col(ret) > 0).cast("double")).alias("hit_rate"),
        F.min(ret).alias("worst"), F.sum(ret).alias("_sum"))
    total = s.filter(F.col(cond) == "All").select(*keys, F.col("_sum").alias("_tot"), F.col("n").alias("_n"))
    return s.join(total, list(keys)).withColumns({
        "return_share": div(F.col("_sum"), F.col("_tot")), "time_share": F.col("n") / F.col("_n")}).drop("_sum", "_tot", "_n")


def drawdown_anatomy(tracks: DataFrame, keys: Keys = ("track",), date: str = "date", ret: str = "ret") -> DataFrame:
    """Depth, peak, trough and recovery date of the worst drawdown, and the days under water."""
    keys = list(keys)
    c = wealth_curve(tracks.filter(F.col(ret).isNotNull()), keys, date, ret)
    t = c.groupBy(*keys).agg(F.min(F.struct(F.col("drawdown"), F.col(date).alias("d"))).alias("t"), F.max(date).alias("_end"))
    t = t.select(*keys, "_end", F.col("t.drawdown").alias("max_drawdown"), F.col("t.d").alias("trough"))
    j = c.join(t, keys)
    pk = j.filter(F.col(date) <= F.col("trough")).groupBy(*keys).agg(
        F.max(F.struct(F.col("wealth").alias("w"), (-F.datediff(date, F.lit("1970-01-01").cast("date"))).alias("k"), F.col(date).alias("d"))).alias("p"))
    pk = pk.select(*keys, F.col("p.w").alias("_pw"), F.col("p.d").alias("peak"))
    rec = j.join(pk, keys).filter((F.col(date) >= F.col("trough")) & (F.col("wealth") >= F.col("_pw"))).groupBy(*keys).agg(F.min(date).alias("recovery"))
    return t.join(pk, keys).join(rec, keys, "left").select(
        *keys, "max_drawdown", "peak", "trough", "recovery",
        F.datediff(F.coalesce("recovery", "_end"), "peak").alias("days_under_water"))


def signal_split(df: DataFrame, signal: str, ret: str, key: str = "asset", min_obs: int = 24) -> DataFrame:
    """Mean return above and not above the asset's own median signal, and their correlation."""
    live = df.filter(F.col(signal).isNotNull() & F.col(ret).isNotNull())
    med = live.groupBy(key).agg(F.percentile(signal, 0.5).alias("_m"))
    hi = F.col(signal) > F.col("_m")
    return live.join(med, key).groupBy(key).agg(
        F.count(ret).alias("obs_months"), F.avg(signal).alias("avg_signal"), F.corr(signal, ret).alias("signal_return_corr"),
        F.avg(F.when(hi, F.col(ret))).alias("avg_return_high"), F.avg(F.when(~hi, F.col(ret))).alias("avg_return_low")).filter(F.col("obs_months") >= min_obs)


def rolling_ratio(tracks: DataFrame, window: int | None, min_periods: int, out: str, keys: Keys = ("track",), date: str = "date", ret: str = "ret") -> DataFrame:
    """Trailing (or expanding, ``window=None``) arithmetic Sharpe."""
    if window is not None:
        ratio = div(roll.mean() * F.sqrt(F.lit(float(ANN_DAYS))), positive_only(roll.std()))
        m = roll.rolling_moments(tracks, ret, window, keys, date)
        return roll.done(m.withColumn(out, F.when(roll.count() >= min_periods, ratio)))
    w = rows_frame(keys, date, None)
    expr = div(F.avg(ret).over(w) * F.sqrt(F.lit(float(ANN_DAYS))), positive_only(F.stddev_samp(ret).over(w)))
    return tracks.withColumn(out, gated(expr, F.col(ret), w, min_periods))


def regime_counts(labels: DataFrame, date: str = "date", regime: str = "regime") -> DataFrame:
    """Days and share per regime, overall and by year."""
    live = labels.filter(F.col(regime).isNotNull()).withColumn("period", F.explode(F.array(F.lit("all"), F.year(date).cast("string"))))
    s = live.groupBy("period", regime).agg(F.count(F.lit(1)).alias("days"))
    t = live.groupBy("period").agg(F.count(F.lit(1)).alias("_n"))
    return s.join(t, "period").select("period", regime, "days", (F.col("days") / F.col("_n")).alias("share"))


def rule_agreement(a: DataFrame, b: DataFrame, on: str = "date", scalar: str = "scalar") -> DataFrame:
    """Two exposure rules on common dates: share of dates each cuts exposure, and share on which both decide alike."""
    cut = lambda df, out: df.select(on, (F.col(scalar) < 1).cast("double").alias(out))
    j = cut(a, "_a").join(cut(b, "_b"), on).dropna(subset=["_a", "_b"])
    return j.agg(F.count(F.lit(1)).alias("n"), F.avg("_a").alias("derisked_a"), F.avg("_b").alias("derisked_b"), F.avg((F.col("_a") == F.col("_b")).cast("double")).alias("agreement"))
