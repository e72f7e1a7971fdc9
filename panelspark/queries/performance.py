"""Performance, distribution and condition tables (M)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.operators import attribution as at
from panelspark.operators import book as bk
from panelspark.operators import cross_section as xs
from panelspark.operators import performance as pf
from panelspark.operators import regress as rg
from panelspark.plans import monthly as pm
from panelspark.queries import base, booksql as bs
from panelspark.queries.book import _FRAME, _REG, _SB, regimes
from panelspark.queries.costs import COSTED, TRADES, costed, trades
from panelspark.queries.registry import query
from panelspark.queries.trailing import scaled
from panelspark.sources import tables as tb

# wealth, drawdown and lagged return of the scaled daily tracks
_ST = """, c0 AS (SELECT date, track, ret/10 AS r, product(1+ret/10) OVER w AS wealth, lag(ret/10) OVER (PARTITION BY track ORDER BY date) AS prev FROM bt WINDOW w AS (PARTITION BY track ORDER BY date ROWS UNBOUNDED PRECEDING)),
 c1 AS (SELECT *, wealth/max(wealth) OVER (PARTITION BY track ORDER BY date ROWS UNBOUNDED PRECEDING)-1 AS dd FROM c0)"""

_M1 = """, s AS (SELECT track, min(date) AS start, max(date) AS "end", count(r) AS n_days, avg(r)*252 AS ann_return, stddev_samp(r)*sqrt(252.0) AS ann_vol, var_samp(r) AS daily_variance, skewness(r) AS skew, kurtosis(r) AS excess_kurtosis, min(dd) AS max_drawdown,
 quantile_cont(r,0.05) AS q05, quantile_cont(r,0.01) AS q01, avg(CASE WHEN r>0 THEN 1.0 ELSE 0 END) AS hit_rate, max(r) AS best_day, min(r) AS worst_day, corr(r,prev) AS autocorr_1d, pow(product(1+r),252.0/count(r))-1 AS cagr, sqrt(avg(least(r,0)**2))*sqrt(252.0) AS down FROM c1 GROUP BY 1 HAVING count(r)>=120),
 tl AS (SELECT c1.track, -avg(r) FILTER (WHERE r<=q05) AS cvar_95, -avg(r) FILTER (WHERE r<=q01) AS cvar_99 FROM c1 JOIN s ON s.track=c1.track GROUP BY 1),
 ir AS (SELECT a.track, avg(a.r-b.r)*252/nullif(stddev_samp(a.r-b.r)*sqrt(252.0),0) AS info_ratio FROM c1 a JOIN c1 b ON b.date=a.date AND b.track='ALL' GROUP BY 1)"""
_M1F = "ann_return ann_vol daily_variance skew excess_kurtosis max_drawdown hit_rate best_day worst_day autocorr_1d cagr cvar_95 cvar_99 sharpe var_95 var_99 sortino calmar info_ratio"


@query("m1_summary_stats", "WITH " + (_ST + _M1)[2:] + """ SELECT s.* EXCLUDE (q05,q01,down), cvar_95, cvar_99, ann_return/ann_vol AS sharpe, -q05 AS var_95, -q01 AS var_99, ann_return/down AS sortino, cagr/abs(max_drawdown) AS calmar, info_ratio FROM s JOIN tl ON tl.track=s.track JOIN ir ON ir.track=s.track""", use="bt", floats=_M1F, digits=7)
def _(spark, sf):
    t = scaled(spark, sf)
    return pf.summary_stats(t, benchmark=t.filter("track = 'ALL'"))


@query("m2_compounded_stats", "WITH " + _ST[2:] + """ SELECT track, count(r) AS observations, pow(product(1+r),252.0/count(r))-1 AS annual_return, stddev_samp(r)*sqrt(252.0) AS annual_volatility, min(dd) AS maximum_drawdown, avg(CASE WHEN r>0 THEN 1.0 ELSE 0 END) AS hit_rate,
 (pow(product(1+r),252.0/count(r))-1)/(stddev_samp(r)*sqrt(252.0)) AS sharpe, (pow(product(1+r),252.0/count(r))-1)/(stddev_samp(r) FILTER (WHERE r<0)*sqrt(252.0)) AS sortino, (pow(product(1+r),252.0/count(r))-1)/abs(min(dd)) AS calmar, avg(abs(r-coalesce(prev,0)))*252 AS annual_turnover FROM c1 GROUP BY 1""", use="bt",
       floats="annual_return annual_volatility maximum_drawdown hit_rate sharpe sortino calmar annual_turnover", digits=6)
def _(spark, sf):
    w = Window.partitionBy("track").orderBy("date")
    t = scaled(spark, sf).withColumn("to", F.abs(F.col("ret") - F.coalesce(F.lag("ret").over(w), F.lit(0.0))))
    return pf.compounded_stats(t, turnover="to").drop("skewness", "best", "worst", "final_return")


_MC = """, m0 AS (SELECT strategy, month_end, gross_return AS r, product(1+gross_return) OVER (PARTITION BY strategy ORDER BY month_end ROWS UNBOUNDED PRECEDING) AS wealth FROM pr),
 m1 AS (SELECT *, wealth/greatest(max(wealth) OVER (PARTITION BY strategy ORDER BY month_end ROWS UNBOUNDED PRECEDING),{init})-1 AS dd FROM m0)"""
_CARD = """SELECT {k}, count(r) AS months, CASE WHEN product(1+r)>0 THEN pow(product(1+r),12.0/count(r))-1 END AS annual_return, stddev_samp(r)*sqrt(12.0) AS annual_volatility, CASE WHEN product(1+r)>0 THEN (pow(product(1+r),12.0/count(r))-1)/(stddev_samp(r)*sqrt(12.0)) END AS sharpe,
 min(dd) AS max_drawdown, skewness(r) AS skewness, avg(CASE WHEN r>0 THEN 1.0 ELSE 0 END) AS hit_rate, max(r) AS best_month, min(r) AS worst_month, product(1+r)-1 AS final_return FROM {s} GROUP BY ALL"""
_CF = "annual_return annual_volatility sharpe max_drawdown skewness hit_rate best_month worst_month final_return"


def strategy_tracks(spark, sf):
    f = pm.strategy_frame(base.sample_books(spark, sf), with_names=False)
    return f.select("strategy", "month_end", F.col("gross_return").alias("ret"))


@query("m3_monthly_stats", "WITH " + (_SB + _FRAME + _MC.format(init="-1e300"))[2:] + " " + _CARD.format(k="strategy", s="m1"), use="mp", floats=_CF, digits=6)
def _(spark, sf):
    return pf.monthly_stats(strategy_tracks(spark, sf), ["strategy"])


@query("m3_wide_strategy_stats", """WITH lg AS (SELECT *, row_number() OVER (PARTITION BY month_end ORDER BY signal, asset) AS rn, count(*) OVER (PARTITION BY month_end) AS n FROM wp WHERE signal IS NOT NULL AND ret IS NOT NULL),
 t AS (SELECT month_end, sum(CASE WHEN rn>n-n//5 THEN 1.0::DOUBLE/(n//5) WHEN rn<=n//5 THEN -1.0::DOUBLE/(n//5) ELSE 0 END*ret/10) AS r FROM lg GROUP BY 1),
 m0 AS (SELECT 'carry' AS track, month_end, r, product(1+r) OVER (ORDER BY month_end ROWS UNBOUNDED PRECEDING) AS wealth FROM t), m1 AS (SELECT *, wealth/max(wealth) OVER (ORDER BY month_end ROWS UNBOUNDED PRECEDING)-1 AS dd FROM m0) """ + _CARD.format(k="track", s="m1"), use="wp", floats=_CF, digits=6)
def _(spark, sf):
    panel = tb.wide_monthly_panel(spark, sf).withColumn("ret", F.col("ret") / 10)
    return pm.carry_card(panel, "signal", "ret", xs.divided_leg_size(5), splits=16)


@query("m4_scenario_table", "WITH " + COSTED[2:] + """, al AS (SELECT strategy, kind, bps, month_end, net AS r FROM cost UNION ALL SELECT strategy, 'gross', 0, month_end, gross FROM pf),
 m0 AS (SELECT *, product(1+r) OVER w AS wealth FROM al WINDOW w AS (PARTITION BY strategy, kind, bps ORDER BY month_end ROWS UNBOUNDED PRECEDING)), m1 AS (SELECT *, wealth/greatest(max(wealth) OVER (PARTITION BY strategy, kind, bps ORDER BY month_end ROWS UNBOUNDED PRECEDING),1.0)-1 AS dd FROM m0) """ + _CARD.format(k="strategy, kind, bps", s="m1"), use="mp", floats=_CF, digits=6)
def _(spark, sf):
    c = costed(spark, sf)
    gross = strategy_tracks(spark, sf).select("strategy", "month_end", F.lit("gross").alias("kind"), F.lit(0).alias("bps"), "ret")
    allt = c.select("strategy", "month_end", "kind", "bps", F.col("net").alias("ret")).unionByName(gross)
    return pf.monthly_stats(allt, ["strategy", "kind", "bps"], initial=True)


_NW = """, u AS (SELECT track, date, r-avg(r) OVER (PARTITION BY track) AS u FROM c0), g AS (SELECT track, """ + ", ".join(f"lag(u,{i}) OVER w AS u{i}" for i in range(1, 6)) + """, u FROM u WINDOW w AS (PARTITION BY track ORDER BY date)),
 nw AS (SELECT track, sqrt(sum(u*u)+2*(""" + "+".join(f"{1 - i / 6!r}*coalesce(sum(u*u{i}),0)" for i in range(1, 6)) + """))/count(*) AS se FROM g GROUP BY 1)"""


@query("m5_summary_table", "WITH " + (_ST + _NW)[2:] + """ SELECT c0.track, avg(r)*252 AS mean_ann, stddev_samp(r)*sqrt(252.0) AS std_ann, avg(r)/stddev_samp(r)*sqrt(252.0) AS sharpe, skewness(r) AS skew, kurtosis(r) AS kurtosis, max(se)*252 AS nw_se_mean_ann, count(r) AS n_obs FROM c0 JOIN nw ON nw.track=c0.track GROUP BY 1""", use="bt",
       floats="mean_ann std_ann sharpe skew kurtosis nw_se_mean_ann", digits=7)
def _(spark, sf):
    t = scaled(spark, sf)
    s = pf.summary_stats(t, min_obs=1).select("track", F.col("ann_return").alias("mean_ann"), F.col("ann_vol").alias("std_ann"), "sharpe", "skew", F.col("excess_kurtosis").alias("kurtosis"), F.col("n_days").alias("n_obs"))
    return s.join(rg.mean_standard_error(t, ["track"], "ret").select("track", (F.col("nw_se") * 252).alias("nw_se_mean_ann")), "track")


@query("m6_max_drawdown", "WITH " + _ST[2:] + """, c2 AS (SELECT *, wealth/greatest(max(wealth) OVER (PARTITION BY track ORDER BY date ROWS UNBOUNDED PRECEDING),1.0)-1 AS ddi FROM c1)
 SELECT track, 'from_returns' AS form, min(dd) AS max_drawdown FROM c2 GROUP BY 1 UNION ALL SELECT track, 'with_initial', min(ddi) FROM c2 GROUP BY 1 UNION ALL SELECT track, 'from_nav', min(dd) FROM c2 GROUP BY 1""", use="bt", floats="max_drawdown")
def _(spark, sf):
    t = scaled(spark, sf)
    nav = pf.wealth_curve(t).select("track", "date", F.col("wealth").alias("nav"))
    parts = {"from_returns": pf.max_drawdown(t), "with_initial": pf.max_drawdown(t, initial=True), "from_nav": pf.max_drawdown_of_nav(nav)}
    out = None
    for n, d in parts.items():
        d = d.withColumn("form", F.lit(n))
        out = d if out is None else out.unionByName(d)
    return out


@query("m7_drawdown_anatomy", "WITH " + _ST[2:] + """, tr AS (SELECT track, min(dd) AS max_drawdown, arg_min(date, (dd, date)) AS trough, max(date) AS e FROM c1 GROUP BY 1), pk AS (SELECT c1.track, max(wealth) AS pw, arg_min(date, (-wealth, date)) AS peak FROM c1 JOIN tr ON tr.track=c1.track WHERE date<=trough GROUP BY 1),
 rc AS (SELECT c1.track, min(date) AS recovery FROM c1 JOIN tr ON tr.track=c1.track JOIN pk ON pk.track=c1.track WHERE date>=trough AND wealth>=pw GROUP BY 1)
 SELECT tr.track, max_drawdown, peak, trough, recovery, CAST(date_diff('day', peak, coalesce(recovery,e)) AS INT) AS days_under_water FROM tr JOIN pk ON pk.track=tr.track LEFT JOIN rc ON rc.track=tr.track""", use="bt", floats="max_drawdown")
def _(spark, sf):
    return pf.drawdown_anatomy(scaled(spark, sf))


@query("m8_asset_cards", """WITH c0 AS (SELECT asset, date, sret/20 AS r, product(1+sret/20) OVER (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING) AS wealth FROM dp WHERE sret IS NOT NULL), c1 AS (SELECT *, wealth/max(wealth) OVER (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING)-1 AS dd FROM c0)
 SELECT asset, avg(r)*252*100 AS ann_return_pct, stddev_samp(r)*sqrt(252.0)*100 AS ann_vol_pct, avg(r)*sqrt(252.0)/stddev_samp(r) AS sharpe, min(dd)*100 AS max_drawdown_pct, avg(CASE WHEN r>0 THEN 1.0 ELSE 0 END)*100 AS hit_rate_pct, count(r) AS n_days FROM c1 GROUP BY 1""", use="dp", floats="ann_return_pct ann_vol_pct sharpe max_drawdown_pct hit_rate_pct", digits=6)
def _(spark, sf):
    p = base.daily(spark, sf).withColumn("ret", F.col("sret") / 20)
    return pf.short_card(p, ["asset"])


@query("m9_yearly_performance", "WITH " + (_SB + _FRAME)[2:] + """, y0 AS (SELECT strategy, month_end, year(month_end) AS year, gross_return AS r, product(1+gross_return) OVER (PARTITION BY strategy, year(month_end) ORDER BY month_end ROWS UNBOUNDED PRECEDING) AS wealth FROM pr),
 y1 AS (SELECT *, wealth/greatest(max(wealth) OVER (PARTITION BY strategy, year ORDER BY month_end ROWS UNBOUNDED PRECEDING),1.0)-1 AS dd FROM y0) SELECT strategy, CAST(year AS INT) AS year, count(r) AS n, product(1+r)-1 AS annual_return, stddev_samp(r)*sqrt(12.0) AS annual_volatility, (product(1+r)-1)/(stddev_samp(r)*sqrt(12.0)) AS sharpe,
 avg(CASE WHEN r>0 THEN 1.0 ELSE 0 END) AS hit_rate, min(dd) AS max_drawdown FROM y1 GROUP BY 1,2""", use="mp", floats="annual_return annual_volatility sharpe hit_rate max_drawdown", digits=7)
def _(spark, sf):
    return pf.yearly_performance(strategy_tracks(spark, sf), ["strategy"])


@query("m10_extreme_months", "WITH " + (_SB + _FRAME)[2:] + """ SELECT * FROM (SELECT strategy, 'worst' AS side, row_number() OVER (PARTITION BY strategy ORDER BY gross_return, month_end) AS rank, month_end, gross_return AS ret FROM pr UNION ALL SELECT strategy, 'best', row_number() OVER (PARTITION BY strategy ORDER BY gross_return DESC, month_end), month_end, gross_return FROM pr) WHERE rank<=10""", use="mp", floats="ret")
def _(spark, sf):
    return pf.extreme_periods(strategy_tracks(spark, sf), 10, ["strategy"])


CRISES = [("slump", "1996-03-31", "1996-12-31"), ("shock", "1998-06-30", "1999-01-31"), ("tail", "2001-01-31", "2001-09-30")]
CRISIS_SQL = "(VALUES ('slump',DATE '1996-03-31',DATE '1996-12-31'),('shock',DATE '1998-06-30',DATE '1999-01-31'),('tail',DATE '2001-01-31',DATE '2001-09-30')) z(win,a,b)"


@query("m11_window_stats", "WITH " + (_SB + _FRAME)[2:] + f""", x0 AS (SELECT strategy, win, month_end, gross_return AS r, product(1+gross_return) OVER (PARTITION BY strategy, win ORDER BY month_end ROWS UNBOUNDED PRECEDING) AS wealth FROM pr JOIN {CRISIS_SQL} ON month_end BETWEEN a AND b), x1 AS (SELECT *, wealth/greatest(max(wealth) OVER (PARTITION BY strategy, win ORDER BY month_end ROWS UNBOUNDED PRECEDING),1.0)-1 AS dd FROM x0)
 SELECT strategy, win AS "window", count(r) AS n, product(1+r)-1 AS window_return, avg(r) AS avg_return, min(r) AS worst, arg_min(month_end, (r, month_end)) AS worst_date, min(dd) AS max_drawdown FROM x1 GROUP BY 1,2""", use="mp", floats="window_return avg_return worst max_drawdown")
def _(spark, sf):
    return pf.window_stats(strategy_tracks(spark, sf), CRISES, ["strategy"])


#: Windows that meet and overlap, besides the named ones.
_PHASES = [*CRISES, ("late", "1998-02-01", "1998-06-30")]
_PHASES_SQL = "(VALUES " + ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in _PHASES) + ") ph(win, a, b)"


@query("m11_pre_and_during", "WITH " + (_SB + _FRAME)[2:] + f""", x AS (SELECT strategy, win, month_end, gross_return AS r, month_end BETWEEN a AND b AS inside FROM pr JOIN {_PHASES_SQL} ON month_end BETWEEN a AND b OR (month_end<last_day(a) AND month_end>=last_day(a - INTERVAL 3 MONTH)))
 SELECT strategy, win AS "window", count(DISTINCT month_end) FILTER (NOT inside) AS n_pre, count(DISTINCT month_end) FILTER (inside) AS n_during, avg(r) FILTER (NOT inside) AS ret_pre, avg(r) FILTER (inside) AS ret_during, avg(r) FILTER (inside)-avg(r) FILTER (NOT inside) AS ret_change FROM x GROUP BY 1,2""", use="mp", floats="ret_pre ret_during ret_change")
def _(spark, sf):
    return pf.phase_averages(strategy_tracks(spark, sf), ["ret"], _PHASES, ["strategy"])


@query("m11_modal_baskets", "WITH " + _SB[2:] + f""", n AS (SELECT strategy, win, asset, count(*) AS c FROM wt JOIN {CRISIS_SQL} ON month_end BETWEEN a AND b WHERE basket='long_high_carry' GROUP BY 1,2,3) SELECT strategy, win AS "window", arg_min(asset, (-c, asset)) AS modal_long FROM n GROUP BY 1,2""", use="mp")
def _(spark, sf):
    w = base.sample_books(spark, sf).filter("basket = 'long_high_carry'")
    return pf.modal_value(pf.tag_windows(w, CRISES), ["strategy", "window"], "asset", "modal_long")


@query("j7_interval_tags", f"SELECT month_end, asset, win AS \"window\", spot FROM mp0 JOIN {CRISIS_SQL} ON month_end BETWEEN a AND b", use="mp0", floats="spot")
def _(spark, sf):
    return pf.tag_windows(base.monthly(spark, sf), CRISES).select("month_end", "asset", "window", "spot")


@query("m12_stats_by_regime", "WITH " + (_REG + _ST)[2:] + """, x AS (SELECT c0.date, track, r, lag(regime) OVER (PARTITION BY track ORDER BY c0.date) AS regime FROM c0 LEFT JOIN rg ON rg.date=c0.date), y AS (SELECT track, regime, r FROM x WHERE regime IS NOT NULL UNION ALL SELECT track, 'All', r FROM x WHERE regime IS NOT NULL),
 z AS (SELECT track, regime, count(r) AS n, avg(r)*252 AS ann_return, stddev_samp(r)*sqrt(252.0) AS ann_vol, avg(r)*sqrt(252.0)/stddev_samp(r) AS sharpe, skewness(r) AS skew, avg(CASE WHEN r>0 THEN 1.0 ELSE 0 END) AS hit_rate, min(r) AS worst, sum(r) AS s FROM y GROUP BY 1,2)
 SELECT a.* EXCLUDE (s), a.s/b.s AS return_share, a.n/b.n AS time_share FROM z a JOIN z b ON b.track=a.track AND b.regime='All'""", use="bt od qd", floats="ann_return ann_vol sharpe skew hit_rate worst return_share time_share", digits=6)
def _(spark, sf):
    w = Window.partitionBy("track").orderBy("date")
    j = scaled(spark, sf).join(regimes(spark, sf).select("date", "regime"), "date", "left")
    return pf.conditional_stats(j.withColumn("regime", F.lag("regime").over(w)))


@query("m13_split_stats", "WITH " + _ST[2:] + """, x0 AS (SELECT track, seg, date, r, product(1+r) OVER (PARTITION BY track, seg ORDER BY date ROWS UNBOUNDED PRECEDING) AS w FROM c0 JOIN (VALUES ('s0',DATE '1900-01-01',DATE '1997-01-01'),('s1',DATE '1997-01-01',DATE '1999-01-04'),('s2',DATE '1999-01-04',DATE '2999-12-31')) z(seg,a,b) ON date BETWEEN a AND b),
 x1 AS (SELECT *, w/max(w) OVER (PARTITION BY track, seg ORDER BY date ROWS UNBOUNDED PRECEDING)-1 AS dd FROM x0) SELECT track, seg AS segment, min(date) AS start, max(date) AS "end", count(r) AS n_days, avg(r)*252 AS ann_return, stddev_samp(r)*sqrt(252.0) AS ann_vol, avg(r)*sqrt(252.0)/stddev_samp(r) AS sharpe, min(dd) AS max_dd FROM x1 GROUP BY 1,2""", use="bt", floats="ann_return ann_vol sharpe max_dd")
def _(spark, sf):
    return pf.split_stats(scaled(spark, sf), ["1997-01-01", "1999-01-04"])


@query("m14_composition", "WITH " + _SB[2:] + """ SELECT strategy, asset, avg(CASE WHEN basket='long_high_carry' THEN 1.0 ELSE 0 END) AS long_rate, avg(CASE WHEN basket='short_low_carry' THEN 1.0 ELSE 0 END) AS short_rate, avg(weight) AS avg_weight,
 greatest(avg(CASE WHEN basket='long_high_carry' THEN 1.0 ELSE 0 END), avg(CASE WHEN basket='short_low_carry' THEN 1.0 ELSE 0 END))>=0.2 AS concentrated FROM wt GROUP BY 1,2""", use="mp", floats="long_rate short_rate avg_weight")
def _(spark, sf):
    return at.composition(base.sample_books(spark, sf), warn_at=0.2)


@query("w13_selection_frequency", "WITH " + _SB[2:] + """, g AS (SELECT a.strategy, a.asset, m.month_end, coalesce(basket,'') AS basket FROM (SELECT DISTINCT strategy, asset FROM wt) a JOIN (SELECT DISTINCT strategy, month_end FROM wt) m ON m.strategy=a.strategy LEFT JOIN wt ON wt.strategy=a.strategy AND wt.asset=a.asset AND wt.month_end=m.month_end)
 SELECT strategy, asset, month_end, CASE WHEN count(*) OVER w>=12 THEN avg(CASE WHEN basket='long_high_carry' THEN 1.0 ELSE 0 END) OVER w END AS long_share, CASE WHEN count(*) OVER w>=12 THEN avg(CASE WHEN basket='short_low_carry' THEN 1.0 ELSE 0 END) OVER w END AS short_share FROM g WINDOW w AS (PARTITION BY strategy, asset ORDER BY month_end ROWS BETWEEN 35 PRECEDING AND CURRENT ROW)""", use="mp", floats="long_share short_share")
def _(spark, sf):
    return at.selection_frequency(base.sample_books(spark, sf))


_SPLIT = """WITH x AS (SELECT asset, {s} AS s, {r} AS r, median({s}) OVER (PARTITION BY asset) AS m FROM {t} WHERE {s} IS NOT NULL AND {r} IS NOT NULL)
 SELECT asset, count(*) AS obs_months, avg(s) AS avg_signal, corr(s,r) AS signal_return_corr, avg(r) FILTER (WHERE s>m) AS avg_return_high, avg(r) FILTER (WHERE NOT s>m) AS avg_return_low FROM x GROUP BY 1 HAVING count(*)>=24"""


@query("m15_signal_split", _SPLIT.format(s="carry_signal", r="realized", t="mp"), use="mp", floats="avg_signal signal_return_corr avg_return_high avg_return_low", digits=7)
def _(spark, sf):
    return pf.signal_split(base.monthly(spark, sf), "carry_signal", "realized")


@query("m18_regime_counts", "WITH " + _REG[2:] + """, x AS (SELECT 'all' AS period, regime FROM rg WHERE regime IS NOT NULL UNION ALL SELECT CAST(year(date) AS VARCHAR), regime FROM rg WHERE regime IS NOT NULL) SELECT period, regime, count(*) AS days, count(*)*1.0/sum(count(*)) OVER (PARTITION BY period) AS share FROM x GROUP BY 1,2""", use="od qd", floats="share")
def _(spark, sf):
    return pf.regime_counts(regimes(spark, sf))



@query("m20_trade_days_and_exposure", "WITH " + (bs.legs("b") + bs.weights("b") + bs.daily("b"))[2:] + """, x AS (SELECT date, sum(abs(d)) AS t, sum(weight) AS net FROM (SELECT date, weight, weight-coalesce(lag(weight) OVER (PARTITION BY asset ORDER BY date),0) AS d FROM bd) GROUP BY 1)
 SELECT last_day(date) AS month_end, count(*) FILTER (WHERE t>1e-12) AS trade_days, avg(net) AS avg_net FROM x GROUP BY 1""", use="dp dense", floats="avg_net")
def _(spark, sf):
    from panelspark.operators.costs import weight_changes
    w = base.unit_weights(spark, sf)
    d = weight_changes(w).groupBy("date").agg(F.sum(F.abs("dw")).alias("t"), F.sum("weight").alias("net"))
    return d.groupBy(F.last_day("date").alias("month_end")).agg(F.count(F.when(F.col("t") > 1e-12, 1)).alias("trade_days"), F.avg("net").alias("avg_net"))
