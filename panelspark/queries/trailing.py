"""Trailing windows (W) and pair correlations (W14, M16, M17)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.functions import calendar as cal
from panelspark.operators import cross_section as xs
from panelspark.operators import performance as pf
from panelspark.operators import trailing as tr
from panelspark.queries import base
from panelspark.queries.registry import query
from panelspark.sources import tables as tb


def frame(n):
    return f"(PARTITION BY asset ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def tframe(n, key="track"):
    return f"(PARTITION BY {key} ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_MS = """, ms AS (SELECT g.month_end, g.asset, value FROM (SELECT DISTINCT month_end FROM om) m CROSS JOIN (SELECT DISTINCT asset FROM om) a JOIN (SELECT month_end, asset FROM (SELECT DISTINCT month_end FROM om) CROSS JOIN (SELECT DISTINCT asset FROM om)) g ON g.month_end=m.month_end AND g.asset=a.asset LEFT JOIN om ON om.month_end=g.month_end AND om.asset=g.asset)"""


@query("w1_lag_lead_change", """SELECT date, asset, lag(mid,2) OVER w AS lag2, lead(mid) OVER w AS lead1, mid-lag(mid) OVER w AS diff1, mid/lag(mid,5) OVER w-1 AS pct5 FROM dense WINDOW w AS (PARTITION BY asset ORDER BY date)""", use="dense", floats="lag2 lead1 diff1 pct5")
def _(spark, sf):
    w = Window.partitionBy("asset").orderBy("date")
    m = F.col("mid")
    return cal.densify(tb.quotes_daily(spark, sf)).select(
        "date", "asset", F.lag(m, 2).over(w).alias("lag2"), F.lead(m).over(w).alias("lead1"), (m - F.lag(m).over(w)).alias("diff1"), (m / F.lag(m, 5).over(w) - 1).alias("pct5"))


@query("w2_momentum", f"""SELECT date, asset, mom63, lag(m21, 5) OVER (PARTITION BY asset ORDER BY date) AS mom21_skip5 FROM (
 SELECT date, asset, CASE WHEN count(xret) OVER {frame(63)}>=31 THEN sum(xret) OVER {frame(63)} END AS mom63,
 CASE WHEN count(xret) OVER {frame(21)}>=10 THEN sum(xret) OVER {frame(21)} END AS m21 FROM dp)""", use="dp", floats="mom63 mom21_skip5")
def _(spark, sf):
    p = tr.momentum(base.daily(spark, sf), "xret", 63, out="mom63")
    return tr.momentum(p, "xret", 21, 5, "mom21_skip5").select("date", "asset", "mom63", "mom21_skip5")


@query("w3_trailing_vol", f"""SELECT date, asset, CASE WHEN count(xret) OVER {frame(60)}>=30 THEN stddev_samp(xret) OVER {frame(60)} END AS vol,
 CASE WHEN count(xret) OVER {frame(60)}>=20 THEN stddev_samp(xret) OVER {frame(60)}*sqrt(252.0) END AS ann_vol FROM dp""", use="dp", floats="vol ann_vol")
def _(spark, sf):
    p = tr.trailing_vol(base.daily(spark, sf), "xret", 60)
    return tr.trailing_vol(p, "xret", 60, tr.vol_min_periods(60), True, "ann_vol").select("date", "asset", "vol", "ann_vol")


@query("w4_trailing_skew", f"""SELECT date, asset, CASE WHEN count(xret) OVER {frame(126)}>=63 THEN skewness(xret) OVER {frame(126)} END AS skew FROM dp""", use="dp", floats="skew", digits=6)
def _(spark, sf):
    return tr.trailing_skew(base.daily(spark, sf), "xret", 126).select("date", "asset", "skew")


@query("w5_trailing_rank", f"""SELECT date, asset, CASE WHEN mid IS NOT NULL AND len(a)>=60 THEN (len(list_filter(a, lambda x: x<mid))+(len(list_filter(a, lambda x: x=mid))+1)/2.0)/len(a) END AS pct
 FROM (SELECT date, asset, mid, list(mid) FILTER (WHERE mid IS NOT NULL) OVER {frame(120)} AS a FROM dense)""", use="dense", floats="pct")
def _(spark, sf):
    p = cal.densify(tb.quotes_daily(spark, sf)).select("date", "asset", "mid")
    return tr.trailing_rank(p, "mid", 120).select("date", "asset", "pct")


@query("w6_trailing_quantile", f"SELECT date, asset, CASE WHEN count(mid) OVER {frame(60)}>=24 THEN quantile_cont(mid,0.8) OVER {frame(60)} END AS q80 FROM dense", use="dense", floats="q80")
def _(spark, sf):
    p = cal.densify(tb.quotes_daily(spark, sf)).select("date", "asset", "mid")
    return tr.trailing_quantile(p, "mid", 0.8, 60, 24, "q80").select("date", "asset", "q80")


@query("w7_trailing_drawdown", f"SELECT date, asset, CASE WHEN count(mid) OVER {frame(126)}>=63 THEN mid/max(mid) OVER {frame(126)}-1 END AS dd FROM dense", use="dense", floats="dd")
def _(spark, sf):
    p = cal.densify(tb.quotes_daily(spark, sf)).select("date", "asset", "mid")
    return tr.trailing_drawdown(p, "mid", 126, 63, "dd").select("date", "asset", "dd")


@query("w8_trailing_product", f"SELECT date, track, CASE WHEN count(ret) OVER {tframe(12)}>=12 THEN product(1+ret) OVER {tframe(12)}-1 END AS comp12 FROM bt", use="bt", floats="comp12")
def _(spark, sf):
    return tr.trailing_product(base.tracks(spark, sf), "ret", 12, "comp12", ["track"]).select("date", "track", "comp12")


@query("w9_trailing_zscore", f"SELECT date, asset, CASE WHEN count(carry) OVER {frame(252)}>=63 THEN (carry-avg(carry) OVER {frame(252)})/nullif(stddev_samp(carry) OVER {frame(252)},0) END AS z FROM dp", use="dp", floats="z", digits=6)
def _(spark, sf):
    return tr.trailing_zscore(base.daily(spark, sf), "carry").select("date", "asset", "z")


@query("w10_rolling_ratio", f"""SELECT date, track, CASE WHEN count(ret) OVER {tframe(756)}>=504 THEN avg(ret) OVER {tframe(756)}*sqrt(252.0)/stddev_samp(ret) OVER {tframe(756)} END AS rolling,
 CASE WHEN count(ret) OVER u>=504 THEN avg(ret) OVER u*sqrt(252.0)/stddev_samp(ret) OVER u END AS expanding FROM bt WINDOW u AS (PARTITION BY track ORDER BY date ROWS UNBOUNDED PRECEDING)""", use="bt", floats="rolling expanding")
def _(spark, sf):
    t = pf.rolling_ratio(base.tracks(spark, sf), 756, 504, "rolling")
    return pf.rolling_ratio(t, None, 504, "expanding").select("date", "track", "rolling", "expanding")


_WEALTH = """, c0 AS (SELECT date, track, ret/10 AS ret, product(1+ret/10) OVER (PARTITION BY track ORDER BY date ROWS UNBOUNDED PRECEDING) AS wealth FROM bt),
 c1 AS (SELECT *, max(wealth) OVER (PARTITION BY track ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM c0)"""


def scaled(spark, sf):
    """Tracks at a tenth of their size, so that compounded wealth stays in a sensible range."""
    return base.tracks(spark, sf).withColumn("ret", F.col("ret") / 10)


@query("w11_wealth_drawdown", "WITH " + _WEALTH[2:] + " SELECT date, track, wealth, wealth/peak-1 AS drawdown, wealth/lag(wealth,12) OVER (PARTITION BY track ORDER BY date)-1 AS trailing_return FROM c1", use="bt", floats="wealth drawdown trailing_return", digits=6)
def _(spark, sf):
    return pf.wealth_curve(scaled(spark, sf), lookback=12).select("date", "track", "wealth", "drawdown", "trailing_return")


@query("w12_cash_nav", """SELECT bt.date, track, product(1+ret/10+coalesce(value/1e10,0)) OVER (PARTITION BY track ORDER BY bt.date ROWS UNBOUNDED PRECEDING) AS nav FROM bt LEFT JOIN od ON od.date=bt.date""", use="bt od", floats="nav", digits=6)
def _(spark, sf):
    cash = tb.orders_daily(spark, sf).select("date", (F.col("value") / 1e10).alias("rate"))
    return pf.cash_nav(scaled(spark, sf), cash).select("date", "track", "nav")


_PAIR_FRAME = "OVER (PARTITION BY i, j ORDER BY t RANGE BETWEEN 125 PRECEDING AND CURRENT ROW)"


@query("w14_rolling_pair_corr", f"""WITH ix AS (SELECT date, dense_rank() OVER (ORDER BY date)-1 AS t FROM (SELECT DISTINCT date FROM dp)),
 grid AS (SELECT t, date, asset FROM ix CROSS JOIN (SELECT DISTINCT asset FROM dp)), v AS (SELECT g.t, g.date, g.asset, xret AS v FROM grid g LEFT JOIN dp USING (date, asset)),
 ok AS (SELECT t, date, asset, v, count(v) OVER (PARTITION BY asset ORDER BY t RANGE BETWEEN 125 PRECEDING AND CURRENT ROW) AS n FROM v),
 pr AS (SELECT a.t, a.date, a.asset AS i, b.asset AS j, a.n>=80 AND b.n>=80 AND a.t>=125 AS live, CASE WHEN b.v IS NOT NULL THEN a.v END AS x, CASE WHEN a.v IS NOT NULL THEN b.v END AS y FROM ok a JOIN ok b ON a.t=b.t AND a.asset<b.asset),
 m AS (SELECT date, live, count(x) {_PAIR_FRAME} AS n, sum(x) {_PAIR_FRAME} AS sx, sum(y) {_PAIR_FRAME} AS sy, sum(x*x) {_PAIR_FRAME} AS sxx, sum(y*y) {_PAIR_FRAME} AS syy, sum(x*y) {_PAIR_FRAME} AS sxy FROM pr),
 c AS (SELECT date, (sxy-sx*sy/n)/sqrt((sxx-sx*sx/n)*(syy-sy*sy/n)) AS c FROM m WHERE live AND n>1 AND sxx-sx*sx/n>0 AND syy-sy*sy/n>0)
 SELECT date, avg(c) AS avg_corr FROM c WHERE NOT isnan(c) GROUP BY 1""", use="dp", floats="avg_corr")
def _(spark, sf):
    p = base.daily(spark, sf).select("date", "asset", "xret")
    return tr.pairwise_rolling_corr(p, "xret", tiles=2)


@query("w15_cumulative", "SELECT date, asset, sum(xret) OVER (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING) AS cum FROM dp", use="dp", floats="cum")
def _(spark, sf):
    return tr.cumulative(base.daily(spark, sf), "xret", "cum").select("date", "asset", "cum")


@query("w17_sign_flips", """SELECT date, asset, sign(carry) AS sign FROM (SELECT date, asset, carry, lag(sign(carry)) OVER (PARTITION BY asset ORDER BY date) AS p FROM dp) WHERE carry IS NOT NULL AND (p IS NULL OR sign(carry)<>p)""", use="dp", floats="sign")
def _(spark, sf):
    return tr.sign_flips(base.daily(spark, sf), "carry").select("date", "asset", "sign")


@query("w18_vol_and_log_momentum", f"""SELECT date, asset, CASE WHEN count(sret) OVER {frame(21)}>=10 THEN stddev_samp(sret) OVER {frame(21)}*sqrt(252.0) END AS ann_vol, ln(spot)-lag(ln(spot),3) OVER (PARTITION BY asset ORDER BY date) AS mom3 FROM dp""", use="dp", floats="ann_vol mom3")
def _(spark, sf):
    p = tr.trailing_vol(base.daily(spark, sf), "sret", 21, annual=True, out="ann_vol")
    return tr.log_momentum(p, "spot", 3, "mom3").select("date", "asset", "ann_vol", "mom3")


@query("m16_pair_correlations", "SELECT a.asset AS asset_i, b.asset AS asset_j, count(*) AS n, corr(a.xret,b.xret) AS corr FROM dp a JOIN dp b ON a.date=b.date AND a.asset<b.asset WHERE a.xret IS NOT NULL AND b.xret IS NOT NULL GROUP BY 1,2", use="dp", floats="corr")
def _(spark, sf):
    p = base.daily(spark, sf)
    return tr.pair_moments(p, "xret", tiles=3).select("asset_i", "asset_j", "n", "corr")


@query("m16_track_correlations", """SELECT a.track AS asset_i, b.track AS asset_j, a.freq, count(*) AS n, corr(a.ret,b.ret) AS corr FROM (SELECT 'D' AS freq, date, track, ret FROM bt UNION ALL SELECT 'M', last_day(date), track, sum(ret) FROM bt GROUP BY 2,3) a
 JOIN (SELECT 'D' AS freq, date, track, ret FROM bt UNION ALL SELECT 'M', last_day(date), track, sum(ret) FROM bt GROUP BY 2,3) b ON a.freq=b.freq AND a.date=b.date AND a.track<b.track GROUP BY 1,2,3""", use="bt", floats="corr")
def _(spark, sf):
    d = base.tracks(spark, sf)
    m = pf.resample_returns(d, "M").select("track", F.col("label").alias("date"), F.col("total").alias("ret"))
    both = d.withColumn("freq", F.lit("D")).unionByName(m.withColumn("freq", F.lit("M")))
    return tr.pair_moments(both, "ret", ["freq"], asset="track").select("asset_i", "asset_j", "freq", "n", "corr")


ERAS = [("early", "1995-01-01", "1997-12-31"), ("middle", "1997-01-01", "1999-12-31"), ("late", "2000-01-01", "2001-12-31")]
ERA_SQL = "(VALUES ('early',DATE '1995-01-01',DATE '1997-12-31'),('middle',DATE '1997-01-01',DATE '1999-12-31'),('late',DATE '2000-01-01',DATE '2001-12-31')) e(era,a,b)"


@query("m17_era_correlation", f"""WITH x AS (SELECT era, date, asset, xret FROM dp JOIN {ERA_SQL} ON date BETWEEN e.a AND e.b WHERE xret IS NOT NULL), c AS (SELECT p.era, p.asset i, q.asset j, corr(p.xret,q.xret) AS c FROM x p JOIN x q ON p.era=q.era AND p.date=q.date AND p.asset<q.asset GROUP BY 1,2,3)
 SELECT era, avg(c) AS avg_corr, max(c) AS max_corr, min(c) AS min_corr, count(c) AS n_pairs FROM c WHERE NOT isnan(c) GROUP BY 1""", use="dp", floats="avg_corr max_corr min_corr")
def _(spark, sf):
    p = pf.tag_windows(base.daily(spark, sf), ERAS, "date", "era")
    return tr.average_corr(tr.pair_moments(p, "xret", ["era"]), ["era"])
