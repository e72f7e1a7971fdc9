"""Turnover, spreads and costs (C), cost scenarios (P21)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.config import ROLL_COST_BPS
from panelspark.operators import holdings
from panelspark.operators import convert as cv
from panelspark.operators import costs as cs
from panelspark.plans import monthly as pm
from panelspark.queries import base, booksql as bs
from panelspark.queries.book import _SB
from panelspark.queries.registry import query

_BOOK = (bs.legs("b") + bs.weights("b") + bs.daily("b"))[2:]
_DW = """, dw AS (SELECT *, weight-lag(weight) OVER (PARTITION BY asset ORDER BY date) AS d, weight-coalesce(lag(weight) OVER (PARTITION BY asset ORDER BY date),0) AS d0 FROM bd)"""


@query("c1_turnover_by_date", "WITH " + _BOOK + _DW + " SELECT date, avg(abs(d)) AS mean_abs, sum(abs(d0)) AS total FROM dw GROUP BY 1", use="dp dense", floats="mean_abs total")
def _(spark, sf):
    w = base.unit_weights(spark, sf)
    total = cs.daily_turnover(w).select("date", F.col("turnover").alias("total"))
    return cs.mean_abs_turnover(w).withColumnRenamed("turnover", "mean_abs").join(total, "date")


@query("c1_period_turnover", "WITH " + _BOOK + _DW + """, pp AS (SELECT last_day(date) AS label, sum(abs(d0))/2 AS o, sum(abs(weight)) AS g FROM dw GROUP BY 1) SELECT avg(o) AS turnover, count(*) AS periods FROM pp WHERE label>=(SELECT min(label) FROM pp WHERE g>0)""", use="dp dense", floats="turnover")
def _(spark, sf):
    return cs.period_turnover(base.unit_weights(spark, sf))


@query("c1_asset_turnover", "WITH " + _BOOK + _DW + " SELECT asset, sum(abs(d0)) AS turnover FROM dw GROUP BY 1", use="dp dense", floats="turnover")
def _(spark, sf):
    return cs.asset_turnover(base.unit_weights(spark, sf))


TRADES = _SB + """, gm AS (SELECT s.strategy, s.asset, m.month_end FROM (SELECT strategy, asset, min(month_end) AS lo FROM wt GROUP BY 1,2) s JOIN (SELECT DISTINCT strategy, month_end FROM wt) m ON m.strategy=s.strategy AND m.month_end>=s.lo),
 td AS (SELECT g.strategy, g.asset, g.month_end, basket, coalesce(weight,0) AS weight, coalesce(weight,0)-coalesce(lag(coalesce(weight,0)) OVER (PARTITION BY g.strategy, g.asset ORDER BY g.month_end),0) AS dw FROM gm g LEFT JOIN wt ON wt.strategy=g.strategy AND wt.asset=g.asset AND wt.month_end=g.month_end)"""


def trades(spark, sf):
    w = base.sample_books(spark, sf).select("strategy", "month_end", "asset", "weight", "basket")
    return cs.rebalancing_trades(w, ["strategy"])


@query("c2_monthly_rebalancing", "WITH " + TRADES[2:] + """ SELECT *, CASE WHEN count(turnover) OVER w>=6 THEN avg(turnover) OVER w END AS turnover_12m FROM (SELECT strategy, month_end, sum(abs(dw)) AS turnover, sum(abs(weight)) AS roll_notional FROM td GROUP BY 1,2) WINDOW w AS (PARTITION BY strategy ORDER BY month_end ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""", use="mp", floats="turnover roll_notional turnover_12m")
def _(spark, sf):
    return cs.monthly_rebalancing(trades(spark, sf), ["strategy"])


@query("c2_asset_activity", "WITH " + TRADES[2:] + """ SELECT strategy, asset, sum(abs(dw)) AS total_traded, avg(abs(dw)) AS avg_traded, count(*) FILTER (WHERE abs(dw)>1e-12) AS months_traded, avg(CASE WHEN basket='long_high_carry' THEN 1.0 ELSE 0 END) AS long_rate,
 avg(CASE WHEN basket='short_low_carry' THEN 1.0 ELSE 0 END) AS short_rate FROM td WHERE basket IS NOT NULL GROUP BY 1,2""", use="mp", floats="total_traded avg_traded long_rate short_rate")
def _(spark, sf):
    return cs.asset_activity(trades(spark, sf), ["strategy"])


@query("c3_half_spreads", "WITH " + bs.HS[2:] + " SELECT date, asset, hs_out, hs_pts FROM hs", use="dense", floats="hs_out hs_pts")
def _(spark, sf):
    return cs.half_spreads(base.point_sides(base.staged_daily(spark, sf)))


@query("c4_cost_models", """SELECT date, asset, CASE WHEN s>0 THEN bid WHEN s<0 THEN ask ELSE mid END AS unit_return, mid AS zero_cost FROM (SELECT date, asset, mid, bid, ask, sign(points) AS s FROM qd)""", use="qd", floats="unit_return zero_cost")
def _(spark, sf):
    from panelspark.sources import tables as tb
    q = tb.quotes_daily(spark, sf).withColumns({"rx": F.col("mid"), "rx_net_long": F.col("bid"), "rx_net_short": F.col("ask")})
    w = F.signum("points")
    return q.select("date", "asset", cs.bid_ask_unit_return(w).alias("unit_return"), cs.zero_cost_unit_return(w).alias("zero_cost"))


def unit_costs(spark, sf):
    p, reb, by_date = base.unit_book(spark, sf)
    return holdings.trade_costs(holdings.trades(holdings.held(reb), by_date), by_date, base.spreads(p))


@query("c5_roundtrip_cost", "WITH " + _BOOK + bs.HS + bs.costs("b", "bd", "kc") + " SELECT date, cost FROM kc", use="dp dense", floats="cost")
def _(spark, sf):
    return unit_costs(spark, sf)


@query("c6_spread_table", "WITH " + bs.HS[2:] + " SELECT asset, median(hs_out)*1e4 AS outright_bp, median(hs_pts)*1e4 AS points_bp FROM hs GROUP BY 1", use="dense", floats="outright_bp points_bp", digits=5)
def _(spark, sf):
    return cs.spread_table(cs.half_spreads(base.point_sides(base.staged_daily(spark, sf))))


@query("c6_cost_drag", "WITH " + _BOOK + bs.HS + bs.costs("b", "bd", "kc") + " SELECT avg(cost)*252 AS annual_drag FROM kc", use="dp dense", floats="annual_drag", digits=7)
def _(spark, sf):
    return cs.cost_drag(unit_costs(spark, sf))


COSTED = TRADES + """, mr AS (SELECT strategy, month_end, sum(abs(dw)) AS turnover FROM td GROUP BY 1,2), pf AS (SELECT wt.strategy, wt.month_end, sum(weight*realized) AS gross, sum(abs(weight)) AS roll_notional FROM wt GROUP BY 1,2),
 cost AS (SELECT p.strategy, p.month_end, gross, 'roll' AS kind, bps, roll_notional*bps/10000.0 AS cost, gross-roll_notional*bps/10000.0 AS net FROM pf p CROSS JOIN (SELECT unnest([2,5,10,25,50]) AS bps)
 UNION ALL SELECT p.strategy, p.month_end, gross, 'rebalancing', bps, turnover*bps/10000.0, gross-turnover*bps/10000.0 FROM pf p JOIN mr ON mr.strategy=p.strategy AND mr.month_end=p.month_end CROSS JOIN (SELECT unnest([2,5,10,25,50]) AS bps))"""


def costed(spark, sf):
    """Monthly strategy returns at every roll and rebalancing cost level."""
    f = pm.strategy_frame(base.sample_books(spark, sf), with_names=False).withColumnRenamed("gross_return", "gross").drop("hhi", "effective_n")
    t = cs.monthly_rebalancing(trades(spark, sf), ["strategy"]).select("strategy", "month_end", "turnover")
    f = f.join(t, ["strategy", "month_end"])
    a = cv.cost_scenarios(f, ROLL_COST_BPS, "roll_notional", "roll")
    b = cv.cost_scenarios(f, ROLL_COST_BPS, "turnover", "rebalancing")
    return a.unionByName(b).select("strategy", "month_end", "gross", "kind", "bps", "cost", "net")


@query("p21_cost_scenarios", "WITH " + COSTED[2:] + " SELECT strategy, month_end, kind, bps, cost, net FROM cost", use="mp", floats="cost net")
def _(spark, sf):
    return costed(spark, sf).drop("gross")


@query("j3_weights_left_join", "WITH " + _SB[2:] + """ SELECT sp.strategy, sp.month_end, sp.asset, coalesce(wt.weight,0) AS weight FROM sp LEFT JOIN wt ON wt.strategy=sp.strategy AND wt.month_end=sp.month_end AND wt.asset=sp.asset""", use="mp", floats="weight")
def _(spark, sf):
    s = base.samples(spark, sf).select(F.col("sample").alias("strategy"), "month_end", "asset")
    w = base.sample_books(spark, sf).select("strategy", "month_end", "asset", "weight")
    return s.join(w, ["strategy", "month_end", "asset"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
