"""Portfolio construction (B), filters inside the sort (F6, F7), scalars and regimes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.functions import calendar as cal
from panelspark.functions.stats import div
from panelspark.operators import book as bk
from panelspark.operators import holdings
from panelspark.operators import convert as cv
from panelspark.operators import cross_section as xs
from panelspark.operators import performance as pf
from panelspark.operators import trailing as tr
from panelspark.plans import monthly as pm
from panelspark.queries import base, booksql as bs
from panelspark.queries.convert import _P5, _P5SEL, SAMPLE_SQL
from panelspark.queries.cross_section import OC_SQL, _K, legs_sql, option_carry
from panelspark.queries.registry import query
from panelspark.session import cut_lineage
from panelspark.sources import tables as tb

_SB = f""", sp AS (SELECT sample AS strategy, * EXCLUDE (sample) FROM ({SAMPLE_SQL})), lg AS (SELECT *, {_K} AS k FROM (SELECT *, row_number() OVER (PARTITION BY strategy, month_end ORDER BY carry_signal, asset) AS rn, count(*) OVER (PARTITION BY strategy, month_end) AS n FROM sp WHERE carry_signal IS NOT NULL AND realized IS NOT NULL)),
 wt AS (SELECT *, CASE WHEN rn>n-k THEN 1.0::DOUBLE/k WHEN rn<=k THEN -1.0::DOUBLE/k ELSE 0.0::DOUBLE END AS weight, CASE WHEN rn>n-k THEN 'long_high_carry' WHEN rn<=k THEN 'short_low_carry' ELSE 'middle' END AS basket FROM lg WHERE k>0 AND n>=2*k)"""


@query("b1_portfolio_return", "WITH " + legs_sql()[2:] + " SELECT month_end, sum(weight*realized) AS ret FROM wt GROUP BY 1", use="mp", floats="ret")
def _(spark, sf):
    m = base.monthly(spark, sf)
    w = xs.equal_leg_weights(m, ["month_end"], "carry_signal", xs.adaptive_leg_size, "realized")
    return bk.book_returns(w.select("month_end", "asset", "weight"), m, ret="realized", date="month_end")


_B2 = """, p AS (SELECT *, CASE WHEN carry IS NOT NULL THEN greatest(1, least(4, ceil(row_number() OVER (PARTITION BY date ORDER BY carry NULLS LAST, asset)::DOUBLE/count(carry) OVER (PARTITION BY date)*4))) END AS bno FROM dp),
 q AS (SELECT date, asset, xret, lag(bno) OVER (PARTITION BY asset ORDER BY date) AS b FROM p), r AS (SELECT date, b, coalesce(sum(xret),0)/count(*) AS ret FROM q WHERE b IS NOT NULL GROUP BY 1,2),
 br AS (SELECT d.date, CAST(i.bucket_no AS INT) AS bucket_no, coalesce(r.ret,0) AS ret FROM (SELECT DISTINCT date FROM dp) d CROSS JOIN (SELECT unnest([1,2,3,4]) AS bucket_no) i LEFT JOIN r ON r.date=d.date AND r.b=i.bucket_no)"""


def carry_buckets(spark, sf):
    p = base.daily(spark, sf).select("date", "asset", "carry", "xret")
    return bk.bucket_returns(xs.rank_buckets(p, ["date"], "carry", 4), "xret", 4)


@query("b2_bucket_returns", "WITH " + _B2[2:] + " SELECT * FROM br", use="dp", floats="ret")
def _(spark, sf):
    return carry_buckets(spark, sf)


@query("x8_high_minus_low_buckets", "WITH " + _B2[2:] + " SELECT date, max(ret) FILTER (WHERE bucket_no=4)-max(ret) FILTER (WHERE bucket_no=1) AS hml, avg(ret) AS average FROM br GROUP BY 1", use="dp", floats="hml average")
def _(spark, sf):
    return bk.high_minus_low(carry_buckets(spark, sf), 4)


@query("x8_hml_factor", """WITH t AS (SELECT last_day(date) AS label, asset, max_by(carry,date) AS s FROM dp GROUP BY 1,2), r AS (SELECT *, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY s, asset) AS lo, row_number() OVER (PARTITION BY label ORDER BY s DESC, asset) AS hi FROM t WHERE s IS NOT NULL),
 hw AS (SELECT t.label, t.asset, coalesce(CASE WHEN hi<=n//3 THEN 1.0::DOUBLE/(n//3) WHEN lo<=n//3 THEN -1.0::DOUBLE/(n//3) ELSE 0.0 END,0.0) AS weight FROM t LEFT JOIN (SELECT * FROM r WHERE n>=6) r ON r.label=t.label AND r.asset=t.asset) """ + bs.daily("h").replace(", he AS", ", he AS", 1) + bs.returns("h", "hd", "hr") + " SELECT date, ret AS hml FROM hr", use="dp dense", floats="hml")
def _(spark, sf):
    p = base.daily(spark, sf)
    w = bk.apply_daily(bk.hml_weights(p), p)
    return bk.book_returns(w, p, out="hml")


@query("b3_sign_strategy", """WITH s AS (SELECT date, asset, xret, sign(carry)/nullif(count(carry) OVER (PARTITION BY date),0) AS w FROM dp), l AS (SELECT date, xret, lag(w) OVER (PARTITION BY asset ORDER BY date) AS w FROM s) SELECT date, coalesce(sum(w*xret),0) AS ret FROM l GROUP BY 1""", use="dp", floats="ret")
def _(spark, sf):
    return bk.sign_strategy(base.daily(spark, sf).select("date", "asset", "carry", "xret"), "carry", "xret")


@query("b4_inverse_vol_book", "WITH " + (bs.legs("b") + bs.weights("b"))[2:] + " SELECT label, asset, weight FROM bw", use="dp", floats="weight")
def _(spark, sf):
    return bk.sorted_book(base.daily(spark, sf), n_buckets=base.BUCKETS)


@query("b4_equal_tight_cap", "WITH " + (bs.legs("b", n=3, least=1) + bs.weights("b", cap=0.15, raw="vol"))[2:] + " SELECT label, asset, leg, share FROM bc10", use="dp", floats="share")
def _(spark, sf):
    """The cap at work: shares proportional to volatility under a tight cap."""
    p = base.daily(spark, sf)
    tab = bk.rebalance_table(p, "carry").filter("carry is not null and _vol > 0")
    legs = xs.assign_legs(tab, ["label"], "carry", xs.divided_leg_size(3), ties="first").filter("k >= 1 and leg <> 0")
    return bk.cap_shares(legs, ["label", "leg"], "_vol", 0.15).select("label", "asset", "leg", "share")


@query("b4_daily_weights", "WITH " + (bs.legs("b") + bs.weights("b", raw="1.0::DOUBLE") + bs.daily("b"))[2:] + " SELECT date, asset, weight FROM bd", use="dp dense", floats="weight")
def _(spark, sf):
    return base.unit_weights(spark, sf, weighting="equal")


@query("f7_directional_filter", "WITH m AS (SELECT *, CASE WHEN count(xret) OVER w>=31 THEN sum(xret) OVER w END AS mom FROM dp WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW))" + bs.legs("b", src="m", filt="mom") + bs.weights("b") + " SELECT label, asset, weight FROM bw", use="dp", floats="weight")
def _(spark, sf):
    p = tr.momentum(base.daily(spark, sf), "xret", 63)
    return bk.sorted_book(p, n_buckets=base.BUCKETS, filter_signal="mom")


@query("b5_fraction_book", """WITH v AS (SELECT date, asset, carry, CASE WHEN count(xret) OVER w>=20 THEN stddev_samp(xret) OVER w*sqrt(252.0) END AS vol FROM dp WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
 r AS (SELECT *, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY carry, asset) AS lo, row_number() OVER (PARTITION BY date ORDER BY carry DESC, asset) AS hi FROM v WHERE carry IS NOT NULL),
 l AS (SELECT *, CASE WHEN hi<=greatest(1,ceil(n*0.3::DOUBLE)) THEN 1 WHEN lo<=greatest(1,ceil(n*0.3::DOUBLE)) THEN -1 ELSE 0 END AS leg FROM r WHERE n>=4)
 SELECT date, asset, coalesce(CASE WHEN leg<>0 THEN 0.5*leg*(1/vol)/sum(1/vol) OVER (PARTITION BY date, leg) END, 0) AS weight FROM l""", use="dp", floats="weight")
def _(spark, sf):
    return bk.fraction_book(base.daily(spark, sf))


@query("b6_simple_book", """WITH t AS (SELECT month_end, asset, weight FROM (""" + "WITH " + legs_sql()[2:] + """ SELECT * FROM wt)), g AS (SELECT mp.month_end AS date, mp.asset, realized AS ret, coalesce(last_value(t.weight IGNORE NULLS) OVER (PARTITION BY mp.asset ORDER BY mp.month_end ROWS UNBOUNDED PRECEDING),0) AS w FROM mp LEFT JOIN t ON t.asset=mp.asset AND t.month_end=mp.month_end),
 l AS (SELECT *, lag(w) OVER (PARTITION BY asset ORDER BY date) AS p FROM g), s AS (SELECT date, coalesce(sum(p*ret),0) AS gross, coalesce(sum(abs(w-p)),0) AS turnover FROM l GROUP BY 1) SELECT date, gross, turnover, gross-turnover*0.0005 AS net FROM s""", use="mp", floats="gross turnover net")
def _(spark, sf):
    m = base.monthly(spark, sf)
    w = xs.equal_leg_weights(m, ["month_end"], "carry_signal", xs.adaptive_leg_size, "realized")
    panel = m.select(F.col("month_end").alias("date"), "asset", F.col("realized").alias("ret"))
    return bk.simple_book(w.select(F.col("month_end").alias("date"), "asset", "weight"), panel, "ret", 5.0)


_FRAME = """, pr AS (SELECT strategy, month_end, sum(weight*realized) AS gross_return, sum(abs(weight)) AS roll_notional, sum(weight*weight) AS hhi, 1/sum(weight*weight) AS effective_n, max(k) AS leg_size, max(n) AS n_universe,
 string_agg(asset, ', ' ORDER BY asset) FILTER (WHERE basket='long_high_carry') AS long_basket, string_agg(asset, ', ' ORDER BY asset) FILTER (WHERE basket='short_low_carry') AS short_basket FROM wt GROUP BY 1,2)"""


@query("b7_monthly_strategy", "WITH " + (_SB + _FRAME)[2:] + " SELECT * FROM pr", use="mp", floats="gross_return roll_notional hhi effective_n")
def _(spark, sf):
    return pm.strategy_frame(base.sample_books(spark, sf), with_names=True)


@query("b7_monthly_strategy_options", f"""WITH u AS (SELECT *, count(*) OVER (PARTITION BY month_end) AS n, row_number() OVER (PARTITION BY month_end ORDER BY carry_signal, asset) AS rn FROM mp
  WHERE asset NOT IN ('N02','N08') AND month_end>=DATE '1993-01-01' AND carry_signal IS NOT NULL AND realized IS NOT NULL),
 l AS (SELECT *, greatest({_K}, 6) AS k FROM u), w AS (SELECT *, CASE WHEN rn>n-k THEN 1.0::DOUBLE/k WHEN rn<=k THEN -1.0::DOUBLE/k ELSE 0.0::DOUBLE END AS weight FROM l WHERE n>=2*k),
 r AS (SELECT month_end, sum(weight*realized) AS ret, sum(abs(weight)) AS roll_notional, max(n) AS n_universe, max(k) AS leg_size FROM w GROUP BY 1),
 c AS (SELECT *, product(1+ret) OVER (ORDER BY month_end ROWS UNBOUNDED PRECEDING) AS wealth FROM r)
 SELECT month_end, ret, roll_notional, n_universe, leg_size, wealth, wealth/max(wealth) OVER (ORDER BY month_end ROWS UNBOUNDED PRECEDING)-1 AS drawdown, wealth/lag(wealth,12) OVER (ORDER BY month_end)-1 AS trailing_return FROM c""",
       use="mp", floats="ret roll_notional wealth drawdown trailing_return", digits=6)
def _(spark, sf):
    m = pm.monthly_strategy(base.monthly(spark, sf), "carry_signal", "realized", exclude=["N02", "N08"], start="1993-01-01", weight_cap=0.18)
    return m.select("month_end", "ret", "roll_notional", "n_universe", "leg_size", "wealth", "drawdown", "trailing_return")


@query("f6_well_formed_books", "WITH " + _SB[2:] + """ SELECT strategy, month_end, sum(weight) FILTER (WHERE weight>0) AS gross_long, sum(weight) FILTER (WHERE weight<0) AS gross_short, sum(weight) AS net, sum(abs(weight)) AS gross FROM wt GROUP BY 1,2
 HAVING abs(sum(weight) FILTER (WHERE weight>0)-1)<1e-8 AND abs(sum(weight) FILTER (WHERE weight<0)+1)<1e-8 AND abs(sum(weight))<1e-8 AND abs(sum(abs(weight))-2)<1e-8""", use="mp", floats="gross_long gross_short net gross")
def _(spark, sf):
    return xs.well_formed(pm.book_sums(base.sample_books(spark, sf)))


_B8 = """, fl AS (SELECT * FROM (SELECT *, count(*) OVER w AS cn, quantile_cont(atm_vol,0.8) OVER w AS qv FROM oc WINDOW w AS (PARTITION BY month_end)) WHERE NOT (cn>=5 AND coalesce(atm_vol>=qv,false))),
 lg AS (SELECT *, {K} AS k FROM (SELECT *, row_number() OVER (PARTITION BY month_end ORDER BY carry_signal, asset) AS rn, count(*) OVER (PARTITION BY month_end) AS n FROM fl WHERE carry_signal IS NOT NULL AND realized IS NOT NULL)),
 wt AS (SELECT *, CASE WHEN rn>n-k THEN 1.0::DOUBLE/k WHEN rn<=k THEN -1.0::DOUBLE/k ELSE 0.0::DOUBLE END AS weight FROM lg WHERE k>0 AND n>=2*k),
 r0 AS (SELECT month_end, sum(weight*realized) AS g, sum(abs(weight)) AS rn, max(n) AS n_universe, sum(atm_vol*abs(weight))/sum(abs(weight)) AS avg_vol, sum(bad_skew25*abs(weight))/sum(abs(weight)) AS avg_skew FROM wt GROUP BY 1)""".replace("{K}", _K)


@query("b8_filtered_strategy", "WITH " + (OC_SQL + _B8)[2:] + """, rs AS (SELECT last_day(date) AS month_end, CASE WHEN max_by(value,date)>250000 THEN 0.5 ELSE 1.0 END AS risk_scale FROM od GROUP BY 1),
 z AS (SELECT r0.*, coalesce(least(300.0/nullif(avg_vol,0),1.0),1.0) AS option_vol_scale, coalesce(risk_scale,1.0) AS risk_scale FROM r0 LEFT JOIN rs ON rs.month_end=r0.month_end)
 SELECT month_end, n_universe, avg_vol, avg_skew, option_vol_scale, risk_scale, g*option_vol_scale*risk_scale AS gross_return, rn*option_vol_scale*risk_scale AS roll_notional FROM z""", use="mp ol pairs od", floats="avg_vol avg_skew option_vol_scale risk_scale gross_return roll_notional", digits=6)
def _(spark, sf):
    risk = cal.resample_last(tb.orders_daily(spark, sf).withColumn("k", F.lit(0)), ["value"], ["k"]).select("month_end", F.when(F.col("value") > 250000, 0.5).otherwise(1.0).alias("risk_scale"))
    return pm.filtered_strategy(option_carry(spark, sf), "vol", scale_target=300.0, vol_unit=1.0, risk=risk)


@query("b9_vol_target", "WITH " + bs.book("b")[2:] + " SELECT date, asset, weight FROM bvt", use="dp dense", floats="weight")
def _(spark, sf):
    _, reb, by_date, _ = base.target_book(spark, sf)
    return holdings.day_weights(reb, by_date)


@query("b9_running_scalar", """WITH v AS (SELECT track, date, CASE WHEN count(ret) OVER w>=20 THEN least(greatest(0.1::DOUBLE/(stddev_samp(ret) OVER w*sqrt(252.0)),0.0),4.0) END AS s FROM bt WINDOW w AS (PARTITION BY track ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) SELECT track, date, coalesce(lag(s) OVER (PARTITION BY track ORDER BY date),0) AS scalar FROM v""", use="bt", floats="scalar")
def _(spark, sf):
    return bk.running_target_scalar(base.tracks(spark, sf))


_RANK = """, ra AS (SELECT date, value, CASE WHEN len(a)>=126 THEN (len(list_filter(a, lambda x: x<value))+(len(list_filter(a, lambda x: x=value))+1)/2.0)/len(a) END AS pct FROM (SELECT date, value, list(value) OVER (ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS a FROM od)),
 rm AS (SELECT last_day(date) AS label, max_by(pct,date) AS pct FROM ra GROUP BY 1), rd AS (SELECT date, lag(pct) OVER (ORDER BY date) AS pct FROM (SELECT od.date, rm.pct FROM od ASOF LEFT JOIN rm ON rm.label<=od.date))"""


def indicator(spark, sf):
    return tb.orders_daily(spark, sf).withColumn("asset", F.lit("orders"))


@query("b10_exposure_scalar", "WITH " + _RANK[2:] + """ SELECT date, 'binary' AS method, CASE WHEN pct>0.8 THEN 0.5 ELSE 1.0 END AS scalar FROM rd UNION ALL SELECT date, 'linear', coalesce(1-0.5*least(greatest((pct-0.8::DOUBLE)/(1-0.8::DOUBLE),0),1),1) FROM rd""", use="od", floats="scalar")
def _(spark, sf):
    out = None
    for m in ("binary", "linear"):
        one = bk.exposure_scalar(indicator(spark, sf), lookback=252, method=m).select("date", F.lit(m).alias("method"), "scalar")
        out = one if out is None else out.unionByName(one)
    return out


_OLD = """, lv AS (SELECT month_end, 'a' AS asset, avg(value) AS value FROM om GROUP BY 1 UNION ALL SELECT month_end, 'b', max(value) FROM om GROUP BY 1), lq36 AS (SELECT asset, month_end, CASE WHEN count(value) OVER w>=12 AND value>quantile_cont(value,0.8) OVER w THEN 0.5 ELSE 1.0 END AS scalar FROM lv WINDOW w AS (PARTITION BY asset ORDER BY month_end ROWS BETWEEN 35 PRECEDING AND CURRENT ROW))"""


@query("m18_rule_agreement", "WITH " + (_RANK + _OLD)[2:] + """, a AS (SELECT month_end, max_by(CASE WHEN pct>0.8 THEN 0.5 ELSE 1.0 END, date) AS s FROM (SELECT *, last_day(date) AS month_end FROM rd) GROUP BY 1),
 b AS (SELECT month_end, min(scalar) AS s FROM lq36 GROUP BY 1) SELECT count(*) AS n, avg(CAST(a.s<1 AS DOUBLE)) AS derisked_a, avg(CAST(b.s<1 AS DOUBLE)) AS derisked_b, avg(CAST((a.s<1)=(b.s<1) AS DOUBLE)) AS agreement FROM a JOIN b USING (month_end)""",
       use="od om", floats="derisked_a derisked_b agreement")
def _(spark, sf):
    from panelspark.functions.calendar import resample_last
    from panelspark.operators.performance import rule_agreement
    a = resample_last(bk.exposure_scalar(indicator(spark, sf), lookback=252, method="binary").withColumn("asset", F.lit("x")), ["scalar"])
    o = tb.orders_monthly(spark, sf).groupBy("month_end").agg(F.avg("value").alias("a"), F.max("value").alias("b"))
    b = bk.combine_scalars(bk.level_scalar(o.select(F.col("month_end").alias("date"), F.expr("stack(2, 'a', a, 'b', b) as (asset, value)"))))
    return rule_agreement(a, b, on="month_end")


@query("b11_level_rule", "WITH " + _OLD[2:] + " SELECT month_end, min(scalar) AS scalar FROM lq36 GROUP BY 1", use="om", floats="scalar")
def _(spark, sf):
    o = tb.orders_monthly(spark, sf).groupBy("month_end").agg(F.avg("value").alias("a"), F.max("value").alias("b"))
    lv = o.select(F.col("month_end").alias("date"), F.expr("stack(2, 'a', a, 'b', b) as (asset, value)"))
    return bk.combine_scalars(bk.level_scalar(lv))


@query("b12_apply_scalar", "WITH " + (bs.legs("b") + bs.weights("b") + bs.daily("b") + _RANK)[2:] + """ SELECT w.date, asset, 'all' AS mode, weight*coalesce(CASE WHEN pct>0.8 THEN 0.5 ELSE 1.0 END,1) AS weight FROM bd w LEFT JOIN rd ON rd.date=w.date
 UNION ALL SELECT w.date, asset, 'long', CASE WHEN weight>0 THEN weight*coalesce(CASE WHEN pct>0.8 THEN 0.5 ELSE 1.0 END,1) ELSE weight END FROM bd w LEFT JOIN rd ON rd.date=w.date""", use="dp dense od", floats="weight")
def _(spark, sf):
    w = base.unit_weights(spark, sf)
    s = bk.exposure_scalar(indicator(spark, sf), lookback=252).select("date", "scalar")
    a = bk.apply_scalar(w, s).withColumn("mode", F.lit("all"))
    return a.unionByName(bk.apply_scalar(w, s, long_only=True).withColumn("mode", F.lit("long"))).select("date", "asset", "mode", "weight")


_REG = """, iv AS (SELECT date, 'orders' AS asset, value FROM od UNION ALL SELECT date, 'spread', avg(ask-bid) FROM qd GROUP BY 1),
 rk AS (SELECT date, asset, CASE WHEN len(a)>=126 THEN (len(list_filter(a, lambda x: x<value))+(len(list_filter(a, lambda x: x=value))+1)/2.0)/len(a) END AS pct FROM (SELECT date, asset, value, list(value) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS a FROM iv)),
 rg AS (SELECT date, avg(pct) AS composite, CASE WHEN avg(pct)<=0.7::DOUBLE THEN 'Low' WHEN avg(pct)<=0.9::DOUBLE THEN 'Moderate' WHEN avg(pct) IS NOT NULL THEN 'Crisis' END AS regime FROM rk GROUP BY 1)"""


def regimes(spark, sf):
    spread = tb.quotes_daily(spark, sf).groupBy("date").agg(F.avg(F.col("ask") - F.col("bid")).alias("value")).withColumn("asset", F.lit("spread"))
    return bk.classify_regime(indicator(spark, sf).unionByName(spread), lookback=252)


@query("b13_regime_classes", "WITH " + _REG[2:] + " SELECT date, composite, regime FROM rg", use="od qd", floats="composite")
def _(spark, sf):
    return regimes(spark, sf)


@query("b14_regime_multiplier", "WITH " + _REG[2:] + """, ml AS (SELECT last_day(date) AS label, CASE max_by(regime,date) WHEN 'Low' THEN 1.0 WHEN 'Moderate' THEN 0.75 WHEN 'Crisis' THEN 0.5 END AS m FROM rg GROUP BY 1) SELECT date, coalesce(lag(m) OVER (ORDER BY date),1.0) AS scalar FROM (SELECT rg.date, ml.m FROM rg ASOF LEFT JOIN ml ON ml.label<=rg.date)""", use="od qd", floats="scalar")
def _(spark, sf):
    return bk.regime_multiplier(regimes(spark, sf), {"Low": 1.0, "Moderate": 0.75, "Crisis": 0.5})


@query("b15_risk_off_flags", """WITH t AS (SELECT asset, month_end, value, CASE WHEN count(value) OVER w>=24 THEN quantile_cont(value,0.8) OVER w END AS ql, ln(value)-lag(ln(value),3) OVER (PARTITION BY asset ORDER BY month_end) AS mom,
 value/max(value) OVER (PARTITION BY asset ORDER BY month_end ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)-1 AS dd, row_number() OVER (PARTITION BY asset ORDER BY month_end) AS rn FROM om WINDOW w AS (PARTITION BY asset ORDER BY month_end ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
 u AS (SELECT *, CASE WHEN count(mom) OVER w>=24 THEN quantile_cont(mom,0.8) OVER w END AS qm FROM t WINDOW w AS (PARTITION BY asset ORDER BY month_end ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
 f AS (SELECT month_end, coalesce(bool_or(asset='N01' AND coalesce(value>ql,false)),false) AS high_a, coalesce(bool_or(asset='N02' AND coalesce(value>ql,false)),false) AS high_b, coalesce(bool_or(asset='N03' AND coalesce(mom>qm,false)),false) AS momentum_a, coalesce(bool_or(asset='N04' AND rn>=3 AND dd<-0.3),false) AS equity FROM u GROUP BY 1)
 SELECT *, high_a OR high_b OR momentum_a OR equity AS risk_off_any, CASE WHEN high_a OR high_b OR momentum_a OR equity THEN 0.5 ELSE 1.0 END AS risk_scale FROM f""", use="om", floats="risk_scale")
def _(spark, sf):
    return bk.risk_off_flags(tb.orders_monthly(spark, sf), {"high_a": "N01", "high_b": "N02"}, {"momentum_a": "N03"}, {"equity": "N04"}, floor=-0.3)


@query("b16_probability_exposure", """SELECT month_end, asset, p, CASE WHEN p IS NOT NULL THEN least(greatest((p-0.4::DOUBLE)/(0.6::DOUBLE-0.4::DOUBLE),0),1) END AS exposure, lag(CASE WHEN p IS NOT NULL THEN least(greatest((p-0.4::DOUBLE)/(0.6::DOUBLE-0.4::DOUBLE),0),1) END) OVER (PARTITION BY asset ORDER BY month_end) AS applied, CASE WHEN p>=0.5 THEN 1 ELSE 0 END AS binary
 FROM (SELECT month_end, asset, (row_number() OVER (PARTITION BY month_end ORDER BY carry_signal, asset)-1)::DOUBLE/nullif(count(*) OVER (PARTITION BY month_end)-1,0) AS p FROM mp)""", use="mp", floats="p exposure applied")
def _(spark, sf):
    m = xs.cross_rank(base.monthly(spark, sf), ["month_end"], "carry_signal", name="r", count="n")
    p = m.select("month_end", "asset", div((F.col("r") - 1).cast("double"), F.nullif((F.col("n") - 1).cast("double"), F.lit(0.0))).alias("p"))
    p = p.withColumn("exposure", bk.probability_exposure(F.col("p")))
    w = Window.partitionBy("asset").orderBy("month_end")
    return p.withColumn("applied", F.lag("exposure").over(w)).withColumn("binary", F.when(F.col("p") >= 0.5, 1).otherwise(0))


@query("b17_single_asset_signs", """SELECT date, asset, 'carry' AS rule, lag(sign(carry)) OVER w * xret AS strategy_ret FROM dp WINDOW w AS (PARTITION BY asset ORDER BY date) UNION ALL
 SELECT date, asset, 'momentum', lag(sign(m)) OVER (PARTITION BY asset ORDER BY date) * xret FROM (SELECT date, asset, xret, spot/lag(spot,63) OVER (PARTITION BY asset ORDER BY date)-1 AS m FROM dp)""", use="dp", floats="strategy_ret")
def _(spark, sf):
    p = base.daily(spark, sf)
    w = Window.partitionBy("asset").orderBy("date")
    p = p.withColumn("mom", div(F.col("spot"), F.lag("spot", 63).over(w)) - 1)
    a = bk.single_asset_signs(p, "carry", "xret").select("date", "asset", F.lit("carry").alias("rule"), "strategy_ret")
    return a.unionByName(bk.single_asset_signs(p, "mom", "xret").select("date", "asset", F.lit("momentum").alias("rule"), "strategy_ret"))


@query("b18_blend", "SELECT a.date, 'blend' AS track, 0.5*a.ret+0.5*b.ret AS ret FROM bt a JOIN bt b ON a.date=b.date AND a.track='ASIA' AND b.track='EUROPE'", use="bt", floats="ret")
def _(spark, sf):
    return bk.blend_tracks(base.tracks(spark, sf), {"ASIA": 0.5, "EUROPE": 0.5})


_B19 = "WITH " + _P5[2:] + f""", fp AS ({_P5SEL}), lb AS (SELECT *, CASE WHEN fwd_discount IS NOT NULL THEN greatest(1, least(6, ceil(row_number() OVER (PARTITION BY date ORDER BY fwd_discount NULLS LAST, asset)::DOUBLE/count(fwd_discount) OVER (PARTITION BY date)*6))) END AS bno FROM fp),
 lb2 AS (SELECT *, lag(bno) OVER (PARTITION BY asset ORDER BY date) AS b FROM lb), hd AS (SELECT *, 1.0::DOUBLE/count(*) OVER (PARTITION BY date, b) AS w FROM lb2 WHERE b IS NOT NULL),
 rb AS (SELECT date, b, coalesce(sum(w*rx),0) AS gross, coalesce(sum(w*rx_net_long),0) AS net FROM hd GROUP BY 1,2),
 bkt AS (SELECT d.date, i.b AS bucket_no, coalesce(gross,0) AS gross, coalesce(net,0) AS net FROM (SELECT DISTINCT date FROM fp) d CROSS JOIN (SELECT unnest([1,2,3,4,5,6]) AS b) i LEFT JOIN rb ON rb.date=d.date AND rb.b=i.b)"""


def backtest(spark, sf):
    p = cv.forward_panel(tb.quotes_daily(spark, sf), tb.conventions(spark, sf))
    return bk.sort_backtest(p, "fwd_discount", 6)


@query("b19_backtest_buckets", _B19 + " SELECT date, CAST(bucket_no AS INT) AS bucket_no, gross, net FROM bkt", use="dense", floats="gross net")
def _(spark, sf):
    return backtest(spark, sf)["buckets"]


@query("b19_backtest_spread", _B19 + """, h AS (SELECT date, max(gross) FILTER (WHERE bucket_no=6)-max(gross) FILTER (WHERE bucket_no=1) AS gross, max(net) FILTER (WHERE bucket_no=6)-max(net) FILTER (WHERE bucket_no=1) AS net FROM bkt GROUP BY 1),
 ww AS (SELECT fp.date, fp.asset, coalesce(CASE b WHEN 6 THEN w WHEN 1 THEN -w END,0) AS weight FROM fp LEFT JOIN hd ON hd.date=fp.date AND hd.asset=fp.asset), tt AS (SELECT date, avg(d) AS turnover FROM (SELECT date, abs(weight-lag(weight) OVER (PARTITION BY asset ORDER BY date)) AS d FROM ww) GROUP BY 1)
 SELECT h.date, gross, net, turnover FROM h JOIN tt ON tt.date=h.date""", use="dense", floats="gross net turnover")
def _(spark, sf):
    r = backtest(spark, sf)
    return r["nav"].select("date", "gross", "net").join(r["turnover"], "date")


_COVW = 120
_B20 = bs.legs("b") + f""", ix AS (SELECT date, row_number() OVER (ORDER BY date)-1 AS t FROM (SELECT DISTINCT date FROM dp)), att AS (SELECT l.label, max(ix.t) AS t0 FROM (SELECT DISTINCT label FROM bl) l JOIN ix ON ix.date<=l.label GROUP BY 1),
 hx AS (SELECT l.label, l.leg, l.asset, l.k, ix.t, dp.xret AS r FROM bl l JOIN att ON att.label=l.label JOIN ix ON ix.t BETWEEN att.t0-{_COVW - 1} AND att.t0 JOIN dp ON dp.date=ix.date AND dp.asset=l.asset),
 ok AS (SELECT label, leg, t FROM hx GROUP BY 1,2,3 HAVING count(r)=max(k)), hc AS (SELECT hx.*, r-avg(r) OVER (PARTITION BY hx.label, hx.leg, asset) AS d FROM hx JOIN ok ON ok.label=hx.label AND ok.leg=hx.leg AND ok.t=hx.t),
 ss AS (SELECT a.label, a.leg, a.asset AS i, b.asset AS j, count(*) AS m, sum(a.d*b.d)/count(*) AS s, sum(a.d*a.d*b.d*b.d)/count(*) AS q, max(a.k) AS k FROM hc a JOIN hc b ON a.label=b.label AND a.leg=b.leg AND a.t=b.t GROUP BY 1,2,3,4),
 mu AS (SELECT label, leg, sum(s) FILTER (WHERE i=j)/max(k) AS mu FROM ss GROUP BY 1,2),
 dl AS (SELECT ss.label, ss.leg, max(mu) AS mu, CASE WHEN sum((s-CASE WHEN i=j THEN mu ELSE 0 END)**2)>0 THEN least(greatest(sum(q-s*s)/sum((s-CASE WHEN i=j THEN mu ELSE 0 END)**2)/max(m),0),1) ELSE 0 END AS d FROM ss JOIN mu ON mu.label=ss.label AND mu.leg=ss.leg GROUP BY 1,2)"""


def held_legs(spark, sf):
    p = base.daily(spark, sf)
    tab = bk.rebalance_table(p, "carry").filter("carry is not null and _vol > 0")
    legs = xs.assign_legs(tab, ["label"], "carry", base.LEG_SIZE, ties="first").filter("k >= 2 and leg <> 0")
    return p, legs


@query("b20_shrunk_covariance", "WITH " + _B20[2:] + """ SELECT ss.label, ss.leg, i AS asset_i, j AS asset_j, CASE WHEN i=j THEN d*mu ELSE 0 END+(1-d)*s AS cov, m AS n_rows FROM ss JOIN dl ON dl.label=ss.label AND dl.leg=ss.leg WHERE i<=j AND m>=2""", use="dp", floats="cov")
def _(spark, sf):
    p, legs = held_legs(spark, sf)
    return bk.leg_covariance(legs, p, ["label"], window=_COVW)


@query("b21_equal_risk_book")
def _(spark, sf):
    return bk.sorted_book(base.daily(spark, sf), n_buckets=base.BUCKETS, weighting="erc", cov_window=250).withColumn("weight", F.round("weight", 6))


@query("b21_risk_shares", "WITH " + _B20[2:] + """ SELECT label, leg, i AS asset, max(1.0::DOUBLE/k) AS risk_share FROM ss WHERE i=j AND m>=greatest(2*k,60) GROUP BY 1,2,3""", use="dp", floats="risk_share", digits=6)
def _(spark, sf):
    """Share of each held name in its leg's variance under the solved weights: all alike, for every leg with enough complete rows."""
    p, legs = held_legs(spark, sf)
    w = bk.optimised_legs(legs, p, ["label"], "carry", "xret", "erc", _COVW, 60, 1.0)
    half = bk.leg_covariance(legs, p, ["label"], window=_COVW)
    full = half.unionByName(half.filter("asset_i <> asset_j").select("label", "leg", F.col("asset_j").alias("asset_i"), F.col("asset_i").alias("asset_j"), "cov", "n_rows"))
    j = full.join(w.select("label", "leg", F.col("asset").alias("asset_i"), F.col("_opt").alias("wi")), ["label", "leg", "asset_i"]).join(w.select("label", "leg", F.col("asset").alias("asset_j"), F.col("_opt").alias("wj")), ["label", "leg", "asset_j"])
    own = j.groupBy("label", "leg", F.col("asset_i").alias("asset")).agg(F.sum(F.col("wi") * F.col("cov") * F.col("wj")).alias("r"))
    total = own.groupBy("label", "leg").agg(F.sum("r").alias("t"))
    return own.join(total, ["label", "leg"]).select("label", "leg", "asset", (F.col("r") / F.col("t")).alias("risk_share"))


@query("b22_max_ratio_book")
def _(spark, sf):
    return bk.sorted_book(base.daily(spark, sf), n_buckets=base.BUCKETS, weighting="mvo", cov_window=250).withColumn("weight", F.round("weight", 6))


@query("b22_optimality", "WITH " + _B20[2:] + """ SELECT label, leg, max(k) AS n_names, 1.0::DOUBLE AS total, true AS within_cap, 0.0::DOUBLE AS gap FROM ss WHERE i=j AND m>=greatest(2*k,60) GROUP BY 1,2""", use="dp", floats="total gap", digits=5)
def _(spark, sf):
    """Every leg with enough complete rows is solved, within its cap, and no feasible change of its shares helps."""
    p, legs = held_legs(spark, sf)
    w = cut_lineage(bk.optimised_legs(legs, p, ["label"], "carry", "xret", "mvo", _COVW, 60, 0.4))
    q = bk.leg_optimality(w, bk.leg_covariance(legs, p, ["label"], window=_COVW), legs, ["label"], "carry", 0.4)
    limit = F.greatest(F.lit(0.4), 1 / F.col("n_names"))
    return q.select("label", "leg", "n_names", "total", (F.col("largest") <= limit + 1e-9).alias("within_cap"), "gap")


@query("j6_scalar_asof", "WITH " + _RANK[2:] + " SELECT date, pct FROM rd", use="od", floats="pct")
def _(spark, sf):
    r = tr.trailing_rank(indicator(spark, sf), "value", 252)
    ev = cal.resample_last(r, ["pct"], label="label")
    return cal.asof_fill(r.select("asset", "date"), ev, ["pct"], lag=1).select("date", "pct")


@query("j12_lag_alignment", "SELECT month_end, asset, lag(carry_signal) OVER (PARTITION BY asset ORDER BY month_end) AS lagged_signal, spot/lag(spot) OVER (PARTITION BY asset ORDER BY month_end)-1 AS ret FROM mp", use="mp", floats="lagged_signal ret")
def _(spark, sf):
    w = Window.partitionBy("asset").orderBy("month_end")
    m = base.monthly(spark, sf)
    return m.select("month_end", "asset", F.lag("carry_signal").over(w).alias("lagged_signal"), (F.col("spot") / F.lag("spot").over(w) - 1).alias("ret"))
