"""Conversions, carry, returns, panels, resampling and fills (P, R, and the joins among them)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.functions import calendar as cal
from panelspark.operators import convert as cv
from panelspark.operators import quality as ql
from panelspark.queries import base
from panelspark.queries.registry import query
from panelspark.sources import tables as tb


@query("p1_invert_quote", "SELECT date, qd.asset, CASE WHEN invert THEN 1/mid ELSE mid END AS spot FROM qd JOIN dim ON dim.asset=qd.asset",
       use="qd dim", floats="spot", digits=10)
def _(spark, sf):
    q = tb.quotes_daily(spark, sf).join(tb.conventions(spark, sf), "asset")
    return q.select("date", "asset", cv.invert_quote(F.col("mid"), F.col("invert")).alias("spot"))


@query("p2_invert_bid_ask", """SELECT date, qd.asset, CASE WHEN invert THEN 1/ask ELSE bid END AS bid,
 CASE WHEN invert THEN 1/bid ELSE ask END AS ask FROM qd JOIN dim ON dim.asset=qd.asset""", use="qd dim", floats="bid ask", digits=10)
def _(spark, sf):
    q = tb.quotes_daily(spark, sf).join(tb.conventions(spark, sf), "asset")
    b, a = cv.invert_bid_ask(F.col("bid"), F.col("ask"), F.col("invert"))
    return q.select("date", "asset", b.alias("bid"), a.alias("ask"))


@query("p3_outright_forward", "SELECT date, qd.asset, mid+points/point_scale AS fwd FROM qd JOIN dim ON dim.asset=qd.asset",
       use="qd dim", floats="fwd")
def _(spark, sf):
    q = tb.quotes_daily(spark, sf).join(tb.conventions(spark, sf), "asset")
    return q.select("date", "asset", cv.outright_forward(F.col("mid"), F.col("points"), F.col("point_scale")).alias("fwd"))


@query("p4_implied_carry", "SELECT date, asset, ln(spot/fwd)*12.0 AS carry_1m, ln(spot/fwd)*4.0 AS carry_3m FROM conv WHERE mid IS NOT NULL",
       use="conv", floats="carry_1m carry_3m")
def _(spark, sf):
    q = cv.convert_quotes(tb.quotes_daily(spark, sf), tb.conventions(spark, sf))
    return q.select(
        "date", "asset",
        cv.implied_carry(F.col("spot"), F.col("fwd"), 1).alias("carry_1m"),
        cv.implied_carry(F.col("spot"), F.col("fwd"), 3).alias("carry_3m"),
    )


_P5 = """, p AS (SELECT date, asset, CASE WHEN NOT invert THEN ln(1/mid) ELSE ln(mid) END AS log_spot,
 CASE WHEN NOT invert THEN ln(1/(mid+points/point_scale)) ELSE ln(mid+points/point_scale) END AS log_fwd,
 CASE WHEN NOT invert THEN ln(1/ask) ELSE ln(bid) END AS sb, CASE WHEN NOT invert THEN ln(1/bid) ELSE ln(ask) END AS sa,
 CASE WHEN NOT invert THEN ln(1/(ask+points/point_scale)) ELSE ln(bid+points/point_scale) END AS fb,
 CASE WHEN NOT invert THEN ln(1/(bid+points/point_scale)) ELSE ln(ask+points/point_scale) END AS fa FROM dense)"""
_P5SEL = """SELECT date, asset, log_spot, log_fwd, log_fwd-log_spot AS fwd_discount, lag(log_fwd) OVER w - log_spot AS rx,
 lag(fb) OVER w - sa AS rx_net_long, sb - lag(fa) OVER w AS rx_net_short FROM p WINDOW w AS (PARTITION BY asset ORDER BY date)"""


@query("p5_forward_panel", "WITH " + _P5[2:] + " " + _P5SEL, use="dense",
       floats="log_spot log_fwd fwd_discount rx rx_net_long rx_net_short")
def _(spark, sf):
    return cv.forward_panel(tb.quotes_daily(spark, sf), tb.conventions(spark, sf))


@query("p6_excess_return", "SELECT date, asset, xret FROM dp", use="dp", floats="xret")
def _(spark, sf):
    p = cal.densify(tb.quotes_daily(spark, sf))
    p = cv.convert_quotes(p, tb.conventions(spark, sf)).withColumn("carry", cv.implied_carry(F.col("spot"), F.col("fwd")))
    return cv.excess_return(p).select("date", "asset", "xret")


@query("p7_log_return", "SELECT date, asset, sret FROM dp", use="dp", floats="sret")
def _(spark, sf):
    p = cv.convert_quotes(cal.densify(tb.quotes_daily(spark, sf)), tb.conventions(spark, sf))
    return cv.log_return(p, "spot", "sret").select("date", "asset", "sret")


@query("p8_return_selector", "WITH " + _P5[2:] + """ SELECT date, asset, 'excess' AS kind, rx AS ret FROM (""" + _P5SEL + """)
 UNION ALL SELECT date, asset, 'spot', log_spot - lag(log_spot) OVER (PARTITION BY asset ORDER BY date) FROM p""",
       use="dense", floats="ret")
def _(spark, sf):
    p = cv.forward_panel(tb.quotes_daily(spark, sf), tb.conventions(spark, sf))
    ex = cv.currency_return(p, "excess").withColumn("kind", F.lit("excess"))
    return ex.unionByName(cv.currency_return(p, "spot").withColumn("kind", F.lit("spot")))


# the classifier's verdict in SQL; asset N00..: mixed inputs so that every branch occurs
_KIND = """, fq AS (SELECT qd.date, qd.asset, mid, CASE WHEN CAST(substr(qd.asset,2) AS INT)%5=0 THEN mid*(1+points/10) WHEN CAST(substr(qd.asset,2) AS INT)%5=1 THEN mid*1.019 ELSE points END AS fwd_in FROM qd),
 diag AS (SELECT asset, count(*) AS observations, median(mid) AS median_spot, median(fwd_in) AS median_forward_input,
 median(fwd_in/mid) AS median_ratio, median(abs((fwd_in-mid)/mid)) AS median_abs_rel, avg(CASE WHEN fwd_in<0 THEN 1.0 ELSE 0.0 END) AS negative_share FROM fq GROUP BY asset),
 kinds AS (SELECT *, CASE WHEN observations<24 THEN 'short' WHEN negative_share=0 AND median_ratio BETWEEN 0.98 AND 1.02 AND median_abs_rel<=0.02 THEN 'outright'
 WHEN negative_share>0 OR median_abs_rel>0.02 THEN 'points' ELSE 'ambiguous' END AS forward_type FROM diag)"""


def mixed_forward(spark, sf):
    """Forward inputs of both kinds: outright for some assets, points for the others."""
    q = tb.quotes_daily(spark, sf)
    k = F.substring("asset", 2, 2).cast("int") % 5
    return q.select(
        "date", "asset", "mid",
        F.when(k == 0, F.col("mid") * (1 + F.col("points") / 10)).when(k == 1, F.col("mid") * 1.019)
        .otherwise(F.col("points")).alias("fwd_in"),
    )


@query("q12_classify_forward", "WITH " + _KIND[2:] + " SELECT asset, observations, median_ratio, median_abs_rel, negative_share, forward_type FROM kinds",
       use="qd", floats="median_ratio median_abs_rel negative_share")
def _(spark, sf):
    d = ql.classify_forward(mixed_forward(spark, sf), "mid", "fwd_in")
    return d.select("asset", "observations", "median_ratio", "median_abs_rel", "negative_share", "forward_type")


@query("q13_forward_diagnostics", "WITH " + _KIND[2:] + """, ex AS (SELECT asset, max_by(mid, date) AS last_spot, max_by(fwd_in, date) AS last_forward, min(date) AS first_date, max(date) AS last_date FROM fq GROUP BY asset),
 ov AS (SELECT k.*, CASE WHEN k.asset='N03' THEN 'outright' ELSE forward_type END AS resolved FROM kinds k)
 SELECT asset, forward_type, resolved, first_date, last_date, converted, converted/last_spot AS converted_over_spot,
 coalesce(converted>0 AND abs(converted/last_spot-1)<0.25, false) AS reasonable,
 CASE WHEN coalesce(converted>0 AND abs(converted/last_spot-1)<0.25, false) AND resolved IN ('points','outright') THEN 'ok' ELSE 'review conversion' END AS flag
 FROM (SELECT ov.*, ex.* EXCLUDE (asset), CASE WHEN resolved='outright' THEN last_forward ELSE last_spot+last_forward/point_scale END AS converted
 FROM ov JOIN ex ON ex.asset=ov.asset JOIN dim ON dim.asset=ov.asset)""", use="qd dim", floats="converted converted_over_spot")
def _(spark, sf):
    return ql.forward_diagnostics(mixed_forward(spark, sf), tb.conventions(spark, sf), "mid", "fwd_in", overrides={"N03": "outright"}).select(
        "asset", "forward_type", "resolved", "first_date", "last_date", "converted", "converted_over_spot", "reasonable", "flag")


@query("p9_daily_tidy_panel", "WITH " + _KIND[2:] + """ SELECT * FROM (SELECT fq.date, fq.asset, invert, forward_type, CASE WHEN forward_type='points' THEN point_scale END AS point_scale_used,
 mid AS raw_spot, fwd_in AS raw_forward_input, CASE WHEN forward_type='outright' THEN fwd_in ELSE mid+fwd_in/point_scale END AS raw_forward_outright,
 CASE WHEN invert THEN 1/mid ELSE mid END AS spot,
 CASE WHEN invert THEN 1/CASE WHEN forward_type='outright' THEN fwd_in ELSE mid+fwd_in/point_scale END ELSE CASE WHEN forward_type='outright' THEN fwd_in ELSE mid+fwd_in/point_scale END END AS fwd
 FROM fq JOIN dim ON dim.asset=fq.asset JOIN kinds ON kinds.asset=fq.asset WHERE forward_type IN ('points','outright')) WHERE spot>0 AND fwd>0""",
       use="qd dim", floats="raw_spot raw_forward_input raw_forward_outright spot fwd point_scale_used")
def _(spark, sf):
    q = mixed_forward(spark, sf)
    kinds = ql.classify_forward(q, "mid", "fwd_in")
    return cv.daily_tidy_panel(q.withColumnRenamed("fwd_in", "points"), tb.conventions(spark, sf), kinds)


@query("p9_drop_report", "WITH " + _KIND[2:] + """ SELECT asset, count(*) AS rows_in, count(*) FILTER (WHERE keep) AS rows_out, count(*) FILTER (WHERE NOT keep) AS rows_dropped
 FROM (SELECT fq.asset, coalesce(forward_type IN ('points','outright') AND mid>0 AND CASE WHEN forward_type='outright' THEN fwd_in ELSE mid+fwd_in/point_scale END>0, false) AS keep
 FROM fq JOIN dim ON dim.asset=fq.asset JOIN kinds ON kinds.asset=fq.asset) GROUP BY asset""", use="qd dim")
def _(spark, sf):
    q = mixed_forward(spark, sf)
    kept = cv.daily_tidy_panel(q.withColumnRenamed("fwd_in", "points"), tb.conventions(spark, sf), ql.classify_forward(q, "mid", "fwd_in"))
    return cv.drop_report(q, kept)


_LASTM = """, ml AS (SELECT last_day(date) AS month_end, asset, max_by(spot,date) AS spot, max_by(fwd,date) AS fwd FROM conv WHERE mid IS NOT NULL GROUP BY 1,2)"""


@query("p10_monthly_panel", "WITH " + _LASTM[2:] + """ SELECT a.month_end, a.asset, a.spot, a.fwd, b.spot AS next_spot, b.spot/a.fwd-1 AS realized, a.spot/a.fwd-1 AS carry_signal
 FROM ml a LEFT JOIN ml b ON b.asset=a.asset AND b.month_end=last_day(a.month_end+INTERVAL 1 MONTH)""", use="conv",
       floats="spot fwd next_spot realized carry_signal")
def _(spark, sf):
    return cv.monthly_panel(cv.convert_quotes(tb.quotes_daily(spark, sf), tb.conventions(spark, sf)))


@query("p11_harmonise", """SELECT month_end, asset, spot, fwd, asset_class, ln(spot) AS log_spot, ln(fwd) AS log_fwd FROM (
 SELECT *, CASE WHEN bucket IN ('ASIA','EUROPE') THEN 'major' ELSE 'other' END AS asset_class FROM mp0)""", use="mp0", floats="spot fwd log_spot log_fwd")
def _(spark, sf):
    m = base.monthly(spark, sf)
    major = F.col("bucket").isin("ASIA", "EUROPE")
    return cv.harmonise({"major": m.filter(major), "other": m.filter(~major)})


SAMPLES = {"ALL": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"], "EAST": ["ASIA", "MIDDLE EAST"], "WEST": ["AFRICA", "AMERICA", "EUROPE"]}
SAMPLE_SQL = """SELECT mp.*, s.sample FROM mp JOIN (VALUES ('ALL','AFRICA'),('ALL','AMERICA'),('ALL','ASIA'),('ALL','EUROPE'),('ALL','MIDDLE EAST'),
 ('EAST','ASIA'),('EAST','MIDDLE EAST'),('WEST','AFRICA'),('WEST','AMERICA'),('WEST','EUROPE')) s(sample,bucket) ON s.bucket=mp.bucket"""


@query("p12_expand_samples", f"SELECT sample, month_end, asset, carry_signal FROM ({SAMPLE_SQL}) WHERE sample<>'EAST' OR month_end>=DATE '1996-01-01'", use="mp", floats="carry_signal")
def _(spark, sf):
    s = cv.expand_samples(base.monthly(spark, sf), SAMPLES, min_start={"EAST": "1996-01-01"})
    return s.select("sample", "month_end", "asset", "carry_signal")


@query("p13_rate_differential", """SELECT a.month_end, a.asset, a.value/1e5/100.0 - b.value/1e5/100.0 AS rate_diff FROM om a JOIN om b ON b.month_end=a.month_end AND b.asset='N00' WHERE a.asset<>'N00'""",
       use="om", floats="rate_diff")
def _(spark, sf):
    r = tb.orders_monthly(spark, sf).select("month_end", "asset", (F.col("value") / 1e5).alias("rate"))
    return cv.rate_differential(r.filter("asset <> 'N00'"), r.filter("asset = 'N00'"), "month_end")


_BASIS = """, basis AS (SELECT mp0.month_end, mp0.asset, ln(spot/fwd)*12.0 - (a.value/1e5/100.0-b.value/1e5/100.0) AS basis FROM mp0 JOIN om a ON a.asset=mp0.asset AND a.month_end=mp0.month_end
 JOIN om b ON b.month_end=a.month_end AND b.asset='N00' WHERE a.asset<>'N00')"""


def monthly_basis(spark, sf):
    r = tb.orders_monthly(spark, sf).select("month_end", "asset", (F.col("value") / 1e5).alias("rate"))
    d = cv.rate_differential(r.filter("asset <> 'N00'"), r.filter("asset = 'N00'"), "month_end")
    m = base.monthly(spark, sf).select("month_end", "asset", cv.implied_carry(F.col("spot"), F.col("fwd")).alias("carry"))
    return cv.basis(m, d, "month_end")


@query("p14_basis", "WITH " + _BASIS[2:] + " SELECT * FROM basis", use="mp0 om", floats="basis")
def _(spark, sf):
    return monthly_basis(spark, sf)


@query("p15_basis_summary", "WITH " + _BASIS[2:] + " SELECT asset, '1M' AS tenor, median(basis) AS median_basis, stddev_samp(basis) AS std_basis, count(basis) AS n FROM basis GROUP BY asset",
       use="mp0 om", floats="median_basis std_basis")
def _(spark, sf):
    return monthly_basis(spark, sf).groupBy("asset").agg(
        F.lit("1M").alias("tenor"), F.percentile("basis", 0.5).alias("median_basis"),
        F.stddev_samp("basis").alias("std_basis"), F.count("basis").alias("n"))


_SURF = """SELECT date, asset, '{k}' AS kind, value*{s} AS value FROM ol JOIN pairs ON ticker=option_pair||'{c}1M Curncy'"""


@query("p16_option_points", " UNION ALL ".join([_SURF.format(k="ATM", c="V", s="1"), _SURF.format(k="RR", c="25R", s="(CASE WHEN foreign_is_base THEN -1 ELSE 1 END)"), _SURF.format(k="BF", c="10B", s="1")]),
       use="ol pairs", floats="value", digits=6)
def _(spark, sf):
    lq, pr = tb.option_quotes(spark, sf), tb.option_pairs(spark, sf)
    parts = [cv.option_points(lq, pr, k, delta=d).withColumn("kind", F.lit(k)) for k, d in (("ATM", 25), ("RR", 25), ("BF", 10))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


OPT_SQL = """, opm AS (SELECT last_day(date) AS month_end, asset, option_pair, foreign_is_base,
 max_by(value,date) FILTER (WHERE ticker=option_pair||'V1M Curncy') AS atm_vol, max_by(value,date) FILTER (WHERE ticker=option_pair||'25R1M Curncy') AS rr25_raw,
 max_by(value,date) FILTER (WHERE ticker=option_pair||'25B1M Curncy') AS bf25, max_by(value,date) FILTER (WHERE ticker=option_pair||'10R1M Curncy') AS rr10_raw,
 max_by(value,date) FILTER (WHERE ticker=option_pair||'10B1M Curncy') AS bf10 FROM ol JOIN pairs ON contains(ticker, option_pair) GROUP BY 1,2,3,4),
 op AS (SELECT *, CASE WHEN foreign_is_base THEN 1 ELSE -1 END AS rr_sign, rr25_raw*CASE WHEN foreign_is_base THEN 1 ELSE -1 END AS rr25_foreign,
 rr10_raw*CASE WHEN foreign_is_base THEN 1 ELSE -1 END AS rr10_foreign, -(rr25_raw*CASE WHEN foreign_is_base THEN 1 ELSE -1 END) AS bad_skew25,
 -(rr10_raw*CASE WHEN foreign_is_base THEN 1 ELSE -1 END) AS bad_skew10,
 CASE WHEN atm_vol IS NOT NULL AND rr25_raw IS NOT NULL THEN 'ok' ELSE 'partial option data' END AS flag FROM opm)"""


@query("p17_option_signals", "WITH " + OPT_SQL[2:] + " SELECT * FROM op", use="ol pairs",
       floats="atm_vol rr25_raw bf25 rr10_raw bf10 rr25_foreign rr10_foreign bad_skew25 bad_skew10")
def _(spark, sf):
    return cv.option_signal_panel(tb.option_quotes(spark, sf), tb.option_pairs(spark, sf))


@query("q20_option_diagnostics", "WITH " + OPT_SQL[2:] + """ SELECT asset, foreign_is_base, avg(atm_vol) AS avg_atm_vol, avg(rr25_raw) AS avg_rr25_raw, avg(rr25_foreign) AS avg_rr25_foreign, avg(bad_skew25) AS avg_bad_skew25,
 count(*) AS months, count(*)-count(atm_vol) AS missing_atm, min(month_end) AS first_month, max(month_end) AS last_month FROM op GROUP BY 1,2""", use="ol pairs",
       floats="avg_atm_vol avg_rr25_raw avg_rr25_foreign avg_bad_skew25", digits=6)
def _(spark, sf):
    return ql.option_diagnostics(cv.option_signal_panel(tb.option_quotes(spark, sf), tb.option_pairs(spark, sf)))


@query("p18_implied_skew", """SELECT a.date, a.asset, CASE WHEN foreign_is_base THEN -1 ELSE 1 END * a.points*100/nullif(a.ask-a.bid,0) AS skew FROM qd a JOIN pairs ON pairs.asset=a.asset""",
       use="qd pairs", floats="skew")
def _(spark, sf):
    lq, pr = tb.option_quotes(spark, sf), tb.option_pairs(spark, sf)
    return cv.implied_skew(cv.option_points(lq, pr, "RR"), cv.option_points(lq, pr, "ATM"))


@query("p19_factor_changes", """SELECT month_end, asset, CASE WHEN asset IN ('N00','N01','N02') THEN ln(value)-lag(ln(value)) OVER w WHEN asset IN ('N03','N04') THEN value-lag(value) OVER w END AS change
 FROM om WHERE asset<='N04' WINDOW w AS (PARTITION BY asset ORDER BY month_end)""", use="om", floats="change", digits=6)
def _(spark, sf):
    o = tb.orders_monthly(spark, sf).filter("asset <= 'N04'")
    kinds = {"N00": "log", "N01": "log", "N02": "log", "N03": "diff", "N04": "diff"}
    return cv.factor_changes(o, kinds, date="month_end").select("month_end", "asset", "change")


_REB = """, reb AS (SELECT date, asset, bucket, 100.0*spot/first_value(spot IGNORE NULLS) OVER (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING) AS index FROM conv)"""


@query("p20_rebased_index", "WITH " + _REB[2:] + " SELECT date, asset, index FROM reb", use="conv", floats="index", digits=6)
def _(spark, sf):
    p = cv.convert_quotes(cal.densify(tb.quotes_daily(spark, sf)), tb.conventions(spark, sf))
    return cv.rebase(p, "spot").select("date", "asset", "index")


@query("p20_rebased_basket", "WITH " + _REB[2:] + " SELECT date, bucket, avg(index) AS basket FROM reb GROUP BY 1,2", use="conv", floats="basket", digits=6)
def _(spark, sf):
    p = cv.convert_quotes(cal.densify(tb.quotes_daily(spark, sf)), tb.conventions(spark, sf))
    return cv.rebased_basket(cv.rebase(p, "spot"))


@query("r1_resample_last", " UNION ALL ".join(f"SELECT asset, {lab} AS label, '{f}' AS freq, max_by(mid,date) AS mid FROM qd GROUP BY 1,2" for f, lab in (
    ("W", "CAST(date + CAST((7-isodow(date)) AS INT) AS DATE)"), ("M", "last_day(date)"),
    ("Q", "last_day(make_date(year(date), quarter(date)*3, 1))"), ("Y", "make_date(year(date),12,31)"))) + """
 UNION ALL SELECT asset, label, '2W', max_by(mid,date) FROM (SELECT *, CAST(a.anchor + CAST(14*ceil((date-a.anchor)/14.0) AS INT) AS DATE) AS label FROM qd,
 (SELECT CAST(min(date)+CAST((7-isodow(min(date))) AS INT) AS DATE) AS anchor FROM qd) a) GROUP BY 1,2""", use="qd", floats="mid")
def _(spark, sf):
    q = tb.quotes_daily(spark, sf)
    out = None
    for f in ("W", "M", "Q", "Y", "2W"):
        anchor = cal.first_sunday(q) if f == "2W" else None
        one = cal.resample_last(q, ["mid"], freq=f, label="label", anchor=anchor).withColumn("freq", F.lit(f))
        out = one if out is None else out.unionByName(one)
    return out


@query("r2_resample_aggregate", """SELECT track, year(date) AS year, sum(ret) AS total, product(1+ret/10)-1 AS compounded, count(ret) AS n, avg(ret) AS mean FROM bt GROUP BY 1,2""",
       use="bt", floats="total compounded mean", digits=6)
def _(spark, sf):
    from panelspark.operators.performance import resample_returns
    t = base.tracks(spark, sf).withColumn("scaled", F.col("ret") / 10)
    a = resample_returns(t, "Y", ret="ret")
    b = resample_returns(t, "Y", ret="scaled").select("track", "label", "compounded")
    return a.drop("compounded").join(b, ["track", "label"]).select("track", F.year("label").alias("year"), "total", "compounded", "n", "mean")


@query("r3_asof_fill_lag", """WITH ev AS (SELECT last_day(date) AS label, asset, max_by(mid,date) AS mid FROM qd GROUP BY 1,2)
 SELECT date, asset, lag(v) OVER (PARTITION BY asset ORDER BY date) AS mid FROM (
 SELECT d.date, d.asset, ev.mid AS v FROM dense d ASOF LEFT JOIN ev ON ev.asset=d.asset AND ev.label<=d.date)""", use="dense", floats="mid")
def _(spark, sf):
    q = tb.quotes_daily(spark, sf)
    ev = cal.resample_last(q, ["mid"], label="label")
    return cal.asof_fill(cal.densify(q.select("asset", "date")), ev, ["mid"], lag=1)


@query("r4_forward_fill", """SELECT date, asset, last_value(mid IGNORE NULLS) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS fill5,
 last_value(mid IGNORE NULLS) OVER (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING) AS fill_all FROM dense""", use="dense", floats="fill5 fill_all")
def _(spark, sf):
    p = cal.densify(tb.quotes_daily(spark, sf)).select("date", "asset", F.col("mid").alias("fill5"), F.col("mid").alias("fill_all"))
    return cal.forward_fill(cal.forward_fill(p, ["fill5"], limit=5), ["fill_all"])


@query("r4_sparse_fill_limit", """WITH g AS (SELECT c.date, a.asset, value FROM (SELECT DISTINCT date FROM ed) c CROSS JOIN (SELECT DISTINCT asset FROM ed) a LEFT JOIN ed ON ed.date=c.date AND ed.asset=a.asset)
 SELECT date, asset, last_value(value IGNORE NULLS) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS value FROM g""", use="ed", floats="value")
def _(spark, sf):
    return cal.forward_fill(cal.densify(tb.events_daily(spark, sf)), ["value"], limit=2)


@query("r5_densify", "SELECT date, asset, mid, points FROM dense", use="dense", floats="mid points")
def _(spark, sf):
    return cal.densify(tb.quotes_daily(spark, sf)).select("date", "asset", "mid", "points")


@query("r6_invalid_to_null", "SELECT date, asset, CASE WHEN points<>0 THEN (ask-bid)/points END AS ratio FROM qd", use="qd", floats="ratio", digits=6)
def _(spark, sf):
    q = tb.quotes_daily(spark, sf)
    raw = F.when(F.col("points") == 0, F.lit(float("inf"))).otherwise((F.col("ask") - F.col("bid")) / F.nullif(F.col("points"), F.lit(0.0)))
    return cv.normalise_invalid(q.select("date", "asset", raw.alias("ratio")), ["ratio"])


@query("j1_inner_align", "SELECT a.month_end, a.asset, a.spot, b.value FROM mp0 a JOIN om b ON a.asset=b.asset AND a.month_end=b.month_end", use="mp0 om", floats="spot value")
def _(spark, sf):
    m = base.monthly(spark, sf).select("month_end", "asset", "spot")
    return m.join(tb.orders_monthly(spark, sf), ["month_end", "asset"])


@query("j2_asset_intersection", "SELECT DISTINCT asset FROM mp0 INTERSECT SELECT DISTINCT CASE WHEN asset IN ('N03','N11') THEN 'X'||asset ELSE asset END FROM om", use="mp0 om")
def _(spark, sf):
    """Two names are renamed on one side, so that each side has keys of its own."""
    own = F.when(F.col("asset").isin("N03", "N11"), F.concat(F.lit("X"), "asset")).otherwise(F.col("asset"))
    return base.monthly(spark, sf).select("asset").intersect(tb.orders_monthly(spark, sf).select(own.alias("asset")))


@query("j5_outer_align", "SELECT coalesce(a.month_end,b.month_end) AS month_end, coalesce(a.asset,b.asset) AS asset, spot, value FROM mp0 a FULL JOIN om b ON a.asset=b.asset AND a.month_end=b.month_end",
       use="mp0 om", floats="spot value")
def _(spark, sf):
    m = base.monthly(spark, sf).select("month_end", "asset", "spot")
    return m.join(tb.orders_monthly(spark, sf), ["month_end", "asset"], "full_outer")


@query("j6_asof_events", """WITH m AS (SELECT DISTINCT date FROM ed) SELECT e.date, e.asset, e.value AS current, p.value AS previous FROM ed e
 ASOF LEFT JOIN (SELECT date+1 AS nxt, asset, value FROM ed) p ON p.asset=e.asset AND p.nxt<=e.date""", use="ed", floats="current previous")
def _(spark, sf):
    e = tb.events_daily(spark, sf)
    ev = e.select("asset", F.date_add("date", 1).alias("label"), F.col("value").alias("previous"))
    prev = cal.asof_fill(e.select("asset", "date"), ev, ["previous"])
    return e.withColumnRenamed("value", "current").join(prev, ["asset", "date"])


@query("w16_seen_mask", "SELECT date, asset, max(CASE WHEN mid IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING)=1 AS seen FROM dense", use="dense")
def _(spark, sf):
    w = Window.partitionBy("asset").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    p = cal.densify(tb.quotes_daily(spark, sf))
    return p.select("date", "asset", (F.max(F.col("mid").isNotNull().cast("int")).over(w) == 1).alias("seen"))
