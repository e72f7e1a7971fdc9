"""Data quality and coverage (Q) and the joins used there (J8, J9, J11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions import calendar as cal
from panelspark.operators import convert as cv
from panelspark.operators import quality as ql
from panelspark.queries import base
from panelspark.queries.registry import query
from panelspark.sources import quotes as sq
from panelspark.sources import tables as tb

_LG = """, lg AS (SELECT *, CASE WHEN ticker LIKE '%1M %' THEN 'forwards' ELSE 'spots' END AS "group" FROM lq)"""


def grouped(spark, sf):
    return tb.long_quotes(spark, sf).withColumn("group", F.when(F.col("ticker").like("%1M %"), "forwards").otherwise("spots"))


@query("q1_coverage", "SELECT asset, min(date) FILTER (WHERE mid IS NOT NULL) AS first_valid, max(date) FILTER (WHERE mid IS NOT NULL) AS last_valid, count(mid) AS n_obs FROM dense GROUP BY asset", use="dense")
def _(spark, sf):
    return ql.coverage(cal.densify(tb.quotes_daily(spark, sf)), "mid")


@query("q2_bid_ask_violations", "SELECT date, asset, bid+points*10000 > mid OR mid > ask AS violation FROM qd", use="qd")
def _(spark, sf):
    q = tb.quotes_daily(spark, sf)
    return q.select("date", "asset", ql.bid_ask_violation(F.col("mid"), F.col("bid") + F.col("points") * 10000, F.col("ask")).alias("violation"))


@query("q3_group_coverage", "WITH " + _LG[2:] + """ SELECT "group", count(*) AS n_rows, count(DISTINCT ticker) AS n_tickers, string_agg(DISTINCT field, ', ' ORDER BY field) AS fields, min(date) AS start, max(date) AS "end",
 avg(CASE WHEN value IS NOT NULL AND value<>0 THEN 1.0 ELSE 0.0 END)*100 AS pct_non_null FROM lg GROUP BY 1""", use="lq", floats="pct_non_null")
def _(spark, sf):
    g = grouped(spark, sf).withColumn("value", F.nullif(F.col("value"), F.lit(0.0)))
    return ql.group_coverage(g)


_FILES = ["customer", "lineitem", "nation", "orders", "region", "supplier", "events", "part"]


@query("q4_file_inventory", " UNION ALL ".join(f"SELECT '{t}.parquet' AS file, count(*) AS n_rows, (SELECT count(*) FROM (DESCRIBE {t})) AS n_columns, 'ok' AS status FROM {t}" for t in _FILES))
def _(spark, sf):
    return ql.file_inventory(spark, sf, [f"{t}.parquet" for t in _FILES]).select("file", "n_rows", "n_columns", "status")


@query("q4_column_inventory", " UNION ALL ".join(f"SELECT '{t}.parquet' AS file, column_name AS \"column\" FROM (DESCRIBE {t})" for t in _FILES))
def _(spark, sf):
    return ql.column_inventory(spark, sf, [f"{t}.parquet" for t in _FILES])


_MAN = """, man AS (SELECT 'spots' AS "group", asset||' Curncy' AS ticker FROM dim UNION ALL SELECT 'forwards', asset||'1M Curncy' FROM dim WHERE asset>'N02' UNION ALL SELECT 'forwards', asset||'3M Curncy' FROM dim WHERE asset<'N04')"""


def manifest(spark, sf):
    d = tb.conventions(spark, sf).select("asset")
    parts = [(d, "spots", ""), (d.filter("asset > 'N02'"), "forwards", "1M"), (d.filter("asset < 'N04'"), "forwards", "3M")]
    out = None
    for df, g, t in parts:
        one = df.select(F.lit(g).alias("group"), F.concat("asset", F.lit(f"{t} Curncy")).alias("ticker"))
        out = one if out is None else out.unionByName(one)
    return out


@query("q5_audit", "WITH " + _LG[2:] + _MAN + """ SELECT coalesce(m."group", g."group") AS "group", count(m.ticker) AS requested, count(g.ticker) AS fetched, count(*) FILTER (WHERE g.ticker IS NULL) AS missing, count(*) FILTER (WHERE m.ticker IS NULL) AS extra
 FROM man m FULL JOIN (SELECT DISTINCT "group", ticker FROM lg) g ON g."group"=m."group" AND g.ticker=m.ticker GROUP BY 1""", use="lq dim")
def _(spark, sf):
    return ql.audit(manifest(spark, sf), grouped(spark, sf))


@query("q6_ticker_coverage", "SELECT ticker, string_agg(DISTINCT field, ', ' ORDER BY field) AS fields, min(date) AS start, max(date) AS \"end\", count(value) AS n_obs, count(DISTINCT date) AS n_dates FROM lq GROUP BY 1", use="lq")
def _(spark, sf):
    return ql.ticker_coverage(tb.long_quotes(spark, sf))


@query("q7_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1,2 HAVING count(*)>1")
def _(spark, sf):
    return ql.duplicate_keys(tb.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query("q8_stale_and_short", """WITH per AS (SELECT 'parts' AS "group", 'P'||asset AS ticker, max(month_end) AS "end", count(mid) AS n_obs FROM wu GROUP BY 1,2), ref AS (SELECT "group", max("end") AS e, median(n_obs) AS m FROM per GROUP BY 1)
 SELECT per."group", ticker, "end", n_obs, "end" < e-31 AS stale, n_obs < greatest(24.0, m*0.1) AS short_history FROM per JOIN ref ON ref."group"=per."group" WHERE "end" < e-31 OR n_obs < greatest(24.0, m*0.1)""", use="wu")
def _(spark, sf):
    w = tb.wide_universe(spark, sf).select(F.lit("parts").alias("group"), F.concat(F.lit("P"), "asset").alias("ticker"), F.col("month_end").alias("date"), F.col("mid").alias("value"))
    return ql.stale_and_short(w, min_obs=24)


@query("q9_field_availability", """SELECT dim.asset, coalesce(bool_or(ticker=dim.asset||' Curncy' AND field='PX_LAST'),false) AS has_spot, coalesce(bool_or(ticker=dim.asset||'1M Curncy' AND field='PX_LAST'),false) AS has_forward,
 coalesce(bool_or(ticker=dim.asset||' Curncy' AND field='PX_BID'),false) AND coalesce(bool_or(ticker=dim.asset||' Curncy' AND field='PX_ASK'),false) AS has_bid_ask
 FROM dim LEFT JOIN (SELECT * REPLACE (CASE WHEN (ticker LIKE 'N03%' AND field='PX_ASK') OR ticker LIKE 'N041M%' THEN 'Z'||ticker ELSE ticker END AS ticker) FROM lq) q ON substr(ticker,1,3)=dim.asset GROUP BY 1""", use="lq dim")
def _(spark, sf):
    away = F.expr("(ticker like 'N03%' and field = 'PX_ASK') or ticker like 'N041M%'")  # under other names, so that gaps are seen
    lq = tb.long_quotes(spark, sf).withColumn("ticker", F.when(away, F.concat(F.lit("Z"), "ticker")).otherwise(F.col("ticker")))
    return ql.field_availability(lq, tb.conventions(spark, sf))


@query("q10_parse_label", """SELECT label, CASE WHEN ok THEN substr(u,1,3) END AS root, CASE WHEN ok THEN CASE WHEN substr(u,4,2)='1M' THEN '1M' ELSE 'SPOT' END END AS tenor, CASE WHEN ok THEN split_part(u,'__',2) END AS field_name
 FROM (SELECT label, upper(trim(label)) AS u, field<>'PX_ASK' AS ok FROM (SELECT DISTINCT field, '  '||lower(ticker)||CASE WHEN field='PX_ASK' THEN '#' ELSE '__' END||field||' ' AS label FROM lq))""", use="lq")
def _(spark, sf):
    lab = F.concat(F.lit("  "), F.lower("ticker"), F.when(F.col("field") == "PX_ASK", "#").otherwise("__"), F.col("field"), F.lit(" "))
    return tb.long_quotes(spark, sf).select(lab.alias("label")).distinct().withColumns(ql.parse_label(F.col("label")))


@query("q11_discover_columns", """WITH src AS (SELECT date, CASE WHEN ticker='N071M Curncy' THEN 'Z071M Curncy' ELSE ticker END AS ticker, field, CASE WHEN (ticker='N05 Curncy' AND field='PX_LAST') OR ticker='N061M Curncy' THEN NULL ELSE value END AS value FROM lq),
 cov AS (SELECT ticker||'__'||field AS label, ticker, field, count(value)*1.0/(SELECT count(DISTINCT date) FROM src) AS c FROM src GROUP BY 1,2,3 HAVING c>=0.5),
 sp AS (SELECT substr(ticker,1,3) AS asset, arg_min(label, (CASE field WHEN 'PX_LAST' THEN 0 WHEN 'PX_BID' THEN 1 ELSE 2 END)*10-c) AS spot_label FROM cov WHERE ticker NOT LIKE '%1M %' GROUP BY 1),
 fw AS (SELECT CASE WHEN ticker LIKE 'Z07%' THEN 'N07' ELSE substr(ticker,1,3) END AS asset, substr(ticker,1,3) AS forward_root, label AS forward_label FROM cov WHERE ticker LIKE '%1M %')
 SELECT sp.asset, spot_label, forward_label, forward_root, CASE WHEN forward_label IS NULL THEN 'missing_1m_forward' ELSE 'ok' END AS status FROM sp LEFT JOIN fw ON fw.asset=sp.asset""", use="lq")
def _(spark, sf):
    gone = F.expr("(ticker = 'N05 Curncy' and field = 'PX_LAST') or ticker = 'N061M Curncy'")
    lq = tb.long_quotes(spark, sf).withColumn("value", F.when(~gone, F.col("value")))
    lq = lq.withColumn("ticker", F.when(F.col("ticker") == "N071M Curncy", "Z071M Curncy").otherwise(F.col("ticker")))
    return ql.discover_columns(lq, {"Z07": "N07"})


@query("q14_level_range", "SELECT asset, min(spot) AS low_seen, max(spot) AS high_seen, bool_and(spot BETWEEN CASE WHEN invert THEN 0.0003 ELSE 900 END AND CASE WHEN invert THEN 0.002 ELSE 2500 END) AS in_range FROM conv WHERE mid IS NOT NULL GROUP BY 1",
       use="conv", floats="low_seen high_seen")
def _(spark, sf):
    d = tb.conventions(spark, sf)
    p = cv.convert_quotes(tb.quotes_daily(spark, sf), d).select("asset", "spot")
    bounds = d.select("asset", F.when(F.col("invert"), 0.0003).otherwise(900.0).alias("lo"), F.when(F.col("invert"), 0.002).otherwise(2500.0).alias("hi"))
    return ql.level_range_check(p, bounds, "spot")


@query("q15_month_coverage", "SELECT month_end, count(DISTINCT asset) AS n_assets FROM wp WHERE ret IS NOT NULL GROUP BY 1", use="wp")
def _(spark, sf):
    return ql.month_coverage(tb.wide_monthly_panel(spark, sf).filter("ret is not null"), "ret")


@query("q15_asset_months", """WITH s AS (SELECT asset, min(month_end) AS first_month, max(month_end) AS last_month, count(DISTINCT month_end) AS months FROM wu GROUP BY 1)
 SELECT asset, first_month, last_month, months, CAST(date_diff('month', first_month, last_month)+1-months AS BIGINT) AS missing_months, last_month < last_day((SELECT max(month_end) FROM wu) - INTERVAL 2 MONTH) AS stale_end FROM s""", use="wu")
def _(spark, sf):
    return ql.asset_month_coverage(tb.wide_universe(spark, sf), "mid")


@query("q15_missing_months", """WITH s AS (SELECT asset, min(month_end) AS a, max(month_end) AS b FROM wu GROUP BY 1), g AS (SELECT asset, last_day(CAST(m AS DATE)) AS month_end FROM (SELECT asset, unnest(generate_series(date_trunc('month',a), date_trunc('month',b), INTERVAL 1 MONTH)) AS m FROM s))
 SELECT g.asset, g.month_end FROM g ANTI JOIN wu ON wu.asset=g.asset AND wu.month_end=g.month_end""", use="wu")
def _(spark, sf):
    return ql.missing_months(tb.wide_universe(spark, sf), "mid")


@query("q16_asset_summary", "SELECT asset, count(*) AS months, avg(signal) AS avg_signal, avg(ret) AS avg_return, count(*)-count(signal) AS missing_signal, count(*)-count(ret) AS missing_return FROM wp GROUP BY 1", use="wp", floats="avg_signal avg_return")
def _(spark, sf):
    return ql.asset_summary(tb.wide_monthly_panel(spark, sf), "signal", "ret")


@query("q17_data_card", "SELECT asset, bucket, min(date) FILTER (WHERE mid IS NOT NULL) AS start, max(date) FILTER (WHERE mid IS NOT NULL) AS \"end\", count(mid)*100.0/(SELECT count(DISTINCT date) FROM dense) AS coverage_pct FROM dense GROUP BY 1,2", use="dense", floats="coverage_pct")
def _(spark, sf):
    p = cal.densify(tb.quotes_daily(spark, sf)).join(tb.conventions(spark, sf), "asset")
    return ql.data_card(p, "mid")


@query("q18_usable_features", """WITH n AS (SELECT count(DISTINCT date) AS n FROM lq), keep AS (SELECT ticker FROM lq, n GROUP BY ticker, n.n HAVING count(value)*1.0/n.n>=0.6 AND count(DISTINCT value)>2)
 SELECT date, ticker, field, value FROM lq WHERE ticker IN (SELECT ticker FROM keep)""", use="lq", floats="value")
def _(spark, sf):
    return ql.usable_features(tb.long_quotes(spark, sf))


@query("q19_carry_validation", "SELECT asset, median(carry) AS median, quantile_cont(carry,0.05) AS p05, quantile_cont(carry,0.95) AS p95, count(carry) AS n FROM dp WHERE carry IS NOT NULL GROUP BY 1", use="dp", floats="median p05 p95", digits=7)
def _(spark, sf):
    return ql.carry_validation(base.daily(spark, sf))


@query("j8_worst_month_flag", """WITH worst AS (SELECT month_end FROM (SELECT month_end, avg(realized) AS r FROM mp WHERE realized IS NOT NULL GROUP BY 1) ORDER BY r LIMIT 10)
 SELECT asset, mp.month_end, realized FROM mp SEMI JOIN worst ON worst.month_end=mp.month_end""", use="mp", floats="realized")
def _(spark, sf):
    m = base.monthly(spark, sf)
    worst = m.filter("realized is not null").groupBy("month_end").agg(F.avg("realized").alias("r")).orderBy("r").limit(10)
    return m.join(worst, "month_end", "left_semi").select("asset", "month_end", "realized")


@query("j9_missing_tickers", "WITH " + _LG[2:] + _MAN + """ SELECT man."group", man.ticker FROM man ANTI JOIN lg ON lg."group"=man."group" AND lg.ticker=man.ticker""", use="lq dim")
def _(spark, sf):
    return ql.missing_tickers(manifest(spark, sf), grouped(spark, sf))


@query("j11_convention_lookup", "SELECT qd.date, qd.asset, bucket, invert, point_scale FROM qd JOIN dim ON dim.asset=qd.asset", use="qd dim", floats="point_scale")
def _(spark, sf):
    return tb.quotes_daily(spark, sf).join(tb.conventions(spark, sf), "asset").select("date", "asset", "bucket", "invert", "point_scale")
