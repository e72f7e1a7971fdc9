"""Scans, shapes, sinks (S), sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import convert as cv
from panelspark.operators import quality as ql
from panelspark.queries import base
from panelspark.queries.registry import query
from panelspark.sources import quotes as sq
from panelspark.sources import tables as tb

ASSETS = [f"N{i:02d}" for i in range(25)]


def wide_frame(spark, sf):
    """Wide layout with ``('T', 'F')`` column names for all assets, as a wide quote file holds it."""
    q = tb.quotes_daily(spark, sf)
    aggs = []
    for a in ASSETS:
        for f, c in (("PX_LAST", "mid"), ("PX_BID", "bid"), ("PX_ASK", "ask")):
            aggs.append(F.max(F.when(F.col("asset") == a, F.col(c))).cast("string").alias(f"('{a} Curncy', '{f}')"))
    return q.groupBy("date").agg(*aggs)


_WIDE = "(SELECT date, a.asset, mid, bid, ask FROM (SELECT DISTINCT date FROM qd) d CROSS JOIN (SELECT printf('N%02d', i) AS asset FROM range(25) r(i)) a LEFT JOIN qd USING (date, asset))"


@query("s1_wide_scan", f"SELECT date, asset AS ticker, mid AS value FROM {_WIDE}", use="qd", floats="value")
def _(spark, sf):
    path = f"{base.landing(spark)}/spots_wide.parquet"
    sq.write_table(wide_frame(spark, sf), path)
    return sq.load_wide(spark, path, "PX_LAST")


@query("s2_long_scan", "SELECT date, ticker, field, CASE WHEN ticker LIKE 'N0%' THEN value END AS value FROM lq", use="lq", floats="value")
def _(spark, sf):
    raw = tb.long_quotes(spark, sf).select(
        F.col("date").cast("string").alias("date"), "ticker", "field",
        F.when(F.col("ticker").like("N0%"), F.col("value").cast("string")).otherwise("n/a").alias("value"))
    path, out = base.landing(spark), None
    for name, fmt, part in (("mids", "parquet", F.col("field") == "PX_LAST"), ("sides", "csv", F.col("field") != "PX_LAST")):  # one is found first, one is the fallback
        sq.write_table(raw.filter(part), f"{path}/{name}.{fmt}", fmt)
        one, status = sq.read_long(spark, f"{path}/{name}")
        if status != fmt:
            raise ValueError(status)
        out = one if out is None else out.unionByName(one)
    return out


@query("s3_strict_scan", "SELECT date, ticker, field, value FROM lq WHERE field<>'PX_BID'", use="lq", floats="value")
def _(spark, sf):
    raw = tb.long_quotes(spark, sf)
    return sq.strict_long(raw.withColumn("field", F.when(F.col("field") != "PX_BID", F.col("field"))))


@query("s4_tolerant_scan", "SELECT 'missing' AS source, 0 AS n_rows, 'PATH_NOT_FOUND' AS status UNION ALL SELECT 'lineitem', count(*), 'ok' FROM lineitem")
def _(spark, sf):
    gone, why = sq.safe_read(spark, f"{sf}/no_such_file.parquet")
    here, ok = sq.safe_read(spark, f"{sf}/lineitem.parquet")
    a = gone.agg(F.lit("missing").alias("source"), F.count(F.lit(1)).alias("n_rows"), F.lit(why).alias("status"))
    return a.unionByName(here.agg(F.lit("lineitem").alias("source"), F.count(F.lit(1)).alias("n_rows"), F.lit(ok).alias("status")))


@query("s5_normalise_frame", """SELECT CAST(o_orderdate AS DATE) AS date, max_by(o_totalprice, o_orderkey) AS price__last, max_by(CAST(o_custkey AS DOUBLE), o_orderkey) AS cust
 FROM orders GROUP BY 1""", floats="price__last cust")
def _(spark, sf):
    """The file holds orders by key; of those of one day the last row in the file stays."""
    o = tb.table(spark, sf, "orders").orderBy("o_orderkey").select(
        F.to_date("o_orderdate").cast("string").alias("Order Date"), F.col("o_totalprice").alias("('price', 'last')"), F.col("o_custkey").cast("string").alias("cust"), F.lit("none").alias("junk"))
    path = f"{base.landing(spark)}/orders.parquet"
    sq.write_table(o, path)
    return sq.normalise_frame(sq.read_in_order(spark, path))


@query("s6_detect_shape", f"SELECT 'wide' AS shape, date, asset||' Curncy' AS ticker, 'PX_BID' AS field, bid AS value FROM {_WIDE} UNION ALL SELECT 'long', date, ticker, field, value FROM lq", use="lq", floats="value")
def _(spark, sf):
    a = sq.to_long(wide_frame(spark, sf), "PX_BID").withColumn("shape", F.lit("wide"))
    b = sq.to_long(tb.long_quotes(spark, sf)).withColumn("shape", F.lit("long"))
    return a.unionByName(b)


@query("s7_split_fields", "SELECT date, asset, mid, bid, ask FROM qd", use="qd", floats="mid bid ask")
def _(spark, sf):
    names = tb.conventions(spark, sf).select("asset", F.concat("asset", F.lit(" Curncy")).alias("ticker"))
    return sq.split_fields(tb.long_quotes(spark, sf), names)


@query("s8_load_series", """SELECT 'spot' AS series, month_end, asset, mid AS value FROM (SELECT last_day(date) AS month_end, asset, max_by(mid,date) AS mid FROM qd GROUP BY 1,2)
 UNION ALL SELECT 'points', last_day(date), asset, max_by(points,date) FROM qd GROUP BY 2,3 UNION ALL SELECT 'rate', last_day(date), NULL, max_by(value,date)/1e5/100.0/12.0 FROM od GROUP BY 2""", use="qd od", floats="value")
def _(spark, sf):
    from panelspark.functions.calendar import resample_last
    lq = tb.long_quotes(spark, sf)
    names = tb.conventions(spark, sf).select("asset", F.explode(F.array(
        F.struct(F.lit("spot").alias("series"), F.concat("asset", F.lit(" Curncy")).alias("ticker")),
        F.struct(F.lit("points").alias("series"), F.concat("asset", F.lit("1M Curncy")).alias("ticker")))).alias("s")).select("asset", "s.*")
    px = lq.filter("field = 'PX_LAST'").join(names, "ticker")
    out = resample_last(px, ["value"], ["series", "asset"])
    rate = sq.periodic_rate(tb.orders_daily(spark, sf).withColumn("value", F.col("value") / 1e5).withColumn("series", F.lit("rate")), 12)
    rate = resample_last(rate, ["rate"], ["series"]).select("series", "month_end", F.lit(None).cast("string").alias("asset"), F.col("rate").alias("value"))
    return out.unionByName(rate)


@query("s9_any_shape_to_long", f"""SELECT 'pair' AS src, date, asset||' Curncy' AS ticker, 'PX_ASK' AS field, ask AS value FROM {_WIDE}
 UNION ALL SELECT 'flat', date, 'value', 'UNKNOWN', value FROM od UNION ALL SELECT 'deep', date, 'EQ|N00', 'value', value FROM od
 UNION ALL SELECT 'long', date, ticker, field, value FROM lq""", use="lq od", floats="value")
def _(spark, sf):
    od = tb.orders_daily(spark, sf)
    lq = tb.long_quotes(spark, sf).toDF("Date", "Ticker", "Field", "Value")
    parts = {"pair": sq.to_long(wide_frame(spark, sf), "PX_ASK"), "flat": sq.to_long(od),
             "deep": sq.to_long(od.withColumnRenamed("value", "('EQ', 'N00', 'value')")), "long": sq.to_long(lq)}
    return sq.stack_groups(parts).withColumnRenamed("group", "src")


@query("s10_union_keep_last", """SELECT date, ticker, field, coalesce(b, a) AS value FROM (SELECT date, ticker, field, value AS a, CASE WHEN date>=DATE '1998-01-01' AND field='PX_LAST' THEN value+1 END AS b FROM lq)""", use="lq", floats="value")
def _(spark, sf):
    lq = tb.long_quotes(spark, sf)
    late = lq.filter("date >= '1998-01-01' and field = 'PX_LAST'").withColumn("value", F.col("value") + 1)
    return sq.union_dedupe([lq, late])


@query("s10_line_dedupe", """SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
 ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM lineitem) WHERE rn=1""", floats="l_extendedprice")
def _(spark, sf):
    li = tb.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")
    out = sq.keep_last(li, ["l_orderkey", "l_linenumber"], "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")
    return out.select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("s11_pivot_export", "SELECT date, " + ", ".join(f"max(mid) FILTER (WHERE asset='{a}') AS {a}_last, max(bid) FILTER (WHERE asset='{a}') AS {a}_bid, max(ask) FILTER (WHERE asset='{a}') AS {a}_ask" for a in ASSETS) + " FROM qd GROUP BY date",
       use="qd", floats=" ".join(f"{a}_last {a}_bid {a}_ask" for a in ASSETS))
def _(spark, sf):
    lq = tb.long_quotes(spark, sf).filter("ticker not like '%1M %'")
    fields = {"last": "PX_LAST", "bid": "PX_BID", "ask": "PX_ASK"}
    path = base.landing(spark)
    sq.save_group(lq, path, "quotes", [f"{a} Curncy__{f}" for a in ASSETS for f in fields.values()])
    wide = sq.read_parquet(spark, f"{path}/wide/quotes")
    return wide.select("date", *[F.col(f"`{a} Curncy__{f}`").alias(f"{a}_{r}") for a in ASSETS for r, f in fields.items()])


@query("s12_block_to_groups", f"""SELECT date, CASE WHEN asset<='N01' THEN 'low' ELSE 'high' END AS "group", asset AS ticker, mid AS value FROM {_WIDE} WHERE mid IS NOT NULL""", use="qd", floats="value")
def _(spark, sf):
    """Landed sheet rows: unpivot, drop nulls, keep the last of duplicated keys, tag the group."""
    w = sq.select_field(wide_frame(spark, sf)).filter("value is not null")
    return sq.union_dedupe([w.withColumn("value", F.col("value") * 2), w], ["date", "ticker"]).withColumn("group", F.when(F.col("ticker") <= "N01", "low").otherwise("high"))


@query("s13_option_manifest", """SELECT option_pair, code, tenor, option_pair||code||tenor||' Curncy' AS ticker FROM pairs CROSS JOIN (SELECT unnest(['V','25R','25B','10R','10B']) AS code) CROSS JOIN (SELECT unnest(['1W','1M','3M','6M','1Y']) AS tenor)""", use="pairs")
def _(spark, sf):
    return sq.option_tickers(tb.option_pairs(spark, sf))


@query("s14_ordered_dedupe", "SELECT l_partkey AS item, min(l_orderkey) AS pos FROM lineitem GROUP BY 1")
def _(spark, sf):
    li = tb.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_orderkey").alias("pos"))
    return sq.unique_keep_order(li)


@query("s15_long_to_wide", "SELECT month_end, " + ", ".join(f"max(value) FILTER (WHERE asset='{a}') AS {a}" for a in ASSETS) + " FROM om GROUP BY 1", use="om", floats=" ".join(ASSETS))
def _(spark, sf):
    return sq.pivot_last(tb.orders_monthly(spark, sf), "asset", ASSETS, date="month_end")


@query("s16_wide_to_long", "SELECT m.month_end, a.asset, value FROM (SELECT DISTINCT month_end FROM om) m CROSS JOIN (SELECT printf('N%02d', i) AS asset FROM range(25) r(i)) a LEFT JOIN om ON om.month_end=m.month_end AND om.asset=a.asset", use="om", floats="value")
def _(spark, sf):
    wide = sq.pivot_last(tb.orders_monthly(spark, sf), "asset", ASSETS, date="month_end")
    return sq.melt(wide, ["month_end"])


@query("s17_stack_groups", """SELECT 'quotes' AS "group", month_end, asset, spot AS value FROM mp0 UNION ALL SELECT 'orders', month_end, asset, value FROM om""", use="mp0 om", floats="value")
def _(spark, sf):
    m = base.monthly(spark, sf).select("month_end", "asset", F.col("spot").alias("value"))
    return sq.stack_groups({"quotes": m, "orders": tb.orders_monthly(spark, sf)})


@query("s18_result_table", "SELECT bucket, count(*) AS n_months, sum(spread) AS total_spread FROM mp0 GROUP BY 1", use="mp0", floats="total_spread", digits=4)
def _(spark, sf):
    """Written by group as parquet, from there as CSV, and read back from both."""
    path = base.landing(spark)
    sq.write_table(base.monthly(spark, sf).select("bucket", "month_end", "asset", "spread"), f"{path}/months", partition_by=["bucket"])
    months = spark.read.parquet(f"{path}/months")
    sq.write_table(months.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_months"), F.sum("spread").alias("total_spread")), f"{path}/result", "csv")
    return spark.read.schema("bucket string, n_months bigint, total_spread double").csv(f"{path}/result", header=True)


@query("s19_filtered_scan", "SELECT date, ticker, value FROM lq WHERE ticker='N07 Curncy' AND field='PX_LAST'", use="lq", floats="value")
def _(spark, sf):
    lq = tb.long_quotes(spark, sf)
    return lq.filter("ticker = 'N07 Curncy' and field = 'PX_LAST'").select("date", "ticker", "value")


@query("s20_daily_panel", "SELECT date, asset, bucket, spot, fwd, carry, sret, xret FROM dp", use="dp", floats="spot fwd carry sret xret")
def _(spark, sf):
    return base.daily(spark, sf).select("date", "asset", "bucket", "spot", "fwd", "carry", "sret", "xret")


@query("f1_instrument_filter", "SELECT date, asset, mid FROM qd WHERE asset IN ('N01','N05','N09')", use="qd", floats="mid")
def _(spark, sf):
    return tb.quotes_daily(spark, sf).filter(F.col("asset").isin("N01", "N05", "N09")).select("date", "asset", "mid")


@query("f2_universe_lists", "SELECT month_end, asset, spot FROM mp0 WHERE bucket IN ('ASIA','EUROPE') AND asset NOT IN ('N02','N08')", use="mp0", floats="spot")
def _(spark, sf):
    m = base.monthly(spark, sf)
    d = tb.conventions(spark, sf)
    inc = d.filter(F.col("bucket").isin("ASIA", "EUROPE")).select("asset")
    exc = d.filter(F.col("asset").isin("N02", "N08")).select("asset")
    return m.join(inc, "asset", "left_semi").join(exc, "asset", "left_anti").select("month_end", "asset", "spot")


@query("f3_live_window", """WITH s AS (SELECT min(month_end) AS a, max(month_end) AS b FROM om WHERE asset='N03') SELECT m.month_end, m.asset, spot FROM mp0 m, s WHERE m.month_end BETWEEN s.a AND s.b""", use="mp0 om", floats="spot")
def _(spark, sf):
    span = tb.orders_monthly(spark, sf).filter("asset = 'N03'").agg(F.min("month_end").alias("a"), F.max("month_end").alias("b"))
    m = base.monthly(spark, sf)
    return m.filter(F.col("month_end").between(span.select("a").scalar(), span.select("b").scalar())).select("month_end", "asset", "spot")


@query("f4_complete_cases", "SELECT month_end, asset, carry_signal, realized FROM mp WHERE carry_signal IS NOT NULL AND realized IS NOT NULL", use="mp", floats="carry_signal realized")
def _(spark, sf):
    return base.monthly(spark, sf).dropna(subset=["carry_signal", "realized"]).select("month_end", "asset", "carry_signal", "realized")


@query("set_union_intersect_except", """SELECT 'union' AS op, count(*) AS n FROM (SELECT asset, month_end FROM mp0 UNION SELECT asset, month_end FROM om)
 UNION ALL SELECT 'intersect', count(*) FROM (SELECT asset, month_end FROM mp0 INTERSECT SELECT asset, month_end FROM om)
 UNION ALL SELECT 'except', count(*) FROM (SELECT asset, month_end FROM mp0 EXCEPT SELECT asset, month_end FROM om)""", use="mp0 om")
def _(spark, sf):
    a = base.monthly(spark, sf).select("asset", "month_end")
    b = tb.orders_monthly(spark, sf).select("asset", "month_end")
    out = None
    for op, df in (("union", a.unionByName(b).distinct()), ("intersect", a.intersect(b)), ("except", a.subtract(b))):
        one = df.agg(F.count(F.lit(1)).alias("n")).withColumn("op", F.lit(op))
        out = one if out is None else out.unionByName(one)
    return out


@query("sort_latest_per_key", "SELECT asset, max(month_end) AS month_end, max_by(spot, month_end) AS spot FROM mp0 GROUP BY asset ORDER BY asset", use="mp0", floats="spot")
def _(spark, sf):
    m = base.monthly(spark, sf).select("asset", "month_end", "spot")
    return sq.keep_last(m.withColumn("k", F.col("month_end")), ["asset"], "k").drop("k").orderBy("asset")


@query("scalar_functions", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ln(l_quantity) AS f_ln, exp(-l_discount) AS f_exp, exp(l_tax)-1 AS f_expm1, sqrt(l_quantity) AS f_sqrt, sign(l_discount-0.05) AS f_sign,
 abs(l_discount-l_tax) AS f_abs, ceil(l_extendedprice/1000.0) AS f_ceil, least(greatest(l_discount,0.02),0.08) AS f_clip, pow(1+l_tax,12) AS f_pow, upper(lower(l_returnflag))||'-'||l_linestatus AS f_text,
 year(l_shipdate) AS f_year, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS INT) AS f_days, CASE WHEN l_quantity<=10 THEN 'small' WHEN l_quantity<=30 THEN 'mid' ELSE 'large' END AS f_cut FROM lineitem""",
       floats="f_ln f_exp f_expm1 f_sqrt f_sign f_abs f_ceil f_clip f_pow")
def _(spark, sf):
    q = F.col("l_quantity")
    return tb.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.ln(q).alias("f_ln"), F.exp(-F.col("l_discount")).alias("f_exp"),
        F.expm1("l_tax").alias("f_expm1"), F.sqrt(q).alias("f_sqrt"), F.signum(F.col("l_discount") - 0.05).alias("f_sign"),
        F.abs(F.col("l_discount") - F.col("l_tax")).alias("f_abs"), F.ceil(F.col("l_extendedprice") / 1000.0).cast("double").alias("f_ceil"),
        F.least(F.greatest("l_discount", F.lit(0.02)), F.lit(0.08)).alias("f_clip"), F.pow(1 + F.col("l_tax"), F.lit(12)).alias("f_pow"),
        F.concat_ws("-", F.upper(F.lower("l_returnflag")), "l_linestatus").alias("f_text"), F.year("l_shipdate").alias("f_year"),
        F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date")).alias("f_days"),
        F.when(q <= 10, "small").when(q <= 30, "mid").otherwise("large").alias("f_cut"))
