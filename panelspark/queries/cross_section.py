"""Cross-section operators (X), filters (F5-F8) and label listings, on the bounded and on the growing universe."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions import calendar as cal
from panelspark.operators import convert as cv
from panelspark.operators import cross_section as xs
from panelspark.operators import trailing as tr
from panelspark.queries import base
from panelspark.queries.convert import OPT_SQL
from panelspark.queries.registry import query
from panelspark.sources import tables as tb

# tasks per month when ranking the universe that grows with the data
WIDE_SPLITS = 16

_RN = "row_number() OVER (PARTITION BY {p} ORDER BY {s}, asset)"
_N = "count(*) OVER (PARTITION BY {p})"
_K = "CASE WHEN n<2 THEN 0 WHEN n>=6 THEN least(greatest(CAST(ceil(0.2::DOUBLE*n) AS INT),3), n//2) ELSE greatest(1, n//3) END"


def option_carry(spark, sf):
    """Monthly carry rows joined with the option measures of the same asset and month (J4)."""
    m = base.monthly(spark, sf).select("month_end", "asset", "bucket", "carry_signal", "realized")
    o = cv.option_signal_panel(tb.option_quotes(spark, sf), tb.option_pairs(spark, sf))
    return m.join(o.select("month_end", "asset", "atm_vol", "bad_skew25", "bf25"), ["month_end", "asset"])


OC_SQL = OPT_SQL + """, oc AS (SELECT mp.month_end, mp.asset, mp.bucket, carry_signal, realized, atm_vol, bad_skew25, bf25 FROM mp JOIN op ON op.month_end=mp.month_end AND op.asset=mp.asset)"""


@query("x1_rank_buckets", f"""SELECT date, asset, CAST(greatest(1, least(6, ceil(rn::DOUBLE/n*6))) AS INT) AS bucket_no FROM (SELECT date, asset, {_RN.format(p='date', s='carry')} AS rn, {_N.format(p='date')} AS n FROM dp WHERE carry IS NOT NULL)""", use="dp")
def _(spark, sf):
    p = base.daily(spark, sf).filter("carry is not null").select("date", "asset", "carry")
    return xs.rank_buckets(p, ["date"], "carry", 6).select("date", "asset", "bucket_no")


@query("x1_rank_buckets_wide", f"""SELECT month_end, asset, CAST(greatest(1, least(10, ceil(rn::DOUBLE/n*10))) AS INT) AS bucket_no FROM (SELECT month_end, asset, row_number() OVER (PARTITION BY month_end ORDER BY signal DESC, asset) AS rn, {_N.format(p='month_end')} AS n FROM wp)""", use="wp")
def _(spark, sf):
    w = tb.wide_monthly_panel(spark, sf).select("month_end", "asset", "signal")
    return xs.rank_buckets(w, ["month_end"], "signal", 10, ascending=False, splits=WIDE_SPLITS).select("month_end", "asset", "bucket_no")


def _q5(s, src, p):
    return f"CASE WHEN {s} IS NOT NULL AND count({s}) OVER (PARTITION BY {p})>=5 THEN CAST(greatest(1, ceil((row_number() OVER (PARTITION BY {p} ORDER BY {s} NULLS LAST, asset)-1)*5/(count({s}) OVER (PARTITION BY {p})-1))) AS INT) END"


@query("x2_quantile_buckets", f"SELECT month_end, asset, {_q5('carry_signal', 'mp', 'month_end')} AS q FROM mp", use="mp")
def _(spark, sf):
    return xs.quantile_buckets(base.monthly(spark, sf), ["month_end"], "carry_signal").select("month_end", "asset", "q")


@query("x2_quantile_buckets_wide", f"SELECT month_end, asset, {_q5('ret', 'wp', 'month_end')} AS q FROM wp", use="wp")
def _(spark, sf):
    w = tb.wide_monthly_panel(spark, sf)
    return xs.quantile_buckets(w, ["month_end"], "ret", splits=WIDE_SPLITS).select("month_end", "asset", "q")


_LEGS = """, lg AS (SELECT *, {k} AS k FROM (SELECT *, {rn} AS rn, {n} AS n FROM {src} WHERE {s} IS NOT NULL AND {r} IS NOT NULL)),
 wt AS (SELECT *, CASE WHEN rn>n-k THEN 1.0::DOUBLE/k WHEN rn<=k THEN -1.0::DOUBLE/k ELSE 0.0::DOUBLE END AS weight, CASE WHEN rn>n-k THEN 'long_high_carry' WHEN rn<=k THEN 'short_low_carry' ELSE 'middle' END AS basket FROM lg WHERE k>0 AND n>=2*k)"""


def legs_sql(src="mp", part="month_end", s="carry_signal", r="realized", k=_K):
    return _LEGS.format(src=src, s=s, r=r, k=k, rn=_RN.format(p=part, s=s), n=_N.format(p=part))


@query("x3_top_bottom_legs", "WITH " + legs_sql()[2:] + " SELECT month_end, asset, k AS leg_size, n AS n_universe, weight, basket FROM wt", use="mp", floats="weight")
def _(spark, sf):
    w = xs.equal_leg_weights(base.monthly(spark, sf), ["month_end"], "carry_signal", xs.adaptive_leg_size, "realized")
    return w.select("month_end", "asset", F.col("k").alias("leg_size"), F.col("n").alias("n_universe"), "weight", "basket")


@query("x3_leg_size_rules", "WITH f AS (SELECT 'fixed' AS rule, * FROM (SELECT * FROM (SELECT *, 3 AS k FROM (SELECT *, " + _RN.format(p="month_end", s="carry_signal") + " AS rn, " + _N.format(p="month_end") + " AS n FROM mp))) UNION ALL SELECT 'fifth', *, n//5 FROM (SELECT *, "
       + _RN.format(p="month_end", s="carry_signal") + " AS rn, " + _N.format(p="month_end") + " AS n FROM mp) UNION ALL SELECT 'share', *, greatest(1, CAST(ceil(n*0.3::DOUBLE) AS INT)) FROM (SELECT *, " + _RN.format(p="month_end", s="carry_signal") + " AS rn, " + _N.format(p="month_end")
       + " AS n FROM mp)) SELECT rule, month_end, asset, CASE WHEN rn>n-k THEN 1 WHEN rn<=k THEN -1 ELSE 0 END AS leg FROM f", use="mp")
def _(spark, sf):
    m = base.monthly(spark, sf)
    out = None
    for rule, size in (("fixed", xs.fixed_leg_size(3)), ("fifth", xs.divided_leg_size(5)), ("share", xs.fraction_leg_size(0.3))):
        one = xs.assign_legs(m, ["month_end"], "carry_signal", size).select(F.lit(rule).alias("rule"), "month_end", "asset", "leg")
        out = one if out is None else out.unionByName(one)
    return out


@query("x3_top_bottom_legs_wide", "WITH " + legs_sql("wp", s="signal", r="ret", k="n//5")[2:] + " SELECT month_end, basket, count(*) AS n_names, sum(weight) AS total_weight, sum(weight*ret) AS leg_return FROM wt GROUP BY 1,2", use="wp", floats="total_weight leg_return")
def _(spark, sf):
    w = xs.equal_leg_weights(tb.wide_monthly_panel(spark, sf), ["month_end"], "signal", xs.divided_leg_size(5), "ret", splits=WIDE_SPLITS)
    return w.groupBy("month_end", "basket").agg(F.count(F.lit(1)).alias("n_names"), F.sum("weight").alias("total_weight"), F.sum(F.col("weight") * F.col("ret")).alias("leg_return"))


@query("x4_zscore", """SELECT month_end, asset, (carry_signal-avg(carry_signal) OVER w)/nullif(stddev_samp(carry_signal) OVER w,0) AS z1, coalesce((carry_signal-avg(carry_signal) OVER w)/nullif(stddev_pop(carry_signal) OVER w,0),0) AS z0 FROM mp WINDOW w AS (PARTITION BY month_end)""", use="mp", floats="z1 z0")
def _(spark, sf):
    m = base.monthly(spark, sf).select("month_end", "asset", "carry_signal")
    z = xs.zscore(xs.zscore(m, ["month_end"], ["carry_signal"], 1, "_z1"), ["month_end"], ["carry_signal"], 0, "_z0")
    return z.select("month_end", "asset", F.col("carry_signal_z1").alias("z1"), F.col("carry_signal_z0").alias("z0"))


@query("x4_zscore_wide", "SELECT month_end, asset, (ret-avg(ret) OVER w)/nullif(stddev_samp(ret) OVER w,0) AS z FROM wp WINDOW w AS (PARTITION BY month_end)", use="wp", floats="z")
def _(spark, sf):
    z = xs.zscore(tb.wide_monthly_panel(spark, sf).select("month_end", "asset", "ret"), ["month_end"], ["ret"])
    return z.select("month_end", "asset", F.col("ret_z").alias("z"))


@query("x5_residual", """SELECT month_end, asset, CASE WHEN n>=3 THEN spread-my-beta*(points-mx) END AS resid, CASE WHEN n>=3 THEN spread-b0*points END AS resid_no_const FROM (SELECT *, count(*) OVER w AS n, avg(spread) OVER w AS my, avg(points) OVER w AS mx,
 covar_pop(spread,points) OVER w/nullif(var_pop(points) OVER w,0) AS beta, sum(spread*points) OVER w/nullif(sum(points*points) OVER w,0) AS b0 FROM mp0 WINDOW w AS (PARTITION BY month_end))""", use="mp0", floats="resid resid_no_const", digits=5)
def _(spark, sf):
    m = base.monthly(spark, sf).select("month_end", "asset", "spread", "points")
    r = xs.residual(m, ["month_end"], "spread", "points")
    return xs.residual(r, ["month_end"], "spread", "points", "resid_no_const", add_const=False).select("month_end", "asset", "resid", "resid_no_const")


@query("x6_cross_stats", "SELECT date, avg(xret) AS mean, stddev_samp(xret) AS dispersion, min(xret) AS lowest, count(xret) AS n, median(xret) AS median FROM dp GROUP BY 1", use="dp", floats="mean dispersion lowest median")
def _(spark, sf):
    return xs.cross_stats(base.daily(spark, sf), ["date"], "xret")


@query("x6_cross_stats_wide", "SELECT month_end, avg(ret) AS mean, stddev_samp(ret) AS dispersion, min(ret) AS lowest, count(ret) AS n, median(ret) AS median FROM wp GROUP BY 1", use="wp", floats="mean dispersion lowest median")
def _(spark, sf):
    return xs.cross_stats(tb.wide_monthly_panel(spark, sf), ["month_end"], "ret", splits=WIDE_SPLITS)


_Z = "CASE WHEN count(carry) OVER w>=63 THEN (carry-avg(carry) OVER w)/nullif(stddev_samp(carry) OVER w,0) END"


@query("x7_stress_index", f"""WITH z AS (SELECT date, asset, carry, {_Z} AS z FROM dp WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW))
 SELECT date, 'zmean' AS method, -avg(z) AS stress FROM z GROUP BY 1 UNION ALL SELECT date, 'mean', -avg(carry) FROM z GROUP BY 1 UNION ALL SELECT date, 'median', -median(carry) FROM z GROUP BY 1 UNION ALL SELECT date, 'worst', -min(carry) FROM z GROUP BY 1""", use="dp", floats="stress", digits=6)
def _(spark, sf):
    z = tr.trailing_zscore(base.daily(spark, sf).select("date", "asset", "carry"), "carry")
    out = None
    for m in ("zmean", "mean", "median", "worst"):
        one = xs.stress_index(z, ["date"], "z" if m == "zmean" else "carry", m).withColumn("method", F.lit(m))
        out = one if out is None else out.unionByName(one)
    return out


@query("x9_spread_factor", f"""WITH r AS (SELECT *, {_RN.format(p='month_end', s='carry_signal')} AS rn, {_N.format(p='month_end')} AS n FROM mp WHERE realized IS NOT NULL)
 SELECT month_end, avg(realized) FILTER (WHERE rn>n-3) AS high_leg, avg(realized) FILTER (WHERE rn<=3) AS low_leg, string_agg(asset, ', ' ORDER BY asset) FILTER (WHERE rn>n-3) AS high_names, string_agg(asset, ', ' ORDER BY asset) FILTER (WHERE rn<=3) AS low_names,
 avg(realized) FILTER (WHERE rn>n-3)-avg(realized) FILTER (WHERE rn<=3) AS factor FROM r WHERE n>=6 GROUP BY 1""", use="mp", floats="high_leg low_leg factor")
def _(spark, sf):
    return xs.spread_factor(base.monthly(spark, sf), ["month_end"], "carry_signal", "realized")


@query("x10_blend", """SELECT month_end, asset, 0.5*zc+0.5*zs AS signal, zc-zs AS contrast FROM (SELECT month_end, asset, (carry_signal-avg(carry_signal) OVER w)/stddev_samp(carry_signal) OVER w AS zc, (spread-avg(spread) OVER w)/stddev_samp(spread) OVER w AS zs FROM mp WINDOW w AS (PARTITION BY month_end))""", use="mp", floats="signal contrast")
def _(spark, sf):
    m = base.monthly(spark, sf).select("month_end", "asset", "carry_signal", "spread")
    b = xs.blend(m, ["month_end"], {"carry_signal": 0.5, "spread": 0.5})
    return b.select("month_end", "asset", "signal", (F.col("carry_signal_z") - F.col("spread_z")).alias("contrast"))


@query("x11_top_bottom_names", f"""WITH r AS (SELECT *, {_RN.format(p='month_end', s='carry_signal')} AS rn, {_N.format(p='month_end')} AS n FROM mp) SELECT month_end, string_agg(asset, ', ' ORDER BY asset) FILTER (WHERE rn<=3) AS lowest, string_agg(asset, ', ' ORDER BY asset) FILTER (WHERE rn>n-3) AS highest FROM r GROUP BY 1""", use="mp")
def _(spark, sf):
    return xs.top_bottom_names(base.monthly(spark, sf), ["month_end"], "carry_signal")


@query("x12_double_sort_grid", "WITH " + OC_SQL[2:] + f""", qq AS (SELECT *, {_q5('carry_signal','oc','month_end')} AS cq, {_q5('atm_vol','oc','month_end')} AS vq FROM oc)
 SELECT cq AS carry_q, """ + ", ".join(f"avg(realized) FILTER (WHERE vq={i}) AS vol_{i}" for i in range(1, 6)) + " FROM qq WHERE cq IS NOT NULL AND vq IS NOT NULL GROUP BY 1", use="mp ol pairs", floats=" ".join(f"vol_{i}" for i in range(1, 6)))
def _(spark, sf):
    c = xs.quantile_buckets(option_carry(spark, sf), ["month_end"], "carry_signal", out="carry_q")
    c = xs.quantile_buckets(c, ["month_end"], "atm_vol", out="vol_q")
    return xs.mean_grid(c, "carry_q", "vol_q", "realized", [1, 2, 3, 4, 5]).toDF("carry_q", *[f"vol_{i}" for i in range(1, 6)])


_BK = [("high carry + low vol", "cq=5 AND vq=1"), ("high carry + high vol", "cq=5 AND vq=5"), ("high carry + low bad skew", "cq=5 AND sq=1"),
       ("high carry + high bad skew", "cq=5 AND sq=5"), ("low carry + high bad skew", "cq=1 AND sq=5"), ("high carry + high butterfly", "cq=5 AND bq=5")]


@query("x13_bucket_stats", "WITH " + OC_SQL[2:] + f""", qq AS (SELECT *, {_q5('carry_signal','oc','month_end')} AS cq, {_q5('atm_vol','oc','month_end')} AS vq, {_q5('bad_skew25','oc','month_end')} AS sq, {_q5('bf25','oc','month_end')} AS bq FROM oc),
 t AS ({' UNION ALL '.join(f"SELECT '{n}' AS bucket_name, * FROM qq WHERE {c}" for n, c in _BK)}), s AS (SELECT 'All' AS sample, * FROM t UNION ALL SELECT 'EAST', * FROM t WHERE bucket IN ('ASIA','MIDDLE EAST') UNION ALL SELECT 'WEST', * FROM t WHERE bucket NOT IN ('ASIA','MIDDLE EAST'))
 SELECT sample, bucket_name, count(realized) AS observations, avg(realized) AS avg_return, stddev_samp(realized) AS volatility, avg(realized)/nullif(stddev_samp(realized),0) AS sharpe, avg(CASE WHEN realized>0 THEN 1.0 ELSE 0.0 END) AS hit_rate,
 skewness(realized) AS skewness, min(realized) AS worst FROM s WHERE realized IS NOT NULL GROUP BY 1,2""", use="mp ol pairs", floats="avg_return volatility sharpe hit_rate skewness worst", digits=6)
def _(spark, sf):
    c = option_carry(spark, sf)
    for col, q in (("carry_signal", "cq"), ("atm_vol", "vq"), ("bad_skew25", "sq"), ("bf25", "bq")):
        c = xs.quantile_buckets(c, ["month_end"], col, out=q)
    east = F.col("bucket").isin("ASIA", "MIDDLE EAST")
    return xs.bucket_stats(c, {n: F.expr(x) for n, x in _BK}, {"All": F.lit(True), "EAST": east, "WEST": ~east}, "realized")


@query("x14_median_correlation", "SELECT corr(a,b) AS median_corr, count(*) AS n_assets FROM (SELECT asset, median(carry_signal) AS a, median(realized) AS b FROM mp GROUP BY 1)", use="mp", floats="median_corr", digits=6)
def _(spark, sf):
    return xs.median_corr(base.monthly(spark, sf), "carry_signal", "realized")


@query("f5_min_cross_section", "SELECT date, asset, mid FROM (SELECT *, count(mid) OVER (PARTITION BY date) AS n FROM qd) WHERE n>=12", use="qd", floats="mid")
def _(spark, sf):
    return xs.min_size(tb.quotes_daily(spark, sf).select("date", "asset", "mid"), ["date"], "mid", 12)


_FILT = "SELECT '{v}' AS variant, month_end, asset, {s} AS score FROM oc2 WHERE {c}"


@query("f8_filter_variants", "WITH " + OC_SQL[2:] + """, oc1 AS (SELECT *, count(*) OVER w AS n, quantile_cont(atm_vol,0.8) OVER w AS qv, quantile_cont(bad_skew25,0.8) OVER w AS qs,
 coalesce((carry_signal-avg(carry_signal) OVER w)/nullif(stddev_pop(carry_signal) OVER w,0),0) AS zc, coalesce((atm_vol-avg(atm_vol) OVER w)/nullif(stddev_pop(atm_vol) OVER w,0),0) AS zv, coalesce((bad_skew25-avg(bad_skew25) OVER w)/nullif(stddev_pop(bad_skew25) OVER w,0),0) AS zs FROM oc WINDOW w AS (PARTITION BY month_end)),
 oc2 AS (SELECT *, n>=5 AND coalesce(atm_vol>=qv,false) AS hv, n>=5 AND coalesce(bad_skew25>=qs,false) AS hs FROM oc1) """
       + " UNION ALL ".join([_FILT.format(v="baseline", s="carry_signal", c="true"), _FILT.format(v="vol", s="carry_signal", c="NOT hv"), _FILT.format(v="skew", s="carry_signal", c="NOT hs"),
                             _FILT.format(v="vol_or_skew", s="carry_signal", c="NOT (hv OR hs)"), _FILT.format(v="score", s="zc-0.5*zv-0.5*zs", c="true")]), use="mp ol pairs", floats="score", digits=6)
def _(spark, sf):
    oc = option_carry(spark, sf)
    out = None
    for v in ("baseline", "vol", "skew", "vol_or_skew", "score"):
        one = xs.apply_filter(oc, v, lam=0.5, gam=0.5).select(F.lit(v).alias("variant"), "month_end", "asset", "score")
        out = one if out is None else out.unionByName(one)
    return out


@query("j4_carry_option_join", "WITH " + OC_SQL[2:] + " SELECT month_end, asset, carry_signal, atm_vol FROM oc", use="mp ol pairs", floats="carry_signal atm_vol")
def _(spark, sf):
    return option_carry(spark, sf).select("month_end", "asset", "carry_signal", "atm_vol")


@query("j10_parameter_grid", "SELECT month_end, asset, lookback, target, carry_signal*target AS scaled FROM mp CROSS JOIN (SELECT unnest([21,63,252]) AS lookback) CROSS JOIN (SELECT unnest([0.08::DOUBLE,0.1::DOUBLE]) AS target)", use="mp", floats="scaled target")
def _(spark, sf):
    m = base.monthly(spark, sf).withColumn("lookback", F.explode(F.array(*map(F.lit, (21, 63, 252))))).withColumn("target", F.explode(F.array(F.lit(0.08), F.lit(0.10))))
    return m.select("month_end", "asset", "lookback", "target", (F.col("carry_signal") * F.col("target")).alias("scaled"))


_LOOKBACKS = (3, 6, 12)


@query("j10_lookback_grid", "WITH " + ", ".join(f"w{k} AS (SELECT month_end, asset, {k} AS lookback, CASE WHEN count(realized) OVER w>={k // 2} THEN sum(realized) OVER w END AS momentum FROM mp WINDOW w AS (PARTITION BY asset ORDER BY month_end ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW))" for k in _LOOKBACKS)
       + " SELECT month_end, asset, lookback, target, momentum*target AS scaled FROM (" + " UNION ALL ".join(f"SELECT * FROM w{k}" for k in _LOOKBACKS) + ") CROSS JOIN (SELECT unnest([0.08::DOUBLE,0.1::DOUBLE]) AS target)", use="mp", floats="scaled target")
def _(spark, sf):
    """Lookback and target as data: one momentum column per lookback, unrolled into rows of the grid."""
    m = base.monthly(spark, sf).select("month_end", "asset", "realized")
    for k in _LOOKBACKS:
        m = tr.momentum(m, "realized", k, out=f"_m{k}", date="month_end")
    cells = F.array(*[F.struct(F.lit(k).alias("lookback"), F.lit(t).alias("target"), (F.col(f"_m{k}") * t).alias("scaled")) for k in _LOOKBACKS for t in (0.08, 0.10)])
    return m.select("month_end", "asset", F.explode(cells).alias("c")).select("month_end", "asset", "c.*")
