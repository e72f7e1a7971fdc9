"""Regressions, factor analytics, attribution and models (G)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.functions.stats import div
from panelspark.operators import holdings
from panelspark.operators import attribution as at
from panelspark.operators import book as bk
from panelspark.operators import cross_section as xs
from panelspark.operators import model as md
from panelspark.operators import performance as pf
from panelspark.operators import regress as rg
from panelspark.operators import trailing as tr
from panelspark.plans import monthly as pm
from panelspark.queries import base, booksql as bs
from panelspark.queries.book import _FRAME, _SB
from panelspark.queries.cross_section import OC_SQL, option_carry
from panelspark.queries.performance import CRISES, CRISIS_SQL, _NW, _ST, strategy_tracks
from panelspark.queries.registry import query
from panelspark.queries.trailing import scaled
from panelspark.sources import tables as tb


def nw1(src: str, key: str, order: str, lags: int, min_obs: int, periods: int, out: str = "q") -> str:
    """One-regressor Newey-West in closed form over ``src(key, order, y, x)``."""
    part = f"PARTITION BY {key}"
    lag_cols = ", ".join(f"lag(g0,{i}) OVER w AS a{i}, lag(g1,{i}) OVER w AS b{i}" for i in range(1, lags + 1))

    def s(a, b):
        terms = [f"sum(g{a}*g{b})"]
        for i in range(1, lags + 1):
            w = repr(1 - i / (lags + 1))
            la, lb = ("a", "b")[a] + str(i), ("a", "b")[b] + str(i)
            terms.append(f"{w}*(coalesce(sum(g{a}*{lb}),0)+coalesce(sum({la}*g{b}),0))")
        return "+".join(terms)

    return f""", {out}0 AS (SELECT *, count(*) OVER k AS n, avg(x) OVER k AS mx, avg(y) OVER k AS my, var_pop(x) OVER k AS vx, var_pop(y) OVER k AS vy, covar_pop(x,y) OVER k AS cxy FROM {src} WHERE y IS NOT NULL AND x IS NOT NULL WINDOW k AS ({part})),
 {out}1 AS (SELECT *, y-my-cxy/vx*(x-mx) AS g0, (y-my-cxy/vx*(x-mx))*(x-mx) AS g1 FROM {out}0 WHERE n>={min_obs} AND vx>0),
 {out}2 AS (SELECT *, {lag_cols} FROM {out}1 WINDOW w AS ({part} ORDER BY {order})),
 {out}3 AS (SELECT {key}, max(n) AS n, max(mx) AS mx, max(my) AS my, max(vx) AS vx, max(vy) AS vy, max(cxy) AS cxy, {s(0, 0)} AS s00, {s(0, 1)} AS s01, {s(1, 1)} AS s11 FROM {out}2 GROUP BY {key}),
 {out} AS (SELECT {key}, n, cxy*cxy/vx/vy AS r2, (my-cxy/vx*mx)*{periods} AS alpha_ann, (my-cxy/vx*mx)/sqrt(s00/n/n-2*mx*s01/n/(n*vx)+mx*mx*s11/(n*vx)/(n*vx)) AS alpha_t, cxy/vx AS beta_x, cxy/vx/sqrt(s11/(n*vx)/(n*vx)) AS t_x FROM {out}3)"""


_NWF = "r2 alpha_ann alpha_t beta_x t_x"


@query("g1_newey_west", "WITH a0 AS (SELECT p.asset, p.date, p.xret AS y, b.ret AS x FROM dp p JOIN bt b ON b.date=p.date AND b.track='ALL')" + nw1("a0", "asset", "date", 5, 250, 252) + " SELECT * FROM q", use="dp bt", floats=_NWF, digits=6)
def _(spark, sf):
    p = base.staged_daily(spark, sf).select("date", "asset", F.col("xret").alias("y"))
    dol = p.filter("y is not null").groupBy("date").agg(F.avg("y").alias("x"))
    return rg.newey_west(p.join(dol, "date"), ["asset"], "y", ["x"], 5, 250)


def _nw2_sql(src: str, key: str, order: str, lags: int, min_obs: int) -> str:
    """Two-regressor version via Frisch-Waugh residuals of each regressor on the other."""
    out = ""
    for me, other in (("x1", "x2"), ("x2", "x1")):
        out += f""", {me}a AS (SELECT *, count(*) OVER k AS n, avg({me}) OVER k AS m, avg({other}) OVER k AS mo, avg(y) OVER k AS my, covar_pop({me},{other}) OVER k/var_pop({other}) OVER k AS b, covar_pop(y,{other}) OVER k/var_pop({other}) OVER k AS c FROM {src} WINDOW k AS (PARTITION BY {key})),
 {me}b AS (SELECT *, {me}-m-b*({other}-mo) AS rx, y-my-c*({other}-mo) AS ry FROM {me}a WHERE n>={min_obs}),
 {me}c AS (SELECT *, sum(rx*ry) OVER k/sum(rx*rx) OVER k AS beta FROM {me}b WINDOW k AS (PARTITION BY {key})),
 {me}d AS (SELECT *, (ry-beta*rx)*rx AS g FROM {me}c), {me}e AS (SELECT *, {', '.join(f'lag(g,{i}) OVER w AS g{i}' for i in range(1, lags + 1))} FROM {me}d WINDOW w AS (PARTITION BY {key} ORDER BY {order})),
 {me}f AS (SELECT {key}, max(n) AS n, max(beta) AS beta, max(beta)/(sqrt(sum(g*g)+2*({'+'.join(f'{1 - i / (lags + 1)!r}*coalesce(sum(g*g{i}),0)' for i in range(1, lags + 1))}))/sum(rx*rx)) AS t FROM {me}e GROUP BY {key})"""
    return out


@query("g1_newey_west_two_factors", "WITH a0 AS (SELECT p.asset, p.date, p.xret AS y, b.ret AS x1, c.ret AS x2 FROM dp p JOIN bt b ON b.date=p.date AND b.track='ALL' JOIN bt c ON c.date=p.date AND c.track='ASIA' WHERE p.xret IS NOT NULL)" + _nw2_sql("a0", "asset", "date", 5, 250)
       + " SELECT x1f.asset, x1f.n, x1f.beta AS beta_x1, x1f.t AS t_x1, x2f.beta AS beta_x2, x2f.t AS t_x2 FROM x1f JOIN x2f ON x2f.asset=x1f.asset", use="dp bt", floats="beta_x1 t_x1 beta_x2 t_x2", digits=6)
def _(spark, sf):
    p = base.staged_daily(spark, sf).select("date", "asset", "bucket", F.col("xret").alias("y"))
    f = p.filter("y is not null").groupBy("date").agg(F.avg("y").alias("x1"), F.avg(F.when(F.col("bucket") == "ASIA", F.col("y"))).alias("x2"))
    return rg.newey_west(p.join(f, "date"), ["asset"], "y", ["x1", "x2"], 5, 250).select("asset", "n", "beta_x1", "t_x1", "beta_x2", "t_x2")


@query("m16_asset_factor_correlations", """SELECT p.asset, b.track AS factor, count(*) AS n, corr(p.xret, b.ret) AS corr FROM dp p JOIN bt b ON b.date=p.date WHERE p.xret IS NOT NULL AND b.ret IS NOT NULL AND b.track IN ('ALL','ASIA') GROUP BY 1,2""", use="dp bt", floats="corr")
def _(spark, sf):
    p = base.staged_daily(spark, sf).select("date", "asset", "bucket", F.col("xret").alias("y"))
    f = p.filter("y is not null").groupBy("date").agg(F.avg("y").alias("ALL"), F.avg(F.when(F.col("bucket") == "ASIA", F.col("y"))).alias("ASIA"))
    return rg.factor_correlation(p.join(f, "date"), ["asset"], "y", ["ALL", "ASIA"])


@query("g2_mean_standard_error", "WITH " + (_ST + _NW)[2:] + " SELECT c0.track, count(r) AS n, avg(r) AS mean, max(se) AS nw_se, avg(r)/max(se) AS nw_t FROM c0 JOIN nw ON nw.track=c0.track GROUP BY 1", use="bt", floats="mean nw_se nw_t")
def _(spark, sf):
    return rg.mean_standard_error(scaled(spark, sf), ["track"], "ret")


@query("g3_pooled_ols", "WITH " + OC_SQL[2:] + """, x AS (SELECT s.sample, realized AS y, atm_vol/1000 AS x FROM oc JOIN (VALUES ('All'),('EAST'),('WEST')) s(sample) ON s.sample='All' OR (s.sample='EAST')=(bucket IN ('ASIA','MIDDLE EAST')) WHERE realized IS NOT NULL AND atm_vol IS NOT NULL),
 m AS (SELECT sample, count(*) AS n, regr_slope(y,x) AS b, regr_intercept(y,x) AS a, regr_sxx(y,x) AS sxx, avg(x) AS mx, regr_syy(y,x)*(1-regr_r2(y,x))/(count(*)-2) AS s2 FROM x GROUP BY 1)
 SELECT sample, 'const' AS variable, a AS coefficient, a/sqrt(s2*(1.0/n+mx*mx/sxx)) AS t_stat, n AS n_obs FROM m UNION ALL SELECT sample, 'x', b, b/sqrt(s2/sxx), n FROM m""", use="mp ol pairs", floats="coefficient t_stat", digits=6)
def _(spark, sf):
    east = F.col("bucket").isin("ASIA", "MIDDLE EAST")
    oc = option_carry(spark, sf).withColumn("sample", F.explode(F.array(F.lit("All"), F.when(east, "EAST").otherwise("WEST"))))
    return rg.ols(oc.select("sample", F.col("realized").alias("y"), (F.col("atm_vol") / 1000).alias("x")), ["sample"], "y", ["x"])


def ols_sql(src: str, model: str, y: str, xs_: list[str]) -> str:
    """Least squares of any number of regressors: the augmented cross products, swept once per variable."""
    q = len(xs_) + 1
    names = ", ".join(f"'{x}'" for x in ["const", *xs_])
    live = " AND ".join(f"{c} IS NOT NULL" for c in [y, *xs_])
    return f"""(WITH RECURSIVE o AS (SELECT [1.0::DOUBLE, {', '.join(f'{c}::DOUBLE' for c in [*xs_, y])}] AS z FROM {src} WHERE {live}), e AS (SELECT i, j, sum(z[i]*z[j]) AS v FROM o, range(1,{q + 2}) a(i), range(1,{q + 2}) b(j) GROUP BY 1,2),
  s AS (SELECT 1 AS k, list(r ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS r FROM e GROUP BY 1) UNION ALL
   SELECT k+1, list_transform(range(1,{q + 2}), lambda i: list_transform(range(1,{q + 2}), lambda j: CASE WHEN i=k AND j=k THEN 1/m[k][k] WHEN i=k THEN m[k][j]/m[k][k] WHEN j=k THEN -m[i][k]/m[k][k] ELSE m[i][j]-m[i][k]*m[k][j]/m[k][k] END)) FROM s WHERE k<={q})
  SELECT 'All' AS pool, '{model}' AS model, [{names}][h] AS variable, m[h][{q + 1}] AS coefficient, m[h][{q + 1}]/sqrt(m[{q + 1}][{q + 1}]/(n-{q})*m[h][h]) AS t_stat, n AS n_obs FROM s, (SELECT count(*) AS n FROM o), range(1,{q + 1}) c(h) WHERE k={q + 1})"""


_G3 = {"simple": ["carry_signal", "atm_vol", "bad_skew25"], "interaction": ["carry_signal", "atm_vol", "bad_skew25", "carry_x_bad_skew"]}


@query("g3_pooled_ols_interaction", "WITH " + OC_SQL[2:] + ", x AS (SELECT *, carry_signal*bad_skew25 AS carry_x_bad_skew FROM oc) SELECT * FROM (" + " UNION ALL ".join("SELECT * FROM " + ols_sql("x", m, "realized", v) for m, v in _G3.items()) + ")", use="mp ol pairs", floats="coefficient t_stat", digits=6)
def _(spark, sf):
    oc = option_carry(spark, sf).withColumn("carry_x_bad_skew", F.col("carry_signal") * F.col("bad_skew25")).withColumn("pool", F.lit("All"))
    out = None
    for name, xs_ in _G3.items():
        one = rg.ols(oc, ["pool"], "realized", xs_).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


_UIP = "a0 AS (SELECT asset, month_end, ln(next_spot/spot) AS y, ln(spot/fwd) AS x FROM mp WHERE next_spot IS NOT NULL)"


@query("g4_uip_regression", f"WITH {_UIP}, a1 AS (SELECT *, 'POOLED' AS pool FROM a0)" + nw1("a0", "asset", "month_end", 3, 24, 12) + nw1("a1", "pool", "asset, month_end", 3, 24, 12, "z") + " SELECT * FROM q UNION ALL SELECT * FROM z", use="mp", floats=_NWF, digits=6)
def _(spark, sf):
    m = base.monthly(spark, sf).select("asset", "month_end", F.ln(F.col("next_spot") / F.col("spot")).alias("y"), F.ln(F.col("spot") / F.col("fwd")).alias("x"))
    per = rg.newey_west(m, ["asset"], "y", ["x"], 3, 24, ["month_end"], periods=12)
    return per.unionByName(rg.pooled_newey_west(m, "y", ["x"], 3, rows=500))


@query("g5_crash_regression", "WITH sp AS (SELECT date, avg(ask-bid) AS v FROM qd GROUP BY 1), a0 AS (SELECT b.track, b.date, b.ret AS y, ln(v)-lag(ln(v)) OVER (PARTITION BY track ORDER BY b.date) AS x FROM bt b JOIN sp ON sp.date=b.date WHERE v>0)" + nw1("a0", "track", "date", 5, 250, 252) + " SELECT * FROM q", use="bt qd", floats=_NWF, digits=6)
def _(spark, sf):
    v = tb.quotes_daily(spark, sf).groupBy("date").agg(F.avg(F.col("ask") - F.col("bid")).alias("v")).filter("v > 0")
    w = Window.partitionBy("track").orderBy("date")
    j = base.tracks(spark, sf).join(v, "date").select("track", "date", F.col("ret").alias("y"), (F.ln("v") - F.lag(F.ln("v")).over(w)).alias("x"))
    return rg.newey_west(j, ["track"], "y", ["x"], 5, 250)


@query("g6_spanning_tests", "WITH a0 AS (SELECT 'ASIA on EUROPE' AS test, a.date, a.ret AS y, b.ret AS x FROM bt a JOIN bt b ON a.date=b.date AND a.track='ASIA' AND b.track='EUROPE' UNION ALL SELECT 'EUROPE on ASIA', a.date, b.ret, a.ret FROM bt a JOIN bt b ON a.date=b.date AND a.track='ASIA' AND b.track='EUROPE')" + nw1("a0", "test", "date", 5, 250, 252) + " SELECT * FROM q", use="bt", floats=_NWF, digits=6)
def _(spark, sf):
    t = rg.spanning_pairs(base.tracks(spark, sf), [("ASIA", "EUROPE"), ("EUROPE", "ASIA")])
    return rg.newey_west(t, ["test"], "y", ["x"], 5, 250)


def monthly_log_returns(spark, sf):
    w = Window.partitionBy("asset").orderBy("month_end")
    m = base.monthly(spark, sf)
    return m.select(F.col("month_end").alias("date"), "asset", (F.ln("spot") - F.lag(F.ln("spot")).over(w)).alias("ret"))


_SQUARINGS = 24  # the matrix to the power of 2^24 is the first component's projector
_G7 = f"""WITH lr AS (SELECT month_end AS date, asset, ln(spot)-lag(ln(spot)) OVER (PARTITION BY asset ORDER BY month_end) AS v FROM mp), oa AS (SELECT asset FROM lr WHERE v IS NOT NULL GROUP BY 1 HAVING count(*)>=60), lv AS (SELECT lr.* FROM lr JOIN oa ON oa.asset=lr.asset WHERE v IS NOT NULL),
 wd AS (SELECT date FROM lv GROUP BY 1 HAVING count(*)=(SELECT count(*) FROM oa)), xc AS (SELECT lv.date, lv.asset, v-avg(v) OVER (PARTITION BY lv.asset) AS x FROM lv JOIN wd ON wd.date=lv.date),
 cv AS (SELECT a.asset AS i, b.asset AS j, sum(a.x*b.x) AS c FROM xc a JOIN xc b ON a.date=b.date GROUP BY 1,2), cr AS (SELECT i, list(c ORDER BY j) AS r FROM cv GROUP BY 1), cm AS (SELECT list(r ORDER BY i) AS m, list(i ORDER BY i) AS names, len(list(i)) AS n FROM cr),
 pc AS (WITH RECURSIVE z AS (SELECT 1 AS comp, 0 AS k, n, m AS c, m AS p FROM cm UNION ALL
  SELECT comp+(k={_SQUARINGS})::INT, CASE WHEN k={_SQUARINGS} THEN 0 ELSE k+1 END, n, c2, list_transform(p2, lambda r: list_transform(r, lambda e: e/list_sum(list_transform(range(1,n+1), lambda i: p2[i][i])))) FROM
   (SELECT comp, k, n, c2, CASE WHEN k={_SQUARINGS} THEN c2 ELSE list_transform(p, lambda r: list_transform(p, lambda s: list_dot_product(r,s))) END AS p2 FROM
    (SELECT *, CASE WHEN k={_SQUARINGS} THEN list_transform(range(1,n+1), lambda i: list_transform(range(1,n+1), lambda j: c[i][j]-p[i][j]*list_sum(list_transform(range(1,n+1), lambda h: list_dot_product(c[h],p[h]))))) ELSE c END AS c2 FROM z WHERE comp<least(8,n) OR k<{_SQUARINGS})))
  SELECT comp, list_sum(list_transform(range(1,n+1), lambda h: list_dot_product(c[h],p[h]))) AS lam, list_transform(p[big], lambda e: e/sqrt(list_dot_product(p[big],p[big]))) AS v FROM (SELECT *, list_position(list_transform(range(1,n+1), lambda i: p[i][i]), list_max(list_transform(range(1,n+1), lambda i: p[i][i]))) AS big FROM z WHERE k={_SQUARINGS})),
 sg AS (SELECT comp, lam, list_transform(v, lambda e: CASE WHEN list_sum(v)<0 THEN -e ELSE e END) AS v FROM pc), ld AS (SELECT comp, unnest(names) AS asset, unnest(v) AS w FROM sg, cm)"""


@query("g7_principal_components", _G7 + """ SELECT 'PC'||comp AS component, lam/t AS explained_variance, sum(lam) OVER (ORDER BY comp)/t AS cumulative_variance FROM sg, (SELECT sum(x*x) AS t FROM xc)""", use="mp", floats="explained_variance cumulative_variance", digits=6)
def _(spark, sf):
    return rg.principal_components(monthly_log_returns(spark, sf), "ret")["explained"]


@query("g7_loadings", _G7 + """ SELECT asset, max(w) FILTER (WHERE comp=1) AS pc1, max(w) FILTER (WHERE comp=2) AS pc2, max(w) FILTER (WHERE comp=3) AS pc3 FROM ld GROUP BY 1""", use="mp", floats="pc1 pc2 pc3", digits=5)
def _(spark, sf):
    return rg.principal_components(monthly_log_returns(spark, sf), "ret")["loadings"]


@query("g7_factor_correlations", _G7 + """, sc AS (SELECT date, comp, sum(x*w) AS score FROM xc JOIN ld ON ld.asset=xc.asset WHERE comp<=3 GROUP BY 1,2), lb AS (SELECT lr.date, lr.v, mp.bucket FROM lr JOIN mp ON mp.asset=lr.asset AND mp.month_end=lr.date), fa AS (SELECT date, avg(v) AS f_all, avg(v) FILTER (WHERE bucket='ASIA') AS f_asia FROM lb GROUP BY 1)
 SELECT 'pc'||comp AS component, 'ALL' AS factor, count(*) AS n, corr(score, f_all) AS corr FROM sc JOIN fa ON fa.date=sc.date WHERE f_all IS NOT NULL GROUP BY 1 UNION ALL SELECT 'pc'||comp, 'ASIA', count(*), corr(score, f_asia) FROM sc JOIN fa ON fa.date=sc.date WHERE f_asia IS NOT NULL GROUP BY 1""", use="mp", floats="corr", digits=5)
def _(spark, sf):
    r = monthly_log_returns(spark, sf)
    bucket = base.monthly(spark, sf).select(F.col("month_end").alias("date"), "asset", "bucket")
    f = r.join(bucket, ["date", "asset"]).groupBy("date").agg(F.avg("ret").alias("ALL"), F.avg(F.when(F.col("bucket") == "ASIA", F.col("ret"))).alias("ASIA"))
    return rg.component_correlations(rg.principal_components(r, "ret")["scores"], f, ["ALL", "ASIA"])


_CON = (bs.book("b"))[2:] + """, cb AS (SELECT w.date, w.asset, bucket, weight, weight*xret AS c, weight*sret AS cs, weight*(xret-sret) AS cc FROM bvt w LEFT JOIN dp ON dp.date=w.date AND dp.asset=w.asset), bb AS (SELECT date, coalesce(sum(c),0) AS b FROM cb GROUP BY 1),
 ag AS (SELECT asset, max(bucket) AS bucket, sum(c) AS contrib_total, avg(c)*252 AS contrib_ann, sum(c)/(SELECT sum(b) FROM bb) AS share_of_pnl, avg(cc)*252 AS carry_part_ann, avg(cs)*252 AS spot_part_ann, covar_samp(c,b)/(SELECT var_samp(b) FROM bb) AS risk_share,
 avg(weight) AS avg_weight, avg(CASE WHEN weight>0 THEN 1.0 WHEN weight IS NOT NULL THEN 0 END) AS pct_long, avg(CASE WHEN weight<0 THEN 1.0 WHEN weight IS NOT NULL THEN 0 END) AS pct_short FROM cb JOIN bb ON bb.date=cb.date GROUP BY 1)"""
_AF = "contrib_total contrib_ann share_of_pnl carry_part_ann spot_part_ann risk_share avg_weight pct_long pct_short"


def attributed(spark, sf):
    p, reb, by_date, unit = base.target_book(spark, sf)
    return holdings.attribution(holdings.contributions(holdings.held(reb), by_date, p), reb, by_date, unit, p)


@query("g8_attribution", "WITH " + _CON + " SELECT * EXCLUDE (bucket) FROM ag", use="dp dense", floats=_AF, digits=6)
def _(spark, sf):
    return attributed(spark, sf)


@query("g9_attribution_by_group", "WITH " + _CON + " SELECT bucket, sum(contrib_ann) AS contrib_ann, sum(share_of_pnl) AS share_of_pnl, sum(risk_share) AS risk_share FROM ag GROUP BY 1", use="dp dense", floats="contrib_ann share_of_pnl risk_share", digits=6)
def _(spark, sf):
    return at.group_attribution(attributed(spark, sf), tb.conventions(spark, sf))


@query("g9_attribution_by_year", "WITH " + _CON + " SELECT bucket, CAST(year(date) AS INT) AS year, sum(c) AS contrib FROM cb GROUP BY 1,2", use="dp dense", floats="contrib", digits=7)
def _(spark, sf):
    p, reb, by_date, _ = base.target_book(spark, sf)
    c = holdings.contributions(holdings.held(reb), by_date, p).select("date", "asset", "contrib").unionByName(holdings.idle_contributions(reb, by_date))
    return at.yearly_attribution(c, tb.conventions(spark, sf))


_FLAGS = _SB + _FRAME + """, fl AS (SELECT strategy, month_end, gross_return, row_number() OVER (PARTITION BY strategy ORDER BY gross_return, month_end)<=10 AS worst FROM pr), ct AS (SELECT wt.strategy, wt.asset, wt.month_end, basket, weight*realized AS c, gross_return AS g, worst FROM wt JOIN fl ON fl.strategy=wt.strategy AND fl.month_end=wt.month_end)"""


def flagged(spark, sf):
    w = base.sample_books(spark, sf).withColumn("contribution", F.col("weight") * F.col("realized"))
    r = pm.strategy_frame(w, with_names=False).select("strategy", "month_end", "gross_return")
    return at.month_flags(w.select("strategy", "month_end", "asset", "basket", "contribution"), r, CRISES)


@query("g10_contribution_table", "WITH " + _FLAGS[2:] + """ SELECT strategy, asset, sum(c) AS total, avg(c) AS monthly_avg, avg(c)*12 AS annualised, coalesce(sum(c) FILTER (WHERE g>0),0) AS up_months, coalesce(sum(c) FILTER (WHERE g<0),0) AS down_months, coalesce(sum(c) FILTER (WHERE worst),0) AS worst_months,
 coalesce(sum(c) FILTER (WHERE basket='long_high_carry'),0) AS long_side, coalesce(sum(c) FILTER (WHERE basket='short_low_carry'),0) AS short_side FROM ct GROUP BY 1,2""", use="mp", floats="total monthly_avg annualised up_months down_months worst_months long_side short_side")
def _(spark, sf):
    return at.contribution_table(flagged(spark, sf))


@query("g10_crisis_contributions", "WITH " + _FLAGS[2:] + f" SELECT strategy, asset, win AS crisis, sum(c) AS contribution FROM ct JOIN {CRISIS_SQL} ON month_end BETWEEN a AND b GROUP BY 1,2,3", use="mp", floats="contribution")
def _(spark, sf):
    return at.crisis_contributions(flagged(spark, sf))


@query("g11_standalone_assets", """WITH m0 AS (SELECT asset, month_end, realized/10 AS r, product(1+realized/10) OVER (PARTITION BY asset ORDER BY month_end ROWS UNBOUNDED PRECEDING) AS w FROM mp WHERE realized IS NOT NULL), m1 AS (SELECT *, w/greatest(max(w) OVER (PARTITION BY asset ORDER BY month_end ROWS UNBOUNDED PRECEDING),1.0)-1 AS dd FROM m0)
 SELECT asset, count(r) AS observations, pow(product(1+r),12.0/count(r))-1 AS annual_return, stddev_samp(r)*sqrt(12.0) AS annual_volatility, min(dd) AS maximum_drawdown, product(1+r)-1 AS final_return FROM m1 GROUP BY 1""", use="mp", floats="annual_return annual_volatility maximum_drawdown final_return", digits=6)
def _(spark, sf):
    m = base.monthly(spark, sf).withColumn("realized", F.col("realized") / 10)
    return at.standalone(m).select("asset", "observations", "annual_return", "annual_volatility", "maximum_drawdown", "final_return")


_G12 = """, mr AS (SELECT last_day(date) AS month_end, product(1+ret/10)-1 AS r FROM bt WHERE track='ALL' GROUP BY 1), fx AS (SELECT month_end, max(value) FILTER (WHERE asset='N01') AS N01, max(value) FILTER (WHERE asset='N02') AS N02 FROM om GROUP BY 1), ds AS (SELECT last_day(date) AS month_end, arg_max(d, date) AS carry_dispersion FROM (SELECT date, stddev_samp(carry) AS d FROM dp GROUP BY 1) GROUP BY 1),
 jj AS (SELECT mr.month_end, r, last_value(N01 IGNORE NULLS) OVER u AS N01, last_value(N02 IGNORE NULLS) OVER u AS N02, carry_dispersion, product(1+r) OVER u AS w FROM mr LEFT JOIN fx ON fx.month_end=mr.month_end LEFT JOIN ds ON ds.month_end=mr.month_end WINDOW u AS (ORDER BY mr.month_end ROWS UNBOUNDED PRECEDING)),
 sf AS (SELECT month_end, N01/lag(N01) OVER w-1 AS N01_change, N02/lag(N02) OVER w-1 AS N02_change, CASE WHEN count(r) OVER w3>=3 THEN stddev_samp(r) OVER w3 END AS carry_volatility_3m, CASE WHEN count(r) OVER w3>=3 THEN product(1+r) OVER w3-1 END AS carry_momentum_3m, CASE WHEN count(r) OVER w12>=12 THEN product(1+r) OVER w12-1 END AS carry_momentum_12m,
 w/max(w) OVER u-1 AS carry_drawdown, carry_dispersion, CASE WHEN lead(r) OVER w>0 THEN 1.0 ELSE 0.0 END AS target_next_positive, lead(r) OVER w AS next_return FROM jj WINDOW w AS (ORDER BY month_end), u AS (ORDER BY month_end ROWS UNBOUNDED PRECEDING), w3 AS (ORDER BY month_end ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), w12 AS (ORDER BY month_end ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))"""
_FEATS = ["N01_change", "N02_change", "carry_volatility_3m", "carry_momentum_3m", "carry_momentum_12m", "carry_drawdown", "carry_dispersion"]


def features(spark, sf):
    t = scaled(spark, sf).filter("track = 'ALL'").select("date", "ret")
    f = tb.orders_monthly(spark, sf).withColumnRenamed("month_end", "date")
    d = base.daily(spark, sf).groupBy("date").agg(F.stddev_samp("carry").alias("value"))
    return md.state_features(t, f, d, ["N01", "N02"])


@query("g12_state_features", "WITH " + _G12[2:] + " SELECT * FROM sf", use="bt om dp", floats=" ".join([*_FEATS, "target_next_positive", "next_return"]))
def _(spark, sf):
    return features(spark, sf)


@query("g13_expanding_logistic")
def _(spark, sf):
    out = md.expanding_logistic(features(spark, sf), _FEATS, "target_next_positive", 36)
    out = out.select("month_end", "probability", *[f"coef_{f}" for f in _FEATS])
    return out.withColumns({c: F.round(c, 6) for c, t in out.dtypes if t == "double"})


@query("g13_fits", "WITH " + _G12[2:] + f""", tq AS (SELECT month_end, row_number() OVER (ORDER BY month_end)-1 AS i, count(target_next_positive) OVER b AS n_train, 0.0::DOUBLE AS residual, min(target_next_positive) OVER b AS lo, max(target_next_positive) OVER b AS hi, {', '.join(f'median({f}) OVER b AS med_{f}' for f in _FEATS)} FROM sf WINDOW b AS (ORDER BY month_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT * EXCLUDE (i, lo, hi) FROM tq WHERE i>=36 AND lo<hi""", use="bt om dp", floats=" ".join(["residual", *[f"med_{f}" for f in _FEATS]]))
def _(spark, sf):
    """Which months are fitted, on how many rows and medians, and that every fit is stationary."""
    out = md.expanding_logistic(features(spark, sf), _FEATS, "target_next_positive", 36)
    return out.select("month_end", "n_train", "residual", *[f"med_{f}" for f in _FEATS])
