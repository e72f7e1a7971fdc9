"""Scenario fan-outs, stresses and checks (Z), and the comparison table (M19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import book as bk
from panelspark.operators import holdings
from panelspark.operators import jackknife as jk
from panelspark.operators import costs as cs
from panelspark.operators import cross_section as xs
from panelspark.operators import performance as pf
from panelspark.operators import regress as rg
from panelspark.operators import scenario as sc
from panelspark.operators import sweep as sw
from panelspark.operators import trailing as tr
from panelspark.queries import base, booksql as bs
from panelspark.queries.cross_section import WIDE_SPLITS
from panelspark.queries.registry import query
from panelspark.queries.regression import nw1
from panelspark.session import cut_lineage
from panelspark.sources import tables as tb

_SH = "avg({c})*sqrt(252.0)/stddev_samp({c})"


def trk(p: str, w: str, out: str, key: str = "") -> str:
    """gross, cost and net of weights ``w``."""
    k, wk = (f"{key},", f"a.{key},") if key else ("", "")
    on = f" AND c.{key}=a.{key}" if key else ""
    return bs.returns(p, w, f"{out}g", key) + bs.costs(p, w, f"{out}k", key) + f", {out} AS (SELECT {wk} a.date, a.ret AS gross, c.cost, a.ret-c.cost AS net FROM {out}g a LEFT JOIN {out}k c ON c.date=a.date{on})"


BOOK = bs.book("b") + bs.HS + trk("b", "bvt", "t")


def staged_book(spark, sf):
    p, reb, by_date, unit = base.target_book(spark, sf)
    names = holdings.held(reb)
    return p, names, by_date, cut_lineage(holdings.tracks(names, by_date, unit, base.spreads(p)))


@query("z1_book_builder", "WITH " + BOOK[2:] + " SELECT date, gross, cost, net FROM t", use="dp dense", floats="gross cost net")
def _(spark, sf):
    return staged_book(spark, sf)[3]


_LOO = """, lo AS (SELECT s.scenario, dp.* FROM dp JOIN (SELECT 'base' AS scenario, '' AS x UNION ALL SELECT DISTINCT 'ex_'||asset, asset FROM dp) s ON s.x<>dp.asset)""" + bs.book("b", "scenario", "lo") + bs.HS + trk("b", "bvt", "t", "scenario") + f""", sh AS (SELECT scenario, {_SH.format(c='gross')} AS gross_sharpe, {_SH.format(c='net')} AS net_sharpe, count(net) AS n_days FROM t GROUP BY 1)"""


def jackknife(spark, sf):
    p = base.staged_daily(spark, sf)
    tab = cut_lineage(bk.rebalance_table(p, "carry"))
    spreads = cut_lineage(base.spreads(p))
    absent = tab.select("asset").distinct().select(F.concat(F.lit("ex_"), "asset").alias("scenario"), "asset")
    *_, t = sc.run_books(sc.leave_one_out(tab), p, spreads, base.LEG_SIZE, absent=absent)
    return p, tab, spreads, cut_lineage(sc.against_base(cut_lineage(sc.ratio_table(t))))


@query("z2_jackknife", "WITH " + _LOO[2:] + " SELECT *, net_sharpe-(SELECT net_sharpe FROM sh WHERE scenario='base') AS delta FROM sh", use="dp dense", floats="gross_sharpe net_sharpe delta", digits=6)
def _(spark, sf):
    return jackknife(spark, sf)[3]


_WIDE = """, lv AS (SELECT month_end, asset, signal AS s, ret AS r FROM wp WHERE signal IS NOT NULL AND ret IS NOT NULL),
 hi AS (SELECT month_end, count(*) AS n, list({'a': asset, 'r': r} ORDER BY s DESC, asset) AS h, list({'a': asset, 'r': r} ORDER BY s, asset) AS l FROM lv GROUP BY 1),
 bs AS (SELECT month_end, CASE WHEN n//5>=2 THEN list_avg(list_transform(h[1:n//5], lambda e: e.r))-list_avg(list_transform(l[1:n//5], lambda e: e.r)) END AS b FROM hi),
 cut AS (SELECT month_end, (n-1)//5 AS k, h[1:(n-1)//5+1] AS h, l[1:(n-1)//5+1] AS l FROM hi),
 wo AS (SELECT lv.asset, lv.month_end, CASE WHEN k>=2 THEN list_avg(list_transform(list_filter(h, lambda e: e.a<>lv.asset)[1:k], lambda e: e.r))-list_avg(list_transform(list_filter(l, lambda e: e.a<>lv.asset)[1:k], lambda e: e.r)) END AS x FROM lv JOIN cut ON cut.month_end=lv.month_end),
 tr AS (SELECT a.asset, CASE WHEN lv.asset IS NULL THEN bs.b ELSE wo.x END AS x FROM (SELECT DISTINCT asset FROM lv) a CROSS JOIN bs LEFT JOIN lv ON lv.asset=a.asset AND lv.month_end=bs.month_end LEFT JOIN wo ON wo.asset=a.asset AND wo.month_end=bs.month_end)"""


@query("z2_jackknife_wide", "WITH " + _WIDE[2:] + " SELECT asset, avg(x)*sqrt(12.0)/stddev_samp(x) AS sharpe, avg(x)*sqrt(12.0)/stddev_samp(x)-(SELECT avg(b)*sqrt(12.0)/stddev_samp(b) FROM bs) AS delta, count(x) AS n FROM tr GROUP BY 1", use="wp", floats="sharpe delta", digits=6)
def _(spark, sf):
    """Every part of the growing universe left out once; rows stay linear in the parts."""
    return jk.leave_one_out_ratios(tb.wide_monthly_panel(spark, sf), splits=WIDE_SPLITS)


_DROP = _LOO + """, rk AS (SELECT asset, row_number() OVER (ORDER BY d, asset) AS rank FROM (SELECT substr(scenario,4) AS asset, net_sharpe-(SELECT net_sharpe FROM sh WHERE scenario='base') AS d FROM sh WHERE scenario<>'base')),
 dk AS (SELECT 'drop_'||CAST(k AS VARCHAR) AS scenario, dp.* FROM dp JOIN rk ON rk.asset=dp.asset JOIN (SELECT unnest([0,1,2,3,4,5]) AS k) ks ON rk.rank>ks.k)""" + bs.book("d", "scenario", "dk") + trk("d", "dvt", "u", "scenario")


@query("z3_concentration", "WITH " + _DROP[2:] + f""" SELECT scenario, {_SH.format(c='gross')} AS gross_sharpe, {_SH.format(c='net')} AS net_sharpe, count(net) AS n_days FROM u GROUP BY 1""", use="dp dense", floats="gross_sharpe net_sharpe", digits=6)
def _(spark, sf):
    p, tab, spreads, j = jackknife(spark, sf)
    d = j.filter("scenario <> 'base'").select(F.lit(0).alias("_g"), F.substring("scenario", 4, 9).alias("asset"), "delta")
    order = xs.cross_rank(d, ["_g"], "delta", name="rank").drop("_g")
    order = cut_lineage(order.select("asset", "rank"))
    absent = sc.fan_out(order, [f"drop_{k}" for k in range(6)]).filter(F.col("rank") <= F.substring("scenario", 6, 9).cast("int")).select("scenario", "asset")
    *_, t = sc.run_books(sc.drop_top(tab, order), p, spreads, base.LEG_SIZE, absent=absent)
    return sc.ratio_table(t)


def _sweep_sql(p, name, **kw):
    return bs.book(p, **kw) + trk(p, f"{p}vt", f"{p}z"), f"SELECT '{name}' AS setting, {_SH.format(c='gross')} AS gross_sharpe, {_SH.format(c='net')} AS net_sharpe, count(net) AS n_days, (SELECT min(dd) FROM (SELECT w/max(w) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)-1 AS dd FROM (SELECT date, product(1+net) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS w FROM {p}z WHERE net IS NOT NULL))) AS net_maxdd FROM {p}z"


_GRID = [("vol_window=40,freq=M", dict(vw=40, freq="M")), ("vol_window=40,freq=Q", dict(vw=40, freq="Q")), ("vol_window=60,freq=M", dict(vw=60, freq="M")), ("vol_window=60,freq=2W", dict(vw=60, freq="2W")),
         ("n_buckets=4", dict(n=4)), ("target=0.06", dict(tgt=0.06)), ("cap=0.25", dict(cap=0.25)), ("weighting=equal", dict(raw="1.0::DOUBLE"))]
_GSQL = [_sweep_sql(f"g{i}", n, **kw) for i, (n, kw) in enumerate(_GRID)]


@query("z4_parameter_sweep", "WITH " + bs.HS[2:] + "".join(c for c, _ in _GSQL) + " " + " UNION ALL ".join(s for _, s in _GSQL), use="dp dense", floats="gross_sharpe net_sharpe net_maxdd", digits=6)
def _(spark, sf):
    names = {"vw": "vol_window", "freq": "freq", "n": "n_buckets", "tgt": "target", "cap": "cap"}
    points = [sw.named(n_buckets=base.BUCKETS) | {names[k]: v for k, v in kw.items() if k in names} | {"setting": n, "weighting": "equal" if "raw" in kw else "inv_vol"} for n, kw in _GRID]
    p = base.staged_daily(spark, sf)
    t = cut_lineage(sw.sweep_tracks(p, points, cut_lineage(base.spreads(p))))
    dd = pf.max_drawdown(t, ["setting"], ret="net").withColumnRenamed("max_drawdown", "net_maxdd")
    return sc.ratio_table(t, ["setting"]).join(dd, "setting")


def _points_sql(points):
    """Tracks of all settings and their ratios over the base setting's live span."""
    key = {"vol_window": "vw", "target": "tgt", "freq": "freq", "n_buckets": "n", "cap": "cap"}
    books = [bs.book(f"g{i}", **{key[k]: v for k, v in p.items() if k in key}) + trk(f"g{i}", f"g{i}vt", f"g{i}z") for i, p in enumerate(points)]
    both = " UNION ALL ".join(f"SELECT '{p['setting']}' AS setting, * FROM g{i}z" for i, p in enumerate(points))
    return "WITH " + bs.HS[2:] + "".join(books) + f""", az AS ({both}), sp AS (SELECT min(date) AS a, max(date) AS b FROM az WHERE setting='base' AND net IS NOT NULL), wz AS (SELECT az.* FROM az, sp WHERE date BETWEEN a AND b),
 dz AS (SELECT setting, min(dd) AS net_maxdd FROM (SELECT setting, w/max(w) OVER (PARTITION BY setting ORDER BY date ROWS UNBOUNDED PRECEDING)-1 AS dd FROM (SELECT setting, date, product(1+net) OVER (PARTITION BY setting ORDER BY date ROWS UNBOUNDED PRECEDING) AS w FROM wz WHERE net IS NOT NULL)) GROUP BY 1)
 SELECT wz.setting, {_SH.format(c='gross')} AS gross_sharpe, {_SH.format(c='net')} AS net_sharpe, count(net) AS n_days, avg(net)*252 AS net_return, max(net_maxdd) AS net_maxdd FROM wz LEFT JOIN dz ON dz.setting=wz.setting GROUP BY 1"""


_ONE = sw.one_at_a_time(n_buckets=base.BUCKETS)
_TWO = sw.one_at_a_time(n_buckets=base.BUCKETS)[:1] + sw.grid(n_buckets=base.BUCKETS)
_RATIOS = "gross_sharpe net_sharpe net_return net_maxdd"


def swept(spark, sf, points):
    p = base.staged_daily(spark, sf)
    return sw.window_ratios(cut_lineage(sw.sweep_tracks(p, points, cut_lineage(base.spreads(p)))))


@query("z4_published_sweep", _points_sql(_ONE), use="dp dense", floats=_RATIOS, digits=6)
def _(spark, sf):
    return swept(spark, sf, _ONE)


@query("z4_window_frequency_grid", _points_sql(_TWO), use="dp dense", floats=_RATIOS, digits=6)
def _(spark, sf):
    return swept(spark, sf, _TWO)


_STRESS = f""", st AS (SELECT multiple, {_SH.format(c='(gross-cost*multiple)')} AS net_sharpe, avg(CASE WHEN gross IS NOT NULL THEN cost*multiple END)*252 AS annual_drag FROM t CROSS JOIN (SELECT unnest([1.0::DOUBLE,1.5::DOUBLE,2.0::DOUBLE,3.0::DOUBLE,5.0::DOUBLE]) AS multiple) GROUP BY 1)"""


@query("z5_cost_stress", "WITH " + (BOOK + _STRESS)[2:] + " SELECT * FROM st", use="dp dense", floats="multiple net_sharpe annual_drag", digits=6)
def _(spark, sf):
    return sc.cost_stress(staged_book(spark, sf)[3])


@query("z5_break_even", "WITH " + (BOOK + _STRESS)[2:] + " SELECT min(multiple) FILTER (WHERE net_sharpe<=0) AS break_even, max(multiple) AS largest_tested FROM st", use="dp dense", floats="break_even largest_tested")
def _(spark, sf):
    return sc.break_even(sc.cost_stress(staged_book(spark, sf)[3]))


_LAG = BOOK + """, cx AS (SELECT date, row_number() OVER (ORDER BY date) AS t FROM (SELECT DISTINCT date FROM bvt)), dl AS (SELECT CAST(k AS VARCHAR) AS scenario, c2.date, w.asset, w.weight FROM bvt w JOIN cx c1 ON c1.date=w.date CROSS JOIN (SELECT unnest([0,1,2,3,5]) AS k) JOIN cx c2 ON c2.t=c1.t+k)""" + trk("e", "dl", "v", "scenario")


@query("z6_lag_stress", "WITH " + _LAG[2:] + f" SELECT scenario, {_SH.format(c='gross')} AS gross_sharpe, {_SH.format(c='net')} AS net_sharpe, count(net) AS n_days FROM v WHERE date BETWEEN (SELECT min(date) FROM v WHERE scenario='0' AND net IS NOT NULL) AND (SELECT max(date) FROM v WHERE scenario='0' AND net IS NOT NULL) GROUP BY 1", use="dp dense", floats="gross_sharpe net_sharpe", digits=6)
def _(spark, sf):
    p, reb, by_date, _ = base.target_book(spark, sf)
    t = cut_lineage(holdings.delayed_tracks(holdings.held(reb), by_date, p, base.spreads(p)))
    return sc.ratio_table(sc.common_window(t, t.filter("scenario = '0'")))


@query("z7_scorecard", "WITH " + (BOOK + _STRESS)[2:] + f""" SELECT 'net sharpe' AS axis, {_SH.format(c='net')} AS value FROM t UNION ALL SELECT 'recent net sharpe', {_SH.format(c='net')} FROM t WHERE date>=DATE '1999-01-01' UNION ALL SELECT 'break-even multiple', min(multiple) FILTER (WHERE net_sharpe<=0) FROM st
 UNION ALL SELECT 'max drawdown', min(dd) FROM (SELECT w/max(w) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)-1 AS dd FROM (SELECT date, product(1+net) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS w FROM t WHERE net IS NOT NULL))""", use="dp dense", floats="value", digits=6)
def _(spark, sf):
    t = staged_book(spark, sf)[3]
    one = lambda axis, df, c: df.select(F.lit(axis).alias("axis"), F.col(c).alias("value"))
    parts = [one("net sharpe", t.agg(pf.annual_ratio("net").alias("v")), "v"), one("recent net sharpe", t.filter("date >= '1999-01-01'").agg(pf.annual_ratio("net").alias("v")), "v"),
             one("break-even multiple", sc.break_even(sc.cost_stress(t)), "break_even"), one("max drawdown", pf.max_drawdown(t.withColumn("track", F.lit("book")), ret="net"), "max_drawdown")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("z8_reconciliation", "WITH " + BOOK[2:] + " SELECT date, gross AS a, gross+0.01 AS b, 0.01::DOUBLE AS abs_diff FROM t WHERE date>=DATE '2001-06-01' AND gross IS NOT NULL", use="dp dense", floats="a b abs_diff", digits=7)
def _(spark, sf):
    """Rows planted to differ are found; equal rows are not."""
    t = staged_book(spark, sf)[3].select("date", "gross")
    moved = t.withColumn("gross", F.when(F.col("date") >= "2001-06-01", F.col("gross") + 0.01).otherwise(F.col("gross")))
    r = sc.reconcile(t, moved, ["date"], "gross", 1e-9)
    return r.select("date", F.col("_a").alias("a"), F.col("_b").alias("b"), "abs_diff")


@query("z9_look_ahead_check", """SELECT 'clean' AS signal, 0::BIGINT AS n_rows UNION ALL SELECT 'leaky', count(*) FROM (SELECT date FROM dense WHERE mid IS NOT NULL AND date<=DATE '1998-06-30' QUALIFY lead(mid) OVER (PARTITION BY asset ORDER BY date) IS NULL)""", use="dense")
def _(spark, sf):
    """A trailing signal passes (0 rows differ); a signal that peeks at the next quote is caught."""
    from pyspark.sql import Window
    q = cut_lineage(tb.quotes_daily(spark, sf).select("date", "asset", "mid"))
    w = Window.partitionBy("asset").orderBy("date")
    clean = sc.look_ahead(lambda d: tr.momentum(d, "mid", 20).select("date", "asset", "mom"), q, "1998-06-30")
    peek = sc.look_ahead(lambda d: d.select("date", "asset", F.lead("mid").over(w).alias("peek")).filter("peek is null"), q, "1998-06-30")
    one = lambda n, df: df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("signal", F.lit(n))
    return one("clean", clean).unionByName(one("leaky", peek))


_M19 = BOOK + bs.legs("e") + bs.weights("e", raw="1.0::DOUBLE") + bs.daily("e") + bs.target("e") + trk("e", "evt", "u") + """, al AS (SELECT 'inv_vol' AS scenario, * FROM t UNION ALL SELECT 'equal', * FROM u), wl AS (SELECT 'inv_vol' AS scenario, * FROM bvt UNION ALL SELECT 'equal', * FROM evt),
 pt AS (SELECT scenario, last_day(date) AS label, sum(abs(d))/2 AS o, sum(abs(weight)) AS g FROM (SELECT scenario, date, coalesce(weight,0) AS weight, coalesce(weight,0)-coalesce(lag(coalesce(weight,0)) OVER (PARTITION BY scenario, asset ORDER BY date),0) AS d FROM wl) GROUP BY 1,2),
 tn AS (SELECT scenario, avg(o) AS turnover FROM pt p WHERE label>=(SELECT min(label) FROM pt q WHERE q.scenario=p.scenario AND g>0) GROUP BY 1), a0 AS (SELECT al.scenario, al.date, al.net AS y, t.net AS x FROM al JOIN t ON t.date=al.date WHERE al.scenario<>'inv_vol')"""


@query("m19_comparison_table", "WITH " + _M19[2:] + nw1("a0", "scenario", "date", 5, 100, 252) + f""" SELECT al.scenario, {_SH.format(c='net')} AS net_sharpe, avg(net)*252 AS ann_return, max(turnover) AS turnover, avg(cost)*252 AS annual_drag, max(alpha_ann) AS alpha_ann, max(alpha_t) AS alpha_t FROM al JOIN tn ON tn.scenario=al.scenario LEFT JOIN q ON q.scenario=al.scenario GROUP BY 1""",
       use="dp dense", floats="net_sharpe ann_return turnover annual_drag alpha_ann alpha_t", digits=6)
def _(spark, sf):
    p = base.staged_daily(spark, sf)
    tab = cut_lineage(bk.rebalance_table(p, "carry"))
    spreads = cut_lineage(base.spreads(p))
    w = None
    for name in ("inv_vol", "equal"):
        one = bk.vol_target(cut_lineage(bk.apply_daily(bk.book_from_table(tab, leg_size=base.LEG_SIZE, weighting=name), p)), p).withColumn("scenario", F.lit(name))
        w = one if w is None else w.unionByName(one)
    w = cut_lineage(w)
    t = cut_lineage(sc.tracks_of(w, p, spreads))
    base_net = t.filter("scenario = 'inv_vol'").select("date", F.col("net").alias("x"))
    alpha = rg.newey_west(t.filter("scenario <> 'inv_vol'").join(base_net, "date").withColumnRenamed("net", "y"), ["scenario"], "y", ["x"], 5, 100).select("scenario", "alpha_ann", "alpha_t")
    s = t.groupBy("scenario").agg(pf.annual_ratio("net").alias("net_sharpe"), (F.avg("net") * 252).alias("ann_return"))
    turn = cs.period_turnover(w, ["scenario"]).select("scenario", "turnover")
    return s.join(turn, "scenario").join(cs.cost_drag(t, ["scenario"]), "scenario").join(alpha, "scenario", "left")
