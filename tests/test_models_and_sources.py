import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import attribution as at
from panelspark.operators import model as md
from panelspark.operators import performance as pf
from panelspark.operators import regress as rg
from panelspark.sources import quotes as sq


def brute_nw(y, x, lags):
    a = np.column_stack([np.ones(len(y)), x])
    b = np.linalg.lstsq(a, y, rcond=None)[0]
    g = a * (y - a @ b)[:, None]
    s = g.T @ g
    for k in range(1, lags + 1):
        c = g[k:].T @ g[:-k]
        s += (1 - k / (lags + 1)) * (c + c.T)
    inv = np.linalg.inv(a.T @ a)
    return b, b / np.sqrt(np.diag(inv @ s @ inv))


def sample(n=300, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) + np.array([5.0, 0.0, -2.0])
    return x, x @ np.array([0.5, -1.0, 0.2]) + 0.1 + rng.normal(size=n)


def test_newey_west_with_three_regressors(spark):
    x, y = sample()
    rows = [("k", i, float(y[i]), *map(float, x[i])) for i in range(len(y))] + [("flat", i, 1.0, 2.0, 2.0, 2.0) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, date int, y double, a double, b double, c double")
    out = rg.newey_west(df, ["key"], "y", ["a", "b", "c"], 4, 100, periods=1).toPandas()
    b, t = brute_nw(y, x, 4)
    out = out.set_index("key")
    assert sorted(out.index) == ["flat", "k"]  # a singular design keeps its key: the smallest slopes that fit, no t-statistics
    flat, r = out.loc["flat"], out.loc["k"]
    assert flat["alpha_ann"] == 1 and flat["beta_a"] == 0 and np.isnan(flat["t_a"])
    assert np.allclose([r["alpha_ann"], r["beta_a"], r["beta_b"], r["beta_c"]], b) and np.allclose([r["alpha_t"], r["t_a"], r["t_b"], r["t_c"]], t)


def test_pooled_blocks_give_the_single_series_result(spark):
    x, y = sample(240, 5)
    rows = [(f"a{i // 30}", i % 30, float(y[i]), float(x[i, 0])) for i in range(240)]
    df = spark.createDataFrame(rows, "asset string, month_end int, y double, x double")
    b, t = brute_nw(y, x[:, :1], 3)
    for size in (7, 50, 1000):
        r = rg.pooled_newey_west(df, "y", ["x"], 3, rows=size, periods=1).toPandas().iloc[0]
        assert r["n"] == 240 and np.allclose([r["alpha_ann"], r["beta_x"], r["alpha_t"], r["t_x"]], [*b, *t])


def test_pooled_ols_matches_least_squares(spark):
    x, y = sample(120, 7)
    df = spark.createDataFrame([("s", float(y[i]), *map(float, x[i])) for i in range(120)], "sample string, y double, a double, b double, c double")
    out = rg.ols(df, ["sample"], "y", ["a", "b", "c"]).toPandas().set_index("variable")
    m = np.column_stack([np.ones(120), x])
    b = np.linalg.lstsq(m, y, rcond=None)[0]
    e = y - m @ b
    se = np.sqrt(np.diag(np.linalg.inv(m.T @ m)) * (e @ e) / 116)
    assert np.allclose(out.loc[["const", "a", "b", "c"], "coefficient"], b) and np.allclose(out.loc[["const", "a", "b", "c"], "t_stat"], b / se)


def test_components_match_an_svd(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 5)) @ rng.normal(size=(5, 5))
    days = pd.bdate_range("2024-01-01", periods=80)
    rows = [(d.date(), f"a{j}", float(x[i, j])) for i, d in enumerate(days) for j in range(5)]
    r = rg.principal_components(spark.createDataFrame(rows, "date date, asset string, v double"), "v", 3)
    c = x - x.mean(axis=0)
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    ev = r["explained"].toPandas()["explained_variance"]
    assert np.allclose(ev, s**2 / (s**2).sum())
    sc = r["scores"].orderBy("date").toPandas()
    for i in range(3):
        v = sc[f"pc{i + 1}"].to_numpy()
        assert np.allclose(np.abs(v), np.abs(u[:, i] * s[i]), atol=1e-8)
        assert np.corrcoef(v, x.mean(axis=1))[0, 1] >= 0
    assert np.allclose(np.abs(r["loadings"].orderBy("asset").toPandas()["pc1"]), np.abs(vt[0]))


def test_components_of_a_wide_universe_need_several_rounds(spark):
    rng = np.random.default_rng(11)
    scale = np.r_[6.0, 5.0, 4.0, 3.5, np.linspace(2.0, 0.5, 36)]
    x = (rng.normal(size=(90, 40)) * scale) @ np.linalg.qr(rng.normal(size=(40, 40)))[0]
    days = pd.bdate_range("2024-01-01", periods=90)
    df = spark.createDataFrame([(d.date(), f"a{j:02d}", float(x[i, j])) for i, d in enumerate(days) for j in range(40)], "date date, asset string, v double")
    r = rg.principal_components(df, "v", 2, top=3, spare=2)
    c = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(r["explained"].toPandas()["explained_variance"], (s**2 / (s**2).sum())[:3], rtol=1e-9)
    assert (r["residual"].toPandas()["residual"] < 1e-6).all()
    got = r["loadings"].orderBy("asset").toPandas()[["pc1", "pc2"]].to_numpy().T
    assert np.allclose(got, vt[:2] * np.sign(vt[:2].sum(axis=1, keepdims=True)), atol=1e-5)


def test_logistic_fit_is_stationary_and_expanding_never_sees_the_future(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 2))
    y = (x[:, 0] + rng.normal(size=60) > 0).astype(float)
    b = md.fit_logistic(x, y)
    p = 1 / (1 + np.exp(-(b[0] + x @ b[1:])))
    assert np.allclose(np.column_stack([np.ones(60), x]).T @ (p - y) + np.r_[0, b[1:]], 0, atol=1e-8)
    months = pd.date_range("2019-01-31", periods=60, freq="ME")
    rows = [(m.date(), float(y[i]), float(x[i, 0]) if i % 9 else None, float(x[i, 1])) for i, m in enumerate(months)]
    df = spark.createDataFrame(rows, "month_end date, t double, f double, g double")
    full = md.expanding_logistic(df, ["f", "g"], "t", 30).orderBy("month_end").toPandas()
    early = md.expanding_logistic(df.filter("month_end <= '2022-06-30'"), ["f", "g"], "t", 30).orderBy("month_end").toPandas()
    assert len(full) == 30 and full["probability"].between(0, 1).all()
    assert np.allclose(full["probability"].head(len(early)), early["probability"])
    assert (full["residual"] < 1e-8).all() and full["n_train"].tolist() == list(range(30, 60))
    one = md.expanding_logistic(df, ["f", "g"], "t", 30, pieces=1).orderBy("month_end").toPandas()
    assert np.allclose(full["probability"], one["probability"], atol=1e-9)
    void = md.expanding_logistic(df.withColumn("h", F.lit(None).cast("double")), ["f", "g", "h"], "t", 30).orderBy("month_end").toPandas()
    assert np.allclose(full["probability"], void["probability"], atol=1e-9) and (void["coef_h"] == 0).all() and void["med_h"].isna().all()
    assert md.expanding_logistic(df.limit(0), ["f", "g"], "t", 30).count() == 0
    # one cut by hand
    xs = pd.DataFrame(x, columns=["f", "g"])
    xs.loc[xs.index % 9 == 0, "f"] = np.nan
    tr = xs.iloc[:30].fillna(xs.iloc[:30].median())
    z = (tr - tr.mean()) / tr.std(ddof=0)
    b = md.fit_logistic(z.to_numpy(), y[:30])
    te = (xs.iloc[[30]].fillna(xs.iloc[:30].median()) - tr.mean()) / tr.std(ddof=0)
    assert np.isclose(full["probability"][0], 1 / (1 + np.exp(-(b[0] + te.to_numpy() @ b[1:])))[0])


def test_contributions_add_up_to_the_book(spark):
    rng = np.random.default_rng(1)
    days = pd.bdate_range("2024-01-01", periods=50)
    rows = [(d.date(), a, float(rng.normal()), float(rng.normal()), float(rng.normal())) for d in days for a in "abc"]
    p = spark.createDataFrame(rows, "date date, asset string, weight double, xret double, sret double")
    c = at.contributions(p.select("date", "asset", "weight"), p)
    a = at.attribution(c).toPandas()
    assert np.isclose(a["share_of_pnl"].sum(), 1) and np.isclose(a["risk_share"].sum(), 1)
    assert np.allclose(a["contrib_ann"], a["carry_part_ann"] + a["spot_part_ann"])


def test_drawdown_with_and_without_initial_wealth(spark):
    t = spark.createDataFrame([("t", dt.date(2024, 1, i + 1), r) for i, r in enumerate((-0.5, 0.2, -0.1, -1.0))], "track string, date date, ret double")
    assert np.isclose(pf.max_drawdown(t.filter("ret > -1")).first()["max_drawdown"], -0.1)
    # wealth runs 0.5, 0.6, 0.54: from the initial 1 the deepest point is the first
    assert np.isclose(pf.max_drawdown(t.filter("ret > -1"), initial=True).first()["max_drawdown"], -0.5)
    s = pf.compounded_stats(t).first()
    assert s["annual_return"] is None and s["final_return"] == -1.0


def test_wide_file_written_by_pandas(spark, tmp_path):
    cols = pd.MultiIndex.from_product([["AAA Curncy", "VIX Index"], ["PX_LAST", "PX_BID"]], names=["ticker", "field"])
    w = pd.DataFrame(np.arange(8.0).reshape(2, 4), index=pd.to_datetime(["2024-01-01", "2024-01-02"]), columns=cols)
    w.iloc[1, 0] = np.nan
    flat = w.copy()
    flat.columns = [str(tuple(c)) for c in flat.columns]
    flat.index.name = "date"
    flat.reset_index().to_parquet(tmp_path / "g_wide.parquet")
    got = sq.load_wide(spark, str(tmp_path / "g_wide.parquet")).orderBy("date", "ticker").collect()
    assert [(r["ticker"], r["value"]) for r in got] == [("AAA", 0.0), ("VIX", 2.0), ("AAA", None), ("VIX", 6.0)]


def test_long_files_sinks_and_fallbacks(spark, tmp_path):
    rows = [(dt.date(2024, 1, 1), "A Curncy", "PX_LAST", 1.0), (dt.date(2024, 1, 2), "A Curncy", "PX_LAST", 2.0)]
    df = spark.createDataFrame(rows, "date date, ticker string, field string, value double")
    sq.write_table(df.select(F.col("date"), "ticker", "field", F.col("value").cast("string").alias("value")), str(tmp_path / "q.csv"), "csv")
    got, status = sq.read_long(spark, str(tmp_path / "q"))
    assert status == "csv" and sorted(map(tuple, got.collect())) == rows
    sq.write_table(df, str(tmp_path / "q.parquet"))
    assert sq.read_long(spark, str(tmp_path / "q"))[1] == "parquet"
    assert sq.read_long(spark, str(tmp_path / "none"))[1] == "missing file"
    assert sq.safe_read(spark, str(tmp_path / "none.parquet"))[0].count() == 0
    sq.save_group(df, str(tmp_path / "out"), "g", ["A Curncy__PX_LAST"])
    assert spark.read.parquet(str(tmp_path / "out" / "long")).filter("group = 'g'").count() == 2
    assert spark.read.parquet(str(tmp_path / "out" / "wide" / "g")).columns == ["date", "A Curncy__PX_LAST"]
    with pytest.raises(ValueError):
        sq.strict_long(df.drop("field"))
    with pytest.raises(ValueError):
        sq.require_fields(df.withColumn("field", F.lit("OTHER")))


def test_user_ticker_list(spark, tmp_path):
    (tmp_path / "t.csv").write_text("ticker\n B \nA\n\nB\n")
    got = [r["item"] for r in sq.read_ticker_csv(spark, str(tmp_path / "t.csv")).orderBy("pos").collect()]
    assert got == ["B", "A"]


def test_months_are_counted_without_a_list_of_pairs(spark, capsys):
    from panelspark.operators import quality as ql

    ends = [(pd.Timestamp("1966-01-31") + pd.offsets.MonthEnd(k)).date() for k in range(200)]
    rows = [(a, ends[k], 1.0) for a in range(6) for k in range(a, 200, a + 1) for _ in range(1 + k % 2)] + [(9, ends[5], None), (1, ends[0], None)]
    panel = spark.createDataFrame(rows, "asset long, month_end date, mid double")
    out = ql.asset_month_coverage(panel, "mid")
    got = {r.asset: (r.first_month, r.last_month, r.months, r.missing_months, r.stale_end) for r in out.collect()}
    exp = {}
    for a in range(6):
        own = list(range(a, 200, a + 1))
        exp[a] = (ends[own[0]], ends[own[-1]], len(own), own[-1] - own[0] + 1 - len(own), own[-1] < 197)
    assert got == exp
    out.explain()
    assert "distinct" not in capsys.readouterr().out
