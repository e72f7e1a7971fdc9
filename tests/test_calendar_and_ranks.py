import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hypothesis import given, settings
from hypothesis import strategies as st

from panelspark.functions import calendar as cal
from panelspark.functions.orderstat import WaveletMatrix
from panelspark.functions.ranking import cross_quantile, cross_rank
from panelspark.operators import cross_section as xs
from panelspark.operators import trailing as tr
from panelspark.operators.book import apply_daily


def gappy(seed=3, days=160, assets=("a", "b", "c", "d"), fill=0.7):
    rng = np.random.default_rng(seed)
    dates = pd.bdate_range("2024-01-01", periods=days)
    rows = [(d.date(), a, float(rng.normal())) for d in dates for a in assets if rng.random() < fill]
    return pd.DataFrame(rows, columns=["date", "asset", "v"])


def wide(pdf):
    return pdf.pivot(index="date", columns="asset", values="v").sort_index()


@pytest.mark.parametrize("keys", [["book"], []])
@pytest.mark.parametrize("full", [True, False])
def test_books_fill_their_own_calendar(spark, keys, full):
    rng = np.random.default_rng(11)
    months = [d.date() for d in pd.date_range("2023-01-31", periods=9, freq="ME")]
    rows = [("big", a, m, 1.0, "x") for a in "abcdefgh" for m in months if rng.random() < 0.5] + [("small", "a", months[2], 2.0, None), ("small", "z", months[7], 3.0, "y")]
    if not keys:
        rows = [r for r in rows if r[0] == "big"]
    df = spark.createDataFrame([*rows, ("big", "a", None, 9.0, "x")], "book string, asset string, month_end date, weight double, basket string")
    got = {(r.book if keys else "big", r.asset, r.month_end): (r.weight, r.basket) for r in cal.densify_books(df if keys else df.drop("book"), keys, full=full).collect()}
    held = {r[:3]: r[3:] for r in rows}
    exp = {}
    for book in {r[0] for r in rows}:
        own = sorted({r[2] for r in rows if r[0] == book})
        for asset in {r[1] for r in rows if r[0] == book}:
            first = min(r[2] for r in rows if r[:2] == (book, asset))
            exp |= {(book, asset, m): held.get((book, asset, m), (None, None)) for m in own if full or m >= first}
    assert got == exp
    assert cal.densify_books(df.limit(0), ["book"], full=full).count() == 0


def test_densify_has_every_date_of_every_asset(spark):
    pdf = gappy()
    out = cal.densify(spark.createDataFrame(pdf)).toPandas()
    assert len(out) == pdf["date"].nunique() * pdf["asset"].nunique()
    assert out["v"].notna().sum() == len(pdf)


def test_trailing_moments_match_pandas(spark):
    pdf = gappy()
    p = cal.densify(spark.createDataFrame(pdf))
    p = tr.trailing_vol(p, "v", 20, 8, out="sd")
    p = tr.trailing_skew(p, "v", 30, 10, out="sk")
    p = tr.momentum(p, "v", 15, skip=2, out="mom")
    p = tr.trailing_rank(p, "v", 25, 5, out="pct")
    got = p.toPandas()
    w = wide(pdf)
    for col, exp in (("sd", w.rolling(20, min_periods=8).std()), ("sk", w.rolling(30, min_periods=10).skew()),
                     ("mom", w.rolling(15, min_periods=7).sum().shift(2)), ("pct", w.rolling(25, min_periods=5).rank(pct=True))):
        have = got.pivot(index="date", columns="asset", values=col).sort_index()
        pd.testing.assert_frame_equal(have.astype(float), exp, check_names=False, rtol=1e-8, atol=1e-10)


def test_constant_series_has_zero_vol_and_no_zscore(spark):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), "a", 7.3) for i in range(40)]
    p = spark.createDataFrame(rows, "date date, asset string, v double")
    out = tr.trailing_zscore(tr.trailing_vol(p, "v", 10), "v", 10).orderBy("date").collect()
    assert out[-1]["vol"] == 0.0 and out[-1]["z"] is None


def test_month_end_label_is_effective_two_trading_days_later(spark):
    days = [dt.date(2024, 8, 29), dt.date(2024, 8, 30), dt.date(2024, 9, 2), dt.date(2024, 9, 3), dt.date(2024, 9, 4)]
    dates = spark.createDataFrame([(d,) for d in days], "date date")
    reb = spark.createDataFrame([(dt.date(2024, 8, 31), "a", 0.5)], "label date, asset string, weight double")
    out = {r["date"]: r["weight"] for r in apply_daily(reb, dates).collect()}
    assert out == {days[3]: 0.5, days[4]: 0.5}


def test_asof_copies_nulls_of_the_latest_row_and_fill_skips_them(spark):
    spine = spark.createDataFrame([("a", dt.date(2024, 1, d)) for d in (1, 2, 3)], "asset string, date date")
    ev = spark.createDataFrame([("a", dt.date(2024, 1, 1), 1.0), ("a", dt.date(2024, 1, 2), None)], "asset string, label date, v double")
    assert [r["v"] for r in cal.asof_fill(spine, ev, ["v"]).orderBy("date").collect()] == [1.0, None, None]
    vals = spark.createDataFrame([("a", dt.date(2024, 1, d), v) for d, v in ((1, 1.0), (2, None), (3, None), (4, None))], "asset string, date date, v double")
    assert [r["v"] for r in cal.forward_fill(vals, ["v"], limit=2).orderBy("date").collect()] == [1.0, 1.0, 1.0, None]


@pytest.mark.parametrize("freq,alias", [("W", "W"), ("2W", "2W"), ("Q", "QE"), ("Y", "YE")])
def test_period_labels_match_pandas(spark, freq, alias):
    dates = pd.date_range("2024-01-03", "2025-02-20", freq="B")
    s = pd.Series(np.arange(len(dates), dtype=float), index=dates)
    exp = s.resample(alias).last().dropna()
    df = spark.createDataFrame([(d.date(), "a", v) for d, v in s.items()], "date date, asset string, v double")
    anchor = cal.first_sunday(df) if freq == "2W" else None
    got = cal.resample_last(df, ["v"], freq=freq, label="label", anchor=anchor).orderBy("label").toPandas()
    assert [pd.Timestamp(x) for x in got["label"]] == list(exp.index) and list(got["v"]) == list(exp)


@pytest.mark.parametrize("ascending", [True, False])
def test_split_rank_equals_plain_rank_with_hot_ties_and_nulls(spark, ascending):
    rng = np.random.default_rng(5)
    n = 3000
    v = np.where(rng.random(n) < 0.4, 0.0, np.round(rng.standard_cauchy(n), 2))
    rows = [(int(i % 2), f"n{i:05d}", None if rng.random() < 0.1 else float(v[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "g int, asset string, v double")
    a = cross_rank(df, ["g"], "v", ascending=ascending, count="n").toPandas()
    b = cross_rank(df, ["g"], "v", ascending=ascending, count="n", splits=7, per_cell=4).toPandas()
    key = ["g", "asset"]
    pd.testing.assert_frame_equal(a.sort_values(key).reset_index(drop=True)[[*key, "rn", "n"]].astype({"rn": float}),
                                  b.sort_values(key).reset_index(drop=True)[[*key, "rn", "n"]].astype({"rn": float}), check_dtype=False)


def test_split_quantile_equals_numpy(spark):
    rng = np.random.default_rng(6)
    rows = [(g, f"n{i}", float(x)) for g in (0, 1) for i, x in enumerate(rng.normal(size=401 + g))]
    df = spark.createDataFrame(rows, "g int, asset string, v double")
    out = cross_quantile(df, ["g"], "v", {"q20": 0.2, "q50": 0.5, "top": 1.0}, splits=5).toPandas().set_index("g")
    for g in (0, 1):
        x = np.array([r[2] for r in rows if r[0] == g])
        assert np.allclose(out.loc[g, ["q20", "q50", "top"]].astype(float), np.quantile(x, [0.2, 0.5, 1.0]))


def test_buckets_match_pandas(spark):
    rng = np.random.default_rng(7)
    rows = [(g, f"n{i:02d}", float(x)) for g, n in enumerate((4, 5, 11, 23, 37)) for i, x in enumerate(np.round(rng.normal(size=n), 1))]
    df = spark.createDataFrame(rows, "g int, asset string, v double")
    got = xs.quantile_buckets(xs.rank_buckets(df, ["g"], "v", 6), ["g"], "v").toPandas().sort_values(["g", "asset"])
    for g, sub in got.groupby("g"):
        r = sub["v"].rank(method="first")
        assert list(np.ceil(r / len(sub) * 6).clip(1, 6)) == list(sub["bucket_no"])
        if len(sub) >= 5:
            assert list(pd.qcut(r, 5, labels=False) + 1) == list(sub["q"])
        else:
            assert sub["q"].isna().all()


def test_adaptive_leg_size(spark):
    got = spark.range(0, 31).select("id", xs.adaptive_leg_size(F.col("id")).alias("k")).collect()
    exp = lambda n: 0 if n < 2 else (min(max(int(np.ceil(0.2 * n)), 3), n // 2) if n >= 6 else max(1, n // 3))
    assert {r["id"]: r["k"] for r in got} == {n: exp(n) for n in range(31)}


def test_pair_correlations_match_pandas_for_any_tiling(spark):
    pdf = gappy(seed=9, assets=tuple("abcdefg"))
    exp = wide(pdf).corr()
    df = spark.createDataFrame(pdf)
    for tiles in (1, 3):
        got = tr.pair_moments(df, "v", tiles=tiles, block_days=40).toPandas()
        assert len(got) == 21
        assert np.allclose(got["corr"], [exp.loc[i, j] for i, j in zip(got["asset_i"], got["asset_j"])])


def test_rolling_pair_correlation_matches_a_loop(spark):
    pdf = gappy(seed=11, days=90)
    w = wide(pdf)
    exp = {}
    for end in range(30, len(w) + 1):
        s = w.iloc[end - 30:end].dropna(axis=1, thresh=20)
        if s.shape[1] >= 2:
            c = s.corr().to_numpy()
            exp[w.index[end - 1]] = np.nanmean(c[np.triu_indices(len(c), 1)])
    for tiles in (1, 2):
        got = tr.pairwise_rolling_corr(spark.createDataFrame(pdf), "v", 30, 20, block=17, tiles=tiles).toPandas().set_index("date")["avg_corr"]
        assert set(got.index) == set(exp) and np.allclose([got[d] for d in exp], list(exp.values()))


def test_densify_can_start_at_the_first_quote_and_shares_its_shuffle(spark):
    rows = [("a", dt.date(2024, 1, 1), 1.0, "x"), ("a", dt.date(2024, 1, 3), 3.0, "x"), ("b", dt.date(2024, 1, 2), 2.0, "y")]
    df = spark.createDataFrame(rows, "asset string, date date, v double, bucket string")
    got = sorted(map(tuple, cal.densify(df, full=False, static=["bucket"]).select("asset", "date", "bucket", "v").collect()), key=str)
    d = [dt.date(2024, 1, i) for i in (1, 2, 3)]
    assert got == sorted([("a", d[0], "x", 1.0), ("a", d[1], "x", None), ("a", d[2], "x", 3.0), ("b", d[1], "y", 2.0), ("b", d[2], "y", None)], key=str)
    out = tr.trailing_vol(cal.densify(df), "v", 2)
    main = out._jdf.queryExecution().executedPlan().toString()
    assert main.count("Exchange hashpartitioning") == 1


def test_rolling_moments_ignore_what_left_the_window(spark):
    import numpy as np
    import pandas as pd

    from panelspark.functions import rolling as roll

    rng = np.random.default_rng(3)
    x = [*rng.normal(size=50), *(1e-7 * rng.normal(size=80)), *(5 + rng.normal(size=40))]
    rows = [(i, "a", None if i % 17 == 5 else float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "t int, k string, v double")
    for window in (1, 2, 12, 30):
        out = roll.rolling_moments(df, "v", window, ["k"], "t", third=True).select("t", roll.count().alias("n"), roll.mean().alias("mean"), roll.std().alias("std"), roll.skew().alias("skew"))
        got = out.toPandas().sort_values("t")
        r = pd.Series([v for _, _, v in rows], dtype=float).rolling(window, min_periods=1)
        assert (got["n"].to_numpy() == r.count().to_numpy()).all()
        for name, exp in (("mean", r.mean()), ("std", r.std()), ("skew", r.skew())):
            for i in range(len(x)):
                part = pd.Series([v for _, _, v in rows], dtype=float)[max(0, i - window + 1) : i + 1].dropna()
                e = ((part * 1e8).skew() if name == "skew" else getattr(part, name)()) if len(part) else np.nan
                g = got[name].iloc[i]
                if not np.isnan(e) and not (name == "skew" and len(part) < 3):
                    assert g is not None and np.isclose(float(g), e, rtol=1e-6, atol=1e-13), (name, window, i)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([0.0, -1.0, 2.5, 2.5, 7.0, 1e300, float("inf")]), min_size=1, max_size=60), st.data())
def test_order_statistics_of_any_range(x, data):
    x = np.array(x)
    m = WaveletMatrix(x)
    lo = data.draw(st.integers(0, len(x) - 1))
    hi = data.draw(st.integers(lo + 1, len(x)))
    k = data.draw(st.integers(0, hi - lo - 1))
    one = lambda *v: [np.array([i]) for i in v]
    own = data.draw(st.integers(0, len(x) - 1))
    less, same = m.below(*one(lo, hi, m.rank[own]))
    assert (less[0], same[0]) == ((x[lo:hi] < x[own]).sum(), (x[lo:hi] == x[own]).sum())
    assert m.smallest(*one(lo, hi, k))[0] == np.sort(x[lo:hi])[k]


def test_trailing_order_and_folds_match_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for s in range(5):  # many ties, gaps, zeros and losses of everything; series longer than an Arrow batch and than the window
        for t in range([1, 7, 50, 300, 40][s]):
            v = None if rng.random() < 0.2 else float(rng.choice([-1.0, 0.0, 0.5, 1.0, 2.0, 3.25]))
            rows.append((f"s{s}", t, v, "keep"))
    df = spark.createDataFrame(rows, "k string, t int, v double, other string").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        for w, mp in ((1, 1), (2, 1), (10, 5), (64, 20), (400, 1)):
            r = tr.trailing_quantile(tr.trailing_rank(df, "v", w, mp, "pct", ["k"], "t"), "v", 0.8, w, mp, "q", ["k"], "t")
            r = tr.trailing_product(tr.trailing_drawdown(r, "v", w, mp, "dd", ["k"], "t"), "v", w, "prod", ["k"], "t", mp)
            assert r.columns == ["k", "t", "v", "other", "pct", "q", "dd", "prod"]
            for s, g in r.toPandas().groupby("k"):
                g = g.sort_values("t")
                v = g["v"].to_numpy()
                for i, x in enumerate(g.itertuples()):
                    f = v[max(0, i - w + 1) : i + 1]
                    f = f[~np.isnan(f)]
                    full = len(f) >= mp
                    now = not np.isnan(v[i])
                    exp = ((f < v[i]).sum() + ((f == v[i]).sum() + 1) / 2) / len(f) if full and now else None
                    assert (np.isnan(x.pct) if exp is None else abs(x.pct - exp) < 1e-12) and (np.isnan(x.q) if not full else abs(x.q - np.quantile(f, 0.8)) < 1e-12)
                    assert np.isnan(x.prod) if not full else abs(x.prod - (np.prod(1 + f) - 1)) <= 1e-9 * np.prod(np.abs(1 + f))
                    assert np.isnan(x.dd) if not (full and now and f.max() != 0) else abs(x.dd - (v[i] / f.max() - 1)) < 1e-12
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_sliding_frame_is_planned(spark):
    df = spark.createDataFrame([("a", 1, 1.0)], "k string, t int, v double")
    for out in (tr.trailing_product(df, "v", 50, "p", ["k"], "t"), tr.trailing_drawdown(df, "v", 50, 1, "d", ["k"], "t"), tr.trailing_rank(df, "v", 50, 1, "r", ["k"], "t")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "specifiedwindowframe(RowFrame, -49, currentrow" not in plan and "collect_list" not in plan
        assert plan.count("Exchange hashpartitioning") == 1  # all windows of a series share one shuffle
