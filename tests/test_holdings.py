"""Sparse holdings against daily weights in full, sweeps, and the linear jackknife against one book per asset."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import attribution as at
from panelspark.operators import book as bk
from panelspark.operators import costs as cs
from panelspark.operators import holdings as hd
from panelspark.operators import jackknife as jk
from panelspark.operators import scenario as sc
from panelspark.operators import sweep as sw
from panelspark.session import cut_lineage
from tests.test_books import panel


@pytest.fixture(scope="module")
def book(spark):
    p = cut_lineage(panel(spark, days=130).withColumn("sret", F.col("xret") * 0.7))
    reb = cut_lineage(bk.sorted_book(p, n_buckets=3, vol_window=30))
    spreads = p.select("date", "asset", F.lit(0.002).alias("hs_out"), (F.abs(F.hash("asset") % 7) * 1e-4).alias("hs_pts"))
    return p, reb, cut_lineage(hd.steps(reb, p)), cut_lineage(spreads)


def frame(df, *by):
    return df.toPandas().sort_values(list(by)).reset_index(drop=True)


def same(a, b, *by):
    cols = sorted(set(a.columns) & set(b.columns))
    pd.testing.assert_frame_equal(frame(a, *by)[cols], frame(b, *by)[cols], check_dtype=False, atol=1e-12)


def test_targets_trades_and_costs_equal_daily_weights(book):
    p, reb, by_date, spreads = book
    dense = bk.apply_daily(reb, p)
    same(hd.day_weights(reb, by_date), dense, "date", "asset")
    unit = hd.day_returns(hd.held(reb), by_date, p)
    same(unit, bk.book_returns(dense, p), "date")
    target = hd.targeted(unit, by_date, window=30)
    w = bk.vol_target(dense, p, window=30)
    same(hd.day_weights(reb, target), w, "date", "asset")
    got = hd.tracks(hd.held(reb), target, unit, spreads)
    same(got.select("date", "gross", "cost"), bk.book_returns(w, p, out="gross").join(cs.roundtrip_cost(w, spreads), "date"), "date")
    assert hd.trades(hd.held(reb), target).count() < w.count() / 4  # rows only where something can change


def test_a_name_that_leaves_gets_one_exit_row(spark):
    reb = spark.createDataFrame([("2024-01-31", "a", 1.0), ("2024-01-31", "b", 0.0), ("2024-02-29", "a", 0.0), ("2024-02-29", "b", -1.0)], "l string, asset string, weight double").select(F.to_date("l").alias("label"), "asset", "weight")
    days = spark.sql("select explode(sequence(date'2024-01-30', date'2024-03-05')) as date")
    moved = hd.trades(hd.held(reb), hd.steps(reb, days)).orderBy("date", "asset").collect()
    assert [(str(r.date), r.asset, r.weight, r.prev) for r in moved] == [("2024-02-01", "a", 1.0, 0.0), ("2024-03-01", "a", 0.0, 1.0), ("2024-03-01", "b", -1.0, 0.0)]


def test_delays_and_attribution_equal_daily_weights(book):
    p, reb, by_date, spreads = book
    unit = hd.day_returns(hd.held(reb), by_date, p)
    target = hd.targeted(unit, by_date, window=30)
    w = hd.day_weights(reb, target)
    late = sc.tracks_of(sc.delay(w, [0, 2]), p, spreads).select("scenario", "date", "gross", "cost")
    same(hd.delayed_tracks(hd.held(reb), target, p, spreads, [0, 2]).select("scenario", "date", "gross", "cost"), late, "scenario", "date")
    got = hd.attribution(hd.contributions(hd.held(reb), target, p), reb, target, unit, p)
    same(got, at.attribution(at.contributions(w, p)), "asset")


def test_sweep_points_and_one_of_them(spark, book):
    p, _, _, spreads = book
    points = sw.one_at_a_time()
    assert len(points) == 24 and len(sw.grid()) == 20 and len({s["setting"] for s in points}) == 24
    some = [sw.named(n_buckets=3, vol_window=20, freq="W") | {"setting": "a"}, sw.named(n_buckets=3) | {"setting": "base"}, sw.named(n_buckets=3, weighting="equal", cap=0.5) | {"setting": "c"}]
    got = sw.sweep_tracks(p, some, spreads)
    reb = bk.sorted_book(p, n_buckets=3, vol_window=20, freq="W")
    w = bk.vol_target(bk.apply_daily(reb, p), p, window=20, freq="W")
    same(got.filter("setting = 'a'").select("date", "gross", "cost"), bk.book_returns(w, p, out="gross").join(cs.roundtrip_cost(w, spreads), "date"), "date")
    assert {r.setting for r in sw.window_ratios(got).collect()} == {"a", "base", "c"}


@pytest.mark.parametrize("raw", [None, "raw"])
def test_jackknife_equals_one_book_per_asset(spark, raw):
    rng = np.random.default_rng(4)
    rows = [(m, f"a{a:02d}", float(rng.integers(0, 9)), float(rng.normal()), float(rng.uniform(0.5, 2))) for m in range(14) for a in range(23) if rng.random() < 0.75]
    rows += [(20, f"a{a:02d}", 1.0, 0.1, 1.0) for a in range(9)] + [(21, "a00", None, 1.0, 1.0)]  # one name less and the legs are too small
    df = pd.DataFrame(rows, columns=["month_end", "asset", "signal", "ret", "raw"])
    got = {r.asset: r for r in jk.leave_one_out_ratios(spark.createDataFrame(df), raw=raw, leg_size=lambda n: F.floor(n / 3).cast("int"), min_per_leg=3, splits=4).collect()}

    def track(d):
        out = []
        for _, g in d.dropna().groupby("month_end"):
            k = len(g) // 3
            if k >= 3:
                leg = lambda s: (s["ret"] * (s["raw"] if raw else 1)).sum() / (s["raw"].sum() if raw else k)
                out.append(leg(g.sort_values(["signal", "asset"], ascending=[False, True]).head(k)) - leg(g.sort_values(["signal", "asset"]).head(k)))
        return np.array(out)

    ratio = lambda x: x.mean() * np.sqrt(12) / x.std(ddof=1)
    whole = ratio(track(df))
    assert set(got) == set(df.dropna()["asset"])
    for a, r in got.items():
        x = track(df[df["asset"] != a])
        assert r.n == len(x) and abs(r.sharpe - ratio(x)) < 1e-9 and abs(r.delta - (ratio(x) - whole)) < 1e-9
