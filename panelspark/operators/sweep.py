"""Parameter sweeps and grids of the sorted book as one fan-out.

Every setting is a row: volatility window, rebalancing frequency, number of buckets, cap, target, weighting. The panel is read once; trailing
volatilities of all windows become columns, the rebalance tables of all frequencies one aggregation, and each setting picks its rows of it.
From there books, steps, targets and tracks carry ``setting`` as their key, so a grid is one job and not one per point.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.config import ANN_DAYS
from panelspark.functions.calendar import asof_fill, first_sunday, period_label
from panelspark.functions.stats import div
from panelspark.operators import holdings
from panelspark.operators.book import book_from_table
from panelspark.operators.performance import annual_ratio, max_drawdown
from panelspark.operators.trailing import trailing_vol
from panelspark.session import cut_lineage

#: Fixed values of the published sweep: one knob at a time around the base setting.
KNOBS = {
    "vol_window": (20, 40, 60, 90, 120),
    "target": (0.06, 0.08, 0.10, 0.12, 0.15),
    "freq": ("M", "2W", "W", "Q"),
    "n_buckets": (3, 4, 5, 6),
    "cap": (0.25, 0.33, 0.40, 0.50, 1.00),
}
BASE = {"vol_window": 60, "target": 0.10, "freq": "M", "n_buckets": 5, "cap": 0.40, "weighting": "inv_vol"}
TYPES = "setting string, vol_window int, target double, freq string, n_buckets int, cap double, weighting string"


def named(**knobs) -> dict:
    """A setting from its base and the knobs that differ, named after those given."""
    return {"setting": ",".join(f"{k}={v}" for k, v in knobs.items()) or "base"} | BASE | knobs


def one_at_a_time(**base) -> list[dict]:
    """The published points; ``base`` changes the setting around which they lie."""
    return [named() | base] + [named() | base | {k: v, "setting": f"{k}={v}"} for k, vs in KNOBS.items() for v in vs]


def grid(knobs: Sequence[str] = ("vol_window", "freq"), **base) -> list[dict]:
    """All combinations of some knobs."""
    points = product(*(KNOBS[k] for k in knobs))
    return [named() | base | dict(zip(knobs, p, strict=True)) | {"setting": ",".join(f"{k}={v}" for k, v in zip(knobs, p, strict=True))} for p in points]


def label_of(freqs: Sequence[str], anchor: Column | None) -> Column:
    """Period label by the frequency column of the row."""
    out = F.lit(None).cast("date")
    for f in freqs:
        out = F.when(F.col("freq") == f, period_label(F.col("date"), f, anchor)).otherwise(out)
    return out


def last_of(df: DataFrame, cols: Sequence[str], keys: Sequence[str], label: Column) -> DataFrame:
    """Last non-null value of each column per period, the label given as a column."""
    return df.groupBy(*keys, label.alias("label")).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date"))).alias(c) for c in cols])


def setting_tables(panel: DataFrame, settings: Sequence[dict], signal: str = "carry", ret: str = "xret") -> DataFrame:
    """Rebalance tables of all settings: setting, cap, n_buckets, label, asset, signal, _vol."""
    spark = panel.sparkSession
    freqs = sorted({s["freq"] for s in settings})
    anchor = first_sunday(panel) if "2W" in freqs else None
    windows = sorted({s["vol_window"] for s in settings})
    p = panel.select("date", "asset", signal, ret)
    for w in windows:
        p = trailing_vol(p, ret, w, out=f"_vol{w}")
    vols = [f"_vol{w}" for w in windows]
    p = p.select("date", "asset", signal, *vols).withColumn("freq", F.explode(F.array(*map(F.lit, freqs))))
    tab = last_of(p, [signal, *vols], ["freq", "asset"], label_of(freqs, anchor))
    tab = tab.withColumn("_v", F.explode(F.array(*[F.struct(F.lit(w).alias("vol_window"), F.col(v).alias("_vol")) for w, v in zip(windows, vols, strict=True)])))
    tab = tab.select("freq", "asset", "label", signal, "_v.vol_window", "_v._vol")
    vol = F.when((F.col("weighting") == "equal") & (F.col("_vol") > 0), F.lit(1.0)).otherwise(F.col("_vol"))  # weights are 1 / _vol
    return tab.join(settings_frame(spark, settings), ["freq", "vol_window"]).select("setting", "cap", "n_buckets", "label", "asset", signal, vol.alias("_vol"))


def settings_frame(spark, settings: Sequence[dict]) -> DataFrame:
    names = [t.split()[0] for t in TYPES.split(", ")]
    return spark.createDataFrame([tuple(s[n] for n in names) for s in settings], TYPES)


def setting_scalars(unit: DataFrame, settings: DataFrame, windows: Sequence[int], freqs: Sequence[str], anchor: Column | None, lev_cap: float = 4.0, vol_floor: float = 0.01) -> DataFrame:
    """(setting, date, scalar): each setting's target over its own book's trailing volatility, sampled at its own labels, one row late."""
    u = unit.join(settings.select("setting", "vol_window", "freq", "target"), "setting")
    v = reduce(DataFrame.unionByName, [trailing_vol(u.filter(F.col("vol_window") == w), "ret", w, annual=True, out="_v", keys=["setting"]) for w in windows])
    s = F.least(div(F.col("target"), F.greatest("_v", F.lit(vol_floor))), F.lit(lev_cap))
    v = v.withColumn("scalar", F.when(F.col("_v").isNotNull(), s))
    ev = last_of(v, ["scalar"], ["setting"], label_of(freqs, anchor))
    return asof_fill(unit.select("setting", "date"), ev, ["scalar"], ["setting"], lag=1)


def sweep_tracks(panel: DataFrame, settings: Sequence[dict], spreads: DataFrame | None, signal: str = "carry", ret: str = "xret", min_per_leg: int = 2) -> DataFrame:
    """(setting, date, gross, cost, net) of every setting."""
    freqs, windows = sorted({s["freq"] for s in settings}), sorted({s["vol_window"] for s in settings})
    anchor = first_sunday(panel) if "2W" in freqs else None
    tab = cut_lineage(setting_tables(panel, settings, signal, ret))
    reb = book_from_table(tab, signal, ["setting", "cap"], lambda n: F.floor(n / F.col("n_buckets")).cast("int"), min_per_leg, F.col("cap"), zeros=False, least_cap=min(s["cap"] for s in settings))
    reb = cut_lineage(reb.drop("cap"))
    by_date = cut_lineage(holdings.steps(reb, panel, ["setting"]))
    unit = cut_lineage(holdings.day_returns(reb, by_date, panel, ["setting"], ret))
    scalars = setting_scalars(unit, settings_frame(panel.sparkSession, settings), windows, freqs, anchor)
    by_date = cut_lineage(by_date.join(scalars, ["setting", "date"]))
    return holdings.tracks(reb, by_date, unit, spreads, ["setting"])


def window_ratios(tracks: DataFrame, base: str = "base") -> DataFrame:
    """Sharpe ratios and the deepest net drawdown of each setting over the dates on which the base setting is live."""
    span = tracks.filter((F.col("setting") == base) & F.col("net").isNotNull()).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    t = tracks.filter(F.col("date").between(span.select("a").scalar(), span.select("b").scalar()))
    r = t.groupBy("setting").agg(annual_ratio("gross").alias("gross_sharpe"), annual_ratio("net").alias("net_sharpe"), F.count("net").alias("n_days"), (F.avg("net") * ANN_DAYS).alias("net_return"))
    return r.join(max_drawdown(t, ["setting"], ret="net").withColumnRenamed("max_drawdown", "net_maxdd"), "setting")
