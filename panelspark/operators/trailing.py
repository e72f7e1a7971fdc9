"""Trailing windows per series.

Frames count calendar rows, so panels are densified first (``functions.calendar.densify``) and
every statistic is gated by its minimum number of values.  One window group is one series.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.config import ANN_DAYS
from panelspark.functions.calendar import calendar_index
from panelspark.functions import orderstat as order
from panelspark.functions import rolling as roll
from panelspark.functions.stats import div, positive_only, rows_frame

Keys = Sequence[str]


def momentum(df: DataFrame, ret: str, lookback: int, skip: int = 0, out: str = "mom", keys: Keys = ("asset",), date: str = "date", min_periods: int | None = None) -> DataFrame:
    """Sum of the last ``lookback`` returns, optionally leaving out the latest ``skip`` rows."""
    mp = lookback // 2 if min_periods is None else min_periods
    m = roll.rolling_moments(df, ret, lookback, keys, date)
    df = roll.done(m.withColumn(out, F.when(roll.count() >= mp, roll.total())))
    return df.withColumn(out, F.lag(out, skip).over(Window.partitionBy(*keys).orderBy(date))) if skip else df


def trailing_vol(df: DataFrame, ret: str, window: int = 60, min_periods: int | None = None, annual: bool = False, out: str = "vol", keys: Keys = ("asset",), date: str = "date") -> DataFrame:
    mp = window // 2 if min_periods is None else min_periods
    sd = roll.std() * F.sqrt(F.lit(float(ANN_DAYS))) if annual else roll.std()
    return roll.done(roll.rolling_moments(df, ret, window, keys, date).withColumn(out, F.when(roll.count() >= mp, sd)))


def vol_min_periods(window: int) -> int:
    """The looser rule used by the annualised volatility: a third of the window, at least 20."""
    return max(20, window // 3)


def trailing_skew(df: DataFrame, ret: str, window: int = 252, min_periods: int | None = None, out: str = "skew", keys: Keys = ("asset",), date: str = "date") -> DataFrame:
    mp = window // 2 if min_periods is None else min_periods
    m = roll.rolling_moments(df, ret, window, keys, date, third=True)
    return roll.done(m.withColumn(out, F.when(roll.count() >= mp, roll.skew())))


def trailing_rank(df: DataFrame, value: str, lookback: int = 756, min_periods: int | None = None, out: str = "pct", keys: Keys = ("asset",), date: str = "date") -> DataFrame:
    """Percentile rank of the current value in its trailing frame, average rank for ties."""
    mp = lookback // 2 if min_periods is None else min_periods
    return order.trailing_order(df, value, lookback, order.percentile_rank(mp), out, keys, date)


def trailing_quantile(df: DataFrame, value: str, q: float, window: int, min_periods: int, out: str, keys: Keys = ("asset",), date: str = "date") -> DataFrame:
    """Linear-interpolated quantile of the trailing frame."""
    return order.trailing_order(df, value, window, order.quantile(q, min_periods), out, keys, date)


def trailing_drawdown(df: DataFrame, value: str, window: int, min_periods: int, out: str, keys: Keys = ("asset",), date: str = "date") -> DataFrame:
    """Value over its trailing maximum, minus 1."""
    m = roll.rolling_fold(df, F.col(value), window, keys, date, F.max, F.greatest)
    return roll.done(m.withColumn(out, F.when(roll.count() >= min_periods, div(F.col(value), roll.folded()) - 1)))


def trailing_product(df: DataFrame, ret: str, window: int, out: str, keys: Keys = ("asset",), date: str = "date", min_periods: int | None = None) -> DataFrame:
    """Compounded return over the frame."""
    m = roll.rolling_fold(df, 1 + F.col(ret), window, keys, date, F.product, lambda a, b: a * b)
    return roll.done(m.withColumn(out, F.when(roll.count() >= (window if min_periods is None else min_periods), roll.folded() - 1)))


def trailing_zscore(df: DataFrame, value: str, window: int = 252, min_periods: int | None = None, out: str = "z", keys: Keys = ("asset",), date: str = "date") -> DataFrame:
    mp = window // 4 if min_periods is None else min_periods
    z = div(F.col(value) - roll.mean(), F.nullif(roll.std(), F.lit(0.0)))
    return roll.done(roll.rolling_moments(df, value, window, keys, date).withColumn(out, F.when(roll.count() >= mp, z)))


def cumulative(df: DataFrame, value: str, out: str, keys: Keys = ("asset",), date: str = "date") -> DataFrame:
    return df.withColumn(out, F.sum(value).over(rows_frame(keys, date, None)))


def log_momentum(df: DataFrame, price: str, k: int, out: str, keys: Keys = ("asset",), date: str = "date") -> DataFrame:
    p = positive_only(F.col(price))
    return df.withColumn(out, F.ln(p) - F.lag(F.ln(p), k).over(Window.partitionBy(*keys).orderBy(date)))


def sign_flips(df: DataFrame, value: str, keys: Keys = ("asset",), date: str = "date") -> DataFrame:
    """Rows whose sign differs from the row before (the first live row counts)."""
    s = F.signum(F.col(value))
    prev = F.lag(s).over(Window.partitionBy(*keys).orderBy(date))
    return df.withColumn("_p", prev).filter(F.col(value).isNotNull() & (F.col("_p").isNull() | (s != F.col("_p")))).drop("_p").withColumn("sign", s)


def tile_count(df: DataFrame, asset: str, size: int = 256) -> int:
    """Tiles of about ``size`` assets, from the number of assets."""
    return df.select(asset).distinct().count() // size + 1


def pairwise_rolling_corr(df: DataFrame, value: str, window: int = 126, min_obs: int = 80, date: str = "date", asset: str = "asset", block: int | None = None, tiles: int | None = None) -> DataFrame:
    """Average pairwise correlation over each trailing window; assets need ``min_obs`` values in it.

    Dates are cut into blocks; each block also receives the ``window - 1`` dates before it, so a
    row is shuffled at most twice per tile.  Inside a block correlations come from masked matrix
    products; no row pair is ever emitted, only a sum and a count per date.  Assets are hashed into
    ``tiles`` (of 256 by default); a task sees the assets of one tile pair, so a large universe splits over tasks.
    """
    block, tiles = block or window, tiles or tile_count(df, asset)
    idx = df.join(calendar_index(df, date), date)
    reach = 1 + (window - 2 + block) // block
    tagged = idx.filter(F.col(value).isNotNull()).select(
        date, F.col(asset).alias("asset"), "t", F.col(value).alias("v"),
        F.pmod(F.xxhash64(asset), F.lit(tiles)).cast("int").alias("tile"),
        F.explode(F.sequence(F.floor(F.col("t") / block), F.floor(F.col("t") / block) + reach)).alias("b"),
    ).filter(F.col("t") >= F.col("b") * block - (window - 1))
    sides = F.transform(F.sequence(F.lit(0), F.lit(tiles - 1)), lambda o: F.struct(F.least("tile", o).alias("ti"), F.greatest("tile", o).alias("tj")))
    tagged = tagged.withColumn("_t", F.explode(sides)).select("*", "_t.ti", "_t.tj").drop("_t")

    def corr_block(key, pdf: pd.DataFrame) -> pd.DataFrame:
        b, ti, tj = (int(k) for k in key)
        lo = b * block - (window - 1)
        names, col = np.unique(pdf["asset"].to_numpy(), return_inverse=True)
        x = np.full((window - 1 + block, len(names)), np.nan)
        x[pdf["t"].to_numpy() - lo, col] = pdf["v"].to_numpy()
        tile = np.zeros(len(names), dtype=int)
        tile[col] = pdf["tile"].to_numpy()
        ts, sums, counts = [], [], []
        for i in range(block):
            end = b * block + i
            if end < window - 1:
                continue
            s = x[i : i + window]
            m = np.isfinite(s)
            keep = m.sum(axis=0) >= min_obs
            if keep.sum() < 2:
                continue
            s, m = s[:, keep], m[:, keep].astype(float)
            z = np.where(m > 0, s - np.nanmean(s, axis=0), 0.0)
            n = m.T @ m
            sx, sq = z.T @ m, (z * z).T @ m
            with np.errstate(invalid="ignore", divide="ignore"):
                cov = z.T @ z - sx * sx.T / n
                vx = sq - sx * sx / n
                c = cov / np.sqrt(vx * vx.T)
            i, j = np.triu_indices(len(c), 1)
            own = tile[keep]
            mine = ((own[i] == ti) & (own[j] == tj)) | ((own[i] == tj) & (own[j] == ti))
            up = c[i[mine], j[mine]]
            up = up[np.isfinite(up)]
            if len(up):
                ts.append(end)
                sums.append(up.sum())
                counts.append(len(up))
        return pd.DataFrame({"t": np.array(ts, dtype="int32"), "s": np.array(sums, dtype=float), "n": np.array(counts, dtype="int64")})

    part = tagged.groupBy("b", "ti", "tj").applyInPandas(lambda key, pdf: corr_block(key, pdf), "t int, s double, n long")
    out = part.groupBy("t").agg((F.sum("s") / F.sum("n")).alias("avg_corr"))
    return out.join(calendar_index(df, date), "t").select(date, "avg_corr")


def pair_moments(df: DataFrame, value: str, keys: Keys = (), date: str = "date", asset: str = "asset", tiles: int | None = None, block_days: int = 366, diagonal: bool = False) -> DataFrame:
    """Pairwise-complete n, correlation and covariance for asset pairs i < j (i <= j with ``diagonal``).

    Blocked cross products: assets are hashed into ``tiles`` (of 256 by default), dates into blocks; each task
    multiplies one tile pair of one date block and emits one partial row per pair, which are then
    summed.  Values are centred per asset first.  The traffic is pairs times date blocks, not
    pairs times dates.
    """
    keys, tiles = list(keys), tiles or tile_count(df, asset)
    live = df.filter(F.col(value).isNotNull())
    mean = live.groupBy(*keys, asset).agg(F.avg(value).alias("_m"))
    live = live.join(mean, [*keys, asset]).select(
        *keys, F.col(asset).cast("string").alias("a"), F.datediff(date, F.lit("1970-01-01").cast("date")).alias("d"), (F.col(value) - F.col("_m")).alias("v"))
    live = live.withColumn("tile", F.pmod(F.xxhash64("a"), F.lit(tiles)).cast("int")).withColumn("blk", F.floor(F.col("d") / block_days).cast("int"))
    sides = F.explode(F.transform(F.sequence(F.lit(0), F.lit(tiles - 1)), lambda o: F.struct(F.least("tile", o).alias("ti"), F.greatest("tile", o).alias("tj"))))
    tagged = live.withColumn("_t", sides).select("*", "_t.ti", "_t.tj").drop("_t")

    def gram(key, pdf: pd.DataFrame) -> pd.DataFrame:
        names, col = np.unique(pdf["a"].to_numpy().astype(str), return_inverse=True)
        days, row = np.unique(pdf["d"].to_numpy(), return_inverse=True)
        x = np.zeros((len(days), len(names)))
        m = np.zeros_like(x)
        x[row, col] = pdf["v"].to_numpy()
        m[row, col] = 1.0
        tile = np.zeros(len(names), dtype=int)
        tile[col] = pdf["tile"].to_numpy()
        ti, tj = int(key[-2]), int(key[-1])
        n, sx, sxx, sxy = m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x
        i, j = np.triu_indices(len(names), 0 if diagonal else 1)
        # names are sorted, so i < j is the order of the pair; keep only pairs of this tile pair
        ok = ((tile[i] == ti) & (tile[j] == tj)) | ((tile[i] == tj) & (tile[j] == ti))
        i, j = i[ok], j[ok]
        out = pd.DataFrame({"asset_i": names[i], "asset_j": names[j], "n": n[i, j].astype("int64"), "si": sx[i, j], "sj": sx[j, i], "sii": sxx[i, j], "sjj": sxx[j, i], "sij": sxy[i, j]})
        for p, k in enumerate(keys):
            out[k] = key[p]
        return out[out["n"] > 0]

    types = dict(df.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["asset_i string, asset_j string, n long, si double, sj double, sii double, sjj double, sij double"])
    grouped = tagged.groupBy(*keys, "blk", "ti", "tj").applyInPandas(lambda k, p: gram(k, p)[[c.split()[0] for c in schema.split(", ")]], schema)
    s = grouped.groupBy(*keys, "asset_i", "asset_j").agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "sii", "sjj", "sij")])
    n = F.col("n")
    cov = F.col("sij") - F.col("si") * F.col("sj") / n
    vi, vj = F.col("sii") - F.col("si") * F.col("si") / n, F.col("sjj") - F.col("sj") * F.col("sj") / n
    return s.select(*keys, "asset_i", "asset_j", "n", div(cov, F.sqrt(positive_only(vi) * positive_only(vj))).alias("corr"), div(cov, F.nullif((n - 1).cast("double"), F.lit(0.0))).alias("cov"))


def average_corr(pairs: DataFrame, keys: Keys = ()) -> DataFrame:
    """Average, largest and smallest pairwise correlation."""
    p = pairs.filter("corr is not null")
    return p.groupBy(*keys).agg(F.avg("corr").alias("avg_corr"), F.max("corr").alias("max_corr"), F.min("corr").alias("min_corr"), F.count("corr").alias("n_pairs"))
