"""Per-date operators: ranks, legs, z-scores, residuals, spreads and filters.

Plain statistics per date are aggregated with map-side combine and joined back, so a date never
has to fit one task.  Ranks go through ``cross_rank``, whose ``splits`` spreads one date over
several tasks; universes of bounded size use one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.config import LONG_BASKET, MIDDLE_BASKET, SHORT_BASKET
from panelspark.functions.ranking import cross_quantile, cross_rank
from panelspark.functions.stats import div, skew_agg

Keys = Sequence[str]


# --- buckets and legs --------------------------------------------------------------------------
def rank_buckets(df: DataFrame, by: Keys, signal: str, n: int, ascending: bool = True, out: str = "bucket_no", splits: int = 1) -> DataFrame:
    """Labels 1..n from first-come ranks: ceil(rank / size * n)."""
    r = cross_rank(df, by, signal, ascending=ascending, name="_rn", count="_n", splits=splits)
    lab = F.ceil(F.col("_rn").cast("double") / F.col("_n") * F.lit(n))
    return r.withColumn(out, F.when(F.col("_rn").isNotNull(), F.greatest(F.lit(1), F.least(F.lit(n), lab.cast("int"))))).drop("_rn", "_n")


def quantile_buckets(df: DataFrame, by: Keys, signal: str, q: int = 5, out: str = "q", splits: int = 1) -> DataFrame:
    """Equal-count quantiles on first-come ranks; dates with fewer than q values get NULL."""
    r = cross_rank(df, by, signal, name="_rn", count="_n", splits=splits)
    edge = F.ceil((F.col("_rn") - 1) * F.lit(q) / F.nullif((F.col("_n") - 1).cast("double"), F.lit(0.0)))
    lab = F.greatest(F.lit(1), edge.cast("int"))
    return r.withColumn(out, F.when(F.col("_rn").isNotNull() & (F.col("_n") >= q), lab)).drop("_rn", "_n")


def adaptive_leg_size(n: Column) -> Column:
    """20 % of the names (at least 3, at most half) from six names on; a third, at least 1, below."""
    big = F.least(F.greatest(F.ceil(F.lit(0.20) * n).cast("int"), F.lit(3)), F.floor(n / 2).cast("int"))
    small = F.greatest(F.lit(1), F.floor(n / 3).cast("int"))
    return F.when(n < 2, F.lit(0)).when(n >= 6, big).otherwise(small)


def capped_leg_size(rule: Callable[[Column], Column], weight_cap: float) -> Callable[[Column], Column]:
    """``rule``, but never so few names that an equal weight exceeds the cap."""
    return lambda n: F.greatest(rule(n), F.lit(math.ceil(1 / weight_cap)))


def divided_leg_size(parts: int) -> Callable[[Column], Column]:
    return lambda n: F.floor(n / F.lit(parts)).cast("int")


def fraction_leg_size(share: float) -> Callable[[Column], Column]:
    return lambda n: F.greatest(F.lit(1), F.ceil(n * F.lit(share)).cast("int"))


def fixed_leg_size(k: int) -> Callable[[Column], Column]:
    return lambda n: F.lit(k)


def assign_legs(df: DataFrame, by: Keys, signal: str, leg_size: Callable[[Column], Column], ties: str = "reverse", splits: int = 1) -> DataFrame:
    """Add n, k and ``leg`` (1 long, -1 short, 0 middle) for rows with a signal.

    ``ties="reverse"`` takes the tail of one ascending order; ``"first"`` ranks each side with the
    smaller asset first.
    """
    live = df.filter(F.col(signal).isNotNull())
    r = cross_rank(live, by, signal, name="_lo", count="n", splits=splits).withColumn("k", leg_size(F.col("n")))
    if ties == "first":
        r = cross_rank(r, by, signal, ascending=False, name="_hi", splits=splits)
        top = F.col("_hi") <= F.col("k")
    else:
        top = F.col("_lo") > F.col("n") - F.col("k")
    leg = F.when(top, 1).when(F.col("_lo") <= F.col("k"), -1).otherwise(0)
    return r.withColumn("leg", leg).drop("_lo", "_hi")


def equal_leg_weights(df: DataFrame, by: Keys, signal: str, leg_size: Callable[[Column], Column], ret: str | None = None, splits: int = 1) -> DataFrame:
    """Long/short weights of +-1/k with basket names; dates with too few names are dropped."""
    if ret is not None:
        df = df.filter(F.col(ret).isNotNull())
    legs = assign_legs(df, by, signal, leg_size, splits=splits).filter((F.col("k") > 0) & (F.col("n") >= 2 * F.col("k")))
    return legs.withColumn("weight", F.col("leg") / F.col("k").cast("double")).withColumn(
        "basket", F.when(F.col("leg") == 1, LONG_BASKET).when(F.col("leg") == -1, SHORT_BASKET).otherwise(MIDDLE_BASKET))


def min_size(df: DataFrame, by: Keys, value: str, least: int) -> DataFrame:
    """Keep dates with at least ``least`` non-null values."""
    ok = df.groupBy(*by).agg(F.count(value).alias("_n")).filter(F.col("_n") >= least).select(*by)
    return df.join(ok, list(by), "left_semi")


def well_formed(books: DataFrame, tol: float = 1e-8) -> DataFrame:
    """Books with long 1, short -1, net 0 and gross 2."""
    near = lambda c, x: F.abs(F.col(c) - F.lit(float(x))) < tol
    return books.filter(near("gross_long", 1) & near("gross_short", -1) & near("net", 0) & near("gross", 2))


def top_bottom_names(df: DataFrame, by: Keys, signal: str, n: int = 3, splits: int = 1) -> DataFrame:
    """Lowest and highest names per date as text."""
    legs = assign_legs(df, by, signal, fixed_leg_size(n), splits=splits)
    names = lambda s: F.array_join(F.sort_array(F.collect_list(F.when(F.col("leg") == s, F.col("asset")))), ", ")
    return legs.filter("leg <> 0").groupBy(*by).agg(names(-1).alias("lowest"), names(1).alias("highest"))


def spread_factor(df: DataFrame, by: Keys, signal: str, ret: str, top: int = 3, bottom: int = 3, splits: int = 1) -> DataFrame:
    """High-minus-low return, leg returns and names per date."""
    live = df.filter(F.col(signal).isNotNull() & F.col(ret).isNotNull())
    r = cross_rank(live, by, signal, name="_r", count="_n", splits=splits).filter(F.col("_n") >= top + bottom)
    hi, lo = F.col("_r") > F.col("_n") - top, F.col("_r") <= bottom
    names = lambda c: F.array_join(F.sort_array(F.collect_list(F.when(c, F.col("asset")))), ", ")
    out = r.filter(hi | lo).groupBy(*by).agg(
        F.avg(F.when(hi, F.col(ret))).alias("high_leg"), F.avg(F.when(lo, F.col(ret))).alias("low_leg"), names(hi).alias("high_names"), names(lo).alias("low_names"))
    return out.withColumn("factor", F.col("high_leg") - F.col("low_leg"))


# --- statistics per date ------------------------------------------------------------------------
def zscore(df: DataFrame, by: Keys, cols: Sequence[str], ddof: int = 1, suffix: str = "_z") -> DataFrame:
    """Cross-sectional z-scores; ddof 0 maps a zero spread to 0, ddof 1 to NULL."""
    sd = F.stddev_samp if ddof == 1 else F.stddev_pop
    m = df.groupBy(*by).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[sd(c).alias(f"_s_{c}") for c in cols])
    out = df.join(m, list(by))
    for c in cols:
        z = div(F.col(c) - F.col(f"_m_{c}"), F.nullif(F.col(f"_s_{c}"), F.lit(0.0)))
        if ddof == 0:
            z = F.when(F.coalesce(F.col(f"_s_{c}"), F.lit(0.0)) == 0, F.lit(0.0)).otherwise(z)
        out = out.withColumn(c + suffix, z)
    return out.drop(*[f"_{p}_{c}" for c in cols for p in ("m", "s")])


def residual(df: DataFrame, by: Keys, y: str, x: str, out: str = "resid", add_const: bool = True) -> DataFrame:
    """Residual of the per-date regression of y on x; NULL below 3 names or without variation."""
    live = df.filter(F.col(y).isNotNull() & F.col(x).isNotNull())
    if add_const:
        sxx, sxy = F.var_pop(x) * F.count(x), F.covar_pop(x, y) * F.count(x)
    else:
        sxx, sxy = F.sum(F.col(x) * F.col(x)), F.sum(F.col(x) * F.col(y))
    m = live.groupBy(*by).agg(F.count(x).alias("_n"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"), sxx.alias("_sxx"), sxy.alias("_sxy"))
    beta = div(F.col("_sxy"), F.nullif(F.col("_sxx"), F.lit(0.0)))
    dx, dy = (F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")) if add_const else (F.col(x), F.col(y))
    fit = F.when(F.col("_n") >= 3, dy - beta * dx)
    return live.join(m, list(by)).withColumn(out, fit).drop("_n", "_mx", "_my", "_sxx", "_sxy")


def cross_stats(df: DataFrame, by: Keys, value: str, splits: int = 1) -> DataFrame:
    """Mean, dispersion, minimum and median per date."""
    s = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("dispersion"), F.min(value).alias("lowest"), F.count(value).alias("n"))
    med = cross_quantile(df, by, value, {"median": 0.5}, splits=splits)
    return s.join(med, list(by), "left")


def stress_index(df: DataFrame, by: Keys, value: str, method: str = "mean", splits: int = 1) -> DataFrame:
    """Negated cross-sectional mean, median or minimum; ``zmean`` expects trailing z-scores as ``value``."""
    if method == "median":
        q = cross_quantile(df, by, value, {"_v": 0.5}, splits=splits)
        return q.select(*by, (-F.col("_v")).alias("stress"))
    agg = {"mean": F.avg, "zmean": F.avg, "worst": F.min}[method]
    return df.groupBy(*by).agg((-agg(value)).alias("stress"))


def blend(df: DataFrame, by: Keys, parts: Mapping[str, float], out: str = "signal") -> DataFrame:
    """Weighted sum of cross-sectional z-scores; NULL where a part is missing."""
    z = zscore(df, by, list(parts))
    total = None
    for c, w in parts.items():
        term = F.lit(float(w)) * F.col(f"{c}_z")
        total = term if total is None else total + term
    return z.withColumn(out, total)


def apply_filter(df: DataFrame, variant: str, by: Keys = ("month_end",), signal: str = "carry_signal", vol: str = "atm_vol", skew: str = "bad_skew25",
                 lam: float = 0.0, gam: float = 0.0, q: float = 0.80, least: int = 5, splits: int = 1) -> DataFrame:
    """Quantile exclusions and composite score.

    Variants: ``baseline``, ``vol``, ``skew``, ``vol_or_skew``, ``score``.  Dates with fewer than
    ``least`` rows are left alone.
    """
    by = list(by)
    df = df.withColumn("score", F.col(signal))
    if variant == "baseline":
        return df
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    if variant == "score":
        z = zscore(df, by, [signal, vol, skew], ddof=0).join(n, by)
        comp = F.col(f"{signal}_z") - F.lit(lam) * F.col(f"{vol}_z") - F.lit(gam) * F.col(f"{skew}_z")
        return z.withColumn("score", F.when(F.col("_n") >= least, comp).otherwise(F.col(signal))).drop("_n", f"{signal}_z", f"{vol}_z", f"{skew}_z")
    cut_v = cross_quantile(df, by, vol, {"_qv": q}, splits=splits)
    cut_s = cross_quantile(df, by, skew, {"_qs": q}, splits=splits)
    j = df.join(n, by).join(cut_v, by, "left").join(cut_s, by, "left")
    hot_v = F.coalesce(F.col(vol) >= F.col("_qv"), F.lit(False))
    hot_s = F.coalesce(F.col(skew) >= F.col("_qs"), F.lit(False))
    hot = {"vol": hot_v, "skew": hot_s, "vol_or_skew": hot_v | hot_s}[variant]
    return j.filter(~(hot & (F.col("_n") >= least))).drop("_n", "_qv", "_qs")


def mean_grid(df: DataFrame, row: str, col: str, ret: str, labels: Sequence[int]) -> DataFrame:
    """Mean return by two bucket labels, one column per second label."""
    return df.filter(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(row).pivot(col, list(labels)).agg(F.avg(ret))


def bucket_stats(df: DataFrame, buckets: Mapping[str, Column], samples: Mapping[str, Column], ret: str) -> DataFrame:
    """Return statistics for named bucket predicates crossed with named samples, in one pass.

    Every row is unrolled into the buckets and samples it belongs to, then aggregated once.
    """
    tag = lambda d: F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in d.items()])))
    t = df.filter(F.col(ret).isNotNull()).withColumn("bucket_name", tag(buckets)).withColumn("sample", tag(samples))
    return t.groupBy("sample", "bucket_name").agg(
        F.count(ret).alias("observations"), F.avg(ret).alias("avg_return"), F.stddev_samp(ret).alias("volatility"),
        div(F.avg(ret), F.nullif(F.stddev_samp(ret), F.lit(0.0))).alias("sharpe"), F.avg((F.col(ret) > 0).cast("double")).alias("hit_rate"),
        skew_agg(ret).alias("skewness"), F.min(ret).alias("worst"))


def median_corr(df: DataFrame, a: str, b: str, key: str = "asset") -> DataFrame:
    """Correlation across assets of their medians of two measures."""
    m = df.groupBy(key).agg(F.percentile(a, 0.5).alias("_a"), F.percentile(b, 0.5).alias("_b"))
    return m.agg(F.corr("_a", "_b").alias("median_corr"), F.count(F.lit(1)).alias("n_assets"))
