"""Trailing moments at constant cost per row.

A sliding frame re-reads its whole window for every row.  Here each series is cut into blocks of
``window`` rows; a trailing window is the tail of one block and the head of the next.  Heads are
running totals from the block's start, tails running totals from its end, each centred at a value
that the window holds, and the two are merged by the pooled-moment formulas.  So a statistic
depends on the values inside its window only, whatever came before.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.stats import adjusted_skew

_PARTS = ("h", "t", "l")
_TMP = ("__rn", "__blk", *(f"__{p}{m}" for p in _PARTS for m in "cnabef"), "__n", "__mean", "__m2", "__m3", "__fold")


def _totals(df: DataFrame, value: str, order, part: str, third: bool) -> DataFrame:
    """Count and power sums about the first value of ``order`` from its start to each row."""
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    c = f"__{part}c"
    df = df.withColumn(c, F.first(value, ignorenulls=True).over(upto))
    d = F.coalesce(F.col(value) - F.col(c), F.lit(0.0))
    sums = {"n": F.count(value), "a": F.sum(d), "b": F.sum(d * d)} | ({"e": F.sum(d * d * d)} if third else {})
    return df.withColumns({f"__{part}{k}": v.over(upto) for k, v in sums.items()})


def _central(part: str, third: bool) -> tuple[Column, Column, Column, Column]:
    """Count, mean, and central sums of order 2 and 3; squares lost in rounding count as 0."""
    n = F.coalesce(F.col(f"__{part}n"), F.lit(0)).cast("double")
    safe = F.nullif(n, F.lit(0.0))
    a, b = F.col(f"__{part}a"), F.col(f"__{part}b")
    m = a / safe
    m2 = b - a * m
    m2 = F.when(m2 > b * 1e-14, m2).otherwise(F.lit(0.0))
    m3 = F.col(f"__{part}e") - 3 * m * b + 2 * safe * m * m * m if third else F.lit(0.0)
    return n, F.col(f"__{part}c") + m, F.coalesce(m2, F.lit(0.0)), F.coalesce(m3, F.lit(0.0))


def _before(df: DataFrame, names: str, window: int, keys: Sequence[str]) -> DataFrame:
    """The tail of the block before, from the first row of the window; sorted as the heads are, so Spark does not sort again."""
    split = (F.col("__rn") % window < window - 1) if window > 1 else F.lit(False)
    order = Window.partitionBy(*keys).orderBy("__blk", "__rn")
    return df.withColumns({f"__l{k}": F.when(split, F.lag(f"__t{k}", max(window - 1, 1)).over(order)) for k in names})


def rolling_fold(df: DataFrame, value: Column, window: int, keys: Sequence[str], date: str, fold: Callable[[Column], Column], two: Callable[[Column, Column], Column]) -> DataFrame:
    """Add ``__n`` and ``__fold``, an aggregate over the trailing window that knows no inverse (a maximum, a product): the fold of the
    block's head and of the tail of the block before, put together by ``two``."""
    order = Window.partitionBy(*keys).orderBy(date)
    out = df.withColumn("__rn", F.row_number().over(order) - 1).withColumn("__blk", F.floor(F.col("__rn") / window)).withColumn("__c", value)
    block = Window.partitionBy(*keys, "__blk")
    for part, by in (("t", F.desc("__rn")), ("h", F.asc("__rn"))):
        upto = block.orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumns({f"__{part}n": F.count("__c").over(upto), f"__{part}f": fold(F.col("__c")).over(upto)})
    out = _before(out.drop("__c"), "nf", window, keys)
    n = F.col("__hn") + F.coalesce("__ln", F.lit(0))
    head, tail = F.when(F.col("__hn") > 0, F.col("__hf")), F.when(F.col("__ln") > 0, F.col("__lf"))
    return out.withColumns({"__n": n, "__fold": F.when(head.isNull(), tail).when(tail.isNull(), head).otherwise(two(head, tail))})


def rolling_moments(df: DataFrame, value: str, window: int, keys: Sequence[str], date: str, third: bool = False) -> DataFrame:
    """Add ``__n``, ``__mean`` and the central sums ``__m2 __m3`` of the trailing window."""
    order = Window.partitionBy(*keys).orderBy(date)
    out = df.withColumn("__rn", F.row_number().over(order) - 1).withColumn("__blk", F.floor(F.col("__rn") / window))
    block = Window.partitionBy(*keys, "__blk")
    out = _totals(out, value, block.orderBy(F.desc("__rn")), "t", third)
    out = _totals(out, value, block.orderBy("__rn"), "h", third)
    out = _before(out, "cnabe" if third else "cnab", window, keys)
    n1, mu1, s1, c1 = _central("h", third)
    n2, mu2, s2, c2 = _central("l", third)
    n = n1 + n2
    gap = F.coalesce(mu1 - mu2, F.lit(0.0))
    safe = F.nullif(n, F.lit(0.0))
    mean_ = F.coalesce(mu1, mu2) - F.when(n1 > 0, gap * n2 / safe).otherwise(F.lit(0.0))
    m2 = s1 + s2 + gap * gap * n1 * n2 / safe
    m3 = c1 + c2 + gap * gap * gap * n1 * n2 * (n2 - n1) / (safe * safe) + 3 * gap * (n2 * s1 - n1 * s2) / safe
    return out.withColumns({"__n": n.cast("long"), "__mean": mean_, "__m2": F.coalesce(m2, F.lit(0.0)), "__m3": F.coalesce(m3, F.lit(0.0))})


def done(df: DataFrame) -> DataFrame:
    return df.drop(*_TMP)


def count() -> Column:
    return F.col("__n")


def folded() -> Column:
    return F.col("__fold")


def total() -> Column:
    return F.when(F.col("__n") > 0, F.col("__mean") * F.col("__n"))


def mean() -> Column:
    return F.when(F.col("__n") > 0, F.col("__mean"))


def std() -> Column:
    """Sample standard deviation."""
    return F.when(F.col("__n") > 1, F.sqrt(F.col("__m2") / F.nullif((F.col("__n") - 1).cast("double"), F.lit(0.0))))


def skew() -> Column:
    """Bias-corrected skewness; needs ``third=True``."""
    n = F.nullif(F.col("__n").cast("double"), F.lit(0.0))
    m2, m3 = F.col("__m2") / n, F.col("__m3") / n
    return F.when(m2 > 0, adjusted_skew(m3 / F.nullif(F.pow(m2, F.lit(1.5)), F.lit(0.0)), F.col("__n")))
