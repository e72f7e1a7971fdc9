"""Column expressions for sample statistics."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def div(a: Column, b: Column) -> Column:
    """Division with NULL for a zero divisor."""
    return F.try_divide(a, b)


def clean(c: Column) -> Column:
    """NaN and infinities to NULL."""
    bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(~bad, c)


def rows_frame(keys, date: str, n: int | None) -> WindowSpec:
    """Trailing frame of ``n`` calendar rows (all rows so far for ``None``)."""
    start = Window.unboundedPreceding if n is None else -(n - 1)
    return Window.partitionBy(*keys).orderBy(date).rowsBetween(start, 0)


def gated(expr: Column, value: Column, w: WindowSpec, min_periods: int) -> Column:
    """``expr`` where the frame holds at least ``min_periods`` non-null values."""
    return F.when(F.count(value).over(w) >= min_periods, expr)


def adjusted_skew(g1: Column, n: Column) -> Column:
    """Bias-corrected skewness from the population one."""
    nd = n.cast("double")
    return F.when(n >= 3, g1 * F.sqrt(nd * (nd - 1)) / F.nullif(nd - 2, F.lit(0.0)))


def adjusted_kurt(g2: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis from the population one."""
    nd = n.cast("double")
    scale = (nd - 1) / F.nullif((nd - 2) * (nd - 3), F.lit(0.0))
    return F.when(n >= 4, scale * ((nd + 1) * g2 + 6))


def skew_agg(c: str) -> Column:
    return adjusted_skew(F.skewness(c), F.count(c))


def kurt_agg(c: str) -> Column:
    return adjusted_kurt(F.kurtosis(c), F.count(c))


def share(cond: Column, base: Column) -> Column:
    """Share of rows with non-null ``base`` where ``cond`` holds."""
    return F.avg(F.when(base.isNotNull(), cond.cast("double")))


def positive_only(c: Column) -> Column:
    return F.when(c > 0, c)
