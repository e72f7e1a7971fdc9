"""Leave-one-out tracks of a ranked long/short book without building one book per asset.

Leaving a name out of a date changes little: the universe is one smaller, so the legs hold ``leg_size(n - 1)`` names; a name outside them
changes nothing else, and a name inside is replaced by the next in rank. So per date and side three pairs of sums suffice (over the base
leg, over the smaller universe's leg, and over that leg with the next name), and each row's return without its asset follows from them by
subtracting that row. An asset's track is the base track but for the dates on which it is ranked; the ratio needs sums of returns and of
their squares, which the differences correct. All rows emitted are rows of the panel: linear in the assets.

For legs whose weights are shares of ``raw`` without a cap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.config import MONTHS_PER_YEAR
from panelspark.functions.ranking import cross_rank
from panelspark.functions.stats import div, positive_only
from panelspark.operators.cross_section import divided_leg_size
from panelspark.session import cut_lineage


def without_each(panel: DataFrame, signal: str = "signal", ret: str = "ret", raw: str | None = None, leg_size: Callable[[Column], Column] = divided_leg_size(5), min_per_leg: int = 2, date: str = "month_end", splits: int = 1) -> tuple[DataFrame, DataFrame]:
    """(date, ret_base) of the book and (date, asset, ret_base, ret_without) for every ranked row; NULL where legs are too small."""
    live = panel.filter(F.col(signal).isNotNull() & F.col(ret).isNotNull()).select(date, "asset", signal, F.col(ret).alias("_ret"), (F.col(raw) if raw else F.lit(1.0)).alias("_raw"))
    r = cross_rank(live, [date], signal, name="_low", count="_n", splits=splits)
    r = cross_rank(r, [date], signal, ascending=False, name="_high", splits=splits)
    r = cut_lineage(r.withColumns({"_k": leg_size(F.col("_n")), "_k1": leg_size(F.col("_n") - 1)}))
    sums = []
    for side in ("_high", "_low"):
        for part, upto in (("base", F.col("_k")), ("small", F.col("_k1")), ("next", F.col("_k1") + 1)):
            inside = F.col(side) <= upto
            sums += [F.sum(F.when(inside, F.col("_raw"))).alias(f"{side}_{part}"), F.sum(F.when(inside, F.col("_raw") * F.col("_ret"))).alias(f"{side}_{part}_ret")]
    legs = r.groupBy(date).agg(F.max("_k").alias("_leg"), F.max("_k1").alias("_leg1"), *sums)
    base = F.when(F.col("_leg") >= min_per_leg, div(F.col("_high_base_ret"), F.col("_high_base")) - div(F.col("_low_base_ret"), F.col("_low_base")))
    legs = cut_lineage(legs.withColumn("ret_base", base))

    def side_without(side: str) -> Column:
        own = F.col(side) <= F.col("_k1") + 1
        return F.when(own, div(F.col(f"{side}_next_ret") - F.col("_raw") * F.col("_ret"), F.col(f"{side}_next") - F.col("_raw"))).otherwise(div(F.col(f"{side}_small_ret"), F.col(f"{side}_small")))

    gone = F.when(F.col("_leg1") >= min_per_leg, side_without("_high") - side_without("_low"))
    return legs.select(date, "ret_base"), r.join(legs, date).select(date, "asset", "ret_base", gone.alias("ret_without"))


def leave_one_out_ratios(panel: DataFrame, periods: int = MONTHS_PER_YEAR, date: str = "month_end", **kw) -> DataFrame:
    """asset, sharpe (of the book without it), delta (from the book's own), n (dates)."""
    base, each = without_each(panel, date=date, **kw)
    zero = F.lit(0.0)

    def moments(c: str) -> list[Column]:
        x = F.coalesce(F.col(c), zero)
        return [F.when(F.col(c).isNotNull(), 1.0).otherwise(0.0), x, x * x]

    b, w = moments("ret_base"), moments("ret_without")
    names = ("_n", "_s", "_q")
    total = base.agg(*[F.sum(c).alias(n) for c, n in zip(b, names, strict=True)])
    total = {n: total.select(n).scalar() for n in names}
    diff = each.groupBy("asset").agg(*[F.sum(y - x).alias(n) for x, y, n in zip(b, w, names, strict=True)])

    def ratio(n: Column, s: Column, q: Column) -> Column:
        var = div(q - div(s * s, n), n - 1)
        return div(div(s, n) * F.sqrt(F.lit(float(periods))), F.sqrt(positive_only(var)))

    own = [F.col(n) + total[n] for n in names]
    return diff.select("asset", ratio(*own).alias("sharpe"), (ratio(*own) - ratio(*(total[n] for n in names))).alias("delta"), own[0].cast("bigint").alias("n"))
