"""Exact ranks and quantiles inside a date, also for universes too large for one task.

With ``splits=1`` a plain window ranks each date; right for universes of bounded size.  With
more splits each date is cut into ordered cells by boundary rows, every cell is ranked in its
own task, and the count of the cells before it is added.  Boundaries come from a hash-chosen
set of about ``per_cell`` assets a cell, however many a date has (its share follows from the
date's row count), so what is gathered for a date is bounded.  The hash makes them the same on
every recomputation; they only decide which task ranks a row.  Boundaries are (value, asset)
pairs: a value shared by a third of all rows still splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.session import cut_lineage


def cross_rank(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    tiebreak: str = "asset",
    ascending: bool = True,
    name: str = "rn",
    count: str | None = None,
    splits: int = 1,
    per_cell: int = 64,
) -> DataFrame:
    """Add ``name`` = 1..n in the order of (value, tiebreak) within ``by``; NULL values get NULL.

    ``count`` names a column for n, the number of non-null values of the group.
    """
    by = list(by)
    key = F.col(value) + F.lit(0.0) if ascending else F.lit(0.0) - F.col(value)
    if splits <= 1:
        w = Window.partitionBy(*by)
        order = w.orderBy(key.asc_nulls_last(), F.col(tiebreak).asc())
        out = df.withColumn(name, F.when(F.col(value).isNotNull(), F.row_number().over(order)))
        return out if count is None else out.withColumn(count, F.count(value).over(w))

    df = cut_lineage(df)  # read four times below: row counts, boundaries, cell counts, ranks
    pair = F.struct(key.alias("k"), F.col(tiebreak).alias("a"))
    live = df.filter(F.col(value).isNotNull())
    share = live.groupBy(*by).agg((F.count(F.lit(1)) / F.lit(per_cell * splits)).cast("long").alias("__share"))
    cuts = (
        live.join(share, by)
        .filter(F.pmod(F.xxhash64(tiebreak, F.lit(splits)), F.greatest(F.col("__share"), F.lit(1))) == 0)
        .groupBy(*by)
        .agg(F.sort_array(F.collect_list(pair)).alias("__s"))
        .select(
            *by,
            F.transform(
                F.sequence(F.lit(1), F.lit(splits - 1)),
                lambda i: F.element_at("__s", F.ceil(i * F.size("__s") / F.lit(splits)).cast("int")),
            ).alias("__cuts"),
        )
    )
    keyed = (
        df.join(cuts, by, "left")
        .withColumn("__p", pair)
        .withColumn(
            "__cell",
            F.when(F.col(value).isNull(), -1 - F.pmod(F.xxhash64(tiebreak), F.lit(splits)).cast("int")).otherwise(
                F.coalesce(F.size(F.filter("__cuts", lambda c: c <= F.col("__p"))), F.lit(0))
            ),
        )
        .drop("__cuts", "__p")
    )
    before = Window.partitionBy(*by).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        keyed.groupBy(*by, "__cell")
        .agg(F.count(value).alias("__n"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .withColumn("__all", F.sum("__n").over(Window.partitionBy(*by)))
        .drop("__n")
    )
    local = Window.partitionBy(*by, "__cell").orderBy(key.asc_nulls_last(), F.col(tiebreak).asc())
    out = (
        keyed.withColumn("__local", F.row_number().over(local))
        .join(cells, [*by, "__cell"])
        .withColumn(name, F.when(F.col(value).isNotNull(), (F.col("__local") + F.col("__before")).cast("int")))
    )
    if count is not None:
        out = out.withColumn(count, F.col("__all"))
    return out.drop("__cell", "__local", "__before", "__all")


def global_position(df: DataFrame, order: Sequence[str], name: str = "pos") -> DataFrame:
    """Add ``name`` = 0, 1, ... in one order over all rows, without one task that sees them all: ranges are sorted apart, and each adds
    the number of rows in the ranges before it (one row per range).  The ranges are staged, so both passes see the same ones."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(df.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()))
    before = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = before.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranged.withColumn(name, inside).join(before, "__range").withColumn(name, F.col(name) + F.col("__before") - 1).drop("__range", "__before")


def cross_quantile(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    qs: dict[str, float],
    tiebreak: str = "asset",
    splits: int = 1,
) -> DataFrame:
    """Linear-interpolated quantiles per group, one named column each.

    Small groups use the built-in exact percentile.  With splits the two neighbouring order
    statistics are picked from the distributed rank, so no task holds a whole group.
    """
    by = list(by)
    if splits <= 1:
        return df.groupBy(*by).agg(*[F.percentile(value, q).alias(c) for c, q in qs.items()])
    ranked = cross_rank(df.select(*by, tiebreak, value), by, value, tiebreak, name="_r", count="_m", splits=splits)
    ranked = ranked.filter(F.col("_r").isNotNull())
    aggs: list[Column] = []
    for c, q in qs.items():
        pos = F.lit(q) * (F.col("_m") - 1)
        lo = F.floor(pos)
        frac = pos - lo
        weight = F.when(F.col("_r") == lo + 1, 1 - frac).when(F.col("_r") == lo + 2, frac)
        aggs.append(F.sum(F.when(weight > 0, weight * F.col(value))).alias(c))
    return ranked.groupBy(*by).agg(*aggs)
