"""Calendar work: period labels, dense grids, forward fills and as-of fills.

All fills run inside ``Window.partitionBy(keys)`` where one group is one series, so a group
never holds more rows than the calendar has dates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.session import cut_lineage


def period_label(date: Column, freq: str, anchor: Column | None = None) -> Column:
    """Label of the period a date falls in: the calendar end of the period.

    ``D W 2W M Q Y``.  Weeks end on Sunday.  Two-week bins count from ``anchor``, the first
    Sunday on or after the first date of the data (see :func:`first_sunday`).
    """
    if freq == "D":
        return date
    if freq == "W":
        return F.date_add(date, F.pmod(F.lit(8) - F.dayofweek(date), F.lit(7)).cast("int"))
    if freq == "2W":
        if anchor is None:
            raise ValueError("2W needs the anchor Sunday")
        return F.date_add(anchor, (F.lit(14) * F.ceil(F.datediff(date, anchor) / F.lit(14))).cast("int"))
    if freq == "M":
        return F.last_day(date)
    if freq == "Q":
        return F.last_day(F.make_date(F.year(date), F.quarter(date) * 3, F.lit(1)))
    if freq == "Y":
        return F.make_date(F.year(date), F.lit(12), F.lit(31))
    raise ValueError(f"unknown frequency {freq!r}")


def first_sunday(df: DataFrame, date: str = "date") -> Column:
    """Scalar subquery: first Sunday on or after the earliest date of ``df``."""
    return df.agg(period_label(F.min(date), "W").alias("anchor")).scalar()


def calendar_index(df: DataFrame, date: str = "date", name: str = "t") -> DataFrame:
    """``(date, t)`` with t = 0,1,2,... over the distinct dates.

    The dates travel as one array built by a partial aggregate, so the only thing gathered is
    the calendar itself (a few thousand dates however large the panel is).
    """
    cal = df.agg(F.sort_array(F.collect_set(date)).alias("_cal"))
    return cal.select(F.posexplode("_cal").alias(name, date))


def densify(
    df: DataFrame,
    keys: Sequence[str] = ("asset",),
    date: str = "date",
    full: bool = True,
    static: Sequence[str] = (),
    stage: bool = True,
) -> DataFrame:
    """One row per (key, calendar date); measures are NULL where nothing was quoted.

    The calendar is the distinct dates of ``df``; (key, date) is unique.  Each row fills the
    calendar positions up to the key's next row, so the grid needs one shuffle by key, shared with
    the windows that follow, and neither a cross join nor a join with a spine.  ``full=False``
    starts each key at its own first date.  ``static`` columns depend on the key only and are
    repeated on the filled rows.

    The input is read three times (twice for the calendar), so by default it is staged in the
    checkpoint folder first: what lies below, often one pass over the largest table, then runs once.
    The broadcast side is the calendar itself: one row per date, however many assets there are.
    """
    keys = list(keys)
    if stage:
        df = cut_lineage(df)
    days = df.agg(F.sort_array(F.collect_set(date)).alias("_cal")).scalar()
    x = df.join(F.broadcast(calendar_index(df, date, "__t")), date)
    w = Window.partitionBy(*keys).orderBy("__t")
    last = F.coalesce(F.lead("__t").over(w), F.size(days)) - 1
    start = F.when(F.lag("__t").over(w).isNull(), F.lit(0)).otherwise(F.col("__t")) if full else F.col("__t")
    x = x.withColumn("__lo", start).withColumn("__hi", F.greatest(last, F.col("__t")))
    x = x.withColumn("__pos", F.explode(F.sequence("__lo", "__hi")))
    here = F.col("__pos") == F.col("__t")
    rest = [c for c in df.columns if c not in (*keys, date, *static)]
    return x.select(*keys, F.get(days, F.col("__pos")).alias(date), *static, *[F.when(here, F.col(c)).alias(c) for c in rest])


def densify_books(df: DataFrame, keys: Sequence[str], date: str = "month_end", full: bool = True) -> DataFrame:
    """One row per (key, asset) and date of the key's own calendar; measures are NULL where the book lacks the asset.

    ``full=False`` starts an asset at its own first date. Each row fills the positions up to the asset's next one. Both joins are on
    (key, date), so a book that holds most of all rows is spread over its dates; the calendars have a row per key and date.
    """
    keys = list(keys)
    by = Window.partitionBy(*(keys or [F.lit(0)]))
    own = df.filter(F.col(date).isNotNull()).select(*keys, date).distinct()
    own = own.select("*", F.row_number().over(by.orderBy(date)).alias("_t"), F.count(F.lit(1)).over(by).cast("int").alias("_n"))
    w = Window.partitionBy(*keys, "asset").orderBy("_t")
    x = df.join(own, [*keys, date])
    first = F.when(F.lag("_t").over(w).isNull(), F.lit(1)).otherwise(F.col("_t")) if full else F.col("_t")
    x = x.withColumn("_lo", first).withColumn("_hi", F.greatest(F.coalesce(F.lead("_t").over(w) - 1, F.col("_n")), F.col("_t")))
    rest = [c for c in df.columns if c not in (*keys, "asset", date)]
    here = F.col("_pos") == F.col("_t")
    x = x.withColumn("_pos", F.explode(F.sequence("_lo", "_hi")))
    x = x.select(*keys, "asset", F.col("_pos"), *[F.when(here, F.col(c)).alias(c) for c in rest])
    return x.join(own.select(*keys, date, F.col("_t").alias("_pos")), [*keys, "_pos"]).select(*keys, "asset", date, *rest)


def densify_monthly(
    df: DataFrame, keys: Sequence[str] = ("asset",), month: str = "month_end", static: Sequence[str] = ()
) -> DataFrame:
    """Monthly rows without holes from each key's first to its last month."""
    keys = list(keys)
    spine = (
        df.groupBy(*keys)
        .agg(
            F.min(month).alias("_lo"),
            F.max(month).alias("_hi"),
            *[F.first(c, ignorenulls=True).alias(c) for c in static],
        )
        .withColumn(
            month,
            F.explode(F.sequence(F.trunc("_lo", "MM"), F.trunc("_hi", "MM"), F.expr("interval 1 month"))),
        )
        .withColumn(month, F.last_day(month))
        .drop("_lo", "_hi")
    )
    return spine.join(df.drop(*static), [*keys, month], "left")


def forward_fill(
    df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("asset",), date: str = "date", limit: int | None = None
) -> DataFrame:
    """Carry the last non-null value forward, at most ``limit`` rows."""
    start = Window.unboundedPreceding if limit is None else -limit
    w = Window.partitionBy(*keys).orderBy(date).rowsBetween(start, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def asof_fill(
    spine: DataFrame,
    events: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str] = ("asset",),
    date: str = "date",
    label: str = "label",
    lag: int = 0,
) -> DataFrame:
    """As-of join: on each spine date the last event with ``label <= date``, then ``lag`` rows later.

    Copies whole event rows (NULL measures of the latest event win over older values).  Linear:
    spine and events are unioned and scanned once per key; no range join is planned.
    """
    keys, cols = list(keys), list(cols)
    marked = spine.select(*keys, F.col(date).alias("_d"), F.lit(1).alias("_is_spine"), F.lit(None).alias("_e"))
    ev = events.select(
        *keys, F.col(label).alias("_d"), F.lit(0).alias("_is_spine"), F.struct(*cols).alias("_e")
    )
    marked = marked.withColumn("_e", F.col("_e").cast(ev.schema["_e"].dataType))
    w = Window.partitionBy(*keys).orderBy("_d", "_is_spine")
    out = (
        marked.unionByName(ev)
        .withColumn("_e", F.last("_e", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .filter("_is_spine = 1")
    )
    if lag:
        out = out.withColumn("_e", F.lag("_e", lag).over(Window.partitionBy(*keys).orderBy("_d")))
    return out.select(*keys, F.col("_d").alias(date), *[F.col(f"_e.{c}").alias(c) for c in cols])


def resample_last(
    df: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str] = ("asset",),
    date: str = "date",
    freq: str = "M",
    label: str = "month_end",
    anchor: Column | None = None,
) -> DataFrame:
    """Last non-null value of each column per period (columns may come from different days)."""
    lab = period_label(F.col(date), freq, anchor)
    return df.groupBy(*keys, lab.alias(label)).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(date))).alias(c) for c in cols]
    )
