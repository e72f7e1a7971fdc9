"""Quote conversion, carry, returns and panel assembly (long panels keyed by asset and date)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.config import ANN_DAYS, OPTION_TYPES
from panelspark.functions.calendar import densify, resample_last
from panelspark.functions.stats import div, positive_only


# --- single-row conversions -------------------------------------------------------------------
def invert_quote(value: Column, invert: Column) -> Column:
    """Common direction: 1/value where the native quote runs the other way."""
    return F.when(invert, div(F.lit(1.0), value)).otherwise(value)


def invert_bid_ask(bid: Column, ask: Column, invert: Column) -> tuple[Column, Column]:
    """Inversion swaps the sides: the new bid is 1/ask."""
    new_bid = F.when(invert, div(F.lit(1.0), ask)).otherwise(bid)
    new_ask = F.when(invert, div(F.lit(1.0), bid)).otherwise(ask)
    return new_bid, new_ask


def outright_forward(spot: Column, points: Column, scale: Column) -> Column:
    """Outright = spot + points/scale, in the native quote."""
    return spot + div(points, scale)


def implied_carry(spot: Column, forward: Column, months: int = 1) -> Column:
    """Annualised ln(spot/forward) for quotes in price-per-unit direction."""
    if months <= 0:
        raise ValueError("months must be positive")
    return F.ln(div(spot, forward)) * F.lit(12.0 / months)


def normalise_invalid(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NaN and infinities become NULL."""
    inf = F.lit(float("inf"))
    return df.withColumns({c: F.when(~(F.isnan(c) | (F.abs(c) == inf)), F.col(c)) for c in cols})


# --- returns -----------------------------------------------------------------------------------
def log_return(df: DataFrame, price: str, out: str, keys: Sequence[str] = ("asset",), date: str = "date") -> DataFrame:
    """Difference of logs between consecutive calendar rows; non-positive prices give NULL."""
    w = Window.partitionBy(*keys).orderBy(date)
    p = positive_only(F.col(price))
    return df.withColumn(out, F.ln(p) - F.lag(F.ln(p)).over(w))


def excess_return(
    df: DataFrame,
    spot: str = "spot",
    carry: str = "carry",
    out: str = "xret",
    keys: Sequence[str] = ("asset",),
    date: str = "date",
) -> DataFrame:
    """Spot log return plus one day of the previous row's annual carry."""
    w = Window.partitionBy(*keys).orderBy(date)
    return df.withColumn(
        out,
        F.ln(positive_only(F.col(spot)))
        - F.lag(F.ln(positive_only(F.col(spot)))).over(w)
        + F.lag(carry).over(w) / F.lit(float(ANN_DAYS)),
    )


def convert_quotes(quotes: DataFrame, conv: DataFrame) -> DataFrame:
    """Attach conventions and add ``spot``, ``fwd`` in the common direction (J11, P1, P3)."""
    q = quotes.join(conv, "asset")
    native = outright_forward(F.col("mid"), F.col("points"), F.col("point_scale"))
    return q.withColumns(
        {"spot": invert_quote(F.col("mid"), F.col("invert")), "fwd": invert_quote(native, F.col("invert"))}
    )


def daily_panel(quotes: DataFrame, conv: DataFrame) -> DataFrame:
    """One-call daily panel on the dense calendar: spot, fwd, carry, sret, xret per asset."""
    dense = densify(quotes, ["asset"], "date")
    p = convert_quotes(dense, conv).withColumn("carry", implied_carry(F.col("spot"), F.col("fwd")))
    w = Window.partitionBy("asset").orderBy("date")
    log_spot = F.ln("spot")
    return p.withColumn("sret", log_spot - F.lag(log_spot).over(w)).withColumn(
        "xret", F.col("sret") + F.lag("carry").over(w) / F.lit(float(ANN_DAYS))
    )


def forward_panel(quotes: DataFrame, conv: DataFrame) -> DataFrame:
    """Aligned forward panel in units-per-base direction: logs, discount, excess return, net legs.

    The discount is log forward minus log spot; the return pairs yesterday's forward with
    today's spot.  Net legs cross the spread: long sells the forward bid and buys spot at the
    ask, short the other way round.  Here the direction flips for assets quoted the other way,
    bid and ask swapping on inversion.
    """
    q = densify(quotes, ["asset"], "date").join(conv, "asset")
    flip = ~F.col("invert")
    fwd = {s: outright_forward(F.col(s), F.col("points"), F.col("point_scale")) for s in ("mid", "bid", "ask")}
    spot_bid, spot_ask = invert_bid_ask(F.col("bid"), F.col("ask"), flip)
    fwd_bid, fwd_ask = invert_bid_ask(fwd["bid"], fwd["ask"], flip)
    w = Window.partitionBy("asset").orderBy("date")
    p = q.select(
        "date",
        "asset",
        F.ln(invert_quote(F.col("mid"), flip)).alias("log_spot"),
        F.ln(invert_quote(fwd["mid"], flip)).alias("log_fwd"),
        F.ln(spot_bid).alias("_sb"),
        F.ln(spot_ask).alias("_sa"),
        F.ln(fwd_bid).alias("_fb"),
        F.ln(fwd_ask).alias("_fa"),
    )
    return p.select(
        "date",
        "asset",
        "log_spot",
        "log_fwd",
        (F.col("log_fwd") - F.col("log_spot")).alias("fwd_discount"),
        (F.lag("log_fwd").over(w) - F.col("log_spot")).alias("rx"),
        (F.lag("_fb").over(w) - F.col("_sa")).alias("rx_net_long"),
        (F.col("_sb") - F.lag("_fa").over(w)).alias("rx_net_short"),
    )


RETURN_KINDS = {"excess": "rx", "spot": "log_spot - lag(log_spot) OVER (PARTITION BY asset ORDER BY date)"}


def currency_return(panel: DataFrame, kind: str = "excess") -> DataFrame:
    """Return of a :func:`forward_panel`, by one of ``RETURN_KINDS``: forward-implied or spot."""
    return panel.select("date", "asset", F.expr(RETURN_KINDS[kind]).alias("ret"))


# --- monthly panel -----------------------------------------------------------------------------
def next_month_return(
    df: DataFrame,
    spot: str = "spot",
    fwd: str = "fwd",
    keys: Sequence[str] = ("asset",),
    month: str = "month_end",
) -> DataFrame:
    """Add ``next_spot`` and ``realized`` = next month's spot over this month's forward - 1.

    The next row counts only when it is the very next month, so the panel needs no dense grid.
    """
    w = Window.partitionBy(*keys).orderBy(month)
    nxt = F.lead(F.struct(F.col(month).alias("m"), F.col(spot).alias("s"))).over(w)
    return (
        df.withColumn("_n", nxt)
        .withColumn("next_spot", F.when(F.col("_n.m") == F.last_day(F.add_months(month, 1)), F.col("_n.s")))
        .drop("_n")
        .withColumn("realized", div(F.col("next_spot"), F.col(fwd)) - 1)
    )


def monthly_panel(daily: DataFrame, log_signal: bool = False) -> DataFrame:
    """Last spot and forward per month, carry signal, realised next-month forward return."""
    m = resample_last(daily, ["spot", "fwd"], ["asset"], "date", "M", "month_end")
    ratio = div(F.col("spot"), F.col("fwd"))
    signal = F.ln(ratio) if log_signal else ratio - 1
    return next_month_return(m.filter("spot is not null or fwd is not null")).withColumn("carry_signal", signal)


def daily_tidy_panel(quotes: DataFrame, conv: DataFrame, kinds: DataFrame) -> DataFrame:
    """Tidy daily panel with provenance: outright or points inputs resolved per asset (``kinds``),
    converted to the common direction, non-positive levels removed."""
    q = quotes.join(conv, "asset").join(kinds.select("asset", "forward_type"), "asset")
    q = q.filter(F.col("forward_type").isin("points", "outright"))
    native = F.when(F.col("forward_type") == "outright", F.col("points")).otherwise(
        outright_forward(F.col("mid"), F.col("points"), F.col("point_scale"))
    )
    out = q.select(
        "date",
        "asset",
        "invert",
        F.col("forward_type"),
        F.when(F.col("forward_type") == "points", F.col("point_scale")).alias("point_scale_used"),
        F.col("mid").alias("raw_spot"),
        F.col("points").alias("raw_forward_input"),
        native.alias("raw_forward_outright"),
        invert_quote(F.col("mid"), F.col("invert")).alias("spot"),
        invert_quote(native, F.col("invert")).alias("fwd"),
    )
    return out.filter("spot > 0 and fwd > 0")


def drop_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows per asset before and after cleaning."""
    a = before.groupBy("asset").agg(F.count(F.lit(1)).alias("rows_in"))
    b = after.groupBy("asset").agg(F.count(F.lit(1)).alias("rows_out"))
    return a.join(b, "asset", "left").select(
        "asset",
        "rows_in",
        F.coalesce("rows_out", F.lit(0)).alias("rows_out"),
        (F.col("rows_in") - F.coalesce("rows_out", F.lit(0))).alias("rows_dropped"),
    )


def harmonise(panels: Mapping[str, DataFrame]) -> DataFrame:
    """Stack panels of several classes with logs recomputed and a class column."""
    out = None
    for name, p in panels.items():
        one = p.select(
            "month_end",
            "asset",
            "spot",
            "fwd",
            F.lit(name).alias("asset_class"),
            F.ln(positive_only(F.col("spot"))).alias("log_spot"),
            F.ln(positive_only(F.col("fwd"))).alias("log_fwd"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def expand_samples(
    panel: DataFrame, samples: Mapping[str, Sequence[str]], column: str = "bucket", min_start: Mapping[str, str] | None = None
) -> DataFrame:
    """One copy of a row per named sample its ``column`` value belongs to.

    The membership is a short literal list unrolled per row, so nothing is joined or crossed.
    ``min_start`` drops a sample's rows before a date.
    """
    starts = dict(min_start or {})
    members = [
        F.when(
            F.col(column).isin(*vals) & ((F.col("month_end") >= F.lit(starts[s]).cast("date")) if s in starts else F.lit(True)),
            F.lit(s),
        )
        for s, vals in samples.items()
    ]
    return panel.withColumn("sample", F.explode(F.array_compact(F.array(*members))))


# --- rates, basis, options ---------------------------------------------------------------------
def rate_differential(rates: DataFrame, base: DataFrame, date: str = "date") -> DataFrame:
    """Rate minus the base leg on the same date, both given in percent."""
    b = base.select(date, F.col("rate").alias("_base"))
    return rates.join(b, date).select(
        date, "asset", (F.col("rate") / F.lit(100.0) - F.col("_base") / F.lit(100.0)).alias("rate_diff")
    )


def basis(carry: DataFrame, diff: DataFrame, date: str = "date") -> DataFrame:
    """Implied carry minus rate differential where both exist."""
    return (
        carry.filter("carry is not null")
        .join(diff.filter("rate_diff is not null"), [date, "asset"])
        .select(date, "asset", (F.col("carry") - F.col("rate_diff")).alias("basis"))
    )


def option_points(long: DataFrame, pairs: DataFrame, kind: str, tenor: str = "1M", delta: int = 25) -> DataFrame:
    """Option surface points by asset; risk reversals are turned so that positive = downside rich.

    ``pairs`` = (asset, option_pair, foreign_is_base).
    """
    code = {"ATM": "V", "RR": f"{delta}R", "BF": f"{delta}B"}[kind]
    want = pairs.withColumn("ticker", F.concat("option_pair", F.lit(f"{code}{tenor} Curncy")))
    sign = F.when(F.col("foreign_is_base"), -1.0).otherwise(1.0) if kind == "RR" else F.lit(1.0)
    return (
        long.filter(F.col("field") == "PX_LAST")
        .join(want, "ticker")
        .select("date", "asset", (F.col("value") * sign).alias("value"))
    )


def option_signal_panel(long: DataFrame, pairs: DataFrame, tenor: str = "1M") -> DataFrame:
    """Month-end option measures per asset with foreign-perspective reversals and a quality flag."""
    names = dict(zip(OPTION_TYPES, ("atm_vol", "rr25_raw", "bf25", "rr10_raw", "bf10")))
    pat = F.regexp_extract("ticker", rf"^(.{{6}})(V|25R|25B|10R|10B){tenor} Curncy$", 1)
    code = F.regexp_extract("ticker", rf"^(.{{6}})(V|25R|25B|10R|10B){tenor} Curncy$", 2)
    q = (
        long.filter(F.col("field") == "PX_LAST")
        .select("date", pat.alias("option_pair"), code.alias("code"), "value")
        .filter("code <> '' and value is not null")
        .join(pairs, "option_pair")
    )
    m = q.groupBy(F.last_day("date").alias("month_end"), "asset", "option_pair", "foreign_is_base").agg(
        *[F.max_by("value", F.when(F.col("code") == c, F.col("date"))).alias(n) for c, n in names.items()]
    )
    sign = F.when(F.col("foreign_is_base"), 1).otherwise(-1)
    return (
        m.withColumn("rr_sign", sign)
        .withColumn("rr25_foreign", F.col("rr25_raw") * F.col("rr_sign"))
        .withColumn("rr10_foreign", F.col("rr10_raw") * F.col("rr_sign"))
        .withColumn("bad_skew25", -F.col("rr25_foreign"))
        .withColumn("bad_skew10", -F.col("rr10_foreign"))
        .withColumn(
            "flag",
            F.when(F.col("atm_vol").isNotNull() & F.col("rr25_raw").isNotNull(), "ok").otherwise("partial option data"),
        )
    )


def implied_skew(rr: DataFrame, atm: DataFrame, standardize: bool = True) -> DataFrame:
    """Risk reversal over at-the-money vol (NULL for zero vol)."""
    if not standardize:
        return rr.select("date", "asset", F.col("value").alias("skew"))
    return rr.join(atm.withColumnRenamed("value", "_atm"), ["date", "asset"]).select(
        "date", "asset", div(F.col("value"), F.nullif(F.col("_atm"), F.lit(0.0))).alias("skew")
    )


def factor_changes(df: DataFrame, kinds: Mapping[str, str], keys: Sequence[str] = ("asset",), date: str = "date") -> DataFrame:
    """Log change or level change per series, as configured (``log`` / ``diff``)."""
    w = Window.partitionBy(*keys).orderBy(date)
    logs = [k for k, v in kinds.items() if v == "log"]
    diffs = [k for k, v in kinds.items() if v == "diff"]
    p = positive_only(F.col("value"))
    return df.withColumn(
        "change",
        F.when(F.col(keys[0]).isin(*logs), F.ln(p) - F.lag(F.ln(p)).over(w)).when(
            F.col(keys[0]).isin(*diffs), F.col("value") - F.lag("value").over(w)
        ),
    )


def rebase(df: DataFrame, value: str, out: str = "index", keys: Sequence[str] = ("asset",), date: str = "date", base: float = 100.0) -> DataFrame:
    """Scale each series to ``base`` at its first valid observation."""
    w = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.lit(base) * div(F.col(value), F.first(value, ignorenulls=True).over(w)))


def rebased_basket(df: DataFrame, value: str = "index", group: str = "bucket", date: str = "date") -> DataFrame:
    """Average of the rebased series by date and group."""
    return df.groupBy(date, group).agg(F.avg(value).alias("basket"))


def cost_scenarios(tracks: DataFrame, bps: Sequence[int], notional: str, kind: str, gross: str = "gross") -> DataFrame:
    """Long table of net returns, one row per cost level in basis points."""
    levels = F.explode(F.array(*[F.lit(int(b)) for b in bps]))
    return (
        tracks.withColumn("bps", levels)
        .withColumn("cost", F.col(notional) * F.col("bps") / F.lit(10000.0))
        .withColumn("net", F.col(gross) - F.col("cost"))
        .withColumn("kind", F.lit(kind))
    )
