"""Coverage, audits, label parsing, column discovery and forward-quote diagnostics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.config import (
    FIELD_PRIORITY, FORWARD_MAX_REL_DIFF, FORWARD_MIN_OBS, FORWARD_RATIO_RANGE, FORWARD_SANITY, TICKER_PATTERN,
)
from panelspark.functions.stats import div


def coverage(df: DataFrame, value: str, key: str = "asset", date: str = "date") -> DataFrame:
    """First and last non-null date and the number of non-null values per key."""
    on = F.when(F.col(value).isNotNull(), F.col(date))
    return df.groupBy(key).agg(F.min(on).alias("first_valid"), F.max(on).alias("last_valid"), F.count(value).alias("n_obs"))


def bid_ask_violation(mid: Column, bid: Column, ask: Column) -> Column:
    """True where the sides do not bracket the mid; unknown counts as fine."""
    return F.coalesce(bid > mid, F.lit(False)) | F.coalesce(mid > ask, F.lit(False))


def group_coverage(long: DataFrame, group: str = "group") -> DataFrame:
    """Rows, tickers, fields, range and share of non-null values per group."""
    return long.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("ticker").alias("n_tickers"),
        F.array_join(F.sort_array(F.collect_set("field")), ", ").alias("fields"),
        F.min("date").alias("start"),
        F.max("date").alias("end"),
        (F.avg(F.col("value").isNotNull().cast("double")) * 100).alias("pct_non_null"),
    )


def ticker_coverage(long: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Fields, range, observations and distinct dates per ticker."""
    return long.filter("value is not null").groupBy(*keys).agg(
        F.array_join(F.sort_array(F.collect_set("field")), ", ").alias("fields"),
        F.min("date").alias("start"),
        F.max("date").alias("end"),
        F.count("value").alias("n_obs"),
        F.countDistinct("date").alias("n_dates"),
    )


def file_inventory(spark: SparkSession, data_dir: str, names: Sequence[str]) -> DataFrame:
    """File, size, rows, columns, status.  Sizes come from file listing, rows from footer-only counts."""
    sizes = (
        spark.read.format("binaryFile").load([f"{data_dir}/{n}" for n in names])
        .select(F.element_at(F.split("path", "/"), -1).alias("file"), (F.col("length") / 1e6).alias("size_mb"))
    )
    stats = None
    for n in names:
        df = spark.read.parquet(f"{data_dir}/{n}")
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(n).alias("file"), "n_rows", F.lit(len(df.columns)).alias("n_columns"), F.lit("ok").alias("status"))
        stats = one if stats is None else stats.unionByName(one)
    return stats.join(sizes, "file", "left")


def column_inventory(spark: SparkSession, data_dir: str, names: Sequence[str]) -> DataFrame:
    rows = [(n, c) for n in names for c in spark.read.parquet(f"{data_dir}/{n}").columns]
    return spark.createDataFrame(rows, "file string, column string")


def audit(manifest: DataFrame, long: DataFrame) -> DataFrame:
    """Requested, fetched, missing and extra tickers per group."""
    got = long.filter("value is not null").select("group", "ticker").distinct().withColumn("_got", F.lit(1))
    want = manifest.select("group", "ticker").distinct().withColumn("_want", F.lit(1))
    both = want.join(got, ["group", "ticker"], "full_outer")
    return both.groupBy("group").agg(
        F.count("_want").alias("requested"),
        F.count("_got").alias("fetched"),
        F.count(F.when(F.col("_got").isNull(), 1)).alias("missing"),
        F.count(F.when(F.col("_want").isNull(), 1)).alias("extra"),
    )


def missing_tickers(manifest: DataFrame, long: DataFrame) -> DataFrame:
    return manifest.join(long.filter("value is not null").select("group", "ticker").distinct(), ["group", "ticker"], "left_anti")


def duplicate_keys(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def stale_and_short(long: DataFrame, group: str = "group", stale_days: int = 31, min_obs: int = 252, share: float = 0.10) -> DataFrame:
    """Series ending long before their group does, or with a history far below the median."""
    per = long.filter("value is not null").groupBy(group, "ticker").agg(F.max("date").alias("end"), F.count("value").alias("n_obs"))
    ref = per.groupBy(group).agg(F.max("end").alias("_end"), F.percentile("n_obs", 0.5).alias("_med"))
    out = per.join(ref, group).withColumn("stale", F.col("end") < F.date_sub("_end", stale_days))
    out = out.withColumn("short_history", F.col("n_obs") < F.greatest(F.lit(float(min_obs)), F.col("_med") * share))
    return out.filter("stale or short_history").drop("_end", "_med")


def field_availability(long: DataFrame, assets: DataFrame, tenor: str = "1M") -> DataFrame:
    """Per asset: is there any spot, forward, and both-sided quote?"""
    root = F.regexp_extract("ticker", r"^([A-Z0-9]{3})(\w*) ", 1)
    ten = F.regexp_extract("ticker", r"^([A-Z0-9]{3})(\w*) ", 2)
    q = long.filter("value is not null").select(root.alias("asset"), ten.alias("ten"), "field")
    spot, fwd = F.col("ten") == "", F.col("ten") == tenor
    flags = q.groupBy("asset").agg(
        F.max(spot & (F.col("field") == "PX_LAST")).alias("has_spot"),
        F.max(fwd & (F.col("field") == "PX_LAST")).alias("has_forward"),
        F.max(spot & (F.col("field") == "PX_BID")).alias("_b"),
        F.max(spot & (F.col("field") == "PX_ASK")).alias("_a"),
    )
    no = F.lit(False)
    return assets.select("asset").join(flags, "asset", "left").select(
        "asset", F.coalesce("has_spot", no).alias("has_spot"), F.coalesce("has_forward", no).alias("has_forward"),
        (F.coalesce("_b", no) & F.coalesce("_a", no)).alias("has_bid_ask"),
    )


def parse_label(label: Column) -> dict[str, Column]:
    """Root, tenor (``SPOT`` when absent) and field of an instrument label; NULLs when it does not parse."""
    text = F.upper(F.trim(label))
    ok = text.rlike(TICKER_PATTERN)
    tenor = F.regexp_extract(text, TICKER_PATTERN, 2)
    return {
        "root": F.when(ok, F.regexp_extract(text, TICKER_PATTERN, 1)),
        "tenor": F.when(ok, F.when(tenor == "", "SPOT").otherwise(tenor)),
        "field_name": F.when(ok, F.regexp_extract(text, TICKER_PATTERN, 3)),
    }


def discover_columns(long: DataFrame, aliases: Mapping[str, str] | None = None, min_share: float = 0.50, tenor: str = "1M") -> DataFrame:
    """Best spot and forward label per asset: coverage of at least ``min_share`` of all dates, then
    field priority, then coverage; forward roots may be aliases of the asset."""
    alias = F.col("root")
    for root, asset in (aliases or {}).items():
        alias = F.when(F.col("root") == root, asset).otherwise(alias)
    prio = F.lit(99)
    for f, p in FIELD_PRIORITY.items():
        prio = F.when(F.col("field_name") == f, p).otherwise(prio)
    n_dates = long.agg(F.countDistinct("date").alias("n")).scalar()
    lab = F.concat_ws("__", "ticker", "field")
    cov = (
        long.groupBy(lab.alias("label")).agg((F.count("value") / n_dates).alias("coverage"))
        .withColumns(parse_label(F.col("label")))
        .filter(F.col("root").isNotNull() & (F.col("coverage") >= min_share))
    )
    pick = F.struct(prio.alias("p"), (-F.col("coverage")).alias("c"), F.col("label").alias("label"), F.col("root").alias("root"))
    spot = cov.filter("tenor = 'SPOT'").groupBy(F.col("root").alias("asset")).agg(F.min(pick).alias("s"))
    fwd = cov.filter(F.col("tenor") == tenor).groupBy(alias.alias("asset")).agg(F.min(pick).alias("f"))
    return spot.join(fwd, "asset", "left").select(
        "asset", F.col("s.label").alias("spot_label"), F.col("f.label").alias("forward_label"), F.col("f.root").alias("forward_root"),
        F.when(F.col("f").isNull(), f"missing_{tenor.lower()}_forward").otherwise("ok").alias("status"),
    )


def classify_forward(df: DataFrame, spot: str, forward: str, key: str = "asset") -> DataFrame:
    """Is the forward input an outright or forward points?  One aggregation per asset."""
    j = df.filter(F.col(spot).isNotNull() & F.col(forward).isNotNull())
    d = j.groupBy(key).agg(
        F.count(F.lit(1)).alias("observations"),
        F.percentile(F.col(spot), 0.5).alias("median_spot"),
        F.percentile(F.col(forward), 0.5).alias("median_forward_input"),
        F.percentile(div(F.col(forward), F.col(spot)), 0.5).alias("median_ratio"),
        F.percentile(F.abs(div(F.col(forward) - F.col(spot), F.col(spot))), 0.5).alias("median_abs_rel"),
        F.avg((F.col(forward) < 0).cast("double")).alias("negative_share"),
    )
    lo, hi = FORWARD_RATIO_RANGE
    kind = (
        F.when(F.col("observations") < FORWARD_MIN_OBS, "short")
        .when((F.col("negative_share") == 0) & F.col("median_ratio").between(lo, hi) & (F.col("median_abs_rel") <= FORWARD_MAX_REL_DIFF), "outright")
        .when((F.col("negative_share") > 0) | (F.col("median_abs_rel") > FORWARD_MAX_REL_DIFF), "points")
        .otherwise("ambiguous")
    )
    return d.withColumn("forward_type", kind)


def forward_diagnostics(df: DataFrame, conv: DataFrame, spot: str, forward: str, overrides: Mapping[str, str] | None = None) -> DataFrame:
    """Classification with overrides, the latest converted forward and a sanity check against spot."""
    resolved = F.col("forward_type")
    for a, k in (overrides or {}).items():
        if k in ("points", "outright"):
            resolved = F.when(F.col("asset") == a, k).otherwise(resolved)
    last = df.filter(F.col(spot).isNotNull() & F.col(forward).isNotNull()).groupBy("asset").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.max_by(spot, "date").alias("last_spot"), F.max_by(forward, "date").alias("last_forward"))
    out = classify_forward(df, spot, forward).withColumn("resolved", resolved).join(last, "asset").join(conv, "asset")
    out = out.withColumn("converted", F.when(F.col("resolved") == "outright", F.col("last_forward"))
                         .otherwise(F.col("last_spot") + div(F.col("last_forward"), F.col("point_scale"))))
    out = out.withColumn("converted_over_spot", div(F.col("converted"), F.col("last_spot")))
    ok = F.coalesce((F.col("converted") > 0) & (F.abs(F.col("converted_over_spot") - 1) < FORWARD_SANITY), F.lit(False))
    return out.withColumn("reasonable", ok).withColumn(
        "flag", F.when(ok & F.col("resolved").isin("points", "outright"), "ok").otherwise("review conversion"))


def level_range_check(df: DataFrame, bounds: DataFrame, value: str) -> DataFrame:
    """Do all levels of an asset lie inside its plausible range?"""
    return df.filter(F.col(value).isNotNull()).join(bounds, "asset").groupBy("asset").agg(
        F.min(value).alias("low_seen"), F.max(value).alias("high_seen"),
        F.bool_and(F.col(value).between(F.col("lo"), F.col("hi"))).alias("in_range"))


def month_coverage(panel: DataFrame, value: str) -> DataFrame:
    return panel.groupBy("month_end").agg(
        F.countDistinct(F.when(F.col(value).isNotNull(), F.col("asset"))).alias("n_assets"))


def asset_month_coverage(panel: DataFrame, value: str, stale_months: int = 2) -> DataFrame:
    """Months present, missing against a hole-free month range, and a stale end, per asset.

    Months are bits of words of 64 months, so a task holds a word for each asset and stretch, and no list of (asset, month) pairs."""
    seen = panel.filter(F.col(value).isNotNull())
    last = seen.agg(F.max("month_end").alias("m")).scalar()
    month = F.year("month_end") * 12 + F.month("month_end")
    bit = F.expr("shiftleft(1L, cast(pmod(_month, 64) as int))")
    words = seen.select("asset", "month_end", month.alias("_month")).groupBy("asset", F.floor(F.col("_month") / 64).alias("_word")).agg(
        F.min("month_end").alias("first_month"), F.max("month_end").alias("last_month"), F.bit_or(bit).alias("_bits"))
    per = words.groupBy("asset").agg(
        F.min("first_month").alias("first_month"), F.max("last_month").alias("last_month"), F.coalesce(F.sum(F.bit_count("_bits")), F.lit(0)).cast("long").alias("months"))
    expect = F.months_between("last_month", "first_month").cast("int") + 1
    return per.select(
        "asset", "first_month", "last_month", "months", (expect - F.col("months")).cast("long").alias("missing_months"),
        (F.col("last_month") < F.last_day(F.add_months(last, -stale_months))).alias("stale_end"))


def missing_months(panel: DataFrame, value: str) -> DataFrame:
    """The missing (asset, month) pairs themselves."""
    seen = panel.filter(F.col(value).isNotNull()).select("asset", "month_end")
    spine = seen.groupBy("asset").agg(F.min("month_end").alias("a"), F.max("month_end").alias("b")).select(
        "asset", F.explode(F.sequence(F.trunc("a", "MM"), F.trunc("b", "MM"), F.expr("interval 1 month"))).alias("m"))
    return spine.select("asset", F.last_day("m").alias("month_end")).join(seen, ["asset", "month_end"], "left_anti")


def asset_summary(panel: DataFrame, signal: str, ret: str) -> DataFrame:
    return panel.groupBy("asset").agg(
        F.count(F.lit(1)).alias("months"), F.avg(signal).alias("avg_signal"), F.avg(ret).alias("avg_return"),
        (F.count(F.lit(1)) - F.count(signal)).alias("missing_signal"), (F.count(F.lit(1)) - F.count(ret)).alias("missing_return"))


def data_card(panel: DataFrame, value: str, bucket: str = "bucket") -> DataFrame:
    """Bucket, first and last date, share of the calendar with a value, per asset."""
    n = panel.select("date").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    on = F.when(F.col(value).isNotNull(), F.col("date"))
    return panel.groupBy("asset", bucket).agg(F.min(on).alias("start"), F.max(on).alias("end"), (F.count(value) * 100.0 / n).alias("coverage_pct"))


def usable_features(long: DataFrame, key: str = "ticker", value: str = "value", min_share: float = 0.60, min_distinct: int = 3) -> DataFrame:
    """Keep the series with enough coverage and more than two distinct values."""
    n = long.agg(F.countDistinct("date").alias("n")).scalar()
    keep = long.groupBy(key).agg((F.count(value) / n).alias("_c"), F.countDistinct(value).alias("_d"))
    return long.join(keep.filter((F.col("_c") >= min_share) & (F.col("_d") >= min_distinct)).select(key), key, "left_semi")


def carry_validation(panel: DataFrame, value: str = "carry") -> DataFrame:
    return panel.filter(F.col(value).isNotNull()).groupBy("asset").agg(
        F.percentile(value, 0.5).alias("median"), F.percentile(value, 0.05).alias("p05"), F.percentile(value, 0.95).alias("p95"), F.count(value).alias("n"))


def option_diagnostics(signals: DataFrame) -> DataFrame:
    return signals.groupBy("asset", "foreign_is_base").agg(
        F.avg("atm_vol").alias("avg_atm_vol"), F.avg("rr25_raw").alias("avg_rr25_raw"), F.avg("rr25_foreign").alias("avg_rr25_foreign"),
        F.avg("bad_skew25").alias("avg_bad_skew25"), F.count(F.lit(1)).alias("months"),
        (F.count(F.lit(1)) - F.count("atm_vol")).alias("missing_atm"),
        F.min("month_end").alias("first_month"), F.max("month_end").alias("last_month"))
