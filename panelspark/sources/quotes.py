"""Quote files in and out: wide and long layouts, shape detection, key dedupe, manifests."""

from __future__ import annotations

import ast
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from panelspark.config import FIELD_ROLES, LONG_SCHEMA, OPTION_TENORS, OPTION_TYPES, TICKER_SUFFIXES
from panelspark.functions.stats import clean

LONG_COLUMNS = ("date", "ticker", "field", "value")
DATE_NAMES = ("date", "datetime", "timestamp", "index")


def to_double(c: Column) -> Column:
    """Coerce to double; text that is no number and NaN become NULL."""
    return clean(c.cast("string").try_cast("double"))


def to_date(c: Column) -> Column:
    return c.cast("string").try_cast("timestamp").cast("date")


def date_of(df: DataFrame, name: str) -> Column:
    """Date of a column: text, timestamp or date, or nanoseconds since the epoch (BIGINT)."""
    c = F.col(f"`{name}`")
    return F.timestamp_micros(F.floor(c / 1000)).cast("date") if dict(df.dtypes)[name] == "bigint" else to_date(c)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files with nanosecond timestamps, as pandas writes them, read those as BIGINT."""
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    return spark.read.parquet(path)


def bare_ticker(c: Column) -> Column:
    """Ticker without its market suffix (``AUD Curncy`` -> ``AUD``)."""
    return F.regexp_replace(c, rf" ({'|'.join(TICKER_SUFFIXES)})$", "")


def parse_wide_name(name: str) -> tuple[str, ...]:
    """Levels of a wide column name: ``('T', 'F')`` text, ``T__F``, ``T|F`` or a flat name."""
    if name.startswith("(") and name.endswith(")"):
        try:
            return tuple(str(p) for p in ast.literal_eval(name))
        except (ValueError, SyntaxError):
            return (name,)
    for sep in ("__", "|"):
        if sep in name:
            head, _, tail = name.rpartition(sep)
            return (*head.split(sep), tail) if sep == "|" else (head, tail)
    return (name,)


def date_column(df: DataFrame) -> str:
    """The date column of a frame by its name."""
    low = {c.lower(): c for c in df.columns}
    for n in DATE_NAMES:
        if n in low:
            return low[n]
    for n, c in low.items():
        if "date" in n or n == "__index_level_0__":
            return c
    raise ValueError(f"no date column among {df.columns[:8]}")


def is_long(df: DataFrame) -> bool:
    return {"ticker", "field", "value"} <= {c.lower() for c in df.columns}


def to_long(df: DataFrame, field: str | None = None) -> DataFrame:
    """Any layout to ``(date, ticker, field, value)``.

    Long frames pass through (names in any case).  Wide columns are unpivoted: the last level of
    the name is the field, earlier levels joined with a bar are the ticker, flat names get
    ``UNKNOWN``.  With ``field`` only that field's columns are read, so the scan is pruned.
    """
    dcol = date_column(df)
    if is_long(df):
        by_lower = {c.lower(): c for c in df.columns}
        out = df.select(
            date_of(df, dcol).alias("date"),
            F.col(by_lower["ticker"]).cast("string").alias("ticker"),
            F.col(by_lower["field"]).cast("string").alias("field"),
            to_double(F.col(by_lower["value"])).alias("value"),
        )
        return out if field is None else out.filter(F.col("field") == field)
    cells = []
    for c in df.columns:
        if c == dcol:
            continue
        parts = parse_wide_name(c)
        tick, fld = ("|".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (parts[0], "UNKNOWN")
        if field is None or fld == field:
            cells.append(F.struct(F.lit(tick).alias("ticker"), F.lit(fld).alias("field"), to_double(F.col(f"`{c}`")).alias("value")))
    if not cells:
        raise ValueError(f"no column carries field {field!r}")
    return df.select(date_of(df, dcol).alias("date"), F.explode(F.array(*cells)).alias("c")).select("date", "c.*")


def load_wide(spark: SparkSession, path: str, field: str = "PX_LAST") -> DataFrame:
    """One field of a wide parquet file as ``(date, ticker, value)`` with bare tickers."""
    return select_field(read_parquet(spark, path), field)


def select_field(df: DataFrame, field: str = "PX_LAST") -> DataFrame:
    return to_long(df, field).select("date", bare_ticker(F.col("ticker")).alias("ticker"), "value")


def read_long(spark: SparkSession, base: str) -> tuple[DataFrame, str]:
    """Long quotes from ``base.parquet``, else ``base.csv``; with a status word."""
    for reader, suffix in ((lambda p: read_parquet(spark, p), "parquet"), (lambda p: spark.read.csv(p, header=True), "csv")):
        try:
            df = reader(f"{base}.{suffix}")
        except AnalysisException:
            continue
        missing = [c for c in LONG_COLUMNS if c not in df.columns]
        if missing:
            return empty_long(spark), f"missing columns: {', '.join(missing)}"
        return to_long(df), suffix
    return empty_long(spark), "missing file"


def strict_long(df: DataFrame) -> DataFrame:
    """Fail on a missing column, coerce types, drop rows without key."""
    missing = [c for c in LONG_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    return to_long(df).dropna(subset=["date", "ticker", "field"])


def empty_long(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LONG_SCHEMA)


def safe_read(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """Parquet frame, or an empty long frame with the reason."""
    try:
        return read_parquet(spark, path), "ok"
    except AnalysisException as e:
        return empty_long(spark), e.getCondition() or "unreadable"


FILE_ORDER = ("_file", "_row")


def read_in_order(spark: SparkSession, path: str) -> DataFrame:
    """A parquet file with the place of each row: file name and row number, from Spark's hidden file columns."""
    return read_parquet(spark, path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def normalise_frame(df: DataFrame, order: Sequence[str] = FILE_ORDER) -> DataFrame:
    """Date-keyed numeric wide frame: bad dates dropped, last row per date kept, all-null columns removed.

    "Last" is by ``order``, columns that say where a row stood (see :func:`read_in_order`); they are not part of the result.  The pruning
    reads one aggregate row (a count per column).
    """
    df_cols = [c for c in df.columns if c not in order]
    dcol = date_column(df.select(*[F.col(f"`{c}`") for c in df_cols]))
    flat = {c: "__".join(parse_wide_name(c)) for c in df_cols if c != dcol}
    out = df.select(date_of(df, dcol).alias("date"), *[to_double(F.col(f"`{c}`")).alias(n) for c, n in flat.items()], *order)
    out = keep_last(out.filter("date is not null"), ["date"], *order).drop(*order)
    counts = out.agg(*[F.count(f"`{n}`").alias(n) for n in flat.values()]).first()
    return out.select("date", *[f"`{n}`" for n in flat.values() if counts[n]])


def keep_last(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """Latest row per key by ``order``; one pass with map-side combine, no window over a hot key."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def union_dedupe(chunks: Sequence[DataFrame], keys: Sequence[str] = ("date", "ticker", "field")) -> DataFrame:
    """Stack chunks in load order; a later chunk replaces an earlier one per key."""
    out = None
    for i, c in enumerate(chunks):
        c = c.withColumn("load_seq", F.lit(i))
        out = c if out is None else out.unionByName(c)
    return keep_last(out, list(keys), "load_seq", "value").drop("load_seq")


def split_fields(long: DataFrame, tickers: DataFrame) -> DataFrame:
    """``(date, asset, mid, bid, ask)`` from long quotes and a (ticker, asset) table."""
    q = long.filter(F.col("field").isin(*FIELD_ROLES)).join(tickers.select("ticker", "asset"), "ticker")
    return q.groupBy("date", "asset").agg(
        *[F.max(F.when(F.col("field") == f, F.col("value"))).alias(r) for f, r in FIELD_ROLES.items()]
    )


def require_fields(long: DataFrame) -> None:
    """Raise when none of the known fields occurs."""
    if long.filter(F.col("field").isin(*FIELD_ROLES)).isEmpty():
        raise ValueError(f"none of the fields {list(FIELD_ROLES)} found")


def periodic_rate(df: DataFrame, periods_per_year: float) -> DataFrame:
    """Annual percent yield to a simple rate per period."""
    return df.withColumn("rate", F.col("value") / F.lit(100.0) / F.lit(float(periods_per_year)))


def pivot_last(long: DataFrame, key: str, labels: Sequence[str], value: str = "value", date: str = "date", seq: str | None = None) -> DataFrame:
    """Wide export: one column per label, the last value per cell.  Labels are given, so planning
    needs no distinct pass."""
    agg = F.max(value) if seq is None else F.max_by(value, seq)
    return long.groupBy(date).pivot(key, list(labels)).agg(agg)


def melt(wide: DataFrame, ids: Sequence[str], name: str = "asset", value: str = "value") -> DataFrame:
    cols = [c for c in wide.columns if c not in ids]
    return wide.unpivot(list(ids), cols, name, value)


def stack_groups(groups: Mapping[str, DataFrame]) -> DataFrame:
    """Groups side by side in the long layout: one ``group`` column, no join."""
    out = None
    for g, df in groups.items():
        df = df.withColumn("group", F.lit(g))
        out = df if out is None else out.unionByName(df)
    return out


def save_group(long: DataFrame, path: str, name: str, labels: Sequence[str] | None = None) -> None:
    """Sink: long parquet under ``group=name``, long CSV, and (with labels) the pivoted parquet."""
    long.write.mode("overwrite").parquet(f"{path}/long/group={name}")
    long.write.mode("overwrite").csv(f"{path}/csv/{name}", header=True)
    if labels is not None:
        keyed = long.withColumn("_k", F.concat_ws("__", "ticker", "field"))
        pivot_last(keyed, "_k", labels).write.mode("overwrite").parquet(f"{path}/wide/{name}")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path, header=True) if fmt == "csv" else w.parquet(path)


def unique_keep_order(df: DataFrame, item: str = "item", pos: str = "pos") -> DataFrame:
    """First occurrence of every item, with its position."""
    return df.groupBy(item).agg(F.min(pos).alias(pos))


def read_ticker_csv(spark: SparkSession, path: str) -> DataFrame:
    """User-supplied ticker list: trimmed, blanks dropped, first occurrence kept."""
    df = spark.read.csv(path, header=True)
    col = "ticker" if "ticker" in df.columns else df.columns[0]
    rows = df.select(F.trim(F.col(f"`{col}`")).alias("item"), F.monotonically_increasing_id().alias("pos"))
    return unique_keep_order(rows.filter("item is not null and item <> ''"))


def option_tickers(pairs: DataFrame) -> DataFrame:
    """Every option ticker of each pair: types times tenors, unrolled from literal lists."""
    return (
        pairs.select("option_pair", F.explode(F.array(*map(F.lit, OPTION_TYPES))).alias("code"))
        .withColumn("tenor", F.explode(F.array(*map(F.lit, OPTION_TENORS))))
        .withColumn("ticker", F.concat("option_pair", "code", "tenor", F.lit(" Curncy")))
    )
