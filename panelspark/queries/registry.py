"""Registry of queries; each pairs a Spark plan with SQL for another engine.

Both sides round doubles as ``floor(x * 10^d + 0.5) / 10^d``, which is the same arithmetic in
both engines.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.queries.ctes import compose


@dataclass
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def rounded(c: str | Column, digits: int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    scale = F.lit(float(10**digits))
    return F.floor(c * scale + F.lit(0.5)) / scale


def query(name: str, sql: str | None = None, use: str = "", floats: str = "", digits: int = 8):
    """Register ``fn(spark, sf_dir)``; ``use`` names the shared CTEs of ``sql``."""
    cols = floats.split()

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.withColumns({c: rounded(c, digits) for c in cols}) if cols else df

        full = None
        if sql is not None:
            body = compose(use, sql)
            if cols:
                rep = ", ".join(f"floor({c}*1e{digits}+0.5)/1e{digits} AS {c}" for c in cols)
                body = f"SELECT * REPLACE ({rep}) FROM ({body})"
            full = body
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(run, full)
        return fn

    return wrap
