"""What the operators of this folder share: staging in the cluster's folder, bounded slices of Arrow batches, word hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.session import checkpoint_dir
from panelspark.session import ship_package as ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder of ``spark.checkpoint.dir`` and read it back: the lineage is cut, and what
    several later jobs read is computed once. The files stay until the owner of that folder clears it."""
    path = f"{checkpoint_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Bounded slices, so that Python objects of a few hundred rows live at a time."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


class WordHashes(dict):
    """bytes -> 64-bit hash; the cache is emptied when full, so its memory is bounded."""

    LIMIT = 1 << 20

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        v = self[word] = xxhash.xxh3_64_intdigest(word)
        return v


_HELD: dict = {}


def held(key, make):
    """The one cache of this worker: workers serve stage after stage, and what another stage remembered is let go."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def word_hashes() -> WordHashes:
    return held("words", WordHashes)


def lower_ascii(c):
    """A-Z lower-cased, all other letters as they are."""
    return F.translate(c, UPPER, LOWER)
