"""Order statistics of trailing windows at a cost per row that does not grow with the window.

A sorted window that slides would be updated row by row; here all windows of a stretch of rows are asked at once. The stretch's values are
kept as a wavelet matrix: for every bit of their ranks, highest first, how many zeros stand before each place, the sequence then being
parted into zeros and ones. A range of places is followed down the levels with two lookups each, which tells how many of its values are
smaller than one of them, how many equal it, and which is the k-th smallest.

Rows arrive sorted within their series; a stretch is one Arrow batch and the ``window - 1`` rows before it, so memory is bounded whatever
the length of a series or of the window's past.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


class WaveletMatrix:
    def __init__(self, x: np.ndarray):
        self.values, rank = np.unique(x, return_inverse=True)
        self.rank = rank
        self.bits = max(len(self.values) - 1, 1).bit_length()
        self.zeros = []
        for b in range(self.bits - 1, -1, -1):
            one = (rank >> b & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]))
            rank = np.concatenate([rank[~one], rank[one]])

    def _down(self, zeros: np.ndarray, lo: np.ndarray, hi: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, z = zeros[lo], zeros[hi]
        return np.where(right, zeros[-1] + lo - a, a), np.where(right, zeros[-1] + hi - z, z)

    def below(self, lo: np.ndarray, hi: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many values of places [lo, hi) have a smaller rank, and how many the same."""
        less = np.zeros(len(lo), np.int64)
        for level, zeros in enumerate(self.zeros):
            right = (rank >> (self.bits - 1 - level) & 1).astype(bool)
            less += np.where(right, zeros[hi] - zeros[lo], 0)
            lo, hi = self._down(zeros, lo, hi, right)
        return less, hi - lo

    def smallest(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) of places [lo, hi)."""
        rank = np.zeros(len(lo), np.int64)
        for level, zeros in enumerate(self.zeros):
            left = zeros[hi] - zeros[lo]
            right = k >= left
            k = np.where(right, k - left, k)
            rank |= right.astype(np.int64) << (self.bits - 1 - level)
            lo, hi = self._down(zeros, lo, hi, right)
        return self.values[rank]


Answer = Callable[[WaveletMatrix, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def percentile_rank(min_periods: int) -> Answer:
    """Average rank of the current value in its window, over the number of values; where the row has a value."""

    def ask(m, lo, hi, own):
        ok = (own >= 0) & (hi - lo >= max(min_periods, 1))
        less, same = m.below(lo[ok], hi[ok], m.rank[own[ok]])
        out = np.zeros(len(lo))
        out[ok] = (less + (same + 1) / 2) / (hi - lo)[ok]
        return out, ok

    return ask


def quantile(q: float, min_periods: int) -> Answer:
    """Linear-interpolated quantile of the window."""

    def ask(m, lo, hi, own):
        ok = hi - lo >= max(min_periods, 1)
        a, z = lo[ok], hi[ok]
        at = q * (z - a - 1)
        k = np.floor(at).astype(np.int64)
        low = m.smallest(a, z, k)
        high = np.where(at > k, m.smallest(a, z, np.minimum(k + 1, z - a - 1)), low)
        out = np.zeros(len(lo))
        with np.errstate(invalid="ignore"):
            out[ok] = np.where(at > k, (k + 1 - at) * low + (at - k) * high, low)
        return out, ok

    return ask


def trailing_order(df: DataFrame, value: str, window: int, ask: Answer, out: str, keys: Sequence[str], date: str) -> DataFrame:
    """Add ``out``, an order statistic over the last ``window`` rows of each series; rows without a value count as rows only."""
    numbered = df.withColumn("__row", F.row_number().over(Window.partitionBy(*keys).orderBy(date))).withColumn("__v", F.col(value).cast("double"))
    fields = [f for f in df.schema.fields if f.name != out]
    schema = StructType([*fields, StructField(out, DoubleType())])

    def run(batches):
        held = np.zeros(0)
        has = np.zeros(0, bool)
        for b in batches:
            v = b.column(b.schema.get_field_index("__v"))
            row = b.column(b.schema.get_field_index("__row")).to_numpy(zero_copy_only=False).astype(np.int64)
            known = v.is_valid().to_numpy(zero_copy_only=False)
            x = np.concatenate([held, v.fill_null(0.0).to_numpy(zero_copy_only=False)])
            ok = np.concatenate([has, known])
            place = np.arange(len(held), len(x))
            before = np.concatenate([[0], np.cumsum(ok)])
            lo, hi = before[np.maximum(place - np.minimum(window, row) + 1, 0)], before[place + 1]
            own = np.where(known, before[place], -1)
            if ok.any():
                got, there = ask(WaveletMatrix(x[ok]), lo, hi, own)
            else:
                got, there = np.zeros(len(place)), np.zeros(len(place), bool)
            keep = [b.column(b.schema.get_field_index(f.name)) for f in fields]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(got, pa.float64(), mask=~there)], names=[f.name for f in schema.fields])
            held, has = x[max(len(x) - window + 1, 0) :], ok[max(len(x) - window + 1, 0) :]

    return numbered.mapInArrow(run, schema)
