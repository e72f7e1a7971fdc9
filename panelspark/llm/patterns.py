"""Best-fit packing by length patterns.

Texts of more than ``size`` ids are cut into pieces of ``size``; no other is cut. What is left to decide is which lengths share a
sequence, and that depends on the histogram of lengths alone, at most ``size`` numbers whatever the corpus:

* Patterns of few documents that fill a sequence exactly are enumerated: two or three lengths, or several of one length and one more.
* Repeat counts are fitted to the histogram by non-negative least squares, column by column: patterns with the steepest gradient
  enter, multiplicative updates keep the counts non-negative, patterns that fade leave.
* Counts are rounded, largest first, to what is still there; patterns that whole documents can still fill are taken greedily.
* The residual goes by best fit, longest first, on the histogram: equal bins are one entry with a count, so the work does not grow
  with the documents.

The plan is a short table of runs (the documents number ``rank`` to ... of a length go to sequences from ..., so many each, at an offset).
Documents of a length are numbered by two passes: each task numbers its own, a running total over tasks adds what came before; no length,
however common, is gathered anywhere. Every piece then finds its run by a join.

Null text counts as empty: its only id is the end. Repeated rows and null ids are pieces of rows of their own. Other columns are ignored.
An empty table gives no pieces.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.chunks import chunks
from panelspark.llm.common import ship, slices, stage

VOCABULARY, END, SIZE = "word_bpe_49k.json", 0, 2048
#: Fitting: rounds of new patterns, patterns a round, uses of a length a round, updates a round.
ROUNDS, ENTER, USES, UPDATES = 48, 384, 6, 60


def _pieces(path: str, end: int, size: int):
    def run(batches):
        enc = chunks(path, "word")
        tail = np.array([end], enc.dtype).tobytes()
        width, met, part = enc.dtype.itemsize, np.zeros(size + 1, np.int64), TaskContext.get().partitionId()
        for b in slices(batches, 128):
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = enc.encode(text or "") + tail
                for piece, at in enumerate(range(0, len(raw), size * width)):
                    own = raw[at : at + size * width]
                    n = len(own) // width
                    rows.append((part, doc, piece, at // width, n, int(met[n]), np.frombuffer(own, enc.dtype).astype("<u4").tobytes()))
                    met[n] += 1
                    if len(rows) == 256:
                        yield _batch(rows)
                        rows = []
            if rows:
                yield _batch(rows)

    return run


PIECES = {"part": "int", "doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "nth": "bigint", "ids": "binary"}
_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, t in zip(zip(*rows, strict=True), PIECES.values(), strict=True)], names=list(PIECES))


def exact_patterns(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All patterns over ``lengths`` that fill ``size``: (lengths [p, 3], how often each [p, 3]), unused places 0."""
    have = np.zeros(size + 1, bool)
    have[lengths] = True
    found, times = [np.zeros((0, 3), np.int64)], [np.zeros((0, 3), np.int64)]

    def add(cols, often):
        n = max(len(c) for c in cols)
        found.append(np.stack([np.broadcast_to(np.asarray(c, np.int64), n) for c in cols], axis=1))
        times.append(np.stack([np.broadcast_to(np.asarray(c, np.int64), n) for c in often], axis=1))

    short = lengths[2 * lengths < size]
    short = short[have[size - short]]
    if len(short):
        add((size - short, short, 0 * short), (1, 1, 0))
    for i in lengths[3 * lengths < size].tolist():  # i < j < k
        j = lengths[(lengths > i) & (2 * lengths < size - i)]
        k = size - i - j
        j = j[have[k]]
        if len(j):
            add((size - i - j, j, [i]), (1, 1, 1))
    for i in lengths.tolist():  # several of one length, and at most one more
        a = np.arange(2, size // i + 1)
        r = size - a * i
        a, r = a[have[r] | (r == 0)], r[have[r] | (r == 0)]
        a, r = a[r != i], r[r != i]
        if len(a):
            add((np.where(r == 0, 0, r), [i], 0 * a), (r > 0, a, 0))
    return np.concatenate(found), np.concatenate(times)


def fit(hist: np.ndarray, lengths: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns that bring A x near the histogram; long documents, which are hard to place, weigh more."""
    size = len(hist) - 1
    weight = np.arange(size + 1) / size
    h = hist.astype(float)
    x, active = np.zeros(len(lengths)), np.zeros(0, np.int64)
    norm = np.sqrt((weight[lengths] * times**2).sum(axis=1))
    left = h.copy()
    for _ in range(ROUNDS):
        gain = (times * (weight * left)[lengths]).sum(axis=1) / norm
        order = np.argsort(-gain)[: 8 * ENTER]
        order = order[gain[order] > 1e-3]
        used, enter = np.zeros(size + 1, np.int64), []
        for p in order.tolist():
            ls = lengths[p][times[p] > 0]
            if (used[ls] < USES).all():
                used[ls] += 1
                enter.append(p)
                if len(enter) == ENTER:
                    break
        if not enter:
            break
        new = np.setdiff1d(enter, active)
        can = np.where(times[new] > 0, h[lengths[new]] / np.maximum(times[new], 1), np.inf).min(axis=1)
        x[new] = np.maximum(can / 8, 0.05)
        active = np.union1d(active, new)
        ls, ts = lengths[active], times[active]
        wanted = (ts * (weight * h)[ls]).sum(axis=1)
        for _ in range(UPDATES):
            ax = np.bincount(ls.ravel(), (ts * x[active, None]).ravel(), size + 1)
            x[active] *= wanted / np.maximum((ts * (weight * ax)[ls]).sum(axis=1), 1e-12)
        gone = x[active] < 0.02
        x[active[gone]] = 0
        active = active[~gone]
        left = h - np.bincount(lengths[active].ravel(), (times[active] * x[active, None]).ravel(), size + 1)
        left[0] = 0
    return x


class Plan:
    """Runs (length, rank_from, rank_to, sequence, each, offset): rank r goes to sequence + (r - rank_from) // each, at offset +
    length * ((r - rank_from) % each)."""

    def __init__(self, hist: np.ndarray):
        self.left, self.next = hist.astype(np.int64).copy(), np.zeros(len(hist), np.int64)
        self.size, self.sequences, self.runs = len(hist) - 1, 0, []

    def place(self, length: int, count: int, each: int, sequence: int, offset: int) -> None:
        """``each`` documents of a length in each of ``count`` sequences."""
        at = int(self.next[length])
        self.runs.append((length, at, at + count * each, sequence, each, offset))
        self.next[length] += count * each
        self.left[length] -= count * each

    def open(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def repeat(self, lengths, times, count: int) -> None:
        """``count`` sequences of a pattern, or as many as there are documents for."""
        count = min([count, *(int(self.left[n]) // t for n, t in zip(lengths, times, strict=True))])
        if count > 0:
            first, offset = self.open(count), 0
            for n, t in zip(lengths, times, strict=True):
                self.place(n, count, t, first, offset)
                offset += n * t

    def best_fit(self) -> None:
        """Longest first, each into the fullest bin that has room; bins alike are one entry (first sequence, count) under their room."""
        rooms, bins = [], {}

        def put(room, first, count):
            if room and count:
                if room not in bins:
                    bins[room] = []
                    bisect.insort(rooms, room)
                bins[room].append((first, count))

        for n in range(self.size, 0, -1):
            while left := int(self.left[n]):
                k = bisect.bisect_left(rooms, n)
                if k == len(rooms):
                    each = self.size // n
                    room, first, count = self.size, self.open(max(left // each, 1)), max(left // each, 1)
                else:
                    room = rooms[k]
                    first, count = bins[room].pop()
                    if not bins[room]:
                        del bins[room], rooms[k]
                each = min(room // n, left)
                full = min(count, left // each)
                self.place(n, full, each, first, self.size - room)
                put(room - each * n, first, full)
                put(room, first + full, count - full)


def plan(hist: np.ndarray) -> Plan:
    """``hist[n]``: how many pieces have length n."""
    out = Plan(hist)
    size = out.size
    out.repeat([size], [1], int(hist[size]))
    lengths = np.nonzero(hist[:size])[0]
    lengths = lengths[lengths > 0]
    found, times = exact_patterns(lengths, size)
    if len(found):
        x = fit(np.concatenate([hist[:size], [0]]), found, times)

        def take(p, count):
            ok = times[p] > 0
            out.repeat(found[p][ok].tolist(), times[p][ok].tolist(), count)

        for p in np.argsort(-x)[: np.count_nonzero(x >= 0.5)].tolist():
            take(p, int(x[p] + 0.5))
        can = np.nonzero(((out.left[found] >= times) | (times == 0)).all(axis=1))[0]
        for p in can[np.argsort(-found[can].max(axis=1), kind="stable")].tolist():
            if (out.left[found[p]] >= times[p]).all():
                take(p, int(hist.sum()))
    out.best_fit()
    return out


def pieces(docs: DataFrame, tokenizer: str | None = None, end: int = END, size: int = SIZE) -> DataFrame:
    """(doc_id, text) -> staged pieces: part (task), doc_id, piece, start, length, nth (of its length in the task), ids."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return stage(docs.mapInArrow(_pieces(tokenizer or public_tokenizers.path(VOCABULARY), end, size), ", ".join(f"{c} {t}" for c, t in PIECES.items())))


def pack(docs: DataFrame, tokenizer: str | None = None, end: int = END, size: int = SIZE) -> DataFrame:
    """(doc_id, text) -> doc_id, piece, start, length, sequence_id, offset, ids (little-endian unsigned 32-bit)."""
    spark = docs.sparkSession
    cut = pieces(docs, tokenizer, end, size)
    counts = stage(cut.groupBy("part", "length").agg(F.count("*").alias("n")))
    hist = np.zeros(size + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``size`` rows
        hist[r.length] = r.n
    runs = plan(hist).runs
    before = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("_before"))
    # Every bin of a room at least halves it when it takes documents, and a length opens two kinds of bins: the runs are bounded by ``size``.
    table = F.broadcast(spark.createDataFrame([(int(a), int(b), int(c), int(d), int(e), int(f)) for a, b, c, d, e, f in runs], "length bigint, _from bigint, _to bigint, _sequence bigint, _each bigint, _offset bigint"))
    ranked = cut.join(before, ["part", "length"]).withColumn("_rank", F.col("nth") + F.col("_before"))
    placed = ranked.join(table, (ranked["length"] == table["length"]) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))).drop(table["length"])
    at = F.expr("_sequence + (_rank - _from) div _each"), F.expr("_offset + length * ((_rank - _from) % _each)")
    return placed.select("doc_id", "piece", "start", "length", at[0].alias("sequence_id"), at[1].alias("offset"), "ids")


def sequences(packed: DataFrame) -> DataFrame:
    """Pieces -> one row a sequence: sequence_id, doc_ids, ids; at most ``size`` ids, so a group is bounded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    joined = packed.groupBy("sequence_id").agg(parts.alias("p"))
    return joined.select("sequence_id", F.col("p.doc_id").alias("doc_ids"), F.expr("aggregate(p, X'', (a, b) -> concat(a, b.ids))").alias("ids"))
