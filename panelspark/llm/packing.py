"""Packing along a space-filling curve.

Each document's ids are counted in ``HASHED`` hashed dimensions, the unit vector is projected to ``AXES`` coordinates by a fixed random
matrix, and the cell of those coordinates gets its number along the Hilbert curve. Documents are range-sorted by that number, so
neighbours have alike vectors, and each range is cut into sequences of ``size`` tokens without gaps; a document may go on in the next
sequence. The end of a range is cut into sequences of falling powers of two, which need no padding.

Null text counts as empty: its only token is the end id. Repeated rows and null ids are packed as rows of their own; equal keys are
ordered by doc_id. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.chunks import chunks
from panelspark.llm.common import ship, slices, stage

VOCABULARY, END, SIZE = "word_bpe_49k.json", 1, 2048
HASHED, AXES, BITS = 256, 4, 12


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Number along the Hilbert curve of cells [n, axes] with coordinates of ``bits`` bits (Skilling 2004)."""
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(axes):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(set_, q - 1, swap)
            x[i] ^= swap
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        t ^= np.where(x[-1] & q, q - 1, 0)
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def place(documents: list[np.ndarray]) -> np.ndarray:
    """Hilbert keys of documents given by their ids."""
    turn = np.random.default_rng(2).standard_normal((HASHED, AXES)) / np.sqrt(AXES)
    v = np.array([np.bincount((d.astype(np.uint64) * np.uint64(0x9E3779B1) >> np.uint64(7)).astype(np.int64) % HASHED, minlength=HASHED) for d in documents], float).reshape(-1, HASHED)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1)
    cells = np.clip(((v @ turn) + 2) / 4 * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert(cells)


def _ids(path: str, end: int):
    def run(batches):
        enc = chunks(path, "word")
        tail = np.array([end], enc.dtype).tobytes()
        for b in slices(batches, 256):
            ids = [enc.encode(t or "") + tail for t in b.column(1).to_pylist()]
            arrays = [np.frombuffer(x, enc.dtype) for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(place(arrays)), pa.array([len(a) for a in arrays], pa.int64()), pa.array([enc.dtype.itemsize] * len(ids), pa.int32()), pa.array(ids, pa.binary())], names=["doc_id", "curve", "n", "width", "ids"])

    return run


def cut(documents, size: int):
    """(doc, ids) in order -> pieces (doc, start, ids, doc tokens, sequence, offset)."""
    held, filled, sequence = [], 0, 0  # pieces of the open sequence
    for doc, ids in documents:
        start = 0
        while start < len(ids):
            take = min(size - filled, len(ids) - start)
            held.append((doc, start, ids[start : start + take], len(ids)))
            start, filled = start + take, filled + take
            if filled == size:
                at = 0
                for d, s, part, n in held:
                    yield d, s, part, n, sequence, at
                    at += len(part)
                held, filled, sequence = [], 0, sequence + 1
    room, at = 0, 0  # what is left goes to sequences of falling powers of two
    for d, s, part, n in held:
        while len(part):
            if not room:
                room, at = 1 << (filled.bit_length() - 1), 0
            take = min(room, len(part))
            yield d, s, part[:take], n, sequence, at
            part, s, at, room, filled = part[take:], s + take, at + take, room - take, filled - take
            if not room:
                sequence += 1


def _pack(size: int):
    def run(batches):
        base = TaskContext.get().partitionId() << 40

        def documents():
            for b in slices(batches, 256):
                for doc, width, ids in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    yield doc, np.frombuffer(ids, f"<u{width}")

        def batch(rows):
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 7 else pa.int64()) for k, c in enumerate(cols)], names=NAMES)

        rows = []
        for doc, start, part, n, sequence, at in cut(documents(), size):
            raw = part.astype("<u4").tobytes()
            rows.append((doc, start, len(part), zlib.crc32(raw), n, base + sequence, at, raw))
            if len(rows) >= 1024:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)

    return run


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


def pack(docs: DataFrame, tokenizer: str | None = None, end: int = END, size: int = SIZE) -> DataFrame:
    """(doc_id, text) -> pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit)."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    ids = stage(docs.mapInArrow(_ids(tokenizer or public_tokenizers.path(VOCABULARY), end), "doc_id bigint, curve bigint, n bigint, width int, ids binary"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = ids.repartitionByRange(parts, "curve", "doc_id").sortWithinPartitions("curve", "doc_id").select("doc_id", "width", "ids")
    return ranged.mapInArrow(_pack(size), ", ".join(f"{n} {'binary' if n == 'ids' else 'bigint'}" for n in NAMES))
