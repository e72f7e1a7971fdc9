"""Token-id files: ids of whole documents in ascending doc_id order, compressed by the coder in independent blocks.

A file set is a Parquet table written by Spark (so any store works and retries commit once) with a row per segment: ``part`` (number of
the id range), ``segment`` (number inside it), ``first`` (ids of the part before the segment), ``n_ids`` and ``blob``. A blob is

    magic "TIDB", version, id of the document end (u32 each), documents, blocks, ids a block (u32 each),
    per document: doc_id (i64), 1 if the id is null (u8), ids (u64), per block: ids, 16-bit words, crc32 of its ids as little-endian
    u32 (u32 each), bytes that follow (u32), deflated shares of the ids for order 0 (those of the segment's ids that no other order
    predicts: how many, the ids as u16, their shares as u32), crc32 of all of the above (u32), then the words of the blocks.

All little-endian. Every block is coded from a fresh state, read with nothing but those shares, and checked when read. Null text counts as empty (its only id is the end).
Order: null ids first, then ascending, equal ids by the text's hash. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.llm import coder
from panelspark.llm.chunks import chunks
from panelspark.llm.common import ship, slices

VOCABULARY, END = "byte_bpe_50k.json", 2
SEGMENT_IDS = 2048 * coder.BLOCK
_HEAD = struct.Struct("<4sIIIII")


def pack_segment(docs: list[int | None], sizes: list[int], ids: np.ndarray, end: int = END, block: int = coder.BLOCK) -> bytes:
    parts = [ids[k : k + block] for k in range(0, len(ids), block)]
    share, words = coder.encode_shared(parts)
    table = np.zeros(len(docs), [("d", "<i8"), ("z", "u1"), ("n", "<u8")])
    table["d"], table["z"], table["n"] = [d or 0 for d in docs], [d is None for d in docs], sizes
    index = np.array([(len(p), len(w), zlib.crc32(p.astype("<u4").tobytes())) for p, w in zip(parts, words, strict=True)], "<u4").reshape(-1, 3)
    met = np.flatnonzero(share)
    shares = zlib.compress(struct.pack("<I", len(met)) + met.astype("<u2").tobytes() + share[met].astype("<u4").tobytes())
    head = _HEAD.pack(b"TIDB", 2, end, len(docs), len(parts), block) + table.tobytes() + index.tobytes() + struct.pack("<I", len(shares)) + shares
    return b"".join([head, struct.pack("<I", zlib.crc32(head)), *(w.astype("<u2").tobytes() for w in words)])


def unpack_segment(blob: bytes) -> tuple[list[int | None], list[int], np.ndarray]:
    magic, version, _, n_docs, n_blocks, _ = _HEAD.unpack_from(blob)
    if magic != b"TIDB" or version != 2:
        raise ValueError("not a token-id segment")
    kind = np.dtype([("d", "<i8"), ("z", "u1"), ("n", "<u8")])
    table = np.frombuffer(blob, kind, n_docs, _HEAD.size)
    at = _HEAD.size + n_docs * kind.itemsize
    index = np.frombuffer(blob, "<u4", 3 * n_blocks, at).reshape(-1, 3)
    at += 12 * n_blocks
    size = struct.unpack_from("<I", blob, at)[0] if at + 4 <= len(blob) else len(blob)
    at += 4 + size
    if at + 4 > len(blob) or struct.unpack_from("<I", blob, at)[0] != zlib.crc32(blob[:at]):
        raise ValueError("damaged segment header")
    shares = zlib.decompress(blob[at - size : at])
    n_met = struct.unpack_from("<I", shares)[0]
    share = np.zeros(1 << 16, np.int64)
    share[np.frombuffer(shares, "<u2", n_met, 4)] = np.frombuffer(shares, "<u4", n_met, 4 + 2 * n_met)
    words, at = [], at + 4
    for _, w, _ in index.tolist():
        words.append(np.frombuffer(blob, "<u2", w, at))
        at += 2 * w
    parts = coder.decode(words, index[:, 0].tolist(), share)
    for k, (p, (_, _, crc)) in enumerate(zip(parts, index.tolist(), strict=True)):
        if zlib.crc32(p.astype("<u4").tobytes()) != crc:
            raise ValueError(f"damaged block {k}")
    return [None if z else d for d, z in zip(table["d"].tolist(), table["z"].tolist(), strict=True)], table["n"].tolist(), np.concatenate([*parts, np.zeros(0, np.int64)])


def _write(path: str, end: int, limit: int):
    def run(batches):
        enc = chunks(path, "byte")
        if enc.dtype.itemsize != 2:
            raise ValueError("the coder takes ids below 65,536")
        tail = np.array([end], enc.dtype).tobytes()
        part, segment, first = TaskContext.get().partitionId(), 0, 0
        docs, sizes, held, count = [], [], [], 0

        def row():
            blob = pack_segment(docs, sizes, np.frombuffer(b"".join(held), enc.dtype).astype(np.int64), end)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([first], pa.int64()), pa.array([count], pa.int64()), pa.array([blob], pa.binary())], names=["part", "segment", "first", "n_ids", "blob"])

        for b in slices(batches, 128):
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = enc.encode(t or "") + tail
                if docs and count + len(raw) // 2 > limit:
                    yield row()
                    segment, first = segment + 1, first + count
                    docs, sizes, held, count = [], [], [], 0
                docs.append(d)
                sizes.append(len(raw) // 2)
                held.append(raw)
                count += len(raw) // 2
        if docs:
            yield row()

    return run


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END, segment_ids: int = SEGMENT_IDS) -> None:
    """(doc_id, text) -> token-id files at ``path``."""
    spark = docs.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h").select("doc_id", "text")
    rows = ordered.mapInArrow(_write(tokenizer or public_tokenizers.path(VOCABULARY), end, segment_ids), "part int, segment int, first bigint, n_ids bigint, blob binary")
    rows.write.option("compression", "uncompressed").option("parquet.block.size", 1 << 24).parquet(path)


def _read(batches):
    for b in slices(batches, 1):
        (part,), (first,), (blob,) = (b.column(i).to_pylist() for i in range(3))
        docs, sizes, ids = unpack_segment(blob)
        raw = ids.astype("<u4").tobytes()
        at = np.concatenate([[0], np.cumsum(sizes)]).astype(int).tolist()
        for k in range(0, len(docs), 512):
            upto = min(k + 512, len(docs))
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * (upto - k), pa.int32()), pa.array(docs[k:upto], pa.int64()), pa.array([first + x for x in at[k:upto]], pa.int64()), pa.array(sizes[k:upto], pa.int64()), pa.array([raw[4 * x : 4 * y] for x, y in zip(at[k:upto], at[k + 1 : upto + 1], strict=True)], pa.binary())],
                names=["part", "doc_id", "inside", "n_tokens", "ids"],
            )


def read(spark: SparkSession, path: str) -> DataFrame:
    """Token-id files -> doc_id, start (ids of all documents before), n_tokens, ids (little-endian unsigned 32-bit)."""
    ship(spark)
    rows = spark.read.schema("part int, segment int, first bigint, n_ids bigint, blob binary").parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each id range
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    docs = rows.select("part", "first", "blob").mapInArrow(_read, "part int, doc_id bigint, inside bigint, n_tokens bigint, ids binary")
    return docs.join(F.broadcast(before), "part").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids")
