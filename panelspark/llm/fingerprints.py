"""Document fingerprints from closed syncmers.

Of all k-mers of a text (code points), those are kept whose smallest inner s-mer, by hash, stands first or last. Whether a k-mer is
kept depends on itself alone, so the same passage gives the same anchors in any document; ``anchors`` returns them with their
positions. ``sketch`` condenses the anchors of a text into ``BINS`` bins (the smallest 16-bit value of each, written as hex; ffff is
an empty bin), and ``likeness`` is the share of equal bins among those that either side fills, an estimate of the anchors' Jaccard
similarity. A text without anchors (shorter than k) has one: the hash of the whole text.

Null text counts as empty. Order of documents: descending doc_id, null ids last, equal ids by descending hash of the text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import ship, slices

S, K, BINS = 8, 24, 64
EMPTY = 0xFFFF
_B = np.uint64(0x9E3779B97F4A7C15)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_B), n, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def syncmers(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, hash of the k-mer) of all closed syncmers."""
    raw = [np.frombuffer(t.encode("utf-32-le"), "<u4") for t in texts]
    ends = np.cumsum([len(r) for r in raw]) if raw else np.zeros(0, int)
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    if not raw or ends[-1] < K:
        return none
    h, grams = _mix(np.concatenate(raw).astype(np.uint64) + np.uint64(1)), {}
    for n in (1, 2, 4, 8):  # hashes of 2, 4, 8, 16 code points
        h = grams[2 * n] = h[:-n] * _power(n) + h[n:]
    eight = grams[S]
    full = grams[K - S][: len(eight) - (K - S)] * _power(S) + eight[K - S :]
    order = _mix(eight)
    low = order
    for step in (1, 2, 4, 8, 1):  # smallest of 17 neighbours
        low = np.minimum(low[:-step], low[step:])
    w = len(low)
    at = np.flatnonzero((order[:w] == low) | (order[K - S : K - S + w] == low))
    doc = np.searchsorted(ends, at, side="right")
    inside = at + K <= ends[doc]
    at, doc = at[inside], doc[inside]
    first = ends[doc] - np.array([len(r) for r in raw])[doc]
    return doc, at - first, _mix(full[at])


def sketch(texts: list[str]) -> np.ndarray:
    """One row of BINS values for each text."""
    out = np.full((len(texts), BINS), EMPTY, np.uint16)
    doc, _, h = syncmers(texts)
    np.minimum.at(out, (doc, (h >> np.uint64(58)).astype(np.int64)), np.minimum((h >> np.uint64(20)) & np.uint64(0xFFFF), EMPTY - 1).astype(np.uint16))
    for i in np.flatnonzero((out == EMPTY).all(axis=1)):
        v = xxhash.xxh3_64_intdigest(texts[i].encode())
        out[i, v >> 58] = min((v >> 20) & 0xFFFF, EMPTY - 1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    filled = (a != EMPTY) | (b != EMPTY)
    return ((a == b) & filled).sum(axis=-1) / np.maximum(filled.sum(axis=-1), 1)


def _anchor_rows(batches):
    for b in slices(batches, 64):
        doc, at, h = syncmers([t or "" for t in b.column(1).to_pylist()])
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(at, pa.int64()), pa.array(h.view(np.int64))], names=["doc_id", "position", "anchor"])


def anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> a row (doc_id, position, anchor) for each closed syncmer, for positional matching."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_anchor_rows, f"doc_id {kind}, position bigint, anchor bigint")


def _fingerprint_rows(batches):
    for b in slices(batches, 64):
        rows = sketch([t or "" for t in b.column(1).to_pylist()])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.astype(">u2").tobytes().hex() for r in rows], pa.string())], names=["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, fingerprint)."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_fingerprint_rows, f"doc_id {kind}, fingerprint string")


def beside_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, extra, o, doc_id, text) such that, sorted by bucket, extra, o and text hash descending, each row stands before its
    successor: ids are cut into ranges of equal counts, and the first row of each range is copied (extra = 1) to the end of the range
    that precedes it; the very first row follows the very last. Only one id for each range passes through the driver."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("o"))
    cuts = rows.agg(F.percentile_approx("o", [i / parts for i in range(1, parts)], 100 * parts)).first()[0]
    bounds = sorted(set(cuts or []))
    steps = [1 << i for i in range(len(bounds).bit_length())][::-1]

    def bucket(o: str):
        """How many bounds are at most o, by bisection."""
        if not bounds:
            return F.lit(0)
        known, column = F.lit(bounds), F.col(o)
        return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.get(known, at + step - 1) <= column), at + step).otherwise(at))

    firsts = rows.select(bucket("o").alias("b"), "o", F.xxhash64("text").alias("h")).groupBy("b").agg(F.max(F.struct("o", "h")).alias("f")).orderBy(F.desc("b")).collect()
    before = [firsts[i - 1].b for i in range(len(firsts))]  # for the first range: the last
    moves = spark.createDataFrame([(r.f.o, r.f.h, to) for r, to in zip(firsts, before, strict=True)], "o long, h long, bucket int")
    keyed = rows.withColumn("h", F.xxhash64("text"))
    own = keyed.select(bucket("o").alias("bucket"), F.lit(0).alias("extra"), "o", "h", "doc_id", "text")
    copies = keyed.join(F.broadcast(moves), ["o", "h"]).select("bucket", F.lit(1).alias("extra"), "o", "h", "doc_id", "text")
    return own.unionByName(copies).repartition(parts, "bucket").sortWithinPartitions("bucket", "extra", F.desc("o"), F.desc("h"))


def _against_next(batches):
    def emit(pairs: list) -> pa.RecordBatch:
        texts = [p[1] for p in pairs]
        halves = [len(t) // 2 for t in texts]
        edited = [t[: len(t) - h] + nxt[:h] for t, h, (_, _, nxt) in zip(texts, halves, pairs, strict=True)]
        prints = sketch([*texts, *edited, *(p[2] for p in pairs)])
        n = len(pairs)
        own, changed, following = prints[:n], prints[n : 2 * n], prints[2 * n :]
        hexed = lambda rows: pa.array([r.astype(">u2").tobytes().hex() for r in rows], pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in pairs], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), hexed(own), hexed(changed), pa.array(likeness(own, changed)), pa.array(likeness(own, following))],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    last, pairs, size = None, [], 0  # last: (bucket, doc_id, text) that awaits its successor
    for b in slices(batches, 64):
        for bucket, extra, doc_id, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if last is not None and last[0] == bucket:
                pairs.append((last[1], last[2], text))
                size += len(last[2]) + len(text)
            last = None if extra else (bucket, doc_id, text)
            if size > 100_000 or len(pairs) >= 256:
                yield emit(pairs)
                pairs, size = [], 0
    if pairs:
        yield emit(pairs)


def against_next(docs: DataFrame) -> DataFrame:
    """Fingerprint of each text, of its edited text (the last half replaced by the start of the next document) and likenesses."""
    ship(docs.sparkSession)
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return beside_next(docs).select("bucket", "extra", "doc_id", "text").mapInArrow(_against_next, schema)
