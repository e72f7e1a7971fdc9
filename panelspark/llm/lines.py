"""Line deduplication by a deletion-neighbourhood join.

Lines are compared as words (A-Z lower-cased, white space collapsed); a line that some earlier line equals or is within ``one edit`` of
(one word put in, left out or replaced) is dropped, the earliest stays. Order: doc_id (null last), then place in the text. Lines of
fewer than ``EDIT_WORDS`` words must be equal, and lines without words are never dropped.

* Equal lines meet by a 128-bit hash; the smallest place is an aggregate.
* Of the distinct lines only those can have a neighbour that share their first or their last half with another line of about the same
  length (one edit leaves a half untouched); this is a semi join on four hashes a line.
* Those lines emit every variant within the bound, the line itself and each line with one word left out, as hashed keys. Two lines
  with the same variant at the same place differ by a replaced word; a line that equals another's variant lacks one word. Only the
  earliest line of a key matters to the others, so keys are aggregated and never expanded into pairs.
* Matches are verified on the words.

Null text counts as empty. Rows repeating a doc_id with the same text have lines at the same places, which don't drop each other; with
another text they are told apart. A document whose lines all go keeps its row with empty text. Further columns stay as they are.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm import common
from panelspark.llm.common import ship, slices, stage

EDIT_WORDS = 10
#: Lists of lines by document up to this many rows are broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000
_BASE = 0xD1342543DE82EF95
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))
_TABLES = {_BASE: np.ones(1, np.uint64), int(_BACK): np.ones(1, np.uint64)}


def _powers(n: int, base: int = _BASE) -> np.ndarray:
    """The first n powers of the base modulo 2^64."""
    while len(_TABLES[base]) < n:
        known = _TABLES[base]
        _TABLES[base] = np.concatenate([known, known * np.uint64(pow(base, len(known), 1 << 64))])
    return _TABLES[base][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(line: str) -> np.ndarray:
    words = line.encode().lower().split()
    return np.fromiter(map(common.word_hashes().__getitem__, words), np.uint64, len(words))


def sums(units: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial whose coefficients are the units: words' hashes, or bytes."""
    p = np.zeros(len(units) + 1, np.uint64)
    np.cumsum(units * _powers(len(units)), out=p[1:])
    return p


def halves(units: np.ndarray, sizes: np.ndarray, start: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
    """For lines of so many words, one after the other in ``units``: hashes [line, 4] of the first and last half, as seen with a partner of
    the same length or one word less, or one more. A word is one unit, or those between its place in ``start`` and in ``ends``."""
    p, back, out = sums(units), _powers(len(units) + 1, int(_BACK)), []
    start = np.arange(len(units)) if start is None else start
    ends = start + 1 if ends is None else ends
    last = np.cumsum(sizes)
    begin = last - sizes
    for least in (sizes, sizes - 1):
        first = least // 2
        skip = sizes - (least - first)
        tag = least.astype(np.uint64) * np.uint64(4)
        for k, x, y in ((1, begin, begin + first), (2, begin + skip, last)):
            x, y = start[x], np.where(y > x, ends[y - 1], start[x])
            out.append(_mix((p[y] - p[x]) * back[x]) + tag + np.uint64(k))
    return _mix(np.stack(out, axis=1)).view(np.int64)


def variants(h: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
    """For lines of such sizes (or one line), one after the other in h: the hash of each line, then for each word that of its line without it."""
    sizes = np.array([len(h)]) if sizes is None else sizes
    p, back = sums(h), _powers(len(h) + 2, int(_BACK))
    last = np.cumsum(sizes)
    begin = last - sizes
    x, y, i = np.repeat(begin, sizes), np.repeat(last, sizes), np.arange(len(h))
    whole = (p[last] - p[begin]) * back[begin]
    return _mix(np.concatenate([whole, (p[i] - p[x]) * back[x] + (p[y] - p[i + 1]) * back[x + 1]])).view(np.int64)


def one_edit(a: list[bytes], b: list[bytes]) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def _line_rows(batches):
    for b in slices(batches, 128):
        found, rows, at = [], [], []
        for r, text in enumerate(b.column(2).to_pylist()):
            own = [b" ".join(line.split()) for line in text.encode().lower().split(b"\n")]
            at += (some := [i for i, w in enumerate(own) if w])
            rows += [r] * len(some)
            found += own if len(some) == len(own) else [own[i] for i in some]
        sizes = np.fromiter((w.count(b" ") for w in found), np.int64, len(found)) + 1
        ident = list(map(xxhash.xxh3_128_digest, found))
        long = sizes >= EDIT_WORDS
        keys, part, held = [np.zeros((0, 4), np.int64)], [], 0
        picked = np.flatnonzero(long).tolist()
        for i in picked:
            part.append(i)
            held += len(found[i])
            if held > 1 << 18 or i == picked[-1]:
                raw = np.frombuffer(b"\n".join([found[k] for k in part]) + b"\n", np.uint8)
                ends = np.flatnonzero((raw == 32) | (raw == 10))
                keys.append(halves(raw, sizes[part], np.concatenate([[0], ends[:-1] + 1]), ends))
                part, held = [], 0
        offsets = np.concatenate([[0], np.cumsum(np.where(long, 4, 0))]).astype(np.int32)
        rows = pa.array(rows, pa.int32())
        yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(at, pa.int32()), pa.array(ident, pa.binary()), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys).ravel(), pa.int64()))], names=["doc", "text_hash", "at", "line", "n", "keys"])


def _some_lines(batches):
    for b in slices(batches, 128):
        out = []
        for d, text, wanted in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            lines = text.split("\n")
            out += [(d, i, b" ".join(lines[i].encode().lower().split())) for i in wanted]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["doc", "at", "words"])


def _variant_rows(batches):
    for b in slices(batches, 256):
        words = [w.split() for w in b.column(2).to_pylist()]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        h = np.fromiter(map(common.word_hashes().__getitem__, itertools.chain.from_iterable(words)), np.uint64, int(sizes.sum()))
        line = np.arange(len(words))
        of = pa.array(np.concatenate([line, np.repeat(line, sizes)]))
        places = np.concatenate([np.full(len(words), -1), np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(variants(h, sizes)), pa.array(places), b.column(0).take(of), b.column(1).take(of)], names=["key", "place", "doc", "at"])


def _verify(batches):
    for b in slices(batches, 1024):
        ok = [one_edit(x.split(), y.split()) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0)], names=["late"]).filter(pa.array(ok, pa.bool_()))


ORDER = "cast(doc as decimal(20,0)) * cast(4294967296 as decimal(10,0)) + at"


def dedupe(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` (doc_id, text, ...) with dropped lines taken out of text, and n_lines, n_dropped."""
    ship(docs.sparkSession)
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1))
    plain = docs.select(key.alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    lines = stage(plain.select("doc", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(_line_rows, "doc bigint, text_hash bigint, at int, line binary, n int, keys array<bigint>")).withColumn("o", F.expr(ORDER))
    firsts = lines.groupBy("line").agg(F.min("o").alias("first"))
    placed = lines.join(firsts, "line")

    reps = placed.filter(f"o = first and n >= {EDIT_WORDS}").select(F.xxhash64("line").alias("id"), "doc", "text_hash", "at", F.explode("keys").alias("key"))
    shared = reps.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).filter("a < z").select("key")
    near = stage(reps.join(shared, "key").select("doc", "text_hash", "at").distinct().groupBy("doc", "text_hash").agg(F.collect_list("at").alias("wanted")))
    wanted = F.broadcast(near) if near.count() <= BROADCAST_ROWS else near
    texts = plain.withColumn("text_hash", F.xxhash64("text")).join(wanted, ["doc", "text_hash"]).select("doc", "text", "wanted")
    some = stage(texts.mapInArrow(_some_lines, "doc bigint, at int, words binary")).withColumn("o", F.expr(ORDER))

    emitted = some.select("doc", "at", "words").mapInArrow(_variant_rows, "key bigint, place int, doc bigint, at int").select("key", "place", F.expr(ORDER).alias("o"))
    whole, less = emitted.filter("place < 0").select("key", F.col("o").alias("w")), emitted.filter("place >= 0")
    replaced = less.join(less.groupBy("key", "place").agg(F.min("o").alias("early"), F.max("o").alias("z")).filter("early < z"), ["key", "place"]).filter("o > early").select(F.col("o").alias("late"), "early")
    longer = less.groupBy("key").agg(F.min("o").alias("early")).join(whole, "key").filter("w > early").select(F.col("w").alias("late"), "early")
    shorter = whole.groupBy("key").agg(F.min("w").alias("early")).join(less, "key").filter("o > early").select(F.col("o").alias("late"), "early")
    matches = replaced.unionByName(longer).unionByName(shorter).distinct()
    by = some.select("o", "words").dropDuplicates(["o"])
    both = matches.join(by.select(F.col("o").alias("late"), F.col("words").alias("x")), "late").join(by.select(F.col("o").alias("early"), F.col("words").alias("y")), "early").select("late", "x", "y")
    gone = both.mapInArrow(_verify, "late decimal(32,0)").distinct()

    equal = placed.filter("o > first").select("doc", "text_hash", "at")
    edited = lines.select("doc", "text_hash", "at", "o").join(gone.withColumnRenamed("late", "o"), "o").select("doc", "text_hash", "at")
    drops = equal.unionByName(edited).groupBy(F.col("doc").alias("_doc"), F.col("text_hash").alias("_text_hash")).agg(F.collect_set("at").alias("_drops"))
    out = docs.withColumn("_doc", key).withColumn("_text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    out = out.join(drops, ["_doc", "_text_hash"], "left")
    parts = F.split(F.coalesce("text", F.lit("")), "\n")
    kept = F.when(F.col("_drops").isNull(), F.col("text")).otherwise(F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "_drops"), lambda i: F.get(parts, i)), "\n"))
    others = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*(kept.alias("text") if c == "text" else F.col(c) for c in others), F.size(parts).cast("bigint").alias("n_lines"), F.coalesce(F.size("_drops"), F.lit(0)).cast("bigint").alias("n_dropped"))
