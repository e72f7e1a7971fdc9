"""Near-duplicate documents by an inverted join over MinHash coordinates.

* A document is the set of its word shingles. Documents of one set form a class, represented by its smallest doc_id.
* Each class is posted under its first ``POSTED`` (coordinate, value) pairs. A pair of classes at the similarity threshold agrees on at
  least ``MEET`` of them (expected 25.6 of 32 at 0.8; fewer than 14 has a chance of about 1e-6), so pairs that no other class holds
  are dropped, classes left with fewer than ``MEET`` have no partner, and of the rest only the rarest (left - MEET + 1) are merged: two
  classes that agree on MEET share one of those (prefix filter under the global order of frequency).
* Lists are not expanded into pairs. Each list takes as pivot the member whose own lists are longest together (the text that copies were
  made from shares most with the others) and its members are compared with it: first by the count of equal
  coordinates among all ``COORDS`` (at least ``MATCHES``; 0.8 expects 102 of 128 with deviation 4.5), then exactly on full shingle
  sets. Members of one component need no further links. Lists that still hold several components are finished exactly: members outside
  the list's largest component against all others, in blocks, skipping pairs already in one component and pairs met in a list before,
  by the same count and then by a finer sketch (one value in each of ``BINS`` bins of the hash range; with about as many bins as
  shingles it is nearly the set itself). What is left is compared exactly.

Null and wordless texts have empty sets and link with nothing. Rows with a null doc_id join their class but can't represent it; alone
they have a null component. Repeated rows share their class. Rows that repeat a doc_id with another text have a class of their own: classes
are numbered by their smallest doc_id, of several that share it all but one by a negative number from their set's hash, and a component is
named by the smallest doc_id of its classes. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import ship, slices, stage, word_hashes
from panelspark.llm.components import components

COORDS, POSTED, MEET, MATCHES = 128, 32, 14, 80
BLOCK, BINS, EMPTY = 1024, 1024, 255
#: Class ids up to this many rows are broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000
_A = np.random.default_rng(8).integers(1, 1 << 63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.random.default_rng(9).integers(0, 1 << 63, COORDS, dtype=np.uint64)
_M = np.uint64(0x9FB21C651E98DF25)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a text of fewer words has one, of all its words."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only x20 and x09-x0D separate
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))
    width = min(size, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = (out ^ h[k : k + len(out)]) * _M
        out ^= out >> np.uint64(31)
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    low = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), 2048):
        low = np.minimum(low, (s[k : k + 2048, None] * _A + _B).min(axis=0))
    return low >> np.uint64(24)


def _summary(size: int):
    def run(batches):
        for b in slices(batches, 256):
            sets = [shingles(t, size) for t in b.column(1).to_pylist()]
            sig = [signature(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.array([x.astype(np.uint16).tobytes() for x in sig], pa.binary()), pa.array([(x[:POSTED] * np.uint64(64) + np.arange(POSTED, dtype=np.uint64)).view(np.int64) if len(s) else np.zeros(0, np.int64) for x, s in zip(sig, sets, strict=True)], pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n", "set_key", "sig", "posts"],
            )

    return run


def fine(s: np.ndarray) -> bytes:
    """Of each bin (highest bits) the smallest item's lowest byte; EMPTY where there is none. Items are sorted."""
    out = np.full(BINS, EMPTY, np.uint8)
    bins, first = np.unique(s >> np.uint64(64 - BINS.bit_length() + 1), return_index=True)
    out[bins.astype(np.int64)] = np.minimum(s[first] & np.uint64(255), EMPTY - 1)
    return out.tobytes()


def alike(one: np.ndarray, n_one: int, others: np.ndarray, n_others: np.ndarray, percent: int) -> np.ndarray:
    """Which others may reach the similarity: equal bins against filled bins, less 4.75 deviations of drawing that many of the union."""
    filled = ((others != EMPTY) | (one != EMPTY)).sum(axis=1)
    equal = ((others == one) & (one != EMPTY)).sum(axis=1)
    p = percent / 100
    union = np.minimum(n_one, n_others) / p
    slack = 2 + 4.75 * np.sqrt(p * (1 - p) * filled * np.clip(1 - filled / union, 0, 1))
    return equal >= p * filled - slack


def _sets(size: int):
    def run(batches):
        for b in slices(batches, 256):
            sets = [shingles(t, size) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([fine(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cls", "set_key", "n", "fine", "items"])

    return run


def _agree(batches):
    for b in slices(batches, 4096):
        a, c = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(-1, COORDS) for i in (2, 3))
        n = (a == c).sum(axis=1)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int32())], names=["a", "b", "agree"])


def _confirm(percent: int):
    def run(batches):
        key, pivot = None, None
        for batch in slices(batches, 256):
            out = []
            for a, salt, b, items in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                s = np.frombuffer(items, np.uint64)
                if b is None:  # the pivot's own row comes first
                    key, pivot = (a, salt), s
                elif key == (a, salt):
                    both = len(np.intersect1d(pivot, s, assume_unique=True))
                    if 100 * both >= percent * (len(pivot) + len(s) - both):
                        out.append((b, a))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["u", "v"])

    return run


def _blocks(percent: int):
    """Rows sorted by (token, f, g, side): the few (side 0) against the block's others (side 1); pairs of different components that
    may be similar, each in the first list that both are in."""

    def pairs(token: int, few: list, many: list):
        if not few or not many:
            return []
        stacked = lambda rows, i, kind, width: np.frombuffer(b"".join(r[i] for r in rows), kind).reshape(-1, width)
        comp, n = (np.array([r[i] for r in many], np.int64) for i in (1, 4))
        rough, close, out = stacked(many, 2, np.uint16, COORDS), stacked(many, 5, np.uint8, BINS), []
        for k, own in enumerate(stacked(few, 2, np.uint16, COORDS)):
            cls, root, _, tokens, size, sketch = few[k]
            at = np.flatnonzero((comp != root) & ((rough == own).sum(axis=1) >= MATCHES))
            at = at[alike(np.frombuffer(sketch, np.uint8), size, close[at], n[at], percent)]
            mine = set(tokens)
            out += [(max(cls, many[j][0]), min(cls, many[j][0])) for j in at.tolist() if min(mine & set(many[j][3])) == token]
        return out

    def run(batches):
        key, sides = None, ([], [])

        def batch():
            found = pairs(key[0], *sides) if key else []
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["b", "a"])

        for b in slices(batches, 1024):
            for token, f, g, side, *row in zip(*(b.column(i).to_pylist() for i in range(10)), strict=True):
                if key != (token, f, g):
                    yield batch()
                    key, sides = (token, f, g), ([], [])
                sides[side].append(row)
        yield batch()

    return run


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_shingles, component_id, kept), one row per input row; ``percent`` of at least 80."""
    out = grouped(docs, size, percent)
    same = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return out.select("doc_id", "n_shingles", "component_id", same.alias("kept"))


def grouped(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text) -> (doc_id, text_hash, n_shingles, component_id, root), one row per input row: the hash of the text, and the number
    of the component itself, which differs between unlike texts that share a doc_id (NULL for texts that link with nothing)."""
    if percent < 80:
        raise ValueError("the counts of agreeing coordinates hold for 80 percent or more")
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    rows = stage(docs.mapInArrow(_summary(size), "doc_id bigint, text_hash bigint, n bigint, set_key binary, sig binary, posts array<bigint>"))
    named = rows.groupBy("set_key").agg(F.min("doc_id").alias("first")).filter("set_key is not null and first is not null")
    lead = named.groupBy("first").agg(F.min("set_key").alias("lead"), F.count("*").alias("c")).filter("c > 1")
    other = -1 - F.shiftrightunsigned(F.xxhash64("set_key"), 1)
    named = stage(named.join(lead, "first", "left").select("set_key", "first", F.when(F.col("set_key") != F.col("lead"), other).otherwise(F.col("first")).alias("cls")))
    reps = rows.join(named, "set_key").filter("doc_id = first").select("cls", "first", "set_key", "sig", "posts").dropDuplicates(["set_key"])
    reps = stage(reps)

    posts = reps.select("cls", F.explode("posts").alias("token"))
    often = posts.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    lists = (
        posts.join(often, "token").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
        .filter(F.size("t") >= MEET).select("cls", F.expr("aggregate(t, 0L, (a, x) -> a + x.df)").alias("mass"), F.expr(f"transform(slice(t, 1, size(t) - {MEET} + 1), x -> x.token)").alias("tokens"))
        .select("cls", "mass", "tokens", F.explode("tokens").alias("token"))
    )
    lists = stage(lists)

    sigs = reps.select("cls", "sig")

    def agreeing(pairs: DataFrame) -> DataFrame:
        two = pairs.join(sigs.withColumnRenamed("cls", "b").withColumnRenamed("sig", "sb"), "b").join(sigs.withColumnRenamed("cls", "a").withColumnRenamed("sig", "sa"), "a")
        return two.select("a", "b", "sa", "sb").mapInArrow(_agree, "a bigint, b bigint, agree int").filter(F.col("agree") >= MATCHES)

    need = lists.groupBy("token").agg(F.min("cls").alias("a"), F.max("cls").alias("z")).filter("a < z").select("token")
    need = stage(lists.join(need, "token").select("cls").distinct().join(reps.select("cls", "first"), "cls"))
    need = F.broadcast(need) if need.count() <= BROADCAST_ROWS else need
    sets = docs.join(need, docs["doc_id"] == need["first"]).select("cls", "text").mapInArrow(_sets(size), "cls bigint, set_key binary, n bigint, fine binary, items binary")
    sets = stage(sets.join(reps.select("cls", "set_key"), ["cls", "set_key"]).select("cls", "n", "fine", "items").dropDuplicates(["cls"]))
    items = sets.select("cls", "items")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose full sets are similar enough; b's set travels once per pair, a's once per 256 pairs."""
        salts = pairs.groupBy("a").agg(F.expr("cast((count(*) - 1) div 256 + 1 as int)").alias("s"))
        members = pairs.join(salts, "a").select("a", F.expr("cast(pmod(xxhash64(b), s) as int)").alias("salt"), "b").join(items.withColumnRenamed("cls", "b"), "b").select("a", "salt", "b", "items")
        pivots = salts.select(F.col("a").alias("cls"), F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("salt")).join(items, "cls").select(F.col("cls").alias("a"), "salt", F.lit(None).cast("bigint").alias("b"), "items")
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return members.unionByName(pivots).repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInArrow(_confirm(percent), "u bigint, v bigint")

    pivots = lists.groupBy("token").agg(F.max_by("cls", F.col("mass") * (1 << 20) + F.pmod(F.xxhash64("cls"), F.lit(1 << 20))).alias("pivot"))
    star = lists.join(pivots, "token").filter("cls <> pivot").select(F.greatest("cls", "pivot").alias("b"), F.least("cls", "pivot").alias("a")).distinct()
    star = stage(agreeing(star))
    best = star.groupBy("b").agg(F.max_by("a", F.struct("agree", -F.col("a"))).alias("a")).select("a", "b")
    links = stage(confirmed(best))
    comp = components(links)

    def across(pairs: DataFrame) -> DataFrame:
        root = comp.select(F.col("u").alias("cls"), F.col("v").alias("root"))
        for side in ("a", "b"):
            pairs = pairs.join(root.select(F.col("cls").alias(side), F.col("root").alias(f"r{side}")), side, "left")
        return pairs.filter("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b")

    links = stage(links.unionByName(confirmed(stage(across(star.join(best, ["a", "b"], "left_anti"))))))
    comp = components(links)

    open_lists = lists.join(comp.select(F.col("u").alias("cls"), F.col("v").alias("comp")), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    sizes = open_lists.groupBy("token", "comp").agg(F.count("*").alias("k"))
    rest = sizes.groupBy("token").agg(F.sum("k").alias("all"), F.max("k").alias("most"), F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count("*").alias("comps")).filter("comps > 1")
    rest = rest.select("token", "main", F.expr(f"cast((all - most - 1) div {BLOCK} as int)").alias("fs"), F.expr(f"cast((all - 1) div {BLOCK} as int)").alias("gs"))
    rest = open_lists.join(rest, "token").join(sigs.join(sets.select("cls", "n", "fine"), "cls"), "cls")
    place = F.xxhash64("cls", F.lit(3))
    few = rest.filter("comp <> main").select("token", F.expr("cast(pmod(xxhash64(cls, 3), fs + 1) as int)").alias("f"), F.explode(F.sequence(F.lit(0), "gs")).alias("g"), F.lit(0).alias("side"), "cls", "comp", "sig", "tokens", "n", "fine")
    many = rest.select("token", F.explode(F.sequence(F.lit(0), "fs")).alias("f"), F.pmod(place, F.col("gs") + 1).cast("int").alias("g"), F.lit(1).alias("side"), "cls", "comp", "sig", "tokens", "n", "fine")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    final = few.unionByName(many).repartition(parts, "token", "f", "g").sortWithinPartitions("token", "f", "g", "side").mapInArrow(_blocks(percent), "b bigint, a bigint").distinct()
    tried = star.select("a", "b")
    final = stage(final.join(tried, ["a", "b"], "left_anti"))
    if final.limit(1).count():
        comp = components(links.unionByName(confirmed(final)))

    whole = named.join(comp.select(F.col("u").alias("cls"), F.col("v").alias("root")), "cls", "left").select("set_key", "first", F.coalesce("root", "cls").alias("root"))
    whole = whole.join(whole.groupBy("root").agg(F.min("first").alias("component")), "root").select("set_key", "root", "component")
    out = rows.select("doc_id", "text_hash", "n", "set_key").join(whole, "set_key", "left")
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), "root")
