"""Near-duplicate vectors by a subspace pigeonhole join.

Two unit vectors with cosine of at least c are at a squared distance of at most 2 - 2c. After a fixed rotation the coordinates are split
into ``BLOCKS`` blocks; in at least one of them the squared distance is at most the block's share of that budget. Vectors lie in tiles of
up to ``CHUNK``, a row each, and each pair of tiles is one unit of work: a product of the tile table with itself whose tasks read the
staged tiles, so nothing is copied for it on disk. Within a pair of tiles each block is joined by range: both sides are sorted by the
block's first coordinate, and strips meet what lies within the share's root. Pairs within the block's budget are verified by their
cosine in double precision and counted in the first block whose budget they meet. Units return the sum of links of each vector and a
spanning forest, never the pairs.

Equal vectors are one class (each links with all others of it). Null, empty and zero vectors, those with null or non-finite
components and rows with a null id link with nothing; vectors of different lengths don't link. Repeated rows count as vectors of their
own. Other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import ship, slices, stage
from panelspark.llm.components import components

BLOCKS, CHUNK, CHUNK_BYTES, STRIP, WIDTH = 4, 16_384, 1 << 22, 256, 1024


@lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))[0]


def spans(dim: int) -> list[tuple[int, int]]:
    cuts = np.linspace(0, dim, min(BLOCKS, dim) + 1).astype(int)
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def budget(cosine: float, dim: int) -> float:
    return (2 - 2 * cosine) / len(spans(dim)) * (1 + 1e-9) + 1e-12


def unit(raw, dim: int) -> np.ndarray:
    """Vectors as 4-byte numbers where these hold them exactly, else as 8-byte ones."""
    x = np.frombuffer(raw[1:], "<f4" if raw[0] == 4 else "<f8").reshape(-1, dim).astype(float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _classes(batches):
    for b in slices(batches, 1024):
        keys, raws, dims = [], [], []
        for v in b.column(1).to_pylist():
            x = np.array(v, float) if v and None not in v else np.zeros(0)
            scale = np.abs(x).max(initial=0)
            ok = len(x) and np.isfinite(x).all() and scale > 0
            keys.append(xxhash.xxh3_128_digest(x.astype("<f8").tobytes()) if ok else None)
            dims.append(len(x))
            x = x / scale if ok and not 1e-100 < scale < 1e100 else x
            with np.errstate(over="ignore", invalid="ignore"):
                short = x.astype("<f4")
            raws.append((short if (short == x).all() else x.astype("<f8")).tobytes() if ok else None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(raws, pa.binary())], names=["vec_id", "key", "dim", "vec"])


def _tiles(rows: int, size: int):
    """(cls, size, dim, vec) -> tiles of vectors of one length and precision, named by one of their classes."""

    def run(batches):
        held = {}

        def tile(kind):
            cls, sizes, raws = held.pop(kind)
            dim, wide = kind
            arrays = [pa.array([x], t) for x, t in ((cls[0], pa.int64()), (dim, pa.int32()), (np.array(cls, "<i8").tobytes(), pa.binary()), (np.array(sizes, "<i8").tobytes(), pa.binary()), (b"".join([bytes([wide]), *raws]), pa.binary()))]
            return pa.RecordBatch.from_arrays(arrays, names=["tile", "dim", "cls", "size", "vec"])

        for b in slices(batches, 1024):
            for c, n, dim, raw in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                kind = dim, len(raw) // dim
                mine = held.setdefault(kind, ([], [], []))
                for x, v in zip(mine, (c, n, raw), strict=True):
                    x.append(v)
                if len(mine[0]) >= min(rows, max(1, size // len(raw))):
                    yield tile(kind)
        for kind in list(held):
            yield tile(kind)

    return run


def join_tiles(left: tuple, right: tuple | None, dim: int, cosine: float):
    """Tiles (ids, weights, unit vectors, the same rotated), or one with itself: sums of links of both, and a forest of (high id, low id)."""
    ids, weight, u, z = (np.concatenate(x) for x in zip(left, right, strict=True)) if right else left
    parts, share = spans(dim), budget(cosine, dim)
    total = np.zeros(len(ids))
    label = np.arange(len(ids))

    def link(pairs, block):
        nonlocal label
        p, q = (np.concatenate([*x, np.zeros(0, int)]) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, int),) * 2
        mine = np.zeros(len(p), bool)
        for k in range(0, len(p), 1 << 14):
            a, b = p[k : k + (1 << 14)], q[k : k + (1 << 14)]
            met = np.stack([((z[a, x:y] - z[b, x:y]) ** 2).sum(axis=1) <= share for x, y in parts], axis=1)
            mine[k : k + (1 << 14)] = (np.einsum("ij,ij->i", u[a], u[b]) >= cosine) & (met.argmax(axis=1) == block) & met[:, block]
        p, q = p[mine], q[mine]
        if not len(p):
            return
        total[:] += np.bincount(p, weight[q], len(ids)) + np.bincount(q, weight[p], len(ids))
        while True:  # smallest label over the links so far
            low = np.minimum(label[p], label[q])
            before = label.copy()
            np.minimum.at(label, label[p], low)
            np.minimum.at(label, label[q], low)
            label = label[label]
            if (label == before).all() and (label[p] == label[q]).all():
                break

    for block, (lo, hi) in enumerate(parts):
        near = np.argsort(z[: len(left[0]), lo])
        other = len(left[0]) + np.argsort(z[len(left[0]) :, lo]) if right else near
        sub = z[:, lo:hi].astype(np.float32)
        norm, one = (sub * sub).sum(axis=1, keepdims=True), np.ones((len(ids), 1), np.float32)
        rows = np.hstack([sub, norm, one])[near]
        columns = np.ascontiguousarray(np.hstack([-2 * sub, one, norm])[other].T)  # their product with the rows is the squared distance
        at, width = z[other, lo], np.sqrt(share) + 1e-9
        held, waiting = [], 0
        for s in range(0, len(near), STRIP):
            e = min(s + STRIP, len(near))
            begin, end = np.searchsorted(at, [z[near[s], lo] - width, z[near[e - 1], lo] + width], "left").tolist()
            begin = begin if right else s  # against itself: only what follows
            for k in range(begin, end, WIDTH):
                stop = min(k + WIDTH, end)
                far = rows[s:e] @ columns[:, k:stop]
                found = np.flatnonzero(far <= share + 1e-5)
                a, b = np.divmod(found, stop - k)
                a, b = a + s, b + k
                if not right:
                    a, b = a[a < b], b[a < b]
                held.append((near[a], other[b]))
                waiting += len(a)
                if waiting >= 1 << 15:
                    link(held, block)
                    held, waiting = [], 0
        link(held, block)
    joined = np.flatnonzero(label != np.arange(len(ids)))
    linked = np.flatnonzero(total)
    return ids[linked], total[linked], ids[joined], ids[label[joined]]


def _units(cosine: float):
    """Pairs of tiles -> (u, v, links): links of u where v is null, else a link of the forest."""

    def run(batches):
        name, left = None, None
        for b in slices(batches, 1):
            first, second, dim = (b.column(i)[0].as_py() for i in (0, 1, 2))

            def tile(k, b=b, dim=dim):
                ids, size, vec = (b.column(i)[0].as_buffer() for i in range(k, k + 3))
                u = unit(memoryview(vec), dim)
                return np.frombuffer(ids, "<i8"), np.frombuffer(size, "<i8").astype(float), u, u @ rotation(dim)

            if name != first:
                name, left = first, tile(3)
            ids, total, u, v = join_tiles(left, None if first == second else tile(6), dim, cosine)
            none = [None] * len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([*ids.tolist(), *u.tolist()], pa.int64()), pa.array([*none, *v.tolist()], pa.int64()), pa.array([*total.astype(np.int64).tolist(), *[None] * len(u)], pa.int64())], names=["u", "v", "links"])

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """(vec_id, embedding) -> (vec_id, n_links, component_id, kept), one row per input row."""
    spark = vectors.sparkSession
    ship(spark)
    hashed = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").mapInArrow(_classes, "vec_id bigint, key binary, dim int, vec binary")
    rows = stage(hashed.select("vec_id", "key"))
    own = F.col("vec_id").isNotNull()
    named = rows.filter(own & F.col("key").isNotNull()).groupBy("key").agg(F.min("vec_id").alias("cls"), F.count("*").alias("size"))
    classes = hashed.filter(own & F.col("key").isNotNull()).groupBy("key").agg(F.min("vec_id").alias("cls"), F.count("*").alias("size"), *[F.first(c).alias(c) for c in ("dim", "vec")])
    tiles = stage(classes.select("cls", "size", "dim", "vec").mapInArrow(_tiles(CHUNK, CHUNK_BYTES), "tile bigint, dim int, cls binary, size binary, vec binary"))

    left, right = (tiles.select(*[F.col(c).alias(f"{side}_{c}") for c in tiles.columns]) for side in "lr")
    pairs = left.join(right, F.expr("l_tile <= r_tile and l_dim - r_dim = 0"))  # no equality of columns: that would send all tiles to one task
    pairs = pairs.select("l_tile", "r_tile", "l_dim", *[f"{side}_{c}" for side in "lr" for c in ("cls", "size", "vec")])
    found = stage(pairs.mapInArrow(_units(cosine), "u bigint, v bigint, links bigint"))

    links = found.filter("v is null").groupBy(F.col("u").alias("cls")).agg(F.sum("links").alias("links"))
    comp = components(found.filter("v is not null").select("u", "v")).select(F.col("u").alias("cls"), F.col("v").alias("root"))
    linked = named.join(links, "cls", "left").join(comp, "cls", "left").select("key", F.coalesce("root", "cls").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n"))
    out = rows.select("vec_id", "key").join(linked, "key", "left")
    comp_id = F.when(own, F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.when(own, F.coalesce("n", F.lit(0))).otherwise(0).cast("bigint").alias("n_links"), comp_id.alias("component_id"), (~own | (F.col("vec_id") == comp_id)).alias("kept"))
