"""Byte-level BPE encoding and decoding by overlapping chunks.

A text longer than ``chunk`` characters is cut into chunks that overlap. Chunks are pre-tokenised in parallel, each from its own
start; two neighbours are stitched at the first position in their overlap where both begin a pre-token, because the pattern looks
only forward and so agrees from there on. The pieces between stitches are encoded in parallel and their ids concatenated. Where an
overlap holds no such position (one pre-token is longer than it), the rest of the text is one piece. A text of one chunk is one piece.
Decoding concatenates the bytes of the ids.

Null text counts as empty; repeated rows and null ids stay as rows of their own; other columns are ignored.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import ship, slices

RANKS = "byte_bpe_50k.tiktoken"
CHUNK, OVERLAP = 1 << 16, 1 << 10


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def pattern():
    return regex.compile(public_tokenizers.PATTERN)


def starts(text: str, at_end: bool) -> list[int]:
    """Where pre-tokens begin; without the last two where the text goes on, as those may depend on what follows."""
    out = [m.start() for m in pattern().finditer(text)]
    return out if at_end else out[:-2]


def stitches(parts: list[tuple[int, list[int], list[int]]]) -> list[int]:
    """Positions where pieces begin, from the (chunk, begins near its start, begins in its overlap) of one text."""
    cuts = [0]
    parts = sorted(parts)
    for (_, _, tail), (_, head, _) in zip(parts, parts[1:], strict=False):
        meet = sorted(set(tail) & set(head))
        if not meet:
            break
        cuts.append(meet[0])
    return cuts


def _encode_column(path: str):
    def run(batches):
        enc = encoding(path)
        for b in slices(batches):
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            ids = [np.array(enc.encode_ordinary(t or ""), dtype="<u4").tobytes() for t in texts]
            keep = [i for i, n in enumerate(b.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(ids, pa.binary())], names=[*(b.schema.names[i] for i in keep), "ids"])

    return run


def _chunk_starts(chunk: int, overlap: int):
    def run(batches):
        for b in slices(batches, 64):
            rows = b.to_pylist()
            heads, tails = [], []
            for r in rows:
                s, base = starts(r["text"], r["last"]), r["k"] * chunk
                heads.append([base + x for x in s if x < overlap])
                tails.append([base + x for x in s if x >= chunk])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], names=["digest", "k", "head", "tail"])

    return run


def _stitch(batches):
    for b in slices(batches, 16):
        cuts = [stitches([(p["k"], p["head"], p["tail"]) for p in r["parts"]]) for r in b.to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cuts, pa.list_(pa.int64()))], names=["digest", "cuts"])


def _join_ids(batches):
    for b in slices(batches, 16):
        ids = [b"".join(p["ids"] for p in sorted(r["parts"], key=lambda p: p["at"])) for r in b.to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["digest", "ids"])


def encode(docs: DataFrame, ranks: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, text) -> (doc_id, ids): ids as little-endian unsigned 32-bit integers."""
    ship(docs.sparkSession)
    ranks = ranks or public_tokenizers.path(RANKS)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    short = docs.filter(F.length("text") <= chunk).mapInArrow(_encode_column(ranks), f"doc_id {id_type}, ids binary")
    long = docs.filter(F.length("text") > chunk).withColumn("digest", F.sha2("text", 256))
    texts = long.groupBy("digest").agg(F.first("text").alias("text")).withColumn("n", F.length("text"))
    parts = (
        texts.select("digest", "text", "n", F.explode(F.sequence(F.lit(0), F.expr(f"cast((n - 1) div {chunk} as int)"))).alias("k"))
        .select("digest", "k", F.expr(f"substring(text, k * {chunk} + 1, {chunk + overlap})").alias("text"), F.expr(f"(k + 1) * {chunk} + {overlap} >= n").alias("last"))
        .repartition("digest", "k")
        .mapInArrow(_chunk_starts(chunk, overlap), "digest string, k int, head array<bigint>, tail array<bigint>")
    )
    cuts = parts.groupBy("digest").agg(F.collect_list(F.struct("k", "head", "tail")).alias("parts")).mapInArrow(_stitch, "digest string, cuts array<bigint>")
    pieces = (
        texts.join(cuts, "digest")
        .select("digest", "text", F.posexplode("cuts").alias("i", "at"), F.expr("concat(slice(cuts, 2, size(cuts)), array(cast(n as bigint)))").alias("ends"))
        .select("digest", "at", F.expr("substring(text, cast(at as int) + 1, cast(ends[i] - at as int))").alias("text"))
        .repartition("digest", "at")
        .mapInArrow(_encode_column(ranks), "digest string, at bigint, ids binary")
    )
    whole = pieces.groupBy("digest").agg(F.collect_list(F.struct("at", "ids")).alias("parts")).mapInArrow(_join_ids, "digest string, ids binary")
    return short.unionByName(long.select("doc_id", "digest").join(whole, "digest").select("doc_id", "ids"))


def _decode_column(path: str):
    def run(batches):
        enc = encoding(path)
        for b in slices(batches):
            ids = b.column(b.schema.get_field_index("ids"))
            out = [enc.decode_bytes(np.frombuffer(x.as_py() or b"", "<u4").tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """Adds ``decoded``, the bytes of ``ids``; null ids decode to nothing."""
    ship(encoded.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(_decode_column(ranks or public_tokenizers.path(RANKS)), f"{fields}, decoded binary")
