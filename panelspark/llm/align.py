"""Alignment of two tokenizers by merge-path partitioning.

The ends of A's and of B's tokens, in bytes, are two sorted lists. Walking their merge, every step stands on one A and one B token,
which overlap unless an end was just met by both; a position where both end closes a group. The merge of a batch of documents (each
ends at one position of both) is cut along diagonals: a binary search on the diagonal i + j = d finds how many ends of A are among the
first d, so all pieces have the same work and need nothing of each other. Pieces are merged side by side, one step of all at a time;
each counts its group ends, and a running total over pieces stitches groups that go on in the next piece.

An id pair's count (documents that hold it linked) needs the whole corpus, so

* a task keeps blocks of documents: the distinct pairs of the block with their documents, and for each document places in that list;
* the blocks' pairs are summed, and each A id's highest count found (an A id has at most B's vocabulary of pairs); what travels are a
  block's distinct pairs, not those of its documents;
* the counts go back to their blocks, where documents add them up.

Texts that are null or empty, or that either tokenizer does not give back byte for byte, have no tokens. Repeated rows and null ids are
documents of their own. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.chunks import byte_letters
from panelspark.llm.common import held, ship, slices, stage

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Steps of one piece of the merge; steps merged at a time; pairs of documents that close a block.
WORK, WINDOW, PAIRS = 64, 1 << 19, 1 << 21


class ByteTokens:
    """A byte-level BPE file of the tokenizers library whose ids follow its merges, encoded by rank (equal, and faster)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        back = {c: b for b, c in enumerate(byte_letters())}
        ids, words = model["vocab"], {}
        for k, m in enumerate(model["merges"]):
            if ids["".join(m.split(" ") if isinstance(m, str) else m)] != 256 + k:
                raise ValueError("ids don't follow the merges")
        for word, i in ids.items():
            if i < 256 + len(model["merges"]):
                words[i] = bytes(back[c] for c in word)
        self.size = max(ids.values()) + 1
        self.lengths = np.array([len(words.get(i, b"")) for i in range(self.size)], np.int64)
        self.library = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={w: i for i, w in words.items()}, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_ordinary(" " + text), np.int64)


class PieceTokens(dict):
    """A sentencepiece file. No piece goes on behind a space but a run of spaces, so a text is cut before each space between two other
    characters, and chunks are remembered (emptied when full). A chunk that isn't given back byte for byte maps to None."""

    LIMIT = 1 << 19

    def __init__(self, path: str):
        super().__init__()
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(self.size)]
        self.bytes = [bytes([int(p[3:-1], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.apart = not any("▁" in p.lstrip("▁") for p in pieces)

    def direct(self, text: str) -> bytes | None:
        ids = self.library.encode(text)
        same = b"".join(map(self.bytes.__getitem__, ids)) == b" " + text.encode()
        return np.array(ids, "<u4").tobytes() if same else None

    def __missing__(self, chunk: str) -> bytes | None:
        v = self.direct(chunk)
        if len(self) >= self.LIMIT:
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = v
        return v

    def encode(self, text: str) -> np.ndarray | None:
        parts = text.split(" ")
        if not self.apart or "▁" in text:
            raw = [self.direct(text)]
        elif "" in parts:
            chunks = [parts[0]]
            for before, p in zip(parts, parts[1:], strict=False):
                if before and p:
                    chunks.append(p)
                else:
                    chunks[-1] += " " + p
            raw = list(map(self.__getitem__, chunks))
        else:
            raw = list(map(self.__getitem__, parts))
        return None if None in raw else np.frombuffer(b"".join(raw), "<u4").astype(np.int64)


def diagonals(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """How many of ``a`` are among the first d of the merge, equal values from ``a`` first."""
    lo, hi = np.maximum(d - len(b), 0), np.minimum(d, len(a))
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        first = a[np.minimum(mid, len(a) - 1)] <= b[np.clip(d - 1 - mid, 0, len(b) - 1)]
        lo = np.where(open_ & first, mid + 1, lo)
        hi = np.where(open_ & ~first, mid, hi)
    return lo


def merge(a: np.ndarray, b: np.ndarray, work: int = WORK, window: int = WINDOW):
    """Links of two lists of ends with the same last end, in order: yields (A numbers, B numbers, group numbers)."""
    last = a[-1]
    a0, b0 = np.concatenate([[0], a, [last + 1]]), np.concatenate([[0], b, [last + 1]])  # place k: end before token k; k + 1: its own
    groups = 0
    for low in range(0, len(a) + len(b), window):
        high = min(low + window, len(a) + len(b))
        d = np.arange(low, high, work)
        i = diagonals(a, b, d)
        j = d - i
        steps = np.minimum(high - d, work)
        width = int(steps.max())
        at_a, at_b = np.empty((width, len(d)), np.int64), np.empty((width, len(d)), np.int64)
        link, close = np.zeros((width, len(d)), bool), np.zeros((width, len(d)), bool)
        for s in range(width):
            ea, eb = a0[i + 1], b0[j + 1]
            on = s < steps
            at_a[s], at_b[s] = i, j
            link[s] = on & (np.maximum(a0[i], b0[j]) < np.minimum(ea, eb))
            close[s] = on & (ea == eb)
            first = ea <= eb
            i = i + (on & first)
            j = j + (on & ~first)
        own = np.cumsum(close, axis=0)
        before = np.cumsum(own[-1]) - own[-1] + groups  # stitches: groups that earlier pieces closed
        number = own - close + before
        groups += int(own[-1].sum())
        ok = link.T
        yield at_a.T[ok], at_b.T[ok], number.T[ok]


class Names:
    """Decimal ids with what follows them, for the text of groups."""

    def __init__(self, size_a: int, size_b: int):
        self.b = 2 * size_a
        self.words = [f"{i}{c}".encode() for i in range(size_a) for c in ",|"] + [f"{i}{c}".encode() for i in range(size_b) for c in ",;"]

    def digest(self, a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray) -> str:
        """sha256 of ``a1,a2|b1;...``; ``ga``, ``gb`` are the groups of the tokens, from 0."""
        n = int(ga[-1]) + 1
        na, nb = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + (np.cumsum(nb) - nb)[ga]] = 2 * a + (np.diff(ga, append=n) > 0)
        out[np.arange(len(b)) + np.cumsum(na)[gb]] = self.b + 2 * b + (np.diff(gb, append=n) > 0)
        return hashlib.sha256(b"".join(map(self.words.__getitem__, out.tolist()))[:-1]).hexdigest()


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteTokens(path_a), PieceTokens(path_b)
        self.names = Names(self.a.size, self.b.size)

    def texts(self, texts: list[str | None]):
        """Per text (n_a, n_b, n_groups, n_links, sha256, distinct pairs a * size_b + b ascending, how often each)."""
        both = []
        for t in texts:
            b = self.b.encode(t) if t else None
            a = self.a.encode(t) if b is not None and len(b) else None
            both.append((a, b) if a is not None and self.a.lengths[a].sum() == self.b.lengths[b].sum() else None)
        live = [x for x in both if x is not None]
        if live:
            ids_a, ids_b = np.concatenate([a for a, _ in live]), np.concatenate([b for _, b in live])
            doc_of = np.repeat(np.arange(len(live)), [len(a) for a, _ in live])
            ga, gb, keys = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64), []
            for i, j, g in merge(np.cumsum(self.a.lengths[ids_a]), np.cumsum(self.b.lengths[ids_b])):
                ga[i], gb[j] = g, g
                keys.append((doc_of[i] << 40) | (ids_a[i] * self.b.size + ids_b[j]))
            links = np.sort(np.concatenate(keys))
            new = np.concatenate([[True], links[1:] != links[:-1]])
            places = np.nonzero(new)[0]
            times = np.diff(places, append=len(links))
            pairs = links[places]
            cuts = np.searchsorted(pairs >> 40, np.arange(len(live) + 1))
            totals = np.bincount(links >> 40, minlength=len(live))
            pairs &= (1 << 40) - 1
        k, at, bt = 0, 0, 0
        for x in both:
            if x is None:
                yield 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
                continue
            a, b = x
            mine_a, mine_b = ga[at : at + len(a)], gb[bt : bt + len(b)]
            base = mine_a[0]
            sha = self.names.digest(a, b, mine_a - base, mine_b - base)
            yield len(a), len(b), int(mine_a[-1] - base) + 1, int(totals[k]), sha, pairs[cuts[k] : cuts[k + 1]], times[cuts[k] : cuts[k + 1]]
            k, at, bt = k + 1, at + len(a), bt + len(b)


_CODEC = pa.Codec("zstd", compression_level=1)
FIGURES = {"n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "groups_sha256": "string"}
#: A block: the figures of its documents, and the pairs. ``places`` are each document's places in ``pairs``, as steps from the one before.
BLOCK = {"block": "bigint", "doc_id": "array<bigint>"} | {c: f"array<{t}>" for c, t in FIGURES.items()} | {"sizes": "array<bigint>", "places": "binary", "times": "binary", "pairs": "array<bigint>", "holds": "array<bigint>"}


def _squeeze(x: np.ndarray) -> bytes:
    return _CODEC.compress(x.astype("<u4").tobytes(), asbytes=True)


def _unsqueeze(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(_CODEC.decompress(raw, 4 * n, asbytes=True), "<u4").astype(np.int64)


def _block(block: int, docs: list, rows: list) -> pa.RecordBatch:
    sizes = np.array([len(r[5]) for r in rows], np.int64)
    pairs, places = np.unique(np.concatenate([r[5] for r in rows]), return_inverse=True)
    steps = np.diff(places, prepend=0)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    steps[starts] = places[starts]
    lists = [docs, *([r[k] for r in rows] for k in range(5)), sizes]
    types = [pa.int64()] * 5 + [pa.string(), pa.int64()]
    cols = [pa.array([x], pa.list_(t)) for x, t in zip(lists, types, strict=True)]
    blobs = [pa.array([_squeeze(steps)], pa.binary()), pa.array([_squeeze(np.concatenate([r[6] for r in rows]))], pa.binary())]
    ends = [pa.array([x], pa.list_(pa.int64())) for x in (pairs, np.bincount(places, minlength=len(pairs)))]
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *cols, *blobs, *ends], names=list(BLOCK))


def _portions(batches, size: int = 1 << 20):
    """(ids, texts) of about ``size`` characters."""
    for b in slices(batches, 256):
        docs, texts, n = [], [], 0
        for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            docs.append(d)
            texts.append(t)
            n += len(t or "")
            if n >= size:
                yield docs, texts
                docs, texts, n = [], [], 0
        if docs:
            yield docs, texts


def _blocks(path_a: str, path_b: str, limit: int):
    def run(batches):
        al = held(("align", path_a, path_b), lambda: Aligner(path_a, path_b))
        number, docs, rows, n = TaskContext.get().partitionId() << 32, [], [], 0
        for ids, texts in _portions(batches):
            docs += ids
            rows += (got := list(al.texts(texts)))
            n += sum(len(r[5]) + 64 for r in got)
            if n >= limit:
                yield _block(number, docs, rows)
                number, docs, rows, n = number + 1, [], [], 0
        if docs:
            yield _block(number, docs, rows)

    return run


def _documents(batches):
    for b in slices(batches, 1):
        r = b.to_pydict()
        sizes, n, best = np.array(r["sizes"][0], np.int64), np.array(r["n"][0] or [], np.int64), np.array(r["best"][0] or [], np.int64)
        total = int(sizes.sum())
        steps, times = _unsqueeze(r["places"][0], total), _unsqueeze(r["times"][0], total)
        starts = np.cumsum(sizes) - sizes
        run = np.cumsum(steps)
        own = sizes > 0
        places = run - np.repeat((run[starts[own]] - steps[starts[own]]), sizes[own]) if total else run
        count_sum, n_best = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        if total:
            count_sum[own] = np.add.reduceat(times * n[places], starts[own])
            n_best[own] = np.add.reduceat(times * best[places], starts[own])
        names = ["doc_id", *FIGURES]
        cols = [pa.array(r[c][0], pa.string() if c == "groups_sha256" else pa.int64()) for c in names]
        whole = pa.RecordBatch.from_arrays([*cols, pa.array(n_best), pa.array(count_sum)], names=[*names, "n_best", "count_sum"])
        yield from slices([whole], 4096)


def align(docs: DataFrame, a: str | None = None, b: str | None = None, pairs: int = PAIRS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) -> per document doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum; and the corpus's linked
    pairs: a, b, n (documents), best (whether n is the highest of its a)."""
    ship(docs.sparkSession)
    a, b = a or public_tokenizers.path(A), b or public_tokenizers.path(B)
    size = sentencepiece.SentencePieceProcessor(model_file=b).get_piece_size()
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    blocks = stage(docs.mapInArrow(_blocks(a, b, pairs), ", ".join(f"{c} {t}" for c, t in BLOCK.items())))
    each = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "holds")).alias("at", "p")).select("block", "at", F.col("p.pairs").alias("pair"), F.col("p.holds").alias("n"))
    sums = stage(each.groupBy("pair").agg(F.sum("n").alias("n")))
    highest = sums.groupBy(F.expr(f"pair div {size}").alias("a")).agg(F.max("n").alias("most"))
    counts = sums.withColumn("a", F.expr(f"pair div {size}")).join(highest, "a").select("pair", "a", "n", (F.col("n") == F.col("most")).alias("best"))
    known = each.select("block", "at", "pair").join(counts.select("pair", "n", "best"), "pair").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "n", F.col("best").cast("int").alias("best")))).alias("k"))
    back = blocks.select("block", "doc_id", *FIGURES, "sizes", "places", "times").join(known, "block", "left").select("doc_id", *FIGURES, "sizes", "places", "times", F.col("k.n").alias("n"), F.col("k.best").alias("best"))
    out = back.mapInArrow(_documents, ", ".join(f"{c} {t}" for c, t in ({"doc_id": "bigint"} | FIGURES | {"n_best": "bigint", "count_sum": "bigint"}).items()))
    return out, counts.select("a", F.expr(f"pair % {size}").alias("b"), "n", "best")
