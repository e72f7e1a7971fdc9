"""Text scoring by a hierarchical Pitman-Yor model.

Tokens are words (A-Z lower-cased) and one end per text. Each preceding word has a restaurant of its own (the end of a text is the context
of the next text's first word); all of them share one parent, the word restaurant, whose base measure spells words byte by byte. The
spelling is a hierarchy of restaurants for the preceding bytes (three, two, one, none), each with the restaurant of the shorter context
as parent, the last with the uniform distribution. The end is the empty word. Preceding bytes are grouped to classes (letters by
themselves; see ``CLASS``), so the spelling has at most 2^14 contexts and its tables a fixed size whatever the corpus.

Seating is sampled by Gibbs sweeps. In each, Spark re-seats the customers of every word given the spelling and the tables of the last
sweep, and sums the tables by cell of the spelling (the customers of its deepest restaurants); the driver then re-seats the spelling,
whose size is fixed, and Spark the contexts, whose tables are the word restaurant's customers of the next sweep. A pair of words seen once
has one table, so only pairs seen more often are seated. Large groups are seated in blocks of an eighth of those already seated.
Predictive probabilities of the last ``KEEP`` sweeps are averaged. Discounts follow from the numbers of cells with one and two customers;
the strength is 1.

Data flow: texts become blocks (numbered distinct words, texts as numbers), written once. A word's 64-bit hash names its part. Each block
sends each part one row of packed arrays: its words there with their counts, and its distinct pairs whose second word is there. Parts
count words and pairs and keep the pairs learnt more than once; in a sweep they send the tables of each context to the group of parts
that has the context's word and get the sums back, so no row of its own is made for a pair. The few words with more than half a part's share of
all tokens (``hot``) have their pairs dealt by the first word; their customers are summed by Spark and known to all parts. In the end each
part answers each block in the order in which it asked.

Null text counts as empty (its only token is the end). Rows where ``learn`` is null are scored and not learnt from; repeated rows count
again. Other columns are ignored. A word that the training texts lack has no customers, so its probability is its own spelling times what
the word restaurant leaves to its base; the score is thus the probability of the very text. (The add-one unigrams beside it know one
event for all such words.) With nothing to learn from, bytes are spelled uniformly.
"""

from __future__ import annotations

import gc
import itertools
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import ship, slices, stage

SWEEPS, KEEP, STRENGTH = 4, 2, 1.0
BLOCK_TOKENS = 4_000_000
_START, _END = 0x20, 0x0A  # bytes that no word has
_letters = np.arange(97, 123)


def _classes(others: int) -> np.ndarray:
    """Byte -> class: 0 the start, 1 to 26 the letters, further bytes spread over the rest."""
    out = 27 + np.arange(256) % others
    out[_letters] = np.arange(1, 27)
    out[_START] = 0
    return out


CLASS = (_classes(37), _classes(5), (_classes(5) * 5) % 8)  # of the last byte (64), the one before (32), the one before that (8)
BITS = (6, 5, 3)
LEVELS = (0, 6, 11, 14)  # bits of the contexts


def joined(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the words, and their bytes."""
    return np.fromiter(map(len, words), np.int64, len(words)), np.frombuffer(b"".join(words), np.uint8)


def cells_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Cell (context of three bytes, byte) of every byte of the words and their ends; lengths of the words with ends."""
    return _cells(*joined(words))


def _cells(lens: np.ndarray, blob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = lens + 1
    ends = np.cumsum(size + 3) - 1
    flat = np.full(int(ends[-1]) + 1 if len(lens) else 0, _START, np.uint8)
    flat[ends] = _END
    own = np.ones(len(flat), bool)
    for k in range(3):
        own[ends - lens - 3 + k] = False
    at = np.flatnonzero(own)
    text = np.ones(len(at), bool)
    text[np.cumsum(size) - 1] = False
    flat[at[text]] = blob
    context = CLASS[0][flat[at - 1]] << 8 | CLASS[1][flat[at - 2]] << 3 | CLASS[2][flat[at - 3]]
    return context << 8 | flat[at], size


def seat(c: np.ndarray, base: np.ndarray, tables: np.ndarray | float, discount: float, rng) -> np.ndarray:
    """Tables of c customers each, seated anew; ``tables`` is what the whole restaurant had."""
    t = np.minimum(c, 1).astype(np.int64)
    todo = np.flatnonzero(c > 1)
    n = np.ones(len(todo), np.int64)
    while len(todo):
        fresh = (STRENGTH + discount * (tables[todo] if isinstance(tables, np.ndarray) else tables)) * base[todo]
        step = np.minimum(c[todo] - n, np.maximum(1, n >> 3))
        t[todo] += rng.binomial(step, fresh / (n - discount * t[todo] + fresh))
        n += step
        go = n < c[todo]
        todo, n = todo[go], n[go]
    return t


def discount_of(c: np.ndarray) -> float:
    one, two = int((c == 1).sum()), int((c == 2).sum())
    return min(max(one / (one + 2 * two), 0.05), 0.95) if one else 0.5


def predictive(parent: np.ndarray, c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """Probabilities [context, byte] from those of the parents of the same contexts."""
    total, tables = c.sum(axis=1, keepdims=True), t.sum(axis=1, keepdims=True)
    return (c - discount * t + (STRENGTH + discount * tables) * parent) / (STRENGTH + total)


class Spelling:
    """Tables of all levels, deepest last; [context, byte]."""

    def __init__(self):
        self.tables = [np.zeros((1 << b, 256), np.int64) for b in LEVELS]
        self.prob = [np.full((1 << b, 256), 1 / 256) for b in LEVELS]

    def sweep(self, customers: np.ndarray, rng) -> None:
        counts, discounts = [None] * 4, [0.5] * 4
        c = customers.reshape(1 << LEVELS[3], 256)
        for k in (3, 2, 1, 0):
            counts[k], discounts[k] = c, discount_of(c)
            context, byte = np.nonzero(c)
            up = context >> (LEVELS[k] - LEVELS[k - 1]) if k else context
            base = self.prob[k - 1][up, byte] if k else np.full(len(byte), 1 / 256)
            t = np.zeros_like(c)
            t[context, byte] = seat(c[context, byte], base, self.tables[k].sum(axis=1)[context], discounts[k], rng)
            self.tables[k] = t
            if k:
                c = t.reshape(1 << LEVELS[k - 1], -1, 256).sum(axis=1)
        for k in range(4):
            parent = np.repeat(self.prob[k - 1], 1 << (LEVELS[k] - LEVELS[k - 1]), axis=0) if k else np.full((1, 256), 1 / 256)
            self.prob[k] = predictive(parent, counts[k], self.tables[k], discounts[k])


def packed(prob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logs of the distinct rows of ``prob`` and the row of each context: one without customers has its parent's."""
    rows, at = np.unique(np.ascontiguousarray(np.log(prob).astype(np.float32)).view("V1024").ravel(), return_inverse=True)
    return rows.view(np.float32).reshape(-1, 256), at.astype(np.uint16)


def spelled(words: tuple[np.ndarray, np.ndarray], log_prob: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-probability of spelling each of the joined words; cells and sizes."""
    cells, size = _cells(*words)
    rows, at = log_prob
    return np.add.reduceat(rows[at[cells >> 8], cells & 255], np.cumsum(size) - size) if len(size) else np.zeros(0), cells, size


def pairs_of(ids: np.ndarray, learns: np.ndarray, codes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (preceding word << 32 | word, or ``codes``) of a block, the pair of each token, how often each is learnt. Every text
    ends with the end, so the token before a text's first one is an end."""
    codes = np.roll(ids, 1).astype(np.int64) << 32 | ids if codes is None else codes
    order = np.argsort(codes)
    codes = codes[order]
    new = np.ones(len(codes), bool)
    np.not_equal(codes[1:], codes[:-1], out=new[1:])
    pair = np.empty(len(codes), np.int32)
    pair[order] = np.cumsum(new, dtype=np.int32) - 1
    del order  # blocks are long: no more arrays than needed at a time
    codes = codes[new]
    return codes, pair, np.bincount(pair[learns], minlength=len(codes))


def pack(*arrays: np.ndarray) -> bytes:
    """Numbers from 0 on as planes of bytes, as many as the largest needs (hashes: all eight), and floats in 4 bytes; compressed."""
    head, body = [len(arrays)], []
    for x in arrays:
        if x.dtype.kind == "f":
            head += [len(x), 0]
            body.append(x.astype("<f4").tobytes())
        else:
            width = 8 if x.dtype == np.uint64 else max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
            head += [len(x), width]
            body.append(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    raw = b"".join([np.array(head, "<i8").tobytes(), *body])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    count = int(np.frombuffer(raw, "<i8", 1)[0])
    at, out = 8 + 16 * count, []
    for n, width in np.frombuffer(raw, "<i8", 2 * count, 8).reshape(-1, 2).tolist():
        if width:
            x = np.zeros((n, 8), np.uint8)
            x[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
            out.append(x.view("<u8").ravel() if width == 8 else x.view("<i8").ravel())
        else:
            out.append(np.frombuffer(raw, "<f4", n, at).astype(float))
        at += n * (width or 4)
    return out


#: Kinds of rows that parts and blocks exchange.
BLOCK, WORDS, PAIRS, ASKS, STATE, TABLES, MOVING, SENT, SENT_LAST, ANSWER, ONES, HOT, STAT, CELLS = range(14)
ROW = "part int, kind int, at bigint, nums array<bigint>, data binary"
RANGES = 64  # of cells of the spelling
BLOCK_SCHEMA = "block bigint, docs array<bigint>, text binary, words binary, n bigint, top array<binary>, times array<bigint>"


def _row(part: int, kind: int, at: int = 0, nums=None, data: bytes | None = None) -> pa.RecordBatch:
    kinds = ((part, pa.int32()), (kind, pa.int32()), (at, pa.int64()), (nums and [int(x) for x in nums], pa.list_(pa.int64())), (data, pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in kinds], names=["part", "kind", "at", "nums", "data"])


def _hot_rows(ones: np.ndarray, t: np.ndarray) -> pa.RecordBatch:
    n = len(ones)
    columns = pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, HOT, np.int32)), pa.array(np.arange(n)), pa.array(np.column_stack([ones, t]).tolist(), pa.list_(pa.int64())), pa.nulls(n, pa.binary())
    return pa.RecordBatch.from_arrays(list(columns), names=["part", "kind", "at", "nums", "data"])


def _by_part(run):
    """run(part, rows by kind: (at, data) in order of at) for the parts of a task."""

    def tasks(batches):
        held = defaultdict(lambda: defaultdict(list))
        for b in slices(batches, 64):
            for part, kind, at, data in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                held[part][kind].append((at, data))
        for part in sorted(held):
            rows = held.pop(part)
            for x in rows.values():
                x.sort(key=lambda r: r[0])
            yield from run(part, rows)

    return tasks


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, seed=42) for w in words), np.uint64, len(words))


def _split(lens: np.ndarray, blob: np.ndarray) -> list[bytes]:
    raw, ends = blob.astype(np.uint8).tobytes(), np.cumsum(lens).tolist()
    return [raw[e - n : e] for e, n in zip(ends, lens.tolist(), strict=True)]


def _part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _blocks(limit: int):
    return lambda batches: _blocks_of(batches, limit)


def _blocks_of(batches, limit: int):
    base, number = TaskContext.get().partitionId() << 32, itertools.count()

    def row():
        flat, names = np.concatenate([*ids, np.zeros(0, np.uint32)]), list(local)
        sizes, learnt = np.array([len(x) for x in ids]), np.array(learns, bool)
        by_hash = np.argsort(_hashes(names))
        rank, common = np.empty(len(names), np.int64), np.empty(len(names), np.int64)
        rank[by_hash] = np.arange(len(names))
        by_times = np.argsort(-np.bincount(flat, minlength=len(names)), kind="stable")
        common[by_times] = np.arange(len(names))  # small numbers for frequent words
        tf = np.bincount(flat[np.repeat(learnt, sizes)], minlength=len(names))
        top = by_times[:2000]
        kinds = ((base + next(number), pa.int64()), (docs, pa.list_(pa.int64())), (pack(common[flat], rank[by_times], sizes, learnt), pa.binary()), (pack(*joined([names[i] for i in by_hash]), tf[by_hash]), pa.binary()), (len(flat), pa.int64()), ([names[i] for i in top], pa.list_(pa.binary())), (tf[top], pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in kinds], names=["block", "docs", "text", "words", "n", "top", "times"])

    def fresh():
        return defaultdict(itertools.count().__next__), [], [], [], 0

    local, ids, docs, learns, count = fresh()
    for b in slices(batches, 256):
        for doc, learn, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            words = [*(text or "").encode().lower().split(), b""]
            ids.append(np.fromiter(map(local.__getitem__, words), np.uint32, len(words)))
            docs.append(doc)
            learns.append(bool(learn))
            count += len(words)
            if count >= limit:
                yield row()
                local, ids, docs, learns, count = fresh()
    if docs:
        yield row()


class Coded:
    """A block's tokens (words numbered by hash) and its distinct pairs: by part, word and preceding word; then those of hot words."""

    def __init__(self, text: bytes, hashes: np.ndarray, parts: int, hot: np.ndarray):
        common, rank, self.sizes, learns = unpack(text)
        self.ids = rank.astype(np.int32)[common]
        del common
        before = np.roll(self.ids, 1)
        n, part = len(hashes), _part_of(hashes, parts)
        codes = self.ids.astype(np.int64)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)
            some = np.flatnonzero((hot[at] == hashes)[self.ids])
            codes[some] = n + part[before[some]] * len(hot) + at[self.ids[some]]
            del some
        codes <<= 32
        codes |= before
        del before
        learnt = np.repeat(learns.astype(bool), self.sizes)
        codes, self.pair, self.tf = pairs_of(self.ids, learnt, codes)
        self.word, self.context = codes >> 32, (codes & 0xFFFFFFFF).astype(np.int32)
        self.words_at = np.searchsorted(part, np.arange(parts + 1))
        self.pairs_at = np.searchsorted(self.word, self.words_at)
        self.hot_at = np.searchsorted(self.word, n + np.arange(parts + 1) * len(hot))


def _ask(parts: int, hot: np.ndarray):
    """Blocks -> rows for the parts."""

    def run(batches):
        for b in slices(batches, 1):
            block, text, words = (b.column(i)[0].as_py() for i in range(3))
            lens, blob, tf = unpack(words)
            hashes, ends = _hashes(_split(lens, blob)), np.concatenate([[0], np.cumsum(lens)])
            x = Coded(text, hashes, parts, hot)
            ones = np.bincount(x.context[x.tf == 1], minlength=len(lens))
            for p in range(parts):
                (a, z), (c, d), (e, f) = (at[p : p + 2].tolist() for at in (x.words_at, x.pairs_at, x.hot_at))
                if a == z and e == f:
                    continue
                both = lambda y, c=c, d=d, e=e, f=f: np.concatenate([y[c:d], y[e:f]])
                counts = np.bincount(x.word[c:d] - a, minlength=z - a), np.bincount(x.word[e:f] - len(lens) - p * len(hot), minlength=len(hot))
                yield _row(p, BLOCK, block, data=pack(lens[a:z], blob[ends[a] : ends[z]], tf[a:z], ones[a:z], *counts, hashes[both(x.context)], both(x.tf)))

    return run


def _stats(c: np.ndarray) -> list[int]:
    return [c.sum(), (c > 0).sum(), (c == 1).sum(), (c == 2).sum()]


def _groups(parts: int) -> int:
    """Sums of contexts are made by groups of parts, so that rows between them grow less than the square of the parts."""
    return min(parts, 2 * math.isqrt(parts))


def _to_groups(part: int, hashes: np.ndarray, parts: int, *arrays):
    """Sorted hashes and what belongs to them, to the groups of their parts."""
    groups = _groups(parts)
    at = np.searchsorted(_part_of(hashes, parts) * groups // parts, np.arange(groups + 1)).tolist()
    for g, (a, z) in enumerate(itertools.pairwise(at)):
        if a < z:
            yield _row(g, SENT, part, data=pack(hashes[a:z], *(x[a:z] for x in arrays)))


def _count(parts: int, hot: np.ndarray):
    """Of a part: counts of its words and pairs, what each block asks for, and the pairs learnt more than once with a table each."""

    def run(part, rows):
        got = [unpack(data) for _, data in rows[BLOCK]]
        lens, blob, times, ones_u, _, _, u, tf = (np.concatenate(x) for x in zip(*got, strict=True))
        names = _split(lens, blob)
        hashes, first, at = np.unique(_hashes(names), return_index=True, return_inverse=True)
        n, c, ones_u = len(hashes), *(np.bincount(at, x, len(hashes)).astype(np.int64) for x in (times, ones_u))
        mine = np.split(at, np.cumsum([len(x[0]) for x in got])[:-1])
        word = np.concatenate([np.concatenate([np.repeat(own, x[4]), n + np.repeat(np.arange(len(hot)), x[5])]) for own, x in zip(mine, got, strict=True)])
        contexts, context = np.unique(u, return_inverse=True)
        codes, pair = np.unique(word << 32 | context, return_inverse=True)
        total = np.bincount(pair, tf, len(codes)).astype(np.int64)
        ones_w = np.bincount(codes[total == 1] >> 32, minlength=n + len(hot))
        many = total > 1
        known, slot = np.unique(codes[many] & 0xFFFFFFFF, return_inverse=True)
        again = np.bincount(context[(tf == 1) & many[pair]], minlength=len(contexts))[known]  # learnt once in a block, more often in all
        word = codes[many] >> 32
        moving = np.unique(word[word < n])
        word = np.where(word < n, np.searchsorted(moving, word), len(moving) + word - n)
        still = np.setdiff1d(np.flatnonzero(~np.isin(hashes, hot)), moving)
        kept, shifts = joined([names[first[i]] for i in moving]), lambda x: np.diff(x, prepend=0)
        yield _row(part, WORDS, part, data=pack(*joined([names[i] for i in first]), c, ones_u, ones_w[:n], moving, still))
        yield _row(part, PAIRS, data=pack(total))
        for (block, _), own, some in zip(rows[BLOCK], mine, np.split(pair, np.cumsum([len(x[6]) for x in got])[:-1]), strict=True):
            yield _row(part, ASKS, block, data=pack(shifts(own), shifts(some)))
        ts = np.ones(len(word), np.int64)
        yield _row(part, STATE, data=pack(*kept, ones_w[moving], word, slot, total[many], contexts[known]))
        yield _row(part, TABLES, data=pack(ts, ts))
        per_word = np.bincount(word, minlength=len(moving) + len(hot))
        cs = ones_w[moving] + per_word[: len(moving)]
        yield _row(part, MOVING, nums=_stats(cs), data=pack(*kept, cs))
        yield _row(part, STAT, nums=[c.sum(), (c > 0).sum(), (total == 1).sum(), (total == 2).sum(), *_stats(ones_w[still])])
        yield _hot_rows(ones_w[n:], per_word[len(moving) :])
        yield from _to_groups(part, contexts[known], parts, np.bincount(slot, minlength=len(known)), again)

    return _by_part(run)


def _first_answers(group, rows):
    """To each part that sent contexts: how often these stand before a word just once, and the sums of their tables."""
    got = [unpack(data)[:4] for _, data in rows[WORDS]]
    ones, hashes = np.concatenate([*(x[3] for x in got), np.zeros(0, np.int64)]), _hashes([w for x in got for w in _split(*x[:2])])
    sums, sent = np.zeros(len(hashes), np.int64), []
    for of, data in rows[SENT]:
        h, t, again = unpack(data)
        sent.append((of, at := np.searchsorted(hashes, h)))
        sums[at] += t
        ones[at] -= again
    ends = np.cumsum([len(x[0]) for x in got]).tolist()
    for (part, _), x, end in zip(rows[WORDS], got, ends, strict=True):
        yield _row(part, ONES, data=pack(ones[end - len(x[0]) : end]))
    for of, at in sent:
        yield _row(of, ANSWER, group, data=pack(ones[at], sums[at]))


def _sums_of(sent):
    """Contexts, the sums of their tables, and the context of each one sent."""
    hashes, at = np.unique(np.concatenate([x[0] for x in sent]), return_inverse=True)
    return hashes, np.bincount(at, np.concatenate([x[1] for x in sent]), len(hashes)).astype(np.int64), at


def _answers(group, rows):
    sent = [unpack(data) for _, data in rows[SENT]]
    _, sums, at = _sums_of(sent)
    for (of, _), own in zip(rows[SENT], np.split(at, np.cumsum([len(x[0]) for x in sent])[:-1]), strict=True):
        yield _row(of, ANSWER, group, data=pack(sums[own]))


def _last_sums(parts: int):
    """Of the two sweeps kept: the sums of contexts, to the parts of their words."""

    def run(_, rows):
        for kind, sent in rows.items():
            hashes, sums, _ = _sums_of([unpack(data) for _, data in sent])
            part = _part_of(hashes, parts)
            for p in np.unique(part).tolist():
                a, z = np.searchsorted(part, [p, p + 1]).tolist()
                yield _row(p, kind, data=pack(hashes[a:z], sums[a:z]))

    return _by_part(run)


def _reseat(sent, sweep: int):
    """Sums of tables by cell, packed by ranges of cells; and of all."""

    def run(batches):
        log_prob, tables, discount, _ = sent.value[0]
        total, sums = 0, np.zeros(1 << (LEVELS[3] + 8))
        for b in slices(batches, 1):
            part, kind, data = (b.column(i)[0].as_py() for i in (0, 1, 4))
            lens, blob, c, *more = unpack(data)
            if kind == WORDS:  # those of pairs learnt once keep their customers
                own = np.zeros(len(lens), bool)
                own[more[3]] = True
                lens, blob, c = lens[own], blob[np.repeat(own, lens)], more[1][own]
            some = c > 0
            lens, blob, c = lens[some], blob[np.repeat(some, lens)], c[some]
            base, cells, size = spelled((lens, blob.astype(np.uint8)), log_prob)
            t = seat(c, np.exp(base), tables, discount, np.random.default_rng([part, kind, sweep]))
            total += int(t.sum())
            sums += np.bincount(cells, np.repeat(t, size), len(sums))
        if total:
            yield _row(0, STAT, nums=[total])
            for k, x in enumerate(sums.astype(np.int64).reshape(RANGES, -1)):
                at = np.flatnonzero(x)
                if len(at):
                    yield _row(k, CELLS, data=pack(at, x[at]))

    return run


def _add_cells(part, rows):
    sums = np.zeros((1 << (LEVELS[3] + 8)) // RANGES, np.int64)
    for _, data in rows[CELLS]:
        at, t = unpack(data)
        sums[at] += t
    at = np.flatnonzero(sums)
    yield _row(part, CELLS, data=pack(at, sums[at]))


def _log_probs(words, c, sample, seed: list[int]) -> np.ndarray:
    """Natural log of each word's probability in the word restaurant."""
    log_prob, tables, discount, n = sample
    base = spelled(words, log_prob)[0].astype(float)
    t = seat(c, np.exp(base), tables, discount, np.random.default_rng(seed))
    own = np.log(c - discount * t, out=np.full(len(c), -np.inf), where=c > 0)
    return np.logaddexp(own, base + np.log(STRENGTH + discount * tables)) - np.log(STRENGTH + n)  # logs: a long word's spelling is below the least float


def _seat_pairs(sent, parts: int, discount: float, sweep: int):
    """Of a part: its pairs seated anew, and what follows for contexts, words and hot words."""

    def run(part, rows):
        sample, hot, hot_cs = sent.value
        lens, blob, ones_w, word, slot, c, contexts = unpack(rows[STATE][0][1])
        before, last, *ones_u = unpack(rows[TABLES][0][1])
        answers = [unpack(data) for _, data in rows[ANSWER]]
        *first, tables = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in zip(*answers, strict=True)) if answers else (np.zeros(0, np.int64),) * 2
        ones_u = first[0] if first else ones_u[0]
        words, n = (lens, blob.astype(np.uint8)), len(lens)
        lp = np.concatenate([_log_probs(words, ones_w + np.bincount(word, last, n + len(hot_cs)).astype(np.int64)[:n], sample, [1, part, sweep]), _log_probs(hot, hot_cs, sample, [2, sweep])])
        t = seat(c, np.exp(lp[word]), (ones_u + tables)[slot], discount, np.random.default_rng([3, part, sweep]))
        per_word = np.bincount(word, t, n + len(hot_cs)).astype(np.int64)
        cs = ones_w + per_word[:n]
        yield _row(part, TABLES, data=pack(last, t, ones_u))
        yield _row(part, MOVING, nums=_stats(cs), data=pack(*words, cs))
        yield _hot_rows(np.zeros(len(hot_cs), np.int64), per_word[n:])
        yield from _to_groups(part, contexts, parts, np.bincount(slot, t, len(contexts)).astype(np.int64))

    return _by_part(run)


def _reply(sent, hot: np.ndarray):
    """Of a part: to each block that asked, its words' counts, tables as contexts and log-probabilities, its pairs' counts and tables."""

    def run(part, rows):
        samples, hot_cs = sent.value
        lens, blob, c, _, ones_w, moving, _ = unpack(rows[WORDS][0][1])
        words = lens, blob.astype(np.uint8)
        hashes, ones_u, total = _hashes(_split(*words)), unpack(rows[ONES][0][1])[0], unpack(rows[PAIRS][0][1])[0]
        word, ts = unpack(rows[STATE][0][1])[3], unpack(rows[TABLES][0][1])[:KEEP]
        at = np.minimum(np.searchsorted(hot, hashes), max(len(hot) - 1, 0))
        here = np.flatnonzero(hot[at] == hashes) if len(hot) else np.zeros(0, int)
        tables, log_probs, seated = [], [], []
        for k, kind in enumerate((SENT, SENT_LAST)):
            cs, tus, t = ones_w.copy(), ones_u.copy(), np.minimum(total, 1)
            cs[moving] += np.bincount(word, ts[k], len(moving)).astype(np.int64)[: len(moving)]
            cs[here] = hot_cs[k][at[here]]
            log_probs.append(_log_probs(words, cs, samples[k], [4, part, k]))
            for _, data in rows[kind]:
                h, x = unpack(data)
                tus[np.searchsorted(hashes, h)] += x
            tables.append(tus)
            t[total > 1] = ts[k]
            seated.append(t)
        for block, data in rows[ASKS]:
            w, p = (np.cumsum(x) for x in unpack(data))
            yield _row(part, ANSWER, block, data=pack(c[w], *(x[w] for x in (*tables, *log_probs)), total[p], *(x[p] for x in seated)))

    return _by_part(run)


def _text_scores(parts: int, hot: np.ndarray, n: int, v: int, discount: float):
    """Rows (block, part, data, docs, text, words), a block's text (part -1) before its parts' answers."""

    def texts(docs, text, words, answers):
        hashes = _hashes(_split(*unpack(words)[:2]))
        x = Coded(text, hashes, parts, hot)
        own, (c, *ts) = [], (np.zeros(len(x.word), np.int64) for _ in range(1 + KEEP))
        for p, data in answers:
            y = unpack(data)
            own.append(y[: 1 + 2 * KEEP])
            (a, z), (e, f) = (at[p : p + 2].tolist() for at in (x.pairs_at, x.hot_at))
            for to, new in zip((c, *ts), y[1 + 2 * KEEP :], strict=True):
                to[a:z], to[e:f] = new[: z - a], new[z - a :]
        counts, *scores = (np.concatenate(k) for k in zip(*own, strict=True))
        w, u = np.zeros(len(c), np.int32), x.context
        w[x.pair] = x.ids
        lp = np.full(len(c), -np.inf)
        for k, t in enumerate(ts):
            own = np.log(c - discount * t, out=np.full(len(c), -np.inf), where=c > 0)
            lp = np.logaddexp(lp, np.logaddexp(own, scores[KEEP + k][w] + np.log(STRENGTH + discount * scores[k][u])) - np.log(STRENGTH + counts[u]))
        lp = (lp - np.log(KEEP)) / np.log(10)
        first = np.cumsum(x.sizes) - x.sizes
        total = lambda y: np.add.reduceat(y, first)
        base = np.log10((counts + 1) / (n + v + 1))
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(x.sizes, pa.int64()), pa.array(total((counts > 0).astype(np.int64)[x.ids])), pa.array(total(base[x.ids])), pa.array(total(lp[x.pair]))], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    def run(batches):
        head, answers = None, []
        for b in slices(batches, 1):
            _, part, data, docs, text, words = (b.column(i)[0].as_py() for i in range(6))
            if part < 0:
                if head:
                    yield texts(*head, answers)
                head, answers = (docs, text, words), []
            else:
                answers.append((part, data))
        if head:
            yield texts(*head, answers)

    return run


def _discount(one: int, two: int) -> float:
    return min(max(one / (one + 2 * two), 0.05), 0.95) if one else 0.5


def _sums(rows: DataFrame, kind: int, width: int) -> list[int]:
    return list(rows.filter(F.col("kind") == kind).agg(*[F.coalesce(F.sum(F.col("nums")[k]), F.lit(0)) for k in range(width)]).first())


def _release(spark) -> None:
    """Shuffle files of finished jobs go when the driver's garbage is collected; what they led to is staged."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def score(docs: DataFrame, learn: Column, sweeps: int = SWEEPS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, text) -> doc_id, n_tokens, n_known, train_tokens, base_score (add-one unigrams), score; log10 of whole texts."""
    spark = docs.sparkSession
    ship(spark)
    blocks = stage(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), "text").mapInArrow(_blocks(block_tokens), BLOCK_SCHEMA))
    count, size, each = blocks.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.expr("coalesce(max(block & 4294967295), 0) + 1")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), count)
    top = blocks.select(F.explode(F.arrays_zip("top", "times")).alias("x")).groupBy("x.top").agg(F.sum("x.times").alias("c"))
    names = [bytes(r[0]) for r in top.filter(F.col("c") * 2 * parts > size).select("top").collect()]  # under 2 * parts words
    hot = np.sort(_hashes(names))
    hot_words = joined(sorted(names, key=lambda w: xxhash.xxh64_intdigest(w, seed=42)))

    def meet(rows, run, number=parts):
        return rows.repartitionById(number, F.col("part")).mapInArrow(run, ROW)

    def kinds(rows, *some):
        return rows.filter(F.col("kind").isin(*some))

    def hot_sums(rows):
        out = np.zeros((2, len(hot)), np.int64)
        for k, ones, t in kinds(rows, HOT).groupBy("at").agg(F.sum(F.col("nums")[0]), F.sum(F.col("nums")[1])).collect():
            out[:, k] = ones, t
        return out

    made = stage(meet(blocks.select("block", "text", "words").mapInArrow(_ask(parts, hot), ROW), _count(parts, hot)))
    groups = _groups(parts)
    grouped = kinds(made, WORDS).withColumn("part", F.expr(f"cast(part * {groups} div {parts} as int)"))
    answers = stage(meet(grouped.unionByName(kinds(made, SENT)), _by_part(_first_answers), groups))
    _release(spark)
    n, v, ones, twos, *still = _sums(made, STAT, 8)
    pair_discount = _discount(ones, twos)
    hot_ones, t = hot_sums(made)
    hot_cs, sent_tables, now = [hot_ones + t] * KEEP, [kinds(made, SENT)] * KEEP, made
    known_ones, asked = kinds(answers, ONES), kinds(answers, ANSWER)

    spelling, tables, rng, samples = Spelling(), None, np.random.default_rng(10), []
    for k in range(sweeps):
        customers, known, one, two = (a + b + c for a, b, c in zip(still, _sums(now, MOVING, 4), map(int, _stats(hot_cs[-1])), strict=True))
        tables = float(known) if tables is None else tables
        samples.append((packed(spelling.prob[3]), tables, _discount(one, two), customers))
        if k + 1 == sweeps:
            break
        sent = spark.sparkContext.broadcast((samples[-1], hot_words, hot_cs[-1]))
        cells = stage(kinds(made, WORDS).unionByName(kinds(now, MOVING)).mapInArrow(_reseat(sent, k), ROW))
        sums = np.zeros((RANGES, (1 << (LEVELS[3] + 8)) // RANGES), np.int64)
        for r in meet(kinds(cells, CELLS), _by_part(_add_cells), RANGES).collect():  # of fixed size
            at, t = unpack(r.data)
            sums[r.part, at] = t
        some = hot_cs[-1] > 0
        base, at, lens = spelled((hot_words[0][some], hot_words[1][np.repeat(some, hot_words[0])]), samples[-1][0])
        t = seat(hot_cs[-1][some], np.exp(base), tables, samples[-1][2], rng)
        np.add.at(sums.reshape(-1), at, np.repeat(t, lens))
        tables = float(_sums(cells, STAT, 1)[0] + t.sum())
        spelling.sweep(sums.reshape(-1), rng)
        if k:
            asked = meet(sent_tables[-1], _by_part(_answers), groups)
        now = stage(meet(kinds(made, STATE).unionByName(kinds(now, TABLES)).unionByName(asked), _seat_pairs(sent, parts, pair_discount, k)))
        hot_cs, sent_tables = [*hot_cs[1:], hot_ones + hot_sums(now)[1]], [*sent_tables[1:], kinds(now, SENT)]
        sent.destroy()  # what was made with it is written
        _release(spark)
    samples = [samples[0]] * (KEEP - len(samples)) + samples
    sent = spark.sparkContext.broadcast((samples[-KEEP:], hot_cs))
    of_parts = kinds(made, WORDS, PAIRS, ASKS, STATE).unionByName(kinds(now, TABLES)).unionByName(known_ones)
    last_sums = meet(sent_tables[0].unionByName(sent_tables[1].withColumn("kind", F.lit(SENT_LAST))), _last_sums(parts), groups)
    of_parts = of_parts.unionByName(last_sums)
    replies = meet(of_parts, _reply(sent, hot)).select(F.col("at").alias("block"), "part", "data", *[F.lit(None).cast(t).alias(c) for c, t in (("docs", "array<bigint>"), ("text", "binary"), ("words", "binary"))])
    heads = blocks.select("block", F.lit(-1).alias("part"), F.lit(None).cast("binary").alias("data"), "docs", "text", "words")
    out = heads.unionByName(replies).repartitionById(parts, F.expr(f"cast(pmod(shiftright(block, 32) * {each} + (block & 4294967295), {parts}) as int)")).sortWithinPartitions("block", "part").mapInArrow(_text_scores(parts, hot, n, v, pair_discount), "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score")


def perplexity(total_log10: float, tokens: int) -> float:
    """Per token, from the sum of scores."""
    return math.pow(10, -total_log10 / max(tokens, 1))
