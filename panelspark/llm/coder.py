"""Adaptive context-mixing range coder for token ids.

Ids are coded in blocks that start from the same state, so each can be read alone; blocks are coded side by side, one id of every block
at a time, each block by range coders of its own (48-bit low and range, 24-bit words; carries are settled when a block is done). Three
orders predict:

* order 2 and order 1: the id that last followed the two ids, or the id, before; with a confidence from hits and misses. Whether the
  order-2 id comes, else the order-1 id, else another, is one decision. Its distribution is mixed from two adaptive estimates, one by the
  order-2 confidence and agreement and one by both confidences and agreement, by a weight that moves towards the estimate that did better.
* order 0: other ids are a stream of their own, coded by a distribution that its blocks share: what ``shares`` finds for the other ids of
  all of them, which is to be kept beside the blocks, or else the uniform one.

A block is two u32 (words of the decisions, other ids), the words of the decisions, those of the other ids (3 bytes each, the highest
first) and a zero byte if odd. Ids are below 65,536.
"""

from __future__ import annotations

import numpy as np

BLOCK = 4096
SHARE_BITS, WORD, TOP = 18, 24, 48
_LEAST, _CARRY = 1 << (TOP - WORD), (1 << WORD) - 1
_SLOTS1, _SLOTS2 = 1 << 10, 1 << 12
#: A distribution of the three outcomes is two bounds out of 65,536, the lower one in the low half of an int64, the upper one in the high half.
# Arrays, since a number would be made one in every call.
_FIELDS, _LOW, _HIGH, _SIGN, _SPAN, _TOWARDS, _TWELVE, _FIFTEEN, _SIXTEEN, _FOUR, _FIVE = (np.array(x) for x in (0xFFFF_0000_FFFF, 0xFFF, 32, 63, 4096 - 512, 256, 12, 15, 16, 4, 5))
_FACTOR1, _FACTOR2, _MASK1, _MASK2, _ONE, _THREE, _FOUR4, _SIX, _SEVEN = (np.array(x, np.int32) for x in (40503, 60493, _SLOTS1 - 1, _SLOTS2 - 1, 1, 3, 4, 6, 7))


def _bounds(low: int, high: int) -> int:
    return high << 32 | low


_START = _bounds(65536 // 3, 65536 * 2 // 3)
_GOALS = np.array([_bounds(65536 - 512, 65536 - 256), _bounds(256, 65536 - 256), _bounds(256, 512)], np.int64)  # every outcome keeps 1 in 256, so two decisions fit in 24 bits of a range
#: The difference of two distributions times this is below zero where the first gave the outcome more: adds or subtracts the halves.
_NEARER = np.array([-((1 << 32) + 1), (1 << 32) - 1, (1 << 32) + 1], np.int64)
_CONFIDENCE = np.array([s for c in range(8) for s in (c >> 1, min(c + 1, 7))], np.int32)  # after a miss, after a hit


class Coders:
    """Range coders side by side; ``words`` (row per coder) are given to read or, with ``room`` of them each, made to write."""

    def __init__(self, n: int, words: np.ndarray | None, room: int = 0):
        self.range = np.full(n, 1 << TOP, np.int64)
        self.reads = words is not None
        self.words = words.ravel() if self.reads else np.zeros(n * room, np.uint32)
        self.room = words.shape[1] if self.reads else room
        self.pos = np.arange(n) * self.room + 2 * self.reads
        self.at = np.zeros(n, np.int64)  # low, or the code less low
        if self.reads:
            self.at = words[:, 0].astype(np.int64) << WORD | words[:, 1]

    def narrow(self, low: np.ndarray, size: np.ndarray, settle: bool = True) -> None:
        """The first coders, as many as ``low`` has, go on with the part [low, low + size) of their range; ``settle``: and with words."""
        k, at = len(low), self.at[: len(low)]
        self.range[:k] = size
        if self.reads:
            at -= low
        else:
            at += low
        if not settle:
            return
        move = (size < _LEAST).nonzero()[0]
        if len(move):
            self.range[move] = size.take(move) << WORD
            there, value = self.pos.take(move), at.take(move)
            if self.reads:
                at[move] = value << WORD | self.words.take(there, mode="clip")  # a damaged block may ask for more
            else:
                self.words[there] = value >> WORD
                at[move] = (value & _CARRY) << WORD
            self.pos[move] = there + 1

    def written(self) -> list[np.ndarray]:
        """Words of each coder."""
        count = self.pos - np.arange(len(self.pos)) * self.room
        words = self.words.reshape(len(count), self.room) if len(count) else self.words.reshape(0, 2)
        words[np.arange(len(count)), count], words[np.arange(len(count)), count + 1] = self.at >> WORD, self.at & _CARRY
        while True:
            lane, there = (words > _CARRY).nonzero()
            if not len(lane):
                return [w[: c + 2] for w, c in zip(words, count.tolist(), strict=True)]
            words[lane, there] &= _CARRY
            words[lane, there - 1] += 1


def _active(sizes: np.ndarray) -> list[int]:
    """Of sizes in falling order, how many are above 0, 1, 2, ..."""
    return np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0))), side="left").tolist()


def _model(sizes: np.ndarray, ids: np.ndarray | None, coders: Coders, others: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Runs over blocks in falling order of size; returns all ids (a row for each step, two before the first) and where no order hit.
    Order 1 and order 2, and the two estimates, stand one behind the other in the same arrays: one call serves both."""
    n, longest = len(sizes), int(sizes.max(initial=0))
    table = np.zeros((longest + 2, n), np.int32) if ids is None else ids
    missed = np.zeros((longest, n), bool)
    lane = np.arange(n)
    last = np.zeros(n * (_SLOTS1 + _SLOTS2), np.int32)  # id << 3 | confidence
    estimates, weights = np.full(n * 144, _START, np.int64), np.full((2, n), 2048)
    if others is not None:
        places, others = np.arange(n) * others.shape[1], others.ravel()
    k = -1
    for t, active in enumerate(_active(sizes)):
        if active != k:
            if k >= 0:
                weights[:, :k] = w
            k = active
            base = np.concatenate([lane[:k] * _SLOTS1, n * _SLOTS1 + lane[:k] * _SLOTS2])
            spot = np.concatenate([lane[:k] * 16, n * 16 + lane[:k] * 128])
            w, whole, at = weights[:, :k].copy(), coders.range[:k], coders.at[:k]
            hashes, context, hit, twice = np.zeros(2 * k, np.int32), np.zeros(2 * k, np.int32), np.zeros(2 * k, bool), np.zeros(2 * k, np.int32)
            hash1, hash2, context1, context2, hit1, hit2, now, again = *(x[h] for x in (hashes, context, hit, twice) for h in (slice(k), slice(k, None))),
            w1, w2 = w
            now[:], after_next = table[t + 1, :k], table[t, :k] * _FACTOR2
        np.multiply(now, _FACTOR1, out=hash1)
        np.add(hash1, after_next, out=hash2)
        hashes >>= _SIX
        hash1 &= _MASK1
        hash2 &= _MASK2
        slot = hashes + base
        e = last.take(slot)
        p, s = e >> _THREE, e & _SEVEN
        p1, p2 = p[:k], p[k:]
        np.left_shift(s[k:], _ONE, out=context1)
        context1 += p1 == p2
        np.left_shift(s[:k], _FOUR4, out=context2)
        context2 += context1
        where = context + spot
        x = estimates.take(where)
        x1, x2 = x[:k], x[k:]
        mix = x1 * w1
        mix += x2 * w2
        mix >>= _SIXTEEN
        unit = whole >> _TWELVE
        bound2 = mix >> _HIGH
        bound2 *= unit
        mix &= _LOW
        mix *= unit
        after_next = now * _FACTOR2
        if ids is None:
            not2, no = at >= mix, at >= bound2
            np.copyto(now, p2)
            np.copyto(now, p1, where=not2)
            np.copyto(now, others.take(places[:k], mode="clip"), where=no)
            places[:k] += no
            table[t + 2, :k] = now
            again[:] = now
            np.equal(twice, p, out=hit)
        else:
            now[:] = again[:] = table[t + 2, :k]
            np.equal(twice, p, out=hit)
            not2 = ~hit2
            no = not2 & ~hit1
        missed[t, :k] = no
        outcome = np.add(not2, no, dtype=np.int64)
        low = mix * not2
        np.copyto(low, bound2, where=no)
        size = bound2
        np.copyto(size, mix, where=hit2)
        np.copyto(size, whole, where=no)
        size -= low
        coders.narrow(low, size, t % 2 == 1)
        d = x1 - x2
        d *= _NEARER.take(outcome)
        goal = _GOALS.take(outcome)
        x *= _FIFTEEN
        x1 += goal
        x2 += goal
        x >>= _FOUR
        x &= _FIELDS
        estimates[where] = x
        d >>= _SIGN  # -1 where the first estimate was nearer
        d &= _SPAN
        d += _TOWARDS
        d -= w1
        d >>= _FIVE
        w1 += d
        w2 -= d
        np.copyto(p, twice, where=s <= _ONE)
        p <<= _THREE
        s <<= _ONE
        s += hit
        p += _CONFIDENCE.take(s)
        last[slot] = p
    coders.narrow(np.zeros(n, np.int64), coders.range.copy(), True)
    return table, missed


def shares(count: np.ndarray) -> np.ndarray:
    """Shares of 2^18 for ids met so often; at least one for each id met."""
    met = np.flatnonzero(count)
    out = np.zeros(len(count), np.int64)
    if len(met):
        out[met] = 1 + (count[met] * ((1 << SHARE_BITS) - len(met)) // count.sum())
        out[out.argmax()] += (1 << SHARE_BITS) - out.sum()
    return out


def _uniform() -> np.ndarray:
    return np.full(1 << 16, 1 << (SHARE_BITS - 16), np.int64)


def _write_others(sizes: np.ndarray, ids: np.ndarray, share: np.ndarray) -> list[np.ndarray]:
    """Blocks in falling order of size, a row for each step."""
    start = np.cumsum(share) - share
    coders = Coders(len(sizes), None, len(ids) + 2)
    for t, k in enumerate(_active(sizes)):
        x, unit = ids[t, :k], coders.range[:k] >> SHARE_BITS
        coders.narrow(unit * start.take(x), unit * share.take(x))
    return coders.written()


def _read_others(sizes: np.ndarray, words: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Row for each block."""
    start, of = np.cumsum(share) - share, np.repeat(np.arange(len(share), dtype=np.uint16), share)
    out = np.zeros((int(sizes.max(initial=0)), len(sizes)), np.uint16)
    coders = Coders(len(sizes), words)
    for t, k in enumerate(_active(sizes)):
        unit = coders.range[:k] >> SHARE_BITS
        x = of.take((coders.at[:k] / unit).astype(np.int64), mode="clip")  # exact: the quotient is below 2^18, both below 2^48
        coders.narrow(unit * start.take(x), unit * share.take(x))
        out[t, :k] = x
    return np.ascontiguousarray(out.T)


def _rows(parts: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(parts), width), np.uint32)
    for row, p in zip(out, parts, strict=True):
        row[: len(p)] = p
    return out


def _bytes(words: np.ndarray) -> bytes:
    return np.ascontiguousarray(words.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:]).tobytes()


def _words(raw: np.ndarray) -> np.ndarray:
    three = raw[: len(raw) // 3 * 3].reshape(-1, 3).astype(np.uint32)
    return three[:, 0] << 16 | three[:, 1] << 8 | three[:, 2]


def encode_shared(blocks: list[np.ndarray], shared: bool = True) -> tuple[np.ndarray, list[np.ndarray]]:
    """Shares of the ids for order 0 (uniform unless ``shared``); 16-bit words of each block."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    sizes = np.array([len(blocks[i]) for i in order], np.int64)
    table = np.zeros((int(sizes.max(initial=0)) + 2, len(sizes)), np.int32)
    for column, i in enumerate(order):
        table[2 : 2 + len(blocks[i]), column] = blocks[i]
    coders = Coders(len(sizes), None, len(table) + 2)
    missed = _model(sizes, table, coders, None)[1].T
    counts = missed.sum(axis=1)
    flat = np.ascontiguousarray(table[2:].T)[missed]  # block after block
    del table, missed
    share = shares(np.bincount(flat, minlength=1 << 16)) if shared else _uniform()
    most = np.argsort(-counts, kind="stable")
    first = np.cumsum(counts) - counts
    others = np.zeros((int(counts.max(initial=0)), len(counts)), np.int64)
    for column, j in enumerate(most.tolist()):
        others[: counts[j], column] = flat[first[j] : first[j] + counts[j]]
    tails: list = [None] * len(blocks)
    for j, w in zip(most.tolist(), _write_others(counts[most], others, share), strict=True):
        tails[j] = w
    out: list = [None] * len(blocks)
    for j, (i, w) in enumerate(zip(order, coders.written(), strict=True)):
        raw = np.array([len(w), counts[j]], "<u4").tobytes() + _bytes(w) + _bytes(tails[j])
        out[i] = np.frombuffer(raw + bytes(len(raw) % 2), "<u2")
    return share, out


def encode(blocks: list[np.ndarray]) -> list[np.ndarray]:
    """16-bit words of each block, to be read without anything beside them."""
    return encode_shared(blocks, False)[1]


def decode(words: list[np.ndarray], sizes: list[int], share: np.ndarray | None = None) -> list[np.ndarray]:
    share = _uniform() if share is None else share
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    heads, tails, counts = [], [], []
    for i in order:
        raw = np.frombuffer(words[i].tobytes(), np.uint8)
        n_words, n_others = np.frombuffer(raw[:8], "<u4").tolist() if len(raw) >= 8 else (0, 0)
        if n_words < 2 or 8 + 3 * n_words > len(raw) or n_others > sizes[i] or n_others and not share.any():
            raise ValueError(f"damaged block {i}")
        heads.append(_words(raw[8 : 8 + 3 * n_words]))
        tails.append(_words(raw[8 + 3 * n_words :]))
        counts.append(n_others)
    counts, wide = np.array(counts, np.int64), 2 + max(map(len, [*heads, *tails]), default=0)
    most = np.argsort(-counts, kind="stable")
    read = _read_others(counts[most], _rows([tails[j] for j in most], wide), share)
    others = np.zeros((len(order), read.shape[1] + 1), np.int32)
    others[most, :-1] = read
    by_size = np.array([sizes[i] for i in order], np.int64)
    table = np.ascontiguousarray(_model(by_size, None, Coders(len(order), _rows(heads, wide)), others)[0].T)
    out: list = [None] * len(sizes)
    for k, i in enumerate(order):
        out[i] = table[k, 2 : 2 + sizes[i]]
    return out
