import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from panelspark.llm import lm


def tokens(t):
    return [*(t or "").encode().lower().split(), b""]


def base_scores(rows, learns):
    c = Counter(w for (_, t), y in zip(rows, learns, strict=True) if y for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return n, [(len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))) for _, t in rows]


def test_spelling_is_a_distribution_and_seats_are_counts():
    rng = np.random.default_rng(1)
    cells, size = lm.cells_of([b"abc", b"", "ü".encode()])
    assert size.tolist() == [4, 1, 3] and (cells & 255).tolist() == [97, 98, 99, 10, 10, *"ü".encode(), 10]
    assert cells[4] == 10 and cells[0] >> 8 == 0 and cells[1] >> 8 == lm.CLASS[0][97] << 8
    customers = np.bincount(np.repeat(cells, rng.integers(1, 90, len(cells))), minlength=1 << 22)
    s = lm.Spelling()
    for _ in range(3):
        s.sweep(customers, rng)
        for p, t in zip(s.prob, s.tables, strict=True):
            assert np.allclose(p.sum(axis=1), 1) and (p > 0).all() and (t >= 0).all()
        rows, at = lm.packed(s.prob[3])
        assert np.array_equal(rows[at], np.log(s.prob[3]).astype(np.float32)) and len(rows) < 30
    c = rng.integers(1, 5000, 300)
    t = lm.seat(c, np.full(300, 0.3), 50.0, 0.6, rng)
    assert (t >= 1).all() and (t <= c).all()
    assert (lm.seat(np.ones(4, int), np.ones(4), 1.0, 0.5, rng) == 1).all()


def test_query_on_whole_table(spark):
    from panelspark.llm.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    learns = [zlib.crc32(str(d).encode()) % 7 != 2 for d, _ in rows]
    n, exp = base_scores(rows, learns)
    got = {r.doc_id: r for r in QUERIES["op10_pitman_yor_scores"](spark, sf).collect()}
    assert len(got) == len(rows)
    for (d, _), y, (k, known, base) in zip(rows, learns, exp, strict=True):
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not y, k, known, n) and abs(r.base_score - base) < 1e-6 and r.score < 0
    held = [r for r in got.values() if r.held_out]
    size = sum(r.n_tokens for r in held)
    plain = spelled_unigram([t for (_, t), y in zip(rows, learns, strict=True) if y], [t for (_, t), y in zip(rows, learns, strict=True) if not y])
    assert lm.perplexity(sum(r.score for r in held), size) < lm.perplexity(plain, size)


def spelled_unigram(train, held):
    """log10 of held-out texts: add-one word counts, an unknown word taking the unknown's share by its bytes' frequencies."""
    c = Counter(w for t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    b = Counter(x for w in c for x in [*w, 10])
    m = sum(b.values()) + 256
    return sum(math.log10((c[w] + 1) / (n + v + 1)) + (0 if c[w] else sum(math.log10((b[x] + 1) / m) for x in [*w, 10])) for t in held for w in tokens(t))


def test_pairs_of_a_block():
    ids, learns = np.array([0, 1, 0, 2, 3, 1, 2], np.uint32), np.array([True, True, True, True, False, False, False])  # texts 0 1 0 2 and 3 1 2; 2 is the end
    codes, pair, times = lm.pairs_of(ids, learns)
    named = [(int(c) >> 32, int(c) & 0xFFFFFFFF) for c in codes]
    assert [named[k] for k in pair] == [(2, 0), (0, 1), (1, 0), (0, 2), (2, 3), (3, 1), (1, 2)]
    assert {p: int(t) for p, t in zip(named, times, strict=True) if t} == {(2, 0): 1, (0, 1): 1, (1, 0): 1, (0, 2): 1}


def test_hash_is_sparks(spark):
    import xxhash

    words = [b"", b"a", "über".encode(), b"z" * 100]
    got = spark.createDataFrame([(w,) for w in words], "w binary").select("w", F.xxhash64("w").alias("h")).collect()
    assert {bytes(r.w): r.h & (1 << 64) - 1 for r in got} == {w: xxhash.xxh64_intdigest(w, seed=42) for w in words}


def test_next_words_by_counts(spark):
    """Texts of one word: about the shares of their two pairs, whatever the block size, and all together below 1."""
    rng = np.random.default_rng(3)
    train = [(d, " ".join(rng.choice(["ka", "lo", "mi", "nu"], 30))) for d in range(60)]
    ask = {1000: "", 1001: "ka", 1002: "lo", 1003: "mi", 1004: "nu", 1005: "xy"}
    follows = Counter(p for _, t in train for ws in [["", *t.split(), ""]] for p in zip(ws, ws[1:], strict=False))
    of = Counter(w for _, t in train for w in tokens(t))
    docs = spark.createDataFrame(train + list(ask.items()), "doc_id long, text string")
    for size in (4_000_000, 100):
        got = {r.doc_id: 10**r.score for r in lm.score(docs.repartition(3), F.col("doc_id") < 1000, block_tokens=size).collect()}
        assert sum(got[d] for d in ask) < 1 and 0 < got[1005] < min(got[d] for d in (1001, 1002, 1003, 1004))
        for d in (1001, 1002, 1003, 1004):
            share = follows["", ask[d]] / of[b""] * follows[ask[d], ""] / of[ask[d].encode()]
            assert abs(got[d] / share - 1) < 0.5


def test_words_in_order_score_better(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rng = np.random.default_rng(7)
    cycle = [(10_000_000 + d, " ".join(f"w{(k * 7 + d) % 50} v{(k * 7 + d) % 50}" for k in range(40))) for d in range(40)]
    mixed = [(20_000_000 + d - 10_000_000, " ".join(rng.permutation(t.split()))) for d, t in cycle]
    learn = (F.col("doc_id") < 20_000_000) & (F.col("doc_id") % 2 == 0)
    got = {r.doc_id: r.score for r in lm.score(docs.unionByName(spark.createDataFrame(cycle + mixed, docs.schema)), learn).collect()}
    odd = [d for d, _ in cycle if d % 2]
    assert all(got[d] > got[d + 10_000_000] + 20 for d in odd)  # held out, same words


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "a B  b"), (3, "a B  b"), (None, "b c"), (5, "z" * 3000), (6, " \n")]
    docs = spark.createDataFrame([(a, b, 0.0) for a, b in rows], "doc_id long, text string, score double")
    n, exp = base_scores(rows, [d is not None and d != 5 for d, _ in rows])
    out = lm.score(docs, F.col("doc_id") != 5).collect()
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in out)
    assert got == sorted((str(d), a, b, round(c, 6)) for (d, _), (a, b, c) in zip(rows, exp, strict=True)) and all(r.train_tokens == n and math.isfinite(r.score) for r in out)
    assert lm.score(docs.limit(0), F.lit(True)).count() == 0
    nothing = lm.score(docs, F.lit(False)).collect()
    assert len(nothing) == len(rows) and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in nothing)


def test_unseen_words_are_spelled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rng = np.random.default_rng(5)
    held = [(d, t) for d, t in docs.collect() if t and t.split() and zlib.crc32(str(d).encode()) % 7 == 2]
    noise = [(-1 - d, " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), len(w))) for w in t.split())) for d, t in held]
    more = spark.createDataFrame([*noise, (-100_001, "z" * 300), (-100_002, "z" * 3000)], docs.schema)
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    got = {r.doc_id: r for r in lm.score(docs.unionByName(more), (F.col("doc_id") >= 0) & learn).collect()}
    assert len(held) > 5 and all(got[-1 - d].n_tokens == got[d].n_tokens and got[-1 - d].score < got[d].score for d, _ in held)
    assert got[-100_002].score < got[-100_001].score - 300  # every byte counts


def test_packed_numbers_come_back():
    arrays = [np.array([0, 300, 2]), np.zeros(0, np.int64), np.array([5, 1 << 63], np.uint64), np.zeros(0, np.uint64), np.array([0.5, -np.inf]), np.array([True, False])]
    got = lm.unpack(lm.pack(*arrays))
    assert [x.tolist() for x in got] == [x.tolist() for x in arrays] and got[3].dtype == np.uint64


def test_parts_count_all_words_and_pairs(monkeypatch):
    """Blocks asking parts, with a hot word: counts of words and learnt pairs as by hand, and each block gets its own in its order."""
    monkeypatch.setattr(lm, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("P", (), {"partitionId": staticmethod(lambda: 0)}))}))
    rng, parts, hot = np.random.default_rng(2), 5, np.sort(lm._hashes([b"a", b"b"]))
    docs = [(d, d % 4 > 0, " ".join(rng.choice([*"aaaabbcdefghij", *(f"w{k}" for k in range(40))], 25))) for d in range(30)]
    table = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*docs, strict=True)], names=["doc_id", "learn", "text"])
    blocks = list(lm._blocks_of([table], 200))
    rows = [r for b in blocks for r in lm._ask(parts, hot)([b.select(["block", "text", "words"])])]
    made = [r for p in range(parts) for r in lm._count(parts, hot)([r for r in rows if r.column(0)[0].as_py() == p])]
    of = {}
    for r in made:
        for k in range(r.num_rows):
            of.setdefault(r.column(1)[k].as_py(), []).append(tuple(r.column(i)[k].as_py() for i in (0, 2, 3, 4)))
    learnt = [["", *t.split(), ""] for _, y, t in docs if y]
    words, pairs = Counter(w.encode() for t in learnt for w in t[1:]), Counter((u.encode(), w.encode()) for t in learnt for u, w in zip(t, t[1:], strict=False))
    names, counts, totals = {}, {}, {p: lm.unpack(data)[0] for p, _, _, data in of[lm.PAIRS]}
    for p, _, _, data in of[lm.WORDS]:
        lens, blob, c = lm.unpack(data)[:3]
        names[p], counts[p] = lm._split(lens, blob), c
    assert {w: n for p in names for w, n in zip(names[p], counts[p].tolist(), strict=True) if n} == dict(words)
    stats = np.sum([nums for _, _, nums, _ in of[lm.STAT]], axis=0)
    assert stats[:4].tolist() == [sum(words.values()), len(words), sum(n == 1 for n in pairs.values()), sum(n == 2 for n in pairs.values())]
    ones = {k: sum(nums[0] for _, at, nums, _ in of[lm.HOT] if at == k) for k in range(2)}
    assert ones == {k: sum(n == 1 for (_, w), n in pairs.items() if lm._hashes([w])[0] == h) for k, h in enumerate(hot)}
    assert len(blocks) > 3
    for b in blocks:
        block, text, data = (b.column(k)[0].as_py() for k in (0, 2, 3))
        own = lm._split(*lm.unpack(data)[:2])
        x = lm.Coded(text, lm._hashes(own), parts, hot)
        asks = {p: [np.cumsum(y) for y in lm.unpack(d)] for p, at, _, d in of[lm.ASKS] if at == block}
        assert [names[p][k] for p in sorted(asks) for k in asks[p][0]] == own
        got = np.full(len(x.word), -1)
        for p, (_, some) in asks.items():
            (a, z), (e, f) = x.pairs_at[p : p + 2], x.hot_at[p : p + 2]
            got[a:z], got[e:f] = totals[p][some][: z - a], totals[p][some][z - a :]
        assert {(own[u], own[w]): got[k] for u, w, k in zip(np.roll(x.ids, 1), x.ids, x.pair, strict=True)} == {(own[u], own[w]): pairs[own[u], own[w]] for u, w in zip(np.roll(x.ids, 1), x.ids, strict=True)}


def test_no_row_for_each_pair_or_word(spark, monkeypatch):
    """What is staged are packed rows: a few for each block and part, whatever the numbers of words and pairs."""
    rows, real = [], lm.stage

    def stage(df):
        out = real(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(lm, "stage", stage)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    out = lm.score(docs, F.col("doc_id") % 2 == 0)
    assert out.count() == 200 and sum(len(tokens(r.text)) for r in docs.collect()) > 20_000
    assert len(rows) > 5 and max(rows) < 500
