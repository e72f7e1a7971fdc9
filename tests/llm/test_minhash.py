import random

from panelspark.llm import minhash
from panelspark.llm.components import components


def words(t):
    return (t or "").encode().lower().split()


def sets(t, n):
    w = words(t)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, percent=80):
    s = [(d, sets(t, n)) for d, t in rows]
    root = {d: d for d, _ in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(s):
        for b, y in s[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: (len(x), find(d)) for d, x in s}


def corpus(seed, n=120):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = " ".join(r.choices(vocab, k=40))
    rows = []
    for i in range(n):
        kind = r.random()
        if rows and kind < 0.5:
            w = rows[r.randrange(min(len(rows), 6))][1].split()
            for _ in range(r.randrange(0, 6)):
                w[r.randrange(len(w))] = r.choice(vocab)
            t = " ".join(w)
        elif kind < 0.7:
            t = passage + " " + " ".join(r.choices(vocab, k=r.randrange(10, 60)))
        else:
            t = " ".join(r.choices(vocab, k=r.randrange(1, 150)))
        rows.append((i * 7 + 3, t))
    return rows


def run(spark, rows, **k):
    docs = spark.createDataFrame([(a, b, "z") for a, b in rows], "doc_id long, text string, cls string")
    return minhash.near_duplicates(docs, **k).collect()


def test_components_match_brute_force(spark):
    for seed, size in ((1, 4), (2, 5)):
        rows = corpus(seed)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, rows, size=size)}
        assert got == brute(rows, size)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE  two"), (6, "one two three"), (9, "a b c d e f"), (9, "a b c d e f"), (None, "a b c d e f"), (None, "alone in here now")]
    got = sorted((r.doc_id or -1, r.n_shingles, -1 if r.component_id is None else r.component_id, r.kept) for r in run(spark, rows, size=4))
    assert got == [(-1, 1, -1, True), (-1, 3, 9, False), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (9, 3, 9, True), (9, 3, 9, True)]
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(docs).count() == 0


def test_chain_of_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 99), (99, 100), (50, 50)], "u long, v long")
    assert {r.u: r.v for r in components(e).collect()} == {i: 1 for i in range(2, 41)} | {100: 99}


def test_unlike_texts_of_one_id_are_classes_of_their_own(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    near = b.replace("b3 ", "x ")
    rows = [(5, a), (5, b), (7, a), (8, near), (9, b), (-4, "lonely text of some words"), (None, a), (None, None), (-4, "another lonely text of words")]
    got = sorted(((str(r.doc_id), r.component_id, r.kept) for r in run(spark, rows, size=4)), key=str)
    assert got == sorted([("5", 5, True), ("5", 5, True), ("7", 5, False), ("8", 5, False), ("9", 5, False), ("-4", -4, True), ("None", 5, False), ("None", None, True), ("-4", -4, True)], key=str)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    roots = {(r.doc_id, r.text_hash): r.root for r in minhash.grouped(docs, 4).collect()}
    assert len(set(roots.values()) - {None}) == 4  # a, b with its near copy, and two lonely ones
