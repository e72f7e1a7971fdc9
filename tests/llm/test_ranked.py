import math
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from panelspark.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(t):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, k):
    """The contract read plainly: every document scored for every item."""
    tfs = [Counter(words(t)) for _, t in docs]
    sizes = [sum(c.values()) for c in tfs]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(w for c in tfs for w in c)
    out = []
    for item, text in items:
        scored = []
        for (d, _), c, s in zip(docs, tfs, sizes, strict=True):
            m = 100 - 25 + 25 * s * n // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 12 * m)) for w in words(text) if c[w])
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


DOCS = [(1, None), (2, ""), (3, "Red red fox. RED-fox"), (4, "fox"), (4, "fox"), (None, "fox den"), (5, "é É e 漢字 漢字"), (6, "x" * 4000 + " fox " * 900), (7, "blue 7 seas\x007"), (8, "...!"), (9, "den fox red"), (10, "fox")]
ITEMS = [(1, "fox"), (2, "FOX fox red"), (2, "den"), (3, None), (4, "zzz"), (5, "漢字 É 7"), (None, "red den fox blue seas"), (6, "")]


def rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def test_edge_cases(spark):
    docs = spark.createDataFrame([(*d, 1, 2) for d in DOCS], "doc_id long, text string, score int, rank int").repartition(3)
    items = spark.createDataFrame([(*i, 3) for i in ITEMS], "item_id long, text string, doc_id int")
    assert rows(ranked.search(docs, items)) == brute(DOCS, ITEMS, 20)
    assert rows(ranked.search(docs, items, k=2, group=4, max_docs=2)) == brute(DOCS, ITEMS, 2)  # several groups, small blocks, ties
    assert rows(ranked.search(docs.limit(0), items)) == [] and rows(ranked.search(docs, items.limit(0))) == []
    assert rows(ranked.search(docs.filter("doc_id < 3"), items)) == []


def block_of(tfs, sizes, queries):
    """One block of the index, made by the operator's own two passes; ``tfs`` are texts."""
    import pyarrow as pa
    from pyspark import TaskContext

    class Task:
        @staticmethod
        def partitionId():
            return 0

    get, TaskContext.get = TaskContext.get, staticmethod(lambda: Task)
    try:
        first = list(ranked._postings(queries.vocabulary, 1 << 20, 1 << 30)([pa.RecordBatch.from_pydict({"doc_id": list(range(len(tfs))), "text": tfs})]))
    finally:
        TaskContext.get = get
    r = first[0].to_pydict()
    df = np.zeros(len(queries.vocabulary), np.int64)
    df[r["terms"][0]] = r["df"][0]
    pairs = queries.order(df)
    weights = np.array([ranked.weight(r["n_docs"][0], int(x)) for x in df], np.int64)
    return ranked.Block(list(ranked._impacts(r["n_docs"][0], r["n_terms"][0], weights, pairs)(first))[0].to_pydict(), weights, len(pairs))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefghij"), max_size=12), min_size=1, max_size=40), st.lists(st.sampled_from("abcdefghijk"), min_size=1, max_size=9), st.integers(1, 4))
def test_bounds_hold_and_nothing_is_lost(texts, asked, k):
    q = ranked.Queries([" ".join(asked)])
    block = block_of([" ".join(t) for t in texts], None, q)
    chain, often, pairs = q.chains[0], q.often[0], q.chained[0]
    every = block.exact(np.arange(len(block.docs)), chain, often)
    units = block.units(chain, often, pairs)
    covered = sorted(p for *_, places in units for p in places)
    assert covered == [p for p, v in enumerate(chain) if block.at[v] >= 0]
    for bound, apart, places in units:
        part = block.exact(np.arange(len(block.docs)), chain[list(places)], often[list(places)])
        assert len(part) == 0 or part.max() <= bound
        if len(places) == 2:
            alone = np.setdiff1d(np.arange(len(block.docs)), block.meeting(pairs[places[0]]))
            assert part[alone].max(initial=0) <= apart
    for threshold in {1, *every.tolist()}:
        docs, scores, _ = ranked.scan(block, chain, often, pairs, max(int(threshold), 1), k)
        assert (every[docs] == scores).all()
        got = [r for r in ranked._top(docs, scores, block.docs, k) if r[1] >= threshold]
        assert got == [r for r in ranked._top(np.arange(len(every)), every, block.docs, k) if r[1] >= threshold]


def test_pair_bounds_skip_more_than_single_ones():
    """Terms that never meet: the pair's bound is the larger one, so documents of the weaker lists are never looked at."""
    texts = [f"a{i % 7} filler{i}" for i in range(300)] + ["a0 a1 a2 a3 a4 a5 a6"]
    q = ranked.Queries([" ".join(f"a{i}" for i in range(7))])
    block = block_of(texts, None, q)
    chain, often, pairs = q.chains[0], q.often[0], q.chained[0]
    best = block.exact(np.arange(len(block.docs)), chain, often).max()
    docs, scores, looked = ranked.scan(block, chain, often, pairs, int(best), 1)
    assert scores.max() == best
    block.pair_highest = block.pair_highest * 0 + 2 * block.highest.max()  # as if nothing were known of pairs
    assert looked <= ranked.scan(block, chain, often, pairs, int(best), 1)[2]
    low = block_of(texts[:-1], None, q)
    assert ranked.scan(low, chain, often, pairs, int(low.highest.max()) * 5, 1)[2] == 0  # all seven add up to more, the pairs don't
