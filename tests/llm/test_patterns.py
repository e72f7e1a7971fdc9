import zlib
from collections import Counter, defaultdict
from itertools import combinations_with_replacement

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from panelspark.llm import patterns
from panelspark.llm.registry import QUERIES


def encoded(rows):
    lib = Tokenizer.from_file(public_tokenizers.path(patterns.VOCABULARY))
    return [(d, lib.encode(t or "", add_special_tokens=False).ids + [0]) for d, t in rows]


def check_places(pieces, size=patterns.SIZE):
    """Sequences hold at most ``size`` tokens, gapless from 0."""
    by = defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append((p.offset, p.length))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= size
    return len(by)


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op12_pattern_packing"](spark, sf).collect()
    exp = set()
    for d, ids in encoded(rows):
        for k in range(0, len(ids), 2048):
            exp.add((d, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())))
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == exp and len(got) == len(exp)
    n, total = check_places(got), sum(r.length for r in got)
    assert n <= -(-total // 2048) + 1


def test_edge_cases_and_sequences(spark):
    rows = [(1, None), (2, ""), (3, "word " * 9000), (4, "same"), (4, "same"), (None, "no id"), (6, " \n "), (7, "a " * 2047), (8, "a " * 2048)]
    docs = spark.createDataFrame([(a, b, 7, 8) for a, b in rows], "doc_id long, text string, start int, length int").repartition(3)
    packed = patterns.pack(docs)
    got = packed.collect()
    check_places(got)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.piece, r.start, bytes(r.ids)))
    exp = encoded(rows)
    for d, ids in exp:
        raw = np.array(ids, "<u4").tobytes()
        copies = sum(x == d for x, _ in exp)
        own = sorted(by[d])[::copies]
        assert b"".join(x for _, _, x in own) == raw and [(p, s) for p, s, _ in own] == [(k, k * 2048) for k in range(-(-len(ids) // 2048))]
    whole = patterns.sequences(packed).collect()
    assert sorted(np.frombuffer(b"".join(bytes(r.ids) for r in whole), "<u4").tolist()) == sorted(i for _, ids in exp for i in ids) and all(len(r.ids) <= 4 * 2048 for r in whole)
    assert patterns.pack(docs.limit(0)).count() == 0


def test_patterns_are_all_exact_fills():
    lengths = np.array([2, 3, 4, 5, 9, 10, 15])
    found, times = patterns.exact_patterns(lengths, 20)
    got = {tuple(sorted(n for n, t in zip(f, ts) for _ in range(t))) for f, ts in zip(found.tolist(), times.tolist())}
    few = {c for k in (2, 3) for c in combinations_with_replacement(lengths.tolist(), k) if sum(c) == 20}
    assert len(got) == len(found) and few <= got and all(sum(c) == 20 for c in got) and (4,) * 5 in got and (2, 9, 9) in got


def test_fit_finds_repeat_counts():
    hist = np.zeros(101, np.int64)
    for a, b, c in ((60, 40, 500), (70, 30, 300), (50, 50, 100)):
        hist[a] += c
        hist[b] += c
    found, times = patterns.exact_patterns(np.nonzero(hist)[0], 100)
    x = patterns.fit(hist, found, times)
    ax = np.zeros(101)
    np.add.at(ax, found, times * x[:, None])
    assert np.abs(ax - hist)[1:].max() < 8
    assert patterns.plan(hist).sequences == 900


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 64), st.integers(1, 400)), max_size=30))
def test_plan_places_every_document_once(given):
    hist = np.zeros(65, np.int64)
    for n, c in given:
        hist[n] += c
    p = patterns.plan(hist)
    ranks, fill = Counter(), defaultdict(list)
    for length, lo, hi, sequence, each, offset in p.runs:
        for r in range(lo, hi):
            ranks[length, r] += 1
            fill[sequence + (r - lo) // each].append((offset + length * ((r - lo) % each), length))
    assert ranks == Counter({(n, r): 1 for n in range(1, 65) for r in range(hist[n])})
    assert set(fill) == set(range(p.sequences))
    for places in fill.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 64
