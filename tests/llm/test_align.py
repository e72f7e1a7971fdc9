import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from panelspark.llm import align, chunks
from panelspark.llm.registry import QUERIES

ODD = [None, "", " ", "a", "a▁b", "<|endoftext|> x </s><s>", "  two  spaces ", "café café ﬁ 　x", "line\nline\r\n\ttab", "漢字 \U0001f600\U0001f44d\U0001f3fd", "x" * 300, "\x00nul", "a b", "'s don't 'LL", "   ", "\n", "word " * 3000]


def brute(rows):
    """The contract read plainly: overlapping byte ranges of all tokens, one pair at a time."""
    lib = Tokenizer.from_file(P.path(align.A))
    lib.encode_special_tokens = True
    back = {c: b for b, c in enumerate(chunks.byte_letters())}
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path(align.B))

    def piece(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()

    def spans(words):
        ends = np.cumsum([len(w) for w in words]).tolist()
        return list(zip([0, *ends[:-1]], ends, strict=True))

    docs, holds = [], Counter()
    for d, t in rows:
        a = lib.encode(" " + (t or ""), add_special_tokens=False).ids if t else []
        b = sp.encode(t) if t else []
        wa, wb = [bytes(back[c] for c in lib.id_to_token(i)) for i in a], [piece(i) for i in b]
        if not t or b"".join(wa) != (" " + t).encode() or b"".join(wb) != (" " + t).encode():
            docs.append((d, [], [], [], []))
            continue
        sa, sb = spans(wa), spans(wb)
        links, j0 = [], 0
        for i, (x, y) in enumerate(sa):
            while sb[j0][1] <= x:
                j0 += 1
            j = j0
            while j < len(sb) and sb[j][0] < y:
                links.append((a[i], b[j]))
                j += 1
        both = sorted({e for _, e in sa} & {e for _, e in sb})
        docs.append((d, a, b, links, [([a[i] for i, (_, e) in enumerate(sa) if lo < e <= hi], [b[j] for j, (_, e) in enumerate(sb) if lo < e <= hi]) for lo, hi in zip([0, *both], both)] if len(a) < 4000 else None))
        holds.update(set(links))
    most = {}
    for (x, _), n in holds.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for d, a, b, links, groups in docs:
        text = None if groups is None else ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sha = None if groups is None else hashlib.sha256(text.encode()).hexdigest() if text else ""
        out.append((d, len(a), len(b), None if groups is None else len(groups), len(links), sum(holds[k] == most[k[0]] for k in links), sum(holds[k] for k in links), sha))
    return out, holds, most


def compare(got, exp):
    key = lambda r: (str(r[0]), *r[1:3], r[4:7])
    got = sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got), key=key)
    assert len(got) == len(exp)
    for g, e in zip(got, sorted(exp, key=key), strict=True):
        assert all(y is None and k in (3, 7) or x == y for k, (x, y) in enumerate(zip(g, e, strict=True))), (g, e)


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    compare(QUERIES["op11_tokenizer_alignment"](spark, sf).collect(), brute(rows)[0])


def test_edge_cases_in_many_blocks(spark):
    rows = [*enumerate(ODD), (3, "a"), (None, "a b"), (None, None)]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, n long, best int").repartition(3)
    out, pairs = align.align(docs, pairs=300)
    exp, holds, most = brute(rows)
    compare(out.collect(), exp)
    assert {(r.a, r.b, r.n, r.best) for r in pairs.collect()} == {(a, b, n, n == most[a]) for (a, b), n in holds.items()}
    none, pairs = align.align(docs.limit(0))
    assert none.count() == 0 and pairs.count() == 0
    blank, _ = align.align(docs.filter("text is null"))
    assert [(r.n_a, r.n_links, r.groups_sha256) for r in blank.collect()] == [(0, 0, "")] * 2


def test_ids_are_the_libraries():
    lib = Tokenizer.from_file(P.path(align.A))
    lib.encode_special_tokens = True
    al = align.Aligner(P.path(align.A), P.path(align.B))
    rng = np.random.default_rng(1)
    letters = list("ab.,' \n\t!?1é́ S▁漢 <s>")
    texts = [t for t in ODD if t] + ["".join(rng.choice(letters, int(n))) for n in rng.integers(1, 40, 3000)]
    for t in texts:
        assert al.a.encode(t).tolist() == lib.encode(" " + t, add_special_tokens=False).ids, repr(t)
        b = al.b.encode(t)
        ids = al.b.library.encode(t)
        assert b is None and b"".join(al.b.bytes[i] for i in ids) != b" " + t.encode() or b.tolist() == ids, repr(t)


@settings(max_examples=150, deadline=None)
@given(st.sets(st.integers(1, 300), min_size=1, max_size=120), st.sets(st.integers(1, 300), max_size=120), st.integers(1, 40), st.integers(1, 90))
def test_pieces_of_the_merge_do_not_matter(a, b, work, window):
    last = max(a | b)
    a, b = np.array(sorted(a | {last})), np.array(sorted(b | {last}))
    got = [np.concatenate(x).tolist() for x in zip(*align.merge(a, b, work, window), strict=True)]
    sa, sb = [0, *a.tolist()], [0, *b.tolist()]
    exp = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(sa[i], sb[j]) < min(sa[i + 1], sb[j + 1])]
    both = sorted(set(a.tolist()) & set(b.tolist()))
    assert list(zip(got[0], got[1])) == exp
    assert got[2] == [sum(e < a[i] for e in both) for i, _ in exp]
    d = np.arange(len(a) + len(b) + 1)
    assert align.diagonals(a, b, d).tolist() == [sum(which == 0 for _, which in sorted([(x, 0) for x in a.tolist()] + [(x, 1) for x in b.tolist()])[:k]) for k in d]
