import random

import numpy as np

from panelspark.llm import lines


def brute(rows):
    """{(doc_id, text): kept text}; an earlier line that equals or is one word away drops a line."""
    seen, out = [], {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        keep = []
        for line in (t or "").split("\n"):
            w = line.encode().lower().split()
            if not any(w == s or (min(len(w), len(s)) >= 10 and lines.one_edit(w, s)) for s in seen) or not w:
                keep.append(line)
            if w:
                seen.append(w)
        out[d, t] = "\n".join(keep)
    return out


def run(spark, rows):
    docs = spark.createDataFrame([(a, b, "x", 1, 2) for a, b in rows], "doc_id long, text string, doc string, text_hash int, at int")
    out = lines.dedupe(docs).collect()
    assert {(x.doc, x.text_hash, x.at) for x in out} == {("x", 1, 2)}  # own columns of those names come back as they were
    return out


def test_matches_brute_force(spark):
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(30)]
    base = [[r.choice(vocab) for _ in range(r.randrange(4, 16))] for _ in range(25)]
    rows = []
    for d in range(60):
        ls = []
        for _ in range(r.randrange(0, 6)):
            w = list(r.choice(base))
            kind = r.random()
            k = r.randrange(len(w))
            if kind < 0.25:
                w[k] = r.choice(vocab)
            elif kind < 0.4:
                del w[k]
            elif kind < 0.55:
                w.insert(k, r.choice(vocab))
            elif kind < 0.6:
                w = [x.upper() for x in w]
            ls.append((" " if kind < 0.8 else "  ").join(w))
        rows.append((d * 3, "\n".join(ls)))
    exp = brute(rows)
    got = {x.doc_id: x for x in run(spark, rows)}
    assert len(got) == len(rows)
    for d, t in rows:
        assert got[d].text == exp[d, t]
        assert got[d].n_lines == len(t.split("\n")) and got[d].n_dropped == len(t.split("\n")) - (len(exp[d, t].split("\n")) if exp[d, t] or not got[d].n_dropped else 0 if got[d].n_dropped == len(t.split("\n")) else 1)


def test_edge_cases(spark):
    long = " ".join(f"v{i}" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "a b\n\na b\nc"), (5, long), (6, long.replace("v7 ", "")), (7, "new a\nA  B"), (8, "same row"), (8, "same row"), (None, "c\nonly null"), (9, "é b c d e f g h i j k"), (10, "e b c d e f g h i j k")]
    out = run(spark, rows)
    got = {(x.doc_id, x.n_lines): x.text for x in out}
    assert len(out) == len(rows)
    assert got[1, 1] is None and got[2, 1] == "" and got[3, 3] == "\n\n" and got[4, 4] == "a b\n\nc" and got[5, 1] == long and got[6, 1] == "" and got[7, 2] == "new a" and got[None, 2] == "only null"
    assert [x.text for x in out if x.doc_id == 8] == ["same row"] * 2 and got[9, 1] and got[10, 1] == ""
    assert lines.dedupe(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_variants_of_a_line():
    h = lines.word_hashes("a b c d e f g h i j k")
    v = lines.variants(h)
    assert v[3] == lines.variants(lines.word_hashes("a b d e f g h i j k"))[0] and len(set(v.tolist())) == 12
    texts = ["a b c d e f g h i j k", "a b x d e f g h i j k", "a b d e f g h i j k", "a b c d e f g h i j", "q a b c d e f g h i j k", "b a d c"]
    hashes = [lines.word_hashes(t) for t in texts]
    near = [set(k) for k in lines.halves(np.concatenate(hashes), np.array([len(x) for x in hashes])).tolist()]
    assert all(near[0] & k for k in near[1:5]) and not near[0] & near[5]


def test_halves_of_bytes_meet_as_those_of_words_do():
    r = random.Random(3)
    found = [[r.choice("ab") * r.randrange(1, 3) for _ in range(r.randrange(1, 7))] for _ in range(400)]
    sizes = np.array([len(w) for w in found])
    raw = np.frombuffer("".join(" ".join(w) + "\n" for w in found).encode(), np.uint8)
    ends = np.flatnonzero((raw == 32) | (raw == 10))
    got = lines.halves(raw, sizes, np.concatenate([[0], ends[:-1] + 1]), ends)
    exp = [[(k, m, tuple(x)) for n, m in enumerate((len(w), len(w) - 1)) for k, x in enumerate((w[: m // 2], w[len(w) - (m - m // 2) :]))] for w in found]
    pairs = {(int(g), e) for a, b in zip(got, exp, strict=True) for g, e in zip(a, b, strict=True)}
    assert len({g for g, _ in pairs}) == len({e for _, e in pairs}) == len(pairs)
