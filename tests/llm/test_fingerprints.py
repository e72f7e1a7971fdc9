import hashlib

import numpy as np

from panelspark.llm import fingerprints as fp


def brute_syncmers(text):
    """Positions whose smallest s-mer, by the order of the hashes that single s-mers get, stands first or last."""
    def order(s):
        h = fp._mix(np.frombuffer(s.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1))
        v = 0
        for c in h:
            v = (v * int(fp._B) + int(c)) % (1 << 64)
        return int(fp._mix(np.array([v], np.uint64))[0])

    out = []
    for i in range(len(text) - fp.K + 1):
        vals = [order(text[i + j : i + j + fp.S]) for j in range(fp.K - fp.S + 1)]
        if min(vals) in (vals[0], vals[-1]):
            out.append(i)
    return out


TEXT = "the quick brown fox jumps over the lazy dog and then some more words follow after it, ünïcode 😀 too"


def test_syncmers_match_brute_force_and_need_no_context():
    doc, at, h = fp.syncmers(["short", TEXT, "", "xx" + TEXT])
    assert at[doc == 1].tolist() == brute_syncmers(TEXT)
    assert set(h[doc == 1]) <= set(h[doc == 3])
    assert not (doc == 0).any()


def check(rows, got):
    rows = sorted(rows, key=lambda r: -r[0])
    for i, (d, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        a, e, n = (fp.sketch([x])[0] for x in (t, edited, nxt))
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == a.astype(">u2").tobytes().hex() and r.edited_fingerprint == e.astype(">u2").tobytes().hex()
        assert r.near_edited == fp.likeness(a, e) and r.near_next == fp.likeness(a, n)
        assert 0 <= r.near_edited <= 1 and (edited != t or r.near_edited == 1)


def test_against_next_on_whole_table(spark):
    from panelspark.llm.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: r for r in QUERIES["op4_syncmer_fingerprints"](spark, sf).collect()}
    assert len(got) == len(rows)
    check(rows, got)


def test_edge_cases(spark):
    rows = [(5, TEXT), (4, None), (3, ""), (2, "a"), (1, TEXT)]
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, fingerprint string")
    check(rows, {r.doc_id: r for r in fp.against_next(docs).collect()})
    assert fp.against_next(docs.limit(0)).count() == 0
    one = fp.against_next(docs.filter("doc_id = 5")).first()
    assert one.near_next == 1
    again = docs.unionByName(docs).unionByName(spark.createDataFrame([(None, TEXT, "y")], docs.schema))
    out = fp.against_next(again).collect()
    assert len(out) == 11 and len({r.fingerprint for r in out if r.n_chars == len(TEXT)}) == 1
    assert fp.anchors(docs).filter("doc_id = 5").count() == len(brute_syncmers(TEXT)) and fp.fingerprints(docs).count() == 5
