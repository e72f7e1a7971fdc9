import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from panelspark.llm import langid


def test_forward_sums_all_segmentations():
    vocab = {p: i + 1 for i, p in enumerate(["a", "b", "ab", "▁", "▁a", "bc", "abc"])}
    prob = np.vstack([np.random.default_rng(1).random((8, 2)), np.zeros((1, 2))])

    def total(m):
        if not m:
            return np.ones(2)
        out = np.zeros(2)
        for k in range(1, len(m) + 1):
            i = vocab.get(m[:k], 0 if k == 1 else None)
            if i is not None:
                out = out + prob[i] * total(m[k:])
        return out

    words = ["abc", "cab", "a", "bbcab"]
    assert np.allclose(langid.word_scores(words, vocab, prob), np.log([total("▁" + w) for w in words]))
    long = "ab" * 40
    assert np.isfinite(langid.word_scores([long], vocab, prob)).all()


def test_held_out_accuracy(spark):
    from panelspark.llm.registry import QUERIES

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = QUERIES["op7_language_id"](spark, sf)
    held = out.join(docs.select("doc_id", "lang", "text"), "doc_id").filter("held_out").collect()
    assert out.count() == docs.count() and len(held) > 200
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in held)


def test_edge_cases(spark):
    rows = [(i, "the cat and the dog" if i % 2 else "der hund und die katze", "en" if i % 2 else "de") for i in range(40)]
    rows += [(100, None, "en"), (101, "", None), (102, "12 34 !!", "en"), (103, "²³", None), (None, "the dog", "de"), (1, "the cat and the dog", "en"), (105, "x" * 5000, None)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    model = langid.train(docs, F.col("doc_id") < 90)
    out = langid.predict(docs, model).collect()
    got = {r.doc_id: (r.lang_pred, r.score) for r in out}
    assert len(out) == len(rows) and got[1][0] == "en" and got[2][0] == "de" and got[None][0] == "en"
    assert all(got[i] == ("und", 0.0) for i in (100, 101, 102, 103)) and got[105][0] in ("en", "de")
    assert langid.predict(docs.limit(0), model).count() == 0
    empty = langid.train(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in langid.predict(docs, empty).collect()} == {"und"}
    assert len(langid.vocabulary(public_tokenizers.path(langid.VOCABULARY))) > 10_000


def test_models_and_bounds_come_from_all_rows(spark):
    few = [(i, "aba ab" if i % 2 else "ba abab", "x") for i in range(900)] + [(900 + i, "bab", "y") for i in range(600)]
    rare = [(2000 + i, f"b{'a' * (i % 5)}", "x") for i in range(20)]
    docs = spark.createDataFrame([*few, *rare], "doc_id long, text string, lang string").repartition(7)
    vocab = langid.vocabulary(public_tokenizers.path(langid.VOCABULARY))
    size = len(vocab) + 1

    def cuts(m):
        if not m:
            yield []
        for k in range(1, min(len(m), langid.WIDEST) + 1):
            i = vocab.get(m[:k], 0 if k == 1 else None)
            if i is not None:
                yield from ([i, *rest] for rest in cuts(m[k:]))

    langs, prob = langid.train(docs, F.lit(True))
    assert langs == ["x", "y"] and prob.shape == (size + 1, 2) and not prob[size].any()
    for j, lang in enumerate(langs):
        p = np.full(size, 1 / size)
        for _ in range(langid.ROUNDS):
            got = np.zeros(size)
            for _, text, own in [*few, *rare]:
                for w in text.split() if own == lang else ():
                    ways = list(cuts("▁" + w))
                    mass = np.array([p[c].prod() for c in ways])
                    for c, m in zip(ways, mass / mass.sum(), strict=True):
                        np.add.at(got, c, m)
            prior = max(langid.PRIOR, langid.LEAST_SHARE * got.sum())
            p = (got + prior) / (got.sum() + prior * size)
        assert np.allclose(prob[:size, j], p, rtol=1e-3, atol=1e-9)
    again = langid.train(docs.repartition(3, "text"), F.lit(True))
    assert (again[1] == prob).all()

    fits = [(f"l{i % 2}", float(-1 - (i * 37 % 1000) / 1000)) for i in range(2000)]
    low = langid.low_fits(spark.createDataFrame([*fits, ("und", -9.0)], "lang_pred string, fit double"))
    assert low.keys() == {"l0", "l1"} and all(abs(low[k] - np.quantile([f for x, f in fits if x == k], langid.LOW)) < 2e-3 for k in low)


def test_lattices_hold_every_piece():
    vocab = langid.vocabulary(public_tokenizers.path(langid.VOCABULARY))
    words = ["", "a", "information", "straße", "ß" * 30, "日本語", "ılĞ", "𝒳𝒴z", "the" * 8]
    got, sizes = langid.lattice(words, vocab)
    for i, m in enumerate("▁" + w[: langid.LONGEST] for w in words):
        exp = {(a, b - a - 1): vocab.get(m[a:b], -1 if b > a + 1 else 0) for a in range(len(m)) for b in range(a + 1, min(a + langid.WIDEST, len(m)) + 1)}
        assert sizes[i] == len(m) and {k: v for k, v in np.ndenumerate(got[i]) if v >= 0} == {k: v for k, v in exp.items() if v >= 0}
