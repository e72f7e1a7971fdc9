import corpus_pipeline as cp
import numpy as np
from pyspark.sql import functions as F
from test_lines import brute as plain_lines
from test_minhash import brute as plain_groups
from test_packing import check as check_pieces

from panelspark.llm import langid, packing

SF = "/root/testdata/sf0.001"


def test_stages_match_a_plain_version(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(9001, None, "en", "x", 0), (9002, "12 !!", None, "x", 5), (9003, "", "en", None, 0)]
    docs = table.unionByName(spark.createDataFrame(odd, table.schema))
    rows = {r.doc_id: r for r in docs.collect()}

    langs, prob = langid.train(docs, F.lit(True))
    vocab = langid.vocabulary(langid.public_tokenizers.path(langid.VOCABULARY))

    def accepted(t):
        w = langid.words_of(t)
        if not langid.has_letter(w):
            return False
        s = langid.word_scores(w, vocab, prob).sum(axis=0)
        z = np.exp((s - s.max()) / np.sqrt(len(w)))
        return z.max() / z.sum() >= cp.LEAST_SCORE

    first = cp.keep_languages(spark, docs, SF)
    kept = {r.doc_id: r.text for r in first.collect()}
    assert first.columns == cp.COLUMNS and set(kept) == {d for d, r in rows.items() if accepted(r.text)}
    assert len(kept) == len(rows) - 3  # clean documents stay

    second = cp.drop_lines(spark, first, SF)
    left = plain_lines(list(kept.items()))
    exp = {d: x for (d, t), x in left.items() if x == t or x.strip()}
    got = {r.doc_id: (r.text, r.n_chars) for r in second.collect()}
    assert second.columns == cp.COLUMNS and got == {d: (x, len(x)) for d, x in exp.items()}

    third = cp.drop_near_duplicates(spark, second, SF)
    groups = plain_groups(list(exp.items()), 5)
    stay = {r.doc_id: r.text for r in third.collect()}
    assert third.columns == cp.COLUMNS and stay == {d: exp[d] for d, (_, root) in groups.items() if d == root}

    check_pieces(list(stay.items()), packing.pack(third).collect())
    assert "ids" not in cp.pack(spark, third, SF).columns


def test_run_on_whole_table(spark):
    out = cp.run(spark, SF)
    assert out.count() > 0 and [n for n, _ in cp.STAGES] == ["language", "lines", "near_duplicates", "packing"]


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, step in cp.STAGES:
        docs = step(spark, docs, SF)
    assert docs.count() == 0


def test_texts_that_no_language_fits_go(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rng = np.random.default_rng(4)
    noise = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9))) for _ in range(30)) for _ in range(20)]
    strange = ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan", "Все люди рождаются свободными и равными в своем достоинстве и правах", *noise]
    short = [" ".join(r.text.split()[:k]) for r in table.filter("lang is not null").orderBy("doc_id").limit(20).collect() for k in (3, 8)]
    rows = [(20_000 + k, t, None, "x", len(t)) for k, t in enumerate(strange)] + [(30_000 + k, t, None, "x", len(t)) for k, t in enumerate(short)]
    kept = {r.doc_id for r in cp.keep_languages(spark, table.unionByName(spark.createDataFrame(rows, table.schema)), SF).collect()}
    assert not [t for k, t in enumerate(strange) if 20_000 + k in kept]
    assert not [t for k, t in enumerate(short) if 30_000 + k not in kept]
    unlabelled = spark.createDataFrame([(1, "some words", None, "x", 10), (2, "12 !!", None, "x", 5), (3, None, None, "x", 0)], table.schema)
    assert [r.doc_id for r in cp.keep_languages(spark, unlabelled, SF).collect()] == [1]


def test_documents_are_ids_with_their_texts(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (7, a), (9, c), (9, c), (None, b), (None, "met only without an id, twice"), (None, "met only without an id, twice"), (11, None), (12, "")]
    docs = spark.createDataFrame([(d, t, "en", "x", 0) for d, t in rows], schema)
    got = sorted(((r.doc_id, r.text) for r in cp.drop_near_duplicates(spark, docs, SF).collect()), key=str)
    assert got == sorted([(5, a), (5, b), (9, c), (None, rows[6][1]), (None, rows[6][1]), (11, None), (12, "")], key=str)
