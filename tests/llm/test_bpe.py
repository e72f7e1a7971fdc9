import hashlib

import numpy as np
import public_tokenizers

from panelspark.llm import bpe


def brute(text):
    ids = bpe.encoding(public_tokenizers.path(bpe.RANKS)).encode_ordinary(text or "")
    return np.array(ids, "<u4").tobytes()


ROWS = [(1, "Hello  world's end\n\n next 12345!!"), (2, None), (3, ""), (4, "ab cd, ef. " * 400), (4, "ab cd, ef. " * 400), (None, "x" * 900 + " " * 300 + "y\n" * 40), (7, "ü ñ 漢字 😀 " * 90), (8, "z" * 5000)]


def test_chunks_stitch_to_the_library_result(spark):
    docs = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(ROWS)], "doc_id long, text string, ids int")
    for chunk, overlap in ((64, 16), (257, 32), (1 << 16, 1 << 10)):
        got = sorted((r.doc_id or 0, bytes(r.ids), bytes(r.decoded)) for r in bpe.decode(bpe.encode(docs, chunk=chunk, overlap=overlap)).collect())
        assert got == sorted((a or 0, brute(b), (b or "").encode()) for a, b in ROWS)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(docs)).count() == 0


def test_query_digests(spark):
    from panelspark.llm.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op6_bpe_round_trip"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = brute(r.text)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
