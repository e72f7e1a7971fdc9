import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from panelspark.llm import coder, tokenfile
from panelspark.llm.chunks import Chunks


def test_coder_round_trips():
    rng = np.random.default_rng(1)
    blocks = [rng.integers(0, 65536, k) for k in (0, 1, 5, 300, 2500)] + [np.full(2000, 7), np.arange(3000) % 5, np.full(50, 65535), np.minimum(rng.zipf(1.3, 4000), 60000)]
    words = coder.encode(blocks)
    back = coder.decode(words, [len(b) for b in blocks])
    assert all((a == b).all() for a, b in zip(blocks, back, strict=True))
    assert len(words[5]) < 60 and len(words[6]) < 150  # what repeats costs little
    alone = coder.decode([words[4]], [2500])[0]  # a block needs no other
    assert (alone == blocks[4]).all()


def test_damage_is_found():
    ids = np.arange(9000) % 700
    blob = bytearray(tokenfile.pack_segment([4, None], [5000, 4000], ids, block=1000))
    docs, sizes, back = tokenfile.unpack_segment(bytes(blob))
    assert docs == [4, None] and sizes == [5000, 4000] and (back == ids).all()
    for at in (30, len(blob) - 600):
        bad = bytearray(blob)
        bad[at] ^= 255
        with pytest.raises(ValueError):
            tokenfile.unpack_segment(bytes(bad))


def expected(rows):
    lib = Tokenizer.from_file(public_tokenizers.path(tokenfile.VOCABULARY))
    at, out = 0, []
    for d, t in rows:
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [tokenfile.END], "<u4")
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_query_on_whole_table(spark):
    from panelspark.llm.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = sorted(map(tuple, QUERIES["op5_token_files"](spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    assert got == expected(rows)


def test_edge_cases(spark, tmp_path):
    rows = [(None, "zero"), (1, None), (2, ""), (3, "word " * 5000), (4, "same"), (4, "same"), (5, "ü 漢 #\n #  x")]
    docs = spark.createDataFrame([(b, a, 1) for a, b in rows], "text string, doc_id long, part int")
    tokenfile.write(docs, f"{tmp_path}/a", segment_ids=3000)
    got = sorted(((r.doc_id is not None, r.doc_id), r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in tokenfile.read(spark, f"{tmp_path}/a").collect())
    assert got == [((d is not None, d), *x) for d, *x in expected(rows)]
    tokenfile.write(docs.limit(0), f"{tmp_path}/b")
    assert tokenfile.read(spark, f"{tmp_path}/b").count() == 0


def test_added_tokens_are_kept_as_one_id(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a <|endoftext|> b"), (2, "after")], "doc_id long, text string")
    tokenfile.write(docs, f"{tmp_path}/a")
    got = sorted((r.doc_id, r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in tokenfile.read(spark, f"{tmp_path}/a").collect())
    assert got[0] == (1, 0, [64, 220, 50256, 275, tokenfile.END]) and got[1][:2] == (2, 5)


def test_coder_makes_few_calls_a_step():
    """Blocks are coded side by side, so what counts is the interpreter's calls for each id of a block: six coding steps an id made 298, three make 51."""
    rng = np.random.default_rng(2)
    blocks = [np.minimum(rng.zipf(1.2, 300), 60000) for _ in range(8)]
    calls = [0]

    def count(frame, event, arg):
        calls[0] += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        words = coder.encode(blocks)
        coder.decode(words, [300] * 8)
    finally:
        sys.setprofile(None)
    assert calls[0] / 300 < 150


def test_order_0_is_shared_by_the_blocks_of_a_segment():
    """Ids that repeat in other blocks only."""
    ids = np.random.default_rng(4).permutation(np.repeat(np.arange(1000) * 50, 16))
    blob = tokenfile.pack_segment([1], [len(ids)], ids, block=500)
    assert len(blob) * 8 < 12 * len(ids) and (tokenfile.unpack_segment(blob)[2] == ids).all()


def test_chunks_are_cut_at_line_feeds():
    """Ids are the library's; two words around a line feed are remembered apart, not as one chunk."""
    path = public_tokenizers.path(tokenfile.VOCABULARY)
    lib, enc = Tokenizer.from_file(path), Chunks(path, "byte")
    rng = np.random.default_rng(6)
    pieces = ["a", "ab", "\n", " ", "  ", "\t", ".", "'s", "\n'll", "é", "漢", "\x1c", "\u00a0", "\r\n", "1", " word,", "e\u0301"]
    for k in range(5000):
        t = "".join(rng.choice(pieces, k % 12))
        assert np.frombuffer(enc.encode(t), enc.dtype).tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)
    fresh = Chunks(path, "byte")
    fresh.encode("one two.\nThree four\nfive")
    assert not any("\n" in chunk[1:] for chunk in [*fresh, *fresh.spaced])
