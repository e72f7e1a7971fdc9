import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from panelspark.llm import chunks, packing

STRANGE = ["", " ", "  a", "a ", "a  b", "Hello, WORLD. it's don't 'tis x's.", "tab\tand nbsp   wide\x1cfs", "é café. ́x a ́b", "ΣΑΣ İstanbul ẞ ﬁ", "漢字 かな 😀👍🏽", "a\r\nb\n\nc \n d", "<|endoftext|> <|startoftext|>x", "123 4.5, 6", "x" * 300 + "." , "...!? ,a .b c.d e,.", "\x85a b 　c", "ab‍ c­ d", "Ünïcode. Ünï, ", "﻿bom x", "A.B. C. 'S 'LL", "q'", " 's", "a 's b", "ẛ̣ Å"]


@pytest.mark.parametrize("name,kind", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_chunked_ids_are_the_librarys(spark, name, kind):
    lib = Tokenizer.from_file(public_tokenizers.path(name))
    enc = chunks.Chunks(public_tokenizers.path(name), kind)
    texts = STRANGE + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rng = np.random.default_rng(3)
    letters = list("ab.,' \n\t!?1é́ S")
    texts += ["".join(rng.choice(letters, 30)) for _ in range(2000)]
    for t in texts:
        assert np.frombuffer(enc.encode(t), enc.dtype).tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_hilbert_is_a_curve():
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * axes, indexing="ij"), -1).reshape(-1, axes)
        key = packing.hilbert(cells, bits)
        assert sorted(key) == list(range(side**axes))
        assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def check(rows, pieces, size=packing.SIZE):
    lib = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    exp = defaultdict(list)
    for d, t in rows:
        exp[d].append(lib.encode(t or "", add_special_tokens=False).ids + [1])
    assert set(exp) == set(by_doc)
    for d, copies in exp.items():
        ids = copies[0]
        assert sum(p.length for p in by_doc[d]) == sum(map(len, copies))
        for p in by_doc[d]:
            part = np.array(ids[p.start : p.start + p.length], "<u4").tobytes()
            assert (p.ids_crc32, p.doc_tokens, bytes(p.ids)) == (zlib.crc32(part), len(ids), part)
    waste = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
        waste += 0 if at & (at - 1) == 0 else size - at
    assert waste == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check([(r.doc_id, r.text) for r in docs.collect()], packing.pack(docs).collect())


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "word " * 9000), (4, "same"), (4, "same"), (None, "no id"), (6, " \n ")]
    docs = spark.createDataFrame([(a, b, 7) for a, b in rows], "doc_id long, text string, start int")
    check(rows, packing.pack(docs).collect())
    assert packing.pack(docs.limit(0)).count() == 0


ADDED = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y <|startoftext|>  Z", "a\n<|endoftext|>\n b. ", "<|endoftext| > <|ENDOFTEXT|>", "<|endoftext|><|endoftext|> 漢"]


@pytest.mark.parametrize("name,kind", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_added_tokens_are_the_plain_librarys(name, kind):
    lib = Tokenizer.from_file(public_tokenizers.path(name))
    enc = chunks.Chunks(public_tokenizers.path(name), kind)
    for t in STRANGE + ADDED:
        assert np.frombuffer(enc.encode(t), enc.dtype).tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)
    end = lib.token_to_id("<|endoftext|>")
    assert np.frombuffer(enc.encode(ADDED[0]), enc.dtype).tolist().count(end) == 1
