import hashlib

import pytest
from tokenizers import Tokenizer

from filmcrate.llm import bpe

ODD = ["", " ", "aaaaaaaaaaa aaaa", "It's they'LL  don't '", "Ünïcödé é ﬁ ΣΑΣ ς", "<|endoftext|>a<|startoftext|> <|x|>b", "\x1c\x1d a\x85b c　d", "数字 １２３ ٤٥ 😀👩‍👩‍👧", "İstanbul ǅ", "x" * 3000, "​﻿", "#$%  &&&", "\x00\x01"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def test_odd_texts_equal_the_library(library):
    coder = bpe.Coder(bpe.vocabulary())
    for text, ids in zip(ODD, coder.encode(ODD), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == want, text
        assert coder.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_digests_and_round_trip(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([*((-i - 2, t) for i, t in enumerate(ODD)), (-1, None)], "doc_id long, text string"))
    coded = bpe.encode_documents(docs)
    ids = {r["doc_id"]: r["ids"] for r in coded.collect()}
    back = {r["doc_id"]: r["text"] for r in bpe.decode_documents(coded).collect()}
    for r in docs.collect():
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert ids[r["doc_id"]] == want
        assert back[r["doc_id"]] == library.decode(want, skip_special_tokens=False)
    assert bpe.encode_documents(docs.limit(0)).count() == 0


def test_query(spark, library):
    got = {r["doc_id"]: r for r in bpe.op8_bpe_round_trip(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert got[r["doc_id"]][1:] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
