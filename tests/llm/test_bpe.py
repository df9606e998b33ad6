import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from brute import SMALL

from usagelens.llm import bpe
from usagelens.llm.queries import op4_byte_bpe


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def tik(ranks):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(ranks)}, special_tokens={})
    return lambda text: np.array(enc.encode_ordinary(text), "<u4").tobytes()


def odd_texts():
    rng = random.Random(3)
    alphabet = [chr(x) for x in range(0x250)] + list(" \t\n\r\u0085  　​'''stremvld") * 3
    alphabet += [chr(rng.randrange(0x300, 0xD000)) for _ in range(200)] + [chr(rng.randrange(0x10000, 0x1F900)) for _ in range(80)]
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(1000)]
    return [*out, "", "a" * 3000, "ab " * 2000, "'re" * 100, " " * 999, "<|endoftext|> x"]


def test_ids_equal_the_library(ranks, tik, monkeypatch):
    codec = bpe.Codec(bpe.sentencepiece_model(ranks), P.PATTERN)
    plain = bpe.Codec(bpe.sentencepiece_model(ranks), P.PATTERN)
    plain.chunks = None
    assert P.PATTERN == bpe.SPACE_JOINS_NEXT
    for text in odd_texts():
        ids = tik(text)
        assert codec.encode(text) == plain.encode(text) == ids
        assert codec.decode(ids) == text.encode()
    monkeypatch.setattr(bpe, "WINDOW", 41)
    for text in odd_texts():
        assert plain.encode(text) == tik(text)


def test_whole_table(spark, tik):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = op4_byte_bpe(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = tik(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_rows(spark, tik):
    rows = [(1, None, "x"), (None, "", "x"), (2, "a  b", "x"), (2, "a  b", "x"), (3, "long " * 300_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens string")
    codec = bpe.ByteBpe(spark, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = codec.decode(codec.encode(docs)).collect()
    for r in got:
        assert bytes(r.ids) == tik(r.text or "") and bytes(r.decoded) == (r.text or "").encode() and r.tokens == "x"
    assert len(got) == 5
    assert codec.decode(codec.encode(docs.limit(0))).count() == 0


def test_result_columns_replace_old_ones(spark, tik):
    codec = bpe.ByteBpe(spark, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    docs = spark.createDataFrame([(1, "some text", "old", "older", "x")], "doc_id long, text string, ids string, decoded string, pieces string")
    both = codec.decode(codec.encode(docs))
    assert both.columns == ["doc_id", "text", "pieces", "ids", "decoded"]
    row = both.first()
    assert bytes(row.ids) == tik("some text") and bytes(row.decoded) == b"some text" and row.pieces == "x"
