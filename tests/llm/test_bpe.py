"""Byte-level BPE by backtracking equals the rank-file tokenizer on whole texts, and decoding is an exact round trip."""

import hashlib
import random

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken

from counterpoise.llm import bpe, queries

RANKS = public_tokenizers.path(queries.BPE_RANKS)


@pytest.fixture(scope="module")
def reference():
    ranks = bpe.read_ranks(open(RANKS, "rb").read())
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder(reference):
    return bpe.Encoder(reference[0], public_tokenizers.PATTERN)


def test_documents_equal_tiktoken(encoder, reference):
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()
    for text in texts:
        assert encoder.encode(text) == reference[1].encode_ordinary(text or "")


def test_odd_texts_equal_tiktoken(encoder, reference):
    rnd = random.Random(7)
    alphabet = "ab c\n\t  \r éü日本語🙂'sTHE-1234.,!?\x00"
    odd = ["", " ", "\n\n\n", "a" * 5000, " " * 300 + "x", "🙂" * 200, "<|endoftext|>", "'s'S'll"]
    odd += ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    for text in odd:
        ids = encoder.encode(text)
        assert ids == reference[1].encode_ordinary(text)
        assert encoder.decode(ids) == text.encode("utf-8")


def test_null_text_has_no_ids(encoder):
    assert encoder.encode(None) == []


def test_query_digests_match_brute_force(spark, reference):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op11_bpe(spark, folder).collect()}
    rows = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert len(got) == len(rows)
    for row in rows:
        ids = reference[1].encode_ordinary(row["text"] or "")
        r = got[row["doc_id"]]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(bpe.ids_bytes(ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((row["text"] or "").encode()).hexdigest()


def test_spark_operator_keeps_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "Hello world", "z"), (3, "Hello world", "z")], "id long, text string, ids string")
    out = bpe.decode(bpe.encode(df, "text", RANKS, public_tokenizers.PATTERN), "ids", RANKS).orderBy("id").collect()
    assert [len(r.ids) for r in out] == [0, 0, 2, 2]
    assert [r.decoded for r in out] == [b"", b"", b"Hello world", b"Hello world"]
    empty = bpe.encode(df.limit(0), "text", RANKS, public_tokenizers.PATTERN)
    assert empty.count() == 0
    packed = bpe.decode(bpe.encode(df, "text", RANKS, public_tokenizers.PATTERN, packed=True), "ids", RANKS).orderBy("id").collect()
    assert [bytes(r.decoded) for r in packed] == [b"", b"", b"Hello world", b"Hello world"]
    assert [len(r.ids) for r in packed] == [0, 0, 8, 8]
    both = bpe.round_trip(df, "text", RANKS, public_tokenizers.PATTERN).orderBy("id").collect()
    assert [(bytes(r.ids), bytes(r.decoded)) for r in both] == [(bytes(r.ids), bytes(r.decoded)) for r in packed]
