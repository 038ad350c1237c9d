"""Encoding against the tiktoken library, decoding by round trip."""

import public_tokenizers
import pytest
import tiktoken

from marketgrade.llm import bpe

FOLDER = "/root/testdata/sf0.001"
RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def encoded(docs, **options):
    return bpe.encode(docs, RANKS, public_tokenizers.PATTERN, **options)


@pytest.mark.parametrize("block_chars", [500, 8_000_000])
def test_given_documents(spark, reference, block_chars):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = bpe.decode(encoded(docs, block_chars=block_chars), RANKS).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == reference.encode_ordinary(texts[r.doc_id])
        assert bytes(r.bytes) == texts[r.doc_id].encode()


def test_odd_texts(spark, reference):
    texts = ["", None, " ", "  a  b\n\n\n c", "it's 'S 12345 ½", "<|endoftext|>", "你好世界 \U0001f600\U0001f468‍\U0001f469", "\x00\x01  x", "a" * 3000, "word " * 5000]
    rows = [(i % 4 if i else None, t, "x") for i, t in enumerate(texts)] + [(1, "again", "x"), (1, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id or -1, str(r.ids), bytes(r.bytes).decode()) for r in bpe.decode(encoded(docs), RANKS).collect())
    assert got == sorted((k or -1, str(reference.encode_ordinary(t or "")), t or "") for k, t, _ in rows)


def test_empty_table_and_null_ids(spark):
    assert encoded(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    ids = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r.bytes for r in bpe.decode(ids, RANKS).orderBy("doc_id").collect()] == [None, b""]


def test_ranks_as_a_table(spark):
    small = {b"a": 0, b"b": 1, b"ab": 2}
    assert sorted((r.id, bytes(r.bytes)) for r in bpe.ranks_table(spark, small).collect()) == [(0, b"a"), (1, b"b"), (2, b"ab")]
