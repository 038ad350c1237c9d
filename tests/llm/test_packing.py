"""Packing: pieces against the tokenizer library, sequences whole and nearly as few as sequential best fit."""

import bisect
import math
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketgrade.llm import bpe, byte_level, packing
from marketgrade.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokens():
    return byte_level.read_byte_level(P.path("byte_bpe_50k.json"), bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)


def best_fit(lengths, size):
    """Number of sequences that one machine needs, largest piece first into the smallest gap."""
    gaps, n = [], 0
    for x in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, x)
        gap = gaps.pop(at) if at < len(gaps) else size
        n += gap == size
        if gap > x:
            bisect.insort(gaps, gap - x)
    return n


def check(rows, size):
    """Sequences are gapless from 0 and hold at most ``size``; returns their number."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_query(spark):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op13_best_fit"](spark, FOLDER).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by.keys() == docs.keys()
    for k, text in docs.items():
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        own = sorted(by[k], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // 1024)))
        assert all(r.length == 1024 for r in own[1:]) and sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    lengths = [r.length for r in rows]
    assert math.ceil(sum(lengths) / 1024) <= check(rows, 1024) <= best_fit(lengths, 1024) + 1


@pytest.mark.parametrize("case", ["uniform", "small", "hot", "equal"])
def test_nearly_best_fit(spark, case):
    rng = np.random.default_rng(7)
    n = 3000
    lengths = {
        "uniform": rng.integers(1, 101, n),
        "small": rng.integers(1, 8, n),
        "hot": np.where(rng.random(n) < 0.4, 30, rng.integers(1, 101, n)),
        "equal": np.full(n, 34),
    }[case].tolist()
    pieces = spark.createDataFrame(list(enumerate(lengths)), "uid long, length int").withColumn("offset", F.lit("clash"))
    rows = packing.pack(pieces, size=100).collect()
    assert sorted(r.uid for r in rows) == list(range(n))
    assert check(rows, 100) <= best_fit(lengths, 100) * 1.005 + 1


def test_odd_texts(spark, tokens):
    texts = ["", None, "a<|endoftext|>b", "日本語", "x " * 5000, "same", "same", " \x1c\x85\xa0 \n\n "]
    docs = spark.createDataFrame([*enumerate(texts), (None, "null id"), (5, "repeat")], "doc_id long, text string")
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces = packing.token_pieces(docs.withColumns({"piece": F.lit(1), "ids": F.lit("x")}), tokens, end_id=2, size=64)
    packed = packing.pack(pieces, size=64)
    rows = packed.collect()
    assert check(rows, 64) == packing.sequences(packed).count()
    whole = {}
    for r in sorted(rows, key=lambda r: r.piece):
        whole[r.uid - r.piece] = whole.get(r.uid - r.piece, b"") + bytes(r.ids)
    want = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for t in [*texts, "null id", "repeat"]]
    assert sorted(whole.values()) == sorted(want)
    joined = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    for r in rows:
        assert joined[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)


def test_empty_and_wrong(spark):
    empty = spark.createDataFrame([], "uid long, length int")
    assert packing.pack(empty).collect() == []
    with pytest.raises(ValueError, match="lengths"):
        packing.pack(spark.createDataFrame([(1, 1025)], "uid long, length int"))


def test_across_is_best_fit_over_ranges():
    spans, served = packing._across([(0, 0, 3), (1, 2, 1), (2, 5, 0)])
    assert spans == [(1, 0, 2, 0, 0), (2, 0, 1, 1, 0), (2, 1, 2, 0, 1)]
    assert served == {1: 2, 2: 2}


def test_words_give_the_same_ids(tokens):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    chars = list(map(chr, range(0x250)))
    texts = [f"a{c} b{c}{c}1{c} {c}\n{c}  {c}é'{c}s {c}" for c in chars] + [f"a{c} {c}b {c}" for c in chars] + [f"{c}b c{c}" for c in chars]
    texts += ["".join(chars), "a" * 500, "'s 's'LL don't", "1234567 " * 9, " a", "a ", "a\n b", "a \nb", "a\n\n b  c", "", " ", "\n", "x\t y"]
    for lead in (False, True):
        want = [library.encode(" " + t if lead else t, add_special_tokens=False).ids for t in texts]
        assert [x.tolist() for x in tokens.encoder(lead)(texts)] == want
    assert [x.tolist() for x in byte_level.piece_encoder(model)(texts)] == model.encode(texts)


def test_ranges_follow_the_rows_and_not_the_packing_the_ranges(spark, monkeypatch):
    lengths = np.random.default_rng(5).integers(1, 101, 1500)
    rows = spark.createDataFrame([(i, int(x)) for i, x in enumerate(lengths)], "uid long, length int").repartition(3)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        items = rows.select("uid", F.col("length").alias("len"))
        gaps = spark.createDataFrame([(7, 300)], "bin long, gap int")
        assert packing._sweep(items, gaps, 1, 100).rdd.getNumPartitions() == 1
        one = {r.uid: (r.sequence_id, r.offset) for r in packing.pack(rows, 100).collect()}
        monkeypatch.setattr(packing, "RANGE_ROWS", 200)
        assert packing._sweep(items, gaps, 1, 100).rdd.getNumPartitions() == 8
        assert {r.uid: (r.sequence_id, r.offset) for r in packing.pack(rows, 100).collect()} == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
