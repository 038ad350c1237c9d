"""Alignments against a plain merge with the two libraries, and the merge path on its own."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketgrade.llm import alignment, bpe, byte_level
from marketgrade.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sides():
    first = byte_level.read_byte_level(
        P.path("byte_bpe_50k.json"), bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN, plain_special=True
    )
    with open(P.path("piece_bpe_32k.model"), "rb") as model:
        return first, model.read()


def brute(rows):
    """Rows by id from (id, text), by the libraries themselves."""
    a_lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    ranks = {v: k for k, v in bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")).items()}

    def spell(i):
        piece = b_lib.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_lib.is_byte(i) else piece.replace("▁", " ").encode()

    docs = []
    for key, text in rows:
        text = text or ""
        a, b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
        bytes_a, bytes_b = [ranks[i] for i in a], [spell(i) for i in b]
        whole = (" " + text).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            a = b = bytes_a = bytes_b = []
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        common = sorted(set(ends_a) & set(ends_b))
        groups, links, i, j = [], [], 0, 0
        for end in common:
            i2, j2 = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            links.append((a[i2 - 1], b[j2 - 1]))
            i, j = i2, j2
        docs.append((key, len(a), len(b), ";".join(groups), links))
    count = Counter(x for *_, links in docs for x in links)
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return [
        (key, n_a, n_b, len(links), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), groups)
        for key, n_a, n_b, groups, links in docs
    ]


def key(row):
    return str(row)


def test_query_equals_plain_merge(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.where("length(text) < 4000").collect()])
    # Counts are of all documents, so only what one document gives is compared here.
    got = {r.doc_id: r for r in QUERIES["op12_alignment"](spark, FOLDER).collect()}
    assert len(got) == docs.count()
    for k, n_a, n_b, n_groups, n_links, _, _, groups in want:
        r = got[k]
        sha = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) == (n_a, n_b, n_groups, n_links, sha)


@pytest.mark.parametrize("piece", [3, 7, 50, 1 << 20])
def test_pieces_and_blocks_change_nothing(spark, sides, piece):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").limit(25).collect()]
    rows += [(100, None), (101, ""), (102, " "), (103, "  two  spaces\n\n"), (104, "<|endoftext|> a <s> <0x41> ▁"), (105, "日本語 émoji 👩‍👩‍👧 ﷽")]
    rows += [(106, "a" * 3000), (107, "x\ny " * 700), (None, "null id"), (7, "again"), (7, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = alignment.align(docs.withColumns({"a": F.lit(1), "block": F.lit(2), "id": F.lit("x")}), *sides, block_chars=9000, piece=piece)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows), key=key)


def test_no_rows_and_no_tables_left(spark, sides):
    before = spark.catalog.listTables()
    assert alignment.align(spark.createDataFrame([], "doc_id string, text string"), *sides).collect() == []
    assert spark.catalog.listTables() == before


ENDS = st.sets(st.integers(1, 60), min_size=1).map(lambda x: np.array(sorted(x | {60})))


@settings(max_examples=200, deadline=None)
@given(ENDS, ENDS, st.integers(1, 12))
def test_merge_path_cuts_the_merge_evenly(a, b, step):
    order = sorted([(e, 0) for e in a.tolist()] + [(e, 1) for e in b.tolist()])
    i, j = alignment.merge_path(a, b, step)
    assert (np.diff(i + j)[:-1] == step).all() and (i + j)[-1] == len(order)
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        assert (x, y) == (sum(s == 0 for _, s in order[: x + y]), sum(s == 1 for _, s in order[: x + y]))


def test_overlaps_cover_every_byte_once(spark, sides):
    lengths = alignment.Sides(*sides).lengths()
    rows = spark.createDataFrame([(1, "Some words, überlong wörds and 12345 numbers.")], "id long, text string")
    cut = rows.mapInArrow(alignment._cut_function(alignment.Sides(*sides), 1000, 5), f"id long, {alignment._PIECE_DDL}")
    found = alignment.overlaps(cut, *lengths).orderBy("piece", "a", "b").collect()
    pairs = sorted({(r.a, r.b) for r in found})
    assert pairs[0] == (0, 0) and all(0 <= c - a <= 1 and 0 <= d - b <= 1 for (a, b), (c, d) in zip(pairs, pairs[1:], strict=False))
    [whole] = alignment.align(rows, *sides, id_col="id").collect()
    assert sum(r.ends for r in found) == whole.n_links and pairs[-1] == (whole.n_a - 1, whole.n_b - 1)
