"""The similarity join against all pairs."""

import random

import numpy as np
import pytest

from marketgrade.llm import ngram_join
from marketgrade.llm.common import components

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def brute_sets(text, words):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        folded = folded.replace(c, " ")
    w = [x for x in folded.split(" ") if x]
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute_force(rows, words, percent):
    """(id, component) by comparing all pairs."""
    sets = {}
    for key, text in rows:
        sets[key] = brute_sets(text, words)
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {(k, find(k)) for k in keys}


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80), (2, 60)])
def test_given_documents(spark, words, percent):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = ngram_join.classes(docs, words, percent).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {(r.doc_id, r.component) for r in got} == brute_force(rows, words, percent)
    assert {(r.doc_id, r.n_shingles) for r in got} == {(k, len(brute_sets(t, words))) for k, t in rows}


@pytest.mark.parametrize("block", [50, 100_000])
def test_edited_copies_in_small_and_large_blocks(spark, block):
    rng = random.Random(5)
    base = [[rng.choice("abcdefgh") + str(rng.randrange(900)) for _ in range(60)] for _ in range(4)]
    rows = []
    for i in range(120):
        text = list(base[i % 4])
        for _ in range(rng.randrange(4)):
            text[rng.randrange(60)] = f"new{i}"
        rows.append((1000 - i, " ".join(text)))
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id, r.component) for r in ngram_join.classes(docs, 3, 90, block_shingles=block).collect()}
    assert got == brute_force(rows, 3, 90)


def test_tree_links_connect_what_pairs_connect():
    rng = np.random.default_rng(3)
    for percent in (60, 80, 90):
        core = rng.integers(0, 2**60, 40)
        sets = [np.unique(np.where(rng.random(40) < 0.06, rng.integers(0, 2**60, 40), core)) for _ in range(60)]
        links = ngram_join.tree_links(sets, percent)
        root = list(range(60))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            inter = len(np.intersect1d(sets[a], sets[b]))
            assert 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter)
            root[find(a)] = find(b)
        assert len(links) < 60
        for a in range(60):
            for b in range(a):
                inter = len(np.intersect1d(sets[a], sets[b]))
                if 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
                    assert find(a) == find(b)


def test_nulls_empty_short_and_repeated_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "One"), (5, "one"), (6, "two words"), (7, "two words"), (7, "two words"), (None, "one"), (8, "Été a b c"), (9, "été a b c")]
    docs = spark.createDataFrame([(k, t, "x", 5) for k, t in rows], SCHEMA + ", component string, size int")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component) for r in ngram_join.classes(docs, 3, 90).collect())
    assert got == [(-1, 1, None), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 6), (7, 1, 6), (8, 2, 8), (9, 2, 9)]
    kept = ngram_join.one_of_each(docs, 3, 90)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 6, 8, 9]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert ngram_join.classes(docs).collect() == []
    assert ngram_join.one_of_each(docs).collect() == []


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
