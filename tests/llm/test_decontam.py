"""Decontamination against overlap with every item, and the index against full scoring."""

import math
import random

from marketgrade.llm import decontam

FOLDER = "/root/testdata/sf0.001"


def brute_leaks(docs, items):
    found = set()
    for key, text in docs:
        have = decontam.shingles(decontam.words_of(text))
        for item, words in items:
            shares = [len(s & have) / len(s) for s in map(decontam.shingles, decontam.question_and_answer(words)) if len(next(iter(s), ())) == 5]
            if shares and all(s >= 0.5 for s in shares) and decontam.words_of(words):
                found.add((key, item))
    return found


def test_given_documents(spark):
    docs, benchmark = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, benchmark).collect()}
    want = brute_leaks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in benchmark.collect()])
    assert want <= got and len(got) >= 3
    clean = decontam.decontaminated(docs, benchmark)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - {k for k, _ in got}


def test_search_finds_all_units_above_the_share():
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, weights=range(400, 0, -1), k=rng.randrange(5, 90)))) for i in range(150)]
    index = decontam.Index(items)
    for _ in range(200):
        item = rng.choice(items)[1].split()
        words = rng.choices(vocabulary, k=60) + item[: rng.randrange(len(item) + 1)]
        terms = sorted({index.term[w] for w in words if w in index.term})
        for share in (0.3, 0.5, 0.9):
            scores = [0.0] * len(index.owner)
            for t in terms:
                for u, s in zip(index.units[t], index.impacts[t], strict=True):
                    scores[u] += s
            assert sorted(index.search(terms, share)) == [u for u, s in enumerate(scores) if s >= share - 1e-9]


def test_long_items_long_texts_and_edits(spark):
    rng = random.Random(2)
    prose = lambda n: " ".join(f"p{rng.randrange(5000)}" for _ in range(n))
    item = prose(150) + ". " + prose(20) + "."
    docs = [(1, prose(30_000) + " " + item.upper() + " " + prose(100)), (2, prose(500)), (3, item.replace("p1", "q1")), (4, item), (4, item), (5, item[: len(item) // 4])]
    table = spark.createDataFrame([(k, t, 1.0) for k, t in docs], "doc_id long, text string, question_share double")
    benchmark = spark.createDataFrame([(10, item), (11, prose(20)), (12, None), (13, "")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontam.leaks(table, benchmark).collect())
    assert got == [(1, 10), (4, 10), (4, 10)]


def test_short_answers_missing_edited_and_repunctuated(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join(f"p{rng.randrange(5000)}" for _ in range(n))
    items, docs, want = [], [], set()
    for number in range(40):
        question, answer = prose(rng.randrange(6, 50)), prose(1 + number % 4)
        items.append((number, f"{question}. {answer}."))
        for kind, leak in enumerate([question, f"{question}. q1 q2", f"{question}, {answer}!", question.replace(" ", ", ") + f'? "{answer}"', f"{answer}. {prose(40)}"]):
            docs.append((5 * number + kind, f"{prose(60)} {leak} {prose(60)}"))
            if kind < 4:
                want.add((5 * number + kind, number))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(table, benchmark).collect()} == want
    assert {r.doc_id for r in decontam.decontaminated(table, benchmark).collect()} == {k for k, _ in docs} - {k for k, _ in want}


def test_parts_keep_the_scores_and_a_sparse_table_the_bounds(spark, monkeypatch):
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in benchmark.orderBy("item_id", "text").collect()]
    whole = decontam.Index(items)

    def impacts(index):
        return sorted((index.items[index.owner[u]][0], t, round(s, 9)) for t, i in index.term.items() for u, s in zip(index.units[i], index.impacts[i], strict=True))

    monkeypatch.setattr(decontam, "PART_BYTES", 2000)
    parts = list(decontam._parts(benchmark, "item_id", "text"))
    assert len(parts) > 3 and all(sum(len(t.encode()) for _, t in part) <= 2000 for part, _ in parts if len(part) > 1)
    assert sorted(x for part in parts for x in impacts(decontam.Index(*part))) == impacts(whole)
    dense = whole.dense_bounds()
    monkeypatch.setattr(decontam, "TABLE_CELLS", 10)
    assert whole.dense_bounds() is None
    text = "some words " + items[3][1] + " and more " + items[7][1]
    assert list(whole.leaks(text, None)) == list(whole.leaks(text, dense)) and len(list(whole.leaks(text, None))) >= 2


def test_impacts_are_normalised_by_length():
    texts = ["a a b", "a b " + " ".join(f"c{i}" for i in range(40)), "d e f a"]
    index = decontam.Index(list(enumerate(texts)))
    units = [t.split() for t in texts]
    mean = sum(map(len, units)) / 3
    for n, words in enumerate(units):
        df = {t: sum(t in u for u in units) for t in words}
        score = {t: math.log(1 + (3 - df[t] + 0.5) / (df[t] + 0.5)) * words.count(t) * 2.2 / (words.count(t) + 1.2 * (0.25 + 0.75 * len(words) / mean)) for t in df}
        got = {t: s for t, i in index.term.items() for u, s in zip(index.units[i], index.impacts[i], strict=True) if u == n}
        assert got.keys() == score.keys() and all(abs(got[t] - score[t] / sum(score.values())) < 1e-9 for t in got)


def test_parts_nulls_and_empty_tables(spark, monkeypatch):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b c d e f g h i j k l"), (4, "x y z")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "a b c d e f g h i j k l"), (2, "x y z")], "item_id long, text string")
    monkeypatch.setattr(decontam, "PART_BYTES", 10)
    assert sorted(str((r.doc_id, r.item_id)) for r in decontam.leaks(docs, benchmark).collect()) == ["(4, 2)", "(None, 1)"]
    assert sorted(r.doc_id for r in decontam.decontaminated(docs, benchmark).collect()) == [1, 2]
    assert decontam.leaks(docs, benchmark.limit(0)).collect() == []
    assert decontam.leaks(docs.limit(0), benchmark).collect() == []
    assert decontam.decontaminated(docs, benchmark.limit(0)).count() == 4


def test_block_size_changes_no_find(spark, monkeypatch):
    """Block-max bounds drop nothing: any block size finds what scoring every unit finds."""
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(300).collect()
    texts = [r.text or "" for r in docs] + [f"{items[i][1]} {items[i + 1][1][:80]}" for i in range(0, min(40, len(items) - 1), 3)]
    found = {}
    for size in (1, 2, 3, 8):
        monkeypatch.setattr(decontam, "BLOCK_ITEMS", size)
        index = decontam.Index(items)
        table = index.dense_bounds()
        found[size] = [[n for n, _, _ in index.leaks(t, table)] for t in texts]
        if size == 2:
            assert [[n for n, _, _ in index.leaks(t, None)] for t in texts] == found[size]
            for text in texts[-10:]:
                terms = sorted({index.term[w] for w in decontam.words_of(text)[: decontam.PASSAGE_WORDS] if w in index.term})
                score = {}
                for t in terms:
                    for u, s in zip(index.units[t], index.impacts[t], strict=True):
                        score[u] = score.get(u, 0.0) + s
                assert index.search(terms, 0.5) == sorted(u for u, s in score.items() if s >= 0.5 - 1e-9)
    assert found[1] == found[2] == found[3] == found[8]
    assert any(found[1][-5:])
