"""Rollup totals against recounting, with repeats, deletes and failures half-way."""

import random

import public_tokenizers
import tiktoken

from marketgrade.llm import bpe, token_rollup
from marketgrade.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def totals(rollup):
    return {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens, r.n_chars) for r in rollup.totals().collect()}


def recount(live):
    out = {}
    for (_, version), (source, lang, tokens, chars) in live.items():
        n, t, c = out.get((source, lang, version), (0, 0, 0))
        out[source, lang, version] = (n + 1, t + tokens, c + chars)
    return out


def test_random_batches(spark, tmp_path):
    rng = random.Random(4)
    rollup = token_rollup.TokenRollup(spark, str(tmp_path / "r"))
    live = {}
    for batch in range(5):
        changes = {}
        for _ in range(30):
            key = (rng.randrange(25), rng.choice(["v1", "v2"]))
            changes[key] = (rng.choice("ab"), rng.choice(["en", "de"]), rng.choice(["insert", "revise", "delete"]), rng.randrange(100), rng.randrange(500))
        for key, (source, lang, op, tokens, chars) in changes.items():
            if op == "delete":
                live.pop(key, None)
            else:
                live[key] = (source, lang, tokens, chars)
        rows = [(k, s, lang, v, op, t, c) for (k, v), (s, lang, op, t, c) in changes.items()]
        frame = spark.createDataFrame(rows + rows[:3], token_rollup.CHANGE)
        assert rollup.apply(f"b{batch}", frame)
        assert totals(rollup) == recount(live)
        assert not rollup.apply(f"b{batch}", frame) and totals(rollup) == recount(live)
    assert {(r.doc_id, r.version) for r in rollup.ledger().collect()} == set(live)


def test_the_last_change_in_a_batch_counts(spark, tmp_path):
    rng = random.Random(5)
    rollup = token_rollup.TokenRollup(spark, str(tmp_path / "r"))
    live = {}
    for batch in range(3):
        rows = []
        for seq in range(60):
            key, op, tokens, chars = (rng.randrange(12), "v"), rng.choice(["insert", "revise", "delete"]), rng.randrange(100), rng.randrange(500)
            rows.append((key[0], "a", "en", "v", op, tokens, chars, seq))
            if op == "delete":
                live.pop(key, None)
            else:
                live[key] = ("a", "en", tokens, chars)
        rng.shuffle(rows)
        assert rollup.apply(f"b{batch}", spark.createDataFrame(rows + rows[:5], token_rollup.SEQUENCED_CHANGE))
        assert totals(rollup) == recount(live)
    rows = [(99, "a", "en", "w", "insert", 7, 7, 1), (99, "a", "en", "w", "insert", 90, 90, None), (99, "a", "en", "w", "delete", 0, 0, 1)]
    rollup.apply("ties", spark.createDataFrame(rows, token_rollup.SEQUENCED_CHANGE))
    assert totals(rollup)["a", "en", "w"] == (1, 7, 7)


def test_an_unfinished_batch_does_not_count(spark, tmp_path):
    rollup = token_rollup.TokenRollup(spark, str(tmp_path / "r"))
    rows = spark.createDataFrame([(1, "a", "en", "v1", "insert", 5, 9)], token_rollup.CHANGE)
    rollup.apply("one", rows)
    (tmp_path / "r" / "commits" / "one").unlink()
    (tmp_path / "r" / "commits" / ".one.crc").unlink(missing_ok=True)
    assert totals(rollup) == {} and rollup.apply("one", rows)
    assert totals(rollup) == {("a", "en", "v1"): (1, 5, 9)}


def test_nulls_and_empty_batches(spark, tmp_path):
    rollup = token_rollup.TokenRollup(spark, str(tmp_path / "r"))
    rows = [(1, None, None, "v", "insert", None, 3), (None, "a", "en", "v", "insert", 1, 1), (2, "a", "en", None, "insert", 1, 1), (3, "a", "en", "v", "what", 1, 1), (4, "a", "en", "v", "delete", 1, 1)]
    assert rollup.apply("one", spark.createDataFrame(rows, token_rollup.CHANGE))
    assert rollup.apply("none", spark.createDataFrame([], token_rollup.CHANGE))
    assert totals(rollup) == {("unknown", "unknown", "v"): (1, 0, 3)}
    assert rollup.apply("gone", spark.createDataFrame([(1, "z", "en", "v", "delete", 9, 9)], token_rollup.CHANGE))
    assert totals(rollup) == {}


def test_query(spark):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encode = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    live = {}
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        live[r.doc_id, "byte_bpe_multi_50k"] = (r.source, r.lang, len(encode(r.text)), len(r.text))
        if r.lang == "en":
            live[r.doc_id, "words-1"] = (r.source, r.lang, len(r.text.split()), len(r.text))
    got = {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens, r.n_chars) for r in QUERIES["op1_token_counts"](spark, FOLDER).collect()}
    assert got == recount(live)


def test_query_revises_and_takes_back_null_languages(spark, tmp_path, monkeypatch):
    rows = [(1, "a", "en", "two  words\nhere "), (2, "a", None, "no language"), (3, "a", "de", "ein Wort"), (4, "a", "en", None)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    apply = token_rollup.TokenRollup.apply

    def watched(rollup, batch, changes):
        done = apply(rollup, batch, changes)
        seen.append((batch, done, totals(rollup).get(("a", "en", "words-1"))))
        return done

    monkeypatch.setattr(token_rollup.TokenRollup, "apply", watched)
    got = QUERIES["op1_token_counts"](spark, str(tmp_path)).collect()
    assert {(r.source, r.lang, r.n_docs, r.n_tokens) for r in got if r.version == "words-1"} == {("a", "en", 2, 3)}
    assert [x[2][1] for x in seen] == [5, 5, 5, 3, 3, 3] and [x[1] for x in seen] == [True, True, False, True, False, True]


def test_counts_of_odd_texts(spark):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "two words")], "doc_id long, text string")
    got = [r.n_tokens for r in token_rollup.bpe_counts(docs, ranks, public_tokenizers.PATTERN).orderBy("doc_id").collect()]
    assert got[:2] == [0, 0] and got[2] >= 2
