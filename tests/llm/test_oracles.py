"""Registered queries of the subpackage against their SQL, and the pipeline's stages in a row."""

import duckdb
import pytest

from marketgrade.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    df = QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(str, result.fetchall()))


def test_one_query_per_operator():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from marketgrade.llm import decontam, importance, line_dedup, ngram_join

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    seen = docs
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen, FOLDER).write.parquet(str(tmp_path / str(number)))
        after = spark.read.parquet(str(tmp_path / str(number)))
        if number < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns, name
        before, left = seen.select("doc_id", "text").collect(), {r.doc_id: r for r in after.collect()}
        if number == 0:
            assert set(left) == {r.doc_id for r in importance.resample(docs, labels).collect()}
            good = {r.doc_id for r in labels.where("quality = 1").collect()}
            assert len(good - set(left)) < 0.1 * len(good)
        elif number == 1:
            kept = {r.doc_id: r.text for r in line_dedup.line_dedup(seen).collect()}
            assert {k: r.text for k, r in left.items()} == kept
            assert all(r.n_chars == len(r.text) for r in left.values())
        elif number == 2:
            assert set(left) == {c for _, c in brute_classes(before, 5, 80)}
        elif number == 3:
            bad = {r.doc_id for r in decontam.leaks(seen, benchmark).collect()}
            assert set(left) == {r.doc_id for r in before} - bad
        else:
            assert all(r.n_bytes == len(t.text.encode()) and r.n_tokens == len(r.ids) for t in before for r in [left[t.doc_id]])
        seen = after
    assert set(left) == {r.doc_id for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert ngram_join


def brute_classes(rows, words, percent):
    from test_ngram_join import brute_force

    return brute_force([(r.doc_id, r.text) for r in rows], words, percent)
