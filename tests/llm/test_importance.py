"""Importance resampling: the sample against plain sorting, held-out accuracy, odd inputs."""

import numpy as np
import pytest

from marketgrade.llm import importance

FOLDER = "/root/testdata/sf0.01"


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    rows = labels.collect()
    teach = labels.where(labels.doc_id % 3 != 0)
    kept = {r.doc_id for r in importance.resample(docs, teach).collect()}
    test = [r for r in rows if r.doc_id % 3 == 0]
    good, bad = [r.doc_id for r in test if r.quality == 1], [r.doc_id for r in test if r.quality == 0]
    assert sum(k in kept for k in good) >= 0.9 * len(good)
    assert sum(k in kept for k in bad) <= 0.4 * len(bad)


def test_short_junk_goes_at_every_size(spark):
    for sf in ("sf0.001", "sf0.01"):
        docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
        model = importance.fit(docs, labels)
        assert np.isfinite(model.cut)
        kept = {r.doc_id for r in importance.resample(docs, labels, model=model).collect()}
        n_grams = {r.doc_id: len(importance.ngram_slots(r.text, {})) for r in docs.collect()}
        rows = labels.collect()
        good, bad = [r.doc_id for r in rows if r.quality == 1], [r.doc_id for r in rows if r.quality == 0]
        short = [k for k in bad if n_grams[k] < 500]
        assert len(short) >= 4 and sum(k in kept for k in short) <= 0.4 * len(short)
        assert sum(k in kept for k in good) >= 0.95 * len(good) and sum(k in kept for k in bad) < 0.5 * len(bad)


def test_held_out_quarter(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in importance.resample(docs, labels.where(labels.doc_id % 4 != 0)).collect()}
    test = [r for r in labels.collect() if r.doc_id % 4 == 0]
    good, bad = [r.doc_id for r in test if r.quality == 1], [r.doc_id for r in test if r.quality == 0]
    assert sum(k in kept for k in good) >= 0.9 * len(good)
    assert sum(k in kept for k in bad) <= 0.4 * len(bad)


def test_top_k_by_key(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    model = importance.fit(docs, labels)
    everything = importance.resample(docs, labels, k=10**9, model=model).collect()
    assert len(everything) == docs.count()
    known = {}
    for r in everything[:50]:
        assert abs(r.log_weight - model.ratio[importance.ngram_slots(r.text, known, len(model.ratio))].sum()) < 1e-6
    for k in (0, 1, 137, 999):
        got = {r.doc_id for r in importance.resample(docs, labels, k=k, model=model).collect()}
        assert got == {r.doc_id for r in sorted(everything, key=lambda r: -r.gumbel_key)[:k]}


@pytest.mark.parametrize("values", [[3.5], [1.0, 1.0, 1.0, 2.0], list(np.random.default_rng(1).normal(0, 1e6, 500)), [-1e9, 0.0, 1e-9, 2e-9, 1e9]])
def test_kth_largest(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    ordered = sorted(map(float, values), reverse=True)
    for k in {1, 2, 3, len(values) // 2, len(values), len(values) + 5} - {0}:
        assert importance.kth_largest(df, k) == ordered[min(k, len(values)) - 1]
    assert importance.kth_largest(df, 0) is None and importance.kth_largest(df.limit(0), 1) is None


def test_noise_is_gumbel(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'' AS text")
    model = importance.Model(np.zeros(16), -np.inf)
    noise = np.array([r.gumbel_key for r in importance.resample(docs, docs, k=10**6, model=model).select("gumbel_key").collect()])
    assert abs(noise.mean() - 0.5772) < 0.05 and abs(noise.var() - np.pi**2 / 6) < 0.1


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 2.0), (None, "a text", 3.0), (4, "word " * 30_000, 4.0), (4, "word " * 30_000, 4.0)], "doc_id long, text string, log_weight double")
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 0), (4, 1)], "doc_id long, quality int")
    out = importance.resample(docs, labels)
    assert out.columns == [*docs.columns, "_log_weight", "gumbel_key"] and out.count() == 5
    assert importance.resample(docs, labels.limit(0)).count() == 5
    assert importance.resample(docs.limit(0), labels).count() == 0
    assert importance.resample(docs, labels, k=0).count() == 0
