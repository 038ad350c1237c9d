"""Source divergences against a plain recount, with forced digest collisions, and odd tables."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from marketgrade.llm import divergence

FOLDER = "/root/testdata/sf0.001"


def brute(rows, least=10, ranks=10):
    """Rows of (lang, source, part, item, value, rank) from (lang, source, text)."""
    lower = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    docs = [(a or "", b or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower))) for a, b, t in rows]
    out = []
    for lang in {a for a, _, _ in docs}:
        own = [(s, w) for a, s, w in docs if a == lang]
        df = Counter(t for _, w in own for t in set(w))
        kept = {t for t, n in df.items() if n >= least}
        counts = defaultdict(Counter)
        for s, w in own:
            counts[s].update(t for t in w if t in kept)
        every = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(every)
        f = lambda x, y: (x - y) * (x - y) // (x + y)
        for s in p:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in p if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t])
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)]
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(terms[:ranks])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "lang string, source string, text string")


@pytest.mark.parametrize("bits", [64, 5, 0])
def test_equals_recount_whatever_collides(spark, bits):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("lang", "source", "text")
    digest = F.xxhash64 if bits == 64 else lambda c: F.xxhash64(c).bitwiseAND(F.lit((1 << bits) - 1))
    got = divergence.divergences(docs, digest=digest)
    assert sorted(map(tuple, got.collect())) == brute(map(tuple, docs.collect()))


def test_odd_rows(spark):
    rows = [("en", "a", "The the THE Ünder ÜNDER 5x"), (None, None, None), ("en", "b", ""), ("en", None, "the\x00the_the"), ("de", "a", "x")] * 6
    rows += [("en", "a", "the " * 20_000), ("en", "c", "zzz")]
    got = divergence.divergences(table(spark, rows).withColumns({"n": F.lit(1), "term": F.lit("x"), "docs": F.lit(2), "value": F.lit(3)}), least_docs=5)
    assert sorted(map(tuple, got.collect())) == brute(rows, least=5)


def test_many_blocks_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TILE", 3)
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 2)
    rows = [("en", f"s{i % 8}", " ".join(f"{chr(97 + (i * k) % 20)}" for k in range(i % 13))) for i in range(120)]
    got = divergence.divergences(table(spark, rows), least_docs=3)
    assert sorted(map(tuple, got.collect())) == brute(rows, least=3)


def test_no_rows(spark):
    assert divergence.divergences(table(spark, [])).collect() == []


def test_strings_are_not_shuffled_with_counts(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    plan = divergence.divergences(docs)._jdf.queryExecution().executedPlan().toString()
    counts = [line for line in plan.splitlines() if "Exchange hashpartitioning(lang" in line and "term" in line]
    assert all("digest" in line for line in counts)
