"""Registered queries against their SQL counterparts on the smallest benchmark tables."""

import math
import os

import pytest

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# The two queries that train 120 trees take minutes; they and the optional ones are compared on demand.
TRAINING = {"walk_forward_accuracy", "classifier_forecasts"}
NAMES = sorted(contract.QUERIES)
if not os.environ.get("ALL_QUERIES"):
    NAMES = [n for n in NAMES if n not in TRAINING]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="benchmark tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def test_every_query_but_the_training_ones_has_sql():
    missing = contract.QUERIES.keys() - contract.ORACLES.keys()
    assert missing == TRAINING
    assert contract.oracle_sql().keys() <= contract.queries().keys()


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = contract.queries()[name](spark, FOLDER)
    got = [tuple(row[c] for c in sorted(df.columns)) for row in df.collect()]
    if name not in contract.oracle_sql():
        assert got
        return
    result = duck.execute(contract.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    expected = [tuple(row[i] for i in order) for row in result.fetchall()]
    assert len(got) == len(expected)
    for have, want in zip(sorted(got, key=str), sorted(expected, key=str), strict=True):
        for a, b in zip(have, want, strict=True):
            assert a == b or (isinstance(a, float) and math.isclose(a, b, abs_tol=2e-6)), (have, want)


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert [r.strategy_id for r in rows] == ["momentum"]
