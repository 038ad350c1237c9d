"""Ordered operators read each input once: summaries and rows share one exchange."""

import re

import pytest

from marketgrade.operators.timeline import Timeline, fill_columns, number, previous, running_max
from marketgrade.plans.catalog import QUERIES
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def scans(plan: str) -> int:
    return len(re.findall(r"FileScan|Scan ExistingRDD", plan))


# Inputs of a query: the events, plus replayed trades, prices or sentiment where it joins them.
@pytest.mark.parametrize(
    "name, inputs",
    [
        ("feature_rows", 1), ("training_labels", 1), ("ascending_trades", 2), ("cleaned_bars", 2),
        ("scored_outcomes", 2), ("backtest_accuracy", 2), ("rolling_accuracy", 2),
        ("degradation_alerts", 2), ("standings_snapshots", 2), ("sentiment_asof", 2), ("verdict_runs", 2),
    ],
)
def test_each_input_is_scanned_once(spark, name, inputs):
    plan = final_plan(QUERIES[name](spark, FOLDER))
    assert scans(plan) == inputs, plan
    assert "ReusedExchange" in plan


def test_a_chain_of_operators_scans_once(spark, tmp_path):
    rows = [("XY"[i % 2], i, i, float(i) if i % 3 else None) for i in range(60)]
    spark.createDataFrame(rows, "k string, t bigint, i bigint, v double").write.parquet(str(tmp_path / "t"))
    line = Timeline(("k",), ("t", "i"), 7)
    df = fill_columns(spark.read.parquet(str(tmp_path / "t")), line, {"f": F.col("v")})
    df = number(running_max(previous(df, line, F.col("f"), "p"), line, F.col("f"), "m"), line, "n")
    # The consumer needs few columns and few rows; the exchange is shared all the same.
    plan = final_plan(df.filter("k = 'X' AND n > 3").select("n", "m"))
    assert scans(plan) == 1, plan
    assert plan.count("ReusedExchange") >= 4


def test_null_keys_are_a_key(spark):
    rows = [(None, 1, 1, 5.0), (None, 30, 2, None), ("X", 2, 3, 7.0), ("X", 40, 4, None)]
    df = spark.createDataFrame(rows, "k string, t bigint, i bigint, v double")
    line = Timeline(("k",), ("t", "i"), 10)
    got = {r.i: (r.f, r.n) for r in number(fill_columns(df, line, {"f": F.col("v")}), line, "n").collect()}
    assert got == {1: (5.0, 0), 2: (5.0, 1), 3: (7.0, 0), 4: (7.0, 1)}
