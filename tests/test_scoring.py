import random

import pytest
from pyspark.sql import functions as F

from marketgrade.functions import scoring
from marketgrade.operators import evaluate
from marketgrade.operators import leaderboard as L

FORECAST = (
    "symbol string, horizon_s int, yhat double, confidence double, strategy_id string, ts bigint, "
    "model_ver string, ref_price double, trade_id bigint"
)
PRICE = "symbol string, ts bigint, trade_id bigint, last_price double"


def test_first_price_at_or_after_the_due_time(spark):
    calls = spark.createDataFrame(
        [
            ("A", 60, 0.01, 0.6, "m", 1000, "v0", 100.0, 0),
            ("A", 3600, 0.01, 0.6, "m", 1000, "v0", 100.0, 0),
            ("B", 60, 0.0, 0.6, "m", 1000, "v0", 0.0, 1),
        ],
        FORECAST,
    )
    prices = spark.createDataFrame(
        [("A", 30_000, 5, 50.0), ("A", 61_000, 7, 103.0), ("A", 61_000, 6, 102.0), ("B", 70_000, 8, 9.0)], PRICE
    )
    matched = evaluate.match_prices(calls, prices)
    out = {r.symbol: r for r in evaluate.score_rows(matched).collect()}
    assert len(out) == 2
    assert out["A"].realized_price == 102.0 and out["A"].realized_return == pytest.approx(0.02)
    assert out["A"].hit and out["A"].abs_error == pytest.approx(0.01) and out["A"].scored_ts == 61_000
    assert out["B"].realized_return == 0.0 and out["B"].hit  # no move forecast, none measured
    waiting = evaluate.pending(matched).collect()
    assert [(r.symbol, r.horizon_s) for r in waiting] == [("A", 3600)]


def outcomes(spark, hits, strategy="m", start=0):
    rows = [
        ("A", strategy, h, 0.02 * (not h), 0.5, 1000 * (start + i), start + i, 0, start + i)
        for i, h in enumerate(hits)
    ]
    return spark.createDataFrame(
        rows,
        "symbol string, strategy_id string, hit boolean, abs_error double, confidence double, "
        "scored_ts bigint, scored_trade_id bigint, pred_ts bigint, pred_trade_id bigint",
    )


def test_metrics(spark):
    row = outcomes(spark, [True, True, False]).agg(*scoring.stats()).first()
    assert row.dir_acc == pytest.approx(2 / 3) and row.mae == pytest.approx(0.02 / 3)
    assert row.calibration_gap == pytest.approx(0.5 - 2 / 3)
    empty = outcomes(spark, [True]).filter("false").agg(*scoring.stats()).first()
    assert (empty.n, empty.dir_acc, empty.mae) == (0, 0.0, 0.0)


def test_standings_order_window_and_rank(spark):
    both = outcomes(spark, [True, True, True, False], "momentum").union(
        outcomes(spark, [True, False, True, False], "ensemble")
    )
    rows = L.ranked(L.standings(both)).orderBy("rank").collect()
    assert [r.strategy_id for r in rows] == ["momentum", "ensemble"]
    assert [r.leader for r in rows] == [True, False] and rows[0].symbol == "*"
    last_two = L.standings(both, window=2).collect()
    assert {r.strategy_id: (r.n, r.dir_acc) for r in last_two} == {"momentum": (2, 0.5), "ensemble": (2, 0.5)}
    assert [r.n for r in L.backtest(both).collect()] == [4, 4]


def test_one_alert_until_recovery(spark):
    fired = L.alerts(outcomes(spark, [False] * 5), window=50, min_samples=4, floor=0.5).collect()
    assert len(fired) == 1 and fired[0].seq == 3
    assert fired[0].message == "m directional accuracy 0% over last 4 (< 50%)"
    again = L.alerts(outcomes(spark, [False] * 4 + [True] * 6 + [False] * 9), window=6, min_samples=4, floor=0.5)
    assert again.count() == 2
    assert L.alerts(outcomes(spark, [False] * 9), window=3, min_samples=4).count() == 0


def test_rolling_equals_a_plain_loop_for_small_blocks(spark):
    rng = random.Random(2)
    hits = [rng.random() < 0.5 for _ in range(130)]
    rolled = L.rolling(outcomes(spark, hits), window=20, width=7_000, block_rows=25).collect()
    assert len(rolled) == 130
    for r in rolled:
        seen = hits[max(0, r.seq - 19) : r.seq + 1]
        assert r.n == len(seen) and r.dir_acc == pytest.approx(sum(seen) / len(seen))


def test_snapshots_hold_every_strategy_seen_so_far(spark):
    both = outcomes(spark, [True] * 5, "a").union(outcomes(spark, [False] * 5, "b", start=5))
    taken = L.snapshots(both, ["a", "b"], every=4, block_rows=200).orderBy("seen", "strategy_id").collect()
    assert [(r.seen, r.strategy_id, r.n) for r in taken] == [(4, "a", 4), (8, "a", 5), (8, "b", 3)]


def test_sign_and_due_time(spark):
    row = spark.range(1).select(
        scoring.sign(F.lit(-0.5)).alias("s"), scoring.target_ts(F.lit(5), F.lit(3_000_000)).alias("t")
    ).first()
    assert (row.s, row.t) == (-1, 3_000_000_005)
