import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketgrade.operators import deep, strategies
from marketgrade.operators.strategies import Signals

ROW = (
    "symbol string, ts bigint, trade_id bigint, last_price double, ema_fast double, ema_slow double, "
    "vwap double, ret_1 double, vol double, rsi double"
)
SNAP = "symbol string, score double, n int, ts bigint, sources array<string>"


def rows(spark, *cells):
    """(symbol, ts, fast, slow, rsi) rows."""
    made = [(s, ts, i, 100.0, f, sl, None, None, None, rsi) for i, (s, ts, f, sl, rsi) in enumerate(cells)]
    return spark.createDataFrame(made, ROW)


def test_momentum(spark):
    df = rows(spark, ("A", 1, 101.0, 100.0, None), ("A", 2, 100.01, 100.0, None), ("A", 3, None, 1.0, None), ("A", 4, 1.0, 0.0, None))
    made = strategies.momentum(df, Signals()).orderBy("ts").collect()
    assert [r.ts for r in made] == [1, 2]
    assert made[0].yhat == pytest.approx(0.01) and made[0].confidence == pytest.approx(0.2)
    assert made[1].confidence == 0.05 and made[1].horizon_s == 60


def test_registry_order_unknown_and_failing(spark):
    assert strategies.registered_ids() == ["deep_analysis", "ensemble", "ml_model", "momentum", "sentiment_llm"]
    df = rows(spark, ("A", 1, 101.0, 100.0, None))
    with pytest.raises(KeyError):
        strategies.forecasts(df, ["nothing"])

    @strategies.register("broken")
    def broken(features, signals):
        raise RuntimeError

    try:
        made = strategies.forecasts(df, ["broken", "momentum", "deep_analysis", "ml_model"]).collect()
    finally:
        del strategies._STRATEGIES["broken"]
    assert [r.strategy_id for r in made] == ["momentum"]


def test_python_strategy_loses_only_failing_rows(spark):
    def predict(batch):
        if (batch["ts"] == 2).any():
            raise ValueError
        return batch.assign(horizon_s=60, yhat=0.1, confidence=0.5)

    df = rows(spark, *[("A", i, 1.0, 1.0, None) for i in range(4)])
    made = strategies.python_strategy("mine", predict)(df, Signals())
    assert sorted(r.ts for r in made.collect()) == [0, 1, 3]


def test_deep_view_is_restamped(spark):
    views = spark.createDataFrame(
        [("A", "bullish", 0.02, 0.7, 3600, 5, "b", "deep-v0")],
        "symbol string, stance string, yhat double, confidence double, horizon_s int, ts bigint, briefing_md string, model_ver string",
    )
    df = rows(spark, ("A", 4, 1.0, 1.0, None), ("A", 9, 1.0, 1.0, None), ("B", 9, 1.0, 1.0, None))
    made = strategies.deep_analysis(df, Signals(deep=views)).collect()
    assert [(r.symbol, r.ts, r.yhat, r.horizon_s, r.ref_price, r.model_ver) for r in made] == [("A", 9, 0.02, 3600, 100.0, "deep-v0")]


def test_verdict_is_asked_once_per_run_and_restamped(spark):
    def model(prompts):
        return pd.Series([json.dumps({"yhat": 0.9 if "RSI 50" in p else -0.01, "confidence": 1.8}) for p in prompts])

    snaps = spark.createDataFrame([("A", 0.4, 10, 500, ["x"])], SNAP)
    df = rows(spark, ("A", 1000, 1.0, 1.0, 50.2), ("A", 2000, 1.0, 1.0, 50.4), ("A", 3000, 1.0, 1.0, 70.0), ("A", 4000, 1.0, 1.0, 50.0), ("B", 1000, 1.0, 1.0, 50.0))
    runs = strategies.verdict_runs(strategies.with_sentiment(df, snaps))
    assert [r.head for r in runs.orderBy("ts").collect()] == [True, False, True, True]
    made = strategies.sentiment_verdicts(df, Signals(sentiment=snaps, model=model)).orderBy("ts").collect()
    assert [(r.ts, r.yhat, r.confidence) for r in made] == [(1000, 0.05, 1.0), (2000, 0.05, 1.0), (3000, -0.01, 1.0), (4000, 0.05, 1.0)]


def test_failed_verdict_gives_no_forecast(spark):
    snaps = spark.createDataFrame([("A", 0.4, 10, 500, ["x"])], SNAP)
    df = rows(spark, ("A", 1000, 1.0, 1.0, 50.0), ("A", 2000, 1.0, 1.0, 70.0))

    def model(prompts):
        return pd.Series(["no verdict" if "RSI 70" in p else '{"yhat": 0.01, "confidence": 0.5}' for p in prompts])

    made = strategies.sentiment_verdicts(df, Signals(sentiment=snaps, model=model)).collect()
    assert [r.ts for r in made] == [1000]
    assert strategies.sentiment_verdicts(df, Signals()) is None


def test_authored_verdicts_default_to_neutral(spark):
    snaps = spark.createDataFrame([(s, 0.4, 10, 0, ["x"]) for s in "AB"], SNAP)
    verdicts = spark.createDataFrame([("A", 0.0002, 0.45)], "symbol string, yhat double, confidence double")
    df = rows(spark, ("A", 1, 1.0, 1.0, None), ("B", 1, 1.0, 1.0, None))
    made = strategies.sentiment_verdicts(df, Signals(sentiment=snaps, verdicts=verdicts)).orderBy("symbol").collect()
    assert [(r.yhat, r.confidence) for r in made] == [(0.0002, 0.45), (0.0, 0.0)]


def test_blend(spark):
    made = spark.createDataFrame(
        [("A", 60, 0.10, 0.8, "x", 1, "v0", 100.0, 0), ("A", 60, -0.02, 0.2, "y", 1, "v0", 100.0, 0), ("B", 60, 0.1, 0.0, "x", 1, "v0", 1.0, 1)],
        strategies.FORECAST,
    )
    out = strategies.blend(made).collect()
    assert len(out) == 1 and out[0].yhat == pytest.approx(0.076) and out[0].confidence == pytest.approx(0.5)


def test_edge_rule(spark):
    row = spark.range(1).select(
        strategies.edge_return(F.lit(0.2)).alias("y"), strategies.edge_confidence(F.lit(0.2)).alias("c")
    ).first()
    assert row.y == pytest.approx(0.004) and row.c == pytest.approx(0.4)


def test_analysis_chain_clamps_and_strips_the_verdict(spark):
    ctx = spark.createDataFrame(
        [("A", "last 1.00", None, ""), ("B", "last 1.00", (0.5, 3, 1, ["x"]), "news")],
        "symbol string, price_summary string, sentiment struct<score:double,n:int,ts:bigint,sources:array<string>>, news string",
    )

    def model(prompts):
        return pd.Series(["## View\nUp. {note}\n\n" + '{"yhat": 0.9, "confidence": 1.8}' if "Weigh" in p else "fine" for p in prompts])

    out = deep.analyze(ctx, F.lit(7), model).orderBy("symbol").collect()
    assert [(r.symbol, r.stance, r.yhat, r.confidence, r.ts) for r in out] == [("A", "neutral", 0.1, 1.0, 7), ("B", "neutral", 0.1, 1.0, 7)]
    assert out[0].briefing_md == "## View\nUp. {note}"
    neutral = deep.analyze(ctx, F.lit(7)).first()
    assert (neutral.stance, neutral.yhat, neutral.briefing_md) == ("neutral", 0.0, "")
