"""Scoring forecasts against the first price after their horizon."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import realized_return, sign, target_ts
from .asof import asof_join
from .timeline import HOUR_MS

# The columns of an outcome record.
OUTCOME_COLUMNS = (
    "symbol", "strategy_id", "horizon_s", "yhat", "realized_return", "hit", "abs_error",
    "confidence", "ref_price", "realized_price", "pred_ts", "scored_ts", "model_ver",
)


def match_prices(forecasts: DataFrame, prices: DataFrame, width: int = HOUR_MS) -> DataFrame:
    """Each forecast with the first same-symbol price at or after its due time, or nulls.

    ``prices`` has symbol, ts, trade_id and last_price.
    """
    due = forecasts.withColumn("target_ts", target_ts(F.col("ts"), F.col("horizon_s")))
    return asof_join(
        due,
        prices,
        ["symbol"],
        "target_ts",
        "ts",
        direction="forward",
        tie="trade_id",
        take={"last_price": "realized_price", "ts": "scored_ts", "trade_id": "scored_trade_id"},
        width=width,
    )


def pending(matched: DataFrame) -> DataFrame:
    """Forecasts not yet due."""
    return matched.filter(F.col("scored_ts").isNull()).drop(
        "realized_price", "scored_ts", "scored_trade_id"
    )


def score_rows(matched: DataFrame) -> DataFrame:
    """Matched forecasts to outcomes; keeps the trade ids that order them."""
    realized = realized_return(F.col("ref_price"), F.col("realized_price"))
    return (
        matched.filter(F.col("scored_ts").isNotNull())
        .withColumn("realized_return", realized)
        .select(
            "symbol",
            "strategy_id",
            "horizon_s",
            "yhat",
            "realized_return",
            (sign(F.col("yhat")) == sign(F.col("realized_return"))).alias("hit"),
            F.abs(F.col("yhat") - F.col("realized_return")).alias("abs_error"),
            "confidence",
            "ref_price",
            "realized_price",
            F.col("ts").alias("pred_ts"),
            "scored_ts",
            "model_ver",
            "scored_trade_id",
            F.col("trade_id").alias("pred_trade_id"),
        )
    )


def outcomes(forecasts: DataFrame, prices: DataFrame, width: int = HOUR_MS) -> DataFrame:
    return score_rows(match_prices(forecasts, prices, width))
