"""Reductions a live view keeps: latest forecast, price history, newest alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sentiment import newest
from .timeline import HOUR_MS, Timeline, previous

HISTORY = 60
ALERTS = 5


def latest_forecasts(forecasts: DataFrame) -> DataFrame:
    """The last forecast of each symbol and strategy."""
    row = F.struct(*forecasts.columns)
    return (
        forecasts.groupBy("symbol", "strategy_id")
        .agg(F.max_by(row, F.struct("ts", "trade_id")).alias("_row"))
        .select("_row.*")
    )


def price_history(forecasts: DataFrame, limit: int = HISTORY, width: int = HOUR_MS) -> DataFrame:
    """The last ``limit`` price changes per symbol; repeated and non-positive prices are left out.

    A forecast without a price leaves the shown price as it is, so changes are found among the
    forecasts that have one (a zero price counts as none; a negative one is shown but not kept).
    """
    priced = forecasts.filter(F.col("ref_price") != 0)
    line = Timeline(("symbol",), ("ts", "trade_id"), width)
    seen = previous(priced, line, F.col("ref_price"), "_before")
    changed = F.col("_before").isNull() | (F.col("_before") != F.col("ref_price"))
    moves = seen.filter(changed & (F.col("ref_price") > 0)).drop("_before")
    return newest(moves, ["symbol"], [F.col("ts").desc(), F.col("trade_id").desc()], limit)


def newest_alerts(alerts: DataFrame, limit: int = ALERTS) -> DataFrame:
    """The newest alerts first; only the top rows of each task are kept."""
    return alerts.orderBy(F.col("ts").desc(), F.col("seq").desc(), F.col("strategy_id")).limit(limit)
