"""Dropping replayed trades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .timeline import Timeline, running_max


def ascending_only(
    trades: DataFrame,
    *,
    arrival: str = "arrival",
    trade_id: str = "trade_id",
    floor: int = -1,
    width: int = 1_000_000,
) -> DataFrame:
    """Keep a trade only if its id exceeds every earlier id of its symbol in arrival order.

    ``floor`` is the id taken as already seen: -1 for a pushed stream, 0 for a polled one.
    """
    line = Timeline(("symbol",), (arrival, trade_id), width)
    seen = running_max(trades, line, F.col(trade_id), "_seen")
    return seen.filter(
        F.col(trade_id) > F.greatest(F.coalesce("_seen", F.lit(floor)), F.lit(floor))
    ).drop("_seen")
