"""Prediction markets: open future markets ranked by traded volume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import iso_timestamp, json_list
from .sentiment import newest

LIMIT = 6

EVENTS = (
    "array<struct<markets:array<struct<question:string,closed:boolean,endDate:string,"
    "outcomes:string,outcomePrices:string,volumeNum:double,oneWeekPriceChange:double>>>>"
)


def explode_markets(events: DataFrame, column: str = "events") -> DataFrame:
    """One row per market, with the other columns of its row and its place in the input."""
    others = [c for c in events.columns if c != column]
    return (
        events.select(*others, F.posexplode(column).alias("event_pos", "_event"))
        .select(*others, "event_pos", F.posexplode("_event.markets").alias("market_pos", "_market"))
        .select(*others, "event_pos", "market_pos", "_market.*")
    )


def is_forward_looking(now: Column) -> Column:
    """Open, not past its end date (an unreadable date passes), with prices and outcomes."""
    ends = iso_timestamp(F.col("endDate"))
    return (
        ~F.coalesce(F.col("closed"), F.lit(False))
        & (ends.isNull() | (ends >= now))
        & (F.size(json_list(F.col("outcomePrices"))) > 0)
        & (F.size(json_list(F.col("outcomes"))) > 0)
    )


def top_markets(
    markets: DataFrame, now: Column, limit: int = LIMIT, per: list[str] | None = None
) -> DataFrame:
    """The most traded open markets, and of those the ones with a readable probability.

    Rows with a bad probability are dropped after the limit, as they hold a place in it.
    """
    ranked = markets.filter(is_forward_looking(now)).withColumn(
        "volume", F.coalesce("volumeNum", F.lit(0.0))
    )
    order = [F.col("volume").desc(), F.col("event_pos").asc(), F.col("market_pos").asc()]
    kept = newest(ranked, per, order, limit) if per else ranked.orderBy(*order).limit(limit)
    probability = F.get(json_list(F.col("outcomePrices")), F.lit(0)).try_cast("double")
    week = F.col("oneWeekPriceChange")
    return (
        kept.withColumn("probability", probability)
        .filter(F.col("probability").isNotNull())
        .select(
            *(per or []),
            "question",
            F.get(json_list(F.col("outcomes")), F.lit(0)).alias("label"),
            "probability",
            "volume",
            F.substring(F.coalesce("endDate", F.lit("")), 1, 10).alias("resolves"),
            F.when(week != 0, week * 100).alias("week_points"),
        )
    )
