"""Standing views: context per symbol, a four-step briefing, the parsed view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import clamp
from ..functions.text import last_json_object, narrative, verdict_number
from ..session import cut
from .features import summary_text
from .strategies import DEEP_CAP, Model, ask, neutral_model

HORIZON_S = 3600


def context(
    symbols: DataFrame, latest: DataFrame, sentiment: DataFrame, news: DataFrame
) -> DataFrame:
    """What an analysis reads per symbol, with placeholders for what is missing.

    ``latest`` has one feature row per symbol, ``sentiment`` one snapshot, ``news`` one text.
    """
    prices = latest.select("symbol", summary_text().alias("price_summary"))
    crowd = sentiment.select("symbol", F.struct("score", "n", "ts", "sources").alias("sentiment"))
    return (
        symbols.select("symbol")
        .join(prices, "symbol", "left")
        .join(crowd, "symbol", "left")
        .join(news.select("symbol", "news"), "symbol", "left")
        .select(
            "symbol",
            F.coalesce("price_summary", F.lit("no recent market data")).alias("price_summary"),
            "sentiment",
            F.coalesce("news", F.lit("")).alias("news"),
        )
    )


def market_prompt() -> Column:
    return F.format_string(
        "Symbol %s. Recent features: %s. State momentum, trend and risk in two or three sentences.",
        F.col("symbol"),
        F.when(F.col("price_summary") != "", F.col("price_summary")).otherwise("n/a"),
    )


def sentiment_prompt() -> Column:
    snap = F.col("sentiment")
    named = F.when(F.size(snap["sources"]) > 0, F.concat_ws(", ", snap["sources"])).otherwise("none")
    return F.when(
        snap.isNull(), F.format_string("Symbol %s. There is no crowd sentiment.", "symbol")
    ).otherwise(
        F.format_string(
            "Symbol %s. Crowd score %+.2f from %d messages (%s). What does it imply for direction?",
            F.col("symbol"), snap["score"], snap["n"].cast("bigint"), named,
        )
    )


def news_prompt() -> Column:
    return F.format_string(
        "Symbol %s. Headlines:\n%s\nWhat do they imply for direction?",
        F.col("symbol"),
        F.when(F.col("news") != "", F.col("news")).otherwise("none"),
    )


def synthesis_prompt() -> Column:
    return F.format_string(
        "Symbol %s.\nMarket notes: %s\nSentiment notes: %s\nNews notes: %s\nWeigh them into a "
        "one-hour view: a short briefing, then a JSON object with stance, yhat and confidence.",
        F.col("symbol"), F.col("_market"), F.col("_crowd"), F.col("_news"),
    )


def analyze(contexts: DataFrame, ts: Column, model: Model = neutral_model, horizon_s: int = HORIZON_S) -> DataFrame:
    """Three readings and one synthesis per symbol to a view; a symbol whose calls fail is left out.

    The views are written out at once, so that later readers do not ask the model again.
    """
    notes = ask(contexts, market_prompt(), model, "_market")
    notes = ask(notes, sentiment_prompt(), model, "_crowd")
    notes = ask(notes, news_prompt(), model, "_news")
    notes = notes.dropna(subset=["_market", "_crowd", "_news"])
    return cut(views_from_briefings(ask(notes, synthesis_prompt(), model, "briefing"), ts, horizon_s))


def views_from_briefings(briefings: DataFrame, ts: Column, horizon_s: int = HORIZON_S) -> DataFrame:
    """Briefing texts that end in a JSON verdict to views; texts without one are left out."""
    text = last_json_object(F.col("briefing"))
    stance = F.from_json(text, "map<string,string>")["stance"]
    zero = F.lit(0.0)
    return briefings.filter(text.isNotNull()).select(
        "symbol",
        F.coalesce(stance, F.lit("neutral")).alias("stance"),
        clamp(F.coalesce(verdict_number(text, "yhat"), zero), -DEEP_CAP, DEEP_CAP).alias("yhat"),
        clamp(F.coalesce(verdict_number(text, "confidence"), zero), 0.0, 1.0).alias("confidence"),
        F.lit(horizon_s).alias("horizon_s"),
        ts.alias("ts"),
        narrative(F.col("briefing")).alias("briefing_md"),
        F.lit("deep-v0").alias("model_ver"),
    )
