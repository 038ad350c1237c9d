"""Views of the benchmark tables in the shapes the operators take.

Nothing here is part of the engine; it lets every operator run over whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import utc_text


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def epoch_ms(ts: Column) -> Column:
    """Milliseconds of a timestamp without time zone, whatever the session's zone."""
    return F.timestamp_diff("MILLISECOND", F.expr("timestamp_ntz '1970-01-01'"), ts)


def events(spark: SparkSession, folder: str) -> DataFrame:
    return with_ms(table(spark, folder, "events"))


def with_ms(events: DataFrame) -> DataFrame:
    return events.withColumn("ms", epoch_ms(F.col("ts").cast("timestamp_ntz")))


def ticks(spark: SparkSession, folder: str, symbol: str = "event_type") -> DataFrame:
    """Events as trades: value is the price, ``k`` of the properties the volume."""
    return events(spark, folder).select(
        F.col(symbol).cast("string").alias("symbol"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("volume"),
        F.col("ms").alias("ts"),
        F.col("event_id").alias("trade_id"),
    )


def orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with a date and a price off the cent grid, so rounding never meets a tie."""
    return table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("symbol"),
        F.col("o_orderdate").cast("date").alias("date"),
        (F.col("o_totalprice") / 997.0).alias("price"),
        F.col("o_orderkey").alias("key"),
        "o_custkey",
        "o_totalprice",
    )


def bars(spark: SparkSession, folder: str) -> DataFrame:
    """One bar per order priority and day."""
    return (
        orders(spark, folder)
        .groupBy("symbol", "date")
        .agg(
            F.min_by("price", "key").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "key").alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        )
    )


def messages(spark: SparkSession, folder: str) -> DataFrame:
    return as_messages(table(spark, folder, "events"))


def as_messages(events: DataFrame) -> DataFrame:
    """Events as labelled messages of a user."""
    label = F.when(F.col("event_type") == "click", "Bullish").when(
        F.col("event_type") == "error", "Bearish"
    )
    return with_ms(events).select(
        F.col("user_id").cast("string").alias("symbol"),
        F.col("ms").alias("ts"),
        F.col("event_id").alias("message_id"),
        label.alias("label"),
        F.concat(F.lit(" "), "event_type", F.lit("\nnote "), F.repeat("props", 40)).alias("body"),
    )


def daily_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    """Label counts per event type and day, known at the end of that day.

    Users with an even id are bullish and those divisible by 3 bearish, so both labels occur
    for every event type.
    """
    day = F.floor(F.col("ms") / F.lit(86_400_000))
    return (
        events(spark, folder)
        .groupBy(F.col("event_type").alias("symbol"), ((day + 1) * 86_400_000).alias("ts"))
        .agg(
            F.count_if(F.col("user_id") % 2 == 0).alias("bullish"),
            F.count_if(F.col("user_id") % 3 == 0).alias("bearish"),
        )
    )


def views(spark: SparkSession, folder: str) -> DataFrame:
    """A standing view per event type and day, from the day's mean value."""
    day = F.floor(F.col("ms") / F.lit(86_400_000))
    lean = F.greatest(F.lit(-0.1), F.least(F.lit(0.1), (F.avg("value") - 50.0) / 100.0))
    return (
        events(spark, folder)
        .groupBy(F.col("event_type").alias("symbol"), ((day + 1) * 86_400_000).alias("ts"))
        .agg(
            lean.alias("yhat"),
            (F.count_if(F.col("user_id") % 2 == 0) / F.count(F.lit(1))).alias("confidence"),
        )
        .select(
            "symbol",
            F.when(F.col("yhat") > 0, "bullish").when(F.col("yhat") < 0, "bearish").otherwise("neutral").alias("stance"),
            "yhat",
            "confidence",
            F.lit(3600).alias("horizon_s"),
            "ts",
            F.lit("").alias("briefing_md"),
            F.lit("deep-v0").alias("model_ver"),
        )
    )


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """Ticks in arrival order with replays: every row once more, five ids later."""
    base = ticks(spark, folder).withColumn("arrival", F.col("trade_id") * 2)
    replay = base.withColumn("arrival", F.col("arrival") + 11)
    return base.unionByName(replay)


def macro(spark: SparkSession, folder: str) -> DataFrame:
    """Daily closes as text observations; "." on days with a single order."""
    value = F.when(F.col("volume") == 1, ".").otherwise(F.format_string("%.3f", "close"))
    return bars(spark, folder).select(
        F.col("symbol").alias("series_id"), F.col("date").cast("string").alias("date"),
        value.alias("value"),
    )


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as articles of a search: source is the query, half nested, half flat."""
    doc = table(spark, folder, "documents")
    title = F.substring_index(F.col("text"), "\n", 1)
    nested = F.col("doc_id") % 2 == 0
    seconds = F.lit(1_704_067_200) + (F.col("doc_id") % 40) * 86_400
    content = F.struct(
        title.alias("title"),
        F.lit("").alias("summary"),
        F.struct(F.col("lang").alias("displayName")).alias("provider"),
        F.struct(F.concat(F.lit("https://example.com/"), "doc_id").alias("url")).alias("canonicalUrl"),
        F.struct(F.lit("").alias("url")).alias("clickThroughUrl"),
        F.when(
            F.col("doc_id") % 7 != 0,
            utc_text(seconds, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        ).alias("pubDate"),
    )
    return doc.select(
        F.col("source").alias("query"),
        F.col("doc_id").alias("position"),
        F.struct(
            F.when(nested, content).alias("content"),
            F.when(~nested, title).alias("title"),
            F.lit(None).cast("string").alias("summary"),
            F.when(~nested, F.col("lang")).alias("publisher"),
            F.when(~nested, F.concat(F.lit("https://example.com/"), "doc_id")).alias("link"),
            F.when(~nested & (F.col("doc_id") % 7 != 0), seconds).alias("providerPublishTime"),
        ).alias("article"),
    )


def posts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as posts; every eleventh has no date."""
    seconds = F.lit(1_704_067_200) + (F.col("doc_id") * 7919) % 2_592_000
    return table(spark, folder, "documents").select(
        "source",
        F.col("doc_id").alias("post_id"),
        F.substring_index(F.col("text"), "\n", 1).alias("title"),
        F.col("text").alias("body"),
        F.when(F.col("doc_id") % 11 != 0, seconds).alias("published"),
    )


def market_events(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as prediction markets, one event with nested markets per brand and size."""
    key = F.col("p_partkey")
    price = F.format_string("0.%02d", (key % 97).cast("int"))
    bad = key % 13 == 0
    market = F.struct(
        F.col("p_name").alias("question"),
        (key % 5 == 0).alias("closed"),
        F.when(key % 9 != 0, F.concat(F.lit("20"), F.lpad((key % 40 + 10).cast("string"), 2, "0"), F.lit("-06-30T00:00:00Z"))).alias("endDate"),
        F.when(key % 17 != 0, F.lit('["Yes", "No"]')).otherwise("junk").alias("outcomes"),
        F.when(bad, F.lit('["n/a"]')).otherwise(F.concat(F.lit('["'), price, F.lit('", "0.5"]'))).alias("outcomePrices"),
        F.when(key % 19 != 0, F.col("p_retailprice") * 3).alias("volumeNum"),
        ((key % 7) / 100.0).alias("oneWeekPriceChange"),
    )
    return (
        table(spark, folder, "part")
        .groupBy("p_brand", "p_size")
        .agg(F.sort_array(F.collect_list(F.struct(key.alias("k"), market.alias("m")))).alias("_m"))
        .groupBy("p_brand")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct("p_size", F.transform("_m", lambda x: x["m"]).alias("markets"))
                )
            ).alias("_e")
        )
        .select(
            F.col("p_brand").alias("topic"),
            F.transform("_e", lambda e: F.struct(e["markets"].alias("markets"))).alias("events"),
        )
    )


def quarterly_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Order totals per customer and quarter as an array of fiscal reports."""
    ends = F.date_sub(F.add_months(F.trunc("date", "quarter"), 3), 1)
    return (
        orders(spark, folder)
        .groupBy(F.col("o_custkey").alias("symbol"), ends.cast("string").alias("fiscalDateEnding"))
        .agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
        .groupBy("symbol")
        .agg(F.sort_array(F.collect_list(F.struct("fiscalDateEnding", "total"))).alias("reports"))
    )
