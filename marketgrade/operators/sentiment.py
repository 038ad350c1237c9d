"""Crowd sentiment from labelled messages and posts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import excerpt, labelled_count, utc_text

MESSAGE_LIMIT = 30
MESSAGE_CHARS = 280
POST_LIMIT = 5
POST_CHARS = 240


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows per key; the limit is applied in each task before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", place).filter(F.col("_rn") <= limit).drop("_rn")


def score(bull: Column, bear: Column) -> Column:
    """Net share of bullish labels in [-1, 1] to four places, 0 without labels."""
    return F.coalesce(F.bround(F.try_divide(bull - bear, bull + bear), 4), F.lit(0.0))


def message_counts(messages: DataFrame, limit: int = MESSAGE_LIMIT) -> DataFrame:
    """Label counts and whole percentages over the newest messages of each symbol.

    ``messages`` has symbol, ts, message_id and label (Bullish, Bearish or anything else).
    """
    kept = newest(messages, ["symbol"], [F.col("ts").desc(), F.col("message_id").desc()], limit)
    label = F.col("label")
    counts = kept.groupBy("symbol").agg(
        F.count_if(F.coalesce(label == "Bullish", F.lit(False))).alias("bullish"),
        F.count_if(F.coalesce(label == "Bearish", F.lit(False))).alias("bearish"),
        F.count(F.lit(1)).alias("total"),
        F.max("ts").alias("last_ts"),
    )
    return with_shares(counts)


def with_shares(counts: DataFrame) -> DataFrame:
    """Label counts with the unlabelled rest and whole percentages."""
    percent = lambda c: F.bround(100 * F.col(c) / F.col("total"), 0).cast("int")
    return counts.withColumns(
        {
            "unlabeled": F.col("total") - F.col("bullish") - F.col("bearish"),
            "bull_pct": percent("bullish"),
            "bear_pct": percent("bearish"),
        }
    )


def message_summary() -> Column:
    """The one-line summary of ``message_counts`` columns."""
    return F.format_string(
        "Bullish: %d (%d%%) · Bearish: %d (%d%%) · Unlabeled: %d · Total: %d most-recent messages",
        "bullish", "bull_pct", "bearish", "bear_pct", "unlabeled", "total",
    )


def message_lines(messages: DataFrame, limit: int = MESSAGE_LIMIT) -> DataFrame:
    """The newest messages of each symbol as single lines."""
    kept = newest(messages, ["symbol"], [F.col("ts").desc(), F.col("message_id").desc()], limit)
    tag = F.when(F.col("label").isin("Bullish", "Bearish"), F.col("label")).otherwise("no-label")
    return kept.select(
        "symbol", "message_id", "ts", tag.alias("tag"),
        excerpt(F.col("body"), MESSAGE_CHARS).alias("line"),
    )


def snapshot(summary: Column | None, posts: Column | None, ts: Column) -> list[Column]:
    """Snapshot columns from a message summary line and a block of posts.

    Any non-empty text counts as a source, a placeholder from an unreachable one included.
    """
    summary = F.lit(None).cast("string") if summary is None else summary
    posts = F.lit(None).cast("string") if posts is None else posts
    bull, bear = (
        labelled_count(F.coalesce(summary, F.lit("")), name) for name in ("Bullish", "Bearish")
    )
    named = [
        F.when(F.coalesce(text, F.lit("")) != "", F.lit(name))
        for name, text in (("stocktwits", summary), ("reddit", posts))
    ]
    return [
        score(bull, bear).alias("score"),
        (bull + bear).cast("int").alias("n"),
        ts.alias("ts"),
        F.array_compact(F.array(*named)).alias("sources"),
    ]


def snapshots(counts: DataFrame, ts: Column) -> DataFrame:
    """Sentiment snapshots straight from label counts (symbol, bullish, bearish)."""
    return counts.select(
        "symbol",
        score(F.col("bullish"), F.col("bearish")).alias("score"),
        (F.col("bullish") + F.col("bearish")).cast("int").alias("n"),
        ts.alias("ts"),
        F.array(F.lit("stocktwits")).alias("sources"),
    )


def source_report(posts: DataFrame, sources: DataFrame, limit: int = POST_LIMIT) -> DataFrame:
    """Newest posts per source with their count; a source without posts keeps a row of 0.

    ``posts`` has source, post_id, title, body and published (epoch seconds, may be null).
    """
    kept = newest(
        posts, ["source"], [F.col("published").desc_nulls_last(), F.col("post_id").asc()], limit
    )
    date = F.coalesce(utc_text(F.col("published"), "yyyy-MM-dd"), F.lit("?"))
    body = excerpt(F.col("body"), POST_CHARS)
    line = F.concat(
        F.lit("["), date, F.lit("] "),
        F.trim(F.replace(F.coalesce("title", F.lit("")), F.lit("\n"), F.lit(" "))),
        F.when(body != "", F.concat(F.lit(" | "), body)).otherwise(""),
    )
    order = F.coalesce(-F.col("published"), F.lit(0))
    blocks = kept.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"),
        F.sort_array(F.collect_list(F.struct(order.alias("o"), "post_id", line.alias("line")))).alias(
            "_lines"
        ),
    )
    return sources.join(blocks, "source", "left").select(
        "source",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.when(F.col("n").isNull(), F.lit("<no posts found>"))
        .otherwise(F.array_join(F.transform("_lines", lambda x: x["line"]), "\n"))
        .alias("block"),
    )
