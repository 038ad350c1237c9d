"""Articles: field extraction, title de-duplication, look-ahead-safe windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import iso_epoch
from .sentiment import newest

ARTICLE = (
    "content struct<title:string,summary:string,provider:struct<displayName:string>,"
    "canonicalUrl:struct<url:string>,clickThroughUrl:struct<url:string>,pubDate:string>, "
    "title string, summary string, publisher string, link string, providerPublishTime bigint"
)


def article_fields(article: str) -> list[Column]:
    """Title, summary, publisher, link and epoch-second date from either article shape.

    A nested article is read from ``content`` only; a flat one from the top level.
    """
    c = lambda path: F.col(f"{article}.{path}")
    nested = c("content").isNotNull()

    def either(inside: Column, flat: Column, default: str) -> Column:
        return F.coalesce(F.when(nested, inside).otherwise(flat), F.lit(default))

    url = F.coalesce(c("content.canonicalUrl"), c("content.clickThroughUrl"))["url"]
    dated = iso_epoch(c("content.pubDate")).cast("bigint")
    flat_time = F.when(c("providerPublishTime") != 0, c("providerPublishTime"))
    return [
        either(c("content.title"), c("title"), "No title").alias("title"),
        either(c("content.summary"), c("summary"), "").alias("summary"),
        either(c("content.provider.displayName"), c("publisher"), "Unknown").alias("publisher"),
        either(url, c("link"), "").alias("link"),
        F.when(nested, dated).otherwise(flat_time).alias("published"),
    ]


def title_key(article: str) -> Column:
    """The title articles are compared by; a flat article without one has a blank key."""
    nested = F.col(f"{article}.content").isNotNull()
    inside = F.coalesce(F.col(f"{article}.content.title"), F.lit("No title"))
    return F.when(nested, inside).otherwise(F.coalesce(F.col(f"{article}.title"), F.lit("")))


def first_by_title(articles: DataFrame, key: str = "title_key") -> DataFrame:
    """First article of each title key by (query, position); blank keys are dropped.

    The minimum is found by partial aggregation, so a title repeated over a large share of
    the rows reaches the shuffle once per task.
    """
    row = F.struct(*articles.columns)
    kept = articles.filter(F.coalesce(F.col(key), F.lit("")) != "")
    return (
        kept.groupBy(F.col(key).alias("_title"))
        .agg(F.min_by(row, F.struct("query", "position")).alias("_row"))
        .select("_row.*")
    )


def first_articles(articles: DataFrame, limit: int, per: list[str] | None = None) -> DataFrame:
    """The first ``limit`` articles in (query, position) order, before any window filter."""
    order = [F.col("query").asc(), F.col("position").asc()]
    if per:
        return newest(articles, per, order, limit)
    return articles.orderBy(*order).limit(limit)


def in_window(published: Column, start: Column, end: Column, now: Column) -> Column:
    """Whether an article belongs to [start, end plus one day], all in epoch seconds.

    An undated article counts only when the window reaches the last day before ``now``.
    """
    day = F.lit(86_400)
    return F.when(
        published.isNotNull(), (published >= start) & (published <= end + day)
    ).otherwise(end >= now - day)
