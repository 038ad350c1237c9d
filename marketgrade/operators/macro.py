"""Macro series: missing values, change over the window, newest observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sentiment import newest

MAX_ROWS = 40


def observations(raw: DataFrame) -> DataFrame:
    """Drop missing observations (".", empty, null); keep the text beside its number."""
    kept = raw.filter(F.col("value").isNotNull() & ~F.col("value").isin(".", ""))
    return kept.withColumn("number", F.col("value").try_cast("double"))


def change(points: DataFrame) -> DataFrame:
    """Latest and first value per series with absolute and percent change over the window.

    Where one of the two is not a number, the change is null and the latest text remains.
    """
    ends = points.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.min_by("value", "date").alias("first_value"),
        F.max_by("value", "date").alias("last_value"),
        F.min_by(F.struct("number"), "date").alias("_first"),
        F.max_by(F.struct("number"), "date").alias("_last"),
    )
    delta = F.col("_last.number") - F.col("_first.number")
    return ends.withColumns(
        {
            "change": delta,
            "change_pct": F.try_divide(delta, F.col("_first.number")) * 100,
        }
    ).drop("_first", "_last")


def recent(points: DataFrame, limit: int = MAX_ROWS) -> DataFrame:
    """The newest observations of each series, shown oldest first."""
    return newest(points, ["series_id"], [F.col("date").desc()], limit).orderBy(
        "series_id", "date"
    )
