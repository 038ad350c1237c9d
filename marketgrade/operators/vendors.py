"""Ordered vendor fallback per symbol."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_vendor(requested: DataFrame, vendors: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Rows of the first vendor, in the given order, that has any for each requested symbol.

    The winning vendor is a small per-symbol aggregate; rows are then kept by an equi join.
    """
    merged = None
    for priority, (name, rows) in enumerate(vendors):
        tagged = rows.withColumns({"vendor": F.lit(name), "_priority": F.lit(priority)})
        merged = tagged if merged is None else merged.unionByName(tagged, allowMissingColumns=True)
    if merged is None:
        raise ValueError("at least one vendor is needed")
    winners = merged.groupBy("symbol").agg(F.min("_priority").alias("_priority"))
    wanted = requested.select("symbol").distinct().join(winners, "symbol", "inner")
    return merged.join(wanted, ["symbol", "_priority"], "inner").drop("_priority")


def no_data(requested: DataFrame, served: DataFrame, detail: str = "no rows") -> DataFrame:
    """One row per requested symbol that no vendor could serve."""
    missing = requested.select("symbol").distinct().join(
        served.select("symbol").distinct(), "symbol", "left_anti"
    )
    return missing.select(
        "symbol",
        F.format_string("NO_DATA_AVAILABLE: %s (%s)", "symbol", F.lit(detail)).alias("message"),
    )
