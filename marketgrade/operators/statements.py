"""Financial statements without look-ahead, and the fundamentals overview."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Overview labels and the fields they come from.
OVERVIEW = [
    ("Name", "longName"),
    ("Sector", "sector"),
    ("Industry", "industry"),
    ("Market Cap", "marketCap"),
    ("PE Ratio (TTM)", "trailingPE"),
    ("Forward PE", "forwardPE"),
    ("PEG Ratio", "pegRatio"),
    ("Price to Book", "priceToBook"),
    ("EPS (TTM)", "trailingEps"),
    ("Forward EPS", "forwardEps"),
    ("Dividend Yield", "dividendYield"),
    ("Beta", "beta"),
    ("52 Week High", "fiftyTwoWeekHigh"),
    ("52 Week Low", "fiftyTwoWeekLow"),
    ("50 Day Average", "fiftyDayAverage"),
    ("200 Day Average", "twoHundredDayAverage"),
    ("Revenue (TTM)", "totalRevenue"),
    ("Gross Profit", "grossProfits"),
    ("EBITDA", "ebitda"),
    ("Net Income", "netIncomeToCommon"),
    ("Profit Margin", "profitMargins"),
    ("Operating Margin", "operatingMargins"),
    ("Return on Equity", "returnOnEquity"),
    ("Return on Assets", "returnOnAssets"),
    ("Debt to Equity", "debtToEquity"),
    ("Current Ratio", "currentRatio"),
    ("Book Value", "bookValue"),
    ("Free Cash Flow", "freeCashflow"),
]


def reports_until(df: DataFrame, date: str, column: str = "reports") -> DataFrame:
    """Keep array entries whose ``fiscalDateEnding`` (yyyy-MM-dd) is on or before ``date``."""
    return df.withColumn(
        column,
        F.filter(column, lambda r: F.coalesce(r["fiscalDateEnding"], F.lit("")) <= date),
    )


def statement_long(wide: DataFrame, ids: list[str]) -> DataFrame:
    """A statement with one column per fiscal period to (ids, period, value) rows."""
    periods = [c for c in wide.columns if c not in ids]
    return wide.unpivot(ids, periods, "period", "value")


def periods_until(long: DataFrame, date: str) -> DataFrame:
    """Drop fiscal periods that end after ``date``; an unreadable period is dropped too."""
    return long.filter(F.try_to_date("period") <= F.lit(date).cast("date"))


def statement_wide(long: DataFrame, ids: list[str], periods: list[str]) -> DataFrame:
    """Back to one column per period, for display."""
    return long.groupBy(*ids).pivot("period", periods).agg(F.first("value"))


def overview(info: DataFrame) -> DataFrame:
    """Label and value rows of the fundamentals that are present, in a fixed order.

    A symbol without any value gives no row; ``vendors.no_data`` reports such symbols.
    """
    present = [(label, field) for label, field in OVERVIEW if field in info.columns]
    entries = F.array(
        *[
            F.struct(
                F.lit(place).alias("place"),
                F.lit(label).alias("label"),
                F.col(field).cast("string").alias("value"),
            )
            for place, (label, field) in enumerate(present)
        ]
    )
    return (
        info.select("symbol", F.explode(entries).alias("_e"))
        .select("symbol", "_e.*")
        .filter(F.col("value").isNotNull())
    )
