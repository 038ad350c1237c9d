"""Bar files and Atom feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import html_to_text, iso_epoch

BAR_FILE = (
    "Date string, Open string, High string, Low string, Close string, Volume string"
)


def read_bar_files(spark: SparkSession, path: str) -> DataFrame:
    """CSV bars as text columns, malformed lines skipped; symbol is taken from ``symbol=``.

    Files without rows or without a Close give nothing, so their symbols count as missing.
    """
    raw = (
        spark.read.schema(BAR_FILE + ", symbol string")
        .option("header", True)
        .option("mode", "DROPMALFORMED")
        .csv(path)
    )
    return raw.select(
        "symbol",
        F.col("Date").alias("date"),
        *[F.col(c).alias(c.lower()) for c in ("Open", "High", "Low", "Close", "Volume")],
    ).filter(F.col("close").isNotNull())


ATOM_ENTRY = "title string, published string, content struct<_VALUE:string,_type:string>"


def read_atom(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Atom files to posts; the built-in XML source turns each entry into a row."""
    entries = (
        spark.read.format("xml")
        .option("rowTag", "entry")
        .option("ignoreNamespace", True)
        .option("attributePrefix", "_")
        .option("valueTag", "_VALUE")
        .schema(ATOM_ENTRY)
        .load(path)
    )
    return entries.select(
        F.lit(source).alias("source"),
        F.coalesce("title", F.lit("")).alias("title"),
        html_to_text(F.col("content._VALUE")).alias("body"),
        iso_epoch(F.col("published")).alias("published"),
    )


ATOM_TEXT = "title string, published string, content string"


def atom_entries(df: DataFrame, column: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """A column of Atom entry texts to post columns."""
    entry = F.from_xml(F.col(column), ATOM_TEXT)
    return df.select(*keep, entry.alias("_e")).select(
        *keep,
        F.coalesce("_e.title", F.lit("")).alias("title"),
        html_to_text(F.col("_e.content")).alias("body"),
        iso_epoch(F.col("_e.published")).alias("published"),
    )
