"""Daily bars: cleaning, cut-offs, technical indicators, calendar fill, verified snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .recurrence import Average, ema, span_alpha
from .sentiment import newest
from .timeline import BLOCK_ROWS, Timeline, blocks, fill_columns, number

PRICES = ("open", "high", "low", "close", "volume")
MAX_STALE_DAYS = 10
YEAR_DAYS = 365

# The text of a day without trading, supported indicators, and the ones a verified snapshot shows.
NOT_TRADING = "N/A: Not a trading day (weekend or holiday)"
INDICATORS = (
    "close_50_sma", "close_200_sma", "close_10_ema", "macd", "macds", "macdh", "rsi", "boll",
    "boll_ub", "boll_lb", "atr", "vwma", "mfi",
)
SNAPSHOT_INDICATORS = (
    "close_10_ema", "close_50_sma", "close_200_sma", "rsi", "boll", "boll_ub", "boll_lb", "macd",
    "macds", "macdh", "atr",
)
PERIOD = 14
BAND_PERIOD = 20
BAND_WIDTH = 2.0


def day_line(width: int = YEAR_DAYS) -> Timeline:
    return Timeline(("symbol",), ("day",), width)


def clean(raw: DataFrame, width: int = YEAR_DAYS) -> DataFrame:
    """Text bars to typed ones: bad dates and missing closes go, gaps fill forward then back.

    One row per symbol and date is expected. Only the rows before a column's first value are
    left for the backward fill, and they all take that first value.
    """
    typed = raw.select(
        "symbol",
        F.try_to_date(F.col("date").cast("string")).alias("date"),
        *[F.col(c).try_cast("double").alias(c) for c in PRICES],
    ).filter(F.col("date").isNotNull() & F.col("close").isNotNull())
    typed = typed.withColumn("day", F.unix_date("date").cast("bigint"))
    gaps = [c for c in PRICES if c != "close"]
    filled = fill_columns(typed, day_line(width), {f"_f_{c}": F.col(c) for c in gaps})
    firsts = typed.groupBy("symbol").agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("day"))).alias(f"_b_{c}") for c in gaps]
    )
    return filled.join(firsts, "symbol", "left").select(
        "symbol",
        "date",
        *[
            F.col(c) if c == "close" else F.coalesce(f"_f_{c}", f"_b_{c}").alias(c)
            for c in PRICES
        ],
    )


def until(bars: DataFrame, date: str) -> DataFrame:
    """Rows on or before the analysis date."""
    return bars.filter(F.col("date") <= F.lit(date).cast("date"))


def between(bars: DataFrame, start: str, end: str) -> DataFrame:
    """Rows inside a date range, both ends included."""
    return bars.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def rounded(bars: DataFrame, places: int = 2) -> DataFrame:
    """Prices to two places for display; volume is left alone."""
    return bars.withColumns({c: F.bround(c, places) for c in PRICES if c != "volume"})


def staleness(bars: DataFrame, date: str, max_days: int = MAX_STALE_DAYS) -> DataFrame:
    """Latest date per symbol, its age at ``date``, and whether it is too old to use."""
    latest = bars.groupBy("symbol").agg(F.max("date").alias("latest"))
    age = F.datediff(F.lit(date).cast("date"), F.col("latest"))
    return latest.withColumn("stale_days", age).withColumn("stale", F.col("stale_days") > max_days)


def fresh(bars: DataFrame, date: str, max_days: int = MAX_STALE_DAYS) -> DataFrame:
    """Bars of the symbols whose latest row is recent enough."""
    usable = staleness(bars, date, max_days).filter(~F.col("stale")).select("symbol")
    return bars.join(usable, "symbol", "left_semi")


def indicators(
    bars: DataFrame, width: int = YEAR_DAYS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Bars with all technical indicators as columns, computed once for every date.

    SMA and bands use the rows there are until their period is full. Exponential averages are
    seeded with the first value; RSI and ATR smooth with 1/14. A value that cannot be formed
    is null.
    """
    day = bars.withColumn("day", F.unix_date("date").cast("bigint"))
    numbered = number(day, day_line(width), "_i")
    cut = blocks(numbered, ["symbol"], "_i", before=200, rows=block_rows)
    last = lambda n: cut.window.rowsBetween(-(n - 1), 0)
    close, volume = F.col("close"), F.col("volume")
    before = F.lag("close").over(cut.window)
    typical = (F.col("high") + F.col("low") + close) / 3.0
    rows = cut.rows.withColumns({"_before": before, "_typical": typical})
    rows = rows.withColumn("_was", F.lag("_typical").over(cut.window))
    flow = F.col("_typical") * volume
    delta = close - F.col("_before")
    rows = rows.withColumns(
        {
            "_up_flow": F.when(F.col("_typical") > F.col("_was"), flow).otherwise(0.0),
            "_down_flow": F.when(F.col("_typical") < F.col("_was"), flow).otherwise(0.0),
            "_gain": F.when(delta.isNotNull(), F.greatest(delta, F.lit(0.0))),
            "_loss": F.when(delta.isNotNull(), F.greatest(-delta, F.lit(0.0))),
            "_range": F.greatest(
                F.col("high") - F.col("low"),
                F.abs(F.col("high") - F.col("_before")),
                F.abs(F.col("low") - F.col("_before")),
            ),
            "close_50_sma": F.avg("close").over(last(50)),
            "close_200_sma": F.avg("close").over(last(200)),
            "boll": F.avg("close").over(last(BAND_PERIOD)),
            "_band": F.stddev_samp("close").over(last(BAND_PERIOD)),
            "vwma": F.try_divide(
                F.sum(close * volume).over(last(PERIOD)), F.sum("volume").over(last(PERIOD))
            ),
        }
    )
    up, down = F.sum("_up_flow").over(last(PERIOD)), F.sum("_down_flow").over(last(PERIOD))
    rows = rows.withColumns(
        {
            "mfi": 100.0 * F.try_divide(up, up + down),
            "boll_ub": F.col("boll") + BAND_WIDTH * F.col("_band"),
            "boll_lb": F.col("boll") - BAND_WIDTH * F.col("_band"),
        }
    )
    rows = cut.finish(rows)
    wilder = 1.0 / PERIOD
    rows = ema(
        rows,
        ["symbol"],
        "_i",
        {
            "close_10_ema": Average("close", span_alpha(10)),
            "_ema_12": Average("close", span_alpha(12)),
            "_ema_26": Average("close", span_alpha(26)),
            "_avg_gain": Average("_gain", wilder, start=1),
            "_avg_loss": Average("_loss", wilder, start=1),
            "atr": Average("_range", wilder),
        },
    ).withColumn("macd", F.col("_ema_12") - F.col("_ema_26"))
    rows = ema(rows, ["symbol"], "_i", {"macds": Average("macd", span_alpha(9))})
    gain, loss = F.col("_avg_gain"), F.col("_avg_loss")
    rsi = F.when(loss == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + gain / loss))
    return rows.withColumns({"macdh": F.col("macd") - F.col("macds"), "rsi": rsi}).select(
        "symbol", "date", *PRICES, *INDICATORS
    )


def indicator_calendar(
    indicated: DataFrame, symbols: DataFrame, indicator: str, date: str, look_back: int
) -> DataFrame:
    """Every calendar day of the look-back with its indicator value or the no-trading text.

    ``value`` is text rounded to six places: "N/A" where a trading day has no value.
    """
    if indicator not in INDICATORS:
        raise ValueError(f"no indicator is named {indicator!r}; known: {', '.join(INDICATORS)}")
    end = F.lit(date).cast("date")
    days = symbols.select("symbol").distinct().select(
        "symbol", F.explode(F.sequence(F.date_sub(end, look_back), end)).alias("date")
    )
    window = between(
        indicated, str(_days_before(date, look_back)), date
    ).select("symbol", "date", F.col(indicator).alias("number"), F.lit(True).alias("_traded"))
    return days.join(window, ["symbol", "date"], "left").select(
        "symbol", "date", "number", value_text(F.col("number"), F.col("_traded")).alias("value")
    )


def value_text(number_: Column, traded: Column) -> Column:
    return F.when(traded.isNull(), NOT_TRADING).otherwise(
        F.coalesce(F.format_string("%.6f", number_), F.lit("N/A"))
    )


def _days_before(date: str, days: int):
    from datetime import date as day
    from datetime import timedelta

    return day.fromisoformat(date) - timedelta(days=days)


def indicator_on(indicated: DataFrame, symbols: DataFrame, indicator: str, date: str) -> DataFrame:
    """One indicator on one date for each symbol, or the no-trading text."""
    return indicator_calendar(indicated, symbols, indicator, date, 0)


def last_bars(bars: DataFrame, n: int) -> DataFrame:
    """The last ``n`` bars of each symbol, ``n`` held between 1 and 30."""
    return newest(bars, ["symbol"], [F.col("date").desc()], max(1, min(int(n), 30)))


def verified_snapshot(
    indicated: DataFrame,
    date: str,
    look_back: int = 30,
    names: Sequence[str] = SNAPSHOT_INDICATORS,
) -> DataFrame:
    """Ground truth per symbol as (section, field, value): latest bar, indicators, closes.

    Rows after the date are excluded before anything is read off.
    """
    usable = until(indicated, date)
    latest = usable.groupBy("symbol").agg(
        F.max_by(F.struct(*usable.columns), "date").alias("_row")
    )
    text = lambda c: F.coalesce(F.format_string("%.2f", c), F.lit("N/A"))
    fields = [("latest", "date", F.col("_row.date").cast("string"))]
    fields += [("latest", c, text(F.col(f"_row.{c}"))) for c in PRICES]
    fields += [("indicator", c, text(F.col(f"_row.{c}"))) for c in names]
    rows = F.array(
        *[
            F.struct(F.lit(s).alias("section"), F.lit(f).alias("field"), v.alias("value"))
            for s, f, v in fields
        ]
    )
    head = latest.select("symbol", F.explode(rows).alias("_f")).select("symbol", "_f.*")
    closes = last_bars(usable, look_back).select(
        "symbol",
        F.lit("close").alias("section"),
        F.col("date").cast("string").alias("field"),
        text(F.col("close")).alias("value"),
    )
    return head.unionByName(closes)
