"""Column rules for forecasts and their scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sign(x: Column) -> Column:
    return F.signum(x).cast("int")


def target_ts(ts: Column, horizon_s: Column) -> Column:
    """When a forecast falls due, in epoch milliseconds."""
    return ts + horizon_s.cast("bigint") * 1000


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def realized_return(ref_price: Column, realized_price: Column) -> Column:
    """Fractional move since the forecast; 0 when there was no reference price."""
    return F.when(ref_price == 0, 0.0).otherwise((realized_price - ref_price) / ref_price)


def accuracy() -> Column:
    """Share of hits, 0 when there are no rows."""
    return F.coalesce(F.avg(F.col("hit").cast("double")), F.lit(0.0))


def mae() -> Column:
    return F.coalesce(F.avg("abs_error"), F.lit(0.0))


def mean_confidence() -> Column:
    return F.coalesce(F.avg("confidence"), F.lit(0.0))


def calibration_gap() -> Column:
    """Positive when forecasts are over-confident."""
    return mean_confidence() - accuracy()


def stats() -> list[Column]:
    """The leaderboard aggregates, named as in the StrategyStat record."""
    return [
        F.count(F.lit(1)).alias("n"),
        accuracy().alias("dir_acc"),
        mae().alias("mae"),
        mean_confidence().alias("mean_confidence"),
        calibration_gap().alias("calibration_gap"),
    ]
