"""Exponential averages as block scans.

``y[t] = alpha * x[t] + (1 - alpha) * y[t-1]`` is a weighted running sum. Inside a block of
consecutive rows the weights ``(1 - alpha) ** -position`` stay within double range, and a
block long enough forgets everything but the last value of the block before it. So a block
needs one number from its predecessor and all blocks run in parallel.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# exp(600) is far below the largest double; exp(-42) is below double precision.
LARGEST_EXPONENT = 600.0
FORGOTTEN_EXPONENT = 42.0


def span_alpha(periods: int) -> float:
    return 2.0 / (periods + 1)


def block_length(alpha: float) -> int:
    """Longest block whose weights stay in range for this smoothing factor."""
    return max(int(LARGEST_EXPONENT / -math.log1p(-alpha)), 1)


def shared_length(alphas: Sequence[float]) -> int | None:
    """One block length that serves all factors, or None when they are too far apart."""
    length = min(block_length(a) for a in alphas)
    slowest = min(-math.log1p(-a) for a in alphas)
    return length if length * slowest >= FORGOTTEN_EXPONENT else None


def decay(alpha: float, steps: Column) -> Column:
    """``(1 - alpha) ** steps``"""
    return F.pow(F.lit(1.0 - alpha), steps.cast("double"))


@dataclass(frozen=True)
class Average:
    """An exponential average of ``column``, seeded with its value at row ``start``."""

    column: str
    alpha: float
    start: int = 0


def ema(
    df: DataFrame, keys: Sequence[str], index: str, averages: Mapping[str, Average]
) -> DataFrame:
    """Add exponential averages over rows numbered from 0 by ``index`` within each key.

    Averages whose factors allow a common block length are computed in one pass.
    """
    moving = {out: a for out, a in averages.items() if a.alpha < 1.0}
    for out in averages.keys() - moving.keys():
        df = df.withColumn(out, F.col(averages[out].column))
    if not moving:
        return df
    size = shared_length([a.alpha for a in moving.values()])
    if size:
        return _pass(df, list(keys), index, moving, size)
    for out, average in moving.items():
        df = _pass(df, list(keys), index, {out: average}, block_length(average.alpha))
    return df


def _pass(
    df: DataFrame, keys: list[str], index: str, averages: Mapping[str, Average], size: int
) -> DataFrame:
    at, place = F.col(index), F.col("_place")
    rows = df.withColumns({"_block": F.floor(at / F.lit(size)), "_place": F.pmod(at, F.lit(size))})
    inside = Window.partitionBy(*keys, "_block").orderBy(index)

    def local(a: Average) -> Column:
        weight = F.when(at == a.start, 1.0).otherwise(a.alpha)
        term = F.when(at >= a.start, weight * F.col(a.column) / decay(a.alpha, place))
        return decay(a.alpha, place) * F.sum(term).over(inside)

    rows = rows.withColumns({f"_loc_{out}": local(a) for out, a in averages.items()})
    ends = rows.groupBy(*keys, "_block").agg(
        *[F.max_by(f"_loc_{out}", index).alias(f"_end_{out}") for out in averages]
    )
    carry = ends.withColumn("_block", F.col("_block") + 1)

    def value(out: str, a: Average) -> Column:
        carried = F.coalesce(f"_end_{out}", F.lit(0.0))
        return F.when(at == a.start, F.col(a.column)).otherwise(
            F.col(f"_loc_{out}") + decay(a.alpha, place + 1) * carried
        )

    return (
        rows.join(carry, [*keys, "_block"], "left")
        .withColumns({out: value(out, a) for out, a in averages.items()})
        .drop("_block", "_place", *[f"_{k}_{out}" for out in averages for k in ("loc", "end")])
    )
