"""As-of joins by time, built on the bucketed fill."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .timeline import HOUR_MS, Timeline, fill


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    *,
    direction: str = "backward",
    tie: str | None = None,
    take: dict[str, str],
    width: int = HOUR_MS,
) -> DataFrame:
    """For each left row, one right row of the same keys by time; nulls where none exists.

    ``backward`` takes the last right row at or before the left time, ``forward`` the first
    one at or after it. Among right rows with equal time, ``tie`` decides: the highest for
    backward, the lowest for forward. ``take`` maps right columns to output names.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"direction must be backward or forward, not {direction!r}")
    forward = direction == "forward"
    right_side, left_side = (1, 0) if forward else (0, 1)
    picked = F.struct(*[F.col(source).alias(name) for source, name in take.items()])
    kept = F.struct(*[F.col(c) for c in left.columns])
    tie_value = F.col(tie).cast("bigint") if tie else F.lit(0).cast("bigint")

    lhs = left.select(
        *keys,
        F.col(left_time).cast("bigint").alias("_t"),
        F.lit(left_side).alias("_side"),
        F.lit(0).cast("bigint").alias("_tie"),
        kept.alias("_left"),
    )
    rhs = right.select(
        *keys,
        F.col(right_time).cast("bigint").alias("_t"),
        F.lit(right_side).alias("_side"),
        tie_value.alias("_tie"),
        picked.alias("_right"),
    )
    both = lhs.unionByName(rhs, allowMissingColumns=True)
    line = Timeline(tuple(keys), ("_t", "_side", "_tie"), width)
    matched = fill(both, line, F.col("_right"), "_match", reverse=forward)
    return matched.filter(F.col("_side") == left_side).select(
        "_left.*", *[F.col(f"_match.{name}").alias(name) for name in take.values()]
    )
