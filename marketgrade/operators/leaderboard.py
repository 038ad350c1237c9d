"""Standings, rolling accuracy, degradation alerts and snapshots.

There are few strategies and each holds a large share of all outcomes, so a strategy is cut
into numbered blocks and every block carries copies of the rows its frames look back to.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import accuracy, mae, stats
from .timeline import BLOCK_ROWS, HOUR_MS, Timeline, blocks, fill, number

WINDOW = 200
MIN_SAMPLES = 10
DEGRADE_FLOOR = 0.45
SNAPSHOT_EVERY = 20

SCORING_ORDER = ("scored_ts", "scored_trade_id", "pred_ts", "pred_trade_id", "symbol")


def standings_order() -> list:
    """Best accuracy first, more samples first among equals."""
    return [F.col("dir_acc").desc(), F.col("n").desc(), F.col("strategy_id").asc()]


def backtest(outcomes: DataFrame) -> DataFrame:
    """Accuracy and error per strategy over the whole outcome history."""
    return (
        outcomes.groupBy("strategy_id")
        .agg(F.count(F.lit(1)).alias("n"), accuracy().alias("dir_acc"), mae().alias("mae"))
        .orderBy(*standings_order())
    )


def standings(outcomes: DataFrame, window: int = WINDOW) -> DataFrame:
    """Current standings over the last ``window`` outcomes of each strategy.

    The row limit is applied before the shuffle, so each task sends at most ``window`` rows
    per strategy.
    """
    newest = Window.partitionBy("strategy_id").orderBy(*[F.col(c).desc() for c in SCORING_ORDER])
    return (
        outcomes.withColumn("_rn", F.row_number().over(newest))
        .filter(F.col("_rn") <= window)
        .groupBy("strategy_id")
        .agg(*stats())
        .withColumn("symbol", F.lit("*"))
        .orderBy(*standings_order())
    )


def ranked(standing: DataFrame) -> DataFrame:
    """Rank and leader flag; a standing has one row per strategy."""
    place = F.row_number().over(Window.orderBy(*standings_order()))
    return standing.withColumn("rank", place).withColumn("leader", F.col("rank") == 1)


def _rolled(outcomes: DataFrame, window: int, line: Timeline, block_rows: int):
    numbered = number(outcomes, line, "seq")
    part = blocks(numbered, ["strategy_id"], "seq", before=window, rows=block_rows)
    frame = part.window.rowsBetween(-(window - 1), 0)
    hit = F.col("hit").cast("double")
    rows = part.rows.withColumns(
        {
            "n": F.count(F.lit(1)).over(frame),
            "dir_acc": F.avg(hit).over(frame),
            "mae": F.avg("abs_error").over(frame),
            "mean_confidence": F.avg("confidence").over(frame),
        }
    )
    return part, rows


def rolling(
    outcomes: DataFrame, window: int = WINDOW, width: int = HOUR_MS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Each outcome with its strategy's statistics over the last ``window`` outcomes."""
    line = Timeline(("strategy_id",), SCORING_ORDER, width)
    return _rolling(outcomes, window, line, block_rows)


def _rolling(outcomes: DataFrame, window: int, line: Timeline, block_rows: int) -> DataFrame:
    part, rows = _rolled(outcomes, window, line, block_rows)
    return part.finish(rows).withColumn("calibration_gap", F.col("mean_confidence") - F.col("dir_acc"))


def alerts(
    outcomes: DataFrame,
    window: int = WINDOW,
    min_samples: int = MIN_SAMPLES,
    floor: float = DEGRADE_FLOOR,
    width: int = HOUR_MS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One alert each time a strategy with enough samples falls below the accuracy floor.

    ``seq + 1`` outcomes have been seen, so a strategy becomes eligible once and stays so;
    an alert is an eligible row below the floor whose predecessor was not one.
    """
    line = Timeline(("strategy_id",), SCORING_ORDER, width)
    part, rows = _rolled(outcomes, window, line, block_rows)
    enough = F.least(F.col("seq") + 1, F.lit(window)) >= min_samples
    below = enough & (F.col("dir_acc") < floor)
    rows = rows.withColumn("_below", below).withColumn(
        "_was_below", F.coalesce(F.lag("_below").over(part.window), F.lit(False))
    )
    message = F.format_string(
        "%s directional accuracy %.0f%% over last %d (< %.0f%%)",
        F.col("strategy_id"),
        F.bround(F.col("dir_acc") * 100, 0),
        F.col("n"),
        F.lit(float(floor * 100)),
    )
    fired = part.finish(rows.filter(F.col("_below") & ~F.col("_was_below")))
    return fired.select(
        F.lit("*").alias("symbol"),
        F.lit("accuracy_degradation").alias("kind"),
        F.lit("warning").alias("severity"),
        message.alias("message"),
        F.col("scored_ts").alias("ts"),
        "strategy_id",
        "seq",
    )


def snapshots(
    outcomes: DataFrame,
    strategies: Sequence[str],
    every: int = SNAPSHOT_EVERY,
    window: int = WINDOW,
    width: int = HOUR_MS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Full standings after every ``every``-th outcome, one row per snapshot and strategy.

    A strategy shows its latest rolling statistics at that point, and only once it has any.
    Only the columns that are needed are shuffled, and those of the order only until the rows
    are numbered: the number orders a strategy's rows as well.
    """
    needed = ("hit", "abs_error", "confidence")
    outcomes = outcomes.select("strategy_id", *needed, *SCORING_ORDER)
    position = F.array_position(F.array(*[F.lit(s) for s in strategies]), F.col("strategy_id"))
    everything = Timeline((), (*SCORING_ORDER, "_position"), width)
    numbered = number(outcomes.withColumn("_position", position), everything, "at")
    numbered = numbered.select("strategy_id", "at", "scored_ts", *needed)
    rolled = _rolling(numbered, window, Timeline(("strategy_id",), ("at",), block_rows), block_rows)
    measured = rolled.select(
        "strategy_id",
        "at",
        F.lit(0).alias("_side"),
        F.struct("n", "dir_acc", "mae", "mean_confidence", "calibration_gap").alias("_stat"),
    )
    due = numbered.filter(F.pmod(F.col("at") + 1, F.lit(every)) == 0).select(
        F.explode(F.array(*[F.lit(s) for s in strategies])).alias("strategy_id"),
        "at",
        F.lit(1).alias("_side"),
        F.col("scored_ts").alias("snapshot_ts"),
    )
    line = Timeline(("strategy_id",), ("at", "_side"), block_rows)
    both = measured.unionByName(due, allowMissingColumns=True)
    return (
        fill(both, line, F.col("_stat"), "_last")
        .filter((F.col("_side") == 1) & F.col("_last").isNotNull())
        .select((F.col("at") + 1).alias("seen"), "snapshot_ts", "strategy_id", "_last.*")
    )
