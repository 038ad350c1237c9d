"""Ordered per-key operators that never put a whole key into one task.

A key (a symbol, a strategy) may hold a third of all rows, so no window here is partitioned
by the key alone. Rows are shuffled once, by (key, time bucket). A bucket is summarised to one
row, the summaries of a key (at most time span / width of them) are combined in bucket order,
and the result is joined back to the rows of the next bucket as its carry. Summaries and rows
read the same exchange, so the input is read once, however long a chain of operators is.

Pick ``width`` so that the busiest key keeps a few million rows per bucket. Results do not
depend on it. Select the columns you need before an operator: all columns are shuffled. Rows
with a null key form a key of their own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS
BLOCK_ROWS = 50_000

BUCKET = "_bucket"
SLOT = "_slot"


@dataclass(frozen=True)
class Timeline:
    """Keys, the total order inside a key (time first, as a whole number), bucket width."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    width: int = HOUR_MS

    def bucket(self) -> Column:
        time = F.col(self.order[0])
        return F.floor((time - F.pmod(time, F.lit(self.width))) / F.lit(self.width))

    def rank(self) -> Column:
        return F.struct(*self.order)

    def window(self, reverse: bool = False) -> WindowSpec:
        order = [F.col(c).desc() if reverse else F.col(c).asc() for c in self.order]
        return Window.partitionBy(*self.keys, BUCKET).orderBy(*order)

    def inside(self, reverse: bool = False) -> WindowSpec:
        """Order of the rows of one slot."""
        order = [F.col(c).desc() if reverse else F.col(c).asc() for c in self.order]
        return Window.partitionBy(SLOT).orderBy(*order)

    def across(self, reverse: bool = False) -> WindowSpec:
        """Order of the slot summaries of one key, up to but without the current one."""
        bucket = F.col(SLOT)[BUCKET]
        return (
            Window.partitionBy(*[F.col(SLOT)[k] for k in self.keys])
            .orderBy(bucket.desc() if reverse else bucket.asc())
            .rowsBetween(Window.unboundedPreceding, -1)
        )


def once(df: DataFrame, *by: str) -> DataFrame:
    """Rows shuffled by the columns ``by``, in an exchange that all users of the result share.

    ``inline`` rebuilds each row from one struct. Spark drops no column and moves no filter
    below it, so every branch needs the same exchange and Spark reuses it.
    """
    rest = F.struct(*[c for c in df.columns if c not in by])
    return df.repartition(*by).select(*by, F.inline(F.array(rest)))


def _slotted(df: DataFrame, line: Timeline, extra: dict[str, Column]) -> DataFrame:
    """Rows with ``extra`` columns, shuffled once by their slot: the key and the time bucket.

    The slot is a struct, which is never null, so a join on it adds no filter to one branch.
    """
    slot = F.struct(*line.keys, line.bucket().alias(BUCKET))
    return once(df.withColumns({SLOT: slot, **extra}), SLOT)


def fill(
    df: DataFrame,
    line: Timeline,
    value: Column,
    out: str,
    *,
    reverse: bool = False,
) -> DataFrame:
    """Add ``out``: the last non-null ``value`` at or before each row (after, if ``reverse``)."""
    return fill_columns(df, line, {out: value}, reverse=reverse)


def fill_columns(
    df: DataFrame, line: Timeline, values: dict[str, Column], *, reverse: bool = False
) -> DataFrame:
    """``fill`` for several values that share one order, in one shuffle of the rows."""
    names = list(values)
    raw, here, carried = ([f"_{kind}_{n}" for n in names] for kind in ("v", "here", "carry"))
    rows = _slotted(df, line, dict(zip(raw, values.values(), strict=True)))
    pick = F.min_by if reverse else F.max_by
    edges = rows.groupBy(SLOT).agg(
        *[pick(v, F.when(F.col(v).isNotNull(), line.rank())).alias(v) for v in raw]
    )
    carry = edges.select(
        SLOT,
        *[
            F.last(v, ignorenulls=True).over(line.across(reverse)).alias(c)
            for v, c in zip(raw, carried, strict=True)
        ],
    )
    frame = line.inside(reverse).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumns(
            {
                h: F.last(v, ignorenulls=True).over(frame)
                for h, v in zip(here, raw, strict=True)
            }
        )
        .join(carry, SLOT, "left")
        .withColumns(
            {n: F.coalesce(h, c) for n, h, c in zip(names, here, carried, strict=True)}
        )
        .drop(*raw, *here, *carried, SLOT)
    )


def previous(df: DataFrame, line: Timeline, value: Column, out: str) -> DataFrame:
    """Add ``out``: ``value`` of the row just before, null on the first row of a key."""
    rows = _slotted(df, line, {"_v": F.struct(value.alias("v"))})
    edges = rows.groupBy(SLOT).agg(F.max_by("_v", line.rank()).alias("_edge"))
    carry = edges.select(SLOT, F.last("_edge").over(line.across()).alias("_carry"))
    return (
        rows.withColumn("_here", F.lag("_v").over(line.inside()))
        .join(carry, SLOT, "left")
        .withColumn(out, F.coalesce("_here", "_carry")["v"])
        .drop("_v", "_here", "_carry", SLOT)
    )


def running_max(df: DataFrame, line: Timeline, value: Column, out: str) -> DataFrame:
    """Add ``out``: the largest ``value`` over all rows strictly before this one."""
    rows = _slotted(df, line, {"_v": value})
    edges = rows.groupBy(SLOT).agg(F.max("_v").alias("_edge"))
    carry = edges.select(SLOT, F.max("_edge").over(line.across()).alias("_carry"))
    frame = line.inside().rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_here", F.max("_v").over(frame))
        .join(carry, SLOT, "left")
        .withColumn(out, F.greatest("_here", "_carry"))
        .drop("_v", "_here", "_carry", SLOT)
    )


def number(df: DataFrame, line: Timeline, out: str) -> DataFrame:
    """Add ``out``: the 0-based position of each row inside its key."""
    rows = _slotted(df, line, {})
    counts = rows.groupBy(SLOT).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        SLOT, F.coalesce(F.sum("_n").over(line.across()), F.lit(0)).alias("_offset")
    )
    return (
        rows.withColumn("_here", F.row_number().over(line.inside()))
        .join(offsets, SLOT, "left")
        .withColumn(out, F.col("_offset") + F.col("_here") - 1)
        .drop("_here", "_offset", SLOT)
    )


@dataclass(frozen=True)
class Blocks:
    """Numbered rows cut into equal blocks, each with copies of its neighbours' edge rows."""

    rows: DataFrame
    window: WindowSpec
    own: Column

    def finish(self, df: DataFrame) -> DataFrame:
        """Drop the copied rows once the windows are computed."""
        return df.filter(self.own).drop("_block", "_home")


def blocks(
    df: DataFrame,
    keys: Sequence[str],
    index: str,
    *,
    before: int = 0,
    after: int = 0,
    rows: int = BLOCK_ROWS,
) -> Blocks:
    """Blocks of ``rows`` consecutive rows of a key, with ``before``/``after`` rows copied in.

    A frame that looks back at most ``before`` rows and ahead at most ``after`` rows is then
    exact inside a block, and the blocks of a hot key spread over the cluster.
    """
    size = max(rows, before, after, 1)
    at = F.col(index)
    home = F.floor(at / F.lit(size))
    place = F.pmod(at, F.lit(size))
    targets = [home]
    if before:
        targets.append(F.when(place >= size - before, home + 1))
    if after:
        targets.append(F.when((place < after) & (home > 0), home - 1))
    spread = df.withColumn("_home", home).withColumn(
        "_block", F.explode(F.array_compact(F.array(*targets)))
    )
    window = Window.partitionBy(*keys, "_block").orderBy(index)
    return Blocks(spread, window, F.col("_home") == F.col("_block"))
