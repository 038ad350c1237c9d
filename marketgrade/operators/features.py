"""One feature row per tick: EMAs, running VWAP, return, volatility, Wilder RSI.

Ticks are shuffled once, by (symbol, time bucket). Window functions compute everything a
bucket can know by itself; one summary row per bucket is folded in time order into the state
each bucket starts from; the rows then combine their local value with that state. A symbol
that holds a third of the ticks is spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .recurrence import block_length, decay, shared_length, span_alpha
from .timeline import BUCKET, HOUR_MS, Timeline, once

FEATURES = ("ema_fast", "ema_slow", "vwap", "ret_1", "vol", "rsi")


@dataclass(frozen=True)
class FeatureConfig:
    ema_fast: int = 12
    ema_slow: int = 26
    rsi_period: int = 14
    vol_window: int = 20


def tick_line(width: int = HOUR_MS) -> Timeline:
    return Timeline(("symbol",), ("ts", "trade_id"), width)


def _scan(
    df: DataFrame, terms: dict[str, tuple[Column, float]], position: str, order: list[str], size: int
) -> DataFrame:
    """Bucket-local weighted sums ``{out: (x, alpha)}``, as if each bucket started at zero.

    ``position`` counts the contributing rows of the bucket from 0. Long buckets are cut into
    blocks of ``size`` positions; a block takes the last value of the block before it.
    """
    at = F.greatest(F.col(position), F.lit(0))
    df = df.withColumns({"_block": F.floor(at / F.lit(size)), "_place": F.pmod(at, F.lit(size))})
    inside = Window.partitionBy("symbol", BUCKET, "_block").orderBy(*order)
    before = Window.partitionBy("symbol", BUCKET).orderBy("_block").rangeBetween(-1, -1)
    place = F.col("_place")
    df = df.withColumns(
        {
            f"{out}_loc": F.coalesce(
                decay(alpha, place) * F.sum(F.lit(alpha) * x / decay(alpha, place)).over(inside),
                F.lit(0.0),
            )
            for out, (x, alpha) in terms.items()
        }
    )
    df = df.withColumns(
        {
            out: F.col(f"{out}_loc")
            + decay(alpha, place + 1)
            * F.coalesce(F.max_by(f"{out}_loc", "_place").over(before), F.lit(0.0))
            for out, (_, alpha) in terms.items()
        }
    )
    return df.drop("_block", "_place", *[f"{out}_loc" for out in terms])


def _ordered(ticks: DataFrame, line: Timeline) -> DataFrame:
    """Ticks by bucket with their place, return and price change inside it.

    ``_j`` counts the usable returns so far. The first row of a bucket has none yet.
    """
    seq = line.window()
    price, prev = F.col("price"), F.col("_prev")
    usable = prev.isNotNull() & (prev != 0)
    rows = ticks.select("symbol", "ts", "trade_id", "price", "volume")
    return (
        once(rows.withColumn(BUCKET, line.bucket()), "symbol", BUCKET)
        .withColumns({"_k": F.row_number().over(seq) - 1, "_prev": F.lag("price").over(seq)})
        .withColumns(
            {"_ret": F.when(usable, price / prev - 1.0), "_delta": F.when(usable, price - prev)}
        )
        .withColumns(
            {
                "_g": F.greatest(F.col("_delta"), F.when(F.col("_delta").isNotNull(), 0.0)),
                "_l": F.greatest(-F.col("_delta"), F.when(F.col("_delta").isNotNull(), 0.0)),
                "_j": F.count("_ret").over(seq.rowsBetween(Window.unboundedPreceding, 0)),
            }
        )
    )


def _running(ordered: DataFrame, cfg: FeatureConfig, line: Timeline) -> DataFrame:
    """Running values of every row, as far as its bucket knows them."""
    fast, slow = span_alpha(cfg.ema_fast), span_alpha(cfg.ema_slow)
    wilder = 1.0 / cfg.rsi_period
    price = F.col("price")
    so_far = line.window().rowsBetween(Window.unboundedPreceding, 0)
    df = ordered.withColumns(
        {
            "_pv": F.sum(price * F.col("volume")).over(so_far),
            "_v": F.sum("volume").over(so_far),
            "_pos": F.col("_j") - 1,
        }
    )
    averages = {"_fast": (price, fast), "_slow": (price, slow)}
    averages = {out: t for out, t in averages.items() if t[1] < 1.0}
    together = shared_length([alpha for _, alpha in averages.values()]) if averages else None
    if together:
        df = _scan(df, averages, "_k", ["ts", "trade_id"], together)
    else:
        for out, term in averages.items():
            df = _scan(df, {out: term}, "_k", ["ts", "trade_id"], block_length(term[1]))
    for out in {"_fast", "_slow"} - set(averages):
        df = df.withColumn(out, price)

    recent = (
        Window.partitionBy("symbol", BUCKET).orderBy("_j").rangeBetween(-(cfg.vol_window - 1), 0)
    )
    df = df.withColumns(
        {"_vmean": F.avg("_ret").over(recent), "_vvar": F.var_pop("_ret").over(recent)}
    )
    if wilder >= 1.0:
        return df.withColumns({"_gain": F.col("_g"), "_loss": F.col("_l")})
    wilder_terms = {"_gain": (F.col("_g"), wilder), "_loss": (F.col("_l"), wilder)}
    return _scan(df, wilder_terms, "_pos", ["_j"], block_length(wilder))


_CARRY_SCHEMA = (
    "symbol string, _bucket bigint, c_start boolean, c_fast double, c_slow double, "
    "c_pv double, c_v double, c_price double, c_skip int, c_gain double, c_loss double, "
    "c_tail int, c_means array<double>, c_squares array<double>"
)


def _summaries(ordered: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """One bounded row per bucket; the lists hold at most one window and one RSI period.

    Weights count from the end of the bucket, so they only shrink and need no blocks.
    """
    slot = Window.partitionBy("symbol", BUCKET)
    df = ordered.withColumns({"_n": F.count(F.lit(1)).over(slot), "_m": F.max("_j").over(slot)})
    valid = F.col("_ret").isNotNull()
    in_tail = valid & (F.col("_m") - F.col("_j") < cfg.vol_window)
    in_head = valid & (F.col("_j") <= cfg.rsi_period)

    def weighted(column: str, alpha: float, steps: Column) -> Column:
        return F.sum(F.lit(alpha) * F.col(column) * decay(alpha, steps))

    rows_left, returns_left = F.col("_n") - F.col("_k") - 1, F.col("_m") - F.col("_j")
    wilder = 1.0 / cfg.rsi_period
    return df.groupBy("symbol", BUCKET).agg(
        F.count(F.lit(1)).alias("n"),
        F.max("_j").alias("m"),
        F.min_by("price", "_k").alias("first_price"),
        F.max_by("price", "_k").alias("last_price"),
        F.sum(F.col("price") * F.col("volume")).alias("pv"),
        F.sum("volume").alias("v"),
        weighted("price", span_alpha(cfg.ema_fast), rows_left).alias("fast"),
        weighted("price", span_alpha(cfg.ema_slow), rows_left).alias("slow"),
        F.coalesce(weighted("_g", wilder, returns_left), F.lit(0.0)).alias("gain"),
        F.coalesce(weighted("_l", wilder, returns_left), F.lit(0.0)).alias("loss"),
        F.sort_array(F.collect_list(F.when(in_tail, F.struct("_j", "_ret")))).alias("tail"),
        F.sort_array(F.collect_list(F.when(in_head, F.struct("_j", "_g", "_l")))).alias("head"),
    )


class _State:
    """What one symbol carries from bucket to bucket."""

    def __init__(self, cfg: FeatureConfig) -> None:
        self.cfg = cfg
        self.q_fast = 1.0 - span_alpha(cfg.ema_fast)
        self.q_slow = 1.0 - span_alpha(cfg.ema_slow)
        self.q_rsi = 1.0 - 1.0 / cfg.rsi_period
        self.fast = self.slow = self.price = None
        self.pv = self.v = self.gain = self.loss = 0.0
        self.seen = 0
        self.tail: list[float] = []

    def step(self, b) -> tuple:
        cfg = self.cfg
        n = cfg.rsi_period
        start = self.price is None
        fast, slow = (b.first_price, b.first_price) if start else (self.fast, self.slow)
        # The first row of a bucket is the only one whose return needs the bucket before.
        if not start and self.price != 0:
            delta = b.first_price - self.price
            up, down = max(delta, 0.0), max(-delta, 0.0)
            keep = 1.0 if self.seen < n else self.q_rsi
            self.gain = self.gain * keep + up / n
            self.loss = self.loss * keep + down / n
            self.seen += 1
            self.tail = (self.tail + [b.first_price / self.price - 1.0])[-cfg.vol_window :]
        skip = max(n - self.seen, 0)
        gain, loss = self.gain, self.loss
        if skip:
            seeds = b.head[:skip]
            gain += sum(s["_g"] for s in seeds) / n
            loss += sum(s["_l"] for s in seeds) / n
        if b.m < skip:
            carry_gain = carry_loss = None
            self.gain, self.loss = gain, loss
        else:
            # The rows add the bucket's own decayed sum, seeds included: take that part off.
            for place, s in enumerate(b.head[:skip], start=1):
                faded = self.q_rsi ** (skip - place) / n
                gain -= s["_g"] * faded
                loss -= s["_l"] * faded
            carry_gain, carry_loss = gain, loss
            fade = self.q_rsi ** (b.m - skip)
            self.gain, self.loss = b.gain + fade * gain, b.loss + fade * loss
        means, squares = suffix_moments(self.tail)
        out = (start, fast, slow, self.pv, self.v, self.price, skip, carry_gain, carry_loss,
               len(self.tail), means, squares)
        self.seen += b.m
        self.tail = (self.tail + [t["_ret"] for t in b.tail])[-cfg.vol_window :]
        self.fast = b.fast + self.q_fast**b.n * fast
        self.slow = b.slow + self.q_slow**b.n * slow
        self.pv += b.pv
        self.v += b.v
        self.price = b.last_price
        return out


def suffix_moments(values: list[float]) -> tuple[list[float], list[float]]:
    """Mean and sum of squared deviations of the last 0, 1, 2, ... values."""
    means, squares = [0.0], [0.0]
    mean = square = 0.0
    for count, x in enumerate(reversed(values), start=1):
        gap = x - mean
        mean += gap / count
        square += gap * (x - mean)
        means.append(mean)
        squares.append(square)
    return means, squares


def _fold(cfg: FeatureConfig):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, state = None, None
        for batch in batches:
            rows = []
            for b in batch.itertuples(index=False):
                if state is None or b.symbol != symbol:
                    symbol, state = b.symbol, _State(cfg)
                rows.append((b.symbol, b.bucket, *state.step(b)))
            columns = [c.split()[0] for c in _CARRY_SCHEMA.split(", ")]
            yield pd.DataFrame(rows, columns=columns)

    return run


def feature_rows(
    ticks: DataFrame, cfg: FeatureConfig | None = None, width: int = HOUR_MS
) -> DataFrame:
    """Ticks (symbol, ts, trade_id, price, volume) to feature rows, absent values as null."""
    cfg = cfg or FeatureConfig()
    line = tick_line(width)
    ordered = _ordered(ticks, line)
    carry = (
        _summaries(ordered, cfg)
        .withColumnRenamed(BUCKET, "bucket")
        .repartition("symbol")
        .sortWithinPartitions("symbol", "bucket")
        .mapInPandas(_fold(cfg), _CARRY_SCHEMA)
    )
    df = _running(ordered, cfg, line).join(carry, ["symbol", BUCKET], "left")

    k, j = F.col("_k"), F.col("_j")
    opening = F.col("c_start") & (k == 0)
    fast_alpha, slow_alpha = span_alpha(cfg.ema_fast), span_alpha(cfg.ema_slow)

    def average(local_value: str, carried: str, alpha: float) -> Column:
        return F.when(opening, F.col("price")).otherwise(
            F.col(local_value) + decay(alpha, k + 1) * F.col(carried)
        )

    before = F.when(k == 0, F.col("c_price")).otherwise(F.col("_prev"))
    valid = before.isNotNull() & (before != 0)
    volume = F.col("c_v") + F.col("_v")

    # Volatility: the bucket's own returns, topped up from the tail of earlier buckets.
    own_n = F.least(j, F.lit(cfg.vol_window))
    need = F.least(F.greatest(F.lit(cfg.vol_window) - j, F.lit(0)), F.col("c_tail"))
    tail_mean = F.element_at("c_means", (need + 1).cast("int"))
    tail_square = F.element_at("c_squares", (need + 1).cast("int"))
    own_mean = F.coalesce(F.col("_vmean"), F.lit(0.0))
    own_square = F.coalesce(F.col("_vvar"), F.lit(0.0)) * own_n
    total = own_n + need
    gap = own_mean - tail_mean
    square = own_square + tail_square + F.try_divide(gap * gap * own_n * need, total)
    spread = F.when(need == 0, F.sqrt(F.col("_vvar"))).when(total > 0, F.sqrt(square / total))

    skip = F.col("c_skip")
    fade = decay(1.0 / cfg.rsi_period, F.greatest(j - skip, F.lit(0)))
    gain = F.col("_gain") + fade * F.col("c_gain")
    loss = F.col("_loss") + fade * F.col("c_loss")
    rsi = F.when(loss <= 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + gain / loss))

    return df.select(
        "symbol",
        "ts",
        "trade_id",
        F.col("price").alias("last_price"),
        average("_fast", "c_fast", fast_alpha).alias("ema_fast"),
        average("_slow", "c_slow", slow_alpha).alias("ema_slow"),
        F.when(volume > 0, (F.col("c_pv") + F.col("_pv")) / volume).alias("vwap"),
        F.when(valid, F.col("price") / before - 1.0).alias("ret_1"),
        F.when(valid & (total >= 2), spread).alias("vol"),
        F.when(valid & (j >= skip) & F.col("c_gain").isNotNull(), rsi).alias("rsi"),
    )


def as_message(features: DataFrame) -> DataFrame:
    """Wide feature rows to the message shape with a ``features`` map that omits absent values."""
    entries = F.array_compact(
        F.array(
            *[
                F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("k"), F.col(c).alias("v")))
                for c in FEATURES
            ]
        )
    )
    return features.select(
        "symbol", "ts", "last_price", F.map_from_entries(entries).alias("features")
    )


def latest_features(features: DataFrame) -> DataFrame:
    """The last feature row of each symbol, by partial aggregation."""
    row = F.struct(*features.columns)
    return (
        features.groupBy("symbol")
        .agg(F.max_by(row, F.struct("ts", "trade_id")).alias("_row"))
        .select("_row.*")
    )


def summary_text(row: str = "") -> Column:
    """One readable line of the features that are present."""
    c = lambda name: F.col(f"{row}{name}")
    slow = c("ema_slow")
    return F.concat_ws(
        ", ",
        F.format_string("last %.2f", c("last_price")),
        F.when(c("ret_1").isNotNull(), F.format_string("ret_1 %+.2f%%", c("ret_1") * 100)),
        F.when(c("rsi").isNotNull(), F.format_string("rsi %.0f", c("rsi"))),
        F.when(
            slow.isNotNull() & (slow != 0) & c("ema_fast").isNotNull(),
            F.format_string("ema_spread %+.4f", F.try_divide(c("ema_fast") - slow, slow)),
        ),
        F.when(c("vol").isNotNull(), F.format_string("vol %.5f", c("vol"))),
    )
