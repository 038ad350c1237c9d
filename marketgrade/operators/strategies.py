"""Forecast strategies: DataFrame transforms from feature rows to forecasts.

A strategy takes the feature table and a ``Signals`` bundle and returns rows in the forecast
shape. Strategies are registered by id, selected by an ordered list of ids, and unioned.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scoring import clamp
from ..functions.text import last_json_object, verdict_number, verdict_of
from ..session import cut
from .asof import asof_join
from .features import FEATURES, tick_line
from .timeline import HOUR_MS, fill, previous

log = logging.getLogger(__name__)

FORECAST = (
    "symbol string, horizon_s int, yhat double, confidence double, strategy_id string, "
    "ts bigint, model_ver string, ref_price double, trade_id bigint"
)
FORECAST_COLUMNS = [part.split()[0] for part in FORECAST.split(", ")]

FAST_CAP = 0.05
DEEP_CAP = 0.10
FULL_CONVICTION_RETURN = 0.01
NEUTRAL_REPLY = '{"stance": "neutral", "yhat": 0.0, "confidence": 0.0}'

# Batch model call: one reply per prompt, in the same order.
Model = Callable[[pd.Series], pd.Series]


def neutral_model(prompts: pd.Series) -> pd.Series:
    """The default model: a valid verdict without conviction, whatever the prompt."""
    return pd.Series([NEUTRAL_REPLY] * len(prompts))


@dataclass
class Signals:
    """Slow inputs strategies may read; each is None when not available."""

    sentiment: DataFrame | None = None  # symbol, score, n, ts, sources
    deep: DataFrame | None = None  # DeepView rows
    verdicts: DataFrame | None = None  # authored verdicts: symbol, yhat, confidence
    model: Model = neutral_model
    classifier: object = None  # fitted pyspark.ml model
    width: int = HOUR_MS
    options: dict = field(default_factory=dict)


Strategy = Callable[[DataFrame, Signals], DataFrame | None]
_STRATEGIES: dict[str, Strategy] = {}


def register(strategy_id: str) -> Callable[[Strategy], Strategy]:
    def add(fn: Strategy) -> Strategy:
        _STRATEGIES[strategy_id] = fn
        return fn

    return add


@contextmanager
def registered(own: dict[str, Strategy]) -> Iterator[None]:
    """Strategies that are registered for a while, hiding those of the same ids."""
    before = dict(_STRATEGIES)
    _STRATEGIES.update(own)
    try:
        yield
    finally:
        _STRATEGIES.clear()
        _STRATEGIES.update(before)


def registered_ids() -> list[str]:
    return sorted(_STRATEGIES)


def get_strategy(strategy_id: str) -> Strategy:
    return _STRATEGIES[strategy_id]


def forecasts(features: DataFrame, ids: Sequence[str], signals: Signals | None = None) -> DataFrame:
    """All selected strategies' forecasts in one table.

    An unknown id is a KeyError. A strategy that fails while its plan is built is left out and
    logged, and one without its inputs yields nothing, so the others go on.
    """
    signals = signals or Signals()
    chosen = [(i, get_strategy(i)) for i in ids]
    merged = features.sparkSession.createDataFrame([], FORECAST)
    for strategy_id, fn in chosen:
        try:
            made = fn(features, signals)
        except Exception:  # noqa: BLE001
            log.warning("strategy %s failed and is skipped", strategy_id, exc_info=True)
            continue
        if made is not None:
            merged = merged.unionByName(made.select(*FORECAST_COLUMNS))
    return merged


def emit(
    rows: DataFrame,
    strategy_id: str,
    horizon_s: Column | int,
    yhat: Column,
    confidence: Column,
    model_ver: Column | str = "v0",
) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select(
        "symbol",
        lit(horizon_s).cast("int").alias("horizon_s"),
        yhat.alias("yhat"),
        confidence.alias("confidence"),
        F.lit(strategy_id).alias("strategy_id"),
        "ts",
        lit(model_ver).alias("model_ver"),
        F.col("last_price").alias("ref_price"),
        "trade_id",
    )


def ema_spread() -> Column:
    """Relative lead of the fast average; null when it cannot be formed."""
    return F.try_divide(F.col("ema_fast") - F.col("ema_slow"), F.col("ema_slow"))


@register("momentum")
def momentum(features: DataFrame, signals: Signals, **options) -> DataFrame:
    """The trend continues: forecast the EMA spread itself."""
    opt = {"horizon_s": 60, "scale": 20.0, "min_confidence": 0.05, "model_ver": "v0"}
    opt |= signals.options.get("momentum", {}) | options
    spread = ema_spread()
    conviction = F.greatest(
        F.lit(opt["min_confidence"]), F.least(F.lit(1.0), F.abs(spread) * opt["scale"])
    )
    return emit(
        features.filter(spread.isNotNull()),
        "momentum",
        opt["horizon_s"],
        spread,
        conviction,
        opt["model_ver"],
    )


@register("deep_analysis")
def deep_analysis(features: DataFrame, signals: Signals) -> DataFrame | None:
    """The latest standing view of the symbol, restamped to each feature row."""
    if signals.deep is None:
        return None
    joined = asof_join(
        features,
        signals.deep,
        ["symbol"],
        "ts",
        "ts",
        take={
            "horizon_s": "view_horizon",
            "yhat": "view_yhat",
            "confidence": "view_confidence",
            "model_ver": "view_ver",
        },
        width=signals.width,
    ).filter(F.col("view_yhat").isNotNull())
    return emit(
        joined,
        "deep_analysis",
        F.col("view_horizon"),
        F.col("view_yhat"),
        F.col("view_confidence"),
        F.col("view_ver"),
    )


def with_sentiment(features: DataFrame, snapshots: DataFrame, width: int = HOUR_MS) -> DataFrame:
    """Feature rows that have a sentiment snapshot at or before them, with that snapshot."""
    return asof_join(
        features,
        snapshots,
        ["symbol"],
        "ts",
        "ts",
        take={"ts": "snap_ts", "score": "score", "n": "n", "sources": "sources"},
        width=width,
    ).filter(F.col("snap_ts").isNotNull())


def score_step() -> Column:
    return F.bround("score", 1)


def rsi_step() -> Column:
    return F.bround(F.coalesce("rsi", F.lit(50.0)) / 5.0, 0)


def spread_step() -> Column:
    return F.bround(F.coalesce(ema_spread(), F.lit(0.0)) * 1000, 0)


def verdict_runs(rows: DataFrame, width: int = HOUR_MS) -> DataFrame:
    """Mark the first row of each run of rows that share a coarse ``reading`` of the market.

    A verdict is asked for once per run, so ``head`` is true where one is needed. The reading
    is the snapshot, its score to one place, RSI in steps of 5 and spread in steps of 0.001.
    """
    reading = F.struct(
        F.col("snap_ts"), score_step().alias("score"), rsi_step().alias("rsi"), spread_step().alias("spread")
    )
    marked = previous(rows.withColumn("reading", reading), tick_line(width), F.col("reading"), "_before")
    changed = F.col("_before").isNull() | ~F.col("_before").eqNullSafe(F.col("reading"))
    return marked.withColumn("head", changed).drop("_before")


def crowd_text() -> Column:
    """The part of a prompt that a snapshot gives."""
    sources = F.when(F.size("sources") > 0, F.concat_ws(",", "sources")).otherwise("none")
    return F.format_string(
        "Symbol %s. Crowd sentiment %+.2f from %d messages via %s.",
        F.col("symbol"),
        F.col("score"),
        F.col("n").cast("bigint"),
        sources,
    )


def market_text(horizon_s: int) -> Column:
    """The part of a prompt that a feature row gives, and the question."""
    return F.format_string(
        " RSI %.0f, EMA spread %+.4f, volatility %.5f. Give the fractional return expected over "
        + str(horizon_s)
        + ' seconds, only as JSON: {"yhat": <signed number>, "confidence": <0 to 1>}.',
        F.coalesce("rsi", F.lit(50.0)),
        F.coalesce(ema_spread(), F.lit(0.0)),
        F.coalesce("vol", F.lit(0.0)),
    )


def sentiment_prompt(horizon_s: int) -> Column:
    return F.concat(crowd_text(), market_text(horizon_s))


def ask(rows: DataFrame, prompt: Column, model: Model, out: str) -> DataFrame:
    """Add the model's reply to each prompt; a failed prompt gives null, not a failed job."""

    @F.pandas_udf(T.StringType())
    def reply(prompts: pd.Series) -> pd.Series:
        return _safe_replies(model, prompts)

    return rows.withColumn(out, reply(prompt))


def _safe_replies(model: Model, prompts: pd.Series) -> pd.Series:
    try:
        return pd.Series(list(model(prompts)), dtype=object)
    except Exception:  # noqa: BLE001
        replies = []
        for i in range(len(prompts)):
            try:
                replies.append(list(model(prompts.iloc[i : i + 1]))[0])
            except Exception:  # noqa: BLE001
                replies.append(None)
        return pd.Series(replies, dtype=object)


#: Calls in a row that must not raise before a model gets many prompts in one, and how many then.
STEADY_CALLS, AT_ONCE = 64, 1024


class Questions:
    """A model that is asked prompt by prompt until it has proved steady, and then many prompts at once.

    A prompt that fails twice has no reply. A call of many prompts that raises, or that does not
    give a reply for each, is done again prompt by prompt, and the model has to prove itself anew.
    """

    def __init__(self, model: Model) -> None:
        self.model, self.steady = model, 0

    @property
    def at_once(self) -> int:
        return AT_ONCE if self.steady >= STEADY_CALLS else 1

    def __call__(self, prompts: list[str]) -> list[str | None]:
        replies = self._try(prompts) if len(prompts) > 1 else None
        if replies is None:
            replies = [(self._try([p]) or self._try([p]) or [None])[0] for p in prompts]
        return [r if isinstance(r, str) else None for r in replies]

    def _try(self, prompts: list[str]) -> list | None:
        try:
            replies = list(self.model(pd.Series(prompts, dtype=object)))
            if len(replies) != len(prompts):
                raise ValueError("one reply for each prompt")
        except Exception:  # noqa: BLE001
            self.steady = 0
            return None
        self.steady += 1
        return replies


def first_answers(rows: DataFrame, prompt: Column, model: Model) -> DataFrame:
    """The first row of each run (symbol, run) whose prompt the model answers, with its ``_reply``.

    A run's rows are asked one after another until one answer comes, so nothing is asked that
    a live loop would not ask; different runs are asked in parallel. Rows are streamed in order
    and not gathered.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done = None
        for batch in batches:
            made = []
            for row in batch.itertuples(index=False):
                if (row.symbol, row.run_ts, row.run_id) == done:
                    continue
                reply = _safe_replies(model, pd.Series([row.prompt]))[0]
                if verdict_of(reply) is not None:
                    done = (row.symbol, row.run_ts, row.run_id)
                    made.append((*done, row.ts, row.trade_id, reply))
            yield pd.DataFrame(made, columns=["symbol", "run_ts", "run_id", "ts", "trade_id", "_reply"])

    asked = rows.select("symbol", F.col("run.ts").alias("run_ts"), F.col("run.trade_id").alias("run_id"), "ts", "trade_id", prompt.alias("prompt"))
    asked = asked.repartition("symbol", "run_ts", "run_id").sortWithinPartitions("symbol", "run_ts", "run_id", "ts", "trade_id")
    return asked.mapInPandas(run, "symbol string, run_ts bigint, run_id bigint, ts bigint, trade_id bigint, _reply string")


def verdict_events(runs: DataFrame, signals: Signals, horizon_s: int) -> DataFrame:
    """Rows (symbol, ts, trade_id, event): where a verdict starts to hold (``event.v``), or none holds (null).

    The first row of each run is asked. Where no answer comes, the run's next rows are asked
    until one does. The memo keeps its reading and verdict over runs without an answer: a run with
    the reading that is still in it takes the old verdict.
    """
    line = tick_line(signals.width)
    prompt = sentiment_prompt(horizon_s)
    asked = ask(runs.filter("head"), prompt, signals.model, "_reply")
    heads = cut(asked.select("symbol", "ts", "trade_id", "reading", parsed_verdict(F.col("_reply"), FAST_CAP).alias("got")))
    failed = heads.filter("got IS NULL").select("symbol", F.struct("ts", "trade_id").alias("run"))
    if failed.isEmpty():
        return heads.select("symbol", "ts", "trade_id", F.struct(F.col("got").alias("v")).alias("event"))
    placed = fill(runs, line, F.when(F.col("head"), F.struct("ts", "trade_id")), "run")
    rest = placed.filter("NOT head").join(failed, ["symbol", "run"], "left_semi")
    late = cut(first_answers(rest, prompt, signals.model))
    late = late.select(
        "symbol", F.col("run_ts"), F.col("run_id"), F.struct("ts", "trade_id").alias("late_at"), parsed_verdict(F.col("_reply"), FAST_CAP).alias("late")
    ).filter("late IS NOT NULL")
    run = heads.withColumnsRenamed({"ts": "run_ts", "trade_id": "run_id"}).join(late, ["symbol", "run_ts", "run_id"], "left")
    run = run.withColumnsRenamed({"run_ts": "ts", "run_id": "trade_id"}).withColumn("verdict", F.coalesce("got", "late"))
    # Of answered runs in a row with one reading, only the first was really asked: its verdict is the memo's.
    answered = previous(run.filter("verdict IS NOT NULL"), line, F.col("reading"), "before")
    first = F.when(~F.col("before").eqNullSafe(F.col("reading")), F.struct(F.col("verdict").alias("v")))
    answered = fill(answered, line, first, "kept").select("symbol", "ts", "trade_id", F.struct("reading", F.col("kept.v").alias("v")).alias("memo"))
    run = fill(run.join(answered, ["symbol", "ts", "trade_id"], "left"), line, F.col("memo"), "after")
    run = previous(run, line, F.col("after"), "held")
    same = F.col("held.reading").eqNullSafe(F.col("reading")) & F.col("held").isNotNull()
    at_head = run.select("symbol", "ts", "trade_id", F.struct(F.when(same, F.col("held.v")).otherwise(F.col("got")).alias("v")).alias("event"))
    at_late = run.filter(~same & F.col("late").isNotNull()).select(
        "symbol", F.col("late_at.ts").alias("ts"), F.col("late_at.trade_id").alias("trade_id"), F.struct(F.col("late").alias("v")).alias("event")
    )
    return cut(at_head.unionByName(at_late))


def parsed_verdict(reply: Column, cap: float) -> Column:
    """The closing JSON verdict of a reply, clamped; null when there is none."""
    yhat, confidence = (verdict_number(last_json_object(reply), name) for name in ("yhat", "confidence"))
    return F.when(
        yhat.isNotNull() & confidence.isNotNull(),
        F.struct(
            clamp(yhat, -cap, cap).alias("yhat"),
            clamp(confidence, 0.0, 1.0).alias("confidence"),
        ),
    )


@register("sentiment_llm")
def sentiment_verdicts(features: DataFrame, signals: Signals, horizon_s: int = 60) -> DataFrame | None:
    """A verdict on features plus crowd sentiment, reused while the reading is unchanged.

    Authored verdicts are looked up per symbol. Otherwise only the first row of each run goes
    to the model; its verdict is joined back on the row's own key and carried forward. After a
    failed call the run's next row is asked, and rows before the first answer have no forecast
    (see ``verdict_events``).
    """
    if signals.sentiment is None:
        return None
    rows = with_sentiment(features, signals.sentiment, signals.width)
    if signals.verdicts is not None:
        answered = verdict_lookup(rows, signals.verdicts).withColumn(
            "_verdict",
            F.struct(
                clamp(F.col("verdict_yhat"), -FAST_CAP, FAST_CAP).alias("yhat"),
                clamp(F.col("verdict_confidence"), 0.0, 1.0).alias("confidence"),
            ),
        )
    else:
        # Cut, because several branches read both, and a model must be asked only once.
        runs = cut(verdict_runs(rows, signals.width))
        joined = runs.join(verdict_events(runs, signals, horizon_s), ["symbol", "ts", "trade_id"], "left")
        answered = (
            fill(joined, tick_line(signals.width), F.col("event"), "_held")
            .withColumn("_verdict", F.col("_held.v"))
            .filter(F.col("_verdict").isNotNull())
        )
    return emit(
        answered,
        "sentiment_llm",
        horizon_s,
        F.col("_verdict.yhat"),
        F.col("_verdict.confidence"),
    )


def verdict_lookup(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Authored verdict per symbol, neutral where none was written."""
    table = verdicts.select(
        "symbol",
        F.col("yhat").alias("verdict_yhat"),
        F.col("confidence").alias("verdict_confidence"),
    )
    return (
        rows.join(table, ["symbol"], "left")
        .withColumn("verdict_yhat", F.coalesce("verdict_yhat", F.lit(0.0)))
        .withColumn("verdict_confidence", F.coalesce("verdict_confidence", F.lit(0.0)))
    )


@register("ml_model")
def classifier(features: DataFrame, signals: Signals, horizon_s: int = 60) -> DataFrame | None:
    """Edge of the fitted model's up-probability over one half; needs every feature."""
    if signals.classifier is None:
        return None
    from pyspark.ml.functions import vector_to_array

    ready = features.dropna(subset=list(FEATURES))
    scored = signals.classifier.transform(ready)
    edge = vector_to_array("probability")[1] - 0.5
    return emit(
        scored,
        "ml_model",
        horizon_s,
        edge_return(edge),
        edge_confidence(edge),
        signals.options.get("ml_model", {}).get("model_ver", "ml-v0"),
    )


def edge_return(edge: Column) -> Column:
    return edge * 2 * FULL_CONVICTION_RETURN


def edge_confidence(edge: Column) -> Column:
    return F.least(F.lit(1.0), F.abs(edge) * 2)


def blend(made: DataFrame, horizon_s: int = 60, model_ver: str = "v0") -> DataFrame:
    """Confidence-weighted mean of the forecasts made on one feature row."""
    weight = F.sum("confidence")
    return (
        made.groupBy("symbol", "ts", "trade_id")
        .agg(
            F.sum(F.col("yhat") * F.col("confidence")).alias("_weighted"),
            weight.alias("_weight"),
            F.count(F.lit(1)).alias("_n"),
            F.max("ref_price").alias("last_price"),
        )
        .filter(F.col("_weight") > 0)
        .transform(
            lambda df: emit(
                df,
                "ensemble",
                horizon_s,
                F.col("_weighted") / F.col("_weight"),
                F.least(F.lit(1.0), F.col("_weight") / F.col("_n")),
                model_ver,
            )
        )
    )


@register("ensemble")
def ensemble(features: DataFrame, signals: Signals) -> DataFrame | None:
    """Blend of the child strategies; an exception in a child loses the blend only."""
    children = signals.options.get("ensemble", {}).get("children", ["momentum", "sentiment_llm"])
    made = [get_strategy(child)(features, signals) for child in children]
    made = [m for m in made if m is not None]
    if not made:
        return None
    merged = made[0]
    for other in made[1:]:
        merged = merged.unionByName(other)
    return blend(merged)


def python_strategy(
    strategy_id: str, predict: Callable[[pd.DataFrame], pd.DataFrame]
) -> Strategy:
    """A strategy written over pandas batches of feature rows.

    ``predict`` returns rows with symbol, ts, trade_id, last_price, horizon_s, yhat and
    confidence. If a batch raises, its halves are tried, down to single rows, and only the
    failing rows are lost. What is made of a batch leaves as one frame.
    """

    def attempt(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        try:
            made = predict(batch)
        except Exception:  # noqa: BLE001
            if len(batch) > 1:
                half = len(batch) // 2
                yield from attempt(batch.iloc[:half])
                yield from attempt(batch.iloc[half:])
            return
        if made is not None and len(made):
            # A selection of columns is dear where a frame holds a few rows.
            yield made if list(made.columns) == _PYTHON_COLUMNS else made[_PYTHON_COLUMNS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = list(attempt(batch))
            if made:
                yield pd.concat(made, ignore_index=True)

    def strategy(features: DataFrame, signals: Signals) -> DataFrame:
        made = features.mapInPandas(run, _PYTHON_SCHEMA)
        return emit(
            made, strategy_id, F.col("horizon_s"), F.col("yhat"), F.col("confidence")
        )

    return strategy


_PYTHON_SCHEMA = (
    "symbol string, ts bigint, trade_id bigint, last_price double, horizon_s int, "
    "yhat double, confidence double"
)
_PYTHON_COLUMNS = [part.split()[0] for part in _PYTHON_SCHEMA.split(", ")]
