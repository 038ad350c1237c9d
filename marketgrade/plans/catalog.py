"""One named query per operator, each over whole benchmark tables."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import scoring, symbols, text
from ..operators import (
    bars as B,
)
from ..operators import (
    dedup,
    deep,
    evaluate,
    learning,
    live,
    macro,
    markets,
    news,
    sentiment,
    statements,
    strategies,
    vendors,
)
from ..operators import features as FX
from ..operators import leaderboard as L
from ..operators.timeline import DAY_MS
from ..schemas import decode, encode
from ..session import ROCKSDB, cut, scratch_folder, ship_package, stored
from ..sources import feeds, lake, payloads
from ..streaming import jobs
from ..streaming.processors import STANDING_ROW
from . import adapters as A

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

HORIZON = 3600
AS_OF = "1998-12-31"
REPLAY_ROWS = 1_000_000  # rows of a micro-batch of a replayed table, about
STATE_ROWS = 50_000  # rows of a micro-batch for each state partition, about
STRATEGIES = ("momentum", "sentiment_llm", "deep_analysis", "ensemble")


def query(fn: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, folder)

    QUERIES[fn.__name__] = run
    return run


def r(c: str | Column, places: int = 6) -> Column:
    """Rounded, without negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, places) + F.lit(0.0)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    doubles = [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({n: r(n, places) for n in doubles}) if doubles else df


# ---- building blocks -------------------------------------------------------------------------


def features(spark: SparkSession, folder: str) -> DataFrame:
    return FX.feature_rows(A.ticks(spark, folder))


def prices(spark: SparkSession, folder: str) -> DataFrame:
    return A.ticks(spark, folder).select(
        "symbol", "ts", "trade_id", F.col("price").alias("last_price")
    )


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    daily = A.daily_sentiment(spark, folder)
    return sentiment.snapshots(daily, F.col("ts"))


def momentum(spark: SparkSession, folder: str) -> DataFrame:
    return strategies.momentum(features(spark, folder), strategies.Signals(), horizon_s=HORIZON)


def score_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Authored verdicts per symbol, made from the symbol's mean sentiment over all days."""
    return (
        A.daily_sentiment(spark, folder)
        .filter(F.col("symbol") != "signup")
        .groupBy("symbol")
        .agg(
            ((F.sum("bullish") - F.sum("bearish")) / F.sum("bullish")).alias("yhat"),
            (F.sum("bullish") / (F.sum("bullish") + F.sum("bearish"))).alias("confidence"),
        )
    )


def signals(spark: SparkSession, folder: str) -> strategies.Signals:
    return strategies.Signals(
        sentiment=snapshots(spark, folder),
        deep=A.views(spark, folder),
        verdicts=score_verdicts(spark, folder),
    )


def all_forecasts(spark: SparkSession, folder: str) -> DataFrame:
    ready = cut(features(spark, folder))
    return strategies.forecasts(ready, STRATEGIES, signals(spark, folder))


def momentum_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.outcomes(momentum(spark, folder), prices(spark, folder))


def by_name(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes of three strategies that need no slow signal, to rank against each other.

    Momentum, its opposite and a constant rise share the tick's reference price and horizon.
    """
    matched = evaluate.match_prices(
        A.ticks(spark, folder).select(
            "symbol", "ts", "trade_id", F.lit(HORIZON).alias("horizon_s"),
            F.col("price").alias("ref_price"),
            "volume",
        ),
        prices(spark, folder),
    )
    lean = (F.col("volume") - 50.0) / 1000.0
    made = F.array(
        *[
            F.struct(
                F.lit(name).alias("strategy_id"), yhat.alias("yhat"), confidence.alias("confidence")
            )
            for name, yhat, confidence in (
                ("volume_up", lean, F.col("volume") / 100.0),
                ("volume_down", -lean, 1.0 - F.col("volume") / 100.0),
                ("always_up", F.lit(0.01), F.lit(0.5)),
            )
        ]
    )
    wide = matched.withColumn("_made", F.explode(made)).select(
        "*", "_made.*", F.lit("v0").alias("model_ver")
    )
    return evaluate.score_rows(wide.drop("_made"))


BY_NAME = ("volume_up", "volume_down", "always_up")
OUTCOME_ORDER = ("scored_trade_id", "pred_trade_id")


# ---- sources and decoding --------------------------------------------------------------------


def trade_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Trades as broker messages; every third is wrapped in a stream envelope."""
    ticks = A.ticks(spark, folder)
    body = F.format_string(
        '{"e":"trade","s":"%s","t":%d,"p":"%s","q":"%s","T":%d,"m":true}',
        F.col("symbol"), F.col("trade_id"), F.col("price").cast("string"),
        F.col("volume").cast("string"), F.col("ts"),
    )
    wrapped = F.concat(F.lit('{"stream":"trades","data":'), body, F.lit("}"))
    return ticks.select(
        F.col("symbol").cast("binary").alias("key"),
        F.when(F.col("trade_id") % 3 == 0, wrapped).otherwise(body).cast("binary").alias("value"),
        F.col("trade_id").alias("offset"),
    )


@query
def source_trade_messages(spark, folder):
    return payloads.trades(trade_messages(spark, folder))


@query
def source_trade_quarantine(spark, folder):
    """Messages of which every seventh has a price in words and every eleventh is cut short."""
    value = F.col("value").cast("string")
    damaged = F.when(F.col("offset") % 7 == 0, F.regexp_replace(value, '"p":"[^"]*"', '"p":"dear"'))
    damaged = damaged.when(F.col("offset") % 11 == 0, F.substring(value, 1, 12)).otherwise(value)
    messages = trade_messages(spark, folder).withColumn("value", damaged)
    good, bad = payloads.split_trades(messages, keep=("offset",))
    return good.select("offset", "price", F.lit(None).cast("string").alias("text")).union(
        bad.select("offset", F.lit(None).cast("double"), F.substring("value", 1, 12))
    )


@query
def source_rest_trades(spark, folder):
    ticks = A.ticks(spark, folder)
    rest = ticks.select(
        "symbol", F.col("trade_id").alias("id"), F.col("price").cast("string").alias("price"),
        F.col("volume").cast("string").alias("qty"), F.col("ts").alias("time"),
    )
    return payloads.normalize(payloads.rest_payload(rest))


@query
def source_klines(spark, folder):
    cells = ["ts", "price", "price", "price", "price", "volume", "ts", "volume"]
    ticks = A.ticks(spark, folder)
    arrays = ticks.select(
        "symbol", "trade_id", F.to_json(F.array(*[F.col(c).cast("string") for c in cells])).alias("value")
    )
    return payloads.klines(arrays, keep=("symbol", "trade_id"))


def prediction_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Forecast messages with unknown fields, absent defaults and, every tenth, no yhat."""
    t = A.ticks(spark, folder)
    body = F.to_json(
        F.struct(
            "symbol", F.lit(60).alias("horizon_s"),
            F.when(F.col("trade_id") % 10 != 0, F.col("price") / 1000.0).alias("yhat"),
            (F.col("volume") / 100.0).alias("confidence"), F.lit("momentum").alias("strategy_id"), "ts",
            F.when(F.col("trade_id") % 2 == 0, F.lit("v7")).alias("model_ver"),
            F.lit("ignored").alias("extra"),
        )
    )
    return t.select("trade_id", body.alias("value"))


@query
def decode_predictions(spark, folder):
    good, _ = decode(prediction_messages(spark, folder), "prediction", keep=("trade_id",))
    return rounded(good.withColumns({
        "direction": scoring.sign(F.col("yhat")),
        "target_ts": scoring.target_ts(F.col("ts"), F.col("horizon_s")),
    }))


@query
def decode_quarantine(spark, folder):
    _, bad = decode(prediction_messages(spark, folder), "prediction", keep=("trade_id",))
    return bad.select("trade_id", F.get_json_object("value", "$.symbol").alias("symbol"))


@query
def source_authored_signals(spark, folder):
    verdicts = score_verdicts(spark, folder)
    entry = F.struct(
        F.when(
            F.col("symbol") != "view",
            F.struct(F.round("yhat", 6).alias("yhat"), F.round("confidence", 6).alias("confidence"), F.lit("x").alias("note")),
        ).alias("sentiment"),
        F.when(
            F.col("symbol") != "click",
            F.struct(F.lit("bullish").alias("stance"), F.lit(0.01).alias("yhat")),
        ).alias("deep"),
    )
    files = verdicts.select(F.to_json(F.struct(F.create_map("symbol", entry).alias("signals"))).alias("value"))
    return rounded(payloads.authored_signals(files))


@query
def source_atom_entries(spark, folder):
    posts = A.posts(spark, folder)
    safe = F.regexp_replace("title", "[^A-Za-z0-9 ]", "")
    entry = F.concat(
        F.lit("<entry><title>"), safe, F.lit("</title><published>"),
        F.coalesce(text.utc_text(F.col("published"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("not a date")),
        F.lit("</published><content type=\"html\">&lt;b&gt;Post&lt;/b&gt; "), F.col("post_id"),
        F.lit(" &amp;amp; more</content></entry>"),
    )
    rows = posts.select("source", "post_id", entry.alias("value"))
    return feeds.atom_entries(rows, "value", keep=("source", "post_id"))


# ---- features --------------------------------------------------------------------------------


@query
def feature_rows(spark, folder):
    return rounded(features(spark, folder))


@query
def feature_rows_by_user(spark, folder):
    """Many short series; prices leave the cent grid, so rounding never meets a tie."""
    ticks = A.ticks(spark, folder, "user_id").withColumn("price", F.col("price") * 1000.0 / 997.0)
    return rounded(FX.feature_rows(ticks, width=7 * DAY_MS))


@query
def feature_messages(spark, folder):
    sent = encode(FX.as_message(features(spark, folder)), "feature_window", "features.out")
    known = [F.get_json_object("value", f"$.features.{c}").isNotNull() for c in FX.FEATURES]
    present = F.array_compact(F.array(*[F.when(k, F.lit(c)) for k, c in zip(known, FX.FEATURES, strict=True)]))
    return sent.groupBy("topic", "key", F.array_join(present, ",").alias("present")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def latest_features(spark, folder):
    return rounded(FX.latest_features(features(spark, folder)))


@query
def feature_summaries(spark, folder):
    return FX.latest_features(features(spark, folder)).select(
        "symbol", FX.summary_text().alias("summary")
    )


@query
def ascending_trades(spark, folder):
    kept = dedup.ascending_only(A.arrivals(spark, folder), width=2_000)
    return kept.select("symbol", "arrival", "trade_id", "price")


@query
def ascending_polled_trades(spark, folder):
    kept = dedup.ascending_only(A.arrivals(spark, folder), floor=0, width=2_000)
    return kept.select("symbol", "arrival", "trade_id", "price")


# ---- strategies ------------------------------------------------------------------------------


@query
def momentum_forecasts(spark, folder):
    made = momentum(spark, folder).withColumns({
        "direction": scoring.sign(F.col("yhat")),
        "target_ts": scoring.target_ts(F.col("ts"), F.col("horizon_s")),
    })
    return rounded(made)


@query
def deep_forecasts(spark, folder):
    made = strategies.deep_analysis(prices(spark, folder), signals(spark, folder))
    return rounded(made)


@query
def sentiment_asof(spark, folder):
    joined = strategies.with_sentiment(prices(spark, folder), snapshots(spark, folder))
    return rounded(joined.select("symbol", "ts", "trade_id", "snap_ts", "score", "n"))


@query
def verdict_runs(spark, folder):
    rows = strategies.with_sentiment(features(spark, folder), snapshots(spark, folder))
    runs = strategies.verdict_runs(rows)
    return runs.select("symbol", "ts", "trade_id", "snap_ts", "head")


@query
def sentiment_forecasts(spark, folder):
    """Authored verdicts, neutral for the symbol that has none."""
    made = strategies.sentiment_verdicts(prices(spark, folder), signals(spark, folder))
    return rounded(made)


def reading_model(prompts: pd.Series) -> pd.Series:
    """A model that reads its numbers out of the prompt, and gives no answer at every fifth RSI."""
    return pd.Series([read_prompt(p) for p in prompts], dtype=object)


def read_prompt(prompt: str) -> str:
    found = re.search(r"from (\d+) messages .*RSI (\d+),", prompt)
    n, rsi = int(found[1]), int(found[2])
    if rsi % 5 == 3:
        return "no idea"
    return f'It looks so: {{"yhat": {(rsi - 50) / 997}, "confidence": "{n % 13 / 10}"}}'


@query
def model_forecasts(spark, folder):
    """Verdicts of a model, asked once per run of equal readings, and again after a failed answer."""
    given = strategies.Signals(sentiment=snapshots(spark, folder), model=reading_model)
    made = strategies.sentiment_verdicts(cut(features(spark, folder)), given)
    return rounded(made)


@query
def edge_forecasts(spark, folder):
    """The classifier's forecast rule over a probability made from the traded volume."""
    edge = F.col("volume") / 99.0 - 0.5
    return rounded(A.ticks(spark, folder).select(
        "symbol", "ts", "trade_id", strategies.edge_return(edge).alias("yhat"),
        strategies.edge_confidence(edge).alias("confidence"),
    ))


@query
def clamped_forecasts(spark, folder):
    lean = (F.col("volume") - 50.0) / 300.0
    return rounded(A.ticks(spark, folder).select(
        "trade_id",
        scoring.clamp(lean, -strategies.FAST_CAP, strategies.FAST_CAP).alias("fast"),
        scoring.clamp(lean, -strategies.DEEP_CAP, strategies.DEEP_CAP).alias("deep"),
        scoring.clamp(F.col("volume") / 50.0, 0.0, 1.0).alias("confidence"),
    ))


@query
def ensemble_forecasts(spark, folder):
    made = strategies.ensemble(cut(features(spark, folder)), signals(spark, folder))
    return rounded(made)


@query
def strategy_union(spark, folder):
    return rounded(
        all_forecasts(spark, folder).groupBy("strategy_id", "symbol").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("confidence").alias("confidence"),
            F.max("ts").alias("last_ts"),
        ), 4,
    )


def half_failing(rows: pd.DataFrame) -> pd.DataFrame:
    """A strategy that cannot take trades whose number ends in 0."""
    if (rows["trade_id"].to_numpy() % 10 == 0).any():
        raise ValueError("a number ends in 0")
    given = {c: rows[c].to_numpy() for c in ("symbol", "ts", "trade_id", "last_price")}
    return pd.DataFrame({**given, "horizon_s": 60, "yhat": given["last_price"] / 1000.0, "confidence": 0.5})


@query
def isolated_strategies(spark, folder):
    """A strategy that always fails and one that fails on some rows, beside one that does not."""
    own = {
        "half_failing": strategies.python_strategy("half_failing", half_failing),
        "failing": lambda rows, given: rows.select("no such column"),
    }
    with strategies.registered(own):
        made = strategies.forecasts(cut(features(spark, folder)), ["failing", "half_failing", "momentum"], strategies.Signals())
    return rounded(made)


@query
def feature_vectors(spark, folder):
    return rounded(features(spark, folder).select(
        "symbol", "ts", "trade_id", *learning.feature_values()
    ))


# ---- scoring ---------------------------------------------------------------------------------


@query
def scored_outcomes(spark, folder):
    return rounded(momentum_outcomes(spark, folder))


@query
def pending_forecasts(spark, folder):
    matched = evaluate.match_prices(momentum(spark, folder), prices(spark, folder))
    return evaluate.pending(matched).select("symbol", "ts", "trade_id", "target_ts")


@query
def outcome_metrics(spark, folder):
    scored = by_name(spark, folder)
    return rounded(scored.agg(*scoring.stats()), 5)


@query
def backtest_accuracy(spark, folder):
    return rounded(L.backtest(by_name(spark, folder)), 5)


@query
def standings(spark, folder):
    return rounded(L.standings(by_name(spark, folder)), 5)


@query
def ranked_standings(spark, folder):
    return rounded(L.ranked(L.standings(by_name(spark, folder))), 5)


@query
def rolling_accuracy(spark, folder):
    rolled = L.rolling(by_name(spark, folder), block_rows=5_000)
    return rounded(rolled.select(
        "strategy_id", "scored_ts", *OUTCOME_ORDER, "seq", "n", "dir_acc", "mean_confidence",
    ))


@query
def rolling_errors(spark, folder):
    rolled = L.rolling(by_name(spark, folder), window=50, block_rows=5_000)
    return rounded(rolled.select("strategy_id", "seq", "mae", "calibration_gap"), 4)


@query
def degradation_alerts(spark, folder):
    return L.alerts(by_name(spark, folder), block_rows=5_000)


@query
def newest_alerts(spark, folder):
    return live.newest_alerts(L.alerts(by_name(spark, folder), block_rows=5_000))


@query
def standings_snapshots(spark, folder):
    taken = L.snapshots(by_name(spark, folder), BY_NAME, block_rows=5_000)
    return rounded(taken.drop("mae", "calibration_gap"))


@query
def recent_outcomes(spark, folder):
    names = F.array(*[F.lit(n) for n in BY_NAME])
    place = F.array_position(names, F.col("strategy_id"))
    stored = by_name(spark, folder).withColumn("id", F.col("pred_trade_id") * 3 + place - 1)
    return rounded(lake.recent_outcomes(stored).select("id", "strategy_id", "scored_ts", "hit", "abs_error"))


# ---- lake and tables -------------------------------------------------------------------------


@query
def lake_routing(spark, folder):
    """Records of four topics; times are absent or 0 for some, so the fallbacks show."""
    kinds = F.array(*[F.lit(t) for t in ("features.out", "predictions.out", "scores.out", "trades.raw")])
    key = F.col("trade_id")
    records = A.ticks(spark, folder).select(
        F.get(kinds, (key % 4).cast("int")).alias("topic"),
        F.when(key % 11 != 0, F.col("symbol")).alias("symbol"),
        F.when(key % 3 == 0, F.lit(0)).when(key % 3 == 1, F.col("ts")).alias("ts"),
        F.when(key % 5 != 0, F.col("ts") + DAY_MS).alias("scored_ts"),
        (F.col("ts") - DAY_MS).alias("pred_ts"),
    )
    return lake.route(records).groupBy("dataset", "dt", "symbol").agg(F.count(F.lit(1)).alias("n"))


@query
def flattened_messages(spark, folder):
    sent = FX.as_message(features(spark, folder))
    return rounded(lake.flatten_features(sent).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.count("rsi").alias("with_rsi"), F.count("vwap").alias("with_vwap"),
        F.max("last_price").alias("top_price"),
    ))


@query
def lake_round_trip(spark, folder):
    """Write outcomes to the partitioned lake, read them with a fixed schema, and backtest."""
    root = scratch_folder(spark, "lake")
    scored = by_name(spark, folder).select(*evaluate.OUTCOME_COLUMNS)
    routed = lake.route(scored.withColumn("topic", F.lit("scores.out"))).drop("topic", "dataset")
    lake.write_dataset(routed, root, "outcomes")
    back = lake.read_dataset(spark, root, "outcomes", routed.schema)
    return rounded(back.groupBy("dt", "symbol", "strategy_id").agg(
        F.count(F.lit(1)).alias("n"), scoring.accuracy().alias("dir_acc")
    ))


@query
def snapshot_upserts(spark, folder):
    """Two writes per hour of the event stream; the later one of each hour stays."""
    log = A.ticks(spark, folder).select(
        (F.floor(F.col("ts") / F.lit(3_600_000)) * 3_600_000).alias("ts"),
        F.col("symbol").alias("standings"), F.col("trade_id").alias("written"),
    )
    return lake.keep_last(log, ["ts"], "written")


def _models(spark, folder):
    d = A.table(spark, folder, "orders")
    return d.select(
        F.col("o_orderstatus").alias("name"), (F.col("o_custkey") % 500).cast("string").alias("version"),
        F.col("o_orderkey").alias("created_ts"), F.lit("gbt").alias("kind"),
    )


@query
def model_registrations(spark, folder):
    have = _models(spark, folder).filter(F.col("created_ts") % 5 == 0).select("name", "version").distinct()
    return lake.new_models(_models(spark, folder), have)


@query
def expired_partitions(spark, folder):
    days = A.orders(spark, folder).groupBy(
        F.col("date").cast("string").alias("dt"), "symbol"
    ).agg(F.count(F.lit(1)).alias("n"))
    return lake.expired(days, AS_OF)


# ---- daily bars ------------------------------------------------------------------------------


def raw_bars(spark, folder):
    """Text bars with bad dates, bad numbers and missing cells."""
    key = F.col("_day")
    b = A.bars(spark, folder).withColumn("_day", F.unix_date("date"))
    cell = lambda c, gap: F.when(key % gap == 0, F.lit("n/a")).otherwise(F.format_string("%.6f", c))
    return b.select(
        "symbol",
        F.when(key % 29 == 0, F.lit("soon")).otherwise(F.col("date").cast("string")).alias("date"),
        cell("open", 3).alias("open"), cell("high", 5).alias("high"), cell("low", 7).alias("low"),
        F.when(key % 23 == 0, None).otherwise(F.format_string("%.6f", "close")).alias("close"),
        cell("volume", 2).alias("volume"),
    )


@query
def cleaned_bars(spark, folder):
    return rounded(B.clean(raw_bars(spark, folder)).withColumn("date", F.col("date").cast("string")))


@query
def bar_files(spark, folder):
    """The text bars written as one CSV folder per symbol, read back and cleaned."""
    path = scratch_folder(spark, "bars")
    names = ("Date", "Open", "High", "Low", "Close", "Volume")
    raw = raw_bars(spark, folder).select("symbol", *[F.col(n.lower()).alias(n) for n in names])
    raw.write.partitionBy("symbol").option("header", True).csv(path)
    back = B.clean(feeds.read_bar_files(spark, path))
    return rounded(back.withColumn("date", F.col("date").cast("string")))


@query
def bars_until(spark, folder):
    return rounded(B.until(A.bars(spark, folder), AS_OF).withColumn("date", F.col("date").cast("string")))


@query
def bars_between(spark, folder):
    kept = B.between(A.bars(spark, folder), "1997-01-01", "1997-12-31")
    return B.rounded(kept).withColumn("date", F.col("date").cast("string"))


@query
def bar_staleness(spark, folder):
    lags = A.bars(spark, folder).filter(F.length("symbol") % 2 == 0)
    old = A.bars(spark, folder).filter((F.length("symbol") % 2 == 1) & (F.col("date") < "1998-11-15"))
    both = B.until(lags.unionByName(old), AS_OF)
    return B.staleness(both, AS_OF).withColumn("latest", F.col("latest").cast("string"))


@query
def fresh_bars(spark, folder):
    old = A.bars(spark, folder).filter((F.length("symbol") % 2 == 0) | (F.col("date") < "1998-11-15"))
    kept = B.fresh(B.until(old, AS_OF), AS_OF)
    return kept.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


def indicated(spark, folder):
    return B.indicators(A.bars(spark, folder))


@query
def rolling_indicators(spark, folder):
    return rounded(indicated(spark, folder).select(
        "symbol", F.col("date").cast("string").alias("date"), "close_50_sma", "close_200_sma",
        "boll", "boll_ub", "boll_lb", "vwma", "mfi",
    ), 5)


@query
def recursive_indicators(spark, folder):
    return rounded(indicated(spark, folder).select(
        "symbol", F.col("date").cast("string").alias("date"), "close_10_ema", "macd", "macds",
        "macdh", "rsi", "atr",
    ), 5)


def _bar_symbols(spark, folder):
    return A.bars(spark, folder).select("symbol").distinct()


@query
def indicator_calendar(spark, folder):
    days = B.indicator_calendar(
        indicated(spark, folder), _bar_symbols(spark, folder), "close_50_sma", AS_OF, 400
    )
    return rounded(days.select(
        "symbol", F.col("date").cast("string").alias("date"), "number",
        F.when(F.col("number").isNull(), F.col("value")).alias("note"),
    ), 5)


@query
def indicator_on_date(spark, folder):
    one = B.indicator_on(indicated(spark, folder), _bar_symbols(spark, folder), "boll", AS_OF)
    return rounded(one.select("symbol", F.col("date").cast("string").alias("date"), "number"), 5)


@query
def last_bars(spark, folder):
    kept = B.last_bars(B.until(A.bars(spark, folder), AS_OF), 45)
    return rounded(kept.withColumn("date", F.col("date").cast("string")))


@query
def verified_snapshot(spark, folder):
    return B.verified_snapshot(indicated(spark, folder), AS_OF)


# ---- sentiment, news, macro, markets, statements ---------------------------------------------


@query
def message_counts(spark, folder):
    return sentiment.message_counts(A.messages(spark, folder))


@query
def message_lines(spark, folder):
    return sentiment.message_lines(A.messages(spark, folder))


@query
def sentiment_snapshots(spark, folder):
    counts = sentiment.message_counts(A.messages(spark, folder)).withColumn(
        "summary", sentiment.message_summary()
    )
    posts = F.when(F.col("total") % 2 == 0, F.lit("some posts"))
    return counts.select("symbol", *sentiment.snapshot(F.col("summary"), posts, F.col("last_ts"))).withColumn(
        "sources", F.array_join("sources", ",")
    )


@query
def source_report(spark, folder):
    posts = A.posts(spark, folder)
    wanted = posts.select("source").distinct().unionByName(
        A.table(spark, folder, "region").select(F.col("r_name").alias("source"))
    )
    return sentiment.source_report(posts, wanted).select(
        "source", "n", F.size(F.split("block", "\n\\[")).alias("lines"), F.substring("block", 1, 12).alias("start"),
    )


@query
def newest_posts(spark, folder):
    kept = sentiment.newest(
        A.posts(spark, folder), ["source"],
        [F.col("published").desc_nulls_last(), F.col("post_id").asc()], sentiment.POST_LIMIT,
    )
    return kept.select("source", "post_id", "published", text.excerpt(F.col("body"), 240).alias("excerpt"))


def extracted(spark, folder):
    return A.articles(spark, folder).select("query", "position", *news.article_fields("article"))


def keyed(spark, folder):
    rows = A.articles(spark, folder)
    return rows.select(
        "query", "position", *news.article_fields("article"), news.title_key("article").alias("title_key")
    )


@query
def article_fields(spark, folder):
    return extracted(spark, folder)


@query
def articles_by_title(spark, folder):
    return news.first_by_title(keyed(spark, folder)).select("query", "position", "title")


@query
def first_articles(spark, folder):
    """The first articles in de-dup order, then those of them inside the window."""
    kept = news.first_articles(news.first_by_title(keyed(spark, folder)), 100)
    start, end, now = (F.lit(x) for x in (1_704_412_800, 1_706_140_800, 1_706_227_200))
    return kept.filter(news.in_window(F.col("published"), start, end, now)).select(
        "query", "position", "published"
    )


@query
def news_window(spark, folder):
    start, end = F.lit(1_704_412_800), F.lit(1_706_140_800)
    live_now, later = F.lit(1_706_227_200), F.lit(1_900_000_000)
    published = F.col("published")
    return extracted(spark, folder).select(
        "position",
        news.in_window(published, start, end, live_now).alias("in_live_window"),
        news.in_window(published, start, end, later).alias("in_past_window"),
    )


@query
def macro_change(spark, folder):
    return rounded(macro.change(macro.observations(A.macro(spark, folder))), 5)


@query
def macro_recent(spark, folder):
    return macro.recent(macro.observations(A.macro(spark, folder))).select("series_id", "date", "value")


NOW = "2030-01-01 00:00:00+00:00"


@query
def open_markets(spark, folder):
    rows = markets.explode_markets(A.market_events(spark, folder))
    open_ = markets.is_forward_looking(F.lit(NOW).cast("timestamp"))
    return rows.filter(open_).select("topic", "event_pos", "market_pos", "question", "volumeNum")


@query
def top_markets(spark, folder):
    rows = markets.explode_markets(A.market_events(spark, folder))
    return rounded(markets.top_markets(rows, F.lit(NOW).cast("timestamp"), per=["topic"]))


@query
def top_markets_overall(spark, folder):
    rows = markets.explode_markets(A.market_events(spark, folder)).withColumn(
        "event_pos",
        F.col("event_pos") + 1000 * F.regexp_extract("topic", r"(\d+)", 1).cast("int"),
    )
    return rounded(markets.top_markets(rows, F.lit(NOW).cast("timestamp"), 25))


@query
def reports_until(spark, folder):
    kept = statements.reports_until(A.quarterly_reports(spark, folder), AS_OF)
    return kept.select(
        "symbol", F.size("reports").alias("n"),
        F.get("reports", F.size("reports") - 1)["fiscalDateEnding"].alias("last"),
    )


@query
def statement_periods(spark, folder):
    years = [str(y) for y in range(1995, 2002)]
    wide = A.orders(spark, folder).withColumn("y", F.year("date").cast("string")).groupBy("symbol").pivot(
        "y", years
    ).agg(F.round(F.sum("o_totalprice"), 2))
    named = wide.select("symbol", *[F.col(f"`{y}`").alias(f"{y}-12-31") for y in years])
    return rounded(statements.periods_until(statements.statement_long(named, ["symbol"]), AS_OF), 2)


@query
def statement_display(spark, folder):
    years = [f"{y}-12-31" for y in range(1995, 1999)]
    long = A.orders(spark, folder).groupBy(
        "symbol", F.concat(F.year("date"), F.lit("-12-31")).alias("period")
    ).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    wide = statements.statement_wide(statements.periods_until(long, "1998-12-31"), ["symbol"], years)
    return rounded(wide.select("symbol", *[F.col(f"`{y}`").alias(f"y{y[:4]}") for y in years]), 2)


@query
def fundamentals_overview(spark, folder):
    info = A.table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("symbol"), F.col("c_name").alias("longName"),
        F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("sector"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey") * 1000).alias("marketCap"),
        F.when(F.col("c_custkey") % 5 == 0, F.col("c_nationkey")).alias("beta"),
    )
    return statements.overview(info)


def _vendors(spark, folder):
    b = A.bars(spark, folder).withColumn("date", F.col("date").cast("string"))
    first = b.filter(F.col("symbol").startswith("1") | F.col("symbol").startswith("2"))
    second = b.filter(~F.col("symbol").startswith("5"))
    return _bar_symbols(spark, folder), [("first", first), ("second", second)]


@query
def vendor_fallback(spark, folder):
    wanted, chain = _vendors(spark, folder)
    served = vendors.first_vendor(wanted, chain)
    return served.groupBy("symbol", "vendor").agg(F.count(F.lit(1)).alias("n"))


@query
def vendor_no_data(spark, folder):
    wanted, chain = _vendors(spark, folder)
    return vendors.no_data(wanted, vendors.first_vendor(wanted, chain))


# ---- text and names --------------------------------------------------------------------------


def briefings(spark, folder):
    """Conversation turns as model replies: some with a verdict, nested or broken JSON."""
    key = F.col("conv_id") * 10 + F.col("turn")
    verdict = F.format_string(
        '{"stance": "bullish", "yhat": %.2f, "confidence": %.1f}', (key % 40 - 20) / 100.0, (key % 15) / 10.0
    )
    tail = (
        F.when(key % 4 == 0, F.concat(F.lit(' {"draft": true} \n\n'), verdict))
        .when(key % 4 == 1, F.concat(F.lit(' {"outer": '), verdict, F.lit(", broken {")))
        .when(key % 4 == 2, F.concat(F.lit(" {not json} "), verdict, F.lit("  \n")))
        .otherwise(F.lit(" no verdict {"))
    )
    return A.table(spark, folder, "conversations").select(
        "conv_id", "turn", key.cast("string").alias("symbol"),
        F.concat("text", tail).alias("briefing"),
    )


@query
def last_json(spark, folder):
    return briefings(spark, folder).select(
        "conv_id", "turn", text.last_json_object(F.col("briefing")).alias("verdict")
    )


@query
def deep_views(spark, folder):
    rows = briefings(spark, folder)
    return rounded(deep.views_from_briefings(rows, F.lit(0)).withColumn(
        "briefing_md", F.md5(F.col("briefing_md"))
    ))


@query
def deep_context(spark, folder):
    names = A.ticks(spark, folder).select("symbol").distinct().unionByName(
        A.table(spark, folder, "region").select(F.col("r_name").alias("symbol"))
    )
    latest = FX.latest_features(features(spark, folder))
    snaps = snapshots(spark, folder)
    newest = snaps.groupBy("symbol").agg(F.max_by(F.struct(*snaps.columns), "ts").alias("s")).select("s.*")
    titles = A.table(spark, folder, "region").select(
        F.col("r_name").alias("symbol"), F.when(F.col("r_regionkey") > 1, F.col("r_name")).alias("news")
    )
    return rounded(deep.context(names, latest, newest, titles).select(
        "symbol", "price_summary", F.col("sentiment.score").alias("score"), F.col("sentiment.n").alias("n"), "news"
    ))


@query
def deep_analysis_default(spark, folder):
    """The four-step analysis of every symbol with the default model."""
    names = A.ticks(spark, folder).select("symbol").distinct()
    latest = FX.latest_features(features(spark, folder))
    snaps = snapshots(spark, folder)
    newest = snaps.groupBy("symbol").agg(F.max_by(F.struct(*snaps.columns), "ts").alias("s")).select("s.*")
    ctx = deep.context(names, latest, newest, names.withColumn("news", F.lit("")))
    return rounded(deep.analyze(ctx, F.lit(0)))


def noting_model(prompts: pd.Series) -> pd.Series:
    """A model whose notes are digests of their prompts, and whose verdict comes from the digest of all notes."""
    digest = prompts.map(lambda p: hashlib.md5(p.encode()).hexdigest())
    number = lambda a, b: digest.str[a:b].map(lambda x: int(x, 16))
    verdict = '{"stance": "bearish", "yhat": ' + ((number(0, 4) % 41 - 20) / 100).astype(str)
    verdict += ', "confidence": "' + (number(4, 8) % 13 / 10).astype(str) + '"}'
    return digest.where(~prompts.str.contains("Weigh them"), "On " + digest + ". " + verdict)


@query
def deep_analysis(spark, folder):
    """The four steps with a model that answers from its prompts, so each prompt shows in the view."""
    latest = FX.latest_features(features(spark, folder))
    names = A.ticks(spark, folder).select("symbol").distinct().unionByName(
        A.table(spark, folder, "region").select(F.col("r_name").alias("symbol"))
    )
    newest = snapshots(spark, folder).withColumn("sources", F.array(F.lit("a"), F.lit("b")))
    newest = newest.groupBy("symbol").agg(F.max_by(F.struct(*newest.columns), "ts").alias("s")).select("s.*")
    titles = A.table(spark, folder, "region").select(
        F.col("r_name").alias("symbol"), F.when(F.col("r_regionkey") > 1, F.col("r_name")).alias("news")
    )
    ctx = deep.context(names, latest, newest, titles)
    return rounded(deep.analyze(ctx, F.lit(0), noting_model))


@query
def page_text(spark, folder):
    return A.table(spark, folder, "pages").select(
        "page_id", text.html_to_text(F.col("html")).alias("text")
    )


@query
def marked_page_text(spark, folder):
    """Only what lies between the body markers counts when both are present."""
    marked = F.concat(F.lit("<p>before</p><!-- SC_OFF -->"), F.col("html"), F.lit("<!-- SC_ON --> after"))
    html = F.when(F.col("page_id") % 2 == 0, marked).otherwise(F.col("html"))
    return A.table(spark, folder, "pages").select(
        "page_id", F.length(text.html_to_text(html)).alias("n"),
        F.substring(text.html_to_text(html), 1, 6).alias("start"),
    )


@query
def summary_labels(spark, folder):
    counts = sentiment.message_counts(A.messages(spark, folder)).select(
        "symbol", sentiment.message_summary().alias("summary")
    )
    return counts.select(
        "symbol", text.labelled_count(F.col("summary"), "Bullish").alias("bull"),
        text.labelled_count(F.col("summary"), "Bearish").alias("bear"),
        text.labelled_count(F.col("summary"), "Neutral").alias("absent"),
    )


@query
def iso_times(spark, folder):
    shape = lambda pattern: F.date_format(F.col("ts"), pattern)
    stamp = shape("yyyy-MM-dd'T'HH:mm:ss")
    forms = [
        F.concat(stamp, F.lit("Z")), F.concat(stamp, F.lit("+02:00")), F.lit("yesterday"), shape("yyyy"), shape("yyyy-MM"), shape("HH:mm"),
        shape("yyyyMMdd'T'HHmmss"), shape("yyyy-MM-dd HH:mm:ss.SSS"), F.concat(shape("yyyy-MM-dd'T'HH:mm"), F.lit("-0130")), shape("yyyy-MM-dd"),
    ]
    shown = F.get(F.array(*forms), F.col("event_id") % len(forms))
    return A.table(spark, folder, "events").select("event_id", text.iso_epoch(shown).alias("epoch"))


@query
def excerpts(spark, folder):
    return A.table(spark, folder, "documents").select("doc_id", text.excerpt(F.col("text"), 280).alias("excerpt"))


def raw_symbols(spark, folder):
    """Instrument names as users type them, built from customer keys."""
    key = F.col("c_custkey")
    bases = F.array(*[F.lit(x) for x in ("btc", "ETH-", "sol", "zzz", "DOGE", "xau", "SPX500", " eur", "usd", "AA.B", "bad$")])
    quotes = F.array(*[F.lit(x) for x in ("usd", "USDT", "-usdc", "jpy ", "", "+", "EUR")])
    raw = F.concat(F.get(bases, (key % 11).cast("int")), F.get(quotes, (key % 7).cast("int")))
    return A.table(spark, folder, "customer").select(key.alias("key"), raw.alias("raw"))


@query
def normalized_symbols(spark, folder):
    s = symbols.normalize_symbol(F.col("raw"))
    return raw_symbols(spark, folder).select("key", "raw", s.alias("symbol"), symbols.is_allowed_symbol(s).alias("allowed"))


@query
def macro_series_ids(spark, folder):
    key = F.col("p_partkey")
    asked = F.array(*[F.lit(x) for x in ("CPI", "10y treasury", " Fed-Funds ", "dgs5", "bank of japan rate", "", "m2", "x" * 31)])
    raw = F.get(asked, (key % 8).cast("int"))
    return A.table(spark, folder, "part").select("p_partkey", symbols.resolve_series(raw).alias("series_id"))


@query
def connector_symbols(spark, folder):
    pairs = F.array(*[F.lit(x) for x in ("BTCUSDT", "ETHUSDT", "SOLUSDT")])
    rows = A.ticks(spark, folder).select(
        F.get(pairs, (F.col("trade_id") % 3).cast("int")).alias("symbol"), "trade_id"
    )
    return symbols.with_connectors(rows, symbols.connectors(spark))


@query
def json_lists(spark, folder):
    rows = markets.explode_markets(A.market_events(spark, folder))
    return rows.select("topic", "question", F.size(text.json_list(F.col("outcomes"))).alias("n_outcomes"),
                       F.get(text.json_list(F.col("outcomePrices")), F.lit(0)).alias("first_price"))


# ---- learning --------------------------------------------------------------------------------


def training_rows(spark, folder):
    return learning.labelled(features(spark, folder), block_rows=2_000)


@query
def training_labels(spark, folder):
    return training_rows(spark, folder).select("symbol", "ts", "trade_id", "label")


@query
def pooled_folds(spark, folder):
    names = ["view", "click", "purchase", "signup", "error"]
    indexed = cut(learning.pooled_index(training_rows(spark, folder), names))
    return learning.with_fold(indexed, indexed.count()).select("symbol", "ts", "trade_id", "pos", "fold")


@query
def walk_forward_folds(spark, folder):
    """What each expanding fold trains on and tests, without the fit."""
    names = ["view", "click", "purchase", "signup", "error"]
    indexed = cut(learning.pooled_index(training_rows(spark, folder), names).select("pos", "label"))
    return learning.fold_sizes(indexed, indexed.count())


@query
def chronological_index(spark, folder):
    names = ["view", "click", "purchase", "signup", "error"]
    indexed = learning.pooled_index(training_rows(spark, folder), names, "chronological")
    return indexed.select("symbol", "ts", "trade_id", "pos")


@query
def walk_forward_accuracy(spark, folder):
    """Five expanding folds, each with a fit of its own."""
    names = ["view", "click", "purchase", "signup", "error"]
    indexed = learning.pooled_index(training_rows(spark, folder), names)
    return learning.walk_forward(indexed)


@query
def classifier_forecasts(spark, folder):
    ready = cut(features(spark, folder))
    model = learning.fit(learning.labelled(ready))
    return strategies.classifier(ready, strategies.Signals(classifier=model))


# ---- live views ------------------------------------------------------------------------------


@query
def latest_forecasts(spark, folder):
    return rounded(live.latest_forecasts(all_forecasts(spark, folder)))


@query
def price_history(spark, folder):
    made = A.ticks(spark, folder).select("symbol", "ts", "trade_id", F.floor("price").cast("double").alias("ref_price"))
    return live.price_history(made)


# ---- streams ---------------------------------------------------------------------------------


def replayed(spark: SparkSession, rows: DataFrame, by: str, limit: int = REPLAY_ROWS) -> DataFrame:
    """``rows`` as a file stream in the order of ``by``, a file of about ``limit`` rows in each micro-batch.

    What the stateful steps hold at once is then bounded, however large the table is. Rows of equal
    ``by`` share a file.
    """
    path = scratch_folder(spark, "replay")
    lake.write_in_order(rows, path, by, limit)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def tick_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a file stream of ticks, in order of time."""
    return replayed(spark, A.ticks(spark, folder), "ts")


@contextmanager
def keyed_state(spark: SparkSession, rows: int | None = None):
    """The state store that the stateful steps need, for the streams started inside.

    Every micro-batch opens and commits all state partitions, however few rows it has. Where
    micro-batches are bounded to about ``rows`` rows, the partitions follow them and not the size of the table.
    """
    provider, partitions = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"
    before = {k: spark.conf.get(k) for k in (provider, partitions)}
    spark.conf.set(provider, ROCKSDB)
    if rows is not None:
        spark.conf.set(partitions, min(int(before[partitions]), max(1, -(-rows // STATE_ROWS))))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def drained(spark: SparkSession, stream: DataFrame, rows: int | None = REPLAY_ROWS) -> DataFrame:
    """Run a stream over what its source holds now and return what it wrote.

    Output and stream checkpoint go to the shared checkpoint folder. ``rows`` are those of a
    micro-batch, None where they are not bounded.
    """
    base = scratch_folder(spark, "stream")
    with keyed_state(spark, rows):
        writer = jobs.to_table(stream, f"{base}/out", f"{base}/checkpoint")
        writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def restarted(
    spark: SparkSession, rows: DataFrame, by: str, parts: int, job: Callable[[DataFrame, str], DataStreamWriter]
) -> None:
    """Bring ``rows`` to a job in ``parts`` slices of ``by``, ending and restarting it between them.

    ``job`` takes the stream and the folder of its checkpoint.
    """
    base = scratch_folder(spark, "slices")
    rows = stored(rows, "sliced")
    low, high = rows.agg(F.min(by), F.max(by)).first()
    place = F.lit(0)
    if low is not None:
        place = F.floor((F.col(by) - F.lit(low)) * parts / F.lit(high - low + 1))
    with keyed_state(spark, REPLAY_ROWS):
        for i in range(parts):
            lake.write_in_order(rows.where(place == i), f"{base}/in", by, REPLAY_ROWS)
            stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
            job(stream, f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()


@query
def stream_dedup(spark, folder):
    """Every trade arrives again eleven places later."""
    arrival = F.explode(F.array(F.col("trade_id") * 2, F.col("trade_id") * 2 + 11))
    twice = replayed(spark, A.ticks(spark, folder).withColumn("arrival", arrival), "arrival")
    return drained(spark, jobs.dedup(twice)).select("symbol", "trade_id", "price")


@query
def stream_features(spark, folder):
    return rounded(drained(spark, jobs.features(tick_stream(spark, folder))))


def stream_scored(spark: SparkSession, folder: str) -> DataFrame:
    ticks = tick_stream(spark, folder)
    made = ticks.select(
        "symbol", "ts", "trade_id", F.lit(HORIZON).alias("horizon_s"),
        ((F.col("volume") - 50.0) / 997.0).alias("yhat"),
        (F.col("volume") / 100.0).alias("confidence"), F.lit("volume_up").alias("strategy_id"),
        F.lit("v0").alias("model_ver"), F.col("price").alias("ref_price"),
    )
    return jobs.outcomes(made, ticks.withColumnRenamed("price", "last_price"))


@query
def stream_outcomes(spark, folder):
    return rounded(drained(spark, stream_scored(spark, folder)))


@query
def stream_standings(spark, folder):
    """Two stateful steps in one stream: scores, then rolling standings of the strategy."""
    rows = drained(spark, jobs.leaderboard(stream_scored(spark, folder)))
    return rounded(rows.select("strategy_id", "scored_ts", "seq", "n", "dir_acc", "mean_confidence"))


@query
def stream_forecasts(spark, folder):
    """Ticks to features to a model's forecasts, two stateful steps, with snapshots in the same replay.

    One stream brings both, so that a snapshot comes in the micro-batch of its time.
    """
    ticks, taken = A.ticks(spark, folder), snapshots(spark, folder)
    is_snapshot = lambda flag: F.lit(flag).alias("is_snapshot")
    both = ticks.select("*", is_snapshot(False)).unionByName(taken.select("*", is_snapshot(True)), allowMissingColumns=True)
    stream = replayed(spark, both, "ts")
    rows = jobs.features(stream.where("NOT is_snapshot").select(*ticks.columns))
    seen = stream.where("is_snapshot").select(*taken.columns)
    return rounded(drained(spark, jobs.verdict_forecasts(rows, seen, reading_model)))


@query
def stream_sentiment(spark, folder):
    """The last counts of each symbol, over its newest messages."""
    schema = A.table(spark, folder, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{folder}/events.parquet*")
    counts = drained(spark, jobs.message_counts(A.as_messages(events)), rows=None)
    last = counts.groupBy("symbol").agg(F.max_by(F.struct(*counts.columns), "updates").alias("last")).select("last.*")
    return sentiment.with_shares(last.drop("updates"))


@query
def stream_latest_features(spark, folder):
    """The latest-value table after five runs of the job, merged at every second batch."""
    path = scratch_folder(spark, "latest")
    restarted(
        spark, A.ticks(spark, folder), "ts", 5,
        lambda ticks, at: jobs.latest_table(jobs.features(ticks), path, at, merge_every=2),
    )
    return rounded(jobs.read_latest(spark, path))


@query
def stream_seeded_standings(spark, folder):
    """Standings of a job that starts from the stored first half of the outcomes, and is restarted once."""
    scored = stored(by_name(spark, folder).select("strategy_id", "hit", "abs_error", "confidence", *L.SCORING_ORDER))
    low, high = scored.agg(F.min("scored_ts"), F.max("scored_ts")).first()
    half = 0 if low is None else (low + high) // 2
    path = scratch_folder(spark, "standings")
    restarted(
        spark, scored.where(F.col("scored_ts") >= half), "scored_ts", 2,
        lambda fresh, at: jobs.to_table(jobs.leaderboard(fresh, scored.where(F.col("scored_ts") < half)), path, at),
    )
    rows = spark.read.schema(STANDING_ROW).parquet(path)
    return rounded(rows.select("strategy_id", "scored_ts", "seq", "n", "dir_acc", "mean_confidence"))


@query
def stream_alerts(spark, folder):
    """Alerts kept by the sink of a leaderboard job that was restarted twice."""
    base = scratch_folder(spark, "alerts")

    def job(scored: DataFrame, at: str) -> DataStreamWriter:
        keep = jobs.alerts_to_table(f"{base}/alerts")
        return jobs.standings_and_alerts(jobs.leaderboard(scored), f"{base}/standings", keep, at)

    scored = by_name(spark, folder).select("strategy_id", "hit", "abs_error", "confidence", *L.SCORING_ORDER)
    restarted(spark, scored, "scored_ts", 3, job)
    return lake.read_batches(spark, f"{base}/alerts", "symbol string, kind string, severity string, message string, ts bigint")


@query
def appended_outcomes(spark, folder):
    """Outcomes appended in three numbered batches, each of them tried twice."""
    path = scratch_folder(spark, "outcomes")
    scored = stored(momentum_outcomes(spark, folder))
    for batch in (0, 1, 2):
        for _ in ("first", "again"):
            lake.append_batch(scored.where(F.pmod("pred_trade_id", F.lit(3)) == batch), path, batch)
    return rounded(lake.read_batches(spark, path, scored.schema))


@query
def stream_trade_messages(spark, folder):
    """A topic replayed from files in three runs; every fourth message is delivered again in the next one."""
    sent = trade_messages(spark, folder).select(
        "key", "value", F.lit("trades").alias("topic"), (F.col("offset") % 3).cast("int").alias("partition"),
        "offset", F.timestamp_seconds(F.col("offset") + 1_700_000_000).alias("timestamp"), F.lit(0).alias("timestampType"),
    )
    sent = stored(sent, "topic")
    last = sent.agg(F.max("offset")).first()[0] or 0
    base = scratch_folder(spark, "replay")
    slice_ = F.floor(F.col("offset") * 3 / F.lit(last + 1))
    with keyed_state(spark):
        for i in range(3):
            again = (slice_ == i - 1) & (F.col("offset") % 4 == 0)
            sent.where((slice_ == i) | again).write.mode("append").parquet(f"{base}/topic")
            ticks = payloads.trades(payloads.each_once(payloads.read_topic_files(spark, f"{base}/topic", 2)))
            writer = jobs.to_table(ticks, f"{base}/ticks", f"{base}/checkpoint")
            writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(ticks.schema).parquet(f"{base}/ticks")
