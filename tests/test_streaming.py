"""Streams agree with the batch operators for any split into micro-batches."""

import random

import pytest
from pyspark.sql import functions as F

from marketgrade.operators import evaluate, features, leaderboard, strategies
from marketgrade.operators.dedup import ascending_only
from marketgrade.sources.payloads import trades
from marketgrade.streaming import jobs

TICK = "symbol string, ts bigint, trade_id bigint, price double, volume double, arrival bigint"


def market(n=240, seed=3):
    rng = random.Random(seed)
    rows, ts = [], 0
    for i in range(n):
        ts += rng.choice([0, 400, 3_000])
        price = 0.0 if i % 37 == 5 else round(rng.uniform(90, 110), 2)
        rows.append((rng.choice("AAB"), ts, i, price, float(rng.choice([0, 1, 4])), i))
    return rows


def write_batches(spark, rows, folder, parts, schema):
    """One file per micro-batch, in order."""
    size = -(-len(rows) // parts)
    for i in range(parts):
        piece = rows[i * size : (i + 1) * size]
        if piece:
            spark.createDataFrame(piece, schema).coalesce(1).write.mode("append").parquet(
                f"{folder}/{i:03d}"
            )


def read_batches(spark, folder, schema):
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", 1)
        .option("latestFirst", False)
        .parquet(f"{folder}/*")
    )


def drain(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None


def rounded(df, columns):
    doubles = {n for n, t in df.dtypes if t == "double"}
    picked = [F.round(c, 7).alias(c) if c in doubles else F.col(c) for c in columns]
    return sorted(map(tuple, df.select(*picked).collect()), key=str)


@pytest.mark.parametrize("parts", [1, 3])
def test_features_agree_with_batch(spark, tmp_path, parts):
    rows = market()
    write_batches(spark, rows, tmp_path / "in", parts, TICK)
    stream = jobs.features(read_batches(spark, tmp_path / "in", TICK).drop("arrival"))
    drain(jobs.to_table(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")))
    got = spark.read.parquet(str(tmp_path / "out"))
    expected = features.feature_rows(spark.createDataFrame(rows, TICK), width=20_000)
    assert rounded(got, expected.columns) == rounded(expected, expected.columns)


def test_features_continue_after_restart(spark, tmp_path):
    rows = market()
    write_batches(spark, rows[:100], tmp_path / "in", 1, TICK)
    for more in (None, rows[100:]):
        if more:
            spark.createDataFrame(more, TICK).coalesce(1).write.parquet(str(tmp_path / "in" / "later"))
        stream = jobs.features(read_batches(spark, tmp_path / "in", TICK).drop("arrival"))
        drain(jobs.to_table(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")))
    got = spark.read.parquet(str(tmp_path / "out"))
    expected = features.feature_rows(spark.createDataFrame(rows, TICK))
    assert rounded(got, expected.columns) == rounded(expected, expected.columns)


def test_dedup_agrees_with_batch(spark, tmp_path):
    rows = market(60)
    rows = rows + [(s, ts, i, p, v, 60 + a) for s, ts, i, p, v, a in rows[20:50]]
    rows = rows + [("B", 10**6, 500, 1.0, 1.0, 200)]
    write_batches(spark, rows, tmp_path / "in", 3, TICK)
    stream = jobs.dedup(read_batches(spark, tmp_path / "in", TICK))
    drain(jobs.to_table(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")))
    got = spark.read.parquet(str(tmp_path / "out"))
    expected = ascending_only(spark.createDataFrame(rows, TICK), width=7)
    columns = ["symbol", "trade_id", "price"]
    assert rounded(got, columns) == rounded(expected, columns)
    assert expected.count() == 61


def forecast_rows(spark, rows):
    made = features.feature_rows(spark.createDataFrame(rows, TICK))
    return made, strategies.momentum(made, strategies.Signals(), horizon_s=20)


def test_scoring_and_leaderboard_agree_with_batch(spark, tmp_path):
    made, forecasts = forecast_rows(spark, market())
    expected = evaluate.outcomes(forecasts, made)

    priced = made.select("symbol", "ts", "trade_id", "last_price")
    price_rows = sorted(map(tuple, priced.collect()), key=lambda r: (r[1], r[2]))
    call_rows = sorted(map(tuple, forecasts.collect()), key=lambda r: (r[5], r[8]))
    write_batches(spark, call_rows, tmp_path / "calls", 3, forecasts.schema)
    write_batches(spark, price_rows, tmp_path / "prices", 3, priced.schema)
    scored = jobs.outcomes(
        read_batches(spark, tmp_path / "calls", forecasts.schema),
        read_batches(spark, tmp_path / "prices", priced.schema),
    )
    drain(jobs.to_table(scored, str(tmp_path / "scored"), str(tmp_path / "c1")))
    got = spark.read.parquet(str(tmp_path / "scored"))
    assert rounded(got, expected.columns) == rounded(expected, expected.columns)

    sent = []
    ranked = jobs.leaderboard(
        spark.readStream.schema(got.schema).parquet(str(tmp_path / "scored")), window=30
    )
    drain(
        jobs.standings_and_alerts(
            ranked, str(tmp_path / "ranked"), lambda df, _: sent.extend(df.collect()), str(tmp_path / "c2")
        )
    )
    rolled = leaderboard.rolling(expected, window=30, block_rows=40)
    columns = ["strategy_id", "seq", "n", "dir_acc", "mae", "mean_confidence", "calibration_gap"]
    standing = spark.read.parquet(str(tmp_path / "ranked"))
    assert rounded(standing, columns) == rounded(rolled.withColumn("n", F.col("n").cast("int")), columns)
    fired = leaderboard.alerts(expected, window=30, block_rows=40)
    assert sorted(a.message for a in sent) == sorted(a.message for a in fired.collect())


def outcome_row(i, hit):
    return ("A", "s", hit, 0.1, 0.5, 1_000 + i, i, i, i)


OUTCOME = (
    "symbol string, strategy_id string, hit boolean, abs_error double, confidence double, "
    "scored_ts bigint, scored_trade_id bigint, pred_ts bigint, pred_trade_id bigint"
)


def test_seeded_leaderboard_keeps_quiet_until_it_recovers(spark, tmp_path):
    stored = spark.createDataFrame([outcome_row(i, False) for i in range(12)], OUTCOME)
    fresh = [outcome_row(20 + i, i >= 2) for i in range(16)] + [outcome_row(60 + i, False) for i in range(12)]
    write_batches(spark, fresh, tmp_path / "in", 1, OUTCOME)
    stream = jobs.leaderboard(read_batches(spark, tmp_path / "in", OUTCOME), stored, window=20)
    drain(jobs.to_table(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")))
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()
    assert rows[0].seq == 12 and rows[0].n == 13 and rows[0].alert is None
    alerts = [r for r in rows if r.alert]
    assert len(alerts) == 1 and alerts[0].scored_ts >= 1_060


def test_seed_is_one_bounded_row_per_strategy(spark, tmp_path):
    rng = random.Random(4)
    hits = [rng.choice([True, False, None]) for _ in range(400)]
    rows = [outcome_row(i * 7919 % 400, hits[i * 7919 % 400]) for i in range(400)]
    stored = spark.createDataFrame([*rows, ("A", None, True, 0.2, 0.5, 5, 1, 1, 1)], OUTCOME).repartition(7)
    made = {r.strategy_id: r for r in jobs.seeds(stored, 20).collect()}
    assert made.keys() == {"s", None} and made["s"].seq == 400 and made[None].hits == [1.0]
    assert made["s"].hits == [None if h is None else float(h) for h in hits[-20:]]
    assert made["s"].errors == [0.1] * 20 and made["s"].confidences == [0.5] * 20
    # Seeded from the first part, the standings go on as if the stream had brought it.
    sure = [outcome_row(i, i % 3 > 0) for i in range(500)]
    seeded = spark.createDataFrame(sure[:400], OUTCOME)
    write_batches(spark, sure[400:], tmp_path / "rest", 2, OUTCOME)
    write_batches(spark, sure, tmp_path / "all", 1, OUTCOME)
    drain(jobs.to_table(jobs.leaderboard(read_batches(spark, tmp_path / "rest", OUTCOME), seeded, window=60), str(tmp_path / "a"), str(tmp_path / "ca")))
    drain(jobs.to_table(jobs.leaderboard(read_batches(spark, tmp_path / "all", OUTCOME), window=60), str(tmp_path / "b"), str(tmp_path / "cb")))
    got, want = spark.read.parquet(str(tmp_path / "a")), spark.read.parquet(str(tmp_path / "b")).where("seq >= 400")
    assert rounded(got, got.columns) == rounded(want, got.columns) and got.count() == 100


def test_trade_messages_decode_on_a_stream(spark, tmp_path):
    body = '{"s":"A","t":%d,"p":"1.5","q":"2","T":%d}'
    rows = [(bytearray(b"A"), bytearray((body % (i, i * 10)).encode()), i) for i in range(4)]
    rows.append((bytearray(b"A"), bytearray(b'{"stream":"x","data":{"s":"A","t":9,"p":"bad","q":"1","T":1}}'), 9))
    schema = "key binary, value binary, offset bigint"
    write_batches(spark, rows, tmp_path / "in", 1, schema)
    stream = trades(read_batches(spark, tmp_path / "in", schema))
    drain(jobs.to_table(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_latest_table_and_forecasts(spark, tmp_path):
    made, forecasts = forecast_rows(spark, market(80))
    rows = sorted(map(tuple, made.collect()), key=lambda r: (r[1], r[2]))
    write_batches(spark, rows, tmp_path / "in", 3, made.schema)
    stream = lambda: read_batches(spark, tmp_path / "in", made.schema)
    drain(jobs.latest_table(stream(), str(tmp_path / "latest"), str(tmp_path / "c1")))
    got = jobs.read_latest(spark, str(tmp_path / "latest"))
    expected = features.latest_features(made)
    assert rounded(got, expected.columns) == rounded(expected, expected.columns)
    given = lambda _: strategies.Signals(options={"momentum": {"horizon_s": 20}})
    drain(jobs.forecasts(stream(), ["momentum", "sentiment_llm"], given, str(tmp_path / "f"), str(tmp_path / "c2")))
    live = spark.read.parquet(str(tmp_path / "f"))
    assert rounded(live, forecasts.columns) == rounded(forecasts, forecasts.columns)


def test_sentiment_refresh(spark, tmp_path):
    rows = [("A", i, i, "Bullish" if i % 3 else "Bearish") for i in range(9)]
    schema = "symbol string, ts bigint, message_id bigint, label string"
    write_batches(spark, rows, tmp_path / "in", 1, schema)
    stream = read_batches(spark, tmp_path / "in", schema)
    drain(jobs.sentiment_refresh(stream, str(tmp_path / "out"), str(tmp_path / "c"), lambda: 77))
    row = spark.read.parquet(str(tmp_path / "out")).first()
    assert (row.score, row.n, row.ts) == (0.3333, 9, 77)
