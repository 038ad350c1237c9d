"""The verdict memo and the newest messages: batch, stream and a plain loop agree for any split."""

import random
import sys

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from test_streaming import drain, read_batches, rounded, write_batches

from marketgrade.functions.text import verdict_of
from marketgrade.operators import sentiment, strategies
from marketgrade.streaming import jobs
from marketgrade.streaming.processors import VerdictMemo

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the models run in worker processes

ROW = (
    "symbol string, ts bigint, trade_id bigint, last_price double, ema_fast double, ema_slow double, "
    "vol double, rsi double"
)
SNAP = "symbol string, score double, n int, ts bigint, sources array<string>"


def market(n=160, seed=5):
    rng = random.Random(seed)
    rows, snaps, ts = [], [], 0
    for i in range(n):
        ts += rng.choice([0, 500, 2_000])
        rsi = rng.choice([None, 40.0, 41.0, 53.0, 58.0, 58.4, 63.0])
        rows.append((rng.choice("AAB"), ts, i, 100.0 + i, 10.0, 10.0, 0.25, rsi))
        if i % 25 == 3:
            snaps.append((rng.choice("AB"), rng.choice([0.5, -0.25]), rng.choice([7, 9]), ts, ["stocktwits"]))
    return rows, snaps


def picky(prompt):
    """The reply to a prompt; none for RSI 53, an error for 58."""
    rsi = int(prompt.split("RSI ")[1].split(",")[0])
    if rsi == 58 and "from 7" in prompt:
        raise ConnectionError(prompt)
    return None if rsi == 53 else '{"yhat": %s, "confidence": "0.5"} for sure' % (rsi / 2000)


def picky_model(prompts: pd.Series) -> pd.Series:
    return prompts.map(picky)


def plain_loop(rows, snaps):
    """Forecasts as one live process makes them, and the prompts' readings it asked about."""
    memo, out, asked = {}, [], []
    for symbol, ts, trade_id, price, _, _, _, rsi in sorted(rows, key=lambda r: (r[1], r[2])):
        known = [s for s in snaps if s[0] == symbol and s[3] <= ts]
        if not known:
            continue
        snap = max(known, key=lambda s: s[3])
        rsi = 50.0 if rsi is None else rsi
        key = (snap[3], round(snap[1], 1), round(rsi / 5.0))
        if memo.get(symbol, (None,))[0] != key:
            asked.append((symbol, key))
            try:
                reply = picky(f"from {snap[2]} messages. RSI {rsi:.0f}, ")
            except ConnectionError:
                reply = None
            if reply is None:
                continue
            memo[symbol] = (key, min(0.05, verdict_of(reply)[0]))
        out.append((symbol, ts, trade_id, round(memo[symbol][1], 7), price))
    return sorted(out), asked


def tables(spark):
    rows, snaps = market()
    unique = {(s[0], s[3]): s for s in snaps}  # one snapshot a symbol and time
    return rows, sorted(unique.values(), key=lambda s: s[3])


def test_batch_equals_a_plain_loop(spark):
    rows, snaps = tables(spark)
    given = strategies.Signals(sentiment=spark.createDataFrame(snaps, SNAP), model=picky_model, width=10_000)
    made = strategies.sentiment_verdicts(spark.createDataFrame(rows, ROW), given)
    got = made.select("symbol", "ts", "trade_id", F.round("yhat", 7), "ref_price")
    want, asked = plain_loop(rows, snaps)
    assert sorted(map(tuple, got.collect())) == want
    assert len(want) > 60 and len(asked) > len(set(asked))


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_stream_equals_a_plain_loop(spark, tmp_path, parts):
    rows, snaps = tables(spark)
    cuts = [rows[-1][1] * (i + 1) // parts for i in range(parts)]
    batch = lambda ts: sum(ts > c for c in cuts)
    for i in range(parts):
        for name, all_, at, schema in (("rows", rows, 1, ROW), ("snaps", snaps, 3, SNAP)):
            own = [r for r in all_ if batch(r[at]) == i]
            spark.createDataFrame(own, schema).coalesce(1).write.parquet(str(tmp_path / name / f"{i:03d}"))
    log = tmp_path / "asked"
    log.mkdir()

    def logged(prompts: pd.Series) -> pd.Series:
        with open(log / "prompts", "a") as out:
            out.writelines(p + "\n" for p in prompts)
        return prompts.map(picky)

    stream = jobs.verdict_forecasts(
        read_batches(spark, tmp_path / "rows", ROW), read_batches(spark, tmp_path / "snaps", SNAP), logged
    )
    drain(jobs.to_table(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")))
    made = spark.read.parquet(str(tmp_path / "out"))
    assert made.columns == strategies.FORECAST_COLUMNS
    want, asked = plain_loop(rows, snaps)
    assert sorted(map(tuple, made.select("symbol", "ts", "trade_id", F.round("yhat", 7), "ref_price").collect())) == want
    # A prompt is tried once more where the model raised.
    prompts = (log / "prompts").read_text().splitlines()
    raised = sum("RSI 58," in p and "from 7" in p for p in prompts)
    assert len(prompts) - raised // 2 == len(asked)


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_newest_messages_for_any_split(spark, tmp_path, parts):
    rng = random.Random(11)
    rows = [(rng.choice("AAAB"), rng.randrange(500), i, rng.choice(["Bullish", "Bearish", None, "x"])) for i in range(300)]
    schema = "symbol string, ts bigint, message_id bigint, label string"
    write_batches(spark, rows, tmp_path / "in", parts, schema)
    stream = jobs.message_counts(read_batches(spark, tmp_path / "in", schema))
    drain(jobs.to_table(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")))
    counts = spark.read.parquet(str(tmp_path / "out"))
    assert counts.count() == 2 * parts
    last = counts.where("updates = %d" % parts)
    want = sentiment.message_counts(spark.createDataFrame(rows, schema))
    columns = ["symbol", "bullish", "bearish", "total", "last_ts"]
    assert rounded(last, columns) == rounded(want, columns)


def test_verdict_of_reads_as_the_columns_do(spark):
    replies = [
        None, "", "no", '{"yhat": 0.1, "confidence": 0.2}', 'a {"yhat": "0.1", "confidence": 1} b', '{"yhat": 1}',
        '{"yhat": 1, "confidence": 1} then {"x": 2}', '{"yhat": "n/a", "confidence": 1}', '{"yhat": 1, "confidence": 1} {bad}',
        '{"yhat": 1, "yhat": 2, "confidence": 0}', '{"a": {"yhat": 3, "confidence": 0.5}}',
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, reply string")
    rows = df.select("i", strategies.parsed_verdict(F.col("reply"), 100.0).alias("v")).orderBy("i").collect()
    assert [None if r.v is None else tuple(r.v) for r in rows] == [verdict_of(r) for r in replies]


@pytest.mark.parametrize("raising", [False, True])
def test_memo_asks_many_prompts_at_once_but_no_others(raising):
    rng = random.Random(2)
    readings = [(0, 0.1, float(rng.randrange(3)), float(i // 700 + rng.randrange(12))) for i in range(6_000)]
    calls = []

    def reply(i):
        if raising and i % 977 == 500:
            raise ConnectionError
        return None if i % 5 == 2 else f'{{"yhat": {i % 89 / 2000}, "confidence": 0.5}}'

    def model(prompts: pd.Series) -> pd.Series:
        calls.append(prompts.astype(int).tolist())
        return prompts.map(lambda p: reply(int(p)))

    want, asked, memo = [], [], (readings[3], (0.01, 0.25))
    for i, reading in enumerate(readings):
        if memo[0] != reading:
            asked.append(i)
            got = None if i % 5 == 2 or raising and i % 977 == 500 else (i % 89 / 2000, 0.5)
            memo = memo if got is None else (reading, got)
        want.append(memo[1] if memo[0] == reading else None)
    made = VerdictMemo(strategies.Questions(model), 0.05)
    found, after = made._verdicts(readings, str, (*readings[3], 0.01, 0.25))
    assert found == want and after == (*memo[0], *memo[1])
    assert sorted({i for c in calls for i in c}) == asked and len(asked) > 4_000
    assert len(calls) < len(asked) / (2 if raising else 20)
    assert raising or sum(map(len, calls)) == len(asked)
