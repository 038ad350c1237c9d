"""Stores that streaming jobs write, when batches repeat and jobs restart; processors against plain loops."""

import random

from pyspark.sql import functions as F

from marketgrade.sources import lake, payloads
from marketgrade.streaming import jobs
from marketgrade.streaming import processors as P

ROW = "symbol string, ts bigint, trade_id bigint, price double"


class Slot:
    """State of one key in memory, with the calls that processors make."""

    def __init__(self):
        self.value, self.map, self.read = None, {}, 0

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def containsKey(self, key):  # noqa: N802
        return key in self.map

    def getValue(self, key):  # noqa: N802
        self.read += 1
        return self.map[key]

    def updateValue(self, key, value):  # noqa: N802
        self.map[key] = value

    def removeKey(self, key):  # noqa: N802
        del self.map[key]


def scorer(bucket_ms):
    made = P.ForecastScorer(bucket_ms=bucket_ms)
    made.buckets, made.index = Slot(), Slot()
    return made


def forecasts_and_ticks(n, seed):
    import pandas as pd

    rng, rows, ts = random.Random(seed), [], 0
    for i in range(n):
        ts += rng.choice([0, 300, 2_000])
        if rng.random() < 0.5:
            rows.append(("A", ts, i, True, round(rng.uniform(90, 110), 1), None, None, None, None, None, None))
        else:
            rows.append(("A", ts, i, False, None, rng.choice([0, 1, 5, 60]), 0.01, 0.5, "s", "v0", rng.choice([0.0, 100.0])))
    return pd.DataFrame(rows, columns=[f.name for f in P.FORECAST_OR_TICK.fields])


def plain_scores(rows):
    made = []
    ticks = rows[rows.is_tick].sort_values(["ts", "trade_id"])
    for call in rows[~rows.is_tick].itertuples():
        due = call.ts + int(call.horizon_s) * 1000
        after = ticks[ticks.ts >= due]
        if len(after):
            made.append((call.trade_id, int(after.iloc[0].trade_id)))
    return sorted(made)


def test_scores_do_not_depend_on_batches_or_buckets():
    rows = forecasts_and_ticks(300, 5)
    expected = plain_scores(rows)
    assert len(expected) > 100
    for parts in (1, 3, 7, 50):
        for bucket_ms in (1, 1_000, 60_000, 10**9):
            made, got = scorer(bucket_ms), []
            # Rows of one time arrive together; inside a batch the order is by time.
            place = rows.ts.rank(method="dense").astype(int) * parts // (rows.ts.nunique() + 1)
            cuts = [piece for _, piece in rows.groupby(place)]
            for piece in cuts:
                for out in made.handleInputRows(("A",), iter([piece.sample(frac=1, random_state=1)]), None):
                    got += zip(out.pred_trade_id.tolist(), out.scored_trade_id.tolist(), strict=True)
            assert len(got) == len(set(got))
            assert {g[0] for g in got} == {e[0] for e in expected}
            assert sorted(got) == expected
            held = sum(len(v[0]) for v in made.buckets.map.values())
            assert held == (~rows.is_tick).sum() - len(expected)
            assert sorted(made.index.value[0] if made.index.value else []) == sorted(k[0] for k in made.buckets.map)


def test_a_batch_opens_only_due_buckets():
    rows = forecasts_and_ticks(200, 6)
    calls = rows[~rows.is_tick].assign(horizon_s=range(100, 100 + int((~rows.is_tick).sum())))
    made = scorer(1_000)
    list(made.handleInputRows(("A",), iter([calls]), None))
    before = len(made.buckets.map)
    tick = rows[rows.is_tick].head(1).assign(ts=int(calls.ts.min()) + 105_000)
    list(made.handleInputRows(("A",), iter([tick]), None))
    assert before > 50 and made.buckets.read < 20


def test_a_forecast_sent_again_while_it_waits_counts_once():
    rows = forecasts_and_ticks(40, 7)
    calls = rows[~rows.is_tick].assign(horizon_s=60)
    made, got = scorer(60_000), []
    for piece in (calls, calls.assign(yhat=0.5), rows[rows.is_tick].head(1).assign(ts=10**9)):
        for out in made.handleInputRows(("A",), iter([piece]), None):
            got += out.yhat.tolist()
    assert got == [0.5] * len(calls) and not made.buckets.map and made.index.value == ([],)


def test_latest_table_merges_restarts_and_repeats(spark, tmp_path):
    path, want = str(tmp_path / "latest"), {}
    rng = random.Random(1)
    source = tmp_path / "in"
    for i in range(8):
        rows = [(rng.choice("ABCDEF"), i * 10 + j, i * 10 + j, float(j)) for j in range(3)]
        want |= {r[0]: r for r in rows}
        spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(ROW).parquet(str(source))
        query = jobs.latest_table(stream, path, str(tmp_path / "ckpt"), merge_every=3).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        folders = [n for n in lake.names_in(spark, path) if n.startswith("batch=")]
        assert len(folders) <= 6
        got = {r.symbol: tuple(r) for r in jobs.read_latest(spark, path).collect()}
        assert got == want
    assert len(lake.names_in(spark, f"{path}/_merged")) <= 2


def test_a_repeated_append_counts_once(spark, tmp_path):
    rows = spark.range(10).withColumn("x", F.col("id") * 2)
    for batch in (0, 1, 1, 0):
        lake.append_batch(rows.where(F.col("id") % 2 == batch), str(tmp_path / "t"), batch)
    back = lake.read_batches(spark, str(tmp_path / "t"), rows.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_redelivered_messages_pass_once_and_late_start_skips(spark, tmp_path):
    made = [
        (None, bytearray(b"x"), "t", o % 2, o, 1_700_000_000 + o, 0) for o in range(20)
    ]
    schema = "key binary, value binary, topic string, partition int, offset bigint, s bigint, timestampType int"
    sent = spark.createDataFrame(made, schema).withColumn("timestamp", F.timestamp_seconds("s")).drop("s")
    for part in (sent.where("offset < 12"), sent.where("offset >= 8")):
        part.select(*[c.split()[0] for c in payloads.KAFKA_COLUMNS.split(", ")]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for name, since, count in (("all", None, 20), ("late", 1_700_000_015_000, 5)):
        rows = payloads.each_once(payloads.read_topic_files(spark, str(tmp_path / "in"), 1, since))
        query = jobs.to_table(rows, str(tmp_path / name), str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        back = spark.read.parquet(str(tmp_path / name))
        assert back.count() == count == back.select("partition", "offset").distinct().count()
