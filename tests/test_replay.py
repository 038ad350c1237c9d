"""Tables replayed as streams: bounded micro-batches in order of time, and the work that small batches cost."""

import pandas as pd
import pytest
from test_streaming import TICK, drain, market, rounded

from marketgrade.operators import features, strategies
from marketgrade.plans import catalog
from marketgrade.sources import lake
from marketgrade.streaming import jobs


def test_files_are_bounded_and_taken_in_order(spark, tmp_path):
    rows = spark.createDataFrame([(i * 37 % 400 // 2,) for i in range(400)], "ts bigint")
    seen = []

    def note(batch, _):
        seen.append([r.ts for r in batch.collect()])

    stream = catalog.replayed(spark, rows, "ts", limit=50)
    drain(stream.writeStream.foreachBatch(note).option("checkpointLocation", str(tmp_path / "ckpt")))
    assert len(seen) >= 7 and max(map(len, seen)) <= 120
    assert sorted(sum(seen, [])) == sorted(r.ts for r in rows.collect())
    assert all(max(a) < min(b) for a, b in zip(seen, seen[1:], strict=False))


def test_appended_slices_keep_their_order(spark, tmp_path):
    path = str(tmp_path / "in")
    for part in (range(30), range(30, 60)):
        lake.write_in_order(spark.createDataFrame([(i,) for i in part], "ts bigint"), path, "ts", 10)
    assert spark.read.parquet(path).count() == 60 and len([n for n in lake.names_in(spark, path) if n.startswith("part-")]) >= 5


@pytest.mark.parametrize("limit", [80])
def test_replayed_features_equal_batch(spark, tmp_path, limit):
    ticks = spark.createDataFrame(market(), TICK).drop("arrival")
    stream = jobs.features(catalog.replayed(spark, ticks, "ts", limit))
    got = catalog.drained(spark, stream)
    expected = features.feature_rows(ticks, width=20_000)
    assert rounded(got, expected.columns) == rounded(expected, expected.columns)


@pytest.mark.parametrize("name", ["stream_dedup", "stream_standings", "stream_forecasts", "stream_alerts"])
def test_queries_do_not_depend_on_the_limit(spark, monkeypatch, name):
    folder = "/root/testdata/sf0.001"
    one = catalog.QUERIES[name](spark, folder)
    want = rounded(one, one.columns)
    small = catalog.replayed.__defaults__
    monkeypatch.setattr(catalog, "REPLAY_ROWS", 400)
    monkeypatch.setattr(catalog.replayed, "__defaults__", (400,) * len(small))
    many = catalog.QUERIES[name](spark, folder)
    assert rounded(many, many.columns) == want


def test_a_failing_batch_costs_few_calls_and_one_frame(spark):
    calls = []

    def predict(batch):
        calls.append(len(batch))
        if (batch["trade_id"] == 700).any():
            raise ValueError
        return batch.assign(horizon_s=60, yhat=0.1, confidence=0.5)

    class Table:
        def mapInPandas(self, run, schema):  # noqa: N802
            self.run = run
            raise InterruptedError

    table = Table()
    with pytest.raises(InterruptedError):
        strategies.python_strategy("mine", predict)(table, strategies.Signals())
    n = 1_000
    batch = pd.DataFrame({"symbol": "A", "ts": range(n), "trade_id": range(n), "last_price": 1.0, "rsi": 2.0})
    made = list(table.run(iter([batch])))
    assert len(made) == 1 and made[0]["trade_id"].tolist() == [i for i in range(n) if i != 700]
    assert len(calls) < 30


def test_registered_for_a_while():
    before = strategies.registered_ids()
    with strategies.registered({"mine": lambda rows, given: rows}):
        assert "mine" in strategies.registered_ids()
    assert strategies.registered_ids() == before


def test_reading_model_equals_columns():
    prompts = pd.Series([f"Crowd from {n} messages via x. RSI {rsi}, so" for n in (7, 26) for rsi in range(0, 101, 4)])
    found = prompts.str.extract(r"from (\d+) messages .*RSI (\d+),").astype("int64")
    reply = 'It looks so: {"yhat": ' + ((found[1] - 50) / 997).astype(str) + ', "confidence": "' + (found[0] % 13 / 10).astype(str) + '"}'
    assert catalog.reading_model(prompts).tolist() == reply.mask(found[1] % 5 == 3, "no idea").tolist()


def test_state_partitions_follow_the_rows_of_a_batch(spark):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, "600")
    try:
        with catalog.keyed_state(spark, catalog.REPLAY_ROWS):
            assert int(spark.conf.get(name)) <= 20
        with catalog.keyed_state(spark):
            assert spark.conf.get(name) == "600"
        assert spark.conf.get(name) == "600"
    finally:
        spark.conf.set(name, before)
