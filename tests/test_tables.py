import pytest
from pyspark.sql import functions as F

from marketgrade.functions import symbols, text
from marketgrade.operators import bars, learning, live, macro, news, sentiment, statements, vendors
from marketgrade.schemas import decode, encode
from marketgrade.sources import feeds, lake, payloads


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_decode_ignores_unknown_fills_defaults_and_quarantines(spark):
    df = spark.createDataFrame(
        [('{"symbol":"A","horizon_s":60,"yhat":0.1,"confidence":1,"strategy_id":"m","ts":5,"later":1}',), ('{"symbol":"A"}',), ("junk",)],
        "value string",
    )
    good, bad = decode(df, "prediction")
    row = good.first()
    assert (row.model_ver, row.ref_price, row.ts) == ("v0", 0.0, 5) and bad.count() == 2
    again, _ = decode(encode(good, "prediction", "predictions.out"), "prediction")
    assert again.collect() == good.collect()


def test_klines_and_authored_signals(spark):
    k = spark.createDataFrame([("A", '[1,"2","3","4","5.5","6",7,"8",9,"10","11","12"]')], "symbol string, value string")
    assert tuple(payloads.klines(k).first()) == ("A", 7, 5.5, 6.0)
    files = spark.createDataFrame([('{"signals":{"A":{"sentiment":{"yhat":0.1,"confidence":0.5}},"B":{"deep":{"stance":"bearish","yhat":-0.1}}}}',)], "value string")
    got = {r.symbol: r for r in payloads.authored_signals(files).collect()}
    assert (got["A"].yhat, got["A"].stance, got["B"].stance, got["B"].confidence) == (0.1, "neutral", "bearish", 0.0)


def test_lake_keeps_text_partitions_and_expires(spark, tmp_path):
    rows = spark.createDataFrame(
        [("scores.out", "007", None, 86_400_000, True, 0.5), ("trades.raw", "007", 1, None, True, 0.5), ("scores.out", None, 0, 0, False, 0.1)],
        "topic string, symbol string, ts bigint, scored_ts bigint, hit boolean, abs_error double",
    )
    routed = lake.route(rows).drop("topic", "dataset")
    assert {(r.dt, r.symbol) for r in routed.collect()} == {("1970-01-02", "007"), ("1970-01-01", "UNKNOWN")}
    lake.write_dataset(routed, str(tmp_path), "outcomes")
    back = lake.read_dataset(spark, str(tmp_path), "outcomes", routed.schema)
    assert back.filter("dt = '1970-01-02'").first().symbol == "007"
    assert lake.expire_dataset(spark, str(tmp_path), "outcomes", "1970-04-02") == ["1970-01-01"]
    assert spark.read.schema(routed.schema).parquet(str(tmp_path / "outcomes")).count() == 1


def test_flattened_feature_wins_over_field(spark):
    df = spark.createDataFrame([("A", 1, {"vol": 2.0})], "symbol string, vol int, features map<string,double>")
    row = lake.flatten_features(df).first()
    assert (row.vol, row.rsi) == (2.0, None)


def test_tables_upsert_insert_and_recent(spark, tmp_path):
    standing = spark.createDataFrame([(5, "m", 3, 0.5)], "ts bigint, strategy_id string, n int, dir_acc double")
    path = str(tmp_path / "snap")
    lake.save_snapshots(standing, path, 1)
    lake.save_snapshots(standing.withColumn("n", F.lit(9)), path, 2)
    kept = lake.read_snapshots(spark, path).collect()
    assert len(kept) == 1 and '"n":9' in kept[0].standings
    models = spark.createDataFrame([("m", "1", 5), ("m", "1", 4), ("m", "2", 6)], "name string, version string, created_ts bigint")
    for _ in range(2):
        lake.register_models(models, str(tmp_path / "models"))
    stored = spark.read.parquet(str(tmp_path / "models"))
    assert sorted(tuple(r) for r in stored.select("version", "created_ts").collect()) == [("1", 4), ("2", 6)]
    outs = spark.createDataFrame([(i, i % 3) for i in range(9)], "id int, scored_ts bigint")
    assert [r.id for r in lake.recent_outcomes(outs, 4).collect()] == [7, 2, 5, 8]


def test_bar_and_atom_files(spark, tmp_path):
    folder = tmp_path / "bars" / "symbol=A"
    folder.mkdir(parents=True)
    (folder / "a.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-02,1,2,0.5,1.5,10\nbad line,1\n2024-01-03,1,2,0.5,,10\n")
    assert [r.date for r in feeds.read_bar_files(spark, str(tmp_path / "bars")).collect()] == ["2024-01-02"]
    (tmp_path / "feed.xml").write_text(
        '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><published>2024-01-01T00:00:10Z</published>'
        '<content type="html">&lt;p&gt;x &amp;amp; y&lt;/p&gt;</content></entry></feed>'
    )
    row = feeds.read_atom(spark, str(tmp_path / "feed.xml"), "s").first()
    assert (row.title, row.body, row.published) == ("T", "x & y", 1_704_067_210)


def test_clean_bars(spark):
    raw = spark.createDataFrame(
        [("A", "2020-12-31", None, "2", "1", "1.5", "9"), ("A", "2021-01-02", "7", "x", "1", "1.6", None), ("A", "never", "1", "1", "1", "1", "1"), ("A", "2021-01-03", "8", "4", "1", None, "1")],
        "symbol string, date string, open string, high string, low string, close string, volume string",
    )
    rows = bars.clean(raw, width=1).orderBy("date").collect()
    assert [(r.open, r.high, r.volume) for r in rows] == [(7.0, 2.0, 9.0), (7.0, 2.0, 9.0)]


def test_indicators_calendar_and_snapshot(spark):
    days = spark.range(40).select(
        F.lit("A").alias("symbol"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") * 2).cast("int")).alias("date"),
        *[(F.col("id") + 10.0).alias(c) for c in bars.PRICES],
    )
    made = bars.indicators(days, width=10, block_rows=200)
    rows = made.orderBy("date").collect()
    assert rows[0].close_50_sma == 10.0 and rows[0].rsi is None and rows[5].rsi == 100.0
    assert rows[39].boll == pytest.approx(sum(range(30, 50)) / 20) and rows[1].macd == pytest.approx(2 / 13 - 2 / 27)
    assert rows[3].atr > 0 and rows[3].mfi == 100.0 and rows[0].mfi is None
    cal = bars.indicator_calendar(made, days, "boll", "2024-01-04", 3).orderBy("date").collect()
    assert [r.value for r in cal] == ["10.000000", bars.NOT_TRADING, "10.500000", bars.NOT_TRADING]
    with pytest.raises(ValueError):
        bars.indicator_calendar(made, days, "nothing", "2024-01-04", 3)
    snap = {(r.section, r.field): r.value for r in bars.verified_snapshot(made, "2024-01-06", 99).collect()}
    assert snap[("latest", "date")] == "2024-01-05" and snap[("latest", "close")] == "12.00"
    assert len([k for k in snap if k[0] == "close"]) == 3
    stale = bars.staleness(days, "2024-04-15").first()
    assert stale.stale_days == 27 and stale.stale


def test_symbols(spark):
    cases = {"xauusd+": "GC=F", "btc-usdt": "BTC-USD", "EURUSD": "EURUSD=X", " aapl ": "AAPL", "SPX500": "^GSPC", "ZZZUSD": "ZZZUSD", " ": " "}
    df = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", symbols.normalize_symbol(F.col("raw")).alias("s"))
    assert {r.raw: r.s for r in df.collect()} == cases
    assert one(spark, symbols.is_allowed_symbol(F.lit("^GSPC"))) and not one(spark, symbols.is_allowed_symbol(F.lit("a b")))
    assert one(spark, symbols.resolve_series(F.lit("10y treasury"))) == "DGS10"
    assert one(spark, symbols.resolve_series(F.lit("bank of japan rate"))) is None
    assert one(spark, symbols.resolve_series(F.lit("dgs5"))) == "DGS5"


@pytest.mark.parametrize(
    ("reply", "found"),
    [
        ('text {"yhat": 0.5, "confidence": 0.6}', '{"yhat": 0.5, "confidence": 0.6}'),
        ('{"a": {"b": 1}}', '{"b": 1}'),
        ('{"a": "x } y"} then { broken', '{"a": "x } y"}'),
        ("none { here", None),
        ("{" + '"' * 20_001 + ' {"a": 1}', '{"a": 1}'),
    ],
)
def test_last_json(spark, reply, found):
    assert one(spark, text.last_json_object(F.lit(reply))) == found


def test_text_helpers(spark):
    assert one(spark, text.labelled_count(F.lit("Bullish: 7 (70%) · Bearish: 3 (30%)"), "Bearish")) == 3
    assert one(spark, text.excerpt(F.lit("a\nbc"), 2)) == "a " + text.ELLIPSIS
    assert one(spark, text.html_to_text(F.lit("<p>no</p><!-- SC_OFF --><b>a</b>&nbsp;&lt;b&gt;<!-- SC_ON -->no"))) == "a <b>"
    assert one(spark, text.iso_epoch(F.lit("1970-01-01T00:01:00Z"))) == 60
    assert one(spark, text.iso_epoch(F.lit("19700101T000100.250+0000"))) == 60.25
    for other in ("1970", "1970-01", "00:01", "1970-01-01T00:01:00.", "1970-13-01", ""):
        assert one(spark, text.iso_epoch(F.lit(other))) is None
    assert one(spark, text.json_list(F.lit("junk"))) == []


def test_sentiment_snapshot_counts_placeholders_as_sources(spark):
    summary, posts = F.lit("Bullish: 7 (70%) · Bearish: 3 (30%)"), F.lit("<unavailable>")
    row = spark.range(1).select(*sentiment.snapshot(summary, posts, F.lit(1))).first()
    assert (row.score, row.n, row.sources) == (0.4, 10, ["stocktwits", "reddit"])
    none = spark.range(1).select(*sentiment.snapshot(None, F.lit(""), F.lit(1))).first()
    assert (none.score, none.n, none.sources) == (0.0, 0, [])


def test_news_and_macro(spark):
    arts = spark.createDataFrame([(0, 1, "t", 5), (0, 0, "t", 6), (1, 0, "", 7), (1, 1, "u", 8)], "query int, position int, title string, published bigint")
    assert sorted(r.published for r in news.first_by_title(arts, "title").collect()) == [6, 8]
    inside = lambda p, now: one(spark, news.in_window(F.lit(p).cast("bigint"), F.lit(0), F.lit(86_400), F.lit(now)))
    assert inside(172_800, 10**9) and not inside(172_801, 10**9)
    assert inside(None, 172_800) and not inside(None, 172_801)
    raw = spark.createDataFrame([("s", "2024-01-01", "2"), ("s", "2024-01-02", "."), ("s", "2024-01-03", "3")], "series_id string, date string, value string")
    row = macro.change(macro.observations(raw)).first()
    assert (row.n, row.change, row.change_pct, row.last_value) == (2, 1.0, 50.0, "3")


def test_statements_and_vendors(spark):
    wide = spark.createDataFrame([("A", 1.0, 2.0)], ["symbol", "2023-12-31", "2024-12-31"])
    kept = statements.periods_until(statements.statement_long(wide, ["symbol"]), "2024-01-01")
    assert [(r.period, r.value) for r in kept.collect()] == [("2023-12-31", 1.0)]
    info = spark.createDataFrame([("A", "Name", None), ("B", None, None)], "symbol string, longName string, beta double")
    assert [(r.symbol, r.label) for r in statements.overview(info).collect()] == [("A", "Name")]
    want = spark.createDataFrame([("A",), ("B",), ("C",)], "symbol string")
    first = spark.createDataFrame([("A", 1)], "symbol string, x int")
    second = spark.createDataFrame([("A", 2), ("B", 3)], "symbol string, x int")
    served = vendors.first_vendor(want, [("p", first), ("q", second)])
    assert sorted((r.symbol, r.vendor, r.x) for r in served.collect()) == [("A", "p", 1), ("B", "q", 3)]
    assert [r.symbol for r in vendors.no_data(want, served).collect()] == ["C"]


def test_live_views(spark):
    calls = spark.createDataFrame([("A", i, i, p) for i, p in enumerate([1.0, 1.0, 0.0, 1.0, 2.0, -1.0, 2.0])], "symbol string, ts bigint, trade_id bigint, ref_price double")
    assert sorted(r.ts for r in live.price_history(calls, width=2).collect()) == [0, 4, 6]


def test_labels_and_folds(spark):
    cols = ", ".join(f"{c} double" for c in learning.FEATURE_ORDER)
    rows = [("A", i, i, p, *([1.0] * 6)) for i, p in enumerate([100.0, 101.0, 100.0])]
    rows += [("B", i, i, p, *([1.0] * 6)) for i, p in enumerate([5.0, 0.0, 6.0, 7.0])]
    df = spark.createDataFrame(rows, f"symbol string, ts bigint, trade_id bigint, last_price double, {cols}")
    lab = learning.labelled(df, width=2, block_rows=2)
    assert [(r.symbol, r.ts, r.label) for r in lab.orderBy("symbol", "ts").collect()] == [("A", 0, 1), ("A", 1, 0), ("B", 0, 0), ("B", 2, 1)]
    pooled = learning.pooled_index(lab, ["B", "A"]).orderBy("pos").collect()
    assert [(r.symbol, r.ts, r.pos) for r in pooled] == [("B", 0, 0), ("B", 2, 1), ("A", 0, 2), ("A", 1, 3)]
    assert list(learning.fold_bounds(100, 4)) == [(20, 40), (40, 60), (60, 80), (80, 100)]
    folds = learning.with_fold(spark.range(13).withColumnRenamed("id", "pos"), 13, 5).orderBy("pos").collect()
    assert [r.fold for r in folds] == [None, None, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, None]


def test_model_round_trip(spark, tmp_path):
    from marketgrade.operators.strategies import Signals, classifier

    rows = spark.range(120).select(
        F.lit("A").alias("symbol"), F.col("id").alias("ts"), F.col("id").alias("trade_id"), F.lit(5.0).alias("last_price"),
        *[(F.col("id") % 2 * 1.0).alias(c) for c in learning.FEATURE_ORDER], (F.col("id") % 2).cast("int").alias("label"), F.col("id").alias("pos"),
    )
    folds = learning.walk_forward(rows, splits=2, trees=2)
    assert [r.accuracy for r in folds.collect()] == [1.0, 1.0] and learning.mean_accuracy(folds).first().oos_dir_acc == 1.0
    model = learning.fit(rows, trees=2)
    learning.save_model(model, str(tmp_path / "m"), learning.FEATURE_ORDER, "ml-v1", {"n": 120})
    loaded, columns, version, metrics = learning.load_model(spark, str(tmp_path / "m"))
    assert (tuple(columns), version, metrics) == (learning.FEATURE_ORDER, "ml-v1", {"n": 120})
    made = classifier(rows.drop("label", "pos"), Signals(classifier=loaded)).collect()
    assert len(made) == 120 and all((r.yhat > 0) == (r.ts % 2 == 1) for r in made)
