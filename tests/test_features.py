import math
import random
import statistics

import pytest

from marketgrade.operators.features import (
    FeatureConfig,
    as_message,
    feature_rows,
    latest_features,
    suffix_moments,
    summary_text,
)

SMALL = FeatureConfig(ema_fast=2, ema_slow=4, rsi_period=3, vol_window=2)
NAMES = ["ema_fast", "ema_slow", "vwap", "ret_1", "vol", "rsi"]


def by_trade(df):
    return {r.trade_id: r for r in df.collect()}


def test_hand_computed_values(ticks):
    df = ticks([("A", 1, 100, 2), ("A", 2, 110, 3), ("B", 1, 7, 0), ("A", 3, 120, 0), ("A", 4, 130, 0)])
    rows = by_trade(feature_rows(df, SMALL))
    assert rows[0].ema_fast == rows[0].ema_slow == 100.0
    assert rows[1].ema_fast == pytest.approx(106.6666667)
    assert rows[1].vwap == pytest.approx(106.0)
    assert rows[1].ret_1 == pytest.approx(0.1)
    assert rows[0].ret_1 is None and rows[1].vol is None and rows[3].rsi is None
    assert rows[4].rsi == 100.0
    assert rows[2].vwap is None and rows[2].ema_fast == 7.0


def test_flat_series_has_rsi_100(ticks):
    rows = by_trade(feature_rows(ticks([("A", i, 5, 1) for i in range(6)]), SMALL))
    assert rows[2].rsi is None and rows[3].rsi == 100.0 and rows[5].rsi == 100.0


def test_zero_price_takes_no_place_in_the_windows(ticks):
    prices = [100, 0, 50, 55, 60.5]
    rows = by_trade(feature_rows(ticks([("A", i, p, 1) for i, p in enumerate(prices)]), SMALL))
    assert rows[1].ret_1 == -1.0
    assert rows[2].ret_1 is None and rows[2].vol is None and rows[2].rsi is None
    assert rows[3].vol == pytest.approx(statistics.pstdev([-1.0, 0.1]))
    assert rows[4].rsi is not None


def plain(rows, cfg):
    out, states = {}, {}
    for symbol, ts, trade, price, volume in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        s = states.setdefault(symbol, {"f": price, "s": price, "pv": 0.0, "v": 0.0, "prev": None, "r": [], "g": [], "l": [], "avg": None})
        if s["prev"] is not None:
            for key, n in (("f", cfg.ema_fast), ("s", cfg.ema_slow)):
                a = 2 / (n + 1)
                s[key] = a * price + (1 - a) * s[key]
        s["pv"] += price * volume
        s["v"] += volume
        row = [s["f"], s["s"], s["pv"] / s["v"] if s["v"] > 0 else None, None, None, None]
        if s["prev"]:
            row[3] = price / s["prev"] - 1
            s["r"] = (s["r"] + [row[3]])[-cfg.vol_window :]
            if len(s["r"]) > 1:
                row[4] = statistics.pstdev(s["r"])
            move, n = price - s["prev"], cfg.rsi_period
            s["g"].append(max(move, 0.0))
            s["l"].append(max(-move, 0.0))
            if len(s["g"]) == n:
                s["avg"] = [sum(s["g"]) / n, sum(s["l"]) / n]
            elif len(s["g"]) > n:
                s["avg"] = [(a * (n - 1) + x[-1]) / n for a, x in zip(s["avg"], (s["g"], s["l"]), strict=True)]
            if s["avg"]:
                row[5] = 100.0 if s["avg"][1] == 0 else 100 - 100 / (1 + s["avg"][0] / s["avg"][1])
        s["prev"] = price
        out[(symbol, ts, trade)] = row
    return out


@pytest.mark.parametrize(
    ("cfg", "width", "n"),
    [
        (FeatureConfig(), 60_000, 1500),
        (FeatureConfig(), 10**12, 9000),
        (FeatureConfig(2, 200, 3, 2), 5_000, 1200),
        (FeatureConfig(1, 26, 14, 20), 1_000, 600),
    ],
)
def test_any_bucket_width_equals_a_plain_loop(spark, cfg, width, n):
    rng = random.Random(n)
    rows, ts = [], 0
    for i in range(n):
        ts += rng.choice([0, 1, 300, 20_000])
        price = 0.0 if rng.random() < 0.08 else round(rng.uniform(1, 100), 2)
        rows.append((rng.choice("AAAAAAAB"), ts, i, price, float(rng.choice([0, 1, 5]))))
    df = spark.createDataFrame(rows, "symbol string, ts bigint, trade_id bigint, price double, volume double")
    expected = plain(rows, cfg)
    got = {(r.symbol, r.ts, r.trade_id): [r[c] for c in NAMES] for r in feature_rows(df, cfg, width).collect()}
    assert got.keys() == expected.keys()
    for key, values in expected.items():
        for have, want in zip(got[key], values, strict=True):
            assert (have is None) == (want is None), key
            assert want is None or math.isclose(have, want, rel_tol=1e-9, abs_tol=1e-11), key


def test_messages_latest_and_summary(ticks):
    made = feature_rows(ticks([("A", 1, 100, 2), ("A", 2, 110, 3)]), SMALL)
    first = as_message(made).orderBy("ts").first()
    assert set(first.features) == {"ema_fast", "ema_slow", "vwap"}
    last = latest_features(made)
    assert last.first().trade_id == 1
    text = last.select(summary_text().alias("t")).first().t
    assert text == "last 110.00, ret_1 +10.00%, ema_spread +0.0256"


def test_suffix_moments():
    means, squares = suffix_moments([5.0, 1.0, 3.0])
    assert means == [0.0, 3.0, 2.0, 3.0]
    assert squares[2] == pytest.approx(2.0) and squares[3] == pytest.approx(8.0)
