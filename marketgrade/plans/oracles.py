"""The SQL counterpart of each query, written independently of the operators."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

NAMES = ["view", "click", "purchase", "signup", "error"]


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql.strip()


def r(x: str, places: int = 6) -> str:
    return f"(round({x}, {places}) + 0.0)"


def ticks(symbol: str = "event_type", price: str = "value") -> str:
    return f"""tk AS (
  SELECT CAST({symbol} AS VARCHAR) AS symbol, {price} AS price,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume,
         (epoch_us(ts) // 1000) AS ts, event_id AS trade_id, user_id
  FROM events)"""


TK = ticks()


def feats(symbol: str = "event_type", price: str = "value") -> str:
    """CTEs that end in ``f``: one feature row per tick, step by step as a stream would."""
    return f"""{ticks(symbol, price)},
n AS (
  SELECT *, row_number() OVER w AS rn, lag(price) OVER w AS prev,
         sum(price * volume) OVER w AS pv, sum(volume) OVER w AS cv
  FROM tk WINDOW w AS (PARTITION BY symbol ORDER BY ts, trade_id)),
d AS (
  SELECT *, CASE WHEN prev <> 0 THEN price / prev - 1.0 END AS ret,
         CASE WHEN prev <> 0 THEN price - prev END AS delta
  FROM n),
v AS (SELECT *, count(ret) OVER (PARTITION BY symbol ORDER BY rn) AS vi FROM d),
st AS (
  SELECT symbol, rn, price AS ef, price AS es, 0 AS seen, CAST(0 AS DOUBLE) AS ag, CAST(0 AS DOUBLE) AS al
  FROM d WHERE rn = 1
  UNION ALL
  SELECT d.symbol, d.rn,
         (2.0::DOUBLE/13) * d.price + (1 - 2.0::DOUBLE/13) * st.ef,
         (2.0::DOUBLE/27) * d.price + (1 - 2.0::DOUBLE/27) * st.es,
         st.seen + CASE WHEN d.delta IS NULL THEN 0 ELSE 1 END,
         CASE WHEN d.delta IS NULL THEN st.ag WHEN st.seen < 14 THEN st.ag + greatest(d.delta, 0) / 14
              ELSE (st.ag * 13 + greatest(d.delta, 0)) / 14 END,
         CASE WHEN d.delta IS NULL THEN st.al WHEN st.seen < 14 THEN st.al + greatest(-d.delta, 0) / 14
              ELSE (st.al * 13 + greatest(-d.delta, 0)) / 14 END
  FROM st JOIN d ON d.symbol = st.symbol AND d.rn = st.rn + 1),
f AS (
  SELECT v.symbol, v.ts, v.trade_id, v.price AS last_price, st.ef AS ema_fast, st.es AS ema_slow,
         CASE WHEN v.cv > 0 THEN v.pv / v.cv END AS vwap, v.ret AS ret_1,
         CASE WHEN v.ret IS NOT NULL AND v.vi >= 2 THEN
           stddev_pop(v.ret) OVER (PARTITION BY v.symbol ORDER BY v.vi RANGE BETWEEN 19 PRECEDING AND CURRENT ROW) END AS vol,
         CASE WHEN v.ret IS NOT NULL AND st.seen >= 14 THEN
           CASE WHEN st.al = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + st.ag / st.al) END END AS rsi,
         v.volume
  FROM v JOIN st ON v.symbol = st.symbol AND v.rn = st.rn)"""


FEATS = feats()
FEATURE_NAMES = ["ema_fast", "ema_slow", "vwap", "ret_1", "vol", "rsi"]
ROUNDED_FEATURES = ", ".join(f"{r(c)} AS {c}" for c in ["last_price", *FEATURE_NAMES])
SPREAD = "(CASE WHEN ema_slow <> 0 THEN (ema_fast - ema_slow) / ema_slow END)"

PX = """px AS (
  SELECT symbol, ts, min(trade_id) AS trade_id, arg_min(price, trade_id) AS last_price
  FROM tk GROUP BY symbol, ts)"""

SENT = """daily AS (
  SELECT event_type AS symbol, ((epoch_us(ts) // 1000) // 86400000 + 1) * 86400000 AS ts,
         count_if(user_id % 2 = 0) AS bull, count_if(user_id % 3 = 0) AS bear
  FROM events GROUP BY 1, 2),
snap AS (
  SELECT symbol, ts AS snap_ts,
         CASE WHEN bull + bear = 0 THEN 0.0 ELSE round_even((bull - bear)::DOUBLE / (bull + bear), 4) END AS score,
         CAST(bull + bear AS INTEGER) AS n
  FROM daily)"""

VERDICTS = """verd AS (
  SELECT symbol, (sum(bull) - sum(bear))::DOUBLE / sum(bull) AS vy,
         sum(bull)::DOUBLE / (sum(bull) + sum(bear)) AS vc
  FROM daily WHERE symbol <> 'signup' GROUP BY symbol)"""

VIEWS = """views AS (
  SELECT event_type AS symbol, ((epoch_us(ts) // 1000) // 86400000 + 1) * 86400000 AS view_ts,
         greatest(-0.1::DOUBLE, least(0.1::DOUBLE, (avg(value) - 50.0) / 100.0)) AS vyhat,
         count_if(user_id % 2 = 0)::DOUBLE / count(*) AS vconf
  FROM events GROUP BY 1, 2)"""


def momentum(horizon: int) -> str:
    return f"""mo AS (
  SELECT symbol, CAST({horizon} AS INTEGER) AS horizon_s, {SPREAD} AS yhat,
         greatest(0.05::DOUBLE, least(1.0::DOUBLE, abs({SPREAD}) * 20.0)) AS confidence,
         'momentum' AS strategy_id, ts, 'v0' AS model_ver, last_price AS ref_price, trade_id
  FROM f WHERE ema_slow <> 0)"""


SENTIMENT_FORECASTS = """se AS (
  SELECT b.symbol, CAST(60 AS INTEGER) AS horizon_s,
         greatest(-0.05::DOUBLE, least(0.05::DOUBLE, coalesce(v.vy, 0.0))) AS yhat,
         greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(v.vc, 0.0))) AS confidence,
         'sentiment_llm' AS strategy_id, b.ts, 'v0' AS model_ver, b.price AS ref_price, b.trade_id
  FROM (SELECT t.*, s.snap_ts FROM tk t ASOF JOIN snap s ON t.symbol = s.symbol AND t.ts >= s.snap_ts) b
  LEFT JOIN verd v ON b.symbol = v.symbol)"""

DEEP_FORECASTS = """de AS (
  SELECT t.symbol, CAST(3600 AS INTEGER) AS horizon_s, v.vyhat AS yhat, v.vconf AS confidence,
         'deep_analysis' AS strategy_id, t.ts, 'deep-v0' AS model_ver, t.price AS ref_price, t.trade_id
  FROM tk t ASOF JOIN views v ON t.symbol = v.symbol AND t.ts >= v.view_ts)"""

ENSEMBLE = """en AS (
  SELECT symbol, CAST(60 AS INTEGER) AS horizon_s, sum(yhat * confidence) / sum(confidence) AS yhat,
         least(1.0::DOUBLE, sum(confidence) / count(*)) AS confidence, 'ensemble' AS strategy_id, ts,
         'v0' AS model_ver, max(ref_price) AS ref_price, trade_id
  FROM (SELECT * FROM mo UNION ALL SELECT * FROM se)
  GROUP BY symbol, ts, trade_id HAVING sum(confidence) > 0)"""

FORECAST_COLUMNS = (
    f"symbol, horizon_s, {r('yhat')} AS yhat, {r('confidence')} AS confidence, strategy_id, ts, "
    f"model_ver, {r('ref_price')} AS ref_price, trade_id"
)

BY_NAME = f"""{TK}, {PX},
due AS (SELECT *, ts + 3600000 AS target_ts FROM tk),
m AS (
  SELECT d.symbol, d.ts AS pred_ts, d.trade_id AS pred_trade_id, d.price AS ref_price, d.volume,
         p.ts AS scored_ts, p.trade_id AS scored_trade_id, p.last_price AS realized_price
  FROM due d ASOF JOIN px p ON d.symbol = p.symbol AND d.target_ts <= p.ts),
made AS (
  SELECT *, 'volume_up' AS strategy_id, (volume - 50.0) / 1000.0 AS yhat, volume / 100.0 AS confidence FROM m
  UNION ALL SELECT *, 'volume_down', -((volume - 50.0) / 1000.0), 1.0 - volume / 100.0 FROM m
  UNION ALL SELECT *, 'always_up', 0.01::DOUBLE, 0.5::DOUBLE FROM m),
rr AS (SELECT *, CASE WHEN ref_price = 0 THEN 0.0 ELSE (realized_price - ref_price) / ref_price END AS realized_return FROM made),
o AS (SELECT *, sign(yhat) = sign(realized_return) AS hit, abs(yhat - realized_return) AS abs_error FROM rr)"""

SCORED = "scored_ts, scored_trade_id, pred_ts, pred_trade_id, symbol"
STATS = ("count(*) AS n, avg(hit::INT::DOUBLE) AS dir_acc, avg(abs_error) AS mae, avg(confidence) AS mean_confidence, "
         "avg(confidence) - avg(hit::INT::DOUBLE) AS calibration_gap")
LAST200 = f"""top AS (
  SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY scored_ts DESC, scored_trade_id DESC,
    pred_ts DESC, pred_trade_id DESC, symbol DESC) AS rk FROM o),
cur AS (SELECT strategy_id, {STATS} FROM top WHERE rk <= 200 GROUP BY strategy_id)"""


def rolled(window: int) -> str:
    frame = f"(PARTITION BY strategy_id ORDER BY {SCORED} ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"
    return f"""roll AS (
  SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY {SCORED}) - 1 AS seq,
         count(*) OVER {frame} AS n, avg(hit::INT::DOUBLE) OVER {frame} AS dir_acc,
         avg(abs_error) OVER {frame} AS mae, avg(confidence) OVER {frame} AS mean_confidence
  FROM o)"""


ROLLED_STATS = ", ".join(f"{r(c, 5)} AS {c}" for c in ["dir_acc", "mae", "mean_confidence", "calibration_gap"])

# ---- sources ---------------------------------------------------------------------------------

for name in ("source_trade_messages", "source_rest_trades"):
    oracle(name, f"WITH {TK} SELECT symbol, price, volume, ts, trade_id FROM tk")
oracle("source_klines", f"WITH {TK} SELECT symbol, trade_id, ts, price, volume FROM tk")

oracle("decode_predictions", f"""
WITH {TK} SELECT trade_id, symbol, CAST(60 AS INTEGER) AS horizon_s, {r('price / 1000.0')} AS yhat,
  {r('volume / 100.0')} AS confidence, 'momentum' AS strategy_id, ts,
  CASE WHEN trade_id % 2 = 0 THEN 'v7' ELSE 'v0' END AS model_ver, 0.0::DOUBLE AS ref_price,
  CAST(sign(price) AS INTEGER) AS direction, ts + 60000 AS target_ts
FROM tk WHERE trade_id % 10 <> 0""")
oracle("decode_quarantine", f"WITH {TK} SELECT trade_id, symbol FROM tk WHERE trade_id % 10 = 0")

oracle("source_trade_quarantine", f"""
WITH {TK}, m AS (SELECT trade_id, price, trade_id % 7 = 0 OR trade_id % 11 = 0 AS bad,
  CASE WHEN trade_id % 3 = 0 THEN '{{{{"stream":"t' ELSE '{{{{"e":"trade"' END AS text FROM tk)
SELECT trade_id AS "offset", CASE WHEN NOT bad THEN price END AS price, CASE WHEN bad THEN text END AS text FROM m""".replace("{{", "{"))

oracle("source_authored_signals", f"""
WITH {SENT}, {VERDICTS}
SELECT symbol, CASE WHEN symbol <> 'view' THEN {r('vy')} ELSE 0.0 END AS yhat,
  CASE WHEN symbol <> 'view' THEN {r('vc')} ELSE 0.0 END AS confidence,
  CASE WHEN symbol <> 'click' THEN 'bullish' ELSE 'neutral' END AS stance,
  CASE WHEN symbol <> 'click' THEN 0.01::DOUBLE ELSE 0.0 END AS deep_yhat,
  0.0::DOUBLE AS deep_confidence, '' AS briefing_md
FROM verd""")

oracle("source_atom_entries", """
SELECT source, doc_id AS post_id,
  trim(regexp_replace(split_part(text, chr(10), 1), '[^A-Za-z0-9 ]', '', 'g')) AS title,
  'Post ' || doc_id || ' & more' AS body,
  CAST(CASE WHEN doc_id % 11 <> 0 THEN 1704067200 + (doc_id * 7919) % 2592000 END AS DOUBLE) AS published
FROM documents""")

# ---- features --------------------------------------------------------------------------------

oracle("feature_rows", f"WITH RECURSIVE {FEATS} SELECT symbol, ts, trade_id, {ROUNDED_FEATURES} FROM f")
oracle("feature_rows_by_user",
       f"WITH RECURSIVE {feats('user_id', 'value * 1000.0 / 997.0')} SELECT symbol, ts, trade_id, {ROUNDED_FEATURES} FROM f")
PRESENT = "concat_ws(',', " + ", ".join(
    f"CASE WHEN {c} IS NOT NULL THEN '{c}' END" for c in FEATURE_NAMES) + ")"
oracle("feature_messages", f"""
WITH RECURSIVE {FEATS} SELECT 'features.out' AS topic, symbol AS key, {PRESENT} AS present, count(*) AS n
FROM f GROUP BY 2, 3""")
LAST_F = "lf AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, trade_id DESC) = 1)"
oracle("latest_features", f"WITH RECURSIVE {FEATS}, {LAST_F} SELECT symbol, ts, trade_id, {ROUNDED_FEATURES} FROM lf")
SUMMARY = f"""concat_ws(', ', printf('last %.2f', last_price),
  CASE WHEN ret_1 IS NOT NULL THEN printf('ret_1 %+.2f%%', ret_1 * 100) END,
  CASE WHEN rsi IS NOT NULL THEN printf('rsi %.0f', rsi) END,
  CASE WHEN {SPREAD} IS NOT NULL THEN printf('ema_spread %+.4f', {SPREAD}) END,
  CASE WHEN vol IS NOT NULL THEN printf('vol %.5f', vol) END)"""
oracle("feature_summaries", f"WITH RECURSIVE {FEATS}, {LAST_F} SELECT symbol, {SUMMARY} AS summary FROM lf")

for name, floor in (("ascending_trades", -1), ("ascending_polled_trades", 0)):
    oracle(name, f"""
WITH {TK},
a AS (SELECT *, trade_id * 2 AS arrival FROM tk UNION ALL SELECT *, trade_id * 2 + 11 FROM tk),
s AS (SELECT *, max(trade_id) OVER (PARTITION BY symbol ORDER BY arrival, trade_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM a)
SELECT symbol, arrival, trade_id, price FROM s WHERE trade_id > greatest(coalesce(seen, {floor}), {floor})""")

# ---- strategies ------------------------------------------------------------------------------

oracle("momentum_forecasts", f"""
WITH RECURSIVE {FEATS}, {momentum(3600)} SELECT {FORECAST_COLUMNS}, CAST(sign(yhat) AS INTEGER) AS direction,
  ts + 3600000 AS target_ts FROM mo""")
oracle("deep_forecasts", f"WITH {TK}, {VIEWS}, {DEEP_FORECASTS} SELECT {FORECAST_COLUMNS} FROM de")
oracle("sentiment_asof", f"""
WITH {TK}, {SENT} SELECT t.symbol, t.ts, t.trade_id, s.snap_ts, {r('s.score')} AS score, s.n
FROM tk t ASOF JOIN snap s ON t.symbol = s.symbol AND t.ts >= s.snap_ts""")
oracle("verdict_runs", f"""
WITH RECURSIVE {FEATS}, {SENT},
b AS (SELECT f.*, s.snap_ts, s.score FROM f ASOF JOIN snap s ON f.symbol = s.symbol AND f.ts >= s.snap_ts),
k AS (SELECT symbol, ts, trade_id, snap_ts,
        concat_ws('|', snap_ts, round_even(score, 1) + 0.0, round_even(coalesce(rsi, 50.0) / 5.0, 0),
          round_even(coalesce({SPREAD}, 0.0) * 1000, 0) + 0.0) AS reading FROM b)
SELECT symbol, ts, trade_id, snap_ts, reading IS DISTINCT FROM
  lag(reading) OVER (PARTITION BY symbol ORDER BY ts, trade_id) AS head FROM k""")
oracle("sentiment_forecasts", f"WITH {TK}, {SENT}, {VERDICTS}, {SENTIMENT_FORECASTS} SELECT {FORECAST_COLUMNS} FROM se")
oracle("model_forecasts", f"""
WITH RECURSIVE {FEATS}, {SENT},
qb AS (SELECT f.*, s.snap_ts, s.score, s.n AS said, CAST(round(coalesce(rsi, 50.0)) AS INTEGER) AS tone
  FROM f ASOF JOIN snap s ON f.symbol = s.symbol AND f.ts >= s.snap_ts),
qk AS (SELECT *, tone % 5 <> 3 AS answered, row_number() OVER w AS place,
        concat_ws('|', snap_ts, round_even(score, 1) + 0.0, round_even(coalesce(rsi, 50.0) / 5.0, 0),
          round_even(coalesce({SPREAD}, 0.0) * 1000, 0) + 0.0) AS reading
  FROM qb WINDOW w AS (PARTITION BY symbol ORDER BY ts, trade_id)),
qh AS (SELECT *, reading IS DISTINCT FROM lag(reading) OVER (PARTITION BY symbol ORDER BY place) AS head FROM qk),
qu AS (SELECT *, sum(head::INT) OVER (PARTITION BY symbol ORDER BY place) AS run FROM qh),
qg AS (SELECT symbol, run, any_value(reading) AS reading, min(place) FILTER (WHERE answered) AS first,
        arg_min((tone - 50) / 997.0::DOUBLE, place) FILTER (WHERE answered) AS yhat,
        arg_min((said % 13) / 10.0::DOUBLE, place) FILTER (WHERE answered) AS confidence
  FROM qu GROUP BY symbol, run),
qa AS (SELECT *, reading IS DISTINCT FROM lag(reading) OVER (PARTITION BY symbol ORDER BY run) AS asked FROM qg WHERE first IS NOT NULL),
qm AS (SELECT symbol, run, reading,
        last_value(CASE WHEN asked THEN yhat END IGNORE NULLS) OVER w AS yhat,
        last_value(CASE WHEN asked THEN confidence END IGNORE NULLS) OVER w AS confidence
  FROM qa WINDOW w AS (PARTITION BY symbol ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
qe AS (SELECT g.*, m.reading AS held, m.yhat AS held_yhat, m.confidence AS held_confidence
  FROM qg g ASOF LEFT JOIN qm m ON g.symbol = m.symbol AND g.run > m.run),
qv AS (SELECT u.*, CASE WHEN held = e.reading THEN held_yhat WHEN place >= first THEN e.yhat END AS yhat,
        CASE WHEN held = e.reading THEN held_confidence WHEN place >= first THEN e.confidence END AS confidence
  FROM qu u JOIN qe e ON u.symbol = e.symbol AND u.run = e.run)
SELECT symbol, CAST(60 AS INTEGER) AS horizon_s, {r('greatest(-0.05::DOUBLE, least(0.05::DOUBLE, yhat))')} AS yhat,
  {r('least(1.0::DOUBLE, confidence)')} AS confidence, 'sentiment_llm' AS strategy_id, ts, 'v0' AS model_ver,
  {r('last_price')} AS ref_price, trade_id
FROM qv WHERE yhat IS NOT NULL""")
oracle("edge_forecasts", f"""
WITH {TK} SELECT symbol, ts, trade_id, {r('(volume / 99.0 - 0.5) * 2 * 0.01')} AS yhat,
  {r('least(1.0, abs(volume / 99.0 - 0.5) * 2)')} AS confidence FROM tk""")
LEAN = "(volume - 50.0) / 300.0"
oracle("clamped_forecasts", f"""
WITH {TK} SELECT trade_id, {r(f'greatest(-0.05, least(0.05, {LEAN}))')} AS fast,
  {r(f'greatest(-0.1, least(0.1, {LEAN}))')} AS deep,
  {r('greatest(0.0, least(1.0, volume / 50.0))')} AS confidence FROM tk""")
FOUR = f"{FEATS}, {SENT}, {VERDICTS}, {VIEWS}, {momentum(60)}, {SENTIMENT_FORECASTS}, {DEEP_FORECASTS}, {ENSEMBLE}"
ALL = """al AS (SELECT * FROM mo UNION ALL SELECT * FROM se UNION ALL SELECT * FROM de UNION ALL SELECT * FROM en)"""
oracle("ensemble_forecasts", f"WITH RECURSIVE {FOUR} SELECT {FORECAST_COLUMNS} FROM en")
oracle("strategy_union", f"""
WITH RECURSIVE {FOUR}, {ALL} SELECT strategy_id, symbol, count(*) AS n, {r('sum(confidence)', 4)} AS confidence,
  max(ts) AS last_ts FROM al GROUP BY 1, 2""")
oracle("latest_forecasts", f"""
WITH RECURSIVE {FOUR}, {ALL} SELECT {FORECAST_COLUMNS} FROM al
QUALIFY row_number() OVER (PARTITION BY symbol, strategy_id ORDER BY ts DESC, trade_id DESC) = 1""")
VECTOR = ", ".join(f"{r(f'coalesce({c}, 0.0)')} AS {c}" for c in ["ema_fast", "ema_slow", "rsi", "vol", "ret_1", "vwap"])
oracle("feature_vectors", f"WITH RECURSIVE {FEATS} SELECT symbol, ts, trade_id, {VECTOR} FROM f")

oracle("isolated_strategies", f"""
WITH RECURSIVE {FEATS}, {momentum(60)},
hf AS (SELECT symbol, ts, trade_id, last_price FROM f WHERE trade_id % 10 <> 0)
SELECT {FORECAST_COLUMNS} FROM mo
UNION ALL SELECT symbol, CAST(60 AS INTEGER), {r('last_price / 1000.0')}, 0.5::DOUBLE, 'half_failing', ts, 'v0',
  {r('last_price')}, trade_id FROM hf""")

# ---- scoring ---------------------------------------------------------------------------------

MATCHED = f"""{FEATS}, {PX}, {momentum(3600)},
mm AS (SELECT mo.*, p.ts AS scored_ts, p.trade_id AS scored_trade_id, p.last_price AS realized_price
  FROM (SELECT *, ts + 3600000 AS target_ts FROM mo) mo
  ASOF LEFT JOIN px p ON mo.symbol = p.symbol AND mo.target_ts <= p.ts)"""
oracle("scored_outcomes", f"""
WITH RECURSIVE {MATCHED},
s AS (SELECT *, CASE WHEN ref_price = 0 THEN 0.0 ELSE (realized_price - ref_price) / ref_price END AS rr
  FROM mm WHERE scored_ts IS NOT NULL)
SELECT symbol, strategy_id, horizon_s, {r('yhat')} AS yhat, {r('rr')} AS realized_return, sign(yhat) = sign(rr) AS hit,
  {r('abs(yhat - rr)')} AS abs_error, {r('confidence')} AS confidence, {r('ref_price')} AS ref_price,
  {r('realized_price')} AS realized_price, ts AS pred_ts, scored_ts, model_ver, scored_trade_id,
  trade_id AS pred_trade_id FROM s""")
oracle("pending_forecasts", f"""
WITH RECURSIVE {MATCHED} SELECT symbol, ts, trade_id, ts + 3600000 AS target_ts FROM mm WHERE scored_ts IS NULL""")
oracle("outcome_metrics", f"WITH {BY_NAME}, x AS (SELECT {STATS} FROM o) SELECT n, {ROLLED_STATS} FROM x")
oracle("backtest_accuracy", f"""
WITH {BY_NAME}, x AS (SELECT strategy_id, {STATS} FROM o GROUP BY 1)
SELECT strategy_id, n, {r('dir_acc', 5)} AS dir_acc, {r('mae', 5)} AS mae FROM x""")
oracle("standings", f"WITH {BY_NAME}, {LAST200} SELECT strategy_id, n, {ROLLED_STATS}, '*' AS symbol FROM cur")
oracle("ranked_standings", f"""
WITH {BY_NAME}, {LAST200},
k AS (SELECT *, CAST(row_number() OVER (ORDER BY dir_acc DESC, n DESC, strategy_id) AS INTEGER) AS rank FROM cur)
SELECT strategy_id, n, {ROLLED_STATS}, '*' AS symbol, rank, rank = 1 AS leader FROM k""")
oracle("rolling_accuracy", f"""
WITH {BY_NAME}, {rolled(200)} SELECT strategy_id, scored_ts, scored_trade_id, pred_trade_id, seq, n,
  {r('dir_acc')} AS dir_acc, {r('mean_confidence')} AS mean_confidence FROM roll""")
oracle("rolling_errors", f"""
WITH {BY_NAME}, {rolled(50)} SELECT strategy_id, seq, {r('mae', 4)} AS mae,
  {r('mean_confidence - dir_acc', 4)} AS calibration_gap FROM roll""")
ALERTS = f"""{BY_NAME}, {rolled(200)},
e AS (SELECT *, n >= 10 AND dir_acc < 0.45 AS below FROM roll),
g AS (SELECT *, coalesce(lag(below) OVER (PARTITION BY strategy_id ORDER BY seq), false) AS was FROM e),
al AS (SELECT '*' AS symbol, 'accuracy_degradation' AS kind, 'warning' AS severity,
  printf('%s directional accuracy %.0f%% over last %d (< 45%%)', strategy_id, round_even(dir_acc * 100, 0), n) AS message,
  scored_ts AS ts, strategy_id, seq FROM g WHERE below AND NOT was)"""
oracle("degradation_alerts", f"WITH {ALERTS} SELECT * FROM al")
oracle("newest_alerts", f"WITH {ALERTS} SELECT * FROM al ORDER BY ts DESC, seq DESC, strategy_id LIMIT 5")
oracle("standings_snapshots", f"""
WITH {BY_NAME}, {rolled(200)},
a AS (SELECT *, row_number() OVER (ORDER BY {SCORED}, list_position(['volume_up', 'volume_down', 'always_up'], strategy_id)) AS seen FROM roll),
every20 AS (SELECT seen, scored_ts AS snapshot_ts, unnest(['volume_up', 'volume_down', 'always_up']) AS strategy_id FROM a WHERE seen % 20 = 0)
SELECT d.seen, d.snapshot_ts, d.strategy_id, a.n, {r('a.dir_acc')} AS dir_acc, {r('a.mean_confidence')} AS mean_confidence
FROM every20 d ASOF JOIN a ON d.strategy_id = a.strategy_id AND d.seen >= a.seen""")
oracle("recent_outcomes", f"""
WITH {BY_NAME}, i AS (SELECT *, pred_trade_id * 3 + list_position(['volume_up', 'volume_down', 'always_up'], strategy_id) - 1 AS id FROM o)
SELECT id, strategy_id, scored_ts, hit, {r('abs_error')} AS abs_error FROM i ORDER BY scored_ts DESC, id DESC LIMIT 200""")

# ---- lake and tables -------------------------------------------------------------------------

oracle("lake_routing", f"""
WITH {TK},
x AS (SELECT CASE trade_id % 4 WHEN 0 THEN 'features' WHEN 1 THEN 'predictions' WHEN 2 THEN 'outcomes' END AS dataset,
  CASE WHEN trade_id % 11 <> 0 THEN symbol ELSE 'UNKNOWN' END AS symbol,
  CASE WHEN trade_id % 3 = 1 THEN ts WHEN trade_id % 5 <> 0 THEN ts + 86400000 ELSE ts - 86400000 END AS t FROM tk)
SELECT dataset, strftime(make_timestamp(t * 1000), '%Y-%m-%d') AS dt, symbol, count(*) AS n
FROM x WHERE dataset IS NOT NULL GROUP BY 1, 2, 3""")
oracle("flattened_messages", f"""
WITH RECURSIVE {FEATS} SELECT symbol, count(*) AS n, count(rsi) AS with_rsi, count(vwap) AS with_vwap,
  {r('max(last_price)')} AS top_price FROM f GROUP BY 1""")
oracle("lake_round_trip", f"""
WITH {BY_NAME} SELECT strftime(make_timestamp(scored_ts * 1000), '%Y-%m-%d') AS dt, symbol, strategy_id,
  count(*) AS n, {r('avg(hit::INT::DOUBLE)')} AS dir_acc FROM o GROUP BY 1, 2, 3""")
oracle("snapshot_upserts", f"""
WITH {TK} SELECT ts // 3600000 * 3600000 AS ts, arg_max(symbol, trade_id) AS standings, max(trade_id) AS written
FROM tk GROUP BY 1""")
oracle("model_registrations", """
WITH m AS (SELECT o_orderstatus AS name, CAST(o_custkey % 500 AS VARCHAR) AS version, o_orderkey AS created_ts FROM orders)
SELECT name, version, min(created_ts) AS created_ts, 'gbt' AS kind FROM m
WHERE NOT EXISTS (SELECT 1 FROM m h WHERE h.created_ts % 5 = 0 AND h.name = m.name AND h.version = m.version)
GROUP BY 1, 2""")
oracle("expired_partitions", """
SELECT strftime(o_orderdate, '%Y-%m-%d') AS dt, o_orderpriority AS symbol, count(*) AS n FROM orders
WHERE CAST(o_orderdate AS DATE) < DATE '1998-10-02' GROUP BY 1, 2""")

# ---- daily bars ------------------------------------------------------------------------------

BARS = """b AS (
  SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date,
         arg_min(o_totalprice / 997.0, o_orderkey) AS open, max(o_totalprice / 997.0) AS high,
         min(o_totalprice / 997.0) AS low, arg_max(o_totalprice / 997.0, o_orderkey) AS close,
         CAST(count(*) AS DOUBLE) AS volume
  FROM orders GROUP BY 1, 2)"""
BAR_COLUMNS = ", ".join(f"{r(c)} AS {c}" for c in ["open", "high", "low", "close", "volume"])
DAY = "CAST(date AS VARCHAR) AS date"
GAP = lambda c, g: f"CASE WHEN (date - DATE '1970-01-01') % {g} <> 0 THEN round({c}, 6) END AS {c}"
FILLED = ", ".join(
    f"(round(coalesce(last_value({c} IGNORE NULLS) OVER up, first_value({c} IGNORE NULLS) OVER whole), 6) + 0.0) AS {c}"
    for c in ["open", "high", "low", "volume"])
oracle("cleaned_bars", f"""
WITH {BARS},
raw AS (SELECT symbol, date, {GAP('open', 3)}, {GAP('high', 5)}, {GAP('low', 7)}, round(close, 6) AS close, {GAP('volume', 2)}
  FROM b WHERE (date - DATE '1970-01-01') % 29 <> 0 AND (date - DATE '1970-01-01') % 23 <> 0)
SELECT symbol, {DAY}, {FILLED}, {r('close')} AS close FROM raw
WINDOW up AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  whole AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
oracle("bar_files", ORACLES["cleaned_bars"])
oracle("bars_until", f"WITH {BARS} SELECT symbol, {DAY}, {BAR_COLUMNS} FROM b WHERE date <= DATE '1998-12-31'")
oracle("bars_between", f"""
WITH {BARS} SELECT symbol, {DAY}, """ + ", ".join(f"round_even({c}, 2) AS {c}" for c in ["open", "high", "low", "close"])
       + """, volume FROM b WHERE date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'""")
STALE = f"""{BARS},
u AS (SELECT * FROM b WHERE date <= DATE '1998-12-31' AND (length(symbol) % 2 = 0 OR date < DATE '1998-11-15'))"""
oracle("bar_staleness", f"""
WITH {STALE} SELECT symbol, CAST(max(date) AS VARCHAR) AS latest, CAST(DATE '1998-12-31' - max(date) AS INTEGER) AS stale_days,
  DATE '1998-12-31' - max(date) > 10 AS stale FROM u GROUP BY 1""")
oracle("fresh_bars", f"""
WITH {STALE} SELECT symbol, count(*) AS n FROM u GROUP BY 1 HAVING DATE '1998-12-31' - max(date) <= 10""")
ROLLING = f"""{BARS},
w AS (SELECT *, (high + low + close) / 3.0 AS tp, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn,
  lag(close) OVER (PARTITION BY symbol ORDER BY date) AS pc FROM b),
w2 AS (SELECT *, lag(tp) OVER (PARTITION BY symbol ORDER BY date) AS pt FROM w),
w3 AS (SELECT *, CASE WHEN tp > pt THEN tp * volume ELSE 0.0 END AS upf, CASE WHEN tp < pt THEN tp * volume ELSE 0.0 END AS dnf FROM w2),
ri AS (SELECT symbol, date, close, avg(close) OVER w50 AS close_50_sma, avg(close) OVER w200 AS close_200_sma,
  avg(close) OVER w20 AS boll, stddev_samp(close) OVER w20 AS sd, sum(close * volume) OVER w14 / sum(volume) OVER w14 AS vwma,
  CASE WHEN sum(upf) OVER w14 + sum(dnf) OVER w14 <> 0 THEN 100.0 * sum(upf) OVER w14 / (sum(upf) OVER w14 + sum(dnf) OVER w14) END AS mfi
  FROM w3 WINDOW w14 AS (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING), w20 AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING),
  w50 AS (PARTITION BY symbol ORDER BY date ROWS 49 PRECEDING), w200 AS (PARTITION BY symbol ORDER BY date ROWS 199 PRECEDING))"""
oracle("rolling_indicators", f"""
WITH {ROLLING} SELECT symbol, {DAY}, {r('close_50_sma', 5)} AS close_50_sma, {r('close_200_sma', 5)} AS close_200_sma,
  {r('boll', 5)} AS boll, {r('boll + 2 * sd', 5)} AS boll_ub, {r('boll - 2 * sd', 5)} AS boll_lb, {r('vwma', 5)} AS vwma,
  {r('mfi', 5)} AS mfi FROM ri""")
A10, A12, A26, A9 = (f"(2.0::DOUBLE/{n + 1})" for n in (10, 12, 26, 9))
STEP = lambda alpha, x, y: f"{alpha} * {x} + (1 - {alpha}) * {y}"
E12, E26 = STEP(A12, "w.close", "s.e12"), STEP(A26, "w.close", "s.e26")
RECURSIVE = f"""{ROLLING},
s AS (
  SELECT symbol, rn, date, close AS e10, close AS e12, close AS e26, CAST(0 AS DOUBLE) AS ms,
         CAST(NULL AS DOUBLE) AS ag, CAST(NULL AS DOUBLE) AS al, high - low AS tr
  FROM w WHERE rn = 1
  UNION ALL
  SELECT w.symbol, w.rn, w.date, {STEP(A10, 'w.close', 's.e10')}, {E12}, {E26},
         {STEP(A9, f'(({E12}) - ({E26}))', 's.ms')},
         CASE WHEN s.ag IS NULL THEN greatest(w.close - w.pc, 0) ELSE (s.ag * 13 + greatest(w.close - w.pc, 0)) / 14 END,
         CASE WHEN s.al IS NULL THEN greatest(w.pc - w.close, 0) ELSE (s.al * 13 + greatest(w.pc - w.close, 0)) / 14 END,
         (s.tr * 13 + greatest(w.high - w.low, abs(w.high - w.pc), abs(w.low - w.pc))) / 14
  FROM s JOIN w ON w.symbol = s.symbol AND w.rn = s.rn + 1)"""
RSI = "CASE WHEN al = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + ag / al) END"
oracle("recursive_indicators", f"""
WITH RECURSIVE {RECURSIVE} SELECT symbol, {DAY}, {r('e10', 5)} AS close_10_ema, {r('e12 - e26', 5)} AS macd, {r('ms', 5)} AS macds,
  {r('e12 - e26 - ms', 5)} AS macdh, {r(RSI, 5)} AS rsi, {r('tr', 5)} AS atr FROM s""")
CALENDAR = """days AS (
  SELECT symbol, CAST(unnest(generate_series(DATE '1998-12-31' - {back}, DATE '1998-12-31', INTERVAL 1 DAY)) AS DATE) AS date
  FROM (SELECT DISTINCT symbol FROM b))"""
oracle("indicator_calendar", f"""
WITH {ROLLING}, {CALENDAR.format(back=400)}
SELECT d.symbol, CAST(d.date AS VARCHAR) AS date, {r('ri.close_50_sma', 5)} AS number,
  CASE WHEN ri.symbol IS NULL THEN 'N/A: Not a trading day (weekend or holiday)' END AS note
FROM days d LEFT JOIN ri ON d.symbol = ri.symbol AND d.date = ri.date""")
oracle("indicator_on_date", f"""
WITH {ROLLING}, {CALENDAR.format(back=0)}
SELECT d.symbol, CAST(d.date AS VARCHAR) AS date, {r('ri.boll', 5)} AS number
FROM days d LEFT JOIN ri ON d.symbol = ri.symbol AND d.date = ri.date""")
oracle("last_bars", f"""
WITH {BARS} SELECT symbol, {DAY}, {BAR_COLUMNS} FROM b WHERE date <= DATE '1998-12-31'
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 30""")
SNAP_FIELDS = (
    [("latest", c, c) for c in ["open", "high", "low", "close", "volume"]]
    + [("indicator", n, e) for n, e in [
        ("close_10_ema", "e10"), ("close_50_sma", "close_50_sma"), ("close_200_sma", "close_200_sma"), ("rsi", RSI),
        ("boll", "boll"), ("boll_ub", "boll + 2 * sd"), ("boll_lb", "boll - 2 * sd"), ("macd", "e12 - e26"), ("macds", "ms"),
        ("macdh", "e12 - e26 - ms"), ("atr", "tr")]])
oracle("verified_snapshot", f"""
WITH RECURSIVE {RECURSIVE},
u AS (SELECT b.*, s.* EXCLUDE (symbol, date), ri.* EXCLUDE (symbol, date, close),
        row_number() OVER (PARTITION BY b.symbol ORDER BY b.date DESC) AS back
      FROM b JOIN s ON b.symbol = s.symbol AND b.date = s.date JOIN ri ON b.symbol = ri.symbol AND b.date = ri.date
      WHERE b.date <= DATE '1998-12-31')
SELECT symbol, 'latest' AS section, 'date' AS field, CAST(date AS VARCHAR) AS value FROM u WHERE back = 1
""" + "".join(f"UNION ALL SELECT symbol, '{s}', '{f}', coalesce(printf('%.2f', {e}), 'N/A') FROM u WHERE back = 1\n"
              for s, f, e in SNAP_FIELDS) +
       "UNION ALL SELECT symbol, 'close', CAST(date AS VARCHAR), printf('%.2f', close) FROM u WHERE back <= 30")

# ---- sentiment, news, macro, markets, statements ---------------------------------------------

MSG = """msg AS (
  SELECT CAST(user_id AS VARCHAR) AS symbol, (epoch_us(ts) // 1000) AS ts, event_id AS message_id,
    CASE event_type WHEN 'click' THEN 'Bullish' WHEN 'error' THEN 'Bearish' END AS label,
    trim(replace(' ' || event_type || chr(10) || 'note ' || repeat(props, 40), chr(10), ' ')) AS body FROM events),
top AS (SELECT * FROM msg QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, message_id DESC) <= 30),
cnt AS (SELECT symbol, count_if(label = 'Bullish') AS bullish, count_if(label = 'Bearish') AS bearish, count(*) AS total,
  max(ts) AS last_ts FROM top GROUP BY 1)"""
CNT_COLUMNS = """symbol, CAST(bullish AS BIGINT) AS bullish, CAST(bearish AS BIGINT) AS bearish, total, last_ts,
  CAST(total - bullish - bearish AS BIGINT) AS unlabeled,
  CAST(round_even(100.0::DOUBLE * bullish / total, 0) AS INTEGER) AS bull_pct,
  CAST(round_even(100.0::DOUBLE * bearish / total, 0) AS INTEGER) AS bear_pct"""
oracle("message_counts", f"WITH {MSG} SELECT {CNT_COLUMNS} FROM cnt")
oracle("message_lines", f"""
WITH {MSG} SELECT symbol, message_id, ts, coalesce(label, 'no-label') AS tag,
  CASE WHEN length(body) > 280 THEN substring(body, 1, 280) || '…' ELSE body END AS line FROM top""")
oracle("sentiment_snapshots", f"""
WITH {MSG} SELECT symbol,
  CASE WHEN bullish + bearish = 0 THEN 0.0 ELSE round_even((bullish - bearish)::DOUBLE / (bullish + bearish), 4) END AS score,
  CAST(bullish + bearish AS INTEGER) AS n, last_ts AS ts,
  CASE WHEN total % 2 = 0 THEN 'stocktwits,reddit' ELSE 'stocktwits' END AS sources FROM cnt""")
oracle("summary_labels", f"""
WITH {MSG} SELECT symbol, CAST(bullish AS BIGINT) AS bull, CAST(bearish AS BIGINT) AS bear, CAST(0 AS BIGINT) AS absent FROM cnt""")
POSTS = """p AS (
  SELECT source, doc_id AS post_id, trim(split_part(text, chr(10), 1)) AS title, trim(replace(text, chr(10), ' ')) AS body,
    CASE WHEN doc_id % 11 <> 0 THEN 1704067200 + (doc_id * 7919) % 2592000 END AS published FROM documents),
pt AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY published DESC NULLS LAST, post_id) AS rk FROM p)"""
oracle("newest_posts", f"""
WITH {POSTS} SELECT source, post_id, published,
  CASE WHEN length(body) > 240 THEN substring(body, 1, 240) || '…' ELSE body END AS excerpt FROM pt WHERE rk <= 5""")
oracle("source_report", f"""
WITH {POSTS} SELECT source, count(*) AS n, CAST(count(*) AS INTEGER) AS lines,
  '[' || strftime(make_timestamp(max(CASE WHEN rk = 1 THEN published END) * 1000000), '%Y-%m-%d') || ']' AS start
FROM pt WHERE rk <= 5 GROUP BY source
UNION ALL SELECT r_name, 0, 1, '<no posts fo' FROM region""")
ART = """art AS (
  SELECT source AS query, doc_id AS position, split_part(text, chr(10), 1) AS title, '' AS summary, lang AS publisher,
    'https://example.com/' || doc_id AS link,
    CASE WHEN doc_id % 7 <> 0 THEN 1704067200 + (doc_id % 40) * 86400 END AS published FROM documents),
ft AS (SELECT * FROM art WHERE title <> '' QUALIFY row_number() OVER (PARTITION BY title ORDER BY query, position) = 1)"""
oracle("article_fields", f"WITH {ART} SELECT * FROM art")
oracle("articles_by_title", f"WITH {ART} SELECT query, position, title FROM ft")
oracle("first_articles", f"""
WITH {ART}, h AS (SELECT * FROM ft ORDER BY query, position LIMIT 100)
SELECT query, position, published FROM h
WHERE published IS NULL OR published BETWEEN 1704412800 AND 1706140800 + 86400""")
oracle("news_window", f"""
WITH {ART} SELECT position, CASE WHEN published IS NULL THEN true ELSE published BETWEEN 1704412800 AND 1706227200 END AS in_live_window,
  CASE WHEN published IS NULL THEN false ELSE published BETWEEN 1704412800 AND 1706227200 END AS in_past_window FROM art""")
MAC = f"""{BARS},
mac AS (SELECT symbol AS series_id, CAST(date AS VARCHAR) AS date, printf('%.3f', close) AS value FROM b WHERE volume <> 1)"""
oracle("macro_change", f"""
WITH {MAC}, e AS (SELECT series_id, count(*) AS n, min(date) AS first_date, max(date) AS last_date, arg_min(value, date) AS first_value,
  arg_max(value, date) AS last_value FROM mac GROUP BY 1)
SELECT *, {r('last_value::DOUBLE - first_value::DOUBLE', 5)} AS change,
  {r('(last_value::DOUBLE - first_value::DOUBLE) / first_value::DOUBLE * 100', 5)} AS change_pct FROM e""")
oracle("macro_recent", f"""
WITH {MAC} SELECT series_id, date, value FROM mac QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY date DESC) <= 40""")
MK = """mk AS (
  SELECT p_brand AS topic, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) - 1 AS INTEGER) AS event_pos,
    CAST(row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) - 1 AS INTEGER) AS market_pos,
    p_name AS question, p_partkey AS k, CASE WHEN p_partkey % 19 <> 0 THEN p_retailprice * 3 END AS volume,
    CASE WHEN p_partkey % 9 <> 0 THEN '20' || lpad(CAST(p_partkey % 40 + 10 AS VARCHAR), 2, '0') || '-06-30' END AS ends
  FROM part),
op AS (SELECT *, coalesce(volume, 0.0) AS vol FROM mk WHERE k % 5 <> 0 AND k % 17 <> 0 AND (ends IS NULL OR ends >= '2030'))"""
MK_COLUMNS = f"""question, 'Yes' AS label, {r('(k % 97)::DOUBLE / 100')} AS probability, {r('vol')} AS volume,
  coalesce(ends, '') AS resolves, CASE WHEN k % 7 <> 0 THEN {r('((k % 7)::DOUBLE / 100.0) * 100')} END AS week_points"""
oracle("open_markets", f"WITH {MK} SELECT topic, event_pos, market_pos, question, volume AS \"volumeNum\" FROM op")
oracle("top_markets", f"""
WITH {MK}, t AS (SELECT * FROM op QUALIFY row_number() OVER (PARTITION BY topic ORDER BY vol DESC, event_pos, market_pos) <= 6)
SELECT topic, {MK_COLUMNS} FROM t WHERE k % 13 <> 0""")
oracle("top_markets_overall", f"""
WITH {MK}, t AS (SELECT * FROM op ORDER BY vol DESC,
  event_pos + 1000 * CAST(regexp_extract(topic, '(\\d+)', 1) AS INTEGER), market_pos LIMIT 25)
SELECT {MK_COLUMNS} FROM t WHERE k % 13 <> 0""")
oracle("json_lists", f"""
WITH {MK} SELECT topic, question, CAST(CASE WHEN k % 17 = 0 THEN 0 ELSE 2 END AS INTEGER) AS n_outcomes,
  CASE WHEN k % 13 = 0 THEN 'n/a' ELSE printf('0.%02d', k % 97) END AS first_price FROM mk""")
oracle("reports_until", """
WITH q AS (SELECT DISTINCT o_custkey AS symbol,
  CAST(CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS VARCHAR) AS e FROM orders)
SELECT symbol, CAST(count(*) FILTER (e <= '1998-12-31') AS INTEGER) AS n, max(e) FILTER (e <= '1998-12-31') AS last
FROM q GROUP BY 1""")
YEARLY = """y AS (SELECT o_orderpriority AS symbol, year(o_orderdate) AS yr, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2)"""
oracle("statement_periods", f"""
WITH {YEARLY} SELECT symbol, yr || '-12-31' AS period, {r('value', 2)} AS value FROM y WHERE yr <= 1998""")
oracle("statement_display", f"WITH {YEARLY} SELECT symbol, " + ", ".join(
    f"{r(f'max(value) FILTER (yr = {y})', 2)} AS y{y}" for y in range(1995, 1999)) + " FROM y GROUP BY 1")
oracle("fundamentals_overview", """
WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS symbol, c_custkey AS k, * FROM customer),
u AS (SELECT symbol, 0 AS place, 'Name' AS label, c_name AS value FROM c
  UNION ALL SELECT symbol, 1, 'Sector', CASE WHEN k % 3 <> 0 THEN c_mktsegment END FROM c
  UNION ALL SELECT symbol, 2, 'Market Cap', CASE WHEN k % 2 = 0 THEN CAST(k * 1000 AS VARCHAR) END FROM c
  UNION ALL SELECT symbol, 3, 'Beta', CASE WHEN k % 5 = 0 THEN CAST(c_nationkey AS VARCHAR) END FROM c)
SELECT symbol, CAST(place AS INTEGER) AS place, label, value FROM u WHERE value IS NOT NULL""")
oracle("vendor_fallback", f"""
WITH {BARS} SELECT symbol, CASE WHEN symbol < '3' THEN 'first' ELSE 'second' END AS vendor, count(*) AS n
FROM b WHERE symbol NOT LIKE '5%' GROUP BY 1, 2""")
oracle("vendor_no_data", f"""
WITH {BARS} SELECT DISTINCT symbol, 'NO_DATA_AVAILABLE: ' || symbol || ' (no rows)' AS message FROM b WHERE symbol LIKE '5%'""")

# ---- text and names --------------------------------------------------------------------------

BRIEF = """k AS (SELECT *, conv_id * 10 + turn AS key FROM conversations),
bv AS (SELECT *, printf('{"stance": "bullish", "yhat": %.2f, "confidence": %.1f}', (key % 40 - 20) / 100.0, (key % 15) / 10.0) AS v FROM k),
br AS (SELECT *, text || CASE key % 4 WHEN 0 THEN ' {"draft": true} ' || chr(10) || chr(10) || v
    WHEN 1 THEN ' {"outer": ' || v || ', broken {' WHEN 2 THEN ' {not json} ' || v || '  ' || chr(10)
    ELSE ' no verdict {' END AS briefing FROM bv)"""
oracle("last_json", f"WITH {BRIEF} SELECT conv_id, turn, CASE WHEN key % 4 <> 3 THEN v END AS verdict FROM br")
oracle("deep_views", f"""
WITH {BRIEF} SELECT CAST(key AS VARCHAR) AS symbol, 'bullish' AS stance,
  {r("greatest(-0.1, least(0.1, printf('%.2f', (key % 40 - 20) / 100.0)::DOUBLE))")} AS yhat,
  {r("least(1.0, printf('%.1f', (key % 15) / 10.0)::DOUBLE)")} AS confidence, CAST(3600 AS INTEGER) AS horizon_s,
  CAST(0 AS INTEGER) AS ts,
  md5(regexp_replace(CASE key % 4 WHEN 0 THEN text || ' {{"draft": true}}' WHEN 2 THEN text || ' {{not json}}' ELSE briefing END,
    '^\\s+|\\s+$', '', 'g')) AS briefing_md, 'deep-v0' AS model_ver FROM br WHERE key % 4 <> 3""".replace("{{", "{").replace("}}", "}"))
oracle("deep_context", f"""
WITH RECURSIVE {FEATS}, {SENT}, {LAST_F},
ls AS (SELECT * FROM snap QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY snap_ts DESC) = 1)
SELECT lf.symbol, {SUMMARY} AS price_summary, {r('ls.score')} AS score, ls.n, '' AS news FROM lf LEFT JOIN ls ON lf.symbol = ls.symbol
UNION ALL SELECT r_name, 'no recent market data', NULL, NULL, CASE WHEN r_regionkey > 1 THEN r_name ELSE '' END FROM region""")
DIGITS = lambda a: f"CAST('0x' || substr(d, {a}, 4) AS INTEGER)"
oracle("deep_analysis", f"""
WITH RECURSIVE {FEATS}, {SENT}, {LAST_F},
ls AS (SELECT * FROM snap QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY snap_ts DESC) = 1),
c AS (SELECT lf.symbol, {SUMMARY} AS price, ls.score, ls.n, 'none' AS news FROM lf LEFT JOIN ls ON lf.symbol = ls.symbol
  UNION ALL SELECT r_name, 'no recent market data', NULL, NULL, CASE WHEN r_regionkey > 1 THEN r_name ELSE 'none' END FROM region),
notes AS (SELECT symbol,
  md5('Symbol ' || symbol || '. Recent features: ' || price || '. State momentum, trend and risk in two or three sentences.') AS market,
  md5(CASE WHEN n IS NULL THEN 'Symbol ' || symbol || '. There is no crowd sentiment.'
    ELSE printf('Symbol %s. Crowd score %+.2f from %d messages (a, b). What does it imply for direction?', symbol, score, n) END) AS crowd,
  md5('Symbol ' || symbol || '. Headlines:' || chr(10) || news || chr(10) || 'What do they imply for direction?') AS read FROM c),
w AS (SELECT symbol, md5('Symbol ' || symbol || '.' || chr(10) || 'Market notes: ' || market || chr(10) || 'Sentiment notes: ' || crowd
  || chr(10) || 'News notes: ' || read || chr(10) || 'Weigh them into a one-hour view: a short briefing, then a JSON object with stance, yhat and confidence.') AS d FROM notes)
SELECT symbol, 'bearish' AS stance, {r(f"greatest(-0.1, least(0.1, ({DIGITS(1)} % 41 - 20) / 100.0))::DOUBLE")} AS yhat,
  {r(f"least(1.0, ({DIGITS(5)} % 13) / 10.0)::DOUBLE")} AS confidence, CAST(3600 AS INTEGER) AS horizon_s, CAST(0 AS INTEGER) AS ts,
  'On ' || d || '.' AS briefing_md, 'deep-v0' AS model_ver FROM w""")
oracle("deep_analysis_default", f"""
WITH {TK} SELECT DISTINCT symbol, 'neutral' AS stance, 0.0::DOUBLE AS yhat, 0.0::DOUBLE AS confidence, CAST(3600 AS INTEGER) AS horizon_s,
  CAST(0 AS INTEGER) AS ts, '' AS briefing_md, 'deep-v0' AS model_ver FROM tk""")
WS = "[\\s\\x{a0}\\x{85}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


def plain(html: str) -> str:
    """Text of HTML that uses only the basic entities, as the benchmark pages do."""
    x = f"regexp_replace({html}, '<[^>]+>', ' ', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·")):
        x = f"replace({x}, '{entity}', '{char}')"
    x = f"regexp_replace({x}, '&amp;?', '&', 'g')"
    return f"trim(regexp_replace({x}, '{WS}', ' ', 'g'))"


oracle("page_text", f"SELECT page_id, {plain('html')} AS text FROM pages")
oracle("marked_page_text", f"""
WITH t AS (SELECT page_id, {plain('html')} AS x FROM pages)
SELECT page_id, CAST(length(x) AS INTEGER) AS n, substring(x, 1, 6) AS start FROM t""")
oracle("iso_times", """
WITH e AS (SELECT event_id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000 AS ms FROM events)
SELECT event_id, CAST(CASE event_id % 10 WHEN 0 THEN s WHEN 1 THEN s - 7200 WHEN 6 THEN s WHEN 7 THEN ms / 1000.0
  WHEN 8 THEN s - s % 60 + 5400 WHEN 9 THEN s - s % 86400 END AS DOUBLE) AS epoch FROM e""")
oracle("excerpts", """
WITH d AS (SELECT doc_id, trim(replace(text, chr(10), ' ')) AS x FROM documents)
SELECT doc_id, CASE WHEN length(x) > 280 THEN substring(x, 1, 280) || '…' ELSE x END AS excerpt FROM d""")
oracle("normalized_symbols", """
WITH s AS (SELECT c_custkey AS key,
    ['btc', 'ETH-', 'sol', 'zzz', 'DOGE', 'xau', 'SPX500', ' eur', 'usd', 'AA.B', 'bad$'][c_custkey % 11 + 1]
    || ['usd', 'USDT', '-usdc', 'jpy ', '', '+', 'EUR'][c_custkey % 7 + 1] AS raw FROM customer),
u AS (SELECT *, rtrim(upper(trim(raw)), '+') AS s FROM s),
c AS (SELECT *, regexp_extract(replace(s, '-', ''), '^(BTC|ETH|SOL|XRP|ADA|DOGE|LTC|BCH|DOT|AVAX|LINK)(USDT|USDC|USD)$', 1) AS base FROM u),
x AS (SELECT key, raw, CASE WHEN s IN ('XAUUSD', 'XAU') THEN 'GC=F' WHEN s = 'SPX500' THEN '^GSPC' WHEN base <> '' THEN base || '-USD'
    WHEN s IN ('EURUSD', 'EURJPY', 'EUREUR', 'USDUSD', 'USDJPY', 'USDEUR') THEN s || '=X' ELSE s END AS symbol FROM c)
SELECT *, regexp_full_match(symbol, '[A-Za-z0-9._\\-\\^=]+') AS allowed FROM x""")
oracle("macro_series_ids", """
SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'CPIAUCSL' WHEN 1 THEN 'DGS10' WHEN 2 THEN 'FEDFUNDS' WHEN 3 THEN 'DGS5'
  WHEN 6 THEN 'M2SL' END AS series_id FROM part""")
oracle("connector_symbols", """
SELECT CASE event_id % 3 WHEN 0 THEN 'BTCUSDT' ELSE 'ETHUSDT' END AS symbol, event_id AS trade_id,
  CASE event_id % 3 WHEN 0 THEN 'Bitcoin' ELSE 'Ethereum' END AS name, CASE event_id % 3 WHEN 0 THEN 'BTC.X' ELSE 'ETH.X' END AS messages,
  CASE event_id % 3 WHEN 0 THEN 'Bitcoin' ELSE 'Ethereum' END AS posts, CASE event_id % 3 WHEN 0 THEN 'BTC-USD' ELSE 'ETH-USD' END AS daily
FROM events WHERE event_id % 3 < 2""")

# ---- learning and live views -----------------------------------------------------------------

LABELS = f"""{FEATS},
nx AS (SELECT *, lead(last_price) OVER (PARTITION BY symbol ORDER BY ts, trade_id) AS nxt FROM f),
lab AS (SELECT symbol, ts, trade_id, CAST((nxt - last_price) / last_price > 0 AS INTEGER) AS label FROM nx
  WHERE nxt IS NOT NULL AND last_price > 0 AND """ + " AND ".join(f"{c} IS NOT NULL" for c in FEATURE_NAMES) + ")"
ORDERED_NAMES = "list_position([" + ", ".join(f"'{n}'" for n in NAMES) + "], symbol)"
oracle("training_labels", f"WITH RECURSIVE {LABELS} SELECT symbol, ts, trade_id, label FROM lab")
oracle("pooled_folds", f"""
WITH RECURSIVE {LABELS},
i AS (SELECT *, row_number() OVER (ORDER BY {ORDERED_NAMES}, ts, trade_id) - 1 AS pos, count(*) OVER () // 6 AS fs FROM lab)
SELECT symbol, ts, trade_id, pos, CASE WHEN pos // fs BETWEEN 1 AND 5 THEN pos // fs END AS fold FROM i""")
oracle("walk_forward_folds", f"""
WITH RECURSIVE {LABELS},
i AS (SELECT *, row_number() OVER (ORDER BY {ORDERED_NAMES}, ts, trade_id) - 1 AS pos, count(*) OVER () // 6 AS fs FROM lab),
k AS (SELECT unnest([1, 2, 3, 4, 5]) AS fold)
SELECT fold, count(*) FILTER (WHERE pos < fs * fold) AS trained, count(*) FILTER (WHERE pos < fs * fold AND label = 1) AS trained_up,
  count(*) FILTER (WHERE pos >= fs * fold) AS tested, count(*) FILTER (WHERE pos >= fs * fold AND label = 1) AS tested_up
FROM i JOIN k ON pos < fs * (fold + 1) GROUP BY fold""")
oracle("chronological_index", f"""
WITH RECURSIVE {LABELS} SELECT symbol, ts, trade_id,
  row_number() OVER (ORDER BY ts, trade_id, {ORDERED_NAMES}) - 1 AS pos FROM lab""")
oracle("price_history", f"""
WITH {TK}, fl AS (SELECT symbol, ts, trade_id, floor(price) AS ref_price FROM tk WHERE floor(price) <> 0),
c AS (SELECT *, lag(ref_price) OVER (PARTITION BY symbol ORDER BY ts, trade_id) AS b FROM fl)
SELECT symbol, ts, trade_id, ref_price FROM c WHERE b IS DISTINCT FROM ref_price AND ref_price > 0
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, trade_id DESC) <= 60""")

# ---- streams ---------------------------------------------------------------------------------

oracle("stream_dedup", f"WITH {TK} SELECT symbol, trade_id, price FROM tk")
oracle("stream_features", ORACLES["feature_rows"])
oracle("stream_outcomes", f"""
WITH {BY_NAME} SELECT symbol, strategy_id, CAST(3600 AS INTEGER) AS horizon_s, {r('(volume - 50.0) / 997.0')} AS yhat,
  {r('realized_return')} AS realized_return, hit, {r('abs((volume - 50.0) / 997.0 - realized_return)')} AS abs_error, {r('confidence')} AS confidence,
  {r('ref_price')} AS ref_price, {r('realized_price')} AS realized_price, pred_ts, scored_ts, 'v0' AS model_ver,
  scored_trade_id, pred_trade_id FROM o WHERE strategy_id = 'volume_up'""")
oracle("stream_standings", f"""
WITH {BY_NAME}, {rolled(200)} SELECT strategy_id, scored_ts, seq, CAST(n AS INTEGER) AS n, {r('dir_acc')} AS dir_acc,
  {r('mean_confidence')} AS mean_confidence FROM roll WHERE strategy_id = 'volume_up'""")
oracle("stream_forecasts", ORACLES["model_forecasts"])
oracle("stream_sentiment", ORACLES["message_counts"])
oracle("stream_latest_features", ORACLES["latest_features"])
oracle("stream_seeded_standings", f"""
WITH {BY_NAME}, {rolled(200)}, half AS (SELECT (min(scored_ts) + max(scored_ts)) // 2 AS start FROM o)
SELECT strategy_id, scored_ts, seq, CAST(n AS INTEGER) AS n, {r('dir_acc')} AS dir_acc,
  {r('mean_confidence')} AS mean_confidence FROM roll, half WHERE scored_ts >= start""")
oracle("stream_alerts", f"WITH {ALERTS} SELECT symbol, kind, severity, message, ts FROM al")
oracle("appended_outcomes", ORACLES["scored_outcomes"])
oracle("stream_trade_messages", ORACLES["source_trade_messages"])
