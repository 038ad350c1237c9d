"""Exchange payloads, klines and authored signals to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Trade payload columns. The payload's ``T`` is named trade_time: column names ignore case.
TRADE = ("s", "t", "p", "q", "trade_time")
KAFKA_COLUMNS = (
    "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp, "
    "timestampType int"
)


def read_topic(
    spark: SparkSession,
    brokers: str,
    topics: str,
    *,
    from_start: bool = False,
    streaming: bool = True,
) -> DataFrame:
    """A broker topic as rows; needs the Kafka connector on the class path.

    A batch read always covers the whole topic.
    """
    reader = spark.readStream if streaming else spark.read
    reader = reader.format("kafka").option("kafka.bootstrap.servers", brokers)
    start = "earliest" if from_start or not streaming else "latest"
    return reader.option("subscribe", topics).option("startingOffsets", start).load()


def read_topic_files(
    spark: SparkSession, path: str, max_files: int = 100, since_ms: int | None = None
) -> DataFrame:
    """A folder of Parquet files with the broker's columns, as a stream of ``max_files`` a micro-batch.

    It starts with the earliest message, or with the first of time ``since_ms``.
    """
    rows = spark.readStream.schema(KAFKA_COLUMNS).option("maxFilesPerTrigger", max_files).parquet(path)
    return rows if since_ms is None else rows.where(F.col("timestamp") >= F.timestamp_millis(F.lit(since_ms)))


def each_once(messages: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream of messages without redeliveries, known by their place in the topic.

    State is kept for ``delay`` of the broker's time. A message that comes later than that is taken
    as a redelivery, so ``delay`` must exceed the time by which one partition is read ahead of another.
    """
    return messages.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(
        ["topic", "partition", "offset"]
    )


def unwrap(value: Column) -> Column:
    """The payload of a combined-stream message, or the message itself when it has none."""
    return F.coalesce(F.get_json_object(value.cast("string"), "$.data"), value.cast("string"))


TICK = ["symbol", "price", "volume", "ts", "trade_id"]


def trades(messages: DataFrame, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Raw trade messages to ticks, without those that ``split_trades`` quarantines."""
    return split_trades(messages, value, keep)[0]


def split_trades(
    messages: DataFrame, value: str = "value", keep: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """Raw trade messages to ticks, and the messages that lack a field or whose numbers do not parse.

    Bad messages are returned with their text, not raised.
    """
    cells = F.json_tuple(unwrap(F.col(value)), "s", "t", "p", "q", "T").alias(*TRADE)
    read = _ticks(messages.select(*keep, F.col(value).cast("string").alias("_text"), cells), (*keep, "_text"))
    whole = F.lit(True)
    for name in TICK:
        whole = whole & F.col(name).isNotNull()
    bad = read.where(~whole).select(*keep, F.col("_text").alias(value))
    return read.where(whole).select(*keep, *TICK), bad


def normalize(payloads: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Trade payload columns to ticks with their trade id; rows that lack one are left out."""
    return _ticks(payloads, keep).dropna(subset=TICK)


def _ticks(payloads: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    return payloads.select(
        *keep,
        F.col("s").alias("symbol"),
        F.col("p").try_cast("double").alias("price"),
        F.col("q").try_cast("double").alias("volume"),
        F.col("trade_time").try_cast("bigint").alias("ts"),
        F.col("t").try_cast("bigint").alias("trade_id"),
    )


def rest_payload(rows: DataFrame) -> DataFrame:
    """Polled trades (symbol, id, price, qty, time) in the pushed trade's columns."""
    return rows.select(
        F.col("symbol").alias("s"),
        F.col("id").alias("t"),
        F.col("price").alias("p"),
        F.col("qty").alias("q"),
        F.col("time").alias("trade_time"),
    )


def klines(rows: DataFrame, value: str = "value", keep: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Kline arrays as JSON text to (close time, close, volume)."""
    k = F.from_json(F.col(value), "array<string>")
    return rows.select(
        *keep,
        F.get(k, F.lit(6)).try_cast("bigint").alias("ts"),
        F.get(k, F.lit(4)).try_cast("double").alias("price"),
        F.get(k, F.lit(5)).try_cast("double").alias("volume"),
    )


VERDICT = (
    "sentiment struct<yhat:double,confidence:double,note:string>, "
    "deep struct<stance:string,yhat:double,confidence:double,briefing_md:string>"
)


def authored_signals(files: DataFrame, value: str = "value") -> DataFrame:
    """Authored verdict files to one row per symbol, absent fields neutral."""
    signals = F.from_json(F.get_json_object(value, "$.signals"), f"map<string, struct<{_inline()}>>")
    rows = files.select(F.explode(signals).alias("symbol", "_s"))
    return rows.select(
        "symbol",
        F.coalesce("_s.sentiment.yhat", F.lit(0.0)).alias("yhat"),
        F.coalesce("_s.sentiment.confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("_s.deep.stance", F.lit("neutral")).alias("stance"),
        F.coalesce("_s.deep.yhat", F.lit(0.0)).alias("deep_yhat"),
        F.coalesce("_s.deep.confidence", F.lit(0.0)).alias("deep_confidence"),
        F.coalesce("_s.deep.briefing_md", F.lit("")).alias("briefing_md"),
    )


def _inline() -> str:
    return ", ".join(f"{n}: {t}" for n, t in (p.split(" ", 1) for p in VERDICT.split(", ")))


def read_authored_signals(spark: SparkSession, path: str) -> DataFrame:
    """Read the verdict files anew; call it per micro-batch to pick up refreshed verdicts."""
    return authored_signals(spark.read.text(path, wholetext=True))
