"""The partitioned Parquet lake and the operational tables kept beside it."""

from __future__ import annotations

import time
from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.features import FEATURES

# Topics that are kept, and the dataset each one lands in.
DATASETS = {
    "features.out": "features",
    "predictions.out": "predictions",
    "scores.out": "outcomes",
}
RETENTION_DAYS = 90


def dataset_of(topic: Column) -> Column:
    """Dataset of a topic, null for topics that are not kept."""
    pairs = [F.lit(x) for kv in DATASETS.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), topic)


def partition_date(ts: Column, scored_ts: Column, pred_ts: Column) -> Column:
    """UTC day of the first of the three times that is neither absent nor 0."""
    usable = [F.when(c != 0, c) for c in (ts, scored_ts, pred_ts)]
    millis = F.coalesce(*usable, F.lit(0))
    days = F.floor(millis / F.lit(86_400_000)).cast("int")
    return F.date_format(F.date_from_unix_date(days), "yyyy-MM-dd")


def route(records: DataFrame, topic: str = "topic") -> DataFrame:
    """Add dataset, dt and symbol to records; other topics are dropped."""
    at = lambda c: F.col(c) if c in records.columns else F.lit(None).cast("bigint")
    symbol = F.coalesce("symbol", F.lit("UNKNOWN"))
    return (
        records.withColumn("dataset", dataset_of(F.col(topic)))
        .filter(F.col("dataset").isNotNull())
        .withColumn("dt", partition_date(at("ts"), at("scored_ts"), at("pred_ts")))
        .withColumn("symbol", symbol)
    )


def flatten_features(messages: DataFrame, names: Sequence[str] = FEATURES) -> DataFrame:
    """Lift the ``features`` map into columns; a feature wins over a field of the same name."""
    fields = [c for c in messages.columns if c != "features" and c not in names]
    return messages.select(
        *fields, *[F.try_element_at("features", F.lit(n)).alias(n) for n in names]
    )


def write_dataset(df: DataFrame, root: str, dataset: str, max_records: int = 5_000_000) -> None:
    """Append to a dataset, partitioned by day and symbol.

    The rebalance hint gathers small partitions into few files and lets adaptive execution
    split a symbol that dominates a day.
    """
    (
        df.hint("rebalance", "dt", "symbol")
        .write.mode("append")
        .partitionBy("dt", "symbol")
        .option("maxRecordsPerFile", max_records)
        .parquet(f"{root.rstrip('/')}/{dataset}")
    )


def read_dataset(spark: SparkSession, root: str, dataset: str, schema: T.StructType | str) -> DataFrame:
    """Read a dataset with a fixed schema, so ``dt`` and ``symbol`` stay text.

    ``schema`` names all columns, dt and symbol included. Filters on them prune folders.
    """
    return spark.read.schema(schema).parquet(f"{root.rstrip('/')}/{dataset}")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_in_order(df: DataFrame, path: str, by: str, limit: int) -> None:
    """Append rows as files of about ``limit`` rows each, which a file stream takes in the order of ``by``.

    Rows of equal ``by`` share a file. Streams go by the time of a file, so the files of this call
    get times a second apart.
    """
    spark, before = df.sparkSession, set(names_in(df.sparkSession, path))
    append(df.repartitionByRange(max(1, -(-df.count() // limit)), by), path)
    written = sorted(n for n in names_in(spark, path) if n.startswith("part-") and n not in before)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    now = int(time.time())
    for i, name in enumerate(written):
        fs.setTimes(spark._jvm.org.apache.hadoop.fs.Path(folder, name), (now - len(written) + i) * 1000, -1)


def append_batch(df: DataFrame, path: str, batch: int) -> None:
    """Append the rows of a numbered batch, once: a repeated batch replaces its first attempt."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def read_batches(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """All rows that ``append_batch`` wrote; ``schema`` is without the batch number."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it does not exist."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def recent_outcomes(outcomes: DataFrame, limit: int = 200) -> DataFrame:
    """The latest outcomes over all strategies, oldest first; ``id`` breaks ties."""
    newest = outcomes.orderBy(F.col("scored_ts").desc(), F.col("id").desc()).limit(limit)
    return newest.orderBy("scored_ts", "id")


def keep_last(rows: DataFrame, keys: Sequence[str], written: str) -> DataFrame:
    """Upsert by key: of all versions of a key, the one written last."""
    row = F.struct(*rows.columns)
    return (
        rows.groupBy(*keys).agg(F.max_by(row, written).alias("_row")).select("_row.*")
    )


def save_snapshots(standing: DataFrame, path: str, written: int) -> None:
    """Append standings of one or more ``ts``; ``written`` grows from call to call."""
    packed = standing.groupBy("ts").agg(
        F.to_json(
            F.sort_array(F.collect_list(F.struct([c for c in standing.columns if c != "ts"])))
        ).alias("standings")
    )
    append(packed.withColumn("written", F.lit(written).cast("bigint")), path)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Current standings per ``ts``: the last write of each wins."""
    log = spark.read.schema("ts bigint, standings string, written bigint").parquet(path)
    return keep_last(log, ["ts"], "written").drop("written")


def new_models(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Models not registered yet; of equals in one batch the earliest is kept."""
    row = F.struct(*incoming.columns)
    first = (
        incoming.groupBy("name", "version")
        .agg(F.min_by(row, "created_ts").alias("_row"))
        .select("_row.*")
    )
    return first.join(existing.select("name", "version"), ["name", "version"], "left_anti")


def register_models(incoming: DataFrame, path: str) -> None:
    """Insert models unless their (name, version) is there already."""
    spark = incoming.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    existing = (
        spark.read.schema(incoming.schema).parquet(path)
        if fs.exists(hadoop)
        else spark.createDataFrame([], incoming.schema)
    )
    append(new_models(incoming, existing), path)


def expired(partitions: DataFrame, today: str, days: int = RETENTION_DAYS) -> DataFrame:
    """Partition rows (with ``dt``) older than the retention period."""
    limit = date.fromisoformat(today) - timedelta(days=days)
    return partitions.filter(F.col("dt") < str(limit))


def expire_dataset(
    spark: SparkSession, root: str, dataset: str, today: str, days: int = RETENTION_DAYS
) -> list[str]:
    """Delete the expired day folders of a dataset; only folder names are read."""
    base = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{dataset}")
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    limit = f"dt={date.fromisoformat(today) - timedelta(days=days)}"
    gone = []
    for status in fs.listStatus(base):
        name = status.getPath().getName()
        if name.startswith("dt=") and name < limit:
            fs.delete(status.getPath(), True)
            gone.append(name.removeprefix("dt="))
    return sorted(gone)
