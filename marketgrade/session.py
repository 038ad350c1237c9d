"""Session set-up, shared scratch folders and the places where lineage is cut."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

#: Bytes, about, of a batch that goes to a Python worker; without it Spark takes up to 10,000 rows or 64 MB.
BATCH_BYTES = 4 << 20
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(master: str | None = None, app: str = "marketgrade", **conf: str) -> SparkSession:
    """A session with the settings the engine relies on; extra keywords override them.

    Keyword names use ``__`` for dots, so ``spark__sql__shuffle__partitions="64"`` is valid.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        BATCH_LIMIT: str(BATCH_BYTES),
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the cluster names none, a folder under ``spark.sql.warehouse.dir``, which all
    executors share as well; never a folder of one machine.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        configured = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(configured)
    return configured


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared checkpoint folder, removed when the session's JVM ends."""
    folder = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from there.

    Used where one expensive result feeds several branches. Checkpoint files sit in shared
    storage, so a lost executor costs a re-read and not a re-computation.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """As ``cut``, but as a compressed Parquet table, of which later reads take only the columns they need."""
    spark = df.sparkSession
    folder = scratch_folder(spark, name)
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of batches that go to Python, as ``build_session`` does, where nobody has.

    A task holds a batch in the JVM and in Python at once, and what Python makes of it.
    """
    if spark.conf.get(BATCH_LIMIT, None) is None:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))


def ship_package(spark: SparkSession) -> None:
    """Make functions and processors of this package travel inside the tasks that use them.

    Not needed where the package is installed on every node. Files added to the application
    would not reach the stream runner on the driver, so the code is pickled by value instead.
    The batches that those tasks take are bounded as well.
    """
    bound_batches(spark)
    package = sys.modules[__name__.partition(".")[0]]
    if package.__name__ not in cloudpickle.list_registry_pickle_by_value():
        cloudpickle.register_pickle_by_value(package)
