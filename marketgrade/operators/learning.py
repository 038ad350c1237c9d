"""Labels, walk-forward folds, training and evaluation of the direction classifier."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .boosting import Boosted, boost
from .timeline import BLOCK_ROWS, HOUR_MS, Timeline, blocks, number

FEATURE_ORDER = ("ema_fast", "ema_slow", "rsi", "vol", "ret_1", "vwap")
TREES = 120
LEARNING_RATE = 0.05
MIN_ROWS_PER_LEAF = 20
DEPTH = 4  # at most 16 leaves


def feature_values(columns: Sequence[str] = FEATURE_ORDER) -> list:
    """Feature columns in model order, absent values as 0."""
    return [F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in columns]


def labelled(
    features: DataFrame,
    horizon: int = 1,
    columns: Sequence[str] = FEATURE_ORDER,
    width: int = HOUR_MS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Feature rows with ``label``: 1 if the price is higher ``horizon`` rows later, else 0.

    The look ahead runs over all rows of a symbol. Rows without a future, without a positive
    price or without every feature are dropped after it.
    """
    line = Timeline(("symbol",), ("ts", "trade_id"), width)
    part = blocks(number(features, line, "_i"), ["symbol"], "_i", after=horizon, rows=block_rows)
    ahead = part.rows.withColumn("_next", F.lead("last_price", horizon).over(part.window))
    ready = part.finish(ahead).drop("_i").filter(
        F.col("_next").isNotNull() & (F.col("last_price") > 0)
    )
    move = (F.col("_next") - F.col("last_price")) / F.col("last_price")
    return (
        ready.dropna(subset=list(columns))
        .withColumn("label", (move > 0).cast("int"))
        .drop("_next")
    )


def pooled_index(
    rows: DataFrame, symbols: Sequence[str], mode: str = "pooled", width: int = HOUR_MS
) -> DataFrame:
    """Add ``pos``: each row's place in the training set.

    ``pooled`` concatenates the symbols in the given order, each in time order.
    ``chronological`` orders all rows by time instead.
    """
    place = F.array_position(F.array(*[F.lit(s) for s in symbols]), F.col("symbol"))
    chosen = rows.filter(F.col("symbol").isin(list(symbols))).withColumn("_place", place)
    if mode == "chronological":
        return number(chosen, Timeline((), ("ts", "trade_id", "_place"), width), "pos").drop("_place")
    if mode != "pooled":
        raise ValueError(f"mode must be pooled or chronological, not {mode!r}")
    indexed = number(chosen, Timeline(("symbol",), ("ts", "trade_id"), width), "_i")
    counts = chosen.groupBy("_place").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    sizes = F.broadcast(  # at most one row per listed symbol
        counts.select("_place", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    return (
        indexed.join(sizes, "_place", "inner")
        .withColumn("pos", F.col("_before") + F.col("_i"))
        .drop("_place", "_before", "_i")
    )


def fold_bounds(n: int, splits: int = 5) -> Iterator[tuple[int, int]]:
    """Expanding folds: (end of training, end of test) for k = 1..splits."""
    size = n // (splits + 1)
    return ((size * k, size * (k + 1)) for k in range(1, splits + 1))


def with_fold(indexed: DataFrame, n: int, splits: int = 5) -> DataFrame:
    """Add ``fold``: the fold that tests the row, null for the first part and the remainder.

    ``n`` is the number of rows of the training set.
    """
    size = n // (splits + 1)
    fold = F.floor(F.col("pos") / F.lit(max(size, 1)))
    tested = (fold >= 1) & (fold <= splits) & F.lit(size > 0)
    return indexed.withColumn("fold", F.when(tested, fold))


def fold_sizes(indexed: DataFrame, n: int, splits: int = 5) -> DataFrame:
    """Rows and rising rows that each fold trains on and tests (fold, trained, trained_up, tested, tested_up)."""
    bounds = F.array(*[F.struct(F.lit(k).alias("fold"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(fold_bounds(n, splits), 1)])
    rows = indexed.select("pos", "label", F.explode(bounds).alias("f")).where(F.col("pos") < F.col("f.b"))
    training, up = F.col("pos") < F.col("f.a"), F.col("label") == 1
    return rows.groupBy(F.col("f.fold").alias("fold")).agg(
        F.count_if(training).alias("trained"),
        F.count_if(training & up).alias("trained_up"),
        F.count_if(~training).alias("tested"),
        F.count_if(~training & up).alias("tested_up"),
    )


def fit(rows: DataFrame, columns: Sequence[str] = FEATURE_ORDER, trees: int = TREES) -> Boosted:
    """Gradient-boosted trees on the label."""
    return _boost(cut(rows.select("label", *columns)), [F.lit(True)], columns, trees)[0]


def _boost(rows: DataFrame, members: list[Column], columns: Sequence[str], trees: int) -> list[Boosted]:
    return boost(rows, members, columns, trees, LEARNING_RATE, DEPTH, MIN_ROWS_PER_LEAF)


def up_probability(model: Boosted, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("p_up", vector_to_array("probability")[1])


def walk_forward(
    indexed: DataFrame,
    splits: int = 5,
    columns: Sequence[str] = FEATURE_ORDER,
    trees: int = TREES,
) -> DataFrame:
    """Out-of-sample accuracy per fold (fold, n, accuracy).

    All folds are fitted in the same passes over the rows, each on its own part. A fold whose
    training part has a single class, or whose test part is empty, is skipped.
    """
    rows = cut(indexed.select("pos", "label", *columns))
    n = rows.count()
    bounds = list(enumerate(fold_bounds(n, splits), start=1))
    classes = rows.agg(*[F.count_distinct(F.when(F.col("pos") < end, F.col("label"))) for _, (end, _) in bounds]).first()
    kept = [(fold, a, b) for (fold, (a, b)), c in zip(bounds, classes, strict=True) if b > a and c > 1]
    if not kept:
        return rows.sparkSession.createDataFrame([], "fold int, n bigint, accuracy double")
    models = _boost(rows, [F.col("pos") < end for _, end, _ in kept], columns, trees)
    right = ((F.col("p_up") >= 0.5).cast("int") == F.col("label")).cast("double")
    scored = None
    for (fold, start, end), model in zip(kept, models, strict=True):
        test = rows.filter((F.col("pos") >= start) & (F.col("pos") < end))
        result = up_probability(model, test).agg(
            F.lit(fold).alias("fold"),
            F.count(F.lit(1)).alias("n"),
            F.avg(right).alias("accuracy"),
        )
        scored = result if scored is None else scored.unionByName(result)
    return scored


def mean_accuracy(folds: DataFrame) -> DataFrame:
    """Mean of the fold accuracies, each fold counting the same; null without folds."""
    return folds.agg(F.avg("accuracy").alias("oos_dir_acc"), F.count(F.lit(1)).alias("folds"))


def save_model(model: Boosted, path: str, columns: Sequence[str], version: str, metrics: dict):
    """The fitted model, with a one-row JSON table of its columns, version and metrics."""
    import json

    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")
    spark.createDataFrame(
        [(list(columns), version, json.dumps(metrics))],
        "columns array<string>, model_ver string, metrics string",
    ).coalesce(1).write.mode("overwrite").json(f"{path}/about")


def load_model(spark, path: str) -> tuple[Boosted, list[str], str, dict]:
    import json

    about = spark.read.schema("columns array<string>, model_ver string, metrics string").json(
        f"{path}/about"
    ).first()
    return Boosted.from_json(spark.read.text(f"{path}/model").first().value), about.columns, about.model_ver, json.loads(about.metrics)
