"""The trees against Spark's own booster, and folds that share their passes."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from marketgrade.operators import boosting, learning


@pytest.fixture
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 6)).round(2)
    x[:, 1] = rng.integers(0, 3, 1500)
    x[:, 2] = 1.0
    up = (x[:, 0] + x[:, 1] * x[:, 4] + rng.normal(size=1500) > 0).astype(int)
    made = [(i, int(u), *map(float, v)) for i, (u, v) in enumerate(zip(up, x, strict=True))]
    return spark.createDataFrame(made, f"pos long, label int, {', '.join(f'{c} double' for c in learning.FEATURE_ORDER)}")


def spark_trees(rows, columns, trees):
    booster = GBTClassifier(
        labelCol="label", maxIter=trees, maxDepth=learning.DEPTH, stepSize=learning.LEARNING_RATE, minInstancesPerNode=learning.MIN_ROWS_PER_LEAF, seed=0
    )
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="features"), booster]).fit(rows)


@pytest.mark.parametrize("width", [6, 3])
def test_same_probabilities_as_sparks_trees(spark, rows, width, monkeypatch):
    monkeypatch.setattr(boosting, "REPLAY", 3)
    columns = learning.FEATURE_ORDER[:width]
    ours = learning.up_probability(learning.fit(rows, columns, trees=8), rows)
    theirs = spark_trees(rows, columns, 8).transform(rows).select("pos", vector_to_array("probability")[1].alias("p"))
    pairs = ours.join(theirs, "pos").select("p_up", "p").collect()
    assert len(pairs) == 1500 and len({r.p for r in pairs}) > 20
    assert max(abs(r.p_up - r.p) for r in pairs) < 1e-9


def test_folds_share_their_passes(spark, rows):
    def run(splits):
        spark.sparkContext.setJobGroup(f"folds-{splits}", "folds")
        try:
            found = learning.walk_forward(rows, splits=splits, trees=6).collect()
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return found, len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"folds-{splits}"))

    (two, few), (five, more) = run(2), run(5)
    assert [r.fold for r in two] == [1, 2] and [r.n for r in five] == [250] * 5
    # A fit of its own took each further fold about 30 jobs.
    assert more - few < 30
    for r in five:
        train, test = rows.where(F.col("pos") < 250 * r.fold), rows.where(F.floor(F.col("pos") / 250) == r.fold)
        made = spark_trees(train, learning.FEATURE_ORDER, 6).transform(test)
        right = made.agg(F.avg(((vector_to_array("probability")[1] >= 0.5).cast("int") == F.col("label")).cast("double"))).first()[0]
        assert r.accuracy == pytest.approx(right, abs=1e-12)


def test_bounds_of_bins():
    assert boosting.bin_bounds(np.array([2.0, 1.0, 2.0, 4.0])).tolist() == [1.5, 3.0]
    assert boosting.bin_bounds(np.ones(5)).tolist() == []
    assert boosting.bin_bounds(np.arange(100.0), 4).tolist() == [24.5, 49.5, 74.5]


def test_refuses_absent_features_other_labels_and_no_rows(spark, rows):
    absent = rows.withColumn("rsi", F.when(F.col("pos") != 7, F.col("rsi")))
    for wrong in (absent, rows.withColumn("label", F.lit(2)), rows.where("pos < 0")):
        with pytest.raises(Exception, match="absent|labels must be"):
            learning.fit(wrong, trees=1)
    model = learning.fit(rows, trees=1)
    with pytest.raises(Exception, match="absent"):
        model.transform(absent).collect()


def test_same_bins_as_sparks_trees_beyond_ten_thousand_rows(spark):
    x = [F.when(F.rand(i) < 0.9, F.round(F.randn(i + 9), 3)).otherwise(0.0).alias(c) for i, c in enumerate(learning.FEATURE_ORDER)]
    rows = learning.cut(spark.range(0, 30_000, 1, 3).select(F.col("id").alias("pos"), *x))
    rows = rows.withColumn("label", (F.col("rsi") + F.col("vol") > F.rand(1)).cast("int"))
    rows = learning.cut(rows)
    ours = learning.up_probability(learning.fit(rows, trees=3), rows)
    theirs = spark_trees(rows, learning.FEATURE_ORDER, 3).transform(rows).select("pos", vector_to_array("probability")[1].alias("p"))
    most = ours.join(theirs, "pos").agg(F.max(F.abs(F.col("p_up") - F.col("p")))).first()[0]
    assert most < 1e-9


def test_more_bins_than_usual_where_the_draw_is_larger_than_expected(spark):
    x = [F.round(F.randn(i + 9), 6).alias(c) for i, c in enumerate(learning.FEATURE_ORDER)]
    rows = learning.cut(spark.range(0, 30_000, 1, 16).select(F.col("id").alias("pos"), *x))
    rows = learning.cut(rows.withColumn("label", (F.col("rsi") + F.col("vol") + F.randn(1) > 1.5).cast("int")))
    model = learning.fit(rows, trees=3)
    assert max(map(len, model.splits)) >= boosting.BINS
    theirs = spark_trees(rows, learning.FEATURE_ORDER, 3).transform(rows).select("pos", vector_to_array("probability")[1].alias("p"))
    most = learning.up_probability(model, rows).join(theirs, "pos").agg(F.max(F.abs(F.col("p_up") - F.col("p")))).first()[0]
    assert most < 1e-9


def test_splits_beyond_the_usual_bins_are_kept_and_used():
    tree = (np.zeros(1, int), np.array([32]), np.array([-1.0, 1.0]))
    made = boosting.Boosted(("x",), [np.arange(33) + 0.5], [tree], 0.05)
    for model in (made, boosting.Boosted.from_json(made.to_json())):
        assert model.margin([np.array([0.0, 32.0, 33.0])]).tolist() == [-1.0, -1.0, 1.0]
