"""Repeated holdout: exact sizes without ranking the rows, and the classifier over its draws."""

import random

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import Window
from pyspark.sql import functions as F

from newsquant.functions.hashing import random_key
from newsquant.operators import classify, sample


@pytest.mark.parametrize("frac", [0.0, 0.31, 0.7, 1.0])
def test_cuts_equal_ranks(spark, monkeypatch, frac):
    monkeypatch.setattr(sample, "CUT_ROWS", 40)
    df = spark.range(700).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("event_id"), "id")
    got = sample.repeated_holdout(df, frac, 5, 3)
    assert got.columns == ["event_id", "id", "draw", "split"] and got.count() == 3500
    named = F.concat_ws(":", "event_id", F.col("draw").cast("string"))
    place = F.row_number().over(Window.partitionBy("draw").orderBy(random_key(named, 3), named))
    wrong = got.withColumn("want", F.when(place <= int(700 * frac), "train").otherwise("test")).filter("want <> split")
    assert wrong.count() == 0


def test_rows_are_not_moved(spark):
    got = sample.repeated_holdout(spark.range(100).withColumnRenamed("id", "event_id"), 0.7, 4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Window" not in plan and "hashpartitioning" not in plan
    assert sample.repeated_holdout(spark.range(0).withColumnRenamed("id", "event_id"), 0.7, 4).count() == 0


def test_classifier_over_draws(spark):
    rng = random.Random(1)
    points = [(f"p{i}", [rng.uniform(-1, 1), rng.uniform(-1, 1)]) for i in range(200)]
    rows = [(i, Vectors.dense(x), int(x[0] + x[1] > 0)) for i, x in points if abs(x[0] + x[1]) > 0.2]
    df = spark.createDataFrame(rows, ["id", "features", "label"])
    out = classify.holdout_svm(df, times=3).collect()
    n = len(rows) - int(len(rows) * 0.7)
    assert [r.draw for r in out] == [0, 1, 2] and {r.n_test for r in out} == {n}
    assert min(r.accuracy for r in out) > 0.95
