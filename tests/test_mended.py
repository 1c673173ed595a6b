"""Cases that once gave wrong answers."""

import math

import pytest
from pyspark.sql import functions as F

from transferlens.operators import metrics
from transferlens.operators.boosting import StumpBooster
from transferlens.operators.features import FeatureEncoder
from transferlens.operators.models import logistic, random_forest
from transferlens.operators.profiling import distinct_counts
from transferlens.operators.splits import pack
from transferlens.operators.stats import variance_inflation


def test_nan_is_no_distinct_value(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (1.0,)], "x double")
    assert distinct_counts(df).first()["n_distinct"] == distinct_counts(df, approximate=True).first()["n_distinct"] == 1


def test_vif_of_proportional_and_constant_columns(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b"), F.rand(1).alias("c"), F.lit(3.0).alias("d"))
    got = {r["feature"]: r["vif"] for r in variance_inflation(df, ["a", "b", "c", "d"]).collect()}
    assert got["a"] == got["b"] == math.inf and 1 <= got["c"] < 2 and got["d"] is None and got["const"] == math.inf


def test_a_value_called_null_and_a_missing_one(spark):
    df = spark.createDataFrame([("null",), (None,)], "k string")
    encoder = FeatureEncoder([], [], ["k"]).fit(df)
    assert encoder.categories == {"k": ["null", None]} and encoder.feature_names == ["k_null", "k_null_"]
    got = encoder.transform_to_vector(df, []).collect()
    assert sorted(tuple(r["features"].toArray()) for r in got) == [(0.0, 1.0), (1.0, 0.0)]


def test_many_bins_do_not_wrap(spark):
    from pyspark.ml.feature import VectorAssembler

    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.range(2000).select(F.col("id").cast("double").alias("x"), (F.col("id") >= 1900).cast("double").alias("label")))
    assert StumpBooster(rounds=1).fit(df).transform(df).where("prediction <> label").count() == 0
    with pytest.raises(ValueError):
        pack(df, "features", "label", bins=300)


def test_penalty_follows_the_rows_fitted_on(spark):
    from pyspark.ml.feature import VectorAssembler

    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.range(40).select((F.col("id") / 10.0).alias("x"), (F.col("id") % 3 == 0).cast("double").alias("label")))
    once, twice = logistic(0.1).fit(df), logistic(0.05).fit(df.union(df))  # twice the summed loss and twice the penalty
    assert abs(once.weight_list()[0] - twice.weight_list()[0]) < 1e-7


def test_depth_and_threshold_limits(spark):
    assert random_forest(depth=31).setting().depth == 31 and random_forest().setting().depth is None
    none = spark.createDataFrame([(0.1, 0)], "score double, is_laundering int")
    assert metrics.threshold_for_tpr(metrics.roc_curve(none), 0.5).count() == 0
