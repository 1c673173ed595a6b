"""What oversampling need not do on all encoded rows, and its nearest points."""

import numpy as np

from transferlens.functions import joins
from transferlens.operators import balancing, features
from transferlens.operators.features import FeatureEncoder
from transferlens.plans import model_queries


def test_known_class_sizes_are_not_counted_on_encoded_rows(spark, monkeypatch):
    def class_sizes(*_):
        raise AssertionError("known")

    monkeypatch.setattr(balancing, "class_sizes", class_sizes)
    assert model_queries.synthetic_minority(spark, "/root/testdata/sf0.001").count() > 0


def test_frequent_unknown_values_are_looked_for_before_any_join(spark, monkeypatch):
    df = spark.createDataFrame([(float(i), f"a{i % 7}", f"b{i % 5}", "f", "d") for i in range(200)], "amount_received double, account string, account_1 string, payment_format string, day string")
    encoder = FeatureEncoder().fit(df)
    before = sorted(encoder.transform_to_vector(df, ["amount_received"]).collect())
    plans = []

    def unknown(rows, lookup, key, real=joins._frequent_unknown):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return real(rows, lookup, key)

    monkeypatch.setattr(joins, "_frequent_unknown", unknown)
    monkeypatch.setattr(features, "BROADCAST_BYTES", 0)
    assert sorted(encoder.transform_to_vector(df, ["amount_received"]).collect()) == before
    assert len(plans) == 4 and not any("Join" in p for p in plans)


def test_nearest_points_with_ties_and_equal_axes():
    rng = np.random.default_rng(5)
    x = np.column_stack([np.ones(600), rng.integers(0, 6, 600), rng.integers(0, 4, 600)]).astype(float)
    ids = rng.permutation(600)
    found = balancing._nearest(ids, x, ids, x, 6)
    for i in range(0, 600, 37):
        d = ((x - x[i]) ** 2).sum(axis=1)
        first = np.lexsort((ids, d))[:6]
        assert found["near"][i].tolist() == ids[first].tolist() and found["dist"][i].tolist() == d[first].tolist()
