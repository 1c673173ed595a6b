import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

import transferlens.operators.features as features_module
from transferlens.operators.balancing import nearest_points, oversample, with_neighbours
from transferlens.operators.features import FeatureEncoder, FittedEncoder

SCHEMA = "row_key string, amount_received double, account string, account_1 string, payment_format string, day string"


@pytest.fixture(scope="module")
def train(spark):
    rows = [
        ("1", 1.0, "A", "X", "ACH", "Monday"),
        ("2", 2.0, "A", "X", "Cash", "Friday"),
        ("3", 3.0, "B", "X", "ACH", "Monday"),
        ("4", 10.0, None, "Y", None, "Monday"),
        ("5", None, "A", "Y", "Cash", "Friday"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def fitted(train):
    return FeatureEncoder().fit(train)


def test_fit(fitted):
    assert fitted.medians == {"amount_received": 2.5}
    # Quartiles of the imputed column 1, 2, 2.5, 3, 10.
    assert fitted.scales == {"amount_received": 1.0}
    assert fitted.feature_names == [
        "amount_received", "account_share", "account_1_share", "payment_format_ACH", "payment_format_Cash", "payment_format_null", "day_Friday", "day_Monday",
    ]


def test_transform_train_and_unseen(spark, fitted, train):
    got = {r["row_key"]: list(r)[1:] for r in fitted.transform(train).collect()}
    assert got["1"] == [-1.5, 0.6, 0.6, 1.0, 0.0, 0.0, 0.0, 1.0]
    assert got["4"] == [7.5, 0.2, 0.4, 0.0, 0.0, 1.0, 0.0, 1.0]
    assert got["5"][0] == 0.0
    new = spark.createDataFrame([("9", float("nan"), "Z", None, "Wire", None)], SCHEMA)
    assert list(fitted.transform(new).first())[1:] == [0.0] * 8


def test_zero_range_scales_by_one(spark):
    rows = [(str(i), 4.0, "A", "B", "ACH", "Monday") for i in range(4)]
    fitted = FeatureEncoder().fit(spark.createDataFrame(rows, SCHEMA))
    assert fitted.scales == {"amount_received": 1.0}


def test_large_lookup_gives_the_same_shares(spark, monkeypatch):
    """Hot values by broadcast, the rest by a salted shuffle join; one account has a third of the rows."""
    rows = [(str(i), float(i), None if i % 50 == 0 else ("hot" if i % 3 == 0 else f"a{i % 700}"), f"b{i % 11}", "ACH", "Monday") for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    fitted = FeatureEncoder().fit(df)
    more = df.unionByName(spark.createDataFrame([("x", 1.0, "new", None, "ACH", "Monday")], SCHEMA))
    small = sorted(fitted.transform(more).collect())
    import transferlens.functions.joins as joins

    monkeypatch.setattr(features_module, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(joins, "HOT_SHARE", 0.01)
    assert sorted(fitted.transform(more).collect()) == small
    assert len(small) == 3001


def test_save_and_load(spark, fitted, train, tmp_path):
    fitted.save(str(tmp_path / "encoder"))
    again = FittedEncoder.load(spark, str(tmp_path / "encoder"))
    assert sorted(again.transform(train).collect()) == sorted(fitted.transform(train).collect())
    assert again.feature_names == fitted.feature_names


def test_vector_equals_columns(fitted, train):
    wide = {r["row_key"]: list(r)[1:] for r in fitted.transform(train).collect()}
    for r in fitted.transform_to_vector(train, ["row_key"]).collect():
        assert list(r["features"].toArray()) == wide[r["row_key"]]


def test_five_thousand_categories(spark):
    """Vectors come from places of sorted values; values not seen, and null where none was seen, give no flag."""
    rows = [(str(i), float(i % 7), "A", "B", f"f{i:04d}", "Monday") for i in range(5000)]
    fitted = FeatureEncoder().fit(spark.createDataFrame(rows, SCHEMA))
    more = spark.createDataFrame([*rows[::500], ("x", 1.0, "A", "B", "other", "Monday"), ("y", 1.0, "A", "B", None, "Monday")], SCHEMA)
    got = {r["row_key"]: r["features"] for r in fitted.transform_to_vector(more, ["row_key"]).collect()}
    assert fitted._values is None  # no list of values was needed
    assert {v.size for v in got.values()} == {3 + 5000 + 1}
    for i in range(0, 5000, 500):
        assert list(got[str(i)].indices[got[str(i)].indices >= 3]) == [3 + i, 5003]
    assert list(got["x"].indices[got["x"].indices >= 3]) == list(got["y"].indices[got["y"].indices >= 3]) == [5003]
    assert len(fitted.feature_names) == 5004 and fitted.feature_names[3] == "payment_format_f0000"


def test_hot_key_that_training_never_saw(spark, monkeypatch):
    """A third of the scored rows share an unknown account; the shuffled join spreads them."""
    import transferlens.functions.joins as joins

    monkeypatch.setattr(features_module, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(joins, "HOT_SHARE", 0.5)
    known = spark.createDataFrame([(str(i), 1.0, f"a{i % 900}", "B", "ACH", "Monday") for i in range(1800)], SCHEMA)
    fitted = FeatureEncoder().fit(known)
    scored = spark.createDataFrame([(str(i), 1.0, "stranger" if i % 3 == 0 else f"a{i % 900}", "B", "ACH", "Monday") for i in range(3000)], SCHEMA)
    lookup = fitted.lookup.where(F.col("column") == "account").select(F.col("value").alias("account"))
    assert joins._frequent_unknown(scored, lookup, "account") == ["stranger"]
    shares = {r["row_key"]: r["account_share"] for r in fitted.transform(scored).collect()}
    assert len(shares) == 3000
    assert all(shares[str(i)] == (0.0 if i % 3 == 0 else 2 / 1800) for i in range(3000))


def _brute(x, k):
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    return [sorted(range(len(x)), key=lambda j: (d[i, j], j))[:k] for i in range(len(x))]


@pytest.mark.parametrize("block_rows", [5000, 60])
def test_nearest_points_are_exact(spark, block_rows):
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.standard_t(1.5, 500), rng.random(500) * 0.01, np.eye(3)[rng.integers(0, 3, 500)]])
    points = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "point long, x array<double>")
    got = {r["point"]: list(r["near"]) for r in nearest_points(points, 500, 6, block_rows).collect()}
    assert [got[i] for i in range(500)] == _brute(x, 6)


@pytest.mark.parametrize("broadcast_rows", [1000, 3])
def test_neighbours_with_many_copies(spark, broadcast_rows):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(150, 2)), 1)
    x[::3] = [0.5, 0.5]
    rows = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "index long, x array<double>")
    got = {r["index"]: [n["index"] for n in r["neighbours"]] for r in with_neighbours(rows, 150, 5, 40, broadcast_rows).collect()}
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    for i in range(150):
        others = [j for j in range(150) if j != i]
        assert got[i] == sorted(others, key=lambda j: (d[i, j], j))[:5]


def _labelled(spark, ones, zeros):
    rng = np.random.default_rng(5)
    rows = [(f"{i:032x}", list(map(float, rng.normal(size=3))), 1.0 if i < ones else 0.0) for i in range(ones + zeros)]
    df = spark.createDataFrame(rows, "row_key string, x array<double>, label double")
    from pyspark.ml.functions import array_to_vector

    return df.select("row_key", array_to_vector("x").alias("features"), "label")


def test_oversample_lies_between_neighbours(spark):
    df = _labelled(spark, 30, 200)
    out = oversample(df)
    assert {r["label"]: r["count"] for r in out.groupBy("label").count().collect()} == {0.0: 200, 1.0: 200}
    assert out.select("row_key").distinct().count() == 400
    made = np.array([r[0] for r in out.where(F.col("row_key").startswith("s")).select(vector_to_array("features")).collect()])
    base = np.array([r[0] for r in df.where("label = 1").select(vector_to_array("features")).collect()])
    near = _brute(base, 6)
    segments = [(base[i], base[j]) for i in range(30) for j in near[i] if j != i]
    for p in made:
        gaps = [np.linalg.norm(p - a) + np.linalg.norm(p - b) - np.linalg.norm(a - b) for a, b in segments]
        assert min(gaps) < 1e-9
    assert sorted(map(str, out.collect())) == sorted(map(str, oversample(df).collect()))


def test_oversample_needs_six_rows(spark):
    with pytest.raises(ValueError, match="more than 5"):
        oversample(_labelled(spark, 5, 20))
    assert oversample(_labelled(spark, 6, 20)).count() == 40
    with pytest.raises(ValueError, match="two classes"):
        oversample(_labelled(spark, 0, 20))
