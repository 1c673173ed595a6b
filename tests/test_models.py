import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from transferlens.operators.balancing import oversample
from transferlens.operators.boosting import BoostSetting, StumpBooster, boost
from transferlens.operators.metrics import confusion_counts, curve_areas
from transferlens.operators.models import (
    ModelSpec,
    boosted_trees,
    boosted_trees_spec,
    forest_spec,
    logistic,
    logistic_spec,
    random_forest,
    stump_boost_spec,
)
from transferlens.operators.sampling import with_folds
from transferlens.operators.splits import pack, summed
from transferlens.operators.scoring import Scorer, as_requests, load_model, requests_table
from transferlens.operators.tuning import best_model, cross_validate, curve_summary, evaluate_models, grid_search, learning_curve, with_score
from transferlens.plans.training import train
from transferlens.sources.runlog import RunLog
from transferlens.sources.transfers import transfers


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(400, 3)), 1)
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + 0.3 * rng.normal(size=400) > 0.6).astype(float)
    rows = [(f"{i:032x}", list(map(float, r)), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "row_key string, x array<double>, label double").select("row_key", array_to_vector("x").alias("features"), "label")
    return with_folds(df, 3, "label", seed=1).cache()


def _arrays(df):
    rows = df.select(vector_to_array("features").alias("x"), "label", "fold").collect()
    return np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows]), np.array([r["fold"] for r in rows])


def _plain_boost(x, y, rounds, rate):
    """Stump boosting as the textbook says, one weight per row, all distinct values as splits."""
    w = np.full(len(y), 1 / len(y))
    out = []
    for _ in range(rounds):
        best = None
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for low, high in zip(values[:-1], values[1:]):
                left = x[:, f] <= low
                impurity = 0.0
                for side in (left, ~left):
                    a, b = w[side & (y == 0)].sum(), w[side & (y == 1)].sum()
                    impurity += 2 * a * b / (a + b) if a + b else 0
                if best is None or impurity < best[0] - 1e-10:
                    classes = [float(w[s & (y == 1)].sum() > w[s & (y == 0)].sum()) for s in (left, ~left)]
                    best = (impurity, f, low + (high - low) / 2, *classes)
        _, f, t, a, b = best
        miss = np.where(x[:, f] <= t, a, b) != y
        error = w[miss].sum() / w.sum()
        alpha = rate * math.log((1 - error) / error)
        out.append((f, t, int(a), int(b), alpha))
        w = w * np.exp(alpha * miss)
        w /= w.sum()
    return out


@pytest.mark.parametrize("bins", [256, 6])
def test_boosting_equals_plain_form(labelled, bins):
    x, y, fold = _arrays(labelled)
    settings = [BoostSetting(18, 1.0), BoostSetting(8, 0.5), BoostSetting(10, 1.0, held_out=1)]
    got = boost(labelled, settings, "features", "label", "fold", bins)
    expected = [_plain_boost(x, y, 18, 1.0), _plain_boost(x, y, 8, 0.5), _plain_boost(x[fold != 1], y[fold != 1], 10, 1.0)]
    for ours, theirs in zip(got, expected):
        assert [(s[0], *s[2:4]) for s in ours] == [(s[0], *s[2:4]) for s in theirs]
        assert np.allclose([(s[1], s[4]) for s in ours], [(s[1], s[4]) for s in theirs])


def test_booster_predicts_saves_and_shortens(labelled, tmp_path):
    model = StumpBooster(rounds=15, learningRate=0.5).fit(labelled)
    x, y, _ = _arrays(labelled)
    rows = model.transform(labelled).select(vector_to_array("probability")[1].alias("p"), "prediction").collect()
    stumps = model.stump_list()
    vote = sum(a * (2 * np.where(x[:, f] <= t, left, right) - 1) for f, t, left, right, a in stumps) / sum(s[4] for s in stumps)
    assert np.allclose([r["p"] for r in rows], 1 / (1 + np.exp(-2 * vote)))
    assert np.array_equal([r["prediction"] for r in rows], (vote > 0).astype(float))
    model.write().overwrite().save(str(tmp_path / "m"))
    assert load_model(str(tmp_path / "m")).stump_list() == stumps
    assert model.first(4).stump_list() == stumps[:4] == StumpBooster(rounds=4, learningRate=0.5).fit(labelled).stump_list()


def test_perfect_stump_ends_boosting(spark):
    rows = [(f"{i}", [float(i)], float(i >= 20)) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, x array<double>, label double").select(array_to_vector("x").alias("features"), "label")
    model = StumpBooster(rounds=10).fit(df)
    assert len(model.stump_list()) == 1
    assert model.transform(df).where("prediction <> label").count() == 0


def test_first_trees_is_a_prefix(labelled):
    model = boosted_trees(8, 0.3, 3).fit(labelled)
    short = model.first(3)
    direct = boosted_trees(3, 0.3, 3).fit(labelled)
    a = [r[0] for r in short.transform(labelled).select(vector_to_array("probability")[1]).collect()]
    b = [r[0] for r in direct.transform(labelled).select(vector_to_array("probability")[1]).collect()]
    assert np.allclose(a, b)


@pytest.mark.parametrize(
    "make", [lambda: random_forest(10, 5), lambda: boosted_trees(5, 0.3, 3), lambda: StumpBooster(rounds=10), lambda: logistic(1.0)]
)
def test_models_learn(labelled, make):
    scored = with_score(make().fit(labelled).transform(labelled))
    assert curve_areas(scored, label="label").first()["roc_auc"] > 0.75


def test_grid_search_orders_and_breaks_ties(labelled):
    result = grid_search(labelled, stump_boost_spec([2, 6], [0.5, 1.0]))
    rows = result.table.collect()
    assert len(rows) == 4 and result.scores.count() == 12
    keys = [(-round(r["recall"], 12), r["grid_no"]) for r in rows]
    assert keys == sorted(keys)
    assert result.best_params == stump_boost_spec([2, 6], [0.5, 1.0]).grid[rows[0]["grid_no"]]
    assert all(math.isclose(r["recall"], r["accuracy"]) for r in rows)


def test_grid_search_counts_every_held_out_row(labelled):
    scores = grid_search(labelled, forest_spec([3], [2, 4])).scores
    sizes = {r["fold"]: r["count"] for r in labelled.groupBy("fold").count().collect()}
    assert all(r["tn"] + r["fp"] + r["fn"] + r["tp"] == sizes[r["fold"]] for r in scores.collect())


def test_oversampling_inside_folds(labelled):
    table = grid_search(labelled, logistic_spec([1.0]), resample=oversample).table
    assert 0.5 < table.first()["recall"] <= 1


def test_boosted_trees_grid_axes(labelled):
    spec = boosted_trees_spec([1, 2], [0.3], [2], subsample=[0.7, 1.0], min_split=[10])
    assert len(spec.grid) == 4 and {p["subsample"] for p in spec.grid} == {0.7, 1.0}
    setting = spec.make(spec.grid[0]).setting()
    assert setting.subsample == spec.grid[0]["subsample"] and setting.min_split == 10
    assert grid_search(labelled, spec).table.count() == 4


def test_cross_validate_and_learning_curve(labelled):
    assert cross_validate(labelled, forest_spec(), {"trees": 3, "depth": 3, "min_split": 2}).count() == 1
    spec = boosted_trees_spec([2], [0.3], [2])
    curve = learning_curve(labelled, spec, spec.grid[0], [0.5, 1.0], seed=3)
    assert curve.count() == 2 * 3 * 2
    summary = curve_summary(curve)
    assert summary.count() == 4 and summary.where("recall_mean is null or recall_std < 0").count() == 0


def test_evaluate_models(labelled):
    specs = [forest_spec([3], [3]), stump_boost_spec([3], [1.0])]
    report, models = evaluate_models(labelled, labelled.drop("fold"), specs)
    assert report.count() == 4 and set(models) == {"random_forest", "adaboost"}
    test = {r["model"]: r["recall"] for r in report.where("split = 'test'").collect()}
    assert best_model(report)["model"] == max(test, key=test.get)


def test_training_run(spark, small_folder, tmp_path):
    rows = transfers(spark, small_folder)
    log = RunLog(spark, str(tmp_path / "log"))
    specs = [forest_spec([3], [3]), stump_boost_spec([3], [1.0])]
    result = train(rows, specs, folds=2, save_to=str(tmp_path / "scorer"), run_log=log)
    assert result.chosen in result.models and log.metrics().count() == 3 and log.runs().count() == 1
    requests = as_requests(rows, ["row_key"])
    Scorer.check(requests.drop("row_key"), str(tmp_path / "scorer"))
    loaded = Scorer.load(spark, str(tmp_path / "scorer")).score(requests, ["row_key"])
    direct = result.scorer.score(requests, ["row_key"])
    assert loaded.exceptAll(direct).count() == 0 and loaded.count() == 6000
    assert loaded.where(F.abs(F.col("p_fraud") + F.col("p_not_fraud") - 1) > 1e-9).count() == 0


def test_requests(spark):
    request = dict(
        from_bank=1, account="A", to_bank=2, account_1="B", amount_received="12.5", receiving_currency="Euro", payment_currency="Euro", payment_format="ACH", day="Monday"
    )
    row = requests_table(spark, [request, request]).first()
    assert row["amount_received"] == 12.5 and row["from_bank"] == "1"
    with pytest.raises(ValueError, match="day"):
        requests_table(spark, [{k: v for k, v in request.items() if k != "day"}])
    with pytest.raises(ValueError, match="day"):
        as_requests(requests_table(spark, [request]).drop("day"))


@pytest.mark.parametrize(
    "spec",
    [
        stump_boost_spec([2, 4], [0.5]), boosted_trees_spec([1, 2], [0.3], [2]), forest_spec([2], [3], [2, 20]), logistic_spec([10], ["lbfgs"]),
    ],
    ids=lambda s: s.name,
)
def test_joint_counts_equal_fitted_models(labelled, spec):
    """Counts of the joint search and curve are those of models fitted and applied one by one."""
    for r in grid_search(labelled, spec).scores.collect():
        p = spec.grid[r["grid_no"]]
        model = spec.make(p).fit(labelled.where(F.col("fold") != r["fold"]))
        counts = confusion_counts(model.transform(labelled.where(F.col("fold") == r["fold"])), "label").first()
        assert tuple(counts) == (r["tn"], r["fp"], r["fn"], r["tp"])
    alone = ModelSpec(spec.name, spec.make, spec.grid)
    both = [learning_curve(labelled, s, spec.grid[-1], [0.02, 0.7], seed=3).orderBy("step", "fold", "part").collect() for s in (spec, alone)]
    assert both[0] == both[1] and len(both[0]) == 12


def _newton(x, y, c, solver, steps=30):
    x = np.column_stack([x, np.ones(len(x))])
    ridge = np.append(np.ones(x.shape[1] - 1), float(solver == "liblinear"))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(c * (x.T * (p * (1 - p))) @ x + np.diag(ridge), c * x.T @ (p - y) + ridge * w)
    return w


def test_logistic_equals_newton_steps(labelled):
    x, y, _ = _arrays(labelled)
    for c in (0.1, 10.0):
        for solver in ("lbfgs", "liblinear"):
            model = logistic(c, solver).fit(labelled)
            assert np.allclose(model.weight_list(), _newton(x, y, c, solver), atol=1e-7)
            p = 1 / (1 + np.exp(-(x @ model.weight_list()[:-1] + model.weight_list()[-1])))
            rows = model.transform(labelled).select(vector_to_array("probability")[1]).collect()
            assert np.allclose([r[0] for r in rows], p)
    with pytest.raises(ValueError):
        logistic(1.0, "newton")


def test_logistic_steps_are_halved_when_they_overshoot(spark):
    """Separable data with a weak penalty: full steps would run away."""
    rows = [(f"{i}", [float(v)], float(v > 0)) for i, v in enumerate([-30, -20, -0.1, 0.1, 20, 40] * 3)]
    df = spark.createDataFrame(rows, "row_key string, x array<double>, label double").select("row_key", array_to_vector("x").alias("features"), "label")
    w = logistic(1e4).fit(df).weight_list()
    assert w[0] > 0 and all(map(math.isfinite, w))


def test_many_partial_sums(spark):
    """More tasks than the driver adds up directly."""
    df = spark.range(300).select(F.col("id").cast("string").alias("row_key"), array_to_vector(F.array(F.col("id").cast("double"))).alias("features"), (F.col("id") % 2).alias("label"))
    data = pack(df, "features", "label")
    blocks = data.blocks.unionAll(data.blocks.limit(0))
    for _ in range(7):
        blocks = blocks.unionAll(blocks)
    data = replace(data, blocks=blocks, tasks=blocks.rdd.getNumPartitions())

    def add(block, total):
        total += [block.n, block.x.sum()]

    assert data.tasks > 64 and list(summed(data, 2, add)) == [128 * 300, 128 * sum(range(300))]
