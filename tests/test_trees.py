"""Tree growers against plain searches over sorted values."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from transferlens.operators import splits, trees
from transferlens.operators.scoring import load_model
from transferlens.operators.splits import Gini, Newton, pack, search
from transferlens.operators.trees import (
    BoostedSetting,
    BoostedTrees,
    Forest,
    ForestSetting,
    Rows,
    bootstrap_counts,
    grow_boosted,
    grow_forests,
    stage_counts,
)


def table(spark, n=600, seed=5, decimals=2):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)), decimals)
    x[:, 2] = rng.integers(0, 2, n)
    x[:, 3] = np.where(rng.random(n) < 0.7, 0.0, np.round(rng.random(n), 3))
    y = (x[:, 0] + 0.7 * x[:, 1] ** 2 + 0.5 * x[:, 2] + 0.4 * rng.normal(size=n) > 0.8).astype(int)
    fold = np.arange(n) % 3
    rows = [(f"{i:08x}", r.tolist(), int(v), int(f)) for i, (r, v, f) in enumerate(zip(x, y, fold))]
    df = spark.createDataFrame(rows, "row_key string, x array<double>, label int, fold int").repartition(3, "row_key")
    return df.select("row_key", array_to_vector("x").alias("features"), "label", "fold"), x, y, fold


def plain_split(x, terms, rule):
    """(feature, threshold, score) by scoring every pair of neighbouring values."""
    best = None
    whole = terms.sum(axis=1)
    for f in range(x.shape[1]):
        for low, high in zip((v := np.unique(x[:, f]))[:-1], v[1:]):
            left = terms[:, x[:, f] <= low].sum(axis=1)
            score = float(rule.score(left[:, None], (whole - left)[:, None])[0])
            if score > -math.inf and (best is None or score > best[2]):
                best = (f, (low + high) / 2, score)
    return best


def grow_plain(x, y, setting, terms_of, rule, leaf, stop, depth=0, rows=None):
    """Nested tuples (feature, threshold, left, right) and leaf values."""
    rows = np.arange(len(y)) if rows is None else rows
    terms = terms_of(rows)
    whole = terms.sum(axis=1)
    if stop(whole, depth) or (split := plain_split(x[rows], terms, rule)) is None or (isinstance(rule, Newton) and split[2] <= 1e-6):
        return leaf(whole)
    f, t, _ = split
    go = x[rows, f] <= t
    return f, t, *(grow_plain(x, y, setting, terms_of, rule, leaf, stop, depth + 1, rows[side]) for side in (go, ~go))


def nested(tree, node=0):
    if tree.feature[node] < 0:
        return tree.value[node]
    return int(tree.feature[node]), float(tree.threshold[node]), nested(tree, tree.left[node]), nested(tree, tree.right[node])


def same(a, b):
    if isinstance(a, tuple) != isinstance(b, tuple):
        return False
    if not isinstance(a, tuple):
        return math.isclose(a, b, abs_tol=1e-9)
    return a[0] == b[0] and math.isclose(a[1], b[1], abs_tol=1e-12) and same(a[2], b[2]) and same(a[3], b[3])


def values_of(tree, x):
    out = np.zeros(len(x))
    for i, r in enumerate(x):
        t = tree
        while isinstance(t, tuple):
            t = t[2] if r[t[0]] <= t[1] else t[3]
        out[i] = t
    return out


def boost_plain(x, y, setting, on, counts=None):
    margin, out = np.zeros(len(y)), []
    for _ in range(setting.rounds):
        p = 1 / (1 + np.exp(-margin))
        terms = np.stack([np.where(y == 0, p, 0), np.where(y == 1, 1 - p, 0), p * (1 - p), np.ones(len(y))])
        rule = Newton(setting.penalty, setting.min_hessian, setting.min_leaf)
        tree = grow_plain(
            x[on], y[on], setting, lambda rows: terms[:, on][:, rows], rule, lambda w: -(w[0] - w[1]) / (w[2] + setting.penalty) * setting.rate,
            lambda w, d: d >= setting.depth or w[3] < setting.min_split,
        )
        out.append(tree)
        margin = margin + values_of(tree, x)
    return out


@pytest.mark.parametrize("bins,listed", [(256, 8192), (8, 8192), (4, 10)])
def test_exact_search_equals_plain_search(spark, monkeypatch, bins, listed):
    """Few coarse bins and short lists make the search go through all its steps."""
    monkeypatch.setattr(splits, "LISTED_ROWS", listed)
    df, x, y, fold = table(spark)
    data = pack(df, "features", "label", "fold", "row_key", bins=bins)

    def weigh(block):
        w = 1.0 + (block.x[0] > 0) + 2 * (block.x[3] == 0)
        node = np.where(block.fold == 2, -1, block.fold)
        yield 0, 2, node, np.stack([np.where(block.y == 0, w, 0), np.where(block.y == 1, w, 0), np.ones(block.n)])

    w = 1.0 + (x[:, 0] > 0) + 2 * (x[:, 3] == 0)
    terms = np.stack([np.where(y == 0, w, 0), np.where(y == 1, w, 0), np.ones(len(y))])
    for rule in (Gini(), Gini(40)):
        found = search(data, weigh, 2, rule)
        for k in (0, 1):
            f, t, score = plain_split(x[fold == k], terms[:, fold == k], rule)
            assert (found[k].feature, found[k].score) == (f, score) and math.isclose(found[k].threshold, t)
    only = search(data, weigh, 2, Gini(), np.array([[False, False, True, False], [False, False, False, True]]))
    assert [s.feature for s in only] == [2, 3] and only[0].threshold == 0.5


def test_boosted_trees_equal_plain_form(spark):
    df, x, y, fold = table(spark, 300)
    settings = [
        BoostedSetting(3, 0.3, 2), BoostedSetting(2, 0.5, 3, penalty=0.5, min_hessian=2.0, rows=Rows(held_out=1)), BoostedSetting(2, 0.1, 3, min_split=60, min_leaf=25),
    ]
    got = grow_boosted(pack(df, "features", "label", "fold", "row_key", bins=16), settings, exact=True)
    for trees, setting in zip(got, settings):
        on = fold != setting.rows.held_out if setting.rows.held_out is not None else np.ones(len(y), bool)
        expected = boost_plain(x, y, setting, on)
        assert len(trees) == len(expected) and all(same(nested(t), e) for t, e in zip(trees, expected))


def test_binned_trees_equal_exact_ones_with_few_values(spark):
    """With every value a bin border, splits part the rows alike; only thresholds lie at the border itself."""
    df, x, _, _ = table(spark, 300, decimals=1)
    data = pack(df, "features", "label", "fold", "row_key")
    settings = [BoostedSetting(11, 0.3, 3)]
    binned, exact = grow_boosted(data, settings)[0], grow_boosted(pack(df, "features", "label", "fold", "row_key"), settings, exact=True)[0]
    assert len(binned) == 11
    if all(len(np.unique(x[:, f])) <= 255 for f in range(4)):
        for a, b in zip(binned, exact):
            assert np.allclose(a.values(x.T), b.values(x.T))


def test_minimum_gain_takes_splits_back(spark):
    df, *_ = table(spark, 300)
    sizes = []
    for gain in (0.0, 3.0, 1e9):
        model = BoostedTrees(rounds=1, depth=4, minGain=gain).fit(df)
        sizes.append(len([f for f in model.tree_list()[0].feature if f >= 0]) if gain < 1e9 else int(model.tree_list()[0].feature[0]))
    assert sizes[0] > sizes[1] > 0 and sizes[2] == -1


def test_forest_tree_equals_plain_tree(spark):
    df, x, y, fold = table(spark, 400)
    settings = [
        ForestSetting(1, None, 2, features=4, bootstrap=False), ForestSetting(1, 4, 30, features=4, bootstrap=False, rows=Rows(held_out=0)),
        ForestSetting(1, None, 2, min_leaf=7, features=4, bootstrap=False),
    ]
    terms = np.stack([(y == 0) * 1.0, (y == 1) * 1.0, np.ones(len(y))])
    for task_rows in (1 << 16, 40, 1):
        got = grow_forests(pack(df, "features", "label", "fold", "row_key", bins=16), settings, task_rows)
        for trees, s in zip(got, settings):
            on = np.flatnonzero(fold != s.rows.held_out) if s.rows.held_out is not None else np.arange(len(y))

            def stop(w, d, s=s):
                return min(w[0], w[1]) == 0 or w[2] < max(s.min_split, 2 * s.min_leaf) or (s.depth is not None and d >= s.depth)

            expected = grow_plain(x[on], y[on], s, lambda rows, on=on: terms[:, on][:, rows], Gini(s.min_leaf), lambda w: w[1] / (w[0] + w[1]), stop)
            assert same(nested(trees[0]), expected), task_rows


def test_forest_does_not_depend_on_where_nodes_are_finished(spark):
    df, x, *_ = table(spark, 400)
    a, b = (
        grow_forests(pack(df, "features", "label", "fold", "row_key"), [ForestSetting(4, None), ForestSetting(2, 5, seed=7)], rows) for rows in (1 << 16, 60)
    )
    for one, two in zip(a, b):
        assert all(same(nested(s), nested(t)) for s, t in zip(one, two))
    assert not same(nested(a[0][0]), nested(a[0][1]))  # trees draw their own rows and features
    assert all(np.isin(t.values(x.T), (0.0, 1.0)).mean() > 0.9 for t in a[0])  # grown until nodes are pure


def test_bootstrap_counts_follow_the_poisson_law():
    counts = bootstrap_counts(np.random.default_rng(1).integers(0, 2**63, 200_000).astype(np.uint64), 3, 4)
    assert abs(counts.mean() - 1) < 0.01 and abs(counts.var() - 1) < 0.02 and abs((counts == 0).mean() - math.exp(-1)) < 0.01


def test_models_predict_save_and_shorten(spark, tmp_path):
    df, x, y, _ = table(spark, 300)
    for name, estimator in (("b", BoostedTrees(rounds=9, depth=3)), ("f", Forest(numTrees=6, depth=4))):
        model = estimator.fit(df)
        trees = model.tree_list()
        raw = sum(t.values(x.T) for t in trees)
        expected = 1 / (1 + np.exp(-raw)) if name == "b" else raw / len(trees)
        rows = model.transform(df).orderBy("row_key").select(vector_to_array("probability").alias("p"), "prediction").collect()
        assert np.allclose([r["p"][1] for r in rows], expected) and np.allclose([sum(r["p"]) for r in rows], 1)
        assert np.array_equal([r["prediction"] for r in rows], (expected > 0.5) * 1.0)
        assert np.mean([r["prediction"] for r in rows] == y) > 0.8
        model.write().overwrite().save(str(tmp_path / name))
        again = load_model(str(tmp_path / name))
        assert all(same(nested(a), nested(b)) for a, b in zip(again.tree_list(), trees))
        shorter = estimator.copy({estimator.rounds if name == "b" else estimator.numTrees: 4}).fit(df).tree_list()
        assert len(model.first(4).tree_list()) == 4 and all(same(nested(a), nested(b)) for a, b in zip(model.first(4).tree_list(), shorter))
        assert model.transform(df.limit(0)).count() == 0


def test_stage_counts_equal_predictions(spark):
    df, x, y, fold = table(spark, 300)
    settings = [BoostedSetting(4, 0.3, 2, rows=Rows(held_out=f)) for f in (0, 2)]
    trees = grow_boosted(pack(df, "features", "label", "fold", "row_key"), settings)
    data = pack(df, "features", "label", "fold", "row_key")
    counts = stage_counts(data, [(t, [1, 4], s.rows, held) for t, s in zip(trees, settings) for held in (True, False)], mean=False)
    k = 0
    for t, s in zip(trees, settings):
        for held in (True, False):
            on = (fold == s.rows.held_out) == held
            for n, got in zip((1, 4), counts[k]):
                says = sum(tree.values(x.T) for tree in t[:n]) > 0
                expected = [int(((y == a) & (says == b) & on).sum()) for a in (0, 1) for b in (0, 1)]
                assert list(got) == expected
            k += 1


def test_subsample_and_constant_features(spark):
    df, *_ = table(spark, 300)
    a, b = (BoostedTrees(rounds=2, depth=2, subsample=0.5, seed=s).fit(df).tree_list() for s in (1, 2))
    assert not same(nested(a[0]), nested(b[0]))
    flat = df.select("row_key", array_to_vector(F.array(F.lit(1.0), F.lit(2.0))).alias("features"), "label")
    for model in (BoostedTrees(rounds=2).fit(flat), Forest(numTrees=2).fit(flat)):
        assert all(len(t.value) == 1 for t in model.tree_list())
    with pytest.raises(ValueError):
        Forest(numTrees=1).fit(df.limit(0))


def test_boosted_trees_of_bin_borders_read_codes_only(spark):
    """The trees are those grown on values, margins written or not, and no pass reads the values."""
    features = array_to_vector(F.array(*[(F.xxhash64("id", F.lit(i)) % (10 ** (i + 1))).cast("double") for i in range(4)]))
    df = spark.range(0, 20_000, 1, 3).select(features.alias("features"), (F.xxhash64("id", F.lit(1)) % 100 + F.xxhash64("id", F.lit(9)) % 60 > 0).cast("int").alias("label"))
    data = splits.pack(df, "features", "label", bins=32)
    setting = trees.BoostedSetting(5, depth=3)
    grown = trees.grow_boosted(data, [setting])[0]
    x, y = (np.array(c) for c in zip(*[(r["features"].toArray(), r["label"]) for r in df.collect()]))
    margin = np.zeros(len(y))
    for tree in grown:
        assert set(tree.threshold[tree.feature >= 0]) <= set(np.concatenate(data.edges).tolist())
        p = 1 / (1 + np.exp(-margin))
        at = tree.leaves(x.T)
        for leaf in np.unique(at):
            on = at == leaf
            assert np.isclose(tree.value[leaf], -(p - y)[on].sum() / ((p * (1 - p))[on].sum() + 1) * setting.rate)
        coded = tree.coded(data.edges)
        codes = np.vstack([np.searchsorted(e, x[:, f]) for f, e in enumerate(data.edges)])
        assert (coded.leaves(codes) == at).all()
        margin += tree.value[at]
    plan = splits.without_values(data).blocks.mapInPandas(lambda batches: batches, splits._SHAPE)._jdf.queryExecution().executedPlan().toString()
    read = plan[plan.index("ReadSchema:") :].splitlines()[0]
    assert "codes:binary" in read and "x:binary" not in read
    splits.released(data)


def test_constant_features_of_large_nodes_are_not_searched(spark, monkeypatch):
    """A node whose first features have one value goes on to the next ones without a search for each, to the same tree."""
    features = array_to_vector(F.array(*[F.lit(float(i)) for i in range(6)], (F.col("id") % 50).cast("double")))
    df = spark.range(0, 2000, 1, 2).select(features.alias("features"), F.when(F.col("id") % 50 < 20, F.col("id") % 3 == 0).otherwise(F.col("id") % 7 > 0).cast("int").alias("label"))
    data, calls = pack(df, "features", "label"), []
    whole = trees.search

    def counted(*args, **more):
        calls.append(args[2])
        return whole(*args, **more)

    monkeypatch.setattr(trees, "search", counted)
    setting = ForestSetting(1, 2, features=1, bootstrap=False)
    large, small = grow_forests(data, [setting], 100)[0][0], grow_forests(data, [setting])[0][0]
    splits.released(data)
    assert len(calls) == 2  # one for each level
    shape = lambda t, i=0: None if t.feature[i] < 0 else (t.feature[i], t.threshold[i], shape(t, t.left[i]), shape(t, t.right[i]))
    assert shape(large) is not None and shape(large) == shape(small)
