import hashlib
import math

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from transferlens.operators.ranking import cut_points, running_totals, with_dense_index
from transferlens.operators.sampling import (
    exact_sample,
    fold_sizes,
    training_subset,
    training_subset_cuts,
    train_test_split,
    with_folds,
    with_split,
)


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def keyed(spark):
    rows = [(md5(str(i)), 1 if i % 37 == 0 else 0, float(i)) for i in range(3000)]
    return spark.createDataFrame(rows, "row_key string, is_laundering int, v double").repartition(5).cache()


@pytest.mark.parametrize("direct_rows", [1_000_000, 50, 1])
def test_sample_equals_sorted_prefix(keyed, direct_rows):
    got = {r["row_key"] for r in exact_sample(keyed, 777, 6, direct_rows=direct_rows).collect()}
    keys = [r["row_key"] for r in keyed.collect()]
    assert got == set(sorted(keys, key=lambda k: md5(k + "|6"))[:777])


def test_sample_sizes(keyed):
    assert exact_sample(keyed, 3000, 1).count() == 3000
    assert exact_sample(keyed, 0, 1).count() == 0
    with pytest.raises(ValueError):
        exact_sample(keyed, 3001, 1)


def test_many_copies_of_one_key(spark):
    """A third of the rows share their key; the sample is still exact."""
    rows = [("same" if i % 3 == 0 else f"k{i}", i) for i in range(900)]
    df = spark.createDataFrame(rows, "row_key string, v int")
    sizes = []
    for n in (1, 100, 450, 899):
        out = exact_sample(df, n, 3, direct_rows=20)
        assert out.columns == df.columns
        sizes.append(out.count())
        assert out.select("v").distinct().count() == n
    assert sizes == [1, 100, 450, 899]


def test_split_is_exact_and_complete(keyed):
    train, test = train_test_split(keyed)
    assert test.count() == math.ceil(3000 * 0.2)
    assert train.select("row_key").intersect(test.select("row_key")).count() == 0
    assert train.count() + test.count() == 3000


def test_stratified_split(keyed):
    marked = with_split(keyed, 0.25, stratify="is_laundering")
    got = {(r["is_laundering"], r["split"]): r["count"] for r in marked.groupBy("is_laundering", "split").count().collect()}
    ones = sum(1 for i in range(3000) if i % 37 == 0)
    assert got[1, "test"] + got[0, "test"] == 750
    assert abs(got[1, "test"] - ones / 4) <= 1


@given(st.lists(st.integers(1, 50), min_size=1, max_size=4), st.integers(2, 9))
def test_fold_sizes_deal_rows_in_turn(counts, k):
    sizes = fold_sizes(dict(enumerate(counts)), k)
    labels = [c for c, n in enumerate(counts) for _ in range(n)]
    for c, per_fold in sizes.items():
        assert per_fold == [sum(1 for p, y in enumerate(labels) if y == c and p % k == i) for i in range(k)]


@pytest.mark.parametrize("seed", [None, 42])
@pytest.mark.parametrize("k", [2, 3, 5])
def test_folds(keyed, k, seed):
    counts = with_folds(keyed, k, seed=seed, direct_rows=100).groupBy("is_laundering", "fold").count().collect()
    for label in (0, 1):
        sizes = [r["count"] for r in counts if r["is_laundering"] == label]
        assert len(sizes) == k and max(sizes) - min(sizes) <= 1


def test_training_subsets_are_nested(keyed):
    folded = with_folds(keyed, 3, seed=1).cache()
    ordered, cuts = training_subset_cuts(folded, [0.1, 0.5, 1.0], seed=1)
    for fold in range(3):
        previous = set()
        for i, share in enumerate((0.1, 0.5, 1.0)):
            rows = training_subset(ordered, cuts, fold, i).collect()
            keys = {r["row_key"] for r in rows}
            assert all(r["fold"] != fold for r in rows)
            assert len(keys) == int(share * 2000) and previous <= keys
            previous = keys


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab", min_size=0, max_size=3), min_size=5, max_size=40), st.data())
def test_cut_points_on_any_text(spark, keys, data):
    rank = data.draw(st.integers(1, len(keys)))
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    out, cuts = cut_points(df, "k", {None: [rank]}, direct_rows=1)
    chosen = [r["k"].split("\0")[0] for r in out.where(F.col("k") <= cuts[None][rank]).collect()]
    assert sorted(chosen) == sorted(keys)[:rank]


@pytest.mark.parametrize("rows", [10, 10**8])
def test_dense_index(keyed, rows):
    got = {r["row_key"]: r["index"] for r in with_dense_index(keyed, "row_key", rows).collect()}
    ordered = sorted(got, key=lambda k: (md5(k), k))
    assert [got[k] for k in ordered] == list(range(3000))


@pytest.mark.parametrize("rows_per_bucket", [10_000, 100, 7])
def test_running_totals(keyed, rows_per_bucket):
    out = running_totals(keyed.select("v", F.lit(1).alias("n")), "v", ["v", "n"], rows_per_bucket)
    got = {r["v"]: (r["upto_v"], r["upto_n"]) for r in out.collect()}
    total = 0.0
    for i, v in enumerate(sorted(got, reverse=True)):
        total += v
        assert got[v] == (total, i + 1)
