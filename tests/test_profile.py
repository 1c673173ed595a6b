import math

import numpy as np
import pytest

from transferlens.functions.special import upper_gamma
from transferlens.operators import profiling, stats
from transferlens.operators.quantiles import long_values, quantile_table, quantiles


def test_quantiles_of_small_table(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "x double")
    assert quantiles(df, ["x"], [0.25, 0.5, 0.75])["all", "x"] == [1.75, 2.5, 4.75]


def test_quantiles_of_nothing_and_of_empty_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("b", float("nan")), (None, 5.0)], "g string, x double")
    got = quantiles(df, ["x"], [0.0, 0.5], by="g")
    assert got == {("all", "x"): [1.0, 3.0], ("a", "x"): [1.0, 1.0], ("b", "x"): [None, None]}
    assert quantiles(df.limit(0), ["x"], [0.5], by="g") == {("all", "x"): [None]}


def test_quantiles_of_many_groups(spark):
    """The plan does not grow with the groups; half of the rows are in one group, which needs narrowing."""
    rng = np.random.default_rng(5)
    values = rng.normal(0, 10, 12_000).round(2)
    groups = np.where(np.arange(12_000) % 2 == 0, 0, rng.integers(1, 1_500, 12_000))
    df = spark.createDataFrame([(int(g), float(v)) for g, v in zip(groups, values)], "g int, x double").repartition(4)
    found = quantile_table(long_values(df, ["x"], "g"), [0.25, 0.9], rows_per_task=200)
    got = {(r["group"], r["prob"]): r["value"] for r in found.collect()}
    want = {(str(g), p): np.quantile(values[groups == g], p) for g in set(groups.tolist()) for p in (0.25, 0.9)}
    want |= {("all", p): np.quantile(values, p) for p in (0.25, 0.9)}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k], rtol=1e-12, atol=1e-12) for k in want)


def _check_large_path(spark, values, limit):
    df = spark.createDataFrame([(i % 2, float(v)) for i, v in enumerate(values)], "g int, x double").repartition(6)
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = quantiles(df, ["x"], probs, by="g", rows_per_task=limit)
    for group, part in (("all", values), ("0", values[0::2]), ("1", values[1::2])):
        assert np.allclose(got[group, "x"], np.quantile(part, probs), rtol=1e-12, atol=0)


@pytest.mark.parametrize("kind", ["uniform", "heavy tail", "one value owns a third", "constant"])
def test_narrowed_quantiles_are_exact(spark, kind):
    rng = np.random.default_rng(7)
    n = 4000
    values = {
        "uniform": rng.random(n),
        "heavy tail": np.exp(rng.normal(0, 6, n)),
        "one value owns a third": np.where(rng.random(n) < 0.34, 5.0, rng.random(n) * 10),
        "constant": np.full(n, 3.25),
    }[kind]
    _check_large_path(spark, values, 5)


def test_duplicates_and_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 1.0), (None, float("nan"))], "s string, x double")
    assert profiling.duplicate_rows(df).first()[0] == 2
    assert profiling.duplicate_rows(df.limit(0)).first()[0] == 0
    assert {r["column"]: r["n_missing"] for r in profiling.missing_counts(df).collect()} == {"s": 1, "x": 1}
    assert {r["column"]: r["n_present"] for r in profiling.table_info(df).collect()} == {"s": 3, "x": 3}


def test_approximate_distinct_counts(transfer_rows):
    exact = {r["column"]: r["n_distinct"] for r in profiling.distinct_counts(transfer_rows, ["account", "day"]).collect()}
    close = {r["column"]: r["n_distinct"] for r in profiling.distinct_counts(transfer_rows, ["account", "day"], approximate=True).collect()}
    assert all(abs(close[c] - exact[c]) <= 0.05 * exact[c] + 1 for c in exact)


def test_constant_histogram(spark):
    df = spark.createDataFrame([(2.0, 0)] * 4, "x double, is_laundering int")
    rows = profiling.histogram(df, "x").collect()
    assert [(r["bin"], r["count"]) for r in rows] == [(0, 4)]


def test_box_outliers(spark):
    df = spark.createDataFrame([(float(x), 0) for x in (1, 2, 3, 4, 100)], "x double, is_laundering int")
    row = profiling.box_numbers(df, ["x"]).where("group = 'all'").first()
    assert (row["whisker_low"], row["whisker_high"], row["n_outliers"]) == (1.0, 4.0, 1)


def test_binned_density_is_close_to_exact(transfer_rows):
    exact = {r["point"]: r["density"] for r in profiling.density(transfer_rows, "amount_paid").collect()}
    binned = {r["point"]: r["density"] for r in profiling.density(transfer_rows, "amount_paid", bins_per_bandwidth=50).collect()}
    top = max(exact.values())
    assert len(exact) == len(binned) == 200
    assert max(abs(exact[p] - binned[p]) for p in exact) < 1e-4 * top


def test_upper_gamma_closed_forms():
    for x in (0.01, 0.5, 2.0, 17.0, 300.0):
        assert math.isclose(upper_gamma(0.5, x), math.erfc(math.sqrt(x)), rel_tol=1e-10, abs_tol=1e-300)
        assert math.isclose(upper_gamma(3, x), math.exp(-x) * (1 + x + x * x / 2), rel_tol=1e-10)
    assert upper_gamma(2, 0) == 1.0
    for a in (100_001.0, 1e12):  # Q(a, a) is a half less a third of a density
        assert math.isclose(upper_gamma(a, a), 0.5 - 1 / (3 * math.sqrt(2 * math.pi * a)), rel_tol=1e-9)
    assert upper_gamma(1e6, 1.0) == 1.0 and upper_gamma(1e6, 1e9) == 0.0
    # a sum of many squares: Wilson and Hilferty's normal form
    z = ((1.003) ** (1 / 3) - 1 + 1 / (9 * 1e6)) * math.sqrt(9 * 1e6)
    assert math.isclose(upper_gamma(1e6, 1.003e6), 0.5 * math.erfc(z / math.sqrt(2)), rel_tol=1e-4)
    assert math.isclose(upper_gamma(749.5, 720.126), 0.8560, abs_tol=5e-3)


def test_two_by_two_has_continuity_correction(spark):
    cells = {("a", 1): 12, ("a", 0): 5, ("b", 1): 3, ("b", 0): 9}
    df = spark.createDataFrame([(v, y) for (v, y), n in cells.items() for _ in range(n)], "c string, is_laundering int")
    row = stats.chi_squared(df, ["c"]).first()
    n, det = 29, 12 * 9 - 5 * 3
    assert math.isclose(row["chi2"], n * (abs(det) - n / 2) ** 2 / (17 * 12 * 15 * 14), rel_tol=1e-12)
    assert row["dof"] == 1


def test_independence_degenerate(spark):
    df = spark.createDataFrame([("a", 0), ("b", 0)], "c string, is_laundering int")
    row = stats.independence_test(df, ["c"]).first()
    assert (row["chi2"], row["dof"], row["p_value"], row["verdict"]) == (0.0, 0, 1.0, "fail_to_reject")


def test_vif_of_three_columns(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(2, 500))
    c = a + 0.1 * rng.normal(size=500)
    df = spark.createDataFrame([tuple(map(float, r)) for r in np.column_stack([a, b, c])], "a double, b double, c double")
    got = {r["feature"]: r["vif"] for r in stats.variance_inflation(df, ["a", "b", "c"]).collect()}
    x = np.column_stack([np.ones(500), a, b, c])
    for j, name in enumerate(["const", "a", "b", "c"]):
        others = np.delete(x, j, axis=1)
        rest = x[:, j] - others @ np.linalg.lstsq(others, x[:, j], rcond=None)[0]
        total = (x[:, j] ** 2).sum() if j == 0 else ((x[:, j] - x[:, j].mean()) ** 2).sum()
        assert math.isclose(got[name], total / (rest**2).sum(), rel_tol=1e-6)
    bands = {r["feature"]: r["collinearity"] for r in stats.with_vif_band(stats.variance_inflation(df, ["a", "b", "c"])).collect()}
    assert bands["a"] == "high" and bands["b"] == "moderate"
