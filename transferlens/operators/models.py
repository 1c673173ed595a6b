"""The classifiers and their parameter grids."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial
from itertools import product

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame

from transferlens.operators.boosting import BoostSetting, StumpBooster, boost_packed, vote_counts
from transferlens.operators.logistic import RidgeLogistic, decision_counts, fit_logistic
from transferlens.operators.splits import Packed, Rows, pack, released
from transferlens.operators.trees import BoostedTrees, Forest, grow_boosted, grow_forests, stage_counts
from transferlens.schema import KEY

#: (parameters, training rows, stages, which parts to count: True for the held-out fold, False for the training rows)
Job = tuple[dict, Rows, list[int], list[bool]]


@dataclass
class ModelSpec:
    """A named classifier, how to build it from parameters, and the grid to try.

    ``stage_param`` names a round count whose smaller values are prefixes of the larger ones:
    such models are fitted once at the largest value and read off at the others. ``count_jobs``
    fits many jobs (parameters, training rows, stages, parts) in the same passes; it gives the
    (tn, fp, fn, tp) of every job, part and stage.
    """

    name: str
    make: Callable[[dict], Estimator]
    grid: list[dict]
    stage_param: str | None = None
    stage: Callable[[Model, int], Model] | None = None
    count_jobs: Callable[..., list[list[list[tuple]]]] | None = None


def grid_of(**values: list) -> list[dict]:
    return [dict(zip(values, point)) for point in product(*values.values())]


def random_forest(trees: int = 100, depth: int | None = None, min_split: int = 2, seed: int = 42, **more) -> Forest:
    """``depth`` None grows until nodes are pure or have fewer than ``min_split`` rows."""
    return Forest(numTrees=trees, depth=depth or 0, minSplit=min_split, seed=seed, **more)


def boosted_trees(
    trees: int = 100, rate: float = 0.3, depth: int = 6, subsample: float = 1.0, min_split: int = 2, min_leaf: int = 1, seed: int = 42, **more
) -> BoostedTrees:
    return BoostedTrees(rounds=trees, rate=rate, depth=depth, subsample=subsample, minSplit=min_split, minLeaf=min_leaf, seed=seed, **more)


def logistic(c: float = 1.0, solver: str = "lbfgs", max_iter: int = 1000) -> RidgeLogistic:
    """Inverse strength ``c`` against the summed loss."""
    return RidgeLogistic(c=float(c), solver=solver, maxIter=max_iter)


# ---------------------------------------------------------------- many fits at once


def _boosted_counts(df: DataFrame, jobs: list[Job], make, **columns: str) -> list[list[tuple]]:
    """Fits that differ in whether thresholds are exact are grown apart, all others together."""
    data = _packed(df, columns)
    estimators = [make(p) for p, *_ in jobs]
    trees: list = [None] * len(jobs)
    for exact in (False, True):
        some = [i for i, e in enumerate(estimators) if e.getOrDefault(e.exact) == exact]
        if some:
            for i, t in zip(some, grow_boosted(data, [estimators[i].setting(jobs[i][1]) for i in some], exact)):
                trees[i] = t
    counts = stage_counts(data, [(t, stages, rows, held) for t, (_, rows, stages, parts) in zip(trees, jobs) for held in parts], mean=False)
    released(data)
    return _by_job(jobs, counts)


def _forest_counts(df: DataFrame, jobs: list[Job], make, **columns: str) -> list[list[tuple]]:
    data = _packed(df, columns)
    estimators = [make(p) for p, *_ in jobs]
    rows_in_task = {e.getOrDefault(e.taskRows) for e in estimators}
    trees = grow_forests(data, [e.setting(rows) for e, (_, rows, *_) in zip(estimators, jobs)], min(rows_in_task))
    counts = stage_counts(data, [(t, stages, rows, held) for t, (_, rows, stages, parts) in zip(trees, jobs) for held in parts], mean=True)
    released(data)
    return _by_job(jobs, counts)


def _stump_counts(df: DataFrame, jobs: list[Job], make, **columns: str) -> list[list[tuple]]:
    data = _packed(df, columns)
    settings = [BoostSetting(p["rounds"], p["rate"], rows.held_out, rows.step) for p, rows, *_ in jobs]
    counts = vote_counts(data, [(s, stages, rows, held) for s, (_, rows, stages, parts) in zip(boost_packed(data, settings), jobs) for held in parts])
    released(data)
    return _by_job(jobs, counts)


def _logistic_counts(df: DataFrame, jobs: list[Job], make, **columns: str) -> list[list[tuple]]:
    data = _packed(df, columns)
    found = fit_logistic(data, [make(p).setting(rows) for p, rows, *_ in jobs])
    counts = decision_counts(data, [(w, rows, held) for w, (_, rows, _, parts) in zip(found, jobs) for held in parts])
    released(data)
    return _by_job(jobs, [[c] for c in counts])


def _packed(df: DataFrame, columns: dict[str, str]) -> Packed:
    return pack(df, "features", "label", key=KEY if KEY in df.columns else None, **columns)


def _by_job(jobs: list[Job], counts: list[list[tuple]]) -> list[list[list[tuple]]]:
    """Counts per job, part and stage."""
    left = iter(counts)
    return [[next(left) for _ in parts] for *_, parts in jobs]


def forest_spec(trees: list[int] = (50, 100, 200), depth: list = (None,), min_split: list[int] = (2,), name: str = "random_forest", **more) -> ModelSpec:
    def make(p: dict) -> Forest:
        return random_forest(**{**more, **p})

    grid = grid_of(trees=list(trees), depth=list(depth), min_split=list(min_split))
    return ModelSpec(name, make, grid, "trees", lambda m, n: m.first(n), partial(_forest_counts, make=make))


def boosted_trees_spec(
    trees: list[int] = (50, 100, 200), rate: list[float] = (0.01, 0.1, 0.05, 0.001), depth: list[int] = (6,), subsample: list[float] = (1.0,),
    min_split: list[int] = (2,), min_leaf: list[int] = (1,), name: str = "boosted_trees", **more,
) -> ModelSpec:
    """Every list is an axis of the grid; an axis of one value takes no part in the points' names."""
    axes = {"trees": trees, "rate": rate, "depth": depth, "subsample": subsample, "min_split": min_split, "min_leaf": min_leaf}
    fixed = {k: v[0] for k, v in axes.items() if k in ("subsample", "min_split", "min_leaf") and len(v) == 1}
    grid = grid_of(**{k: list(v) for k, v in axes.items() if k not in fixed})

    def make(p: dict) -> BoostedTrees:
        return boosted_trees(**{**more, **fixed, **p})

    return ModelSpec(name, make, grid, "trees", lambda m, n: m.first(n), partial(_boosted_counts, make=make))


def stump_boost_spec(rounds: list[int] = (50, 100, 200), rate: list[float] = (0.01, 0.1, 0.5, 1.0), name: str = "adaboost") -> ModelSpec:
    def make(p: dict) -> StumpBooster:
        return StumpBooster(rounds=p["rounds"], learningRate=p["rate"])

    return ModelSpec(name, make, grid_of(rounds=list(rounds), rate=list(rate)), "rounds", lambda m, n: m.first(n), partial(_stump_counts, make=make))


def logistic_spec(c: list[float] = (0.1, 1, 10), solver: list[str] = ("liblinear", "lbfgs"), name: str = "logistic") -> ModelSpec:
    def make(p: dict) -> RidgeLogistic:
        return logistic(**p)

    return ModelSpec(name, make, grid_of(c=list(c), solver=list(solver)), count_jobs=partial(_logistic_counts, make=make))
