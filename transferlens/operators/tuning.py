"""Grid search, learning curves, and the comparison of models."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Row, functions as F

from transferlens.operators.metrics import CELLS, choose_model, confusion_counts, curve_areas, with_rates, with_weighted_scores
from transferlens.operators.models import ModelSpec
from transferlens.operators.profiling import mean_and_spread
from transferlens.operators.sampling import training_subset, training_subset_cuts
from transferlens.operators.splits import Rows
from transferlens.session import discard, materialise

Resample = Callable[[DataFrame], DataFrame]


@dataclass
class SearchResult:
    """``scores``: one row per (grid point, fold). ``table``: their means, best first."""

    scores: DataFrame
    table: DataFrame
    best_params: dict
    best_score: float


def _hold(*tables: DataFrame) -> list[DataFrame]:
    """Keeps tables in memory, spilling to disk; returns those the caller had not kept or written already."""
    return [df.persist(StorageLevel.MEMORY_AND_DISK) for df in tables if not df.is_cached and not getattr(df, "_written_step", None)]


def _release(held: list[DataFrame]) -> None:
    for df in held:
        df.unpersist()


def _counts(model: Model, df: DataFrame) -> Row:
    return confusion_counts(model.transform(df), "label").first()


def _score_rows(df: DataFrame, rows: list[tuple], columns: str) -> DataFrame:
    """Confusion counts of fitted models (a few numbers each) as a table with weighted scores."""
    schema = columns + ", " + ", ".join(f"{c} long" for c in CELLS)
    return with_weighted_scores(df.sparkSession.createDataFrame(rows, schema))


def grid_search(
    df: DataFrame, spec: ModelSpec, fold: str = "fold", refit: str = "recall", parallelism: int = 4, resample: Resample | None = None
) -> SearchResult:
    """Every grid point on every fold, scored by accuracy and weighted precision, recall and F1.

    One fit and one confusion count give all four scores. Ties go to the grid point listed first.
    ``resample`` is applied to the training part of each fold (oversampling inside the folds).
    """
    held = _hold(df)
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    parts = {f: (df.where(F.col(fold) != f), df.where(F.col(fold) == f)) for f in folds}
    if resample:
        parts = {f: (resample(train.drop(fold)).persist(StorageLevel.MEMORY_AND_DISK), test) for f, (train, test) in parts.items()}

    # Grid points that differ only in the stage come from one fit at the largest stage.
    fits: dict[str, list[int]] = {}
    for i, p in enumerate(spec.grid):
        fits.setdefault(json.dumps({k: v for k, v in p.items() if k != spec.stage_param}, sort_keys=True), []).append(i)
    jobs = []
    for points in fits.values():
        largest = max(points, key=lambda i: spec.grid[i].get(spec.stage_param, 0))
        jobs += [(spec.grid[largest], f, points) for f in folds]

    def run(job: tuple[dict, int, list[int]]) -> list[tuple]:
        params, f, points = job
        train, test = parts[f]
        model = spec.make(params).fit(train)
        stages = [spec.stage(model, spec.grid[i][spec.stage_param]) if spec.stage_param else model for i in points]
        return [_counts(stage, test) for stage in stages]

    if spec.count_jobs and not resample:
        wanted = [(p, Rows(f), [spec.grid[i].get(spec.stage_param, 1) for i in points], [True]) for p, f, points in jobs]
        counts = [parts[0] for parts in spec.count_jobs(df, wanted, fold=fold)]
    else:
        with ThreadPool(parallelism) as pool:
            counts = pool.map(run, jobs, chunksize=1)
    rows = [(i, json.dumps(spec.grid[i]), f, *c) for (_, f, points), part in zip(jobs, counts) for i, c in zip(points, part)]
    if resample:
        for train, _ in parts.values():
            train.unpersist()
    _release(held)
    scores = _score_rows(df, rows, "grid_no int, params string, fold int")
    table = mean_scores(scores, refit)
    best = table.first()
    return SearchResult(scores, table, json.loads(best["params"]), best[refit])


def mean_scores(scores: DataFrame, refit: str = "recall") -> DataFrame:
    """Mean of each score over the folds, best grid point first."""
    metrics = ["accuracy", "precision", "recall", "f1"]
    return scores.groupBy("grid_no", "params").agg(*[F.avg(m).alias(m) for m in metrics]).orderBy(F.desc(F.round(refit, 12)), "grid_no")


def cross_validate(df: DataFrame, spec: ModelSpec, params: dict, fold: str = "fold", parallelism: int = 4) -> DataFrame:
    """Mean weighted scores of one parameter setting."""
    one = ModelSpec(spec.name, spec.make, [params], spec.stage_param, spec.stage, spec.count_jobs)
    return grid_search(df, one, fold, parallelism=parallelism).table


def learning_curve(
    df: DataFrame, spec: ModelSpec, params: dict, fractions: list[float], fold: str = "fold", seed: int | None = None, parallelism: int = 4
) -> DataFrame:
    """Weighted precision and recall on training subset and held-out fold, per (step, fold).

    One fit per (size, fold) serves every score, and all of them share their passes where the model can.
    Subsets with one class only give null scores.
    """
    ordered, cuts = training_subset_cuts(df, fractions, fold, seed)
    folds = sorted({f for f, _ in cuts})
    # Per fold, the number of the first subset that holds the row: subsets are nested.
    first = [F.size(F.filter(F.lit([cuts[f, i] for i in range(len(fractions))]), lambda cut: cut < F.col("_order"))) for f in folds]
    ordered = ordered.withColumn("_steps", F.array(*[first[folds.index(f)] if f in folds else F.lit(0) for f in range(max(folds) + 1)]))
    ordered = materialise(ordered.drop("_order") if spec.count_jobs else ordered)
    sizes = _subset_sizes(ordered, fold, folds, len(fractions))
    rows, open_jobs = [], []
    for f, i in cuts:
        n = sum(sizes[f, i].values())
        if len(sizes[f, i]) < 2:
            rows += [(i + 1, f, n, part, None, None, None, None) for part in ("train", "validation")]
        else:
            open_jobs.append((f, i, n))
    if spec.count_jobs:
        stages = [params.get(spec.stage_param, 1)]
        found = spec.count_jobs(ordered, [(params, Rows(f, i), stages, [False, True]) for f, i, _ in open_jobs], fold=fold, steps="_steps")
        for (f, i, n), (trained, held) in zip(open_jobs, found):
            rows += [(i + 1, f, n, "train", *trained[0]), (i + 1, f, n, "validation", *held[0])]
    else:

        def run(job: tuple[int, int, int]) -> list[tuple]:
            f, i, n = job
            subset = training_subset(ordered.drop("_steps"), cuts, f, i, fold)
            model = spec.make(params).fit(subset)
            held = ordered.where(F.col(fold) == f)
            return [(i + 1, f, n, "train", *_counts(model, subset)), (i + 1, f, n, "validation", *_counts(model, held))]

        with ThreadPool(parallelism) as pool:
            rows += [r for part in pool.map(run, open_jobs, chunksize=1) for r in part]
    discard(ordered)
    return _score_rows(df, rows, "step int, fold int, n_train long, part string")


def _subset_sizes(ordered: DataFrame, fold: str, folds: list[int], steps: int) -> dict[tuple[int, int], dict]:
    """Rows by label in every (fold, step), from one count by the first step that holds a row."""
    each = ordered.select("label", F.col(fold).alias("own"), F.explode(F.lit(folds)).alias("f"), "_steps").where("own <> f")
    counts = each.groupBy("f", F.get("_steps", F.col("f")).alias("step"), "label").count().collect()
    out: dict[tuple[int, int], dict] = {(f, i): {} for f in folds for i in range(steps)}
    for r in counts:
        for i in range(r["step"], steps):
            out[r["f"], i][r["label"]] = out[r["f"], i].get(r["label"], 0) + r["count"]
    return out


def curve_summary(curve: DataFrame) -> DataFrame:
    """Mean and population deviation over the folds."""
    return mean_and_spread(curve, ["step", "part"], ["precision", "recall"])


def with_score(predicted: DataFrame) -> DataFrame:
    """Adds ``score``, the probability of the positive class."""
    return predicted.withColumn("score", vector_to_array("probability")[1])


def evaluate_models(
    train: DataFrame, test: DataFrame, specs: list[ModelSpec], fold: str = "fold", refit: str = "accuracy", parallelism: int = 4, areas: bool = True
) -> tuple[DataFrame, dict[str, Model]]:
    """Searches, refits and measures every model: one report row per (model, split).

    ``train`` carries a fold column. ``recall`` is the weighted recall, which equals accuracy; the
    share of suspicious transfers found is ``tpr``.
    """
    held = _hold(train, test)
    rows, models = [], {}
    for number, spec in enumerate(specs):
        best = grid_search(train, spec, fold, refit, parallelism).best_params
        model = spec.make(best).fit(train.drop(fold))
        models[spec.name] = model
        for split, part in (("train", train), ("test", test)):
            roc = pr = None
            predicted = with_score(model.transform(part)).select("label", "prediction", "score").persist(StorageLevel.MEMORY_AND_DISK)
            counts = confusion_counts(predicted, "label").first()
            if areas and split == "test":
                roc, pr = curve_areas(predicted, label="label").first()
            predicted.unpersist()
            rows.append((number, spec.name, split, json.dumps(best), roc, pr, *counts))
    _release(held)
    columns = "model_no int, model string, split string, params string, roc_auc double, pr_auc double"
    return with_rates(_score_rows(train, rows, columns)), models


def best_model(report: DataFrame, by: str = "recall") -> Row:
    """The model with the highest test score; the first one listed wins ties."""
    return choose_model(report.where("split = 'test'"), by).first()
