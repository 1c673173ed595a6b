"""Training from a transfer table to a chosen, saved and measured model."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Model
from pyspark.sql import DataFrame, functions as F

from transferlens.functions.columns import enrich
from transferlens.operators.balancing import oversample
from transferlens.operators.features import FeatureEncoder, FittedEncoder
from transferlens.operators.models import ModelSpec, boosted_trees_spec, forest_spec, stump_boost_spec
from transferlens.operators.sampling import class_sizes, exact_sample, with_folds, with_split
from transferlens.operators.scoring import Scorer, as_requests
from transferlens.operators.tuning import best_model, evaluate_models
from transferlens.schema import KEY, LABEL
from transferlens.session import materialise
from transferlens.sources.runlog import RunLog


@dataclass
class PreparedData:
    """Encoded train and test rows: row key, ``features``, ``label``."""

    encoder: FittedEncoder
    train: DataFrame
    test: DataFrame
    split: DataFrame

    def train_sizes(self) -> dict:
        """Training rows of each class, counted before they are encoded."""
        return class_sizes(self.split.where("split = 'train'").withColumn("label", F.col(LABEL).cast("double")), "label")


def prepare(transfers: DataFrame, sample: int | None = None, sample_seed: int = 6, split_seed: int = 42, stratify: str | None = None) -> PreparedData:
    """Sample, split, derive the weekday, fit the encoder on train and apply it to both parts."""
    rows = exact_sample(transfers, sample, sample_seed) if sample else transfers
    # The few columns the model needs, written once and read by every later step.
    wanted = enrich(rows).select(KEY, "amount_received", "account", "account_1", "payment_format", "day", LABEL)
    marked = materialise(with_split(wanted, 0.2, split_seed, stratify=stratify))
    train, test = marked.where("split = 'train'"), marked.where("split = 'test'")
    encoder = FeatureEncoder().fit(train)

    def encode(df: DataFrame) -> DataFrame:
        return encoder.transform_to_vector(df.withColumn("label", F.col(LABEL).cast("double")), [KEY, "label"])

    return PreparedData(encoder, encode(train), encode(test), marked)


def default_specs() -> list[ModelSpec]:
    """The full grids: 3 forests, 12 boosted stump models, 12 boosted tree models."""
    return [forest_spec(), stump_boost_spec(), boosted_trees_spec()]


@dataclass
class TrainingResult:
    report: DataFrame
    chosen: str
    scorer: Scorer
    models: dict[str, Model]


def train(
    transfers: DataFrame,
    specs: list[ModelSpec] | None = None,
    sample: int | None = None,
    folds: int = 3,
    fold_seed: int | None = None,
    choose_by: str = "recall",
    save_to: str | None = None,
    run_log: RunLog | None = None,
    parallelism: int = 4,
) -> TrainingResult:
    """The whole run: prepare, balance, search, refit, measure, choose, save, log."""
    started = int(time.time() * 1000)
    data = prepare(transfers, sample)
    train_rows = data.train.persist(StorageLevel.MEMORY_AND_DISK)
    balanced = materialise(with_folds(oversample(train_rows), folds, "label", fold_seed))
    train_rows.unpersist()
    report, models = evaluate_models(balanced, data.test, specs or default_specs(), parallelism=parallelism)
    best = best_model(report, choose_by)
    scorer = Scorer(data.encoder, models[best["model"]])
    if save_to:
        scorer.save(save_to, as_requests(enrich(transfers)).limit(0))
    if run_log:
        test_rows = report.where(f"split = 'test' and model = '{best['model']}'")
        run_id = f"{best['model']}-{started}"
        run_log.log_metrics(test_rows, run_id, ["precision", "recall", "f1"], int(time.time() * 1000))
        run_log.log_run(run_id, started, int(time.time() * 1000), "FINISHED", "training")
    return TrainingResult(report, best["model"], scorer, models)
