"""AdaBoost on stumps (multi-class exponential loss, two classes), which Spark ML does not have.

A stump splits at any distinct value, halfway to the next one (``splits.search``). Weights are kept as
sums of the weights of the stumps that got a row wrong, written anew every few rounds, so there is no state
to lose and no lineage that grows. Several settings, folds and training subsets are boosted side by side in
the same passes over the rows.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from transferlens.operators.splits import BINS, Block, Gini, Packed, Rows, pack, released, search, summed, with_margins

# Rounds after which weights are written instead of being recomputed from the stumps.
KEPT_ROUNDS = 16


@dataclass(frozen=True)
class BoostSetting:
    """One model to boost; ``held_out`` leaves a fold out of its training rows, ``step`` takes a nested subset of them."""

    rounds: int
    learning_rate: float
    held_out: int | None = None
    step: int | None = None

    @property
    def rows(self) -> Rows:
        return Rows(self.held_out, self.step)


def _misses(block: Block, s: int, since: list[tuple], shift: float) -> np.ndarray:
    """Logarithm of the weights of a setting's rows."""
    out = (block.margin[s] if len(block.margin) else np.zeros(block.n)) - shift
    for f, t, left, right, alpha in since:
        out = out + alpha * (np.where(block.x[f] <= t, left, right) != block.y)
    return out


def boost_packed(data: Packed, settings: list[BoostSetting]) -> list[list[tuple]]:
    """Stumps ``(feature, threshold, left class, right class, alpha)`` of every setting."""
    stumps: list[list[tuple]] = [[] for _ in settings]
    since: list[list[tuple]] = [[] for _ in settings]
    # Keeps the summed weight near 1, so that exp cannot overflow.
    shift = [0.0] * len(settings)
    active, rule, first = list(range(len(settings))), Gini(), data
    for step in range(max(s.rounds for s in settings)):
        active = [i for i in active if step < settings[i].rounds]
        if not active:
            break
        now, new, away = list(active), [list(s) for s in since], list(shift)

        def weigh(block: Block, now=now, new=new, away=away):
            for k, i in enumerate(now):
                w = np.exp(_misses(block, i, new[i], away[i]))
                node = np.where(settings[i].rows.mask(block), 0, -1)
                yield k, 1, node, np.stack([np.where(block.y == 0, w, 0), np.where(block.y == 1, w, 0), np.ones(block.n)])

        for i, split in zip(now, search(data, weigh, len(now), rule, same_rows=[settings[i].rows for i in now])):
            if split is None:
                active.remove(i)
                continue
            sides = split.left, split.right
            classes = [int(s[1] > s[0]) for s in sides]
            total = sum(s[0] + s[1] for s in sides)
            error = float(sum(s[1 - c] for s, c in zip(sides, classes)) / total)
            if error >= 0.5:
                active.remove(i)
                continue
            if error <= 1e-15:
                # A perfect stump ends the boosting.
                stumps[i].append((split.feature, split.threshold, *classes, 1.0))
                active.remove(i)
                continue
            alpha = settings[i].learning_rate * math.log((1 - error) / error)
            stumps[i].append((split.feature, split.threshold, *classes, alpha))
            since[i].append(stumps[i][-1])
            shift[i] += math.log(float(total) * (1 - error + error * math.exp(alpha)))
        if (step + 1) % KEPT_ROUNDS == 0 and active:
            kept = [list(s) for s in since]
            before, data = data, with_margins(data, lambda block: np.stack([_misses(block, i, s, 0.0) for i, s in enumerate(kept)]))  # noqa: B023
            since = [[] for _ in settings]
            if before is not first:
                released(before)
    if data is not first:
        released(data)
    return stumps


def boost(df: DataFrame, settings: list[BoostSetting], features: str, label: str, fold: str | None = None, bins: int = BINS) -> list[list[tuple]]:
    """Stumps ``(feature, threshold, left class, right class, alpha)`` of every setting. ``bins`` are the coarse
    bins of the first look and do not change the result."""
    data = pack(df, features, label, fold, bins=bins)
    _check_features(data)
    stumps = boost_packed(data, settings)
    released(data)
    return stumps


def _check_features(data: Packed) -> None:
    if not any(len(e) for e in data.edges):
        raise ValueError("all features are constant")


def vote_counts(data: Packed, jobs: list[tuple[list[tuple], list[int], Rows, bool]]) -> list[list[tuple[int, int, int, int]]]:
    """(tn, fp, fn, tp) after the first n stumps, for every n of each job (stumps, stages, rows, held-out rows instead), in one pass."""
    places = np.cumsum([0, *[4 * len(stages) for _, stages, _, _ in jobs]]).tolist()

    def add(block: Block, total: np.ndarray) -> None:
        for (stumps, stages, rows, held), first in zip(jobs, places):
            on = np.flatnonzero(block.fold == rows.held_out if held else rows.mask(block))
            cell, vote = 2 * block.y[on].astype(np.int64), np.zeros(len(on))
            wanted = {n: first + 4 * i for i, n in enumerate(stages)}
            for n in range(1, max(stages) + 1):
                if n <= len(stumps):
                    f, t, left, right, alpha = stumps[n - 1]
                    vote += alpha * np.where(block.x[f, on] <= t, 2 * left - 1, 2 * right - 1)
                if n in wanted:
                    total[wanted[n] : wanted[n] + 4] += np.bincount(cell + (vote > 0), minlength=4)

    counts = summed(data, places[-1], add).astype(int)
    return [[tuple(counts[first + 4 * i : first + 4 * i + 4].tolist()) for i in range(len(stages))] for (_, stages, _, _), first in zip(jobs, places)]


class _BoostParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol):
    rounds = Param(Params._dummy(), "rounds", "number of stumps", TypeConverters.toInt)
    learningRate = Param(Params._dummy(), "learningRate", "factor on each stump's weight", TypeConverters.toFloat)


class StumpBooster(Estimator, _BoostParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, rounds=50, learningRate=1.0, featuresCol="features", labelCol="label"):
        super().__init__()
        self._setDefault(rounds=50, learningRate=1.0)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "StumpBoosterModel":
        setting = BoostSetting(self.getOrDefault(self.rounds), self.getOrDefault(self.learningRate))
        return self.wrap(boost(df, [setting], self.getFeaturesCol(), self.getLabelCol())[0])

    def wrap(self, stumps: list[tuple]) -> "StumpBoosterModel":
        return self._copyValues(StumpBoosterModel(stumps=stumps))


class StumpBoosterModel(Model, _BoostParams, DefaultParamsReadable, DefaultParamsWritable):
    stumps = Param(Params._dummy(), "stumps", "JSON list of (feature, threshold, left, right, alpha)", TypeConverters.toString)

    def __init__(self, stumps: list[tuple] | None = None):
        super().__init__()
        self._set(stumps=json.dumps(stumps or []))

    def stump_list(self) -> list[tuple]:
        return [tuple(s) for s in json.loads(self.getOrDefault(self.stumps))]

    def first(self, n: int) -> "StumpBoosterModel":
        """The model after its first ``n`` rounds."""
        return self._copyValues(StumpBoosterModel(), {}).set_stumps(self.stump_list()[:n])

    def set_stumps(self, stumps: list[tuple]) -> "StumpBoosterModel":
        return self._set(stumps=json.dumps(stumps))

    def _transform(self, df: DataFrame) -> DataFrame:
        stumps = self.stump_list()
        weight = sum(s[4] for s in stumps) or 1.0
        table = F.array(
            *[
                F.struct(
                    F.lit(int(f)).alias("f"),
                    F.lit(float(t)).alias("t"),
                    F.lit(a * (2 * left - 1) / weight).alias("left"),
                    F.lit(a * (2 * right - 1) / weight).alias("right"),
                )
                for f, t, left, right, a in stumps
            ]
        )
        if not stumps:
            vote = F.lit(0.0)
        else:
            x = vector_to_array(self.getFeaturesCol())
            vote = F.aggregate(table, F.lit(0.0), lambda acc, s: acc + F.when(x[s["f"]] <= s["t"], s["left"]).otherwise(s["right"]))
        p = 1.0 / (1.0 + F.exp(-2.0 * F.col("_vote")))
        return (
            df.withColumn("_vote", vote)
            .withColumns(
                {
                    self.getRawPredictionCol(): array_to_vector(F.array(-F.col("_vote"), F.col("_vote"))),
                    self.getProbabilityCol(): array_to_vector(F.array(1.0 - p, p)),
                    self.getPredictionCol(): F.when(F.col("_vote") > 0, 1.0).otherwise(0.0),
                }
            )
            .drop("_vote")
        )
