"""Exact random samples, splits and folds, all as filters on a hashed key.

A random order is the text order of ``md5(key|seed)``. Instead of ranking every row, the keys at the
wanted ranks are found first (``cut_points``), and a row's place follows from comparing its key with
them. The rows themselves are never shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from transferlens.functions.columns import any_of, hash_key
from transferlens.operators.ranking import DIRECT_ROWS, cut_points
from transferlens.schema import KEY, LABEL

_ORDER = "_order"


def _ordered(df: DataFrame, key: str, seed: int | None) -> DataFrame:
    return df.withColumn(_ORDER, F.col(key) if seed is None else hash_key(key, seed))


def exact_sample(df: DataFrame, n: int, seed: int, key: str = KEY, direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """Exactly ``n`` rows without replacement."""
    rows = df.count()
    if n > rows:
        raise ValueError(f"cannot take {n} rows without replacement from {rows}")
    if n <= 0:
        return df.limit(0)
    ordered, cuts = cut_points(_ordered(df, key, seed), _ORDER, {None: [n]}, direct_rows=direct_rows, largest=rows)
    return ordered.where(F.col(_ORDER) <= cuts[None][n]).drop(_ORDER)


def with_split(
    df: DataFrame, test_size: float = 0.2, seed: int = 42, key: str = KEY, stratify: str | None = None, direct_rows: int = DIRECT_ROWS
) -> DataFrame:
    """Adds ``split``: 'test' for exactly ``ceil(test_size * rows)`` rows, 'train' for the rest.

    ``stratify`` shares the test rows out over the values of a column, largest remainder first.
    """
    ordered = _ordered(df, key, seed)
    if stratify is None:
        rows = df.count()
        n_test = math.ceil(rows * test_size)
        ordered, cuts = cut_points(ordered, _ORDER, {None: [n_test]}, direct_rows=direct_rows, largest=rows)
        in_test = F.col(_ORDER) <= cuts[None][n_test] if n_test else F.lit(False)
    else:
        sizes = class_sizes(df, stratify)
        n_test = math.ceil(sum(sizes.values()) * test_size)
        share = {v: n_test * n / sum(sizes.values()) for v, n in sizes.items()}
        take = {v: math.floor(x) for v, x in share.items()}
        for v in sorted(share, key=lambda v: (take[v] - share[v], str(v)))[: n_test - sum(take.values())]:
            take[v] += 1
        ordered, cuts = cut_points(ordered, _ORDER, {v: [t] for v, t in take.items()}, stratify, direct_rows, max(sizes.values()))
        in_test = any_of([F.col(stratify).eqNullSafe(F.lit(v)) & (F.col(_ORDER) <= cuts[v][t]) for v, t in take.items() if t])
    return ordered.withColumn("split", F.when(in_test, "test").otherwise("train")).drop(_ORDER)


def train_test_split(df: DataFrame, test_size: float = 0.2, seed: int = 42, key: str = KEY, stratify: str | None = None) -> tuple[DataFrame, DataFrame]:
    marked = with_split(df, test_size, seed, key, stratify)
    return marked.where("split = 'train'").drop("split"), marked.where("split = 'test'").drop("split")


def class_sizes(df: DataFrame, label: str) -> dict:
    rows = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()
    return {r[0]: r["n"] for r in sorted(rows, key=lambda r: (r[0] is None, r[0]))}


def fold_sizes(sizes: dict, k: int) -> dict:
    """Rows of each class in each fold. Classes are dealt one after the other over the folds, so
    sizes differ by at most one, per class and in total."""
    out, start = {}, 0
    for value, n in sizes.items():
        out[value] = [len(range(start + (i - start) % k, start + n, k)) for i in range(k)]
        start += n
    return out


def with_folds(
    df: DataFrame, k: int, label: str = LABEL, seed: int | None = None, key: str = KEY, name: str = "fold", direct_rows: int = DIRECT_ROWS
) -> DataFrame:
    """Adds a stratified fold number 0 … k-1.

    Without a seed the folds are blocks in key order; with one they are blocks in a random order.
    """
    sizes = class_sizes(df, label)
    if max(sizes.values()) < k:
        raise ValueError(f"no class has {k} rows")
    ends = {}
    for value, per_fold in fold_sizes(sizes, k).items():
        ends[value] = [sum(per_fold[: i + 1]) for i in range(k - 1)]
    ordered, cuts = cut_points(_ordered(df, key, seed), _ORDER, ends, label, direct_rows, max(sizes.values()))
    fold = F.lit(k - 1)
    for i in reversed(range(k - 1)):
        here = any_of([F.col(label).eqNullSafe(F.lit(v)) & (F.col(_ORDER) <= cuts[v][e[i]]) for v, e in ends.items() if e[i]])
        fold = F.when(here, i).otherwise(fold)
    return ordered.withColumn(name, fold.cast("int")).drop(_ORDER)


def training_subset_sizes(n_train: int, fractions: list[float]) -> list[int]:
    return [int(f * n_train + 1e-9) for f in fractions]


def training_subset_cuts(
    df: DataFrame, fractions: list[float], fold: str = "fold", seed: int | None = None, key: str = KEY, direct_rows: int = DIRECT_ROWS
) -> tuple[DataFrame, dict]:
    """Nested subsets of each training part: ``{(fold, size): cut}`` over the added ``_order`` column.

    Sizes come from the first fold's training part, as one size list serves all folds.
    """
    sizes = class_sizes(df, fold)
    total = sum(sizes.values())
    wanted = training_subset_sizes(total - sizes[min(sizes)], fractions)
    ranks = {f: [min(n, total - sizes[f]) for n in wanted] for f in sizes}
    ordered = _ordered(df, key, seed)
    others = F.array(*[F.when(F.col(fold) != f, F.lit(f)) for f in sizes])
    without = F.explode(F.filter(others, lambda f: f.isNotNull()))
    ordered, cuts = cut_points(ordered, _ORDER, ranks, without, direct_rows, total - min(sizes.values()))
    return ordered, {(f, i): cuts[f][n] for f in sizes for i, n in enumerate(ranks[f])}


def training_subset(ordered: DataFrame, cuts: dict, fold_value: int, i: int, fold: str = "fold") -> DataFrame:
    """Rows of one training subset."""
    return ordered.where((F.col(fold) != fold_value) & (F.col(_ORDER) <= cuts[fold_value, i])).drop(_ORDER)


def training_subset_table(ordered: DataFrame, cuts: dict, fold: str = "fold") -> DataFrame:
    """All subsets in long form: one row per (subset, row), with ``held_out`` and ``step``."""
    marks = [
        F.when((F.col(fold) != f) & (F.col(_ORDER) <= cut), F.struct(F.lit(f).alias("held_out"), F.lit(i + 1).alias("step")))
        for (f, i), cut in cuts.items()
    ]
    tagged = ordered.withColumn("_in", F.explode(F.filter(F.array(*marks), lambda m: m.isNotNull())))
    return tagged.select(*[c for c in ordered.columns if c != _ORDER], "_in.held_out", "_in.step")


def training_subset_parts(ordered: DataFrame, cuts: dict, fold: str = "fold") -> tuple[DataFrame, DataFrame]:
    """Rows with the number of their ``_part``, and the parts of every subset: (held_out, step, fold, _part).

    A part lies between two neighbouring cuts, and subsets are unions of (fold, part). What is aggregated once
    per part adds up to all subsets, while the long form has a copy of a row for each of them.
    """
    ends = sorted(set(cuts.values()))
    part = F.size(F.filter(F.lit(ends), lambda cut: cut < F.col(_ORDER)))
    rows = ordered.where(F.col(_ORDER).isNotNull()).withColumn("_part", part).drop(_ORDER)
    folds = sorted({f for f, _ in cuts})
    members = [(f, i + 1, other, p) for (f, i), cut in cuts.items() for other in folds if other != f for p in range(ends.index(cut) + 1)]
    return rows, ordered.sparkSession.createDataFrame(members, f"held_out int, step int, {fold} int, _part int")
