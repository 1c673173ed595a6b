"""Tests of independence and collinearity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from transferlens.functions.columns import as_long_table, is_missing
from transferlens.functions.special import chi2_tail
from transferlens.schema import LABEL


def chi_squared(df: DataFrame, columns: list[str], label: str = LABEL) -> DataFrame:
    """Pearson's test of each categorical column against the 0/1 label: ``chi2`` and ``dof``.

    One groupBy for all columns, then one small aggregate per column; no join with the margins.
    With d = n1 - R·p0 for a row total R and any constant p0 near the label rate p,
    chi2 = (Σ d²/R - (Σ d)²/N) / (p(1-p)), which loses no digits however large N is. A 2x2 table
    gets Yates' correction.
    """
    p0 = df.agg(F.avg(F.col(label).cast("double"))).first()[0]
    p0 = 0.5 if p0 is None else p0
    rows = (
        as_long_table(df, columns, [label])
        .where(F.col("value").isNotNull() & F.col(label).isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("r"), F.sum(F.col(label).cast("bigint")).alias("n1"))
        .withColumn("d", F.col("n1") - F.col("r") * F.lit(p0))
    )
    sums = rows.groupBy("column").agg(
        F.sum("r").alias("n"),
        F.sum("n1").alias("ones"),
        F.count(F.lit(1)).alias("values"),
        F.sum("d").alias("d"),
        F.sum(F.col("d") * F.col("d") / F.col("r")).alias("d2"),
        F.sum(1.0 / F.col("r")).alias("inverse"),
    )
    p = F.col("ones") / F.col("n")
    plain = (F.col("d2") - F.col("d") * F.col("d") / F.col("n")) / (p * (1 - p))
    # Σ 1/E over the four cells; |O-E| is the same in each of them.
    inverse_e = F.col("inverse") / (p * (1 - p))
    distance = F.sqrt(F.greatest(plain, F.lit(0.0)) / inverse_e)
    yates = F.pow(F.greatest(distance - 0.5, F.lit(0.0)), 2) * inverse_e
    both = (F.col("ones") > 0) & (F.col("ones") < F.col("n"))
    return sums.select(
        "column",
        F.col("n"),
        F.when(~both | (F.col("values") < 2), 0.0).when(F.col("values") == 2, yates).otherwise(plain).alias("chi2"),
        F.when(both, F.col("values") - 1).otherwise(F.lit(0)).cast("bigint").alias("dof"),
    )


def independence_test(df: DataFrame, columns: list[str], label: str = LABEL, alpha: float = 0.05) -> DataFrame:
    """``chi_squared`` with the p-value and the verdict at ``alpha``."""
    tested = chi_squared(df, columns, label).withColumn("p_value", chi2_tail("chi2", F.col("dof").cast("double")))
    return tested.withColumn("verdict", F.when(F.col("p_value") < alpha, "reject").otherwise("fail_to_reject"))


def variance_inflation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Variance inflation factor of each column, and of the constant.

    One aggregate gives means and covariances; the small matrix is inverted where that row lands. A
    column that others determine has an infinite factor, one without spread none (null).
    """
    present = ~is_missing(df, columns[0])
    for c in columns[1:]:
        present &= ~is_missing(df, c)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    clean = df.where(present).select(*[F.col(c).cast("double").alias(c) for c in columns])
    row = clean.agg(
        F.array(*[F.avg(c) for c in columns]).alias("means"),
        F.array(*[F.covar_pop(columns[i], columns[j]) for i, j in pairs]).alias("covariances"),
    )
    p = len(columns)

    def invert(batches):
        for batch in batches:
            for means, flat in zip(batch["means"], batch["covariances"]):
                s = np.zeros((p, p))
                for (i, j), v in zip(pairs, flat):
                    s[i, j] = s[j, i] = v
                yield pd.DataFrame({"feature": ["const", *columns], "vif": _factors(np.asarray(means, dtype=float), s)})

    return row.mapInPandas(invert, "feature string, vif double")


def _factors(means: np.ndarray, s: np.ndarray) -> list[float]:
    spread = np.sqrt(np.diag(s))
    live = spread > 0
    scaled = s[np.ix_(live, live)] / np.outer(spread[live], spread[live])
    if live.all() and np.linalg.matrix_rank(scaled, tol=1e-12) == len(scaled):
        inverse = np.linalg.inv(s)
        return [1.0 + means @ inverse @ means, *(np.diag(inverse) * np.diag(s))]
    factors, k = np.full(len(s), np.nan), np.flatnonzero(live)
    for j in range(len(k)):
        rest = np.delete(np.arange(len(k)), j)
        unexplained = 1.0 - scaled[j, rest] @ np.linalg.pinv(scaled[np.ix_(rest, rest)]) @ scaled[rest, j]
        factors[k[j]] = 1.0 / unexplained if unexplained > 1e-10 else np.inf
    share = means[live] / spread[live]
    constant = np.inf if (means[~live] != 0).any() else 1.0 + share @ np.linalg.pinv(scaled) @ share
    return [constant, *factors]


def with_vif_band(vif: DataFrame) -> DataFrame:
    """1: none, up to 5: moderate, above 5: high."""
    band = F.when(F.col("vif") > 5, "high").when(F.col("vif") > 1 + 1e-9, "moderate").otherwise("none")
    return vif.withColumn("collinearity", band)
