"""Whitening of vectors by a weighted covariance over distinct vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transferlens.session import materialise

#: A vector with more than this share of the rows is hot; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 256


def usable(vector: str) -> Column:
    """True where the vector is neither null nor holds a null or non-finite entry."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.coalesce(F.col(vector).isNotNull() & ~bad, F.lit(False))


def scaled(vector: str, factor: float = 64.0, shift: int = 1_000_000) -> Column:
    """floor(factor * entry) + shift of every entry, as long."""
    return F.transform(F.col(vector).cast("array<double>"), lambda v: F.floor(v * F.lit(factor)) + F.lit(shift).cast("long"))


def _matrix(batch: pa.RecordBatch, column: str, width: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _summed(parts: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """Sums of the arrays ``part`` (of numpy type ``kind``) with one number ``i``, added up in tasks."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(p.as_py(), kind) for p in table.column("part"))
        return pa.table({"i": table.column("i")[:1], "part": pa.array([total.tobytes()], pa.binary())})

    rows = parts.groupBy("i").applyInArrow(add, "i int, part binary").toArrow()
    return {i.as_py(): np.frombuffer(p.as_py(), kind) for i, p in zip(rows.column("i"), rows.column("part"))}


def weighted_sums(df: DataFrame, column: str, weight: str, width: int) -> np.ndarray:
    """Sum of the vectors times their weights; exact for vectors of longs."""
    exact = df.schema[column].dataType.elementType.typeName() == "long"
    kind = "i8" if exact else "f8"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, kind)
        for batch in batches:
            if batch.num_rows:
                total += (_matrix(batch, column, width) * batch.column(weight).to_numpy()[:, None]).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"i": pa.array([0], pa.int32()), "part": pa.array([total.tobytes()], pa.binary())})

    found = _summed(df.select(column, weight).mapInArrow(sums, "i int, part binary"), kind)
    return found.get(0, np.zeros(width, kind))


def weighted_covariance(df: DataFrame, column: str, weight: str, n: int, sums: np.ndarray) -> np.ndarray:
    """Covariance with divisor ``n``: the vectors are centred, then multiplied, block by block.

    Each task adds up its blocks' products and sends one row per dimension; rows of a dimension are
    summed in a task of their own, so the driver gets one matrix however many tasks there are.
    """
    width = len(sums)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                y = centred(_matrix(batch, column, width), n, sums)
                total += (y * batch.column(weight).to_numpy()[:, None]).T @ y
        rows = pa.array([row.tobytes() for row in total], pa.binary())
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(width), pa.int32()), "part": rows})

    found = _summed(df.select(column, weight).mapInArrow(products, "i int, part binary"), "f8")
    return np.vstack([found.get(i, np.zeros(width)) for i in range(width)]) / n


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n; of longs the difference n * x - sums is taken exactly before it is divided."""
    if x.dtype.kind != "i":
        return x - sums / n
    return _differences(x, n, sums) / n


def _differences(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums without overflow: entries are taken from the rounded mean first."""
    mean = sums // n
    y = x - mean
    if len(y) and float(np.abs(y).max()) * n >= 2.0**62:
        raise OverflowError("deviations of these vectors do not fit into 64 bits")
    return y * n - (sums - mean * n)


@dataclass
class Whitening:
    """What a fit gives: ``n`` vectors, ``sums`` by dimension, components as rows, falling eigenvalues.

    ``explained`` is a component's share of the whole variance, ``identity_error`` the largest absolute
    entry of the whitened vectors' own covariance minus the identity.
    """

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None


def fit(distinct: DataFrame, column: str, weight: str, components: int = 32) -> Whitening | None:
    """Principal components of weighted vectors; None for no rows.

    At most ``components`` are kept, and none whose eigenvalue is nothing but rounding (at most
    width * 2^-52 of the largest): such a direction has no variance to divide by.
    """
    sizes = distinct.agg(F.sum(weight).alias("n"), F.min(F.size(column)).alias("a"), F.max(F.size(column)).alias("b")).first()
    if not sizes["n"]:
        return None
    if sizes["a"] != sizes["b"]:
        raise ValueError(f"vectors have from {sizes['a']} to {sizes['b']} entries")
    n, width = int(sizes["n"]), int(sizes["a"])
    if width == 0:
        return Whitening(n, np.zeros(0, "i8"), np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    sums = weighted_sums(distinct, column, weight, width)
    covariance = weighted_covariance(distinct, column, weight, n, sums)
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1].T
    kept = int((values[:components] > max(values[0], 0.0) * width * 2.0**-52).sum())
    return Whitening(n, sums, vectors[:kept], values[:kept], values[:kept] / np.trace(covariance))


def apply(distinct: DataFrame, column: str, model: Whitening) -> DataFrame:
    """Adds ``whitened`` (array of doubles, one per component) and ``deviation`` (exact long)."""
    n, sums, width = model.n, model.sums, len(model.sums)
    scale = (model.components / np.sqrt(model.eigenvalues)[:, None]).T
    kept = distinct.columns

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, column, width) if width else np.zeros((batch.num_rows, 0), "i8")
            d = _differences(x, n, sums)
            if d.size and float(np.abs(d).max()) ** 2 * width >= 2.0**63:
                raise OverflowError("the deviation does not fit into 64 bits")
            z = (d / n) @ scale
            offsets = pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32())
            whitened = pa.ListArray.from_arrays(offsets, pa.array(z.ravel(), pa.float64()))
            arrays = [batch.column(c) for c in kept] + [whitened, pa.array((d * d).sum(axis=1), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "whitened", "deviation"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in distinct.schema.fields)
    return distinct.mapInArrow(project, fields + ", whitened array<double>, deviation long")


def whiten(df: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = 32) -> tuple[DataFrame, Whitening | None]:
    """(rows (id, whitened array<double>, deviation long), the fitted model) of the usable vectors.

    1. Entries become scaled longs; equal vectors are counted (partial counts before the shuffle).
    2. The covariance is fitted on the distinct vectors, weighted by their counts.
    3. Each distinct vector is whitened once, in a written table; its covariance gives ``identity_error``.
    4. Rows get their vector's result back by a join. Vectors with more than 1/256 of the rows, at most
       255 of them, are broadcast; the other rows are shuffled, none of whose keys is hot.

    Null vectors and vectors with null or non-finite entries are left out. Ids take no part: null or
    repeated ones keep one row for each of theirs. No usable row gives no rows and no model; vectors of
    different lengths are an error. Other columns are not read.
    """
    spark = df.sparkSession
    rows = df.where(usable(vector)).select(F.col(id).alias("id"), scaled(vector).alias("x"))
    distinct = materialise(rows.groupBy("x").agg(F.count(F.lit(1)).alias("weight")))
    model = fit(distinct, "x", "weight", components)
    kind = df.schema[id].dataType.simpleString()
    if model is None:
        return spark.createDataFrame([], f"`{id}` {kind}, whitened array<double>, deviation long"), None
    white = materialise(apply(distinct, "x", model))
    kept = len(model.eigenvalues)
    if kept:
        means = weighted_sums(white, "whitened", "weight", kept)
        model.identity_error = float(np.abs(weighted_covariance(white, "whitened", "weight", model.n, means) - np.eye(kept)).max())
    hot = white.where(F.col("weight") > F.lit(model.n * HOT_SHARE))
    near = rows.join(F.broadcast(hot), "x")
    far = rows.join(F.broadcast(hot.select("x")), "x", "left_anti").join(white.where(F.col("weight") <= F.lit(model.n * HOT_SHARE)), "x")
    out = near.unionByName(far)
    return out.select(F.col("id").alias(id), "whitened", "deviation"), model


def by_component(rows: DataFrame, model: Whitening | None, id: str = "vec_id") -> DataFrame:
    """One row per (row, component): id, component (from 1), n, deviation, whitened, explained, identity_error."""
    n, error, explained = (model.n, model.identity_error, model.explained.tolist()) if model else (0, None, [])
    long = rows.select(id, "deviation", F.posexplode("whitened").alias("k", "whitened"))
    shares = F.lit(explained) if explained else F.array().cast("array<double>")
    return long.select(
        id, (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("k")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
