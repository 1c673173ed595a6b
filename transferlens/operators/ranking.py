"""Exact ranks, cut points and running totals without a window over the whole table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.ml.feature import Bucketizer

from transferlens.functions.columns import any_of
from transferlens.session import materialise

# A bucket of at most this many rows is sorted in one task.
DIRECT_ROWS = 100_000
PREFIX_STEP = 3


def _spread_copies(df: DataFrame, key: str, tied: list[str]) -> DataFrame:
    """Gives the copies of a tied key different keys; the checkpoint fixes their numbering."""
    numbered = materialise(df.withColumn("_copy", F.monotonically_increasing_id()))
    # The separator sorts before every character, so an extended key keeps its place among the others.
    extended = F.concat(F.col(key), F.lit("\u0000"), F.md5(F.col("_copy").cast("string")))
    return numbered.withColumn(key, F.when(F.col(key).isin(tied), extended).otherwise(F.col(key))).drop("_copy")


def _search(keys: DataFrame, wanted: set[tuple], direct_rows: int) -> dict[tuple, tuple[str, int, int]]:
    """For each wanted (stratum, rank): its key, how many copies of it are needed, how many exist.

    ``keys`` has columns ``s`` and ``k``. Each round counts rows by a longer key prefix and keeps
    only the prefixes that hold a wanted rank, so a round moves a few thousand counts, never rows.
    """
    found: dict[tuple, tuple[str, int, int]] = {}
    open_at = {w: ("", w[1]) for w in wanted}
    width = 0
    while open_at:
        width += PREFIX_STEP
        parents = {(s, prefix) for (s, _), (prefix, _) in open_at.items()}
        parent = F.substring("k", 1, width - PREFIX_STEP) if width > PREFIX_STEP else F.lit("")
        inside = any_of([F.col("s").eqNullSafe(F.lit(s)) & (parent == p) for s, p in parents])
        counts = (
            keys.where(inside)
            .groupBy("s", parent.alias("parent"), F.substring("k", 1, width).alias("bucket"))
            # Hashes keep this a hash aggregate; a minimum of texts would sort all rows.
            .agg(F.count(F.lit(1)).alias("n"), F.min(F.xxhash64("k")).alias("low"), F.max(F.xxhash64("k")).alias("high"))
        )
        order = Window.partitionBy("s", "parent").orderBy("bucket")
        upto = counts.withColumn("upto", F.sum("n").over(order))
        hits = any_of(
            [
                F.col("s").eqNullSafe(F.lit(s)) & (F.col("parent") == p) & (F.col("upto") >= r) & (F.col("upto") - F.col("n") < r)
                for (s, _), (p, r) in open_at.items()
            ]
        )
        buckets = upto.where(hits).collect()
        small: dict[tuple, tuple[str, int]] = {}
        still: dict[tuple, tuple[str, int]] = {}
        for w, (p, r) in open_at.items():
            hit = next(b for b in buckets if b.s == w[0] and b.parent == p and b.upto - b.n < r <= b.upto)
            rest = r - (hit.upto - hit.n)
            if hit.n <= direct_rows:
                small[w] = (hit.bucket, rest)
            elif hit.low == hit.high and (only := _only_key(keys, w[0], hit.bucket, width)) is not None:
                found[w] = (only, rest, hit.n)
            else:
                still[w] = (hit.bucket, rest)
        if small:
            found.update(_sorted_lookup(keys, small, width))
        open_at = still
    return found


def _only_key(keys: DataFrame, stratum, bucket: str, width: int) -> str | None:
    """The key of a bucket if all its rows share it."""
    inside = keys.where(F.col("s").eqNullSafe(F.lit(stratum)) & (F.substring("k", 1, width) == bucket))
    low, high = inside.agg(F.min("k"), F.max("k")).first()
    return low if low == high else None


def _sorted_lookup(keys: DataFrame, small: dict[tuple, tuple[str, int]], width: int) -> dict:
    """Keys at ranks inside small buckets, each sorted in one task."""
    bucket = F.substring("k", 1, width)
    places = {(s, b) for (s, _), (b, _) in small.items()}
    inside = any_of([F.col("s").eqNullSafe(F.lit(s)) & (bucket == b) for s, b in places])
    order = Window.partitionBy("s", "bucket").orderBy("k")
    grouped = keys.where(inside).groupBy("s", bucket.alias("bucket"), "k").agg(F.count(F.lit(1)).alias("n"))
    upto = grouped.withColumn("upto", F.sum("n").over(order))
    hits = any_of(
        [
            F.col("s").eqNullSafe(F.lit(s)) & (F.col("bucket") == b) & (F.col("upto") >= r) & (F.col("upto") - F.col("n") < r)
            for (s, _), (b, r) in small.items()
        ]
    )
    rows = upto.where(hits).collect()
    out = {}
    for w, (b, r) in small.items():
        row = next(x for x in rows if x.s == w[0] and x.bucket == b and x.upto - x.n < r <= x.upto)
        out[w] = (row.k, r - (row.upto - row.n), row.n)
    return out


def cut_points(
    df: DataFrame, key: str, ranks: dict, stratum: str | Column | None = None, direct_rows: int = DIRECT_ROWS, largest: int | None = None
) -> tuple[DataFrame, dict]:
    """Keys that sit at given ranks, so that "the first r rows" becomes the filter ``key <= cut``.

    ``ranks`` maps a stratum value (None without strata) to ranks counted from 1; ``stratum`` may
    explode a row into several strata; ``largest`` is the size of the largest stratum, if known. A cut that would fall between copies of one key first tells the copies apart; hence the returned table, which has
    the same rows, is the one to filter.
    """
    wanted = {(s, r) for s, rs in ranks.items() for r in rs if r > 0}
    if not wanted:
        return df, {s: {} for s in ranks}
    s = F.lit(None).cast("string") if stratum is None else stratum
    s = F.col(s) if isinstance(s, str) else s
    while True:
        keys = df.select(s.alias("s"), F.col(key).alias("k"))
        if largest is not None and largest <= direct_rows:
            found = _sorted_lookup(keys, {w: ("", w[1]) for w in wanted}, 0)
        else:
            found = _search(keys, wanted, direct_rows)
        tied = sorted({k for k, needed, copies in found.values() if needed < copies})
        if not tied:
            break
        df = _spread_copies(df, key, tied)
    cuts: dict = {s: {} for s in ranks}
    for (s_value, rank), (k, _, _) in found.items():
        cuts[s_value][rank] = k
    return df, cuts


def with_dense_index(df: DataFrame, key: str, rows: int, name: str = "index") -> DataFrame:
    """Adds 0, 1, 2, … in order of (md5(key), key).

    Buckets of the md5 are counted, their totals turned into offsets (at most 65,536 rows, which are
    broadcast), and rows are numbered inside their bucket.
    """
    width = 0 if rows <= DIRECT_ROWS else (3 if rows <= 10**9 else 4)
    hashed = df.withColumn("_hash", F.md5(F.col(key)))
    if width == 0:
        order = Window.orderBy("_hash", key)
        return hashed.withColumn(name, (F.row_number().over(order) - 1).cast("bigint")).drop("_hash")
    bucketed = hashed.withColumn("_bucket", F.substring("_hash", 1, width))
    counts = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    order = Window.partitionBy("_bucket").orderBy("_hash", key)
    numbered = bucketed.withColumn("_place", F.row_number().over(order) - 1)
    return (
        numbered.join(F.broadcast(offsets), "_bucket")
        .withColumn(name, (F.col("_offset") + F.col("_place")).cast("bigint"))
        .drop("_hash", "_bucket", "_place", "_offset")
    )


def with_place(df: DataFrame, within: list[str], order_by: list[Column], name: str) -> DataFrame:
    """Adds each row's place, from 0, in the order of ``order_by`` (unique) among the rows equal in ``within``.

    Rows are cut into ranges and written, numbered inside each range, and moved by the sizes of the ranges before.
    """
    ordered = df.withColumns({f"_by{i}": c for i, c in enumerate(order_by)})
    by = [f"_by{i}" for i in range(len(order_by))]
    ranged = materialise(ordered.repartitionByRange(*within, *by).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy(*within, "_range").agg(F.count(F.lit(1)).alias("_n"))  # a row per range, and one more per value of ``within``
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*within, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*within, "_range").orderBy(*by)
    numbered = ranged.withColumn("_place", F.row_number().over(inside) - 1).join(offsets, [*within, "_range"])
    return numbered.select(*df.columns, (F.col("_offset") + F.col("_place")).cast("bigint").alias(name))


def running_totals(df: DataFrame, order_by: str, sums: list[str], rows_per_bucket: int = 1_000_000, rows: int | None = None) -> DataFrame:
    """Running sums over ``order_by`` descending; adds ``upto_<column>`` for each summed column.

    ``order_by`` must be unique (group by it first). The value range is cut at approximate quantiles
    into buckets that fit a task, bucket totals become offsets, and a window sums inside each bucket.
    """
    rows = df.count() if rows is None else rows
    n_buckets = math.ceil(rows / rows_per_bucket)
    order = Window.orderBy(F.desc(order_by)).rowsBetween(Window.unboundedPreceding, 0)
    if n_buckets <= 1:
        return df.withColumns({f"upto_{c}": F.sum(c).over(order) for c in sums})
    probs = [i / n_buckets for i in range(1, n_buckets)]
    splits = sorted(set(df.approxQuantile(order_by, probs, 0.1 / n_buckets)))
    edges = [-float("inf"), *splits, float("inf")]
    bucketed = Bucketizer(splits=edges, inputCol=order_by, outputCol="_bucket").transform(df)
    totals = bucketed.groupBy("_bucket").agg(*[F.sum(c).alias(f"_sum_{c}") for c in sums])
    before = Window.orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_bucket", *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in sums])
    inside = Window.partitionBy("_bucket").orderBy(F.desc(order_by)).rowsBetween(Window.unboundedPreceding, 0)
    summed = bucketed.withColumns({f"_in_{c}": F.sum(c).over(inside) for c in sums})
    joined = summed.join(F.broadcast(offsets), "_bucket")
    return joined.select(*df.columns, *[(F.col(f"_off_{c}") + F.col(f"_in_{c}")).alias(f"upto_{c}") for c in sums])


def with_next(df: DataFrame, order_by: str, columns: list[str], rows_per_bucket: int = 1_000_000, rows: int | None = None) -> DataFrame:
    """Adds ``next_<column>``, the value in the row that follows when ``order_by`` (unique) falls; null in the last row.

    Rows are cut into buckets of the value range as in ``running_totals``; a bucket's last row gets the first
    row of the next bucket that has any, from a table with one row per bucket.
    """
    rows = df.count() if rows is None else rows
    n_buckets = math.ceil(rows / rows_per_bucket)
    if n_buckets <= 1:
        order = Window.orderBy(F.desc(order_by))
        return df.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    probs = [i / n_buckets for i in range(1, n_buckets)]
    splits = sorted(set(df.approxQuantile(order_by, probs, 0.1 / n_buckets)))
    bucketed = Bucketizer(splits=[-float("inf"), *splits, float("inf")], inputCol=order_by, outputCol="_bucket").transform(df)
    heads = bucketed.groupBy("_bucket").agg(F.max_by(F.struct(*columns), order_by).alias("_head"))
    following = heads.select("_bucket", F.lead("_head").over(Window.orderBy(F.desc("_bucket"))).alias("_head"))
    inside = Window.partitionBy("_bucket").orderBy(F.desc(order_by))
    marked = bucketed.withColumns({"_last": F.lead(F.lit(1)).over(inside).isNull(), **{f"_in_{c}": F.lead(c).over(inside) for c in columns}})
    joined = marked.join(F.broadcast(following), "_bucket")
    return joined.select(*df.columns, *[F.when(F.col("_last"), F.col(f"_head.{c}")).otherwise(F.col(f"_in_{c}")).alias(f"next_{c}") for c in columns])
