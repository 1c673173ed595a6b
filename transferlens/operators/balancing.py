"""Synthetic minority oversampling with exact nearest neighbours."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from transferlens.functions.joins import lookup_join
from transferlens.operators.ranking import with_dense_index
from transferlens.operators.sampling import class_sizes
from transferlens.schema import KEY
from transferlens.session import cores, materialise

# Points compared with each other inside one task, and the most blocks there can be.
BLOCK_ROWS = 2048
MAX_BLOCKS = 20_000
# Requests answered by one task in the second round.
CHUNK_ROWS = 4096
# Neighbour lists up to this many minority rows are broadcast to the generated rows.
BROADCAST_ROWS = 50_000

_NEAR = "point long, near array<long>, dist array<double>"


def _nearest(query_ids: np.ndarray, query: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, step: int = 256) -> pd.DataFrame:
    """The k points nearest to each query: ids and squared distances, ties by id."""
    by_id = np.argsort(ids)
    ids, x = ids[by_id], x[by_id]
    # An axis on which all points and queries have one value adds nothing to any distance.
    same = np.isfinite(x[:1]) & (x == x[:1]).all(axis=0) & (query == x[:1]).all(axis=0) if len(x) else np.zeros((1, x.shape[1]), bool)
    differing = np.flatnonzero(~same[0])
    near, dist = [], []
    for i in range(0, len(query), step):
        d = np.zeros((len(query[i : i + step]), len(x)))
        for axis in differing:
            d += (query[i : i + step, axis, None] - x[None, :, axis]) ** 2
        if k >= len(x) or np.isnan(d).any():
            first = np.argsort(d, axis=1, kind="stable")
            near.extend(ids[first])
            dist.extend(np.take_along_axis(d, first, axis=1))
            continue
        # Points up to the kth distance, which are more than k where it occurs again.
        row, place = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k])
        found = d[row, place]
        order = np.lexsort((place, found, row))
        begin = np.searchsorted(row, np.arange(len(d)))
        first = order[begin[:, None] + np.arange(k)]
        near.extend(ids[place[first]])
        dist.extend(found[first])
    return pd.DataFrame({"point": query_ids, "near": near, "dist": dist})


def nearest_points(points: DataFrame, n_points: int, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact k nearest points of every point, the point itself included, ties by id.

    ``points`` has ``point`` (long, unique) and ``x`` (array of double), no two of them equal. Points
    sorted by their coordinates are cut into blocks; each point is compared with its own block first.
    The distance to the last neighbour found there is a radius, and only blocks whose bounding box
    lies within it can hold a nearer one, so the point is sent to just those. Nothing is
    approximated, and no pairs leave a task.
    """
    block_rows = max(block_rows, math.ceil(n_points / MAX_BLOCKS))
    n_blocks = max(1, math.ceil(n_points / block_rows))

    def own_block(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, x = pdf["point"].to_numpy(), np.vstack(pdf["x"])
        return _nearest(ids, x, ids, x, k)

    if n_blocks == 1:
        return points.groupBy(F.lit(0).alias("block")).applyInPandas(own_block, _NEAR)

    width = points.select(F.size("x")).first()[0]
    axes = [F.col("x")[i] for i in range(width)]
    spread = points.agg(*[F.stddev_pop(a) for a in axes]).first()
    widest = sorted(range(width), key=lambda i: -(spread[i] or 0.0))
    ranged = points.repartitionByRange(n_blocks, *[axes[i] for i in widest])
    placed = materialise(ranged.withColumn("block", F.spark_partition_id().cast("long")))
    own = materialise(placed.groupBy("block").applyInPandas(own_block, _NEAR))

    # Bounding boxes: at most MAX_BLOCKS rows.
    boxes = placed.groupBy("block").agg(F.array(*[F.min(a) for a in axes]).alias("low"), F.array(*[F.max(a) for a in axes]).alias("high"))
    rows = boxes.collect()
    box = placed.sparkSession.sparkContext.broadcast(tuple(np.array([r[c] for r in rows]) for c in ("block", "low", "high")))

    def blocks_in_reach(batches):
        block, low, high = box.value
        for pdf in batches:
            targets = []
            for x, home, radius in zip(pdf["x"], pdf["block"], pdf["radius"]):
                gap = np.maximum(np.maximum(low - x, x - high), 0.0)
                targets.append(block[((gap**2).sum(axis=1) <= radius * (1 + 1e-9)) & (block != home)])
            yield pd.DataFrame({"point": pdf["point"], "x": pdf["x"], "targets": targets})

    radius = F.when(F.size("dist") >= k, F.col("dist")[k - 1]).otherwise(F.lit(float("inf")))
    searching = placed.join(own.select("point", radius.alias("radius")), "point")
    visits = searching.mapInPandas(blocks_in_reach, "point long, x array<double>, targets array<long>")
    asked = materialise(visits.select("point", "x", F.explode("targets").alias("target")))
    # A block that many points ask for is copied, so that a task answers about CHUNK_ROWS of them.
    loads = asked.groupBy("target").agg(F.ceil(F.count(F.lit(1)) / F.lit(CHUNK_ROWS)).alias("chunks"))
    queries = asked.join(F.broadcast(loads), "target").withColumn("chunk", F.pmod(F.xxhash64("point"), F.col("chunks")))
    copies = loads.select(F.col("target").alias("block"), F.col("chunks").alias("n_copies"))
    held = placed.join(F.broadcast(copies), "block").select(
        "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_copies") - 1)).alias("copy"), F.col("point").alias("held"), F.col("x").alias("held_x")
    )

    def answer(query: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if query.empty or block.empty:
            return pd.DataFrame({"point": [], "near": [], "dist": []})
        return _nearest(query["point"].to_numpy(), np.vstack(query["x"]), block["held"].to_numpy(), np.vstack(block["held_x"]), k)

    other = queries.groupBy("target", "chunk").cogroup(held.groupBy("block", "copy")).applyInPandas(answer, _NEAR)
    found = own.unionByName(other).select("point", F.arrays_zip("dist", "near").alias("c"))
    # One list of k per block a point visited.
    merged = found.groupBy("point").agg(F.slice(F.sort_array(F.flatten(F.collect_list("c"))), 1, k).alias("c"))
    return merged.select("point", F.col("c.near").alias("near"), F.col("c.dist").alias("dist"))


def with_neighbours(minority: DataFrame, rows: int, k: int = 5, block_rows: int = BLOCK_ROWS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Adds ``neighbours``, the k nearest other rows by (squared distance, index), nearest first.

    ``minority`` has a dense ``index`` and ``x``. Equal rows are searched once: of each distinct
    point only the k+1 lowest indexes can ever be neighbours, and picking those is cut down before
    the shuffle, so a point with very many copies stays small.
    """
    copies = Window.partitionBy("x").orderBy("index")
    lowest = minority.select("x", "index").withColumn("_n", F.row_number().over(copies)).where(F.col("_n") <= k + 1)
    members = lowest.groupBy("x").agg(F.sort_array(F.collect_list("index")).alias("members"))
    shares = minority.groupBy("x").agg((F.count(F.lit(1)) / F.lit(rows)).alias("share"))
    points = materialise(members.join(shares, "x").select(F.col("members")[0].alias("point"), "x", "members", "share"))
    n_points = points.count()

    near = nearest_points(points.select("point", "x"), n_points, k + 1, block_rows)
    each = near.select("point", F.explode(F.arrays_zip("near", "dist")).alias("n")).select("point", F.col("n.near").alias("other"), "n.dist")
    others = points.select(F.col("point").alias("other"), F.col("x").alias("other_x"), "members")
    listed = each.join(others, "other").groupBy("point").agg(F.collect_list(F.struct("dist", "members", "other_x")).alias("found"))
    rows_of = F.transform("found", lambda f: F.transform(f["members"], lambda m: F.struct(f["dist"].alias("dist"), m.alias("index"), f["other_x"].alias("x"))))
    nearest_rows = F.slice(F.sort_array(F.flatten(rows_of)), 1, k + 1).alias("candidates")
    lists = listed.select("point", nearest_rows).join(points.select("point", "x", "share"), "point").drop("point")

    joined = lookup_join(minority, lists, "x", "share", small=n_points <= broadcast_rows, spread=["index"], covers=True)
    others_only = F.filter("candidates", lambda c: c["index"] != F.col("index"))
    return joined.select(*minority.columns, F.slice(others_only, 1, k).alias("neighbours"))


def _draw(digest: Column, start: int, digits: int) -> Column:
    """Number in [0, 1) from hex digits of an md5."""
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("bigint") / F.lit(float(16**digits))


def oversample(
    df: DataFrame, label: str = "label", key: str = KEY, k: int = 5, seed: int = 42, block_rows: int = BLOCK_ROWS, broadcast_rows: int = BROADCAST_ROWS,
    sizes: dict | None = None,
) -> DataFrame:
    """Raises the rarer class to the size of the other: (key, features, label), originals untouched.

    A synthetic row is x + u·(nn - x): x a minority row drawn with replacement, nn one of its k
    nearest minority rows, u in [0, 1). All draws come from ``md5(seed|number)``, so rows can be made
    anywhere and again after a failure. ``sizes`` are the rows of each class, where they are known. Keys of synthetic rows start with 's', after every hex key.
    """
    spark = df.sparkSession
    sizes = class_sizes(df, label) if sizes is None else sizes
    if len(sizes) != 2:
        raise ValueError(f"two classes are needed, found {sorted(sizes)}")
    rare = min(sizes, key=lambda v: (sizes[v], -v))
    rows, n_new = sizes[rare], max(sizes.values()) - sizes[rare]
    if rows <= k:
        raise ValueError(f"{k} neighbours need more than {k} minority rows, found {rows}")
    original = df.select(key, "features", label)
    if n_new == 0:
        return original
    minority = df.where(F.col(label) == rare).select(key, vector_to_array("features").alias("x"))
    minority = materialise(with_dense_index(minority, key, rows).select("index", "x"))
    seeds = materialise(with_neighbours(minority, rows, k, block_rows, broadcast_rows))
    if rows <= broadcast_rows:
        seeds = F.broadcast(seeds)
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col("id").cast("string")))
    draws = spark.range(0, n_new, 1, max(cores(spark), math.ceil(n_new / 1_000_000))).select(
        F.concat(F.lit("s"), digest).alias(key),
        F.floor(_draw(digest, 1, 12) * F.lit(rows)).alias("index"),
        F.floor(_draw(digest, 13, 6) * F.lit(k)).cast("int").alias("choice"),
        _draw(digest, 19, 8).alias("u"),
    )
    made = draws.join(seeds, "index").withColumn("nn", F.col("neighbours")[F.col("choice")]["x"])
    x = F.zip_with("x", "nn", lambda a, b: F.struct(a.alias("a"), (b - a).alias("d")))
    synthetic = made.select(
        key,
        array_to_vector(F.transform(x, lambda p: p["a"] + F.col("u") * p["d"])).alias("features"),
        F.lit(rare).cast(df.schema[label].dataType).alias(label),
    )
    return original.unionByName(synthetic)
