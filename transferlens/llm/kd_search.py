"""Exact top-k by inner product over KD-trees, one per shard."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transferlens.session import materialise

_TREE = "shard int, dim int, ids binary, points binary, low binary, high binary, first binary, count binary, child binary"


def build_tree(points: np.ndarray, leaf: int) -> tuple[np.ndarray, ...]:
    """Median splits on the widest side; (order, low, high, first, count, child) with tight boxes.

    Node i holds order[first:first + count]; its children are child[i] and child[i] + 1, or none (-1).
    """
    order = np.arange(len(points))
    low, high, first, count, child = [], [], [], [], []

    def node(a: int, b: int) -> None:
        part = points[order[a:b]]
        low.append(part.min(axis=0))
        high.append(part.max(axis=0))
        first.append(a)
        count.append(b - a)
        child.append(-1)

    node(0, len(points))
    i = 0
    while i < len(first):
        a, n = first[i], count[i]
        wide = high[i] - low[i]
        if n > leaf and len(wide) and wide.max() > 0:
            axis, mid = int(wide.argmax()), n // 2
            order[a : a + n] = order[a : a + n][np.argpartition(points[order[a : a + n], axis], mid)]
            child[i] = len(first)
            node(a, a + mid)
            node(a + mid, a + n)
        i += 1
    return order, np.array(low), np.array(high), np.array(first), np.array(count), np.array(child)


def search_tree(tree: dict, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
    """Per query its best (score, -id) of this tree, greatest first, leaving out its own id.

    Best-first: the node with the greatest box bound is opened next, and the search ends when that
    bound is under the kth score known here or, from other shards, in ``floor``.
    """
    bounds = np.maximum(queries, 0) @ tree["high"].T + np.minimum(queries, 0) @ tree["low"].T  # all box-to-query bounds
    first, count, child, points, ids = (tree[x] for x in ("first", "count", "child", "points", "ids"))
    out = []
    for q, me, least, bound in zip(queries, own, floor, bounds):
        best: list[tuple[float, int]] = []
        todo = [(-bound[0], 0)]
        while todo:
            far, i = heapq.heappop(todo)
            if -far < least:
                break
            if child[i] >= 0:
                for c in (child[i], child[i] + 1):
                    if bound[c] >= least:
                        heapq.heappush(todo, (-bound[c], int(c)))
                continue
            part = slice(first[i], first[i] + count[i])
            scores = points[part] @ q
            for s, v in zip(scores[scores >= least].tolist(), ids[part][scores >= least].tolist()):
                if v != me:
                    best.append((s, -v))
            if len(best) >= k:
                best = heapq.nlargest(k, best)
                least = max(least, best[-1][0])
        out.append(heapq.nlargest(k, best))
    return out


def _tree(row) -> dict:
    d = int(row["dim"])
    box = {x: np.frombuffer(row[x], np.float64).reshape(-1, d) for x in ("points", "low", "high")}
    return box | {x: np.frombuffer(row[x], np.int64) for x in ("ids", "first", "count", "child")}


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id: str = "vec_id", vector: str = "embedding", scale: float = 256.0, shard_size: int = 8192, leaf: int = 48, block: int = 1024) -> DataFrame:
    """(query_id, rank, id, score): each query's k greatest inner products with other rows, ties to smaller ids.

    Components become floor(scale * x). Rows with a null id, or a vector that is null or holds null or
    non-finite components, take no part on either side; vectors meet those of their own length only.
    Queries are rows with the columns of ``vectors``. Rows of one id that are repeated are each returned
    to other ids, and none of them to a query of that id; of repeated queries the least vector asks.

    Shards of about ``shard_size`` rows each build a tree. Queries go in blocks: first to one shard
    each, and the kth score found there travels with the query to the other shards, where it prunes
    from the start. Only k rows per query and shard come back.
    """
    spark = vectors.sparkSession
    sound = F.col(vector).isNotNull() & F.col(id).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))

    def whole(df: DataFrame) -> DataFrame:
        x = F.transform(vector, lambda v: F.floor(v.cast("double") * F.lit(scale)).cast("double"))
        return df.where(sound).select(F.col(id).cast("long").alias("id"), F.size(vector).alias("dim"), x.alias("x"))

    rows = whole(vectors)
    n = rows.count()
    parts = max(1, ceil(n / shard_size))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(parts)).cast("int"))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        d = int(group["dim"].iloc[0])
        points = np.array(group["x"].tolist(), np.float64).reshape(len(group), d)
        order, low, high, first, count, child = build_tree(points, leaf)
        ids = group["id"].to_numpy(np.int64)[order]
        blobs = [ids, points[order], low.astype(np.float64), high.astype(np.float64), first, count, child]
        return pd.DataFrame([[group["shard"].iloc[0], d, *[b.tobytes() for b in blobs]]], columns=[c.split()[0] for c in _TREE.split(", ")])

    trees = materialise(dealt.groupBy("shard", "dim").applyInPandas(build, _TREE))
    homes = trees.groupBy("dim").agg(F.sort_array(F.collect_set("shard")).alias("shards"))  # at most one number a shard
    asked = whole(queries).groupBy("id", "dim").agg(F.min("x").alias("x")).withColumn("floor", F.lit(float("-inf")))
    blocks = max(1, ceil(asked.count() / block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(blocks)).cast("int")).join(homes, "dim")
    asked = materialise(asked.withColumn("home", F.get("shards", F.pmod("block", F.size("shards")).cast("int"))))
    kinds = "query_id long, dim int, vec_id long, score double"

    def ask(_, them: pd.DataFrame, tree_rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(them) and len(tree_rows):
            tree = _tree(tree_rows.iloc[0])
            d = int(tree_rows["dim"].iloc[0])
            q = np.array(them["x"].tolist(), np.float64).reshape(len(them), d)
            found = search_tree(tree, q, them["id"].to_numpy(), them["floor"].to_numpy(), k)
            out = [(i, d, -v, s) for i, best in zip(them["id"], found) for s, v in best]
        return pd.DataFrame(out, columns=["query_id", "dim", "vec_id", "score"])

    def wave(them: DataFrame) -> DataFrame:
        keys = them.select(F.col("shard").alias("s"), F.col("dim").alias("d"), F.col("block").alias("b")).distinct()
        sent = keys.join(trees, (keys["s"] == trees["shard"]) & (keys["d"] == trees["dim"]))
        return them.groupBy("shard", "dim", "block").cogroup(sent.groupBy("s", "d", "b")).applyInPandas(ask, kinds)

    near = materialise(wave(asked.select("id", "dim", "x", "floor", "block", F.col("home").alias("shard"))))
    order = Window.partitionBy("query_id", "dim").orderBy(F.desc("score"), "vec_id")
    kth = near.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select(F.col("query_id").alias("id"), "dim", F.col("score").alias("kth"))
    rest = asked.join(kth, ["id", "dim"], "left").withColumn("floor", F.coalesce("kth", "floor"))
    rest = rest.withColumn("shard", F.explode(F.array_except("shards", F.array("home"))))
    more = wave(rest.select("id", "dim", "x", "floor", "block", "shard"))
    best = near.union(more).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))
