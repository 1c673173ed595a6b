"""What the text operators share: registry, fold rule, tables kept by bucket, linking of pairs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transferlens.session import materialise

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query of this package, with its SQL if there is one."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def shards(spark: SparkSession, least: int = 8) -> int:
    """Number of parts for keyed work: the session's shuffle partitions, which is how a user sizes a job."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


@contextmanager
def bucketed(df: DataFrame, key: str, buckets: int) -> Iterator[DataFrame]:
    """``df`` as a table laid out by ``key``, so that several later groupings by it shuffle nothing.

    Tasks write their rows straight into the bucket files; the table goes when the block ends, so
    results have to be materialised inside it.
    """
    spark, name = df.sparkSession, f"llm_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").bucketBy(buckets, key).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def linked(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the pairs (a, b): root is the smallest node reachable.

    Alternates the large-star and small-star steps: each node's greater (then smaller) neighbours are
    hung on the least node it sees. A hub's neighbours stay separate rows throughout, minima are
    aggregated before the shuffle, and lineage is cut by written tables. Rounds grow with the
    logarithm of the longest path. Null ends and loops are ignored.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u > v")
    pairs = materialise(pairs.distinct())

    def state(p: DataFrame) -> tuple:
        return p.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = state(pairs)
    while True:
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where("u > v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        pairs = materialise(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = state(pairs)
        if now == before:
            break
        before = now
    roots = pairs.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def cuts(df: DataFrame, column: str, parts: int) -> list:
    """At most parts - 1 rising values that cut ``column`` into parts of about equal row counts."""
    if parts < 2:
        return []
    found = df.agg(F.percentile_approx(column, [i / parts for i in range(1, parts)], 100 * parts)).first()[0]
    return sorted(set(found or []))


def part_of(column: Column, bounds: list) -> Column:
    """How many of the rising bounds are at most the value; null goes to part 0.

    Looks first among every k-th bound, then among k, so a row costs about 2 * sqrt(bounds) steps.
    """
    if not bounds:
        return F.lit(0)
    k = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + k] for i in range(0, len(bounds), k)]
    upper = F.size(F.filter(F.lit([g[0] for g in groups]), lambda b: b <= column))
    inner = F.size(F.filter(F.get(F.array(*[F.lit(g) for g in groups]), upper - 1), lambda b: b <= column))
    return F.when(upper > 0, (upper - 1) * k + inner).otherwise(0)
