"""Profile of a transfer table: every report is one or two aggregate passes over all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from transferlens.functions.columns import as_long_table, categorical_columns, is_missing, numeric_columns
from transferlens.operators.quantiles import ALL, long_values, quantile_table, quantiles
from transferlens.schema import LABEL
from transferlens.session import materialise


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("bigint"))


def first_rows(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows that repeat an earlier row. Hashes of the rows are counted first, and only rows whose hash occurs
    again are compared by their columns. Copies are counted before the shuffle, so many copies of one row do
    not overload a task."""
    columns = columns or df.columns
    hashed = df.select(F.xxhash64(*columns).alias("_hash"), *columns)
    again = hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_hash")
    groups = hashed.join(materialise(again), "_hash", "left_semi").groupBy("_hash", *columns).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("n_duplicates"))


def _one_row_per_column(df: DataFrame, aggregates: dict, value_name: str) -> DataFrame:
    wide = df.agg(*[expr.alias(c) for c, expr in aggregates.items()])
    return wide.unpivot([], list(aggregates), "column", value_name)


def missing_counts(df: DataFrame) -> DataFrame:
    return _one_row_per_column(df, {c: F.count_if(is_missing(df, c)) for c in df.columns}, "n_missing")


def table_info(df: DataFrame) -> DataFrame:
    """Type and number of present values of each column."""
    present = _one_row_per_column(df, {c: F.count_if(~is_missing(df, c)) for c in df.columns}, "n_present")
    names = F.create_map(*[F.lit(x) for c, t in df.dtypes for x in (c, t)])
    return present.withColumn("data_type", names[F.col("column")])


def distinct_counts(df: DataFrame, columns: list[str] | None = None, approximate: bool = False, rsd: float = 0.01) -> DataFrame:
    """Distinct values of each column, nulls and NaN left out. ``approximate`` uses mergeable sketches.

    Each column is read and aggregated by itself: over a columnar table that reads no byte twice,
    while several distinct counts in one aggregate would copy every wide row once per column.
    """
    columns = columns or df.columns
    if approximate:
        return _one_row_per_column(df, {c: F.approx_count_distinct(F.when(~is_missing(df, c), F.col(c)), rsd) for c in columns}, "n_distinct")
    counts = [
        df.where(~is_missing(df, c)).select(c).distinct().agg(F.count(F.lit(1)).alias("n_distinct")).select(F.lit(c).alias("column"), "n_distinct")
        for c in columns
    ]
    return reduce(DataFrame.union, counts)


def describe_numbers(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, mean, std (n-1), min, quartiles and max; one row per numeric column."""
    columns = columns or numeric_columns(df)
    q = quantiles(df, columns, [0.25, 0.5, 0.75])
    clean = df.select(*[F.when(~is_missing(df, c), F.col(c).cast("double")).alias(c) for c in columns])
    stats = clean.agg(
        *[
            F.struct(
                F.count(c).alias("count"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).alias("min"),
                *[F.lit(v).cast("double").alias(n) for n, v in zip(("q25", "median", "q75"), q.get((ALL, c), [None] * 3))],
                F.max(c).alias("max"),
            ).alias(c)
            for c in columns
        ]
    )
    return stats.unpivot([], columns, "column", "s").select("column", "s.*")


def value_counts(df: DataFrame, columns: list[str] | None = None, keep_null: bool = True) -> DataFrame:
    """(column, value, count) of every categorical column in one pass."""
    long = as_long_table(df, columns or categorical_columns(df))
    if not keep_null:
        long = long.where(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def describe_categories(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, unique, most frequent value and its frequency; ties go to the smallest value."""
    counts = value_counts(df, columns, keep_null=False)
    top = F.min(F.struct((-F.col("count")).alias("minus"), F.col("value")))
    return (
        counts.groupBy("column")
        .agg(F.sum("count").alias("count"), F.count(F.lit(1)).alias("unique"), top.alias("t"))
        .select("column", "count", "unique", F.col("t.value").alias("top"), (-F.col("t.minus")).alias("freq"))
    )


def value_counts_by_label(df: DataFrame, columns: list[str], label: str = LABEL) -> DataFrame:
    """Count of each value among suspicious and clean transfers, one pass for all columns."""
    return (
        as_long_table(df, columns, [label])
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count_if(F.col(label) == 1).alias("n_suspicious"), F.count_if(F.col(label) == 0).alias("n_clean"))
    )


def top_values(df: DataFrame, column: str, label: str | None = None, label_value: int | None = None, n: int = 5) -> DataFrame:
    """The ``n`` most frequent values, within a class if given, and their share among those ``n``."""
    rows = df if label is None else df.where(F.col(label) == label_value)
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    top = counts.orderBy(F.desc("count"), column).limit(n)
    # The window sees the n rows of the top list only.
    return top.withColumn("percent", F.round(100.0 * F.col("count") / F.sum("count").over(Window.partitionBy()), 1))


def class_counts(df: DataFrame, label: str = LABEL) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))


def contingency(df: DataFrame, columns: list[str], label: str = LABEL) -> DataFrame:
    """Cells (column, value, label, count); rows with a null are dropped."""
    return (
        as_long_table(df, columns, [label])
        .where(F.col("value").isNotNull() & F.col(label).isNotNull())
        .groupBy("column", "value", label)
        .agg(F.count(F.lit(1)).alias("count"))
    )


def box_numbers(df: DataFrame, columns: list[str], label: str | None = LABEL) -> DataFrame:
    """Quartiles, whisker ends within 1.5 IQR and number of outliers, overall and per class; only groups with values have a row."""
    long = long_values(df, columns, label)
    q = quantile_table(long, [0.25, 0.5, 0.75]).where("value IS NOT NULL").groupBy("group", "column").pivot("prob", [0.25, 0.5, 0.75]).agg(F.first("value"))
    q = materialise(q.toDF("group", "column", "q1", "median", "q3"))
    low, high = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    x = F.col("x")
    return (
        long.where("x IS NOT NULL")
        .join(q, ["group", "column"])
        .groupBy("group", "column", "q1", "median", "q3")
        .agg(
            F.least(F.min(F.when(x >= low, x)), F.col("q1")).alias("whisker_low"),
            F.greatest(F.max(F.when(x <= high, x)), F.col("q3")).alias("whisker_high"),
            F.count_if((x < low) | (x > high)).alias("n_outliers"),
        )
    )


def histogram(df: DataFrame, column: str, label: str | None = LABEL, bins: int = 20) -> DataFrame:
    """Counts in equal-width bins, per class; the last bin includes the maximum."""
    present = df.where(~is_missing(df, column))
    low, high = present.agg(F.min(column), F.max(column)).first()
    keys = ["bin"] + ([label] if label else [])
    if low is None or high == low:
        bin_no, width = F.lit(0), 0.0
    else:
        width = (high - low) / bins
        bin_no = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
    counts = present.withColumn("bin", bin_no.cast("bigint")).groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("bin_start", F.lit(low) + F.col("bin") * F.lit(width))


def density(df: DataFrame, column: str, points: int = 200, cut: float = 3.0, bins_per_bandwidth: int | None = None) -> DataFrame:
    """Gaussian kernel density with Scott's bandwidth on an even grid that reaches ``cut`` bandwidths
    past the data.

    Equal values are counted first and every value adds to every grid point; those over 39 bandwidths
    away are skipped, where the kernel is zero in double precision. With ``bins_per_bandwidth`` values
    are counted in bins of that width around their mean instead, which changes a density by less than
    1/(24·bins²) of its curvature term.
    """
    present = df.where(~is_missing(df, column)).select(F.col(column).cast("double").alias("x"))
    n, sigma, low, high = present.agg(F.count("x"), F.stddev_samp("x"), F.min("x"), F.max("x")).first()
    if n < 2 or not sigma:
        raise ValueError(f"{column} needs at least two different values")
    h = sigma * n ** (-1 / 5)
    start = low - cut * h
    step = (high + cut * h - start) / (points - 1)
    if bins_per_bandwidth is None:
        weights = present.groupBy("x").agg(F.count(F.lit(1)).alias("w"))
    else:
        b = F.floor((F.col("x") - F.lit(low)) * F.lit(bins_per_bandwidth / h))
        weights = present.groupBy(b.alias("b")).agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("w"))
    reach = 39 * h
    first = F.greatest(F.ceil((F.col("x") - F.lit(reach + start)) / F.lit(step)), F.lit(0))
    last = F.least(F.floor((F.col("x") + F.lit(reach - start)) / F.lit(step)), F.lit(points - 1))
    near = weights.where(first <= last).select("x", "w", F.explode(F.sequence(first, last)).alias("point"))
    z = (F.lit(start) + F.col("point") * F.lit(step) - F.col("x")) / F.lit(h)
    scale = 1.0 / (n * h * (2 * 3.141592653589793) ** 0.5)
    sums = near.groupBy("point").agg((F.sum(F.col("w") * F.exp(-0.5 * z * z)) * F.lit(scale)).alias("density"))
    grid = df.sparkSession.range(points).withColumnRenamed("id", "point")
    return grid.join(sums, "point", "left").select(
        "point", (F.lit(start) + F.col("point") * F.lit(step)).alias("x"), F.coalesce("density", F.lit(0.0)).alias("density")
    )


def single_class(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Whether only one label value occurs, in which case curves have no meaning."""
    return df.agg(F.count_distinct(F.col(label)).alias("n_classes")).withColumn("single_class", F.col("n_classes") <= 1)


def mean_and_spread(scores: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Mean and population deviation of fold scores."""
    stats = [s for m in metrics for s in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))]
    return scores.groupBy(*by).agg(*stats)
