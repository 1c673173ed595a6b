"""Column-level helpers: names, types, dates, keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from transferlens.schema import KEY, RAW_TIME_FORMAT


def canonical_names(df: DataFrame) -> DataFrame:
    """Lower-case names with spaces and dots as underscores; refuses names that collide."""
    names = [c.lower().replace(" ", "_").replace(".", "_") for c in df.columns]
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"columns collide after renaming: {repeated}")
    return df.toDF(*names)


def parse_time(column: str | Column, fmt: str = RAW_TIME_FORMAT, strict: bool = True) -> Column:
    """Timestamp from text; ``strict=False`` gives null for text that does not parse."""
    column = F.col(column) if isinstance(column, str) else column
    return F.to_timestamp(column, fmt) if strict else F.try_to_timestamp(column, F.lit(fmt))


def with_calendar(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """Adds ``date``, English weekday name ``day`` and clock ``time``."""
    ts = F.col(column).cast("timestamp")
    return df.withColumns(
        {
            "date": F.to_date(ts),
            "day": F.date_format(ts, "EEEE"),
            "time": F.date_format(ts, "HH:mm:ss"),
        }
    )


def banks_as_text(df: DataFrame) -> DataFrame:
    """Bank codes are names, not numbers."""
    return df.withColumns({c: F.col(c).cast("string") for c in ("from_bank", "to_bank") if c in df.columns})


def enrich(df: DataFrame) -> DataFrame:
    """Bank codes as text plus the calendar columns."""
    return with_calendar(banks_as_text(df))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    """Text columns; dates count as categories too."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.DateType))]


def as_long_table(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """One row per (column, value), values as text: a single pass instead of one scan per column."""
    values = df.select(*(keep or []), *[F.col(c).cast("string").alias(c) for c in columns])
    return values.unpivot(list(keep or []), columns, "column", "value")


def is_missing(df: DataFrame, column: str) -> Column:
    missing = F.col(column).isNull()
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        missing = missing | F.isnan(column)
    return missing


def hash_key(column: str | Column, seed: int | str) -> Column:
    """Uniform 32-digit hex key; its text order is a random order fixed by the seed."""
    column = F.col(column) if isinstance(column, str) else column
    return F.md5(F.concat(column, F.lit(f"|{seed}")))


def with_content_key(df: DataFrame, columns: list[str] | None = None, name: str = KEY) -> DataFrame:
    """Row key from the row's content, the same on any cluster layout.

    Nulls are told apart from empty text. Equal rows share a key: the rank operators split such
    copies exactly.
    """
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(f"`{c}`").cast("string")), F.lit("n")) for c in columns or df.columns]
    return df.withColumn(name, F.md5(F.concat_ws("\u0001", *parts)))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
