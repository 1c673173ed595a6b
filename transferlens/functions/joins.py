"""Lookup join that holds up when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Keys with at least this share of the rows are hot; there can be no more than 1/HOT_SHARE of them.
HOT_SHARE = 1e-4
SALTS = 1024
# Keys of the other side with at least this share of its rows are looked for among the unknown ones.
UNKNOWN_SHARE = 1e-3


def lookup_join(
    df: DataFrame, lookup: DataFrame, key: str, share: str, small: bool, spread: list[str | Column], covers: bool = False, source: DataFrame | None = None
) -> DataFrame:
    """Left join of ``df[key]`` with ``lookup[key]``, nulls matching nulls.

    ``share`` (a lookup column, never null) is the part of the rows that carry the key. A small
    lookup is broadcast. Of a large one only the hot keys are broadcast, whose number is bounded
    whatever the table size; rows they match get a salted null key in the second, shuffled join and
    so spread evenly over its tasks. So do rows whose key is frequent in ``df`` but absent from the
    lookup; these keys (at most 1/UNKNOWN_SHARE) come from a pass over ``df``, which streams go without
    and a lookup that ``covers`` all keys does not need. The pass reads ``source`` instead where that has the same keys
    at less cost.
    """
    payload = [c for c in lookup.columns if c != key]
    near = lookup if small else lookup.where((F.col(share) >= HOT_SHARE) | F.col(key).isNull())
    near = near.withColumnRenamed(key, "_near_key")
    out = df.join(F.broadcast(near), df[key].eqNullSafe(F.col("_near_key")), "left").drop("_near_key")
    if small:
        return out
    done = F.col(share).isNotNull() | F.col(key).isNull()
    if unknown := [] if covers or df.isStreaming else _frequent_unknown(df if source is None else source, lookup, key):
        done = done | F.col(key).isin(unknown)
    salt = (F.pmod(F.xxhash64(*spread), F.lit(SALTS)) + 1).cast("int")
    out = out.withColumns({"_key": F.when(~done, F.col(key)), "_salt": F.when(done, salt).otherwise(F.lit(0))})
    cold = lookup.where((F.col(share) < HOT_SHARE) & F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), F.lit(0).alias("_salt"), *[F.col(c).alias(f"_cold_{c}") for c in payload]
    )
    out = out.join(cold, ["_key", "_salt"], "left")
    return out.select(*df.columns, *[F.coalesce(F.col(c), F.col(f"_cold_{c}")).alias(c) for c in payload])


def _frequent_unknown(df: DataFrame, lookup: DataFrame, key: str) -> list:
    """Keys with at least UNKNOWN_SHARE of the rows of ``df`` that ``lookup`` does not have."""
    present = df.select(F.col(key).alias("_key")).where("_key IS NOT NULL")
    frequent = present.stat.freqItems(["_key"], UNKNOWN_SHARE).select(F.explode("_key_freqItems").alias("_key"))
    known = lookup.select(F.col(key).alias("_key"))
    return [r["_key"] for r in frequent.join(known, "_key", "left_anti").collect()]
