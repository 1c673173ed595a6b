"""Feature encoding fitted on training rows: impute, scale, frequency-encode, one-hot."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from transferlens.functions.columns import as_long_table, is_missing
from transferlens.functions.joins import lookup_join
from transferlens.operators.quantiles import quantiles
from transferlens.operators.ranking import with_place
from transferlens.session import materialise

# The columns of the model, by treatment.
NUMERIC = ["amount_received"]
FREQUENCY = ["account", "account_1"]
ONE_HOT = ["payment_format", "day"]

# A lookup whose values take at most this much is broadcast.
BROADCAST_BYTES = 16 << 20
ENTRY_BYTES = 48  # share, index and row overhead of a value
LOOKUP = "value string, share double, index long, bytes long, column string"


@dataclass
class FeatureEncoder:
    """Columns to encode; ``fit`` learns everything from the given rows only."""

    numeric: list[str] = field(default_factory=lambda: list(NUMERIC))
    frequency: list[str] = field(default_factory=lambda: list(FREQUENCY))
    one_hot: list[str] = field(default_factory=lambda: list(ONE_HOT))

    def fit(self, df: DataFrame) -> "FittedEncoder":
        seen = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(is_missing(df, c)).alias(c) for c in self.numeric]).first()
        rows = seen["_rows"]
        if rows == 0:
            raise ValueError("no rows to fit on")
        medians, scales = self._fit_numbers(df, [c for c in self.numeric if seen[c]])
        lookup, sizes, sent = self._fit_values(df, rows)
        return FittedEncoder(self.numeric, self.frequency, self.one_hot, medians, scales, sizes, sent, lookup)

    def _fit_numbers(self, df: DataFrame, holes: list[str]) -> tuple[dict, dict]:
        if not self.numeric:
            return {}, {}
        probs = [0.25, 0.5, 0.75]
        found = quantiles(df, self.numeric, probs)
        q = {c: v for (_, c), v in found.items()}
        medians = {c: v[1] for c, v in q.items()}
        empty = [c for c, m in medians.items() if m is None]
        if empty:
            raise ValueError(f"no present values in {empty}")
        if holes:
            # The scaler sees the imputed column, so the filled-in medians pull its quartiles in.
            filled = df.select(*[F.when(is_missing(df, c), F.lit(medians[c])).otherwise(F.col(c)).alias(c) for c in holes])
            again = quantiles(filled, holes, probs)
            q.update({c: v for (_, c), v in again.items()})
        return medians, {c: (q[c][2] - q[c][0]) or 1.0 for c in self.numeric}

    def _fit_values(self, df: DataFrame, rows: int) -> tuple[DataFrame | None, dict, dict]:
        """Share of rows and place among the sorted values, per value of each category column, in one
        pass for all of them; with the number of values and their bytes per column.

        Null is a value of its own and comes last. Nothing per value reaches the driver.
        """
        columns = [*self.frequency, *self.one_hot]
        if not columns:
            return None, {}, {}
        counts = as_long_table(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        sized = F.coalesce(F.octet_length("value"), F.lit(0)).cast("long") + F.lit(ENTRY_BYTES)
        shares = counts.select("column", "value", (F.col("n") / F.lit(rows)).alias("share"), sized.alias("bytes"))
        ordered = with_place(shares, ["column"], [F.col("value").isNull(), F.col("value")], "index")
        lookup = materialise(ordered.select("value", "share", "index", "bytes", "column"))
        found = lookup.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).collect()
        return lookup, {r["column"]: r["n"] for r in found}, {r["column"]: r["bytes"] for r in found}


@dataclass
class FittedEncoder:
    """Constants and lookup table of a fitted encoder. Works on batch tables and on streams.

    One-hot columns may have any number of values: vectors are built from a lookup of places, without
    the values being known to the driver. Names of features and a table with a column per feature list
    the values, since they stand in the result's schema.
    """

    numeric: list[str]
    frequency: list[str]
    one_hot: list[str]
    medians: dict
    scales: dict
    lookup_sizes: dict
    lookup_bytes: dict
    lookup: DataFrame | None
    _values: dict | None = field(default=None, repr=False, compare=False)

    @property
    def categories(self) -> dict:
        """Values per one-hot column in the order of their features."""
        if self._values is None:
            wanted = self.lookup.where(F.col("column").isin(self.one_hot)).select("column", "value", "index") if self.one_hot else None
            found = sorted(wanted.collect(), key=lambda r: r["index"]) if wanted is not None else []
            self._values = {c: [r["value"] for r in found if r["column"] == c] for c in self.one_hot}
        return self._values

    @property
    def feature_names(self) -> list[str]:
        names = [*self.numeric, *[f"{c}_share" for c in self.frequency]]
        return names + [n for c in self.one_hot for n in self._one_hot_names(c)]

    def _one_hot_names(self, column: str) -> list[str]:
        missing, known = "null", set(self.categories[column])
        while missing in known:  # a value may be called so
            missing += "_"
        return [f"{column}_{missing if v is None else v}" for v in self.categories[column]]

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """``keep`` columns followed by one double column per feature; other columns are dropped."""
        keep, out = self._looked_up(df, keep, self.frequency)
        flags = [F.col(f"_{c}").eqNullSafe(F.lit(v)).cast("double").alias(n) for c in self.one_hot for v, n in zip(self.categories[c], self._one_hot_names(c))]
        return out.select(*keep, *self._numbers(out), *flags)

    def transform_to_vector(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """``keep`` columns and a ``features`` vector, sparse where that is smaller."""
        keep, out = self._looked_up(df, keep, [*self.frequency, *self.one_hot])
        places = [F.coalesce(F.col(f"{c}_index"), F.lit(self.lookup_sizes[c])).cast("double").alias(f"_at{i}") for i, c in enumerate(self.one_hot)]
        numbers = [x.alias(f"_f{i}") for i, x in enumerate(self._numbers(out))]
        out = out.select(*keep, *numbers, *places)
        flags = [f"_hot{i}" for i in range(len(self.one_hot))]
        if flags:
            out = self._one_hot_model(df.sparkSession, flags).transform(out)
        inputs = [f"_f{i}" for i in range(len(numbers))] + flags
        return VectorAssembler(inputCols=inputs, outputCol="features").transform(out).select(*keep, "features")

    def _one_hot_model(self, spark: SparkSession, flags: list[str]):
        """Turns places into unit vectors, and the place after the last one into a zero vector."""
        fields = [T.StructField(f"_at{i}", T.DoubleType(), True, {"ml_attr": {"type": "nominal", "num_vals": self.lookup_sizes[c]}}) for i, c in enumerate(self.one_hot)]
        encoder = OneHotEncoder(inputCols=[f.name for f in fields], outputCols=flags, handleInvalid="keep", dropLast=True)
        return encoder.fit(spark.createDataFrame([], T.StructType(fields)))

    def _looked_up(self, df: DataFrame, keep: list[str] | None, columns: list[str]) -> tuple[list[str], DataFrame]:
        keep = [c for c in df.columns if c not in self._inputs()] if keep is None else keep
        out = df.select(*keep, *[F.col(c).alias(f"_{c}") for c in self._inputs()])
        source = out  # rows before any lookup, so that a pass over one column repeats no join
        for c in columns:
            out = self._with_lookup(out, c, source)
        return keep, out

    def _numbers(self, df: DataFrame) -> list[Column]:
        scaled = [self._scaled(df, c).alias(c) for c in self.numeric]
        return scaled + [F.coalesce(f"{c}_share", F.lit(0.0)).alias(f"{c}_share") for c in self.frequency]

    def _inputs(self) -> list[str]:
        return [*self.numeric, *self.frequency, *self.one_hot]

    def _scaled(self, df: DataFrame, column: str) -> Column:
        filled = F.when(is_missing(df, f"_{column}"), F.lit(self.medians[column])).otherwise(F.col(f"_{column}"))
        return (filled - F.lit(self.medians[column])) / F.lit(self.scales[column])

    def _with_lookup(self, df: DataFrame, column: str, source: DataFrame) -> DataFrame:
        """Adds the value's training share and place, null for values not seen."""
        share, key = f"{column}_share", f"_{column}"
        lookup = self.lookup.where(F.col("column") == column).select(F.col("value").alias(key), F.col("share").alias(share), F.col("index").alias(f"{column}_index"))
        text = df.withColumn(key, F.col(key).cast("string"))
        small = self.lookup_bytes.get(column, 0) <= BROADCAST_BYTES
        return lookup_join(text, lookup, key, share, small, spread=[c for c in df.columns if c != key], source=source.select(F.col(key).cast("string")))

    def save(self, path: str) -> None:
        """Constants as one JSON line, the lookup as Parquet."""
        path = path.rstrip("/")
        constants = {k: getattr(self, k) for k in ("numeric", "frequency", "one_hot", "medians", "scales", "lookup_sizes", "lookup_bytes")}
        spark = SparkSession.active()
        spark.createDataFrame([(json.dumps(constants),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/constants")
        if self.lookup is not None:
            self.lookup.write.mode("overwrite").partitionBy("column").parquet(f"{path}/lookup")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "FittedEncoder":
        path = path.rstrip("/")
        constants = json.loads(spark.read.text(f"{path}/constants").first()[0])
        lookup = None
        if constants["lookup_sizes"]:
            lookup = spark.read.schema(LOOKUP).parquet(f"{path}/lookup")
        return FittedEncoder(**constants, lookup=lookup)


def features_to_columns(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """A ``features`` vector back to named columns."""
    array = vector_to_array("features")
    return df.select(*keep, *[array[i].alias(f) for i, f in enumerate(features)])
