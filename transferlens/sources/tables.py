"""Readers and writers: CSV, Parquet, JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from transferlens.functions.columns import with_content_key
from transferlens.schema import RAW_TIME_FORMAT, TRANSFERS
from transferlens.session import materialise

CSV_OUT_TIME = "yyyy-MM-dd HH:mm:ss"


def read_transfers_csv(spark: SparkSession, path: str, schema: T.StructType = TRANSFERS, time_format: str = RAW_TIME_FORMAT) -> DataFrame:
    """Raw transfer CSV. Columns go by position, so the repeated ``Account`` header does no harm.

    A missing path fails here, and so does a value that does not fit its type.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("mode", "FAILFAST")
        .option("timestampFormat", time_format)
        .csv(path)
    )


def ingest_csv(spark: SparkSession, path: str, key_columns: list[str] | None = None) -> DataFrame:
    """Parses the CSV once into a Parquet table with a row key; every later step scans columns."""
    return materialise(with_content_key(read_transfers_csv(spark, path), key_columns))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """CSV with a header and no index column."""
    df.write.mode(mode).option("header", True).option("timestampFormat", CSV_OUT_TIME).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Reads back what ``write_csv`` wrote."""
    return read_transfers_csv(spark, path, schema, CSV_OUT_TIME)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> str:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def as_documents(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Every row as one JSON document."""
    return F.to_json(F.struct(*[F.col(c) for c in columns or df.columns]), {"timestampFormat": CSV_OUT_TIME})


class DocumentStore:
    """A collection of documents kept as JSON lines: insert many, find all, find the first few."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path, schema

    def insert_many(self, df: DataFrame) -> None:
        (
            df.select(*self.schema.fieldNames())
            .write.mode("append")
            .option("timestampFormat", CSV_OUT_TIME)
            .json(self.path)
        )

    def find(self) -> DataFrame:
        reader = self.spark.read.schema(self.schema).option("mode", "FAILFAST")
        return reader.option("timestampFormat", CSV_OUT_TIME).json(self.path)

    def find_first(self, n: int, order_by: list[str]) -> DataFrame:
        return self.find().orderBy(*order_by).limit(n)
