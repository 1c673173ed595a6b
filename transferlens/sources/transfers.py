"""Transfers derived from an order star schema, written once and then scanned as one wide table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from transferlens.session import CODEC, forget_shuffles, scratch_path

_written: dict[tuple, str] = {}
_INPUTS = ("lineitem", "orders", "customer", "supplier", "nation", "region")


def input_state(spark: SparkSession, folder: str) -> tuple:
    """What identifies the contents of the input tables: their files' paths, sizes and times, as one count and sum.

    The files are listed, not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([f"{folder}/{t}.parquet" for t in _INPUTS])
    seen = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    return (spark.sparkContext.applicationId, folder, *files.agg(F.count(F.lit(1)), F.sum(seen)).first())


def derive_transfers(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as transfers from a customer's account to a supplier's.

    Orders meet customers before the lines do, so that the many lines are shuffled once, for their order (and once
    more only where suppliers are too many to broadcast). No join is hinted: the sizes of customer and supplier grow with the data, so Spark decides from
    their statistics which side to broadcast.
    """

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    def bank_region(prefix: str) -> DataFrame:
        nation, region = table("nation"), table("region")
        return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            F.col("n_nationkey").alias(f"{prefix}_bank"), F.col("r_name").alias(f"{prefix}_currency")
        )

    lines = table("lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate"
    )
    orders = table("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    payers = (
        table("customer").select("c_custkey", "c_nationkey").join(bank_region("payer"), F.col("c_nationkey") == F.col("payer_bank"))
    )
    payees = (
        table("supplier").select("s_suppkey", "s_nationkey").join(bank_region("payee"), F.col("s_nationkey") == F.col("payee_bank"))
    )
    paid = orders.join(payers, F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey", "c_nationkey")
    joined = lines.join(payees, F.col("l_suppkey") == F.col("s_suppkey")).join(paid, F.col("l_orderkey") == F.col("o_orderkey"))
    minutes = F.pmod(F.col("l_orderkey") * 13 + F.col("l_linenumber") * 7, F.lit(1440)).cast("int")
    suspicious = (
        (F.col("l_quantity") >= 48)
        & (F.col("l_discount") >= F.lit(0.09))
        & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    )
    return joined.select(
        F.timestamp_add("MINUTE", minutes, F.col("l_shipdate").cast("timestamp")).alias("timestamp"),
        F.col("payer_bank").cast("bigint").alias("from_bank"),
        F.hex("o_custkey").alias("account"),
        F.col("payee_bank").cast("bigint").alias("to_bank"),
        F.concat(F.lit("S"), F.hex("l_suppkey")).alias("account_1"),
        # Rounded half up on the double itself; decimal rounding differs between engines.
        (F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100 + 0.5) / 100).alias("amount_received"),
        F.col("payee_currency").alias("receiving_currency"),
        F.col("l_extendedprice").alias("amount_paid"),
        F.col("payer_currency").alias("payment_currency"),
        F.col("o_orderpriority").alias("payment_format"),
        F.when(suspicious, 1).otherwise(0).alias("is_laundering"),
        F.md5(
            F.concat_ws(
                "|",
                F.col("l_orderkey").cast("string"),
                F.col("l_partkey").cast("string"),
                F.col("l_suppkey").cast("string"),
                F.col("l_linenumber").cast("string"),
                F.col("l_quantity").cast("int").cast("string"),
                F.date_format("l_shipdate", "yyyyMMdd"),
            )
        ).alias("row_key"),
    )


def transfers(spark: SparkSession, folder: str) -> DataFrame:
    """The transfer table of a folder, joined once per application and state of its files, read back as Parquet.

    Every report then reads only the columns it needs from one table, with filters pushed into the
    scan, instead of repeating the joins.
    """
    at = input_state(spark, folder)
    if at not in _written:
        path = scratch_path(spark, "transfers")
        derive_transfers(spark, folder).write.parquet(path, compression=CODEC)
        forget_shuffles(spark)
        _written[at] = path
    return spark.read.parquet(_written[at])
