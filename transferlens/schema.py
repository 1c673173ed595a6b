"""Table schemas of the transfer data."""

from pyspark.sql import types as T

# Column order of the raw CSV file, and its time format.
RAW_TIME_FORMAT = "yyyy/MM/dd HH:mm"
RAW_HEADERS = [
    "Timestamp",
    "From Bank",
    "Account",
    "To Bank",
    "Account.1",
    "Amount Received",
    "Receiving Currency",
    "Amount Paid",
    "Payment Currency",
    "Payment Format",
    "Is Laundering",
]

TRANSFERS = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("from_bank", T.LongType()),
        T.StructField("account", T.StringType()),
        T.StructField("to_bank", T.LongType()),
        T.StructField("account_1", T.StringType()),
        T.StructField("amount_received", T.DoubleType()),
        T.StructField("receiving_currency", T.StringType()),
        T.StructField("amount_paid", T.DoubleType()),
        T.StructField("payment_currency", T.StringType()),
        T.StructField("payment_format", T.StringType()),
        T.StructField("is_laundering", T.IntegerType()),
    ]
)

SCORING_REQUEST = T.StructType(
    [
        T.StructField("from_bank", T.StringType()),
        T.StructField("account", T.StringType()),
        T.StructField("to_bank", T.StringType()),
        T.StructField("account_1", T.StringType()),
        T.StructField("amount_received", T.DoubleType()),
        T.StructField("receiving_currency", T.StringType()),
        T.StructField("payment_currency", T.StringType()),
        T.StructField("payment_format", T.StringType()),
        T.StructField("day", T.StringType()),
    ]
)

RUN_METRICS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("step", T.IntegerType()),
    ]
)

RUNS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("start_ms", T.LongType()),
        T.StructField("end_ms", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)

LABEL = "is_laundering"
KEY = "row_key"
AMOUNTS = ["amount_received", "amount_paid"]
CATEGORIES = [
    "from_bank",
    "account",
    "to_bank",
    "account_1",
    "receiving_currency",
    "payment_currency",
    "payment_format",
    "day",
]
# Columns the model does not use.
DROPPED = [
    "timestamp",
    "date",
    "time",
    "amount_paid",
    "receiving_currency",
    "payment_currency",
    "from_bank",
    "to_bank",
]
