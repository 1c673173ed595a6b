"""Queries: sources, enrichment and profile reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from transferlens.functions.columns import canonical_names, categorical_columns, enrich, numeric_columns, parse_time
from transferlens.operators import profiling, stats
from transferlens.operators.scoring import as_requests
from transferlens.plans.registry import query
from transferlens.schema import AMOUNTS, CATEGORIES, DROPPED, KEY, LABEL, RAW_HEADERS, RAW_TIME_FORMAT, TRANSFERS
from transferlens.session import scratch_path
from transferlens.sources.tables import DocumentStore, as_documents, read_csv, read_transfers_csv, write_csv
from transferlens.sources.transfers import transfers

TIME_TEXT = "yyyy-MM-dd HH:mm:ss"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    doubles = {c: F.round(c, digits) for c, t in df.dtypes if t == "double"}
    return df.withColumns(doubles) if doubles else df


def timed_as_text(df: DataFrame) -> DataFrame:
    texts = {c: F.date_format(c, TIME_TEXT) for c, t in df.dtypes if t == "timestamp"}
    texts.update({c: F.col(c).cast("string") for c, t in df.dtypes if t == "date"})
    return df.withColumns(texts) if texts else df


@query(
    "suspicious_by_day_and_format",
    """SELECT day, payment_format, CAST(sum(is_laundering) AS BIGINT) AS n_suspicious, CAST(sum(1-is_laundering) AS BIGINT) AS n_clean
    FROM enriched GROUP BY day, payment_format""",
)
def suspicious_by_day_and_format(spark, folder):
    rows = enrich(transfers(spark, folder))
    return rows.groupBy("day", "payment_format").agg(
        F.count_if(F.col(LABEL) == 1).alias("n_suspicious"), F.count_if(F.col(LABEL) == 0).alias("n_clean")
    )


@query(
    "transfer_csv_scan",
    """SELECT strftime(timestamp,'%Y-%m-%d %H:%M:%S') AS timestamp, from_bank, account, to_bank, account_1, amount_received,
    receiving_currency, amount_paid, payment_currency, payment_format, is_laundering FROM transfers""",
)
def transfer_csv_scan(spark, folder):
    """Raw CSV with its repeated header, written and scanned by position."""
    path = scratch_path(spark, "raw-csv")
    raw = transfers(spark, folder).select(*TRANSFERS.fieldNames()).toDF(*RAW_HEADERS)
    raw.write.option("header", True).option("timestampFormat", RAW_TIME_FORMAT).csv(path)
    return timed_as_text(read_transfers_csv(spark, path))


@query(
    "csv_round_trip",
    """SELECT payment_format, is_laundering, count(*) AS n, round(sum(amount_received),2) AS received, round(sum(amount_paid),2) AS paid,
    count(DISTINCT account) AS accounts, strftime(min(timestamp),'%Y-%m-%d %H:%M:%S') AS first_time FROM transfers GROUP BY ALL""",
)
def csv_round_trip(spark, folder):
    rows = transfers(spark, folder)
    back = read_csv(spark, write_csv(rows, scratch_path(spark, "csv")), rows.schema)
    return timed_as_text(
        back.groupBy("payment_format", LABEL).agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.sum("amount_received"), 2).alias("received"),
            F.round(F.sum("amount_paid"), 2).alias("paid"),
            F.count_distinct("account").alias("accounts"),
            F.min("timestamp").alias("first_time"),
        )
    )


_DOCUMENT = ["row_key", "from_bank", "account", "to_bank", "account_1", "amount_received", "payment_format", "is_laundering"]


@query(
    "transfers_as_documents",
    """SELECT row_key, CAST(to_json({'row_key': row_key, 'from_bank': from_bank, 'account': account, 'to_bank': to_bank,
    'account_1': account_1, 'amount_received': amount_received, 'payment_format': payment_format, 'is_laundering': is_laundering}) AS VARCHAR) AS document
    FROM transfers""",
)
def transfers_as_documents(spark, folder):
    return transfers(spark, folder).select(KEY, as_documents(transfers(spark, folder), _DOCUMENT).alias("document"))


def _document_store(spark, folder) -> DocumentStore:
    rows = transfers(spark, folder).select(*_DOCUMENT, "timestamp")
    store = DocumentStore(spark, scratch_path(spark, "documents"), rows.schema)
    store.insert_many(rows.where(F.col(LABEL) == 1))
    store.insert_many(rows.where(F.col(LABEL) == 0))
    return store


@query(
    "document_store_find_all",
    """SELECT row_key, from_bank, account, to_bank, account_1, amount_received, payment_format, is_laundering,
    strftime(timestamp,'%Y-%m-%d %H:%M:%S') AS timestamp FROM transfers""",
)
def document_store_find_all(spark, folder):
    return timed_as_text(_document_store(spark, folder).find())


@query(
    "document_store_first_five",
    """SELECT row_key, from_bank, account, to_bank, account_1, amount_received, payment_format, is_laundering,
    strftime(timestamp,'%Y-%m-%d %H:%M:%S') AS timestamp FROM transfers ORDER BY transfers.timestamp, row_key LIMIT 5""",
)
def document_store_first_five(spark, folder):
    return timed_as_text(_document_store(spark, folder).find_first(5, ["timestamp", KEY]))


@query(
    "scoring_requests",
    """SELECT row_key, from_bank, account, to_bank, account_1, amount_received, receiving_currency, payment_currency, payment_format, day FROM enriched""",
)
def scoring_requests(spark, folder):
    return as_requests(transfers(spark, folder), [KEY])


@query(
    "enriched_transfers",
    """SELECT row_key, from_bank, account, to_bank, account_1, amount_received, receiving_currency, amount_paid, payment_currency, payment_format,
    is_laundering, strftime(timestamp,'%Y-%m-%d %H:%M:%S') AS timestamp, CAST(date AS VARCHAR) AS date, day, time FROM enriched""",
)
def enriched_transfers(spark, folder):
    """From raw headers and text times to the enriched table."""
    rows = transfers(spark, folder)
    raw = rows.withColumn("timestamp", F.date_format("timestamp", RAW_TIME_FORMAT)).select(*TRANSFERS.fieldNames(), KEY)
    named = canonical_names(raw.toDF(*RAW_HEADERS, "Row Key"))
    return timed_as_text(enrich(named.withColumn("timestamp", parse_time("timestamp"))))


@query(
    "model_inputs",
    "SELECT row_key, account, account_1, amount_received, payment_format, day, CAST(is_laundering AS INTEGER) AS label FROM enriched",
)
def model_inputs(spark, folder):
    rows = enrich(transfers(spark, folder))
    return rows.drop(*DROPPED).withColumn("label", F.col(LABEL).cast("double").cast("int")).drop(LABEL)


@query(
    "suspicious_transfers",
    """SELECT row_key, account, account_1, amount_received, amount_paid, payment_format, day FROM enriched WHERE is_laundering = 1""",
)
def suspicious_transfers(spark, folder):
    return enrich(transfers(spark, folder).where(F.col(LABEL) == 1)).select(
        KEY, "account", "account_1", "amount_received", "amount_paid", "payment_format", "day"
    )


@query(
    "first_transfers",
    """SELECT row_key, strftime(timestamp,'%Y-%m-%d %H:%M:%S') AS timestamp, account, amount_received FROM transfers
    ORDER BY transfers.timestamp, row_key LIMIT 5""",
)
def first_transfers(spark, folder):
    rows = profiling.first_rows(transfers(spark, folder), 5, ["timestamp", KEY])
    return timed_as_text(rows.select(KEY, "timestamp", "account", "amount_received"))


@query("table_shape", "SELECT count(*) AS n_rows, CAST(15 AS BIGINT) AS n_columns FROM enriched")
def table_shape(spark, folder):
    return profiling.shape(enrich(transfers(spark, folder)))


@query(
    "column_groups",
    """SELECT g.column, g.kind, count(*) AS n_rows FROM enriched CROSS JOIN (VALUES ('amount_received','numeric'),('amount_paid','numeric'),
    ('is_laundering','numeric'),('from_bank','categorical'),('to_bank','categorical'),('account','categorical'),('account_1','categorical'),
    ('receiving_currency','categorical'),('payment_currency','categorical'),('payment_format','categorical'),('row_key','categorical'),
    ('date','categorical'),('day','categorical'),('time','categorical')) g("column", kind) GROUP BY ALL""",
)
def column_groups(spark, folder):
    """Columns by kind, with the rows they cover."""
    rows = enrich(transfers(spark, folder))
    kinds = {**{c: "numeric" for c in numeric_columns(rows)}, **{c: "categorical" for c in categorical_columns(rows)}}
    counts = rows.agg(*[F.count(F.lit(1)).alias(c) for c in kinds]).unpivot([], list(kinds), "column", "n_rows")
    return counts.withColumn("kind", F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("column")])


@query(
    "duplicate_rows",
    """SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE (row_key) FROM transfers)) AS BIGINT) AS n_duplicates FROM transfers""",
)
def duplicate_rows(spark, folder):
    return profiling.duplicate_rows(transfers(spark, folder).drop(KEY))


@query(
    "duplicate_routes",
    """SELECT CAST(sum(n-1) AS BIGINT) AS n_duplicates FROM (SELECT count(*) AS n FROM enriched GROUP BY account, account_1, payment_format, day)""",
)
def duplicate_routes(spark, folder):
    return profiling.duplicate_rows(enrich(transfers(spark, folder)), ["account", "account_1", "payment_format", "day"])


_COLUMNS = [*TRANSFERS.fieldNames()]


def _per_column(columns: list[str], expression: str, table: str = "enriched") -> str:
    return " UNION ALL ".join(f"""SELECT '{c}' AS "column", {expression.format(c=f'"{c}"')} FROM {table}""" for c in columns)


_HOLES = """holes AS (SELECT * REPLACE (CASE WHEN to_bank = '7' THEN NULL ELSE amount_received END AS amount_received,
CASE WHEN from_bank = '3' THEN NULL ELSE account END AS account, NULLIF(payment_format, '5-LOW') AS payment_format) FROM enriched)"""


def with_holes(df: DataFrame) -> DataFrame:
    """Missing values made by rule, as the tables have none."""
    return df.withColumns(
        {
            "amount_received": F.when(F.col("to_bank") != "7", F.col("amount_received")),
            "account": F.when(F.col("from_bank") != "3", F.col("account")),
            "payment_format": F.when(F.col("payment_format") != "5-LOW", F.col("payment_format")),
        }
    )


@query("missing_values", _HOLES + " " + _per_column(_COLUMNS, "count(*) - count({c}) AS n_missing", "holes"))
def missing_values(spark, folder):
    return profiling.missing_counts(with_holes(enrich(transfers(spark, folder))).select(*_COLUMNS))


_TYPES = dict(zip(_COLUMNS, ["timestamp", "string", "string", "string", "string", "double", "string", "double", "string", "string", "int"]))


@query(
    "table_info",
    _HOLES + " " + " UNION ALL ".join(f"""SELECT '{c}' AS "column", count("{c}") AS n_present, '{t}' AS data_type FROM holes""" for c, t in _TYPES.items()),
)
def table_info(spark, folder):
    return profiling.table_info(with_holes(enrich(transfers(spark, folder))).select(*_COLUMNS))


@query("distinct_values", _per_column([*_COLUMNS, "date", "day", "time"], "count(DISTINCT {c}) AS n_distinct"))
def distinct_values(spark, folder):
    return profiling.distinct_counts(enrich(transfers(spark, folder)).drop(KEY))


@query(
    "describe_numbers",
    _HOLES + " " + _per_column(
        ["amount_received", "amount_paid", "is_laundering"],
        "count({c}) AS count, round(avg({c}),6) AS mean, round(stddev_samp({c}),6) AS std, CAST(min({c}) AS DOUBLE) AS min, "
        "round(quantile_cont({c}::DOUBLE,0.25),6) AS q25, round(quantile_cont({c}::DOUBLE,0.5),6) AS median, "
        "round(quantile_cont({c}::DOUBLE,0.75),6) AS q75, CAST(max({c}) AS DOUBLE) AS max",
        "holes",
    ),
)
def describe_numbers(spark, folder):
    return rounded(profiling.describe_numbers(with_holes(enrich(transfers(spark, folder))), [*AMOUNTS, LABEL]))


@query(
    "describe_categories",
    _HOLES + ", counts AS ("
    + " UNION ALL ".join(f"""SELECT '{c}' AS "column", CAST("{c}" AS VARCHAR) AS value, count(*) AS n FROM holes WHERE "{c}" IS NOT NULL GROUP BY 2""" for c in CATEGORIES)
    + """), ranked AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS place FROM counts)
    SELECT "column", CAST(sum(n) AS BIGINT) AS count, count(*) AS unique, max(CASE WHEN place=1 THEN value END) AS top,
    max(CASE WHEN place=1 THEN n END) AS freq FROM ranked GROUP BY "column" """,
)
def describe_categories(spark, folder):
    return profiling.describe_categories(with_holes(enrich(transfers(spark, folder))), CATEGORIES)


@query(
    "value_counts",
    _HOLES + " " + " UNION ALL ".join(f"""SELECT '{c}' AS "column", CAST("{c}" AS VARCHAR) AS value, count(*) AS count FROM holes GROUP BY 2""" for c in [*CATEGORIES, "date"]),
)
def value_counts(spark, folder):
    return profiling.value_counts(with_holes(enrich(transfers(spark, folder))), [*CATEGORIES, "date"])


@query(
    "value_counts_by_class",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {c} AS value, CAST(sum(is_laundering) AS BIGINT) AS n_suspicious, CAST(sum(1-is_laundering) AS BIGINT) AS n_clean FROM enriched GROUP BY 2"""
        for c in ("day", "payment_format", "payment_currency")
    ),
)
def value_counts_by_class(spark, folder):
    return profiling.value_counts_by_label(enrich(transfers(spark, folder)), ["day", "payment_format", "payment_currency"])


def _top(column: str, value: int) -> str:
    return f"""SELECT {column}, count, round(100.0*count/sum(count) OVER (), 1) AS percent FROM (SELECT {column}, count(*) AS count FROM enriched
    WHERE is_laundering = {value} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)"""


@query("top_banks_suspicious", _top("from_bank", 1))
def top_banks_suspicious(spark, folder):
    return profiling.top_values(enrich(transfers(spark, folder)), "from_bank", LABEL, 1)


@query("top_banks_clean", _top("from_bank", 0))
def top_banks_clean(spark, folder):
    return profiling.top_values(enrich(transfers(spark, folder)), "from_bank", LABEL, 0)


@query("top_currencies_suspicious", _top("payment_currency", 1))
def top_currencies_suspicious(spark, folder):
    return profiling.top_values(enrich(transfers(spark, folder)), "payment_currency", LABEL, 1)


_BOX = " UNION ALL ".join(
    f"""SELECT g AS "group", '{c}' AS "column", {c} AS x FROM enriched, (VALUES (1),(2)) v(k), LATERAL (SELECT CASE WHEN k=1 THEN 'all' ELSE CAST(is_laundering AS VARCHAR) END AS g)"""
    for c in AMOUNTS
)


@query(
    "box_plot_numbers",
    f"""v AS ({_BOX}), q AS (SELECT "group", "column", quantile_cont(x,0.25) AS q1, quantile_cont(x,0.5) AS median, quantile_cont(x,0.75) AS q3 FROM v GROUP BY 1,2)
    SELECT v."group", v."column", round(q1,6) AS q1, round(median,6) AS median, round(q3,6) AS q3,
    round(least(min(CASE WHEN x >= q1-1.5*(q3-q1) THEN x END), q1),6) AS whisker_low, round(greatest(max(CASE WHEN x <= q3+1.5*(q3-q1) THEN x END), q3),6) AS whisker_high,
    count(CASE WHEN x < q1-1.5*(q3-q1) OR x > q3+1.5*(q3-q1) THEN 1 END) AS n_outliers
    FROM v JOIN q ON v."group"=q."group" AND v."column"=q."column" GROUP BY v."group", v."column", q1, median, q3""",
)
def box_plot_numbers(spark, folder):
    return rounded(profiling.box_numbers(transfers(spark, folder), AMOUNTS))


@query(
    "amount_histogram",
    """m AS (SELECT min(amount_received) AS low, (max(amount_received)-min(amount_received))/20 AS w FROM transfers)
    SELECT CAST(least(floor((amount_received-low)/w),19) AS BIGINT) AS bin, is_laundering, count(*) AS count,
    round(low + least(floor((amount_received-low)/w),19)*w, 6) AS bin_start FROM transfers, m GROUP BY 1,2,4""",
)
def amount_histogram(spark, folder):
    return rounded(profiling.histogram(transfers(spark, folder), "amount_received"))


def _density(column: str, source: str, weights: str) -> str:
    return f"""s AS (SELECT count(*)::DOUBLE AS n, stddev_samp({column})*pow(count(*)::DOUBLE,-0.2) AS h, min({column}) AS low, max({column}) AS high FROM {source}),
    g AS (SELECT i AS point, low-3*h + i*((high+3*h-(low-3*h))/199) AS gx, h, n FROM s, range(200) r(i)), w AS ({weights})
    SELECT point, round(gx,4) AS x, round(1e6*sum(w*exp(-0.5*((gx-x)/h)*((gx-x)/h)))/(n*h*sqrt(2*pi())),3) AS density FROM g, w GROUP BY point, gx, n, h"""


def _scaled_density(df: DataFrame) -> DataFrame:
    return df.select("point", F.round("x", 4).alias("x"), F.round(F.col("density") * 1e6, 3).alias("density"))


@query(
    "amount_density",
    _density("amount_received", "transfers", "SELECT amount_received AS x, count(*) AS w FROM transfers GROUP BY 1"),
)
def amount_density(spark, folder):
    return _scaled_density(profiling.density(transfers(spark, folder), "amount_received"))


@query(
    "suspicious_amount_density_exact",
    "bad AS (SELECT * FROM transfers WHERE is_laundering = 1), " + _density("amount_paid", "bad", "SELECT amount_paid AS x, count(*) AS w FROM bad GROUP BY 1"),
)
def suspicious_amount_density_exact(spark, folder):
    return _scaled_density(profiling.density(transfers(spark, folder).where(F.col(LABEL) == 1), "amount_paid"))


@query("class_counts", "SELECT is_laundering, count(*) AS count FROM transfers GROUP BY 1")
def class_counts(spark, folder):
    return profiling.class_counts(transfers(spark, folder))


@query(
    "contingency_cells",
    " UNION ALL ".join(f"""SELECT '{c}' AS "column", {c} AS value, is_laundering, count(*) AS count FROM enriched GROUP BY 2,3""" for c in CATEGORIES),
)
def contingency_cells(spark, folder):
    return profiling.contingency(enrich(transfers(spark, folder)), CATEGORIES)


@query("single_class_guard", "SELECT count(DISTINCT is_laundering) AS n_classes, count(DISTINCT is_laundering) <= 1 AS single_class FROM transfers")
def single_class_guard(spark, folder):
    return profiling.single_class(transfers(spark, folder))


def _cells(columns: list[str]) -> str:
    return (
        "cells AS ("
        + " UNION ALL ".join(f"""SELECT '{c}' AS col, {c} AS value, is_laundering AS y, 1 AS o FROM enriched WHERE {c} IS NOT NULL""" for c in columns)
        + """), n AS (SELECT col, count(*)::DOUBLE AS n, count(DISTINCT value) AS r, count(DISTINCT y) AS c FROM cells GROUP BY 1),
    rt AS (SELECT col, value, count(*)::DOUBLE AS rn FROM cells GROUP BY 1,2), ct AS (SELECT col, y, count(*)::DOUBLE AS cn FROM cells GROUP BY 1,2),
    o AS (SELECT col, value, y, count(*)::DOUBLE AS o FROM cells GROUP BY 1,2,3),
    full_cells AS (SELECT rt.col, rn*cn/n AS e, coalesce(o.o,0) AS o, r, c, n FROM rt JOIN ct ON rt.col=ct.col JOIN n ON n.col=rt.col
      LEFT JOIN o ON o.col=rt.col AND o.value=rt.value AND o.y=ct.y),
    chi AS (SELECT col AS "column", CAST(n AS BIGINT) AS n, sum(CASE WHEN r=2 AND c=2 THEN pow(greatest(abs(o-e)-0.5,0),2)/e ELSE (o-e)*(o-e)/e END) AS chi2, (r-1)*(c-1) AS dof
      FROM full_cells GROUP BY col, n, r, c)"""
    )


@query("chi_squared", _cells(CATEGORIES) + """ SELECT "column", n, round(chi2,4) AS chi2, dof FROM chi""")
def chi_squared(spark, folder):
    return rounded(stats.chi_squared(enrich(transfers(spark, folder)), CATEGORIES), 4)


# Tail of the chi-squared distribution with x = chi2/2: a finite sum, plus erfc(sqrt(x)) for odd degrees
# of freedom, which Simpson's rule gives here.
_TAIL = """, erfc AS (SELECT "column", 2/sqrt(pi())*0.002/3*(SELECT sum(CASE WHEN j IN (0,4000) THEN 1 WHEN j%2=1 THEN 4 ELSE 2 END
      * exp(-pow(sqrt(chi2/2)+j*0.002::DOUBLE,2))) FROM range(4001) t(j)) AS e FROM chi),
    p AS (SELECT chi.*, (SELECT coalesce(sum(exp(-chi2/2 + (i+(dof%2)/2.0::DOUBLE)*ln(chi2/2) - lgamma(i+1+(dof%2)/2.0::DOUBLE))),0) FROM range(dof//2) t(i))
      + CASE WHEN dof%2=1 THEN e ELSE 0 END AS p FROM chi JOIN erfc USING ("column"))
    SELECT "column", n, round(chi2,4) AS chi2, dof, round(p,6) AS p_value, CASE WHEN p < 0.05 THEN 'reject' ELSE 'fail_to_reject' END AS verdict FROM p"""


@query("independence_verdicts", _cells(CATEGORIES) + _TAIL)
def independence_verdicts(spark, folder):
    tested = stats.independence_test(enrich(transfers(spark, folder)), CATEGORIES)
    return tested.withColumns({"chi2": F.round("chi2", 4), "p_value": F.round("p_value", 6)})


@query("account_independence", _cells(["account", "account_1"]) + _TAIL)
def account_independence(spark, folder):
    tested = stats.independence_test(enrich(transfers(spark, folder)), ["account", "account_1"])
    return tested.withColumns({"chi2": F.round("chi2", 4), "p_value": F.round("p_value", 6)})


_VIF = """m AS (SELECT avg(amount_received) AS m1, avg(amount_paid) AS m2, var_pop(amount_received) AS s11, var_pop(amount_paid) AS s22,
    covar_pop(amount_received, amount_paid) AS s12 FROM transfers), d AS (SELECT *, s11*s22-s12*s12 AS det FROM m),
    vif AS (SELECT 'const' AS feature, 1 + (m1*m1*s22 - 2*m1*m2*s12 + m2*m2*s11)/det AS vif FROM d
    UNION ALL SELECT 'amount_received', s11*s22/det FROM d UNION ALL SELECT 'amount_paid', s11*s22/det FROM d)"""


@query("variance_inflation", _VIF + " SELECT feature, round(vif,6) AS vif, CASE WHEN vif > 5 THEN 'high' WHEN vif > 1 THEN 'moderate' ELSE 'none' END AS collinearity FROM vif")
def variance_inflation(spark, folder):
    return rounded(stats.with_vif_band(stats.variance_inflation(transfers(spark, folder), AMOUNTS)))
