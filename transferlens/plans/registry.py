"""Named queries over a folder of tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_TRANSFERS = """transfers AS MATERIALIZED (
SELECT l.l_shipdate + to_minutes(((l.l_orderkey*13+l.l_linenumber*7)%1440)::BIGINT) AS timestamp,
       c.c_nationkey::BIGINT AS from_bank, hex(o.o_custkey) AS account,
       s.s_nationkey::BIGINT AS to_bank, concat('S', hex(l.l_suppkey)) AS account_1,
       floor(l.l_extendedprice*(1-l.l_discount)*100+0.5::DOUBLE)/100 AS amount_received, rs.r_name AS receiving_currency,
       l.l_extendedprice AS amount_paid, rc.r_name AS payment_currency, o.o_orderpriority AS payment_format,
       CASE WHEN l.l_quantity>=48 AND l.l_discount>=CAST(0.09 AS DOUBLE)
             AND o.o_orderpriority IN ('1-URGENT','2-HIGH') THEN 1 ELSE 0 END AS is_laundering,
       md5(concat_ws('|', l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber,
                     CAST(l.l_quantity AS INT), strftime(l.l_shipdate,'%Y%m%d'))) AS row_key
FROM lineitem l JOIN orders o ON l.l_orderkey=o.o_orderkey
JOIN customer c ON o.o_custkey=c.c_custkey JOIN supplier s ON l.l_suppkey=s.s_suppkey
JOIN nation nc ON c.c_nationkey=nc.n_nationkey JOIN region rc ON nc.n_regionkey=rc.r_regionkey
JOIN nation ns ON s.s_nationkey=ns.n_nationkey JOIN region rs ON ns.n_regionkey=rs.r_regionkey)"""

_ENRICHED = """enriched AS MATERIALIZED (
SELECT * REPLACE (CAST(from_bank AS VARCHAR) AS from_bank, CAST(to_bank AS VARCHAR) AS to_bank),
       CAST(timestamp AS DATE) AS date, dayname(timestamp) AS day, strftime(timestamp,'%H:%M:%S') AS time
FROM transfers)"""


def query(name: str, sql: str | None = None, uses: str = "enriched") -> Callable[[Query], Query]:
    """Registers a query. ``sql`` may start with further common tables ("a AS (…), … SELECT …") on top
    of ``transfers`` and ``enriched``; ``uses=''`` leaves those out."""

    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = f
        if sql is not None:
            tables = [_TRANSFERS, _ENRICHED] if uses == "enriched" else []
            text = sql.strip()
            if text.upper().startswith("SELECT"):
                ORACLES[name] = (f"WITH {', '.join(tables)}\n" if tables else "") + text
            else:
                recursive = "RECURSIVE " if "UNION ALL SELECT k+1" in text else ""
                ORACLES[name] = f"WITH {recursive}{', '.join([*tables, text])}"
        return f

    return register
