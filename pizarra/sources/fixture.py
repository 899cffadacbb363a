"""Enrolment-shaped view over the driver's TPC-H-like tables.

There is no enrolment microdata in the test environment, so every query runs
on a deterministic view with the 15 raw columns of the published files, built
from ``lineitem``, ``orders`` and ``customer``. The same SQL text runs in
Spark (here) and in DuckDB (the oracle), so both sides see identical input.

The view deliberately contains null codes, null outcomes, an unmapped sector
(8), code 9, blank padding and the ``00-`` prefix defect in department 1.

Scale: the view is a lineitem-orders-customer equi-join. Catalyst prunes it to
the columns a query needs and pushes them into the Parquet scans; the big
lineitem/orders join shuffles on the order key (sort-merge), and the customer
side is only broadcast when its measured size passes Spark's
``autoBroadcastJoinThreshold`` (AQE re-plans at runtime), never by hint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Raw columns of a department file, in published order (snake_case names).
RAW_COLUMNS = [
    "anio",
    "cod_establecimiento",
    "departamento_f",
    "depto_mupio",
    "sector",
    "area",
    "sexo",
    "grado",
    "nivel",
    "pueblo_per",
    "plan_est",
    "jornada_est",
    "resultado_f",
    "repitente",
    "graduando",
]

# The view body; table names are substituted ({lineitem} etc.) for Spark and
# left as plain view names for DuckDB.
FIXTURE_SQL = """
SELECT
  2024 AS anio,
  CASE WHEN l.l_partkey % 1009 = 0 THEN NULL
       ELSE (CASE WHEN l.l_linenumber = 7 THEN '  ' ELSE '' END)
         || (CASE WHEN c.c_nationkey % 22 = 0 AND l.l_orderkey % 100 < 36 THEN '00'
                  ELSE lpad(CAST(c.c_nationkey % 22 + 1 AS STRING), 2, '0') END)
         || '-' || lpad(CAST(o.o_custkey % 17 + 1 AS STRING), 2, '0')
         || '-' || lpad(CAST(l.l_suppkey % 9999 AS STRING), 4, '0')
         || '-' || (CASE substring(o.o_orderpriority, 1, 1) WHEN '1' THEN '42' WHEN '2' THEN '43'
                    WHEN '3' THEN '45' WHEN '4' THEN '46' ELSE '44' END) END AS cod_establecimiento,
  CAST(c.c_nationkey % 22 + 1 AS INT) AS departamento_f,
  CAST((c.c_nationkey % 22 + 1) * 100 + 1 AS INT) AS depto_mupio,
  CASE c.c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 WHEN 'AUTOMOBILE' THEN 3
       WHEN 'HOUSEHOLD' THEN 4 ELSE 8 END AS sector,
  CASE WHEN l.l_partkey % 101 = 0 THEN 9 WHEN l.l_linestatus = 'F' THEN 1 ELSE 2 END AS area,
  CASE WHEN l.l_partkey % 211 = 0 THEN 9 ELSE CAST(l.l_orderkey % 2 + 1 AS INT) END AS sexo,
  CAST(l.l_linenumber % 7 AS INT) AS grado,
  CASE WHEN l.l_partkey % 97 = 0 THEN 9 ELSE CAST(substring(o.o_orderpriority, 1, 1) AS INT) END AS nivel,
  CASE WHEN l.l_suppkey % 7 = 0 THEN 9 ELSE CAST(l.l_suppkey % 7 AS INT) END AS pueblo_per,
  CAST(l.l_partkey % 5 + 1 AS INT) AS plan_est,
  CASE WHEN o.o_custkey % 6 = 0 THEN 9 ELSE CAST(o.o_custkey % 6 AS INT) END AS jornada_est,
  CASE WHEN l.l_partkey % 503 = 0 THEN NULL WHEN l.l_quantity <= 42 THEN 1 WHEN l.l_quantity = 43 THEN 2
       WHEN l.l_quantity <= 46 THEN 3 WHEN l.l_quantity = 47 THEN 4 WHEN l.l_quantity <= 49 THEN 5 ELSE 9 END AS resultado_f,
  CASE l.l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 9 END AS repitente,
  CASE o.o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 9 END AS graduando
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey
"""

DUCKDB_FIXTURE_SQL = FIXTURE_SQL.format(lineitem="lineitem", orders="orders", customer="customer")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def enrolments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 raw enrolment columns, one row per lineitem."""
    return spark.sql(
        FIXTURE_SQL,
        lineitem=table(spark, sf_dir, "lineitem"),
        orders=table(spark, sf_dir, "orders"),
        customer=table(spark, sf_dir, "customer"),
    )
