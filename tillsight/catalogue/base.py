"""Registry of named queries, and the SQL views that mirror ``sources.testtables``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without SQL only its rows are checked by the driver, and its values by the tests."""
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


RAW_CUSTOMERS = """
customers AS (
  SELECT c_custkey AS customer_id,
         CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal END AS balance,
         CAST(CASE WHEN c_custkey % 13 <> 0 THEN 18 + c_custkey % 60 END AS INT) AS age,
         c_acctbal >= 0 AS online_active, income,
         CAST(floor(c_acctbal + 0.5) AS DOUBLE) AS gross_income,
         'S' || (c_custkey % 50) AS postal_sector,
         CAST(n_regionkey AS INT) AS acorn_type_id, c_mktsegment AS gender,
         CAST(CASE WHEN c_custkey % 2 <> 0 THEN 1 END AS INT) AS marital_status_id,
         CAST(CASE WHEN c_custkey % 10 = 0 THEN 4 END AS INT) AS occupation_id
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS income
             FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey)"""

# A group is known by its region and online flag; members holds its distinct buckets.
GROUPS = RAW_CUSTOMERS + """,
members AS (
  SELECT DISTINCT acorn_type_id, online_active, gender, marital_status_id, occupation_id FROM customers),
group_sizes AS (
  SELECT acorn_type_id, online_active, CAST(count(*) AS INT) AS group_size FROM customers GROUP BY ALL)"""

EVENT_TX = """
tx AS (
  SELECT user_id AS c, value AS amount, CAST(isodow(ts) AS INT) AS day, event_type AS code,
         'B' || k AS bname, 'T' || (k % 10) AS btown,
         CASE WHEN k % 7 <> 0 THEN 'P' || (k % 20) || ' 1AB' END AS postcode
  FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) AS k FROM events))"""

EVENT_FAT = GROUPS + "," + EVENT_TX + """,
fat AS (
  SELECT tx.*, acorn_type_id, online_active FROM tx JOIN customers ON c = customer_id)"""

ORDER_TX = """
raw_tx AS (
  SELECT p_brand AS merchant_name, n_name AS merchant_town, r_name AS merchant_country,
         p_type AS merchant_category_code, l_extendedprice AS amount, CAST(o_orderdate AS DATE) AS date,
         o_custkey AS customer_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""

ORDER_FAT = GROUPS + "," + ORDER_TX + """,
fat AS (
  SELECT r.customer_id AS c, amount, CAST(isodow(date) AS INT) AS day, merchant_category_code AS code,
         merchant_name AS bname, merchant_town AS btown,
         CASE WHEN merchant_country <> 'ASIA' THEN substr(merchant_town, 1, 3) || ' 9XY' END AS postcode,
         acorn_type_id, online_active
  FROM raw_tx r JOIN customers USING (customer_id))"""

MERCHANTS = """
merchants AS (
  SELECT DISTINCT upper(p_brand) AS merchant_name, upper(n_name) AS merchant_town, 'Shop ' || p_brand AS name,
         upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) AS town,
         substr(n_name, 1, 2) || n_nationkey || ' 9XY' AS postcode
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE r_name <> 'ASIA')"""

MONEY = "CAST(sum(CAST({0} AS DECIMAL(18,2))) AS DOUBLE)"
