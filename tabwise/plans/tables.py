"""Derived inputs shared by registered queries and their SQL oracles.

The driver tables have no NULLs, so NULL-handling operators run on views with
deterministic gaps (a function of the key) — the same expression appears in
each query's SQL twin.  No rows are removed: every row of every table is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwise.sources.tables import read_table


def _gap(col: str, key: str, mod: int, hit: int):
    return F.when(F.col(key) % mod == hit, F.lit(None)).otherwise(F.col(col)).alias(col)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders")


def orders_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    return o.select("o_orderkey", "o_custkey",
                    _gap("o_orderstatus", "o_orderkey", 13, 5),
                    _gap("o_totalprice", "o_orderkey", 10, 0),
                    "o_orderdate",
                    _gap("o_orderpriority", "o_orderkey", 7, 3))


ORDERS_WITH_GAPS_SQL = """og AS (
  SELECT o_orderkey, o_custkey,
         CASE WHEN o_orderkey % 13 = 5 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
         CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
         o_orderdate,
         CASE WHEN o_orderkey % 7 = 3 THEN NULL ELSE o_orderpriority END AS o_orderpriority
  FROM orders)"""


def customer_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    return c.select("c_custkey", "c_name", "c_nationkey", "c_acctbal",
                    _gap("c_mktsegment", "c_custkey", 11, 0))


CUSTOMER_WITH_GAPS_SQL = """cg AS (
  SELECT c_custkey, c_name, c_nationkey, c_acctbal,
         CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment
  FROM customer)"""


def md5_key_sql(seed: int, *cols: str) -> str:
    """SQL twin of ``ranking.hash_key``."""
    parts = " || ':' || ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return f"md5('{seed}:' || {parts})"
