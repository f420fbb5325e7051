"""Ledger views over the star-schema tables.

A ledger has account STRING, txn_id BIGINT, date DATE, amount DOUBLE, type
(CREDIT or DEBIT), description STRING and cluster STRING.  The SQL texts define
the same views for the oracle.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDERS_SQL = """ledger AS (SELECT CAST(o_custkey AS VARCHAR) AS account, o_orderkey AS txn_id, CAST(o_orderdate AS DATE) AS date,
 o_totalprice AS amount, CASE WHEN o_orderstatus = 'F' THEN 'DEBIT' ELSE 'CREDIT' END AS type,
 o_orderpriority AS description, o_orderpriority AS cluster FROM orders),
accounts AS (SELECT CAST(c_custkey AS VARCHAR) AS account, c_acctbal AS balance, c_mktsegment AS account_type FROM customer),
day_ AS (SELECT max(CAST(o_orderdate AS DATE)) AS d FROM orders)"""

EVENTS_SQL = """ledger AS (SELECT CAST(user_id AS VARCHAR) AS account, event_id AS txn_id, CAST(ts AS DATE) AS date,
 round(value, 2) AS amount, CASE WHEN event_type IN ('purchase', 'error') THEN 'DEBIT' ELSE 'CREDIT' END AS type,
 event_type AS description, event_type AS cluster FROM events),
day_ AS (SELECT max(CAST(ts AS DATE)) AS d FROM events)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table whose key alone makes many rows, in one task.
SPREAD_ROWS = 20_000


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt by ``keys`` over as many tasks as their count asks for, so that what a task makes of its rows is bounded."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // SPREAD_ROWS))
    return rows.repartition(tasks, *keys)


def orders_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    debit = F.when(F.col("o_orderstatus") == "F", "DEBIT").otherwise("CREDIT")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("account"), F.col("o_orderkey").alias("txn_id"), F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_totalprice").alias("amount"), debit.alias("type"), F.col("o_orderpriority").alias("description"), F.col("o_orderpriority").alias("cluster"),
    )


def events_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    debit = F.when(F.col("event_type").isin("purchase", "error"), "DEBIT").otherwise("CREDIT")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("account"), F.col("event_id").alias("txn_id"), F.col("ts").cast("date").alias("date"),
        F.round("value", 2).alias("amount"), debit.alias("type"), F.col("event_type").alias("description"), F.col("event_type").alias("cluster"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("account"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("account_type"))


def last_date(ledger: DataFrame) -> datetime.date:
    """The as-of date where none is given: the ledger's last."""
    return ledger.agg(F.max("date")).first()[0]
