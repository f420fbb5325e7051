"""Requests: one JSON document per customer, to tables and errors.

Any number of customers is read at once; a bad document becomes a row of the
errors table and takes no part in the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import printable, standard_timestamp

ACCOUNT = "accountGuid string, accountType string, currentBalance string, availableBalance string, currentBalanceDate string"
TRANSACTION = "guid string, accountGuid string, description string, originalDescription string, category string, amount double, date string, type string, label string"
REQUEST = f"asOfDate string, accounts array<struct<{ACCOUNT.replace(' string', ': string').replace(' double', ': double')}>>, transactions array<struct<{TRANSACTION.replace(' string', ': string').replace(' double', ': double')}>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(request_id, body) of every JSON file in a directory; the file's path is the id."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("request_id"), F.col("value").alias("body"))


def parsed(requests: DataFrame) -> DataFrame:
    """(request_id, body) to (request_id, doc); null where the body is no such document."""
    return requests.select("request_id", F.from_json(printable(F.col("body")), REQUEST).alias("doc"))


def as_of() -> Column:
    return F.coalesce(F.try_to_timestamp(F.col("doc.asOfDate"), F.lit("yyyy-MM-dd")), F.try_to_timestamp("doc.asOfDate")).cast("date")


def errors(requests: DataFrame) -> DataFrame:
    """(request_id, code, message) of documents that cannot be analysed: 401 nothing to work on, 301 a single
    field, credit or debit, 501 no date; the first that applies."""
    rows = requests.select("request_id", "body", F.from_json(printable(F.col("body")), REQUEST).alias("doc"))
    side = lambda t: F.size(F.filter(F.coalesce("doc.transactions", F.array()), lambda x: F.upper(x["type"]) == t))
    empty = F.col("doc").isNull() | (F.size(F.coalesce("doc.transactions", F.array())) == 0)
    fault = lambda n, text: F.struct(F.lit(n).alias("code"), F.lit(text).alias("message"))
    code = (
        F.when(F.coalesce(F.size(F.json_object_keys("body")) == 1, F.lit(False)), fault(301, "a single field"))
        .when(empty, fault(401, "no transactions"))
        .when(side("CREDIT") == 0, fault(401, "no credits"))
        .when((side("CREDIT") == 1) | (side("DEBIT") == 1), fault(301, "a single credit or debit"))
        .when(F.size(F.coalesce("doc.accounts", F.array())) == 0, fault(401, "no accounts"))
        .when(as_of().isNull(), fault(501, "no valid date"))
    )
    return rows.select("request_id", code.alias("x")).where("x is not null").select("request_id", "x.code", "x.message")


def valid(requests: DataFrame) -> DataFrame:
    bad = errors(requests).select("request_id")
    return parsed(requests).join(bad, "request_id", "left_anti")


def accounts(requests: DataFrame) -> DataFrame:
    """One row per request and account, the one with the last balance date; numbers from any spelling."""
    rows = requests.select("request_id", as_of().alias("as_of"), F.inline("doc.accounts"))
    date = F.to_date(F.substring(standard_timestamp(F.col("currentBalanceDate")), 1, 10))
    rows = rows.select("request_id", "as_of", F.col("accountGuid").alias("account"), F.coalesce("accountType", F.lit("CHECKING")).alias("account_type"), F.col("currentBalance").try_cast("double").alias("balance"), F.coalesce(F.col("availableBalance").try_cast("double"), F.lit(0.0)).alias("available"), date.alias("date"))
    order = Window.partitionBy("request_id", "account").orderBy(F.desc_nulls_last("date"), F.desc("balance"))
    return rows.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def ledger(requests: DataFrame) -> DataFrame:
    """One row per transaction up to the as-of date, of accounts that the request lists."""
    rows = requests.select("request_id", as_of().alias("as_of"), F.transform("doc.accounts", lambda a: a["accountGuid"]).alias("known"), F.inline("doc.transactions"))
    date = F.to_date(F.substring(standard_timestamp(F.col("date")), 1, 10))
    text = F.coalesce("originalDescription", "description", F.lit("NO DESCRIPTION"))
    rows = rows.where(F.array_contains("known", F.col("accountGuid")))
    return rows.select("request_id", F.col("accountGuid").alias("account"), F.col("guid").alias("txn_id"), date.alias("date"), "amount", F.upper("type").alias("type"), text.alias("description"), "category", "label", "as_of").where(F.col("date") <= F.col("as_of"))


def read_table(spark: SparkSession, path: str, format: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """A dimension or ledger in any of Spark's formats (parquet, csv, json, orc, jdbc ...)."""
    reader = spark.read.format(format).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)
