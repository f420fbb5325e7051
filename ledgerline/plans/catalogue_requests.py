"""Two requests of every customer, with dates and time frames of their own, in one job; each with the SQL that gives
the same rows.  Amounts are whole numbers, whose sums are exact in any order: periods of 32 or 48 days otherwise give
means that lie between two roundings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.adapters import ORDERS_SQL, accounts, orders_ledger
from .catalogue import SIGNED
from .per_request import analyze_requests
from .registry import query

#: Requests, their rows up to the date, and those within the time frame (six months for the second request).
CUT = f"""WITH {ORDERS_SQL}, req AS (SELECT 'r' || c_custkey || '-' || k AS request_id, CAST(c_custkey AS VARCHAR) AS account, round(c_acctbal) AS balance, k,
 CASE k WHEN 0 THEN DATE '1996-06-30' ELSE DATE '1998-03-31' END + CAST(c_custkey % 7 AS INTEGER) AS d FROM customer, (VALUES (0), (1)) v(k)),
upto AS (SELECT r.request_id, r.k, r.d, l.* REPLACE (round(l.amount) AS amount) FROM ledger l JOIN req r ON r.account = l.account WHERE l.date <= r.d),
frame AS (SELECT request_id, CAST(date_trunc('month', CAST(max(date) - INTERVAL 6 MONTH AS DATE)) AS DATE) AS first FROM upto WHERE k = 1 GROUP BY 1),
cut AS (SELECT u.*, date_diff('day', u.date, u.d) AS age FROM upto u LEFT JOIN frame f ON f.request_id = u.request_id WHERE f.first IS NULL OR u.date >= f.first)"""


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    twice = lambda df: df.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("request_id", F.concat(F.lit("r"), "account", F.lit("-"), "k"))
    owners = twice(accounts(spark, d)).withColumn("balance", F.round("balance"))
    day = F.date_add(F.when(F.col("k") == 0, F.lit("1996-06-30")).otherwise(F.lit("1998-03-31")).cast("date"), (F.col("account").cast("long") % 7).cast("int"))
    wanted = owners.select("request_id", day.alias("as_of"), F.when(F.col("k") == 1, 6).alias("months"))
    labelled = twice(orders_ledger(spark, d)).withColumn("amount", F.round("amount")).withColumn("label", F.when(F.col("type") == "CREDIT", "payroll").otherwise("loan"))
    return analyze_requests(labelled.drop("k"), owners.drop("k"), wanted)


@query("requests_cashflow", f"""{CUT}, per AS (SELECT request_id, sum(CASE WHEN type = 'CREDIT' THEN amount ELSE 0 END) AS c, sum(CASE WHEN type = 'DEBIT' THEN amount ELSE 0 END) AS b, greatest(1.0, max(age) / 30.0) AS m FROM cut GROUP BY 1)
SELECT req.request_id, d AS as_of, account, round(coalesce(c, 0.0), 2) AS credit, round(coalesce(b, 0.0), 2) AS debit, round(coalesce((c - b) / m, 0.0), 2) AS net_cash_flow, round(coalesce(b / m, 0.0), 2) AS spending
FROM req LEFT JOIN per ON per.request_id = req.request_id""")
def requests_cashflow(spark, d):
    return _tables(spark, d)["cashflow"]


@query("requests_net_cashflow", f"""{CUT}, per AS (SELECT request_id, max(age) AS t, sum({SIGNED}) AS s, sum(CASE WHEN age <= 180 THEN {SIGNED} ELSE 0 END) AS s6, sum(CASE WHEN age <= 90 THEN {SIGNED} ELSE 0 END) AS s3 FROM cut GROUP BY 1)
SELECT req.request_id, d AS as_of, account, round(coalesce(s / greatest(1.0, t / 30.0), 0.0), 4) AS net_cash_flow_all,
 round(coalesce(CASE WHEN t > 30 THEN s6 / (least(t, 180) / 30.0) ELSE s6 END, 0.0), 4) AS net_cash_flow_6m,
 round(coalesce(CASE WHEN t > 30 THEN s3 / (least(t, 90) / 30.0) ELSE s3 END, 0.0), 4) AS net_cash_flow_3m
FROM req LEFT JOIN per ON per.request_id = req.request_id""")
def requests_net_cashflow(spark, d):
    return _tables(spark, d)["net_cashflow"]


@query("requests_monthly_income", f"""{CUT}, per AS (SELECT request_id, max(age) AS t, sum(amount) AS s, sum(CASE WHEN age <= 180 THEN amount ELSE 0 END) AS s6, sum(CASE WHEN age <= 90 THEN amount ELSE 0 END) AS s3 FROM cut WHERE type = 'CREDIT' GROUP BY 1)
SELECT req.request_id, d AS as_of, account, round(CASE WHEN t >= 30 THEN s * 30 / t ELSE s END, 4) AS monthly_all, round(CASE WHEN t >= 30 THEN s6 * 30 / least(t, 180) ELSE s6 END, 4) AS monthly_6m,
 round(CASE WHEN t >= 30 THEN s3 * 30 / least(t, 90) ELSE s3 END, 4) AS monthly_3m FROM req JOIN per ON per.request_id = req.request_id""")
def requests_monthly_income(spark, d):
    return _tables(spark, d)["monthly_income"]


@query("requests_balances", f"""{CUT}, net AS (SELECT request_id, date, sum({SIGNED}) AS net FROM cut GROUP BY 1, 2), first_ AS (SELECT request_id, min(date) AS f FROM cut GROUP BY 1),
span AS (SELECT r.request_id, r.d, r.account, r.balance, greatest(coalesce(f, d), CAST(d - 179 AS DATE)) AS s FROM req r LEFT JOIN first_ ON first_.request_id = r.request_id),
days AS (SELECT request_id, d, account, balance, CAST(unnest(generate_series(CAST(s AS TIMESTAMP), CAST(d AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM span),
bal AS (SELECT days.request_id, d, account, date_diff('day', days.date, d) // 30 AS bucket, balance - sum(coalesce(net, 0.0)) OVER (PARTITION BY days.request_id ORDER BY days.date DESC) AS b FROM days LEFT JOIN net ON net.request_id = days.request_id AND net.date = days.date),
buckets AS (SELECT request_id, d, account, bucket, avg(b) AS m FROM bal GROUP BY ALL)
SELECT request_id, d AS as_of, account, round(avg(CASE WHEN bucket < 3 THEN m END), 4) AS balance_3m, round(avg(CASE WHEN bucket < 6 THEN m END), 4) AS balance_6m, round(avg(m), 4) AS balance_all FROM buckets GROUP BY request_id, d, account""")
def requests_balances(spark, d):
    return _tables(spark, d)["balances"]
