"""Windowed money measures, one conditional aggregation per key.

``age`` is the number of days from a row to the as-of date; the 3- and 6-month
windows are ages up to 90 and 180 days.  Accounts without rows get zeros.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOWS = {"all": None, "6m": 180, "3m": 90}
#: Days of a balance history, and of each of its buckets.
BALANCE_DAYS, BUCKET_DAYS = 180, 30


def aged(ledger: DataFrame, as_of: datetime.date) -> DataFrame:
    return ledger.withColumn("age", F.datediff(F.lit(as_of), "date"))


def within(days: int | None) -> Column:
    return F.lit(True) if days is None else F.col("age") <= days


def _sum(condition: Column, value: str = "amount") -> Column:
    return F.sum(F.when(condition, F.col(value)).otherwise(0.0))


def signed_amount() -> Column:
    return F.when(F.col("type") == "CREDIT", F.col("amount")).otherwise(-F.col("amount"))


def cashflow(ledger: DataFrame, accounts: DataFrame, as_of: datetime.date) -> DataFrame:
    """Credits, debits, net cash flow and spending per 30 days of the account's own history."""
    per = aged(ledger, as_of).groupBy("account").agg(_sum(F.col("type") == "CREDIT").alias("credit"), _sum(F.col("type") == "DEBIT").alias("debit"), F.max("age").alias("period"))
    months = F.greatest(F.lit(1.0), F.col("period") / 30.0)
    out = accounts.select("account").join(per, "account", "left")
    value = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 2)
    return out.select("account", value(F.col("credit")).alias("credit"), value(F.col("debit")).alias("debit"), value((F.col("credit") - F.col("debit")) / months).alias("net_cash_flow"), value(F.col("debit") / months).alias("spending"))


def net_cashflow(ledger: DataFrame, accounts: DataFrame, as_of: datetime.date) -> DataFrame:
    """Net flow of each window; windows of more than 30 days of history are brought to 30 days."""
    rows = aged(ledger, as_of)
    per = rows.groupBy("account").agg(F.max("age").alias("period"), *[F.sum(F.when(within(d), signed_amount()).otherwise(0.0)).alias(f"sum_{k}") for k, d in WINDOWS.items()])
    scale = {k: F.greatest(F.lit(1.0), F.col("period") / 30.0) if d is None else F.when(F.col("period") > 30, F.least(F.col("period"), F.lit(d)) / 30.0).otherwise(1.0) for k, d in WINDOWS.items()}
    return accounts.select("account").join(per, "account", "left").select("account", *[F.round(F.coalesce(F.col(f"sum_{k}") / scale[k], F.lit(0.0)), 4).alias(f"net_cash_flow_{k}") for k in WINDOWS])


def inflow(ledger: DataFrame, accounts: DataFrame, as_of: datetime.date, days: int, excluded_clusters: list[str], excluded: list[str]) -> DataFrame:
    """Credits of the last days without excluded clusters and descriptions."""
    keep = (F.col("type") == "CREDIT") & within(days) & ~F.col("cluster").isin(excluded_clusters) & ~F.coalesce(F.col("description").rlike("(?i)" + "|".join(excluded)), F.lit(False))
    per = aged(ledger, as_of).where(keep).groupBy("account").agg(F.sum("amount").alias("inflow"))
    return accounts.select("account").join(per, "account", "left").select("account", F.round(F.coalesce("inflow", F.lit(0.0)), 2).alias("inflow"))


def incidents(ledger: DataFrame, nsf: list[str], overdraft: list[str]) -> DataFrame:
    """Debits whose description speaks of insufficient funds or of an overdraft."""
    debit = F.col("type") == "DEBIT"
    has = lambda words: (debit & F.coalesce(F.col("description").rlike("(?i)" + "|".join(words)), F.lit(False))).cast("int")
    return ledger.withColumns({"nsf": has(nsf), "overdraft_fee": has(overdraft)}).withColumn("overdraft", F.greatest("nsf", "overdraft_fee"))


def overdraft_counters(ledger: DataFrame, accounts: DataFrame, as_of: datetime.date, nsf: list[str], overdraft: list[str]) -> DataFrame:
    """Nine counters, three flags in three windows, by one aggregation."""
    rows = aged(incidents(ledger, nsf, overdraft), as_of)
    aggs = [F.sum(F.when(within(d), F.col(flag)).otherwise(0)).alias(f"{flag}_{k}") for flag in ("nsf", "overdraft_fee", "overdraft") for k, d in WINDOWS.items()]
    per = rows.groupBy("account").agg(*aggs)
    return accounts.select("account").join(per, "account", "left").na.fill(0)


def history_days(ledger: DataFrame, as_of: datetime.date) -> DataFrame:
    """Days from the first credit of each window to the as-of date."""
    rows = aged(ledger, as_of).where("type = 'CREDIT'")
    return rows.groupBy("account").agg(*[F.coalesce(F.max(F.when(within(d), F.col("age"))), F.lit(0)).cast("long").alias(f"days_{k}") for k, d in WINDOWS.items()])


def average_monthly(ledger: DataFrame, as_of: datetime.date) -> DataFrame:
    """Sum of each window brought to 30 days once the filtered history reaches 30 days."""
    rows = aged(ledger, as_of)
    per = rows.groupBy("account").agg(F.max("age").alias("period"), *[_sum(within(d)).alias(f"sum_{k}") for k, d in WINDOWS.items()])
    span = lambda d: F.col("period") if d is None else F.least(F.col("period"), F.lit(d))
    return per.select("account", *[F.round(F.when(F.col("period") >= 30, F.col(f"sum_{k}") * 30 / span(d)).otherwise(F.col(f"sum_{k}")), 4).alias(f"monthly_{k}") for k, d in WINDOWS.items()])


def distinct_clusters(ledger: DataFrame, as_of: datetime.date) -> DataFrame:
    """Distinct clusters seen in each window."""
    return aged(ledger, as_of).groupBy("account").agg(*[F.countDistinct(F.when(within(d), F.col("cluster"))).alias(f"clusters_{k}") for k, d in WINDOWS.items()])


def latest_balance(rows: DataFrame) -> DataFrame:
    """Of several balance rows of an account the one with the last date; ties by the largest balance."""
    order = Window.partitionBy("account").orderBy(F.desc("date"), F.desc("balance"))
    return rows.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def truncate(ledger: DataFrame, as_of: datetime.date | Column, months: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows up to the as-of date, from the first day of the last row's month less ``months``.

    ``by``: the columns that tell one customer's request from another's, each with a last row of its own; without
    any the ledger is one request.  ``as_of`` may be a column."""
    rows = ledger.where(F.col("date") <= F.lit(as_of))
    first = F.trunc(F.add_months(F.max("date"), -months), "MM").alias("first")
    if not by:
        return rows.join(F.broadcast(rows.agg(first)), F.col("date") >= F.col("first")).drop("first")  # one row
    return rows.join(rows.groupBy(*by).agg(first), list(by)).where(F.col("date") >= F.col("first")).drop("first")


def daily_net(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("account", "date").agg(F.sum(signed_amount()).alias("net"))


def daily_series(ledger: DataFrame) -> DataFrame:
    """Dense days from the day before an account's first row to the day after its last, with the running net."""
    net = daily_net(ledger)
    span = net.groupBy("account").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = span.select("account", F.explode(F.sequence(F.date_sub("a", 1), F.date_add("b", 1))).alias("date"))
    run = Window.partitionBy("account").orderBy("date")
    return days.join(net, ["account", "date"], "left").select("account", "date", F.round(F.sum(F.coalesce("net", F.lit(0.0))).over(run), 2).alias("running"))


def balance_history(ledger: DataFrame, accounts: DataFrame, as_of: datetime.date) -> DataFrame:
    """Mean start-of-day balance, by 30-day buckets back from the as-of date and over buckets.

    A row changes the start balance of its own and of all earlier days, so that it counts in a bucket as often as the
    bucket has such days: one sum a bucket, without a row for each day.  Only 180 days matter."""
    age, widths = F.datediff(F.lit(as_of), "date"), range(0, BALANCE_DAYS, BUCKET_DAYS)
    recent = lambda days, value: F.sum(F.when(age < days, value))
    per = ledger.where(F.col("date") <= F.lit(as_of)).groupBy("account").agg(
        F.min("date").alias("first"), recent(BALANCE_DAYS, signed_amount()).alias("moved"),
        *[recent(k + BUCKET_DAYS, signed_amount() * (k + BUCKET_DAYS - F.greatest(age, F.lit(k)))).alias(f"moved_{k}") for k in widths],
    )
    oldest = F.least(F.coalesce(F.datediff(F.lit(as_of), "first"), F.lit(0)), F.lit(BALANCE_DAYS - 1))
    rows = accounts.select("account", "balance").join(per, "account", "left").withColumn("oldest", F.when(F.lit(as_of).isNotNull(), oldest)).where("oldest is not null")

    def mean(k: int) -> Column:
        # days of the bucket before the account's first row have no balance
        missing = F.greatest(F.lit(k + BUCKET_DAYS - 1) - F.col("oldest"), F.lit(0))
        moved = F.coalesce(f"moved_{k}", F.lit(0.0)) - F.when(missing > 0, missing * F.coalesce("moved", F.lit(0.0))).otherwise(0.0)
        return F.when(F.col("oldest") >= k, (F.col("balance") * (BUCKET_DAYS - missing) - moved) / (BUCKET_DAYS - missing))

    def over(days: int) -> Column:
        means = F.array_compact(F.array(*[mean(k) for k in widths if k < days]))
        return F.round(F.when(F.size(means) > 0, F.aggregate(means, F.lit(0.0), lambda t, m: t + m) / F.size(means)), 4)

    return rows.select("account", over(90).alias("balance_3m"), over(180).alias("balance_6m"), over(BALANCE_DAYS).alias("balance_all"))
