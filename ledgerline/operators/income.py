"""Income and loan sources: one parameterised builder, ranks and recommendations."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clusters import KEYS, KNOWN
from .frequency import RECENCY, RECENCY_OTHER, by_frequency, judged, kept, pay_counts, pay_patterns, score_counts, scored

LOW_PAY = 10
LOAN_MIN = 50
#: Stands between kind and cluster while sources of all kinds are made at once.
BETWEEN = "\x01"
#: Last digit of a kind's error codes.
KINDS = {"Payroll": 1, "Benefit": 2, "gig": 3, "loan": 4, "Transfer": 5}


def pay_days(ledger: DataFrame) -> DataFrame:
    """One row per account, cluster and day: amount and gap of all its rows, paid and paid_amount of those that are
    ``kept``, and the days since the cluster's previous day that has any (paid_gap)."""
    marked = ledger.withColumn("kept", kept(F.col("amount")))
    days = marked.groupBy(*KEYS, "date").agg(F.sum("amount").alias("amount"), F.sum(F.when(F.col("kept"), F.col("amount"))).alias("paid_amount"), F.count_if("kept").alias("paid"))
    order = Window.partitionBy(*KEYS).orderBy("date")
    before = F.last(F.when(F.col("paid") > 0, F.col("date")), True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return days.select(*KEYS, "date", "amount", "paid_amount", "paid", F.datediff("date", F.lag("date").over(order)).alias("gap"), F.datediff("date", before).alias("paid_gap"))


def income_sources(ledger: DataFrame, as_of: datetime.date, kind: str | Column = "Payroll", calendar: DataFrame | None = None) -> DataFrame:
    """One row per account and cluster of credits, with frequency, amounts, scores and an error code.

    Codes: 30x mean pay below 10 (no id), 20x one pay day, 40x last pay day too old (payroll and benefit: by
    frequency, irregular ones never), else 0; 10x rows come from ``with_missing``.  Ids count within an account and
    kind by cluster.  ``kind`` may be a column, so that sources of all kinds are made in one pass: rows of one
    cluster and different kinds are different sources.
    """
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    credits = ledger.where("type = 'CREDIT'").withColumn("cluster", F.concat(kind, F.lit(BETWEEN), F.coalesce("cluster", F.lit(""))))
    days = pay_days(credits)
    if calendar is not None:
        days = days.persist()  # every pattern reads the pay days
    rows = days.groupBy(*KEYS).agg(*score_counts(), *pay_counts("paid_amount", "paid_gap", "paid > 0"))
    if calendar is not None:
        rows = rows.join(pay_patterns(days.where("paid > 0"), calendar), list(KEYS), "left")
    rows = scored(judged(rows, calendar is not None), as_of).withColumns({"pays": F.col("n"), "pay": F.col("mean"), "variation": F.round("variation", 4)})
    none = ~(F.expr(KNOWN) & (F.col("n_pays") > 0))  # clusters without a frequency have no scores either
    judgements = ("monthly_amount", "regular_day", "same_day_share", "active_score", "recurring_score", "stability_score", "variation")
    rows = rows.withColumns({c: F.when(~none, F.col(c)) for c in judgements} | {"frequency": F.when(none, "I").otherwise(F.col("frequency"))})
    age = F.datediff(F.lit(as_of), "last")
    kind = F.split_part(F.col("cluster"), F.lit(BETWEEN), F.lit(1))
    late = F.when(kind.isin("Payroll", "Benefit"), (age > by_frequency(F.col("frequency"), RECENCY, RECENCY_OTHER)) & (F.col("frequency") != "I")).otherwise(age > RECENCY_OTHER)
    digit = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in KINDS.items()])
    code = F.when(F.col("pay") < LOW_PAY, 300 + digit).when(F.col("pays") == 1, 200 + digit).when(late, 400 + digit).otherwise(0)
    rows = rows.withColumn("error_code", code)
    monthly = F.coalesce("monthly_amount", F.lit(0.0))
    stable = F.when(F.col("stability_score") == 3, monthly).otherwise(monthly * (1 - F.coalesce("variation", F.lit(1.0))))
    number = F.row_number().over(Window.partitionBy("account", kind).orderBy(F.when(F.col("error_code") == 300 + digit, 1).otherwise(0), "cluster"))
    ident = F.when(F.col("error_code") != 300 + digit, F.format_string("I%d_err_%d", number, "error_code"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.select(
        "account", F.split_part(F.col("cluster"), F.lit(BETWEEN), F.lit(2)).alias("cluster"), ident.alias("source_id"), kind.alias("income_type"), "pays", "frequency", F.round("pay", 2).alias("pay"), F.round(monthly, 2).alias("monthly_income"), F.round(stable, 2).alias("stable_monthly_income"),
        "regular_day", F.coalesce("same_day_share", F.lit(0.0)).alias("same_day_share"), "last", zero("active_score").alias("active_score"), zero("recurring_score").alias("recurring_score"), zero("stability_score").alias("stability_score"), "error_code",
    )


def loan_sources(ledger: DataFrame) -> DataFrame:
    """Largest credit and debit of each cluster, their counts, the payment share and an error code.

    304: both amounts at most 50 and one above 0 (no id)."""
    side = lambda t, c: F.when(F.col("type") == t, F.col(c))
    per = ledger.groupBy(*KEYS).agg(F.coalesce(F.max(side("CREDIT", "amount")), F.lit(0.0)).alias("origination"), F.coalesce(F.max(side("DEBIT", "amount")), F.lit(0.0)).alias("payment"), F.count(side("CREDIT", "amount")).alias("n_originations"), F.countDistinct(side("DEBIT", "date")).alias("n_payments"), F.max("date").alias("last"))
    low = (F.col("origination") <= LOAN_MIN) & (F.col("payment") <= LOAN_MIN) & (F.greatest("origination", "payment") > 0)
    rows = per.withColumn("error_code", F.when(low, 304).otherwise(0))
    number = F.row_number().over(Window.partitionBy("account").orderBy("error_code", "cluster"))
    rate = F.when(F.col("origination") > 10, F.round(F.col("payment") / F.col("origination"), 6))
    return rows.select(*KEYS, F.when(F.col("error_code") == 0, F.format_string("L%d", number)).alias("source_id"), "origination", "payment", "n_originations", "n_payments", rate.alias("payment_share"), "last", "error_code")


def ranked(sources: DataFrame) -> DataFrame:
    """Sources of an account by monthly income, rows with an error after all others; ties by cluster.
    ``dominant`` marks the largest income among rows without an error, all of them on ties."""
    ok = F.col("error_code") == 0
    group = Window.partitionBy("account")
    top = F.max(F.when(ok, F.col("monthly_income"))).over(group)
    rank = F.row_number().over(group.orderBy((~ok).cast("int"), F.desc("monthly_income"), "cluster"))
    return sources.select("*", rank.alias("rank"), (ok & (F.col("monthly_income") == top)).cast("int").alias("dominant"))


def regular_top(sources: DataFrame) -> DataFrame:
    """Each account's active regular source of the largest monthly income; ties by cluster."""
    good = sources.where((F.col("error_code") == 0) & (F.col("active_score") == 3) & (F.col("frequency") != "I"))
    best = F.min(F.struct((-F.col("monthly_income")).alias("m"), "cluster", "income_type", "frequency", "regular_day"))
    return good.groupBy("account").agg(best.alias("x")).select("account", "x.cluster", "x.income_type", "x.frequency", "x.regular_day", (-F.col("x.m")).alias("monthly_income"))


def counts_by_recency(sources: DataFrame, as_of: datetime.date) -> DataFrame:
    """Sources without an error, all and with a last pay day in the last 180 and 90 days."""
    age = F.datediff(F.lit(as_of), "last")
    ok = F.col("error_code") == 0
    return sources.groupBy("account").agg(F.count_if(ok).alias("sources_all"), F.count_if(ok & (age <= 180)).alias("sources_6m"), F.count_if(ok & (age <= 90)).alias("sources_3m"))


def recommended_account(sources: DataFrame, accounts: DataFrame, types: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Per account type (within ``by``, columns of ``accounts``) the account to debit: those with an active regular income first, then by balance, then by id."""
    has = sources.where((F.col("active_score") == 3) & (F.col("frequency") != "I") & (F.col("error_code") == 0)).select("account").distinct().withColumn("has", F.lit(1))
    rows = accounts.where(F.col("account_type").isin(types)).join(has, "account", "left")
    order = F.struct((-F.coalesce("has", F.lit(0))).alias("h"), F.col("balance").isNull().alias("none"), (-F.col("balance")).alias("b"), "account")
    return rows.groupBy(*by, "account_type").agg(F.min(order).alias("x")).select(*by, "account_type", F.col("x.account").alias("account"), (-F.col("x.h")).alias("has_income"))


def amount_range(score: Column, low: float, high: float, least: float, most: float) -> tuple[Column, Column]:
    """Least and most to offer for a score: ratios clamped, floored and ceiled to tens."""
    clamp = lambda r: F.least(F.greatest(score * r, F.lit(least)), F.lit(most))
    return (F.floor(clamp(low) / 10) * 10).cast("long"), (F.ceil(clamp(high) / 10) * 10).cast("long")


def spending_days(ledger: DataFrame, pay: Column) -> DataFrame:
    """Days until debits after a pay day use up the pay, capped by the next pay day; one row per pay day.

    ``pay`` is the condition that makes a row a pay.  Debits join the pay period they fall into by a running
    count, not by a range join.
    """
    flagged = ledger.select("account", "date", "txn_id", "amount", "type", pay.alias("is_pay"))
    days = flagged.groupBy("account", "date").agg(F.sum(F.when(F.col("is_pay"), F.col("amount"))).alias("paid"), F.sum(F.when(F.col("type") == "DEBIT", F.col("amount")).otherwise(0.0)).alias("spent"))
    w = Window.partitionBy("account").orderBy("date")
    period = days.withColumn("period", F.count("paid").over(w)).where("period > 0")
    inside = Window.partitionBy("account", "period").orderBy("date")
    runs = period.select("account", "period", "date", F.first("paid").over(inside).alias("paid"), F.first("date").over(inside).alias("start"), F.sum("spent").over(inside).alias("spent"))
    return runs.groupBy("account", "start").agg(F.round(F.max("paid"), 2).alias("paid"), F.min(F.when(F.col("spent") >= F.col("paid"), F.datediff("date", "start"))).alias("days_to_spend"))


def with_missing(sources: DataFrame, accounts: DataFrame, kind: str) -> DataFrame:
    """Sources of a kind and, for each account that has none, a row whose error code (10x) says so."""
    none = accounts.select("account").join(sources.select("account").distinct(), "account", "left_anti")
    return sources.unionByName(none.select("account", F.lit(kind).alias("income_type"), F.lit(100 + KINDS[kind]).alias("error_code")), allowMissingColumns=True)


def combined_sources(*parts: DataFrame) -> DataFrame:
    """Sources of several kinds under ids that run on from kind to kind within an account, in the order given."""
    out = None
    for place, part in enumerate(parts):
        part = part.withColumn("_kind", F.lit(place))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    has = (F.col("error_code") >= 400) | (F.col("error_code") == 0) | F.col("error_code").between(200, 299)
    number = F.row_number().over(Window.partitionBy("account").orderBy(F.when(has, 0).otherwise(1), "_kind", "cluster"))
    return out.withColumn("source_id", F.when(has, F.format_string("I%d_err_%d", number, "error_code"))).drop("_kind")
