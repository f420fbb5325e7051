"""Roll-ups, model input, reasons and recommendations over sources, cash flow and risk scores."""

from __future__ import annotations

import datetime
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .income import amount_range

#: Cuts of alerts and insights, of the repeat score and of recommended amounts.
GOOD_HISTORY_DAYS, LOW_MONTHLY_INCOME, HIGH_DEBITS, LOW_RISK_SCORE = 30, 0, 50_000, 50
REPEAT_MEDIUM, REPEAT_HIGH = 150, 215
LOAN = (2.988, 3.928, 300.0, 1000.0)
PAYMENT = (0.843, 1.185, 90.0, 300.0)
#: Error codes of "no source found", of sources not paid any more, and the codes that still count as income.
NOT_FOUND, ABSENT = (101, 102, 103, 104, 105), (401, 402)
VALID = (0, 201, 202, 203, 205, 401, 402, 403, 405)
WEEK = 7
#: Texts of alerts, insights and reasons.
SHORT_INCOME = "Increased Default Risk: Income Detected for < 30 Consecutive Days"
NO_INCOME = "Increased Default Risk: No Active Income Detected"
HIGH_EXPENSES = "High Repeat Opportunity: High Monthly Expenses"
PAYROLL_ABSENT = "Recent Payroll Absent - Job Loss Risk"
LOANS_FUNDED = " Loan(s) Funded within the week"
RECENT_OVERDRAFT = "Recent Overdraft Identified"
BAD_SPENDING = "Unfavorable Spending Ratio - High Risk"
LOANS_PAID = " Loan Payment(s) made this week"
GOOD_SPENDING = "Good Spending Ratio - Low Risk"
#: Ranges of values that a global rank counts apart, at least and at most, and distinct values of one between.
RANGES, MOST_RANGES, RANGE_VALUES = 64, 1_000, 1_000_000


def recurring_monthly(sources: DataFrame, accounts: DataFrame) -> DataFrame:
    """Monthly income of active and of recurring sources without an error; null for accounts without any."""
    ok = F.col("error_code") == 0
    per = sources.groupBy("account").agg(F.round(F.sum(F.when(ok & (F.col("active_score") == 3), F.col("monthly_income"))), 2).alias("active_monthly_income"), F.round(F.sum(F.when(ok & (F.col("recurring_score") == 3), F.col("monthly_income"))), 2).alias("recurring_monthly_income"))
    return accounts.select("account").join(per, "account", "left")


def by_score(sources: DataFrame, score: str, amount: str = "monthly_income") -> DataFrame:
    """Counts and sums of an account's sources for each score 0 to 3, wide, by one conditional aggregation."""
    cells = []
    for k in range(4):
        on = F.col(score) == k
        cells += [F.count_if(on).alias(f"{score}_{k}_count"), F.round(F.coalesce(F.sum(F.when(on, F.col(amount))), F.lit(0.0)), 4).alias(f"{score}_{k}_sum")]
    return sources.groupBy("account").agg(*cells)


def loan_rollup(loans: DataFrame, accounts: DataFrame) -> DataFrame:
    """Loan sources without an error per account: their number, payments and originations; zeros without any."""
    per = loans.where("error_code = 0").groupBy("account").agg(F.count("*").alias("n_loans"), F.sum("n_payments").alias("n_payments"), F.sum("n_originations").alias("n_originations"))
    return accounts.select("account").join(per, "account", "left").na.fill(0)


def spine(accounts: DataFrame, *parts: DataFrame, fill: float | None = 0) -> DataFrame:
    """One row per account with the columns of every part; numbers that are missing become ``fill``.

    All joins are on the account, so that one exchange of each part serves them."""
    out = accounts
    for part in parts:
        out = out.join(part, "account", "left")
    return out if fill is None else out.na.fill(fill)


def model_input(sources: DataFrame, loans: DataFrame, accounts: DataFrame, kinds: list[str], *more: DataFrame) -> DataFrame:
    """Features of the risk models: sources by kind and by score, loans, and other tables by account."""
    cells = []
    for kind in kinds:
        on = F.col("income_type") == kind
        cells += [F.count_if(on).alias(f"{kind}_count"), F.round(F.coalesce(F.sum(F.when(on, F.col("monthly_income"))), F.lit(0.0)), 4).alias(f"{kind}_sum")]
    kept = sources.where(~F.col("error_code").isin(*NOT_FOUND))
    by_kind = kept.groupBy("account").agg(*cells)
    return spine(accounts.select("account"), by_kind, by_score(kept, "active_score"), by_score(kept, "recurring_score"), loan_rollup(loans, accounts), *more)


def alerts_and_insights(rows: DataFrame, risk: DataFrame, reasons: DataFrame) -> DataFrame:
    """Per account: risk_behavior, alerts and insights.

    ``rows``: account, income_history_days, active_monthly_income, debit.  ``risk``: account, score.  ``reasons``:
    account, bad (array).  An account at risk has its bad reasons as alerts."""
    joined = rows.join(risk.select("account", "score"), "account", "left").join(reasons.select("account", "bad"), "account", "left")
    risky = F.coalesce(F.col("score") <= LOW_RISK_SCORE, F.lit(False))
    own = F.array_compact(F.array(
        F.when(F.coalesce("income_history_days", F.lit(0)) <= GOOD_HISTORY_DAYS, SHORT_INCOME),
        F.when(F.coalesce("active_monthly_income", F.lit(0.0)) <= LOW_MONTHLY_INCOME, NO_INCOME),
    ))
    insights = F.array_compact(F.array(F.when(F.coalesce("debit", F.lit(0.0)) >= HIGH_DEBITS, HIGH_EXPENSES)))
    return joined.select("account", F.when(risky, "YES").otherwise("NO").alias("risk_behavior"), F.when(risky, F.coalesce("bad", F.array().cast("array<string>"))).otherwise(own).alias("alerts"), insights.alias("insights"))


def universal_reasons(accounts: DataFrame, sources: DataFrame, ledger: DataFrame, spending: DataFrame, as_of: datetime.date, incident: Column, loan: Column) -> DataFrame:
    """(account, bad, good): reasons that hold whatever the score.

    ``incident`` and ``loan`` are conditions on ledger rows; ``spending``: account, days_to_spend (mean days in which
    a pay is spent).  One conditional aggregation of the last week and one of the sources."""
    recent = ledger.where((F.col("date") >= F.date_sub(F.lit(as_of), WEEK)) & (F.col("date") <= F.lit(as_of)))
    side = lambda t: F.count_if(F.coalesce(loan, F.lit(False)) & (F.col("type") == t))
    week = recent.groupBy("account").agg(side("CREDIT").alias("funded"), side("DEBIT").alias("paid"), F.count_if(F.coalesce(incident, F.lit(False))).alias("incidents"))
    absent = sources.where(F.col("error_code").isin(*ABSENT)).select("account").distinct().withColumn("absent", F.lit(True))
    rows = accounts.select("account").join(week, "account", "left").join(absent, "account", "left").join(spending.select("account", "days_to_spend"), "account", "left")
    some = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    bad = F.array(
        F.when(F.col("absent"), PAYROLL_ABSENT), F.when(some("funded"), F.concat(F.col("funded").cast("string"), F.lit(LOANS_FUNDED))),
        F.when(some("incidents"), RECENT_OVERDRAFT), F.when(F.col("days_to_spend") <= 3, BAD_SPENDING),
    )
    good = F.array(F.when(some("paid"), F.concat(F.col("paid").cast("string"), F.lit(LOANS_PAID))), F.when(F.col("days_to_spend") >= 7, GOOD_SPENDING))
    return rows.select("account", F.array_compact(bad).alias("bad"), F.array_compact(good).alias("good"))


def combined_reasons(accounts: DataFrame, model: DataFrame, universal: DataFrame, covered: dict[str, str] | None = None) -> DataFrame:
    """(account, bad, good): a model's reasons (account, sign, rank, reason) in the order of rank, then universal ones,
    each once; a reason goes where one stands that covers it.  Accounts with one side only stay."""
    side = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("sign") == s, F.struct("rank", "reason")))), lambda x: x["reason"])
    of_model = model.where("reason is not null").groupBy("account").agg(side(1).alias("m_bad"), side(-1).alias("m_good"))
    rows = accounts.select("account").join(of_model, "account", "left").join(universal, "account", "left")
    none = F.array().cast("array<string>")

    def merged(name: str) -> Column:
        out = every = F.array_distinct(F.concat(F.coalesce(f"m_{name}", none), F.coalesce(name, none)))
        for reason, cover in (covered or {}).items():
            out = F.when(F.array_contains(every, cover), F.array_remove(out, reason)).otherwise(out)
        return out

    return rows.select("account", merged("bad").alias("bad"), merged("good").alias("good"))


def both_sided(bad: DataFrame, good: DataFrame) -> DataFrame:
    """Accounts that have reasons of both sides, as arrays in the order of reasons."""
    lists = lambda df, name: df.groupBy("account").agg(F.array_sort(F.collect_set("reason")).alias(name))
    return lists(bad, "bad").join(lists(good, "good"), "account")


def repeat_opportunity(score: Column) -> Column:
    return F.when(score >= REPEAT_HIGH, "High").when(score >= REPEAT_MEDIUM, "Medium").otherwise("Low")


def debit_date(sources: DataFrame, keys: list[str]) -> DataFrame:
    """Income type, frequency and day to debit: of the active regular source with the largest income; else, if some
    active one is irregular, weekly on a day that the customer is asked for; else none."""
    active = sources.where((F.col("error_code") == 0) & (F.col("active_score") == 3))
    regular = F.col("frequency") != "I"
    best = active.groupBy(*keys).agg(F.min(F.when(regular, F.struct((-F.col("monthly_income")).alias("m"), "cluster", "income_type", "frequency", "regular_day"))).alias("x"), F.min(F.when(~regular, F.struct((-F.col("monthly_income")).alias("m"), "cluster", "income_type"))).alias("y"))
    found = F.col("x").isNotNull()
    return best.select(*keys, F.when(found, F.col("x.income_type")).otherwise(F.col("y.income_type")).alias("income_type"), F.when(found, F.col("x.frequency")).otherwise(F.lit("W")).alias("debit_frequency"), F.when(found, F.col("x.regular_day")).otherwise(F.lit("ask customer")).alias("debit_date"))


def near_holiday(sources: DataFrame, keys: list[str]) -> DataFrame:
    """Behaviour at free days of the active regular source with the largest income, or of the irregular one without it.

    ``sources`` has holiday_direction (A, B or null) and next_on_holiday."""
    active = sources.where((F.col("error_code") == 0) & (F.col("active_score") == 3))
    order = F.struct(F.when(F.col("frequency") != "I", 0).otherwise(1).alias("irregular"), (-F.col("monthly_income")).alias("m"), "cluster", "holiday_direction", "next_on_holiday")
    best = active.groupBy(*keys).agg(F.min(order).alias("x"))
    return best.select(*keys, F.coalesce(F.col("x.holiday_direction"), F.lit("None")).alias("payment_near_holiday"), F.col("x.next_on_holiday").alias("next_payment_on_holiday"))


def lending_guide(risk: DataFrame, sources: DataFrame, repeat: DataFrame, keys: list[str]) -> DataFrame:
    """Amounts, debit date, holiday behaviour and repeat opportunity by ``keys`` (account, or customer).

    ``risk`` and ``repeat``: keys and score, of which the largest counts.  Keys without one of the parts drop out."""
    top = risk.groupBy(*keys).agg(F.max("score").alias("score"))
    loan, payment = amount_range(F.col("score"), *LOAN), amount_range(F.col("score"), *PAYMENT)
    amounts = top.select(*keys, loan[0].alias("min_loan"), loan[1].alias("max_loan"), payment[0].alias("min_debit"), payment[1].alias("max_debit"))
    again = repeat.groupBy(*keys).agg(repeat_opportunity(F.max("score")).alias("repeat_opportunity"))
    return amounts.join(debit_date(sources, keys), keys).join(near_holiday(sources, keys), keys).join(again, keys)


def recommended_by_score(sources: DataFrame, accounts: DataFrame, risk: DataFrame, types: str = "(?i)saving|checking") -> DataFrame:
    """Per customer the account to debit: savings and checking accounts, those with an active regular income first,
    then by risk score, then by id.  ``accounts``: customer, account, account_type."""
    has = sources.where((F.col("active_score") == 3) & (F.col("frequency") != "I") & (F.col("error_code") == 0)).select("account").distinct().withColumn("has", F.lit(1))
    rows = accounts.where(F.col("account_type").rlike(types)).join(has, "account", "left").join(risk.select("account", "score"), "account", "left")
    order = F.struct((-F.coalesce("has", F.lit(0))).alias("h"), (-F.coalesce("score", F.lit(0))).alias("s"), "account")
    return rows.groupBy("customer").agg(F.min(order).alias("x")).select("customer", F.col("x.account").alias("account"), (-F.col("x.h")).alias("has_income"))


def hit_rates(rows: DataFrame, source: str = "label_source") -> DataFrame:
    """How many rows each source of labels has labelled, and its share."""
    counts = rows.groupBy(source).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select(source, "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))  # one row


def global_rank(rows: DataFrame, value: str) -> DataFrame:
    """``rank`` of each row by value, largest first, ties sharing the least rank: the number of larger values and one.

    Counts of distinct values are summed within and between ranges of values, whose borders are approximate
    quantiles, so that no task holds all rows."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c"))
    ranges = min(MOST_RANGES, max(RANGES, counts.count() // RANGE_VALUES))
    borders = sorted(set(counts.approxQuantile(value, [k / ranges for k in range(1, ranges)], 0.5 / ranges)))
    part = F.size(F.filter(F.array(*[F.lit(b) for b in borders]), lambda b: b > F.col(value))) if borders else F.lit(0)
    ranged = counts.withColumn("part", part)
    # at most MOST_RANGES rows
    below = ranged.groupBy("part").agg(F.sum("c").alias("n"))
    before = below.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "before")
    inside = F.sum("c").over(Window.partitionBy("part").orderBy(F.desc(value))) - F.col("c")
    ranks = ranged.join(F.broadcast(before), "part").select(F.col(value), (F.col("before") + inside + 1).alias("rank"))
    return rows.join(ranks, value)


def _uniform(key: Column, name: str, seed: int) -> Column:
    """A number in [0, 1) from a row's key alone."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(name), key.cast("string")), 256), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def augmented(rows: DataFrame, share: float, low: float, high: float, seed: int = 7, key: str = "txn_id") -> DataFrame:
    """Rows drawn with replacement (Poisson of mean ``share``) whose amounts are scaled by a factor of [low, high), for
    training; both follow from a hash of the row's key, however rows are dealt."""
    reach, term, steps = 0.0, math.exp(-share), []
    while term > 1e-12 or len(steps) < share:
        reach += term
        steps.append(reach)
        term *= share / len(steps)
    u = _uniform(F.col(key), "copies", seed)
    copies = sum((F.when(u >= s, 1).otherwise(0) for s in steps), F.lit(0))
    drawn = rows.select("*", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))).alias("copy"))
    factor = _uniform(F.concat_ws(":", F.col(key).cast("string"), F.col("copy").cast("string")), "factor", seed) * (high - low) + low
    return drawn.withColumn("amount", F.round(F.col("amount") * factor, 2))
