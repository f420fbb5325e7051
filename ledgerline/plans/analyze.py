"""Whole analyses: labelling and the tables of a report, for all customers at once."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import clusters as K
from ..operators import income as I
from ..operators import lookup as L
from ..operators import calendar as C
from ..operators import money as M
from ..operators import reports as R
from ..operators import text_clusters as X
from ..operators.lineage import cut as cut_lineage
from ..operators.peaks import peak_features


#: Days before the as-of date that pay-day patterns look back.
CALENDAR_DAYS = 3_660


@dataclass
class Config:
    """Settings of one job; nothing is global."""

    months: int | None = None
    distance: float = X.DISTANCE
    rules: list[tuple[str, list[str]]] = field(default_factory=lambda: [
        ("loan", [r"\bloan", r"\blend", r"cash advance"]), ("benefit", [r"\bssa\b", r"social security", r"unemployment"]), ("transfer", [r"\btransfer\b", r"\bzelle\b", r"\bp2p\b"]),
        ("deposit", [r"\bdeposit\b"]), ("gig", [r"\bdriver pay\b", r"\bcourier\b"]), ("payroll", [r"\bpayroll\b", r"\bsalary\b", r"\bdir dep\b"]),
    ])
    #: whether pay-day patterns name days and tell two weeks from half months; the plan gets several times as long,
    #: which pays for many customers and not for a few
    patterns: bool = False
    #: whether loans are clustered again at a looser cut and payroll and benefits merged
    recluster: bool = False
    nsf: list[str] = field(default_factory=lambda: [r"\bnsf", r"\binsufficient\b", r"\breturned item\b", r"\bunpaid item\b"])
    overdraft: list[str] = field(default_factory=lambda: [r"\boverdraft\b", r"\bod fee\b"])


def label(ledger: DataFrame, config: Config | None = None, edits: DataFrame | None = None) -> DataFrame:
    """Adds ``cluster``, ``label`` and ``label_source``.

    Texts are cleaned and clustered per account (by ``entity`` first, where the ledger has that column); rules label rows, the majority of a cluster's labels (earlier
    ones in ``known_label``, if there, before rules' ones) labels the rest, hand edits win, and keyword
    corrections come last.
    """
    config = config or Config()
    rows = ledger if "known_label" in ledger.columns else ledger.withColumn("known_label", F.lit(None).cast("string"))
    # computed once: every table of a report reads it, and the expression is long
    rows = cut_lineage(rows.withColumn("clean", T.clean_for_clusters(T.clean_for_ngrams(F.coalesce("description", F.lit(""))))))
    if "entity" in rows.columns:
        rows = X.entity_clusters(rows.drop("cluster"), config.distance)
    else:
        found = X.text_clusters(rows, "clean", config.distance).withColumnRenamed("text", "clean")
        rows = rows.drop("cluster").join(found, ["account", "clean"], "left").withColumn("cluster", F.coalesce("cluster", F.lit("text_none")))
    rows = rows.withColumn("ruled", T.regex_label(F.col("clean"), config.rules)).withColumn("seen", F.coalesce("known_label", "ruled"))
    major = K.triage(rows, "seen").select("account", "cluster", "majority")
    rows = rows.join(major, ["account", "cluster"], "left")
    name, source = L.cascade(("rules", F.col("ruled")), ("history", F.col("known_label")), ("cluster", F.col("majority")), ("none", F.lit("other")))
    rows = rows.withColumns({"label": name, "label_source": source})
    if edits is not None:
        rows = L.agent_override(rows, edits)
    rows = rows.withColumn("label", T.corrected_label(F.col("label"), F.col("clean"), F.col("type")))
    if config.recluster:
        rows = X.reclustered(rows) if "entity" in rows.columns else X.reclustered(rows.withColumn("entity", F.lit(None).cast("string"))).drop("entity")
    return rows.drop("clean", "ruled", "seen", "majority", "known_label")


def calendar_of(rows: DataFrame, as_of: datetime.date | Column) -> DataFrame:
    """Business days around the as-of date, or around the first and last one of a column."""
    ends = rows.agg(F.min(as_of), F.max(as_of)).first() if isinstance(as_of, Column) else (as_of, as_of)
    begin, end = (d or datetime.date.today() for d in ends)  # no rows, no pay days to place
    return C.business_calendar(rows.sparkSession, begin - datetime.timedelta(days=CALENDAR_DAYS), end + datetime.timedelta(days=60))


def analyze(labelled: DataFrame, accounts: DataFrame, as_of: datetime.date | Column, config: Config | None = None) -> dict[str, DataFrame]:
    """Tables of a report.  ``accounts``: account, balance, account_type.

    ``as_of`` is a date or a column that follows from ``account`` (see ``per_request``); with ``request_id`` among the
    accounts' columns, accounts are recommended within a request.  Each is a plan over the same labelled ledger; persist or write that first if several are taken.
    """
    config = config or Config()
    rows = labelled.where(F.col("date") <= F.lit(as_of))
    if config.months is not None:
        rows = M.truncate(rows, as_of, config.months, ("request_id",) if "request_id" in rows.columns else ())
    kinds = {"Payroll": "payroll", "Benefit": "benefit", "Transfer": "transfer", "gig": "gig"}
    kind = F.coalesce(*[F.when(F.col("label") == name, kind) for kind, name in kinds.items()])
    calendar = calendar_of(labelled, as_of).persist() if config.patterns else None
    sources = I.income_sources(rows.where(F.col("label").isin(*kinds.values())), as_of, kind, calendar).persist()  # most tables read it
    ranked = I.ranked(sources)
    loans = I.loan_sources(rows.where("label = 'loan'"))
    return {
        "income_sources": ranked,
        "loan_sources": loans,
        "model_input": R.model_input(sources, loans, accounts, list(kinds)),
        "recurring_income": R.recurring_monthly(sources, accounts),
        "debit_date": R.debit_date(sources, ["account"]),
        "income_counts": I.counts_by_recency(sources, as_of),
        "income_history": M.history_days(rows.where(F.col("label").isin(*kinds.values())), as_of),
        "monthly_income": M.average_monthly(rows.where((F.col("type") == "CREDIT") & F.col("label").isin(*kinds.values())), as_of),
        "monthly_loan_payments": M.average_monthly(rows.where("type = 'DEBIT' and label = 'loan'"), as_of),
        "cashflow": M.cashflow(rows, accounts, as_of),
        "net_cashflow": M.net_cashflow(rows, accounts, as_of),
        "overdrafts": M.overdraft_counters(rows, accounts, as_of, config.nsf, config.overdraft),
        "balances": M.balance_history(rows, accounts, as_of),
        "ability_to_pay": peak_features(M.daily_series(rows)),
        "top_income": I.regular_top(sources),
        "recommended_account": I.recommended_account(sources, accounts, ["CHECKING", "SAVINGS"], ("request_id",) if "request_id" in accounts.columns else ()),
    }


def customer_level(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """The ledger with each account's rows again under its customer: account level and customer level in one pass.

    ``owners``: account, customer.  Customers with a single account are left out."""
    several = owners.groupBy("customer").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    joint = rows.join(owners.join(several, "customer"), "account").drop("account").withColumnRenamed("customer", "account")
    return rows.withColumn("level", F.lit("account")).unionByName(joint.withColumn("level", F.lit("customer")))
