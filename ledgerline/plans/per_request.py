"""Many requests in one job, each with its own as-of date and time frame.

The measures group by ``account`` alone.  Here an account's key also says its request and as-of date, so that an
account in two requests is two keys and every measure finds the date in the key; the tables are split into
request and account again at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lookup import small
from .analyze import Config, analyze

#: Characters of the date that a key begins with.
DATE = 10


def key() -> Column:
    """Date, length of the request's id, that id and the account: no two triples give one key, whatever the ids hold."""
    request = F.col("request_id").cast("string")
    return F.concat(F.date_format("as_of", "yyyy-MM-dd"), F.length(request).cast("string"), F.lit(":"), request, F.col("account").cast("string"))


def as_of() -> Column:
    """The as-of date in a key."""
    return F.to_date(F.substring("account", 1, DATE))


def split(rows: DataFrame) -> DataFrame:
    """``rows`` with request_id (string), as_of and account in place of the key."""
    size = F.regexp_extract("account", rf"^.{{{DATE}}}(\d+):", 1)
    start = F.lit(DATE + 2) + F.length(size)
    request = F.col("account").substr(start, size.cast("int"))
    account = F.expr("account").substr(start + size.cast("int"), F.length("account"))
    others = [F.col(c) for c in rows.columns if c not in ("account", "request_id", "as_of")]
    return rows.select(request.alias("request_id"), as_of().alias("as_of"), account.alias("account"), *others)


def settings(requests: DataFrame) -> DataFrame:
    """One row (request_id, as_of, months) per request.

    ``requests``: request_id, as_of and, if there, months (null: all).  Requests without an id or a date are left out
    (they are errors of the parser); of repeated ids the row with the latest date, then the longest time frame, counts."""
    months = F.col("months").cast("int") if "months" in requests.columns else F.lit(None).cast("int")
    rows = requests.where("request_id is not null and as_of is not null").select(F.col("request_id").cast("string").alias("request_id"), F.col("as_of").cast("date").alias("as_of"), months.alias("months"))
    rank = F.struct("as_of", F.col("months").isNull().alias("whole"), "months")
    return rows.groupBy("request_id").agg(F.max(rank).alias("x")).select("request_id", "x.as_of", "x.months")


def keyed(ledger: DataFrame, accounts: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ledger and accounts, both with ``request_id``, under keys of request and account.

    Rows after their request's as-of date go; with a time frame so do those before the first day of the last row's
    month less ``months``, as in ``money.truncate``.  Rows of unknown requests have no place in a report.  Settings are
    broadcast if they are few by count, else joined by shuffle."""
    known = settings(requests)
    plain = lambda df: df.withColumn("request_id", F.col("request_id").cast("string")).drop("as_of", "months")
    rows = plain(ledger).join(small(known.drop("months")), "request_id").where(F.col("date") <= F.col("as_of"))
    # a time frame hangs on the last row of a request: a maximum each, combined before it is shuffled
    framed = known.where("months is not null").select("request_id", "months")
    last = rows.groupBy("request_id").agg(F.max("date").alias("last"))
    first = framed.join(last, "request_id").select("request_id", F.trunc(F.add_months("last", -F.col("months")), "MM").alias("first"))
    # at most a row a framed request: these are counted without a pass over the ledger
    rows = rows.join(small(first, framed), "request_id", "left").where(F.col("first").isNull() | (F.col("date") >= F.col("first")))
    owners = plain(accounts).join(small(known.drop("months")), "request_id")
    return rows.withColumn("account", key()).drop("as_of", "first"), owners.withColumn("account", key()).drop("as_of")


def analyze_requests(labelled: DataFrame, accounts: DataFrame, requests: DataFrame, config: Config | None = None) -> dict[str, DataFrame]:
    """The tables of ``analyze`` for all requests at once, each row with request_id, as_of and account.

    ``labelled`` and ``accounts`` as for ``analyze``, with ``request_id``; each request is cut at its own date and time
    frame, which stand in ``requests``.  A request's rows are those that ``analyze`` gives for it alone."""
    rows, owners = keyed(labelled, accounts, requests)
    return {name: split(table) for name, table in analyze(rows, owners, as_of(), config).items()}
