"""Queries over the star-schema tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import attributions as A
from ..operators import calendar as C
from ..operators import clusters as K
from ..operators import frequency as Q
from ..operators import income as I
from ..operators import lookup as L
from ..operators import money as M
from ..operators import peaks as P
from ..operators import scoring as S
from ..operators import text_clusters as X
from ..sources.adapters import EVENTS_SQL, ORDERS_SQL, accounts, events_ledger, last_date, orders_ledger, spread, table
from .registry import query


def _longs(df: DataFrame) -> DataFrame:
    """Integer columns as BIGINT, so that both engines return one type."""
    return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])


def _orders(spark: SparkSession, d: str):
    ledger = orders_ledger(spark, d)
    return ledger, accounts(spark, d), last_date(ledger)


def _events(spark: SparkSession, d: str):
    ledger = events_ledger(spark, d)
    return ledger, ledger.select("account").distinct(), last_date(ledger)


AGED = "aged AS (SELECT l.*, date_diff('day', l.date, a.d) AS age FROM ledger l CROSS JOIN day_ a)"
O, E = f"WITH {ORDERS_SQL}, {AGED}", f"WITH {EVENTS_SQL}, {AGED}"
SIGNED = "CASE WHEN type = 'CREDIT' THEN amount ELSE -amount END"


@query("cashflow", f"""{O}, per AS (SELECT account, sum(CASE WHEN type = 'CREDIT' THEN amount ELSE 0 END) AS c, sum(CASE WHEN type = 'DEBIT' THEN amount ELSE 0 END) AS b,
 greatest(1.0, max(age) / 30.0) AS m FROM aged GROUP BY account)
SELECT accounts.account, round(coalesce(c, 0.0), 2) AS credit, round(coalesce(b, 0.0), 2) AS debit, round(coalesce((c - b) / m, 0.0), 2) AS net_cash_flow, round(coalesce(b / m, 0.0), 2) AS spending
FROM accounts LEFT JOIN per ON per.account = accounts.account""")
def cashflow(spark, d):
    return M.cashflow(*_orders(spark, d))


@query("net_cashflow_windows", f"""{O}, per AS (SELECT account, max(age) AS t, sum({SIGNED}) AS s, sum(CASE WHEN age <= 180 THEN {SIGNED} ELSE 0 END) AS s6, sum(CASE WHEN age <= 90 THEN {SIGNED} ELSE 0 END) AS s3 FROM aged GROUP BY account)
SELECT accounts.account, round(coalesce(s / greatest(1.0, t / 30.0), 0.0), 4) AS net_cash_flow_all,
 round(coalesce(CASE WHEN t > 30 THEN s6 / (least(t, 180) / 30.0) ELSE s6 END, 0.0), 4) AS net_cash_flow_6m,
 round(coalesce(CASE WHEN t > 30 THEN s3 / (least(t, 90) / 30.0) ELSE s3 END, 0.0), 4) AS net_cash_flow_3m
FROM accounts LEFT JOIN per ON per.account = accounts.account""")
def net_cashflow_windows(spark, d):
    return M.net_cashflow(*_orders(spark, d))


@query("inflow_30d", f"""{E}, per AS (SELECT account, sum(amount) AS s FROM aged WHERE type = 'CREDIT' AND age <= 30 AND cluster NOT IN ('signup') AND NOT regexp_matches(lower(description), 'refund|clic') GROUP BY account)
SELECT x.account, round(coalesce(s, 0.0), 2) AS inflow FROM (SELECT DISTINCT account FROM ledger) x LEFT JOIN per ON per.account = x.account""")
def inflow_30d(spark, d):
    ledger, accts, as_of = _events(spark, d)
    return M.inflow(ledger, accts, as_of, 30, ["signup"], ["refund", "clic"])


_NSF, _OD = [r"\berror\b", r"\breturned item\b"], [r"\bpurchase\b", r"\boverdraft\b"]
_FLAGS = """flagged AS (SELECT *, CASE WHEN type = 'DEBIT' AND regexp_matches(lower(description), 'error|returned item') THEN 1 ELSE 0 END AS nsf,
 CASE WHEN type = 'DEBIT' AND regexp_matches(lower(description), 'purchase|overdraft') THEN 1 ELSE 0 END AS overdraft_fee FROM aged),
both_ AS (SELECT *, greatest(nsf, overdraft_fee) AS overdraft FROM flagged)"""
_COUNTS = ", ".join(f"CAST(sum(CASE WHEN {w} THEN {f} ELSE 0 END) AS BIGINT) AS {f}_{k}" for f in ("nsf", "overdraft_fee", "overdraft") for k, w in (("all", "true"), ("6m", "age <= 180"), ("3m", "age <= 90")))


@query("overdraft_counters", f"{E}, {_FLAGS} SELECT account, {_COUNTS} FROM both_ GROUP BY account")
def overdraft_counters(spark, d):
    return _longs(M.overdraft_counters(*_events(spark, d), _NSF, _OD))


@query("overdraft_incidents", f"{E}, {_FLAGS} SELECT account, txn_id, CAST(nsf AS BIGINT) AS nsf, CAST(overdraft_fee AS BIGINT) AS overdraft_fee FROM both_ WHERE overdraft = 1")
def overdraft_incidents(spark, d):
    return _longs(M.incidents(_events(spark, d)[0], _NSF, _OD).where("overdraft = 1").select("account", "txn_id", "nsf", "overdraft_fee"))


@query("income_history_days", f"{O} SELECT account, CAST(max(age) AS BIGINT) AS days_all, CAST(coalesce(max(CASE WHEN age <= 180 THEN age END), 0) AS BIGINT) AS days_6m, CAST(coalesce(max(CASE WHEN age <= 90 THEN age END), 0) AS BIGINT) AS days_3m FROM aged WHERE type = 'CREDIT' GROUP BY account")
def income_history_days(spark, d):
    ledger, _, as_of = _orders(spark, d)
    return M.history_days(ledger, as_of)


def _monthly(side: str) -> str:
    return f"""{O}, per AS (SELECT account, max(age) AS t, sum(amount) AS s, sum(CASE WHEN age <= 180 THEN amount ELSE 0 END) AS s6, sum(CASE WHEN age <= 90 THEN amount ELSE 0 END) AS s3 FROM aged WHERE type = '{side}' GROUP BY account)
SELECT account, round(CASE WHEN t >= 30 THEN s * 30 / t ELSE s END, 4) AS monthly_all, round(CASE WHEN t >= 30 THEN s6 * 30 / least(t, 180) ELSE s6 END, 4) AS monthly_6m, round(CASE WHEN t >= 30 THEN s3 * 30 / least(t, 90) ELSE s3 END, 4) AS monthly_3m FROM per"""


@query("avg_monthly_income", _monthly("CREDIT"))
def avg_monthly_income(spark, d):
    ledger, _, as_of = _orders(spark, d)
    return M.average_monthly(ledger.where("type = 'CREDIT'"), as_of)


@query("avg_monthly_loan_payment", _monthly("DEBIT"))
def avg_monthly_loan_payment(spark, d):
    ledger, _, as_of = _orders(spark, d)
    return M.average_monthly(ledger.where("type = 'DEBIT'"), as_of)


@query("loan_distinct_counts", f"{O} SELECT account, count(DISTINCT cluster) AS clusters_all, count(DISTINCT CASE WHEN age <= 180 THEN cluster END) AS clusters_6m, count(DISTINCT CASE WHEN age <= 90 THEN cluster END) AS clusters_3m FROM aged GROUP BY account")
def loan_distinct_counts(spark, d):
    ledger, _, as_of = _orders(spark, d)
    return M.distinct_clusters(ledger, as_of)


@query("latest_balance", f"WITH {ORDERS_SQL} SELECT account, date, balance FROM (SELECT account, date, amount AS balance, row_number() OVER (PARTITION BY account ORDER BY date DESC, amount DESC) AS rn FROM ledger) WHERE rn = 1")
def latest_balance(spark, d):
    return M.latest_balance(orders_ledger(spark, d).select("account", "date", F.col("amount").alias("balance")))


@query("truncate_3m", f"{O} SELECT account, txn_id, date, amount FROM ledger WHERE date >= (SELECT CAST(date_trunc('month', CAST(d - INTERVAL 3 MONTH AS DATE)) AS DATE) FROM day_)")
def truncate_3m(spark, d):
    ledger, _, as_of = _orders(spark, d)
    return M.truncate(ledger, as_of, 3).select("account", "txn_id", "date", "amount")


@query("daily_net_running", f"""WITH {EVENTS_SQL}, net AS (SELECT account, date, sum({SIGNED}) AS net FROM ledger GROUP BY account, date),
span AS (SELECT account, min(date) AS a, max(date) AS b FROM net GROUP BY account),
days AS (SELECT account, CAST(unnest(generate_series(CAST(a - 1 AS TIMESTAMP), CAST(b + 1 AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM span)
SELECT days.account, days.date, round(sum(coalesce(net, 0.0)) OVER (PARTITION BY days.account ORDER BY days.date), 2) AS running FROM days LEFT JOIN net ON net.account = days.account AND net.date = days.date""")
def daily_net_running(spark, d):
    return M.daily_series(events_ledger(spark, d))


@query("reverse_balance_monthly_avg", f"""{O}, net AS (SELECT account, date, sum({SIGNED}) AS net FROM ledger GROUP BY account, date),
first_ AS (SELECT account, min(date) AS f FROM ledger GROUP BY account),
span AS (SELECT a.account, a.balance, greatest(coalesce(f, d), CAST(d - 179 AS DATE)) AS s, d FROM accounts a CROSS JOIN day_ LEFT JOIN first_ ON first_.account = a.account),
days AS (SELECT account, balance, d, CAST(unnest(generate_series(CAST(s AS TIMESTAMP), CAST(d AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM span),
bal AS (SELECT days.account, date_diff('day', days.date, d) // 30 AS bucket, balance - sum(coalesce(net, 0.0)) OVER (PARTITION BY days.account ORDER BY days.date DESC) AS b FROM days LEFT JOIN net ON net.account = days.account AND net.date = days.date),
buckets AS (SELECT account, bucket, avg(b) AS m FROM bal GROUP BY account, bucket)
SELECT account, round(avg(CASE WHEN bucket < 3 THEN m END), 4) AS balance_3m, round(avg(CASE WHEN bucket < 6 THEN m END), 4) AS balance_6m, round(avg(m), 4) AS balance_all FROM buckets GROUP BY account""")
def reverse_balance_monthly_avg(spark, d):
    return M.balance_history(*_orders(spark, d))


DAYS = "days AS (SELECT account, cluster, date, sum(amount) AS amount, count(*) AS n FROM ledger GROUP BY account, cluster, date)"
GAPS = "gaps AS (SELECT *, date_diff('day', lag(date) OVER (PARTITION BY account, cluster ORDER BY date), date) AS gap FROM days)"
BIN = "CASE WHEN gap IS NULL OR gap <= 0 THEN '36+' WHEN gap <= 1 THEN '1' WHEN gap <= 5 THEN '2-5' WHEN gap <= 8 THEN '6-8' WHEN gap <= 12 THEN '9-12' WHEN gap <= 17 THEN '13-17' WHEN gap <= 24 THEN '18-24' WHEN gap <= 35 THEN '24-35' ELSE '36+' END"


@query("same_day_rollup", f"WITH {EVENTS_SQL}, {DAYS} SELECT account, cluster, date, round(amount, 2) AS amount, n FROM days")
def same_day_rollup(spark, d):
    return K.same_day(events_ledger(spark, d)).withColumn("amount", F.round("amount", 2))


@query("interval_bins", f"WITH {EVENTS_SQL}, {DAYS}, {GAPS} SELECT {BIN} AS bin, count(*) AS n FROM gaps GROUP BY 1")
def interval_bins(spark, d):
    return K.gaps(K.same_day(events_ledger(spark, d))).groupBy(K.interval_bin(F.col("gap")).alias("bin")).agg(F.count("*").alias("n"))


@query("interval_histogram_top2", f"""WITH {EVENTS_SQL}, {DAYS}, {GAPS}, counts AS (SELECT account, cluster, {BIN} AS bin, count(*) AS n FROM gaps GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY account, cluster ORDER BY n DESC, bin) AS rank, sum(n) OVER (PARTITION BY account, cluster) AS total FROM counts)
SELECT account, cluster, CAST(rank AS BIGINT) AS rank, bin, round(CAST(n AS DOUBLE) / CAST(total AS DOUBLE), 6) AS share FROM ranked WHERE rank <= 2""")
def interval_histogram_top2(spark, d):
    return _longs(K.top_intervals(events_ledger(spark, d)))


@query("cluster_amount_stats", f"""WITH {EVENTS_SQL}, {DAYS} SELECT account, cluster, count(*) AS n, round(avg(amount), 6) AS mean, round(min(amount), 6) AS low, round(max(amount), 6) AS high, round(stddev_samp(amount), 6) AS deviation,
 round(arg_min(amount, date), 6) AS first, round(arg_max(amount, date), 6) AS last FROM days GROUP BY account, cluster""")
def cluster_amount_stats(spark, d):
    return K.amount_stats(events_ledger(spark, d))


@query("amount_mode", f"""WITH {EVENTS_SQL}, c AS (SELECT account, cluster, amount, count(*) AS n FROM ledger GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY account, cluster ORDER BY n DESC, amount) AS rn FROM c) SELECT account, cluster, amount AS mode, n FROM r WHERE rn = 1""")
def amount_mode(spark, d):
    return K.amount_mode(events_ledger(spark, d))


@query("gap_mode_smallest_abs", f"""WITH {EVENTS_SQL}, {DAYS}, {GAPS}, x AS (SELECT account, cluster, gap - 7 AS v FROM gaps WHERE gap IS NOT NULL), c AS (SELECT account, cluster, v, count(*) AS n FROM x GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY account, cluster ORDER BY n DESC, abs(v), v) AS rn FROM c) SELECT account, cluster, CAST(v AS BIGINT) AS mode FROM r WHERE rn = 1""")
def gap_mode_smallest_abs(spark, d):
    rows = K.gaps(K.same_day(events_ledger(spark, d))).where("gap is not null").withColumn("off", F.col("gap") - 7)
    return _longs(K.mode_smallest_abs(rows, ["account", "cluster"], "off"))


@query("majority_label", f"""WITH {ORDERS_SQL}, c AS (SELECT account, type, description, count(*) AS n FROM ledger GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY CASE WHEN type = 'CREDIT' THEN 0 ELSE 1 END, n DESC, description) AS rn FROM c) SELECT account, 'all' AS cluster, description AS label FROM r WHERE rn = 1""")
def majority_label(spark, d):
    return K.majority_label(orders_ledger(spark, d).withColumn("cluster", F.lit("all")))


@query("keyword_share_flags", f"""WITH {ORDERS_SQL} SELECT account, cluster, CAST(CASE WHEN avg(CASE WHEN regexp_matches(description, 'URGENT|HIGH') THEN 1.0 ELSE 0.0 END) >= 0.5 THEN 1 ELSE 0 END AS BIGINT) AS urgent,
 CAST(CASE WHEN avg(CASE WHEN regexp_matches(description, '^[0-9]-') THEN 1.0 ELSE 0.0 END) >= 0.5 THEN 1 ELSE 0 END AS BIGINT) AS numbered FROM ledger GROUP BY account, cluster""")
def keyword_share_flags(spark, d):
    return _longs(K.keyword_flags(orders_ledger(spark, d), {"urgent": "URGENT|HIGH", "numbered": "^[0-9]-"}))


@query("unique_descriptions", f"WITH {ORDERS_SQL} SELECT account, string_agg(description, '|' ORDER BY description) AS descriptions FROM (SELECT DISTINCT account, description FROM ledger) GROUP BY account")
def unique_descriptions(spark, d):
    return K.unique_text(orders_ledger(spark, d))


@query("all_multiples_of_five", f"WITH {EVENTS_SQL} SELECT account, cluster, CAST(CASE WHEN bool_and(CAST(floor(amount) AS BIGINT) % 5 = 0) THEN 1 ELSE 0 END AS BIGINT) AS all_multiples FROM ledger GROUP BY account, cluster")
def all_multiples_of_five(spark, d):
    return _longs(K.all_multiples(events_ledger(spark, d)))


@query("partition_extent", f"""WITH {ORDERS_SQL} SELECT account, txn_id, cluster, min(date) OVER (PARTITION BY account) AS first_date, max(date) OVER (PARTITION BY account) AS last_date, count(*) OVER (PARTITION BY account, cluster) AS cluster_rows,
 CAST(sum(CASE WHEN type = 'CREDIT' THEN 1 ELSE 0 END) OVER (PARTITION BY account, cluster) AS BIGINT) AS cluster_credits FROM ledger""")
def partition_extent(spark, d):
    return K.extent(orders_ledger(spark, d))


@query("cluster_triage", f"""WITH {ORDERS_SQL}, x AS (SELECT account, cluster, CASE WHEN txn_id % 3 = 0 THEN NULL ELSE type END AS label FROM ledger),
k AS (SELECT account, cluster, count(*) AS n, count(label) AS l FROM x GROUP BY 1, 2), c AS (SELECT account, cluster, label, count(*) AS n FROM x WHERE label IS NOT NULL GROUP BY 1, 2, 3),
m AS (SELECT account, cluster, label FROM (SELECT *, row_number() OVER (PARTITION BY account, cluster ORDER BY n DESC, label) AS rn FROM c) WHERE rn = 1)
SELECT k.account, k.cluster, CASE WHEN l = n THEN 'keep' WHEN l > 0 THEN 'copy' ELSE 'predict' END AS action, m.label AS majority FROM k LEFT JOIN m ON m.account = k.account AND m.cluster = k.cluster""")
def cluster_triage(spark, d):
    return K.triage(orders_ledger(spark, d).withColumn("label", F.when(F.col("txn_id") % 3 != 0, F.col("type"))), "label")


@query("payday_next_lead", f"{O}, {DAYS} SELECT account, cluster, date, coalesce(lead(date) OVER (PARTITION BY account, cluster ORDER BY date), (SELECT d FROM day_)) AS next_date FROM days")
def payday_next_lead(spark, d):
    ledger, _, as_of = _orders(spark, d)
    return K.next_pay(K.same_day(ledger), as_of)


RUNNING = f"""net AS (SELECT account, date, sum({SIGNED}) AS net FROM ledger GROUP BY account, date), span AS (SELECT account, min(date) AS a, max(date) AS b FROM net GROUP BY account),
days_ AS (SELECT account, CAST(unnest(generate_series(CAST(a - 1 AS TIMESTAMP), CAST(b + 1 AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM span),
series AS (SELECT days_.account, days_.date, round(sum(coalesce(net, 0.0)) OVER (PARTITION BY days_.account ORDER BY days_.date), 2) AS running FROM days_ LEFT JOIN net ON net.account = days_.account AND net.date = days_.date)"""


@query("spend_islands", f"""WITH {EVENTS_SQL}, {RUNNING}, f AS (SELECT *, sum(CASE WHEN running > 100 THEN 0 ELSE 1 END) OVER (PARTITION BY account ORDER BY date) AS island FROM series)
SELECT account, min(date) AS start, count(*) AS days, CAST(CASE WHEN count(*) >= 3 THEN 1 ELSE 0 END AS BIGINT) AS good FROM f WHERE running > 100 GROUP BY account, island""")
def spend_islands(spark, d):
    return _longs(K.islands(M.daily_series(events_ledger(spark, d)), 100.0))


@query("merge_doubled_clusters", f"""WITH x AS (SELECT CAST(c_nationkey AS VARCHAR) AS account, c_custkey AS txn_id, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE concat(c_mktsegment, ' ', c_mktsegment) END AS description,
 concat('k', CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE concat(c_mktsegment, '2') END) AS cluster FROM customer),
c AS (SELECT account, cluster, description, count(*) AS n FROM x GROUP BY 1, 2, 3),
t AS (SELECT account, cluster, description FROM (SELECT *, n / sum(n) OVER (PARTITION BY account, cluster) AS share, row_number() OVER (PARTITION BY account, cluster ORDER BY n DESC, description) AS rn FROM c) WHERE rn = 1 AND share >= 0.5),
s AS (SELECT account, concat(description, ' ', description) AS description, min(cluster) AS merged FROM t GROUP BY 1, 2),
r AS (SELECT t.account, t.cluster, s.merged FROM t JOIN s ON s.account = t.account AND s.description = t.description)
SELECT x.account, x.txn_id, coalesce(r.merged, x.cluster) AS cluster FROM x LEFT JOIN r ON r.account = x.account AND r.cluster = x.cluster""")
def merge_doubled_clusters(spark, d):
    even, seg = F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")
    rows = table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("account"), F.col("c_custkey").alias("txn_id"), F.when(even, seg).otherwise(F.concat_ws(" ", seg, seg)).alias("description"), F.concat(F.lit("k"), F.when(even, seg).otherwise(F.concat(seg, F.lit("2")))).alias("cluster"))
    return K.merge_doubled(rows).select("account", "txn_id", "cluster")


SOURCES = """src AS (SELECT account, cluster, round(sum(amount) / 12, 4) AS monthly_income, CAST(CASE WHEN count(*) = 1 THEN 201 ELSE 0 END AS BIGINT) AS error_code, CAST(least(count(*), 3) AS BIGINT) AS active_score,
 CASE WHEN count(*) >= 3 THEN 'M' ELSE 'I' END AS frequency, cluster AS income_type, max(date) AS last FROM ledger WHERE type = 'CREDIT' GROUP BY account, cluster)"""


def _sources(spark: SparkSession, d: str) -> DataFrame:
    n = F.count("*")
    rows = orders_ledger(spark, d).where("type = 'CREDIT'").groupBy("account", "cluster").agg(F.round(F.sum("amount") / 12, 4).alias("monthly_income"), F.when(n == 1, 201).otherwise(0).alias("error_code"), F.least(n, F.lit(3)).alias("active_score"), F.when(n >= 3, "M").otherwise("I").alias("frequency"), F.max("date").alias("last"))
    return _longs(rows).withColumns({"income_type": F.col("cluster"), "regular_day": F.lit("1")})


@query("rank_sources", f"""WITH {ORDERS_SQL}, {SOURCES}, r AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY CASE WHEN error_code = 0 THEN 0 ELSE 1 END, monthly_income DESC, cluster) AS rank,
 max(CASE WHEN error_code = 0 THEN monthly_income END) OVER (PARTITION BY account) AS top FROM src)
SELECT account, cluster, monthly_income, error_code, CAST(rank AS BIGINT) AS rank, CAST(CASE WHEN error_code = 0 AND monthly_income = top THEN 1 ELSE 0 END AS BIGINT) AS dominant FROM r""")
def rank_sources(spark, d):
    return _longs(I.ranked(_sources(spark, d)).select("account", "cluster", "monthly_income", "error_code", "rank", "dominant"))


@query("top_regular_income", f"""WITH {ORDERS_SQL}, {SOURCES}, r AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY monthly_income DESC, cluster) AS rn FROM src WHERE error_code = 0 AND active_score = 3 AND frequency <> 'I')
SELECT account, cluster, frequency, monthly_income FROM r WHERE rn = 1""")
def top_regular_income(spark, d):
    return I.regular_top(_sources(spark, d)).select("account", "cluster", "frequency", "monthly_income")


@query("income_counts", f"{O}, {SOURCES} SELECT account, count(CASE WHEN error_code = 0 THEN 1 END) AS sources_all, count(CASE WHEN error_code = 0 AND date_diff('day', last, d) <= 180 THEN 1 END) AS sources_6m, count(CASE WHEN error_code = 0 AND date_diff('day', last, d) <= 90 THEN 1 END) AS sources_3m FROM src CROSS JOIN day_ GROUP BY account")
def income_counts(spark, d):
    return I.counts_by_recency(_sources(spark, d), last_date(orders_ledger(spark, d)))


@query("recommend_account", f"""WITH {ORDERS_SQL}, {SOURCES}, h AS (SELECT DISTINCT account FROM src WHERE active_score = 3 AND frequency <> 'I' AND error_code = 0),
r AS (SELECT a.account_type, a.account, CASE WHEN h.account IS NULL THEN 0 ELSE 1 END AS has_income, a.balance FROM accounts a LEFT JOIN h ON h.account = a.account WHERE a.account_type IN ('BUILDING', 'MACHINERY'))
SELECT account_type, account, CAST(has_income AS BIGINT) AS has_income FROM (SELECT *, row_number() OVER (PARTITION BY account_type ORDER BY has_income DESC, balance DESC, account) AS rn FROM r) WHERE rn = 1""")
def recommend_account(spark, d):
    return _longs(I.recommended_account(_sources(spark, d), accounts(spark, d), ["BUILDING", "MACHINERY"]))


@query("loan_sources", f"""WITH {EVENTS_SQL}, per AS (SELECT account, cluster, coalesce(max(CASE WHEN type = 'CREDIT' THEN amount END), 0.0) AS origination, coalesce(max(CASE WHEN type = 'DEBIT' THEN amount END), 0.0) AS payment,
 count(CASE WHEN type = 'CREDIT' THEN 1 END) AS n_originations, count(DISTINCT CASE WHEN type = 'DEBIT' THEN date END) AS n_payments, max(date) AS last FROM ledger GROUP BY account, cluster),
c AS (SELECT *, CASE WHEN origination <= 50 AND payment <= 50 AND greatest(origination, payment) > 0 THEN 304 ELSE 0 END AS error_code FROM per),
n AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY error_code, cluster) AS rn FROM c)
SELECT account, cluster, CASE WHEN error_code = 0 THEN concat('L', CAST(rn AS VARCHAR)) END AS source_id, origination, payment, n_originations, n_payments, CASE WHEN origination > 10 THEN round(payment / origination, 6) END AS payment_share, last, CAST(error_code AS BIGINT) AS error_code FROM n""")
def loan_sources(spark, d):
    return _longs(I.loan_sources(events_ledger(spark, d)))


@query("days_to_spend", f"""WITH {EVENTS_SQL}, dy AS (SELECT account, date, sum(CASE WHEN cluster = 'view' AND amount > 60 THEN amount END) AS paid, sum(CASE WHEN type = 'DEBIT' THEN amount ELSE 0 END) AS spent FROM ledger GROUP BY 1, 2),
p AS (SELECT *, count(paid) OVER (PARTITION BY account ORDER BY date) AS period FROM dy),
r AS (SELECT account, period, date, first_value(paid) OVER w AS pay, first_value(date) OVER w AS start, sum(spent) OVER w AS total FROM p WHERE period > 0 WINDOW w AS (PARTITION BY account, period ORDER BY date))
SELECT account, start, round(max(pay), 2) AS paid, CAST(min(CASE WHEN total >= pay THEN date_diff('day', start, date) END) AS BIGINT) AS days_to_spend FROM r GROUP BY account, start""")
def days_to_spend(spark, d):
    return _longs(I.spending_days(events_ledger(spark, d), (F.col("cluster") == "view") & (F.col("amount") > 60)))


@query("loan_amount_range", """WITH s AS (SELECT c_nationkey AS nation, max(c_acctbal) / 50 AS score FROM customer GROUP BY 1)
SELECT CAST(nation AS BIGINT) AS nation, CAST(floor(least(greatest(score * 2.988, 300.0), 1000.0) / 10) * 10 AS BIGINT) AS low, CAST(ceil(least(greatest(score * 3.928, 300.0), 1000.0) / 10) * 10 AS BIGINT) AS high FROM s""")
def loan_amount_range(spark, d):
    low, high = I.amount_range(F.col("score"), 2.988, 3.928, 300.0, 1000.0)
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("nation")).agg((F.max("c_acctbal") / 50).alias("score")).select("nation", low.alias("low"), high.alias("high"))


@query("stability_score", f"""WITH {EVENTS_SQL}, {DAYS}, v AS (SELECT account, cluster, count(*) AS n, least(coalesce(stddev_samp(amount) / NULLIF(avg(amount), 0), 1.0), 1.0) AS cv FROM days GROUP BY 1, 2)
SELECT account, cluster, CAST(CASE WHEN n < 4 THEN 0 WHEN cv <= 0.33 THEN 3 WHEN cv <= 0.5 THEN 2 ELSE 1 END AS BIGINT) AS stability_score FROM v""")
def stability_score(spark, d):
    ledger, _, as_of = _events(spark, d)
    freq = Q.frequency(ledger, trim=False).withColumn("frequency", F.lit("I"))
    return _longs(Q.scores(ledger, freq, as_of).select("account", "cluster", "stability_score"))


@query("activity_score", f"""{E}, {DAYS}, {GAPS}, v AS (SELECT account, cluster, count(*) AS n, max(date) AS last, max(gap) AS gap FROM gaps GROUP BY 1, 2)
SELECT account, cluster, CAST(CASE WHEN n < 4 THEN 0 WHEN date_diff('day', last, d) > 30 THEN 1 WHEN gap >= 40 THEN 2 ELSE 3 END AS BIGINT) AS active_score FROM v CROSS JOIN day_""")
def activity_score(spark, d):
    ledger, _, as_of = _events(spark, d)
    freq = Q.frequency(ledger, trim=False).withColumn("frequency", F.lit("I"))
    return _longs(Q.scores(ledger, freq, as_of).select("account", "cluster", "active_score"))


_FREQ = f"""f0 AS (SELECT account, cluster, date, amount FROM days), g AS (SELECT *, date_diff('day', lag(date) OVER (PARTITION BY account, cluster ORDER BY date), date) AS gap, isodow(date) - 1 AS wd, day(date) AS dom FROM f0),
base AS (SELECT account, cluster, count(*) AS n, avg(amount) AS mean, date_diff('day', min(date), max(date)) AS span, count(CASE WHEN gap = 7 THEN 1 END) AS w, count(CASE WHEN gap BETWEEN 13 AND 17 THEN 1 END) AS b, count(CASE WHEN gap BETWEEN 25 AND 35 THEN 1 END) AS m, count(CASE WHEN gap % 7 = 0 THEN 1 END) AS s7 FROM g GROUP BY 1, 2),
wc AS (SELECT account, cluster, wd, c, row_number() OVER (PARTITION BY account, cluster ORDER BY c DESC, wd) AS r FROM (SELECT account, cluster, wd, count(*) AS c FROM g GROUP BY 1, 2, 3)),
dc AS (SELECT account, cluster, dom, c, row_number() OVER (PARTITION BY account, cluster ORDER BY c DESC, dom) AS r FROM (SELECT account, cluster, dom, count(*) AS c FROM g GROUP BY 1, 2, 3)),
dd AS (SELECT account, cluster, max(CASE WHEN r = 1 THEN dom END) AS d1, max(CASE WHEN r = 2 THEN dom END) AS d2, sum(c) AS c2 FROM dc WHERE r <= 2 GROUP BY 1, 2),
al AS (SELECT base.*, wc.wd, CAST(wc.c AS DOUBLE) / n AS ws, d1, d2, CAST(c2 AS DOUBLE) / n AS ds, CASE WHEN n > 3 THEN 0.4999 ELSE 0.5 END AS cut, greatest(n - 1, 1) AS k FROM base JOIN wc ON wc.account = base.account AND wc.cluster = base.cluster AND wc.r = 1 JOIN dd ON dd.account = base.account AND dd.cluster = base.cluster),
fq AS (SELECT *, CASE WHEN CAST(w AS DOUBLE) / k > cut THEN CASE WHEN ws > cut THEN 'W' ELSE 'I' END WHEN CAST(b AS DOUBLE) / k > cut THEN CASE WHEN ws > ds THEN CASE WHEN ws > cut THEN 'B' ELSE 'I' END WHEN d2 IS NOT NULL AND ds > cut THEN 'S' ELSE 'I' END
 WHEN CAST(m AS DOUBLE) / k > cut THEN 'M' WHEN CAST(s7 AS DOUBLE) / k > cut AND n > 3 AND w > b THEN 'W' WHEN CAST(s7 AS DOUBLE) / k > cut AND n > 3 AND b > w THEN 'B' ELSE 'I' END AS frequency FROM al)"""
#: A ledger of rows at regular intervals by customer: every frequency occurs.
REGULAR_SQL = """regular AS (SELECT CAST(c_custkey AS VARCHAR) AS account, c_custkey * 100 + k AS txn_id, CASE c_custkey % 4 WHEN 0 THEN DATE '2021-01-01' + CAST(7 * k AS INTEGER) WHEN 1 THEN DATE '2021-01-01' + CAST(14 * k AS INTEGER)
 WHEN 2 THEN CAST(DATE '2021-01-05' + INTERVAL 1 MONTH * CAST(k AS INTEGER) AS DATE) ELSE DATE '2021-01-01' + CAST(11 * k + (k * k) % 9 AS INTEGER) END AS date, 100.0 + (c_custkey * 7 + k * (c_custkey % 3)) % 50 AS amount, 'CREDIT' AS type, 'pay' AS description, 'pay' AS cluster
 FROM customer CROSS JOIN (SELECT unnest(generate_series(0, 9)) AS k))"""


def _regular(spark: SparkSession, d: str) -> DataFrame:
    owners = spread(table(spark, d, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("account")), "account")  # a file of customers makes ten rows each
    rows = owners.select("c_custkey", "account", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"))
    start, k, kind = F.lit("2021-01-01").cast("date"), F.col("k"), F.col("c_custkey") % 4
    date = F.when(kind == 0, F.date_add(start, 7 * k)).when(kind == 1, F.date_add(start, 14 * k)).when(kind == 2, F.add_months(F.lit("2021-01-05").cast("date"), k)).otherwise(F.date_add(start, 11 * k + (k * k) % 9))
    amount = F.lit(100.0) + (F.col("c_custkey") * 7 + k * (F.col("c_custkey") % 3)) % 50
    return rows.select("account", (F.col("c_custkey") * 100 + k).alias("txn_id"), date.alias("date"), amount.alias("amount"), F.lit("CREDIT").alias("type"), F.lit("pay").alias("description"), F.lit("pay").alias("cluster"))


@query("pay_frequency", f"""WITH {REGULAR_SQL}, ledger AS (SELECT * FROM regular), {DAYS}, {_FREQ}
SELECT account, cluster, n AS n_pays, frequency, round(mean * CASE frequency WHEN 'W' THEN 52.0 / 12 WHEN 'B' THEN 26.0 / 12 WHEN 'S' THEN 2.0 WHEN 'M' THEN 1.0 ELSE CASE WHEN span >= 30 THEN n * 30.0 / span ELSE n END END, 2) AS monthly_amount,
 CASE WHEN frequency IN ('W', 'B') OR (frequency = 'I' AND n > 4 AND ws > cut) THEN ['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'][CAST(wd AS INTEGER) + 1]
 WHEN frequency = 'M' THEN CAST(d1 AS VARCHAR) WHEN frequency = 'S' OR (frequency = 'I' AND n > 4) THEN concat_ws(',', CAST(least(d1, d2) AS VARCHAR), CAST(greatest(d1, d2) AS VARCHAR)) END AS regular_day FROM fq""")
def pay_frequency(spark, d):
    return _longs(Q.frequency(_regular(spark, d)).select("account", "cluster", "n_pays", "frequency", "monthly_amount", "regular_day"))


@query("weekday_share", f"""WITH {REGULAR_SQL}, c AS (SELECT account, isodow(date) - 1 AS wd, count(*) AS n FROM regular GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY n DESC, wd) AS rn, sum(n) OVER (PARTITION BY account) AS total FROM c)
SELECT account, CAST(wd AS BIGINT) AS weekday, round(CAST(n AS DOUBLE) / CAST(total AS DOUBLE), 6) AS share FROM r WHERE rn = 1""")
def weekday_share(spark, d):
    best = Q._mode(_regular(spark, d).withColumn("weekday", F.weekday("date")), "weekday", 1)
    return _longs(best.select("account", "weekday", F.round("weekday_share", 6).alias("share")))


@query("missing_paydays", f"""WITH {REGULAR_SQL}, l AS (SELECT account, cluster, date, lead(date) OVER (PARTITION BY account, cluster ORDER BY date) AS nxt FROM regular WHERE txn_id % 100 NOT IN (3, 4)),
s AS (SELECT *, CAST(floor((date_diff('day', date, nxt) - 2 - 1) / 7.0) AS BIGINT) AS n FROM l WHERE date_diff('day', date, nxt) >= 9)
SELECT account, cluster, CAST(date + CAST(7 * k AS INTEGER) AS DATE) AS missing FROM (SELECT account, cluster, date, unnest(generate_series(1, n)) AS k FROM s WHERE n > 0)""")
def missing_paydays(spark, d):
    return C.missing_paydays(_regular(spark, d).where(~(F.col("txn_id") % 100).isin(3, 4)), F.lit("W"))


@query("next_payday", f"""WITH {REGULAR_SQL}, l AS (SELECT account, max(date) AS last FROM regular WHERE CAST(account AS BIGINT) % 4 < 2 GROUP BY 1), t AS (SELECT account, last, last + CAST(CASE WHEN CAST(account AS BIGINT) % 4 = 0 THEN 7 ELSE 14 END AS INTEGER) AS there FROM l),
s AS (SELECT *, ((3 - (isodow(there) - 1)) % 7 + 7) % 7 AS shift FROM t) SELECT account, CAST(there + CAST(CASE WHEN shift > 3 THEN shift - 7 ELSE shift END AS INTEGER) AS DATE) AS next_date FROM s""")
def next_payday(spark, d):
    last = _regular(spark, d).where(F.col("account").cast("long") % 4 < 2).groupBy("account").agg(F.max("date").alias("last"))
    freq = F.when(F.col("account").cast("long") % 4 == 0, "W").otherwise("B")
    return last.select("account", C.next_payday(F.col("last"), freq, F.lit(3), F.lit(1), F.lit(None).cast("int")).alias("next_date"))


@query("business_calendar", """WITH days AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2020-12-01', TIMESTAMP '2021-03-10', INTERVAL 1 DAY)) AS DATE) AS date),
free AS (SELECT unnest([DATE '2020-12-25', DATE '2021-01-01', DATE '2021-01-18', DATE '2021-02-15']) AS f), c AS (SELECT date, isodow(date) < 6 AND f IS NULL AS bd FROM days LEFT JOIN free ON f = date)
SELECT x.date, x.bd AS is_business_day, (SELECT max(y.date) FROM c y WHERE y.bd AND y.date < x.date) AS previous_bd, (SELECT min(y.date) FROM c y WHERE y.bd AND y.date > x.date) AS next_bd FROM c x WHERE x.date BETWEEN DATE '2020-12-21' AND DATE '2021-02-20'""")
def business_calendar(spark, d):
    return C.business_calendar(spark, datetime.date(2020, 12, 21), datetime.date(2021, 2, 20)).select("date", "is_business_day", "previous_bd", "next_bd")


@query("nth_weekday", """WITH m AS (SELECT DISTINCT CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS DATE) AS m FROM orders)
SELECT m AS month, CAST(m + CAST((1 - (isodow(m) - 1) + 7) % 7 + 7 AS INTEGER) AS DATE) AS second_tuesday, CAST(last_day(m) - CAST(((isodow(last_day(m)) - 1) - 4 + 7) % 7 AS INTEGER) AS DATE) AS last_friday FROM m""")
def nth_weekday(spark, d):
    months = table(spark, d, "orders").select(F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("month")).distinct()
    return months.select("month", C.nth_weekday(F.col("month"), 1, 2).alias("second_tuesday"), C.nth_weekday(F.col("month"), 4, -1).alias("last_friday"))


@query("month_flags", f"WITH {ORDERS_SQL} SELECT txn_id, date_part('day', date) = 1 AS month_start, date = last_day(date) AS month_end, CAST((day(date) - 1) // 7 + 1 AS BIGINT) AS week_of_month, month(date + 7) <> month(date) AS last_weekday FROM ledger")
def month_flags(spark, d):
    date = F.col("date")
    return _longs(orders_ledger(spark, d).select("txn_id", (F.dayofmonth(date) == 1).alias("month_start"), (date == F.last_day(date)).alias("month_end"), C.week_of_month(date).alias("week_of_month"), C.is_last_weekday(date).alias("last_weekday")))


@query("month_day_distance", "SELECT DISTINCT CAST(day(o_orderdate) AS BIGINT) AS day, CAST(least(((day(o_orderdate) - 15) % 30 + 30) % 30, ((15 - day(o_orderdate)) % 30 + 30) % 30) AS BIGINT) AS distance FROM orders")
def month_day_distance(spark, d):
    day = F.dayofmonth("o_orderdate")
    return _longs(table(spark, d, "orders").select(day.alias("day"), C.month_distance(day, F.lit(15)).alias("distance")).distinct())


@query("category_case", "SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 0 END AS BIGINT) AS category FROM orders")
def category_case(spark, d):
    p = F.col("o_orderpriority")
    label = F.when(p == "1-URGENT", "Payroll").when(p == "2-HIGH", "benefit").when(p == "3-MEDIUM", "transfer").otherwise("x")
    return _longs(table(spark, d, "orders").select("o_orderkey", T.transaction_category(label).alias("category")))


_PHRASE = "CASE p_partkey % 6 WHEN 0 THEN 'ATM cash at branch' WHEN 1 THEN 'mobile check deposit' WHEN 2 THEN 'transfer from savings' WHEN 3 THEN 'pay friend QuickPay' WHEN 4 THEN 'wire' ELSE 'round up' END"


@query("transfer_subcategory", f"""WITH x AS (SELECT p_partkey, {_PHRASE} AS t, CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 4 END AS c FROM part),
s AS (SELECT p_partkey, CASE WHEN c = 4 AND regexp_matches(lower(t), 'check') THEN 'Check Deposit' WHEN c = 4 AND regexp_matches(lower(t), 'mobile|online') THEN 'Mobile Deposit' WHEN c = 4 AND regexp_matches(lower(t), 'cash|atm') THEN 'Cash Deposit'
 WHEN c = 3 AND regexp_matches(lower(t), 'quickpay') THEN 'Quick Pay' WHEN regexp_matches(lower(t), 'round up|from.*sav') THEN 'Balance Transfer' WHEN c = 3 THEN 'Other Transfer' ELSE 'Other Deposit' END AS subcategory FROM x)
SELECT p_partkey, subcategory, CASE WHEN subcategory LIKE '%Deposit' THEN split_part(subcategory, ' ', 1) ELSE 'Transfer' END AS method FROM s""")
def transfer_subcategory(spark, d):
    k = F.col("p_partkey")
    said = F.element_at(F.array(*[F.lit(x) for x in ("ATM cash at branch", "mobile check deposit", "transfer from savings", "pay friend QuickPay", "wire", "round up")]), (k % 6 + 1).cast("int"))
    rows = table(spark, d, "part").select(k, T.transfer_subcategory(said, F.when(k % 2 == 0, 3).otherwise(4), ((r"\bquickpay\b", "Quick Pay"),)).alias("subcategory"))
    return rows.select("p_partkey", "subcategory", T.deposit_method(F.col("subcategory")).alias("method"))


@query("clean_tokens", "SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9* ]+', ' ', 'g'), ' +', ' ', 'g')) AS cleaned FROM part")
def clean_tokens(spark, d):
    return table(spark, d, "part").select("p_partkey", T.clean_for_rules(F.lower("p_name")).alias("cleaned"))


@query("dedupe_tokens", "SELECT p_partkey, list_aggregate(list_sort(list_distinct(string_split(concat(p_type, ' ', p_type, ' x'), ' '))), 'string_agg', ' ') AS words FROM part")
def dedupe_tokens(spark, d):
    twice = F.concat_ws(" ", "p_type", "p_type", F.lit("x"))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(F.split(T.distinct_tokens(twice), " ")), " ").alias("words"))


@query("regex_kb_label", "SELECT p_partkey, CASE WHEN regexp_matches(lower(p_type), 'brass|steel') THEN 'metal' WHEN regexp_matches(lower(p_type), 'plated') THEN 'plated' WHEN regexp_matches(lower(p_type), 'small|economy') THEN 'cheap' END AS label FROM part")
def regex_kb_label(spark, d):
    return table(spark, d, "part").select("p_partkey", T.regex_label(F.col("p_type"), [("cheap", ["small", "economy"]), ("plated", ["plated"]), ("metal", ["brass", "steel"])]).alias("label"))


_KB = """kb AS (SELECT 0 AS shape, o_orderpriority AS description, o_orderstatus AS type, concat('a', o_orderstatus) AS label FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'O' GROUP BY 2, 3),
kb1 AS (SELECT DISTINCT o_orderpriority AS description, 'b' AS label FROM orders WHERE o_orderpriority < '3')"""


@query("prioritized_lookup", f"""WITH {_KB} SELECT o_orderkey, coalesce(kb.label, kb1.label) AS label, CAST(CASE WHEN kb.label IS NOT NULL THEN 0 WHEN kb1.label IS NOT NULL THEN 1 END AS BIGINT) AS hit
FROM orders LEFT JOIN kb ON kb.description = o_orderpriority AND kb.type = o_orderstatus LEFT JOIN kb1 ON kb1.description = o_orderpriority""")
def prioritized_lookup(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("description"), F.col("o_orderstatus").alias("type"))
    first = orders.where("description = '1-URGENT' and type <> 'O'").select(F.lit(0).alias("shape"), "description", "type", F.concat(F.lit("a"), "type").alias("label")).distinct()
    second = orders.where("description < '3'").select(F.lit(1).alias("shape"), "description", F.lit(None).cast("string").alias("type"), F.lit("b").alias("label")).distinct()
    out = L.prioritised(orders, first.unionByName(second), [["description", "type"], ["description"]])
    return _longs(out.select("o_orderkey", "label", "hit"))


@query("label_cascade", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'f' WHEN o_orderpriority = '2-HIGH' THEN 'high' ELSE 'other' END AS label, CASE WHEN o_orderstatus = 'F' THEN 'rules' WHEN o_orderpriority = '2-HIGH' THEN 'entities' ELSE 'model' END AS source FROM orders")
def label_cascade(spark, d):
    label, source = L.cascade(("rules", F.when(F.col("o_orderstatus") == "F", "f")), ("entities", F.when(F.col("o_orderpriority") == "2-HIGH", "high")), ("model", F.lit("other")))
    return table(spark, d, "orders").select("o_orderkey", label.alias("label"), source.alias("source"))


@query("agent_override", """WITH x AS (SELECT CAST(o_custkey AS VARCHAR) AS account, o_orderkey, o_orderpriority AS description, o_orderstatus AS cluster, 'auto' AS label FROM orders)
SELECT x.o_orderkey, CASE WHEN description = '1-URGENT' AND CAST(account AS BIGINT) % 5 = 0 THEN 'hand' WHEN cluster = 'P' AND CAST(account AS BIGINT) % 3 = 0 THEN 'group' ELSE label END AS label FROM x""")
def agent_override(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("account"), "o_orderkey", F.col("o_orderpriority").alias("description"), F.col("o_orderstatus").alias("cluster"), F.lit("auto").alias("label"))
    who, none = rows.select("account").distinct(), F.lit(None).cast("string")
    edits = who.where(F.col("account").cast("long") % 5 == 0).select("account", F.lit("1-URGENT").alias("description"), none.alias("cluster"), F.lit("hand").alias("label"))
    edits = edits.unionByName(who.where(F.col("account").cast("long") % 3 == 0).select("account", none.alias("description"), F.lit("P").alias("cluster"), F.lit("group").alias("label")))
    return L.agent_override(rows, edits).select("o_orderkey", "label")


@query("pivot_income_types", f"""WITH {ORDERS_SQL}, {SOURCES} SELECT account, {", ".join(f'count(CASE WHEN cluster = {v!r} THEN 1 END) AS "{v}_count", round(coalesce(sum(CASE WHEN cluster = {v!r} THEN monthly_income END), 0.0), 4) AS "{v}_sum"' for v in ("1-URGENT", "2-HIGH"))} FROM src GROUP BY account""")
def pivot_income_types(spark, d):
    return S.pivoted(_sources(spark, d), "cluster", ["1-URGENT", "2-HIGH"])


@query("reaggregate_rollup", f"WITH {ORDERS_SQL}, c AS (SELECT account, type, count(*) AS n FROM ledger GROUP BY 1, 2) SELECT account, type, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY ROLLUP (account, type)")
def reaggregate_rollup(spark, d):
    counts = orders_ledger(spark, d).groupBy("account", "type").agg(F.count("*").alias("n"))
    return counts.rollup("account", "type").agg(F.sum("n").alias("n"))


@query("distinct_reasons", f"WITH {ORDERS_SQL}, r AS (SELECT DISTINCT account, description FROM ledger) SELECT account, coalesce(string_agg(description, '|' ORDER BY description), '') AS reasons FROM r a WHERE NOT (description = '2-HIGH' AND EXISTS (SELECT 1 FROM r b WHERE b.account = a.account AND b.description = '1-URGENT')) GROUP BY account")
def distinct_reasons(spark, d):
    return S.distinct_reasons(orders_ledger(spark, d).select("account", F.col("description").alias("reason")), {"2-HIGH": "1-URGENT"})


@query("feature_alignment", f"WITH {ORDERS_SQL} SELECT account, CAST(count(*) AS DOUBLE) AS rows, CAST(sum(amount) AS BIGINT) * 0 + CAST(floor(max(amount)) AS BIGINT) AS most, CAST(0 AS BIGINT) AS absent FROM ledger GROUP BY account")
def feature_alignment(spark, d):
    rows = orders_ledger(spark, d).groupBy("account").agg(F.count("*").alias("rows"), F.floor(F.max("amount")).alias("most"))
    return S.aligned(rows, {"rows": "double", "most": "long", "absent": "long"})


_CONTRIB = """SELECT CAST(l_suppkey AS VARCHAR) AS account, concat('f', CAST(l_linenumber AS VARCHAR)) AS feature, round(sum(l_discount - 0.05), 4) AS contribution FROM lineitem GROUP BY 1, 2"""


@query("top5_contributions", f"""WITH c AS ({_CONTRIB}), r AS (SELECT account, CASE WHEN contribution > 0 THEN 1 ELSE -1 END AS sign, feature, contribution, row_number() OVER (PARTITION BY account, contribution > 0 ORDER BY abs(contribution) DESC, feature) AS rank FROM c WHERE contribution <> 0),
s AS (SELECT account, sign, unnest(generate_series(1, 5)) AS rank FROM (SELECT DISTINCT account FROM c) CROSS JOIN (SELECT unnest([1, -1]) AS sign))
SELECT s.account, CAST(s.sign AS BIGINT) AS sign, CAST(s.rank AS BIGINT) AS rank, r.feature, r.contribution FROM s LEFT JOIN r ON r.account = s.account AND r.sign = s.sign AND r.rank = s.rank""")
def top5_contributions(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("account"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("feature")).agg(F.round(F.sum(F.col("l_discount") - 0.05), 4).alias("contribution"))
    return _longs(S.top_contributions(rows))


@query("score_transform", "SELECT c_custkey, CAST(trunc(850 - 100 / ln(2) * ln(100) + 100 / ln(2) * ln(p / (1 - p))) AS BIGINT) AS score FROM (SELECT c_custkey, 0.001 + 0.998 * ((c_custkey * 37) % 1000) / 1000.0 AS p FROM customer)")
def score_transform(spark, d):
    p = F.lit(0.001) + F.lit(0.998) * ((F.col("c_custkey") * 37) % 1000) / F.lit(1000.0)
    return _longs(table(spark, d, "customer").select("c_custkey", T.log_odds_score(p).alias("score")))


@query("repeat_opportunity", "SELECT c_custkey, CASE WHEN c_acctbal / 20 >= 215 THEN 'High' WHEN c_acctbal / 20 >= 150 THEN 'Medium' ELSE 'Low' END AS opportunity FROM customer")
def repeat_opportunity(spark, d):
    score = F.col("c_acctbal") / 20
    return table(spark, d, "customer").select("c_custkey", F.when(score >= 215, "High").when(score >= 150, "Medium").otherwise("Low").alias("opportunity"))


@query("dedup_row_number", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def dedup_row_number(spark, d):
    best = F.min(F.struct((-F.col("o_totalprice")).alias("m"), "o_orderkey"))
    return table(spark, d, "orders").groupBy("o_custkey").agg(best.alias("x")).select("o_custkey", "x.o_orderkey", (-F.col("x.m")).alias("o_totalprice"))


@query("ranked_earlier_order", """SELECT a.o_orderkey, b.o_orderkey AS earliest FROM orders a LEFT JOIN (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS rn FROM orders) b ON b.o_custkey = a.o_custkey AND b.rn = 1 AND b.d < CAST(a.o_orderdate AS DATE)""")
def ranked_earlier_order(spark, d):
    # the farthest earlier loan is the customer's first: an aggregate, not a self-join
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    first = F.min(F.struct("date", "o_orderkey")).over(Window.partitionBy("o_custkey"))
    return rows.withColumn("first", first).select("o_orderkey", F.when(F.col("first.date") < F.col("date"), F.col("first.o_orderkey")).alias("earliest"))


@query("lateral_top1", "SELECT c_custkey, o.o_orderkey FROM customer LEFT JOIN (SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1) o ON o.o_custkey = c_custkey")
def lateral_top1(spark, d):
    return spark.sql("SELECT c_custkey, x.o_orderkey FROM {c} LEFT JOIN LATERAL (SELECT max_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS o_orderkey FROM {o} WHERE o_custkey = c_custkey) x", c=table(spark, d, "customer"), o=table(spark, d, "orders"))


FPD = """WITH loans AS (SELECT o_orderkey AS loan, o_custkey AS customer, CAST(o_orderdate AS DATE) AS applied, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth FROM {orders}),
kinds AS (SELECT *, lag(applied) OVER (PARTITION BY customer ORDER BY applied, loan) AS before FROM loans),
due AS (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS due, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS paid FROM {lineitem}),
firsts AS (SELECT l_orderkey, due, paid, rank() OVER (PARTITION BY l_orderkey ORDER BY due, l_linenumber) AS rn FROM due),
outcome AS (SELECT l_orderkey, min(due) AS first_due, 1 - max(paid) AS failed FROM firsts WHERE rn = 1 GROUP BY l_orderkey),
rate AS (SELECT l_orderkey, round(avg(CAST(paid AS DOUBLE)), 4) AS paid_rate FROM due GROUP BY l_orderkey)
SELECT loan, customer, CASE WHEN nth = 1 THEN 'NEW' WHEN datediff_days <= 180 THEN 'RENEWAL' ELSE 'REPEAT' END AS customer_type, first_due, CAST(failed AS BIGINT) AS first_payment_default, paid_rate
FROM (SELECT k.*, {days} AS datediff_days FROM kinds k) k JOIN outcome ON outcome.l_orderkey = loan JOIN rate ON rate.l_orderkey = loan"""


@query("first_payment_default", FPD.replace("{orders}", "orders").replace("{lineitem}", "lineitem").replace("{days}", "date_diff('day', before, applied)"))
def first_payment_default(spark, d):
    return spark.sql(FPD.replace("{days}", "datediff(applied, before)"), orders=table(spark, d, "orders"), lineitem=table(spark, d, "lineitem"))


@query("semi_active_accounts", f"WITH {ORDERS_SQL} SELECT account, balance FROM accounts WHERE account IN (SELECT account FROM ledger)")
def semi_active_accounts(spark, d):
    return accounts(spark, d).join(orders_ledger(spark, d), "account", "left_semi").select("account", "balance")


@query("anti_unseen", f"WITH {ORDERS_SQL} SELECT account, balance FROM accounts WHERE account NOT IN (SELECT account FROM ledger)")
def anti_unseen(spark, d):
    return accounts(spark, d).join(orders_ledger(spark, d), "account", "left_anti").select("account", "balance")


@query("outer_importance", "SELECT coalesce(a.k, b.k) AS k, a.n AS before, b.n AS after FROM (SELECT p_brand AS k, count(*) AS n FROM part WHERE p_size <= 25 GROUP BY 1) a FULL JOIN (SELECT p_brand AS k, count(*) AS n FROM part WHERE p_size > 45 GROUP BY 1) b ON a.k = b.k")
def outer_importance(spark, d):
    part = table(spark, d, "part")
    count = lambda c, n: part.where(c).groupBy(F.col("p_brand").alias("k")).agg(F.count("*").alias(n))
    return count("p_size <= 25", "before").join(count("p_size > 45", "after"), "k", "full_outer")


@query("union_sources", f"WITH {ORDERS_SQL} SELECT account, 'credit' AS kind, count(*) AS n FROM ledger WHERE type = 'CREDIT' GROUP BY 1 UNION ALL SELECT account, 'debit' AS kind, count(*) AS n FROM ledger WHERE type = 'DEBIT' GROUP BY 1")
def union_sources(spark, d):
    return orders_ledger(spark, d).groupBy("account", F.lower("type").alias("kind")).agg(F.count("*").alias("n"))


@query("feature_set_difference", "SELECT DISTINCT p_brand FROM part WHERE p_size > 25 AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 1)")
def feature_set_difference(spark, d):
    part = table(spark, d, "part")
    return part.where("p_size > 25").select("p_brand").subtract(part.where("p_size = 1").select("p_brand"))


@query("card_tails", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN right(lpad(CAST(c_custkey AS VARCHAR), 6, '9'), 4) ELSE '' END AS tails FROM customer")
def card_tails(spark, d):
    number = F.lpad(F.col("c_custkey").cast("string"), 6, "9")
    text = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Paid with CARD ending "), number)).otherwise(F.concat(F.lit("gift card "), number))
    return table(spark, d, "customer").select("c_custkey", F.array_join(T.card_tails(text), ",").alias("tails"))


@query("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("category_normalised", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Food/Out' WHEN 1 THEN 'Other' WHEN 2 THEN NULL ELSE p_type END AS category FROM part")
def category_normalised(spark, d):
    k = F.col("p_partkey") % 4
    return table(spark, d, "part").select("p_partkey", T.category_text(F.when(k == 0, '[" Food", "Out", ""]').when(k == 1, "123").when(k == 3, F.col("p_type"))).alias("category"))


@query("alerts", f"""{O}, per AS (SELECT account, sum(CASE WHEN type = 'CREDIT' THEN amount ELSE 0 END) AS c, sum(CASE WHEN type = 'DEBIT' THEN amount ELSE 0 END) AS b, min(age) AS quiet FROM aged GROUP BY account)
SELECT account, concat_ws('|', CASE WHEN c < 600000 THEN 'low_credit' END, CASE WHEN b > 500000 THEN 'high_debit' END, CASE WHEN quiet > 180 THEN 'quiet' END) AS alerts FROM per""")
def alerts(spark, d):
    ledger, _, as_of = _orders(spark, d)
    side = lambda t: F.sum(F.when(F.col("type") == t, F.col("amount")).otherwise(0.0))
    per = M.aged(ledger, as_of).groupBy("account").agg(side("CREDIT").alias("c"), side("DEBIT").alias("b"), F.min("age").alias("quiet"))
    return S.alerts(per, {"low_credit": F.col("c") < 600000, "high_debit": F.col("b") > 500000, "quiet": F.col("quiet") > 180})


@query("session_gap", "WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM x) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def session_gap(spark, d):
    events = table(spark, d, "events")
    return events.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


# --- without SQL: trained, iterative or per-group numeric ---


@query("soundex_match")
def soundex_match(spark, d):
    """Names of customers against those of the customer with the next key."""
    names = table(spark, d, "customer").select("c_custkey", F.regexp_replace("c_name", "[#0-9]+", "").alias("a"))
    other = table(spark, d, "customer").select((F.col("c_custkey") - 1).alias("c_custkey"), F.concat(F.lit("Mr. "), F.regexp_replace("c_name", "[#0-9]+", "")).alias("b"))
    return names.join(other, "c_custkey").select("c_custkey", T.name_match(F.col("a"), F.col("b")).alias("match"))


_DIST = lambda x: f"coalesce(least(((dom - {x}) % 30 + 30) % 30, (({x} - dom) % 30 + 30) % 30), 30)"


@query("income_sources", f"""WITH {REGULAR_SQL}, ledger AS (SELECT * FROM regular), {DAYS}, {_FREQ}, z AS (SELECT max(date) AS d FROM regular),
q AS (SELECT fq.*, CASE WHEN frequency IN ('W', 'B') THEN ws WHEN frequency IN ('M', 'S') THEN ds WHEN n > 4 AND ws > cut THEN ws WHEN n > 4 THEN ds ELSE 0.0 END AS same, CASE WHEN frequency <> 'M' THEN d2 END AS dd2,
 CASE WHEN frequency IN ('W', 'B') OR (frequency = 'I' AND n > 4 AND ws > cut) THEN ['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'][CAST(wd AS INTEGER) + 1] WHEN frequency = 'M' THEN CAST(d1 AS VARCHAR) WHEN frequency = 'S' OR (frequency = 'I' AND n > 4) THEN concat_ws(',', CAST(least(d1, d2) AS VARCHAR), CAST(greatest(d1, d2) AS VARCHAR)) END AS regular_day,
 round(mean * CASE frequency WHEN 'W' THEN 52.0 / 12 WHEN 'B' THEN 26.0 / 12 WHEN 'S' THEN 2.0 WHEN 'M' THEN 1.0 ELSE CASE WHEN span >= 30 THEN n * 30.0 / span ELSE n END END, 2) AS monthly FROM fq),
st AS (SELECT g.account, max(g.date) AS last, max(gap) AS gap, least(coalesce(stddev_samp(amount) / avg(amount), 1.0), 1.0) AS cv, avg(amount) AS pay, avg(CASE WHEN frequency IN ('W', 'B') OR least({_DIST("d1")}, {_DIST("dd2")}, date_diff('day', g.date, last_day(g.date))) <= 3 THEN 1.0 ELSE 0.0 END) AS close FROM g JOIN q ON q.account = g.account GROUP BY 1),
r AS (SELECT q.*, last, gap, cv, pay, close, date_diff('day', last, z.d) AS age, CASE frequency WHEN 'W' THEN 10 WHEN 'B' THEN 18 WHEN 'S' THEN 18 WHEN 'M' THEN 35 ELSE 30 END AS lim, CASE WHEN frequency IN ('M', 'I') THEN 40 ELSE 35 END AS wide, n >= CASE WHEN frequency = 'I' THEN 4 ELSE 2 END AS enough FROM q JOIN st ON st.account = q.account CROSS JOIN z),
e AS (SELECT *, CAST(CASE WHEN NOT enough THEN 0 WHEN cv <= 0.33 THEN 3 WHEN cv <= 0.5 THEN 2 ELSE 1 END AS BIGINT) AS stability_score, CAST(CASE WHEN age > lim AND frequency <> 'I' THEN 401 ELSE 0 END AS BIGINT) AS error_code FROM r)
SELECT account, cluster, concat('I1_err_', error_code) AS source_id, 'Payroll' AS income_type, n AS pays, frequency, round(pay, 2) AS pay, monthly AS monthly_income, round(CASE WHEN stability_score = 3 THEN monthly ELSE monthly * (1 - round(cv, 4)) END, 2) AS stable_monthly_income, regular_day, round(same, 4) AS same_day_share, last,
 CAST(CASE WHEN NOT enough THEN 0 WHEN age > lim THEN 1 WHEN gap >= wide THEN 2 ELSE 3 END AS BIGINT) AS active_score, CAST(CASE WHEN NOT enough THEN 0 WHEN regular_day IS NULL OR close < 0.75 THEN 1 WHEN round(same, 4) >= 0.75 THEN 3 ELSE 2 END AS BIGINT) AS recurring_score, stability_score, error_code FROM e""")
def income_sources(spark, d):
    ledger = _regular(spark, d)
    return _longs(I.income_sources(ledger, last_date(ledger)))


@query("shifted_weekday_pattern")
def shifted_weekday_pattern(spark, d):
    return Q.shifted_matches(_regular(spark, d), C.business_calendar(spark, datetime.date(2020, 12, 1), datetime.date(2022, 1, 31)))


@query("peak_features")
def peak_features(spark, d):
    return P.peak_features(M.daily_series(events_ledger(spark, d)))


@query("text_clusters")
def text_clusters(spark, d):
    parts = table(spark, d, "part").select(F.col("p_brand").alias("account"), F.lower("p_type").alias("description"))
    return X.text_clusters(parts, cut=0.4)


@query("risk_scores")
def risk_scores(spark, d):
    """A tree model of first-payment default on account features, its points and its largest contributions."""
    ledger, accts, as_of = _orders(spark, d)
    features = ["credit", "debit", "net_cash_flow", "spending"]
    label = first_payment_default(spark, d).groupBy(F.col("customer").cast("string").alias("account")).agg(F.max("first_payment_default").cast("double").alias("label"))
    rows = M.cashflow(ledger, accts, as_of).join(label, "account")
    fold = S.grouped_split(rows, "account")
    model = S.fit_trees(rows.where(fold == 0), features, "label", trees=5, depth=3)
    return S.predict(model, rows).select("account", F.round("p", 6).alias("p"), T.log_odds_score(F.col("p")).alias("score"))


@query("tree_contributions")
def tree_contributions(spark, d):
    """Exact contributions of the features to each account's log-odds."""
    ledger, accts, as_of = _orders(spark, d)
    features = ["credit", "debit", "net_cash_flow", "spending"]
    label = first_payment_default(spark, d).groupBy(F.col("customer").cast("string").alias("account")).agg(F.max("first_payment_default").cast("double").alias("label"))
    rows = M.cashflow(ledger, accts, as_of).join(label, "account")
    model = S.fit_trees(rows.where(S.grouped_split(rows, "account") == 0), features, "label", trees=5, depth=3)
    return A.contributions(model, rows, features).select("account", "feature", F.round("contribution", 9).alias("contribution"))
