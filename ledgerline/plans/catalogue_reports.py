"""Queries on roll-ups, reasons, recommendations, matching and label columns, each with the SQL that gives the same rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as B
from ..functions import matching as H
from ..functions import text as T
from ..operators import calendar as C
from ..operators import frequency as Q
from ..operators import income as I
from ..operators import lookup as L
from ..operators import money as M
from ..operators import reports as R
from ..operators import scoring as S
from ..sources import documents as D
from ..sources.adapters import EVENTS_SQL, ORDERS_SQL, accounts, events_ledger, last_date, orders_ledger, table
from .catalogue import AGED, SOURCES, _longs, _sources
from .registry import query

#: Sources with scores that differ, and loans, over the orders.
SRC = f"""{ORDERS_SQL}, {SOURCES}, s AS (SELECT *, CAST(length(income_type) % 4 AS BIGINT) AS recurring_score FROM src),
loan AS (SELECT account, cluster, max(amount) AS amount, count(*) AS n_payments, CAST(count(*) % 3 AS BIGINT) AS n_originations, CAST(CASE WHEN count(*) = 2 THEN 304 ELSE 0 END AS BIGINT) AS error_code FROM ledger WHERE type = 'DEBIT' GROUP BY 1, 2)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return _sources(spark, d).withColumn("recurring_score", (F.length("income_type") % 4).cast("long"))


def _loans(spark: SparkSession, d: str) -> DataFrame:
    n = F.count("*")
    return _longs(orders_ledger(spark, d).where("type = 'DEBIT'").groupBy("account", "cluster").agg(F.max("amount").alias("amount"), n.alias("n_payments"), (n % 3).alias("n_originations"), F.when(n == 2, 304).otherwise(0).alias("error_code")))


@query("recurring_monthly_income", f"""WITH {SRC}, p AS (SELECT account, round(sum(CASE WHEN error_code = 0 AND active_score = 3 THEN monthly_income END), 2) AS x, round(sum(CASE WHEN error_code = 0 AND recurring_score = 3 THEN monthly_income END), 2) AS y FROM s GROUP BY 1)
SELECT accounts.account, x AS active_monthly_income, y AS recurring_monthly_income FROM accounts LEFT JOIN p ON p.account = accounts.account""")
def recurring_monthly_income(spark, d):
    return R.recurring_monthly(_scored(spark, d), accounts(spark, d))


_CELLS = lambda name: ", ".join(f"count(CASE WHEN {name} = {k} THEN 1 END) AS {name}_{k}_count, round(coalesce(sum(CASE WHEN {name} = {k} THEN monthly_income END), 0.0), 4) AS {name}_{k}_sum" for k in range(4))


@query("pivot_by_score", f"WITH {SRC} SELECT account, {_CELLS('recurring_score')} FROM s GROUP BY account")
def pivot_by_score(spark, d):
    return R.by_score(_scored(spark, d), "recurring_score")


@query("loan_rollup", f"""WITH {SRC}, p AS (SELECT account, count(*) AS n, CAST(sum(n_payments) AS BIGINT) AS a, CAST(sum(n_originations) AS BIGINT) AS b FROM loan WHERE error_code = 0 GROUP BY 1)
SELECT accounts.account, coalesce(n, 0) AS n_loans, coalesce(a, 0) AS n_payments, coalesce(b, 0) AS n_originations FROM accounts LEFT JOIN p ON p.account = accounts.account""")
def loan_rollup(spark, d):
    return R.loan_rollup(_loans(spark, d), accounts(spark, d))


@query("model_input", f"""WITH {SRC}, k AS (SELECT account, count(CASE WHEN income_type = '2-HIGH' THEN 1 END) AS n, round(coalesce(sum(CASE WHEN income_type = '2-HIGH' THEN monthly_income END), 0.0), 4) AS t FROM s GROUP BY 1),
a AS (SELECT account, {_CELLS('active_score')} FROM s GROUP BY account), r AS (SELECT account, {_CELLS('recurring_score')} FROM s GROUP BY account), p AS (SELECT account, count(*) AS n_loans, CAST(sum(n_payments) AS BIGINT) AS n_payments, CAST(sum(n_originations) AS BIGINT) AS n_originations FROM loan WHERE error_code = 0 GROUP BY 1)
SELECT accounts.account, coalesce(n, 0) AS "2-HIGH_count", coalesce(t, 0) AS "2-HIGH_sum", {", ".join(f"coalesce({x}_score_{i}_{c}, 0) AS {x}_score_{i}_{c}" for x in ("active", "recurring") for i in range(4) for c in ("count", "sum"))}, coalesce(n_loans, 0) AS n_loans, coalesce(n_payments, 0) AS n_payments, coalesce(n_originations, 0) AS n_originations
FROM accounts LEFT JOIN k ON k.account = accounts.account LEFT JOIN a ON a.account = accounts.account LEFT JOIN r ON r.account = accounts.account LEFT JOIN p ON p.account = accounts.account""")
def model_input(spark, d):
    return R.model_input(_scored(spark, d), _loans(spark, d), accounts(spark, d), ["2-HIGH"])


@query("alerts_and_insights", f"""WITH {ORDERS_SQL}, {AGED}, h AS (SELECT account, max(age) - min(age) AS days, sum(CASE WHEN type = 'CREDIT' THEN amount ELSE 0 END) / 100000 AS inc, sum(CASE WHEN type = 'DEBIT' THEN amount ELSE 0 END) AS debit FROM aged GROUP BY 1),
r AS (SELECT account, CAST(account AS BIGINT) % 100 AS score FROM h WHERE CAST(account AS BIGINT) % 2 = 0)
SELECT h.account, CASE WHEN score <= 50 THEN 'YES' ELSE 'NO' END AS risk_behavior, CASE WHEN score <= 50 THEN 'few payments' ELSE concat_ws('|', CASE WHEN days <= 30 THEN 'Increased Default Risk: Income Detected for < 30 Consecutive Days' END, CASE WHEN inc <= 0 THEN 'Increased Default Risk: No Active Income Detected' END) END AS alerts,
 CASE WHEN debit >= 50000 THEN 'High Repeat Opportunity: High Monthly Expenses' ELSE '' END AS insights FROM h LEFT JOIN r ON r.account = h.account""")
def alerts_and_insights(spark, d):
    ledger = orders_ledger(spark, d)
    side = lambda t: F.sum(F.when(F.col("type") == t, F.col("amount")).otherwise(0.0))
    rows = M.aged(ledger, last_date(ledger)).groupBy("account").agg((F.max("age") - F.min("age")).alias("income_history_days"), (side("CREDIT") / 100000).alias("active_monthly_income"), side("DEBIT").alias("debit"))
    number = F.col("account").cast("long")
    risk = rows.where(number % 2 == 0).select("account", (number % 100).alias("score"))
    out = R.alerts_and_insights(rows, risk, rows.select("account", F.array(F.lit("few payments")).alias("bad")))
    return out.select("account", "risk_behavior", F.array_join("alerts", "|").alias("alerts"), F.array_join("insights", "|").alias("insights"))


@query("universal_reasons", f"""WITH {EVENTS_SQL}, w AS (SELECT account, count(CASE WHEN description = 'view' AND type = 'CREDIT' THEN 1 END) AS f, count(CASE WHEN description = 'purchase' AND type = 'DEBIT' THEN 1 END) AS p, count(CASE WHEN description = 'error' THEN 1 END) AS i FROM ledger CROSS JOIN day_ WHERE date >= d - 7 GROUP BY 1),
a AS (SELECT DISTINCT account FROM ledger), x AS (SELECT a.account, coalesce(f, 0) AS f, coalesce(p, 0) AS p, coalesce(i, 0) AS i, CAST(a.account AS BIGINT) % 3 = 0 AS gone, CAST(a.account AS BIGINT) % 10 AS ds FROM a LEFT JOIN w ON w.account = a.account)
SELECT account, concat_ws('|', CASE WHEN gone THEN 'Recent Payroll Absent - Job Loss Risk' END, CASE WHEN f > 0 THEN concat(f, ' Loan(s) Funded within the week') END, CASE WHEN i > 0 THEN 'Recent Overdraft Identified' END, CASE WHEN ds <= 3 THEN 'Unfavorable Spending Ratio - High Risk' END) AS bad,
 concat_ws('|', CASE WHEN p > 0 THEN concat(p, ' Loan Payment(s) made this week') END, CASE WHEN ds >= 7 THEN 'Good Spending Ratio - Low Risk' END) AS good FROM x""")
def universal_reasons(spark, d):
    ledger = events_ledger(spark, d)
    who, number = ledger.select("account").distinct(), F.col("account").cast("long")
    sources = who.select("account", F.when(number % 3 == 0, 401).otherwise(0).alias("error_code"))
    spending = who.select("account", (number % 10).alias("days_to_spend"))
    out = R.universal_reasons(who, sources, ledger, spending, last_date(ledger), F.col("description") == "error", F.col("description").isin("view", "purchase"))
    return out.select("account", F.array_join("bad", "|").alias("bad"), F.array_join("good", "|").alias("good"))


_REASONS = "m AS (SELECT CAST(l_suppkey AS VARCHAR) AS account, CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END AS sign, l_linenumber AS rank, concat('r', l_linenumber) AS reason FROM lineitem GROUP BY ALL)"


@query("combined_reasons", f"""WITH {_REASONS}, u AS (SELECT DISTINCT account, concat('r', CAST(account AS BIGINT) % 7) AS extra FROM m),
b AS (SELECT account, 'b' AS side, rank AS o, reason FROM m WHERE sign = 1 UNION ALL SELECT account, 'b', 99, extra FROM u UNION ALL SELECT account, 'g', rank, reason FROM m WHERE sign = -1 UNION ALL SELECT account, 'g', 99, 'late' FROM u WHERE CAST(account AS BIGINT) % 2 = 0),
f AS (SELECT account, side, reason, min(o) AS o FROM b GROUP BY 1, 2, 3), k AS (SELECT * FROM f WHERE NOT (reason = 'r2' AND EXISTS (SELECT 1 FROM f z WHERE z.account = f.account AND z.side = f.side AND z.reason = 'r4')))
SELECT account, coalesce(string_agg(CASE WHEN side = 'b' THEN reason END, '|' ORDER BY o), '') AS bad, coalesce(string_agg(CASE WHEN side = 'g' THEN reason END, '|' ORDER BY o), '') AS good FROM k GROUP BY 1""")
def combined_reasons(spark, d):
    line = F.col("l_linenumber")
    model = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("account"), F.when(line % 2 == 0, 1).otherwise(-1).alias("sign"), line.alias("rank"), F.concat(F.lit("r"), line.cast("string")).alias("reason")).distinct()
    who = model.select("account").distinct()
    number = F.col("account").cast("long")
    universal = who.select("account", F.array(F.concat(F.lit("r"), (number % 7).cast("string"))).alias("bad"), F.when(number % 2 == 0, F.array(F.lit("late"))).otherwise(F.array().cast("array<string>")).alias("good"))
    out = R.combined_reasons(who, model, universal, {"r2": "r4"})
    return out.select("account", F.array_join("bad", "|").alias("bad"), F.array_join("good", "|").alias("good"))


@query("both_sided_reasons", "WITH b AS (SELECT o_custkey AS a, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS x FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), g AS (SELECT o_custkey AS a, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS x FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) SELECT CAST(b.a AS VARCHAR) AS account, b.x AS bad, g.x AS good FROM b JOIN g ON g.a = b.a")
def both_sided_reasons(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("account"), "o_orderstatus", F.col("o_orderpriority").alias("reason"))
    out = R.both_sided(rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus = 'P'"))
    return out.select("account", F.array_join("bad", "|").alias("bad"), F.array_join("good", "|").alias("good"))


_GUIDE = f"""{SRC}, t AS (SELECT *, CASE WHEN recurring_score = 2 THEN 'I' ELSE frequency END AS fr FROM s), act AS (SELECT *, CASE WHEN recurring_score % 2 = 0 THEN 'A' END AS dir FROM t WHERE error_code = 0 AND active_score = 3),
reg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY monthly_income DESC, cluster) AS rn FROM act WHERE fr <> 'I') WHERE rn = 1), irr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY monthly_income DESC, cluster) AS rn FROM act WHERE fr = 'I') WHERE rn = 1),
dd AS (SELECT a.account, coalesce(reg.income_type, irr.income_type) AS income_type, coalesce(reg.fr, 'W') AS debit_frequency, CASE WHEN reg.account IS NOT NULL THEN '1' ELSE 'ask customer' END AS debit_date, coalesce(CASE WHEN reg.account IS NOT NULL THEN reg.dir ELSE irr.dir END, 'None') AS near FROM (SELECT DISTINCT account FROM act) a LEFT JOIN reg ON reg.account = a.account LEFT JOIN irr ON irr.account = a.account),
sc AS (SELECT account, greatest(balance, 0) / 40 AS score FROM accounts)"""


def _guide_parts(spark: SparkSession, d: str):
    odd = F.col("recurring_score")
    src = _scored(spark, d).withColumns({"frequency": F.when(odd == 2, "I").otherwise(F.col("frequency")), "holiday_direction": F.when(odd % 2 == 0, "A"), "next_on_holiday": F.lit("NO")})
    scores = accounts(spark, d).select("account", (F.greatest("balance", F.lit(0.0)) / 40).alias("score"))
    return src, scores


@query("lending_guide", f"""WITH {_GUIDE} SELECT dd.account, CAST(floor(least(greatest(score * 2.988, 300.0), 1000.0) / 10) * 10 AS BIGINT) AS min_loan, CAST(ceil(least(greatest(score * 3.928, 300.0), 1000.0) / 10) * 10 AS BIGINT) AS max_loan,
 CAST(floor(least(greatest(score * 0.843, 90.0), 300.0) / 10) * 10 AS BIGINT) AS min_debit, CAST(ceil(least(greatest(score * 1.185, 90.0), 300.0) / 10) * 10 AS BIGINT) AS max_debit, income_type, debit_frequency, debit_date, near AS payment_near_holiday, 'NO' AS next_payment_on_holiday,
 CASE WHEN score >= 215 THEN 'High' WHEN score >= 150 THEN 'Medium' ELSE 'Low' END AS repeat_opportunity FROM dd JOIN sc ON sc.account = dd.account""")
def lending_guide(spark, d):
    src, scores = _guide_parts(spark, d)
    return R.lending_guide(scores, src, scores, ["account"])


@query("holiday_top1", f"WITH {_GUIDE} SELECT account, near AS payment_near_holiday FROM dd")
def holiday_top1(spark, d):
    return R.near_holiday(_guide_parts(spark, d)[0], ["account"]).select("account", "payment_near_holiday")


@query("recommend_account_by_score", f"""WITH {SRC}, h AS (SELECT DISTINCT account FROM s WHERE active_score = 3 AND frequency <> 'I' AND error_code = 0),
r AS (SELECT CAST(a.account AS BIGINT) % 50 AS customer, a.account, CASE WHEN h.account IS NULL THEN 0 ELSE 1 END AS has, CAST(a.account AS BIGINT) % 17 AS score FROM accounts a LEFT JOIN h ON h.account = a.account WHERE account_type IN ('BUILDING', 'MACHINERY'))
SELECT CAST(customer AS BIGINT) AS customer, account, CAST(has AS BIGINT) AS has_income FROM (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY has DESC, score DESC, account) AS rn FROM r) WHERE rn = 1""")
def recommend_account_by_score(spark, d):
    number = F.col("account").cast("long")
    own = accounts(spark, d).withColumn("customer", number % 50)
    return _longs(R.recommended_by_score(_scored(spark, d), own, own.select("account", (number % 17).alias("score")), "BUILDING|MACHINERY"))


@query("label_hit_rates", "SELECT o_orderpriority AS label_source, count(*) AS n, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM orders), 6) AS share FROM orders GROUP BY 1")
def label_hit_rates(spark, d):
    return R.hit_rates(table(spark, d, "orders").select(F.col("o_orderpriority").alias("label_source")))


@query("global_rank", "SELECT o_orderkey, CAST(rank() OVER (ORDER BY floor(o_totalprice / 1000) DESC) AS BIGINT) AS rank FROM orders")
def global_rank(spark, d):
    return R.global_rank(table(spark, d, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") / 1000).cast("double").alias("v")), "v").select("o_orderkey", "rank")


@query("lateral_aggregate", "SELECT c_custkey, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0.0), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY 1")
def lateral_aggregate(spark, d):
    """A correlated aggregate for each outer row."""
    return spark.sql("SELECT c_custkey, x.n, round(coalesce(x.total, 0.0D), 2) AS total FROM {c} LEFT JOIN LATERAL (SELECT count(*) AS n, sum(o_totalprice) AS total FROM {o} WHERE o_custkey = c_custkey AND o_orderstatus = 'O') x", c=table(spark, d, "customer"), o=table(spark, d, "orders"))


@query("importance_head", "SELECT p_brand AS k, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, k LIMIT 10")
def importance_head(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k").limit(10)


@query("account_spine", f"""WITH {ORDERS_SQL}, c AS (SELECT account, count(*) AS n_credits FROM ledger WHERE type = 'CREDIT' GROUP BY 1), b AS (SELECT account, count(*) AS n_debits FROM ledger WHERE type = 'DEBIT' GROUP BY 1)
SELECT accounts.account, balance, coalesce(n_credits, 0) AS n_credits, coalesce(n_debits, 0) AS n_debits FROM accounts LEFT JOIN c ON c.account = accounts.account LEFT JOIN b ON b.account = accounts.account""")
def account_spine(spark, d):
    ledger = orders_ledger(spark, d)
    part = lambda t, name: ledger.where(F.col("type") == t).groupBy("account").agg(F.count("*").alias(name))
    return R.spine(accounts(spark, d).select("account", "balance"), part("CREDIT", "n_credits"), part("DEBIT", "n_debits"))


@query("sources_with_missing", f"WITH {SRC}, p AS (SELECT account, income_type, error_code FROM s WHERE income_type = '2-HIGH') SELECT account, income_type, error_code FROM p UNION ALL SELECT account, 'Benefit', CAST(102 AS BIGINT) FROM accounts WHERE account NOT IN (SELECT account FROM p)")
def sources_with_missing(spark, d):
    own = _sources(spark, d).where("income_type = '2-HIGH'").select("account", "income_type", "error_code")
    return _longs(I.with_missing(own, accounts(spark, d), "Benefit").select("account", "income_type", "error_code"))


@query("combined_source_ids", f"""WITH {SRC}, u AS (SELECT account, cluster, error_code, 0 AS k FROM s WHERE income_type = '2-HIGH' UNION ALL SELECT account, cluster, CAST(305 AS BIGINT), 1 FROM s WHERE income_type = '1-URGENT' UNION ALL SELECT account, cluster, error_code, 2 FROM s WHERE income_type = '3-MEDIUM')
SELECT account, cluster, CASE WHEN error_code <> 305 THEN concat('I', row_number() OVER (PARTITION BY account ORDER BY CASE WHEN error_code = 305 THEN 1 ELSE 0 END, k, cluster), '_err_', error_code) END AS source_id FROM u""")
def combined_source_ids(spark, d):
    src = _sources(spark, d).select("account", "cluster", "error_code", "income_type")
    part = lambda t: src.where(F.col("income_type") == t).drop("income_type")
    out = I.combined_sources(part("2-HIGH"), part("1-URGENT").withColumn("error_code", F.lit(305).cast("long")), part("3-MEDIUM"))
    return out.select("account", "cluster", "source_id")


@query("truncate_per_request", """WITH l AS (SELECT CAST(o_custkey % 40 AS BIGINT) AS request_id, o_orderkey, CAST(o_orderdate AS DATE) AS date, CAST(DATE '1995-01-01' + CAST((o_custkey % 40) * 30 AS INTEGER) AS DATE) AS as_of FROM orders), k AS (SELECT * FROM l WHERE date <= as_of),
f AS (SELECT request_id, CAST(date_trunc('month', CAST(max(date) - INTERVAL 3 MONTH AS DATE)) AS DATE) AS first FROM k GROUP BY 1) SELECT k.request_id, o_orderkey FROM k JOIN f ON f.request_id = k.request_id WHERE date >= first""")
def truncate_per_request(spark, d):
    """Each request is cut at its own as-of date and reaches back from its own last row."""
    request = (F.col("o_custkey") % 40).cast("long")
    rows = table(spark, d, "orders").select(request.alias("request_id"), "o_orderkey", F.col("o_orderdate").cast("date").alias("date"), F.date_add(F.lit("1995-01-01").cast("date"), (request * 30).cast("int")).alias("as_of"))
    return M.truncate(rows, F.col("as_of"), 3, ("request_id",)).select("request_id", "o_orderkey")


@query("entity_lookup", """WITH x AS (SELECT o_orderkey, o_orderpriority AS who, o_orderstatus AS why, CAST(o_orderkey % 3 AS VARCHAR) AS how FROM orders)
SELECT o_orderkey, CASE WHEN who = '1-URGENT' AND why = 'F' AND how = '0' THEN 'all' WHEN who = '2-HIGH' AND why = 'O' THEN 'who-why' WHEN why = 'P' AND how = '1' THEN 'why-how' WHEN why = 'F' THEN 'why' WHEN who = '3-MEDIUM' AND how = '2' THEN 'who-how' WHEN who = '2-HIGH' THEN 'who' WHEN how = '0' THEN 'how' ELSE 'Undecided' END AS label FROM x""")
def entity_lookup(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("who"), F.col("o_orderstatus").alias("why"), (F.col("o_orderkey") % 3).cast("string").alias("how"))
    base = [(0, "1-URGENT", "F", "0", "all"), (1, "2-HIGH", "O", None, "who-why"), (2, None, "P", "1", "why-how"), (3, None, "F", None, "why"), (4, "3-MEDIUM", None, "2", "who-how"), (5, "2-HIGH", None, None, "who"), (6, None, None, "0", "how")]
    return L.entity_label(rows, spark.createDataFrame(base, "shape int, who string, why string, how string, label string")).select("o_orderkey", "label")




@query("six_shape_lookup", """WITH x AS (SELECT o_orderkey, o_custkey % 5 AS a, o_orderstatus AS t, o_orderpriority AS p FROM orders)
SELECT o_orderkey, CAST(CASE WHEN a = 0 AND t = 'F' AND p = '1-URGENT' THEN 0 WHEN a = 1 AND t = 'O' THEN 1 WHEN a = 2 AND p = '2-HIGH' THEN 2 WHEN t = 'P' AND p = '3-MEDIUM' THEN 3 WHEN a = 3 THEN 4 WHEN t = 'F' THEN 5 END AS BIGINT) AS hit FROM x""")
def six_shape_lookup(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 5).cast("int").alias("a"), F.col("o_orderstatus").alias("t"), F.col("o_orderpriority").alias("p"))
    base = [(0, 0, "F", "1-URGENT", "x"), (1, 1, "O", None, "x"), (2, 2, None, "2-HIGH", "x"), (3, None, "P", "3-MEDIUM", "x"), (4, 3, None, None, "x"), (5, None, "F", None, "x")]
    out = L.prioritised(rows, spark.createDataFrame(base, "shape int, a int, t string, p string, label string"), [["a", "t", "p"], ["a", "t"], ["a", "p"], ["t", "p"], ["a"], ["t"]])
    return _longs(out.select("o_orderkey", "hit"))


@query("category_flags", "SELECT o_orderkey, o_orderpriority = '1-URGENT' AS is_payroll, o_orderpriority = '2-HIGH' AS is_benefit, false AS is_transfer, false AS is_deposit, false AS is_gig FROM orders")
def category_flags(spark, d):
    p = F.col("o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", *B.category_flags(F.when(p == "1-URGENT", "Payroll").when(p == "2-HIGH", "benefit")))


@query("unknown_history_labels", "SELECT CAST(o_custkey AS VARCHAR) AS request_id, CAST(501 AS BIGINT) AS code, concat('unknown labels: ', string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority)) AS message FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY 1")
def unknown_history_labels(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("request_id"), F.col("o_orderpriority").alias("label"))
    return _longs(B.unknown_labels(rows, ["1-URGENT", "2-HIGH", "3-MEDIUM"]))


@query("label_defaults", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'None' ELSE o_orderstatus END AS label, 'None' AS who FROM orders")
def label_defaults(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("category_label"))
    return B.with_defaults(B.as_input(rows), ["label", "who"])


@query("interval_bin_flags", f"WITH b AS (SELECT p_partkey, CASE WHEN p_size <= 1 THEN '1' WHEN p_size <= 5 THEN '2-5' WHEN p_size <= 8 THEN '6-8' WHEN p_size <= 12 THEN '9-12' WHEN p_size <= 17 THEN '13-17' WHEN p_size <= 24 THEN '18-24' WHEN p_size <= 35 THEN '24-35' ELSE '36+' END AS b FROM part) SELECT p_partkey, {', '.join(f'CAST(CASE WHEN b = {x!r} THEN 1 ELSE 0 END AS BIGINT) AS bin_{k}' for k, x in enumerate(B.BINS))} FROM b")
def interval_bin_flags(spark, d):
    from ..operators.clusters import interval_bin

    return _longs(table(spark, d, "part").select("p_partkey", *B.bin_flags(interval_bin(F.col("p_size")), "bin")))


@query("amount_classes", """SELECT p_partkey, CASE WHEN p_retailprice / 100 < 10 THEN 'minor' WHEN p_retailprice / 100 < 100 THEN 'small' WHEN p_retailprice / 100 < 1000 THEN 'medium' ELSE 'major' END AS amount_class,
 CASE WHEN p_size / 50.0 >= 0.9 THEN 'high' WHEN p_size / 50.0 >= 0.7 THEN 'medium' WHEN p_size / 50.0 >= 0.5 THEN 'low' ELSE 'none' END AS consistency, CAST(p_size * 2 AS BIGINT) AS percent FROM part""")
def amount_classes(spark, d):
    share = F.col("p_size") / F.lit(50.0)
    return table(spark, d, "part").select("p_partkey", B.amount_class(F.col("p_retailprice") / 100).alias("amount_class"), B.consistency_class(share).alias("consistency"), B.whole_percent(share).alias("percent"))


@query("ngram_presence", "SELECT p_partkey, CAST(CASE WHEN contains(concat(' ', p_type, ' '), ' STEEL ') THEN 1 ELSE 0 END AS BIGINT) AS has_0, CAST(CASE WHEN contains(concat(' ', p_type, ' '), ' PLATED BRASS ') THEN 1 ELSE 0 END AS BIGINT) AS has_1 FROM part")
def ngram_presence(spark, d):
    return _longs(table(spark, d, "part").select("p_partkey", *B.ngram_presence(F.col("p_type"), ["STEEL", "PLATED BRASS"])))


@query("clean_output_rows", "SELECT CAST(o_custkey AS VARCHAR) AS account, o_orderkey AS id, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS who FROM orders WHERE o_orderstatus <> 'P'")
def clean_output_rows(spark, d):
    rows = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") != "P", F.col("o_custkey").cast("string")).alias("account"), "o_orderkey", F.when(F.col("o_orderpriority") == "5-LOW", "None").otherwise(F.col("o_orderpriority")).alias("who_label"))
    return B.clean_output(rows, {"o_orderkey": "id", "who_label": "who"})


@query("nested_documents", f"""WITH {ORDERS_SQL}, c AS (SELECT account, count(*) AS n, min(txn_id) AS first, max(txn_id) AS last FROM ledger GROUP BY 1)
SELECT accounts.account, coalesce(n, 0) AS n, first, last, n AS rows_all FROM accounts LEFT JOIN c ON c.account = accounts.account""")
def nested_documents(spark, d):
    """Documents with a list of transactions and a flat window, read back field by field."""
    ledger = orders_ledger(spark, d)
    window = ledger.groupBy("account").agg(F.count("*").alias("rowsAll"))
    out = D.nested_by_account(accounts(spark, d).select("account"), {"transactions": ledger.select("account", "txn_id", "amount")}, {"counts": window}, {"rowsAll": "rows_all"})
    ids = F.transform(B.without_fields(F.col("transactions"), ["amount"]), lambda x: x["txn_id"])
    return out.select("account", F.size("transactions").cast("long").alias("n"), F.array_min(ids).alias("first"), F.array_max(ids).alias("last"), "rows_all")


@query("keyed_documents", "SELECT CAST(o_custkey % 9 AS BIGINT) AS request_id, CAST(o_custkey AS VARCHAR) AS account, count(*) AS n FROM orders GROUP BY 1, 2")
def keyed_documents(spark, d):
    """One map per request, exploded again."""
    rows = table(spark, d, "orders").groupBy((F.col("o_custkey") % 9).cast("long").alias("request_id"), F.col("o_custkey").cast("string").alias("account")).agg(F.count("*").alias("n"))
    return D.keyed(rows).select("request_id", F.explode("by_key").alias("account", "x")).select("request_id", "account", "x.n")


@query("claim_search", """SELECT CAST(p_size AS BIGINT) AS size, bool_or(contains(concat(' ', lower(p_name), ' '), ' blue ')) AS found, count(CASE WHEN contains(concat(' ', lower(p_name), ' '), ' blue ') THEN 1 END) AS n FROM part GROUP BY 1""")
def claim_search(spark, d):
    found, n = H.found_in(F.col("p_name"), F.lit("Blue"))
    return table(spark, d, "part").groupBy(F.col("p_size").cast("long").alias("size")).agg(found.alias("found"), n.alias("n"))


@query("application_match", """SELECT c_custkey, c_custkey % 2 = 0 AS city, c_custkey % 3 = 0 AS state, true AS zip, c_custkey % 5 = 0 AS phone, c_custkey % 7 = 0 AS bank, CAST(c_custkey AS VARCHAR) AS number, CASE WHEN c_custkey % 4 > 0 THEN round(c_acctbal / (c_custkey % 4 * 1000), 2) + 0.0 END AS claim FROM customer""")
def application_match(spark, d):
    k = F.col("c_custkey")
    known = H.address_match(F.when(k % 2 == 0, " Troy").otherwise("Rome"), F.when(k % 3 == 0, "US-NY").otherwise("CA"), F.lit("12345-6789"), F.array(F.lit("TROY"), F.lit(None).cast("string")), F.array(F.lit("ny")), F.array(F.lit("12345")))
    phone = H.phone_match(F.when(k % 5 == 0, "+1 (555) 010-0199").otherwise("5550100198"), F.array(F.lit("555-010-0199")))
    bank = H.bank_brand(F.array(F.lit("Other"), F.when(k % 7 == 0, "First Acorn Bank").otherwise("Acorns")), ["acorn"])
    return table(spark, d, "customer").select("c_custkey", *[v.alias(n) for n, v in known.items()], phone.alias("phone"), bank.alias("bank"), H.numeric_text(F.concat(F.lit("00"), k.cast("string"))).alias("number"), H.claim_ratio(k % 4 * 1000, F.col("c_acctbal")).alias("claim"))


@query("entity_texts", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'ACME 12 pay' WHEN 1 THEN 'a b' ELSE 'x' END AS cleaned, CASE p_partkey % 3 WHEN 0 THEN 'acme pay' WHEN 1 THEN 'Who' ELSE 'none' END AS who, 'acme|b c' AS entities FROM part")
def entity_texts(spark, d):
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, "ACME12/*pay").when(k == 1, "a - b").otherwise("x")
    who = H.who_or_text(F.when(k == 1, "Who").otherwise(""), F.when(k == 2, "123").otherwise("ACME 12 pay"))
    found = H.entities(F.array(F.lit("Acme Acme"), F.lit("acme"), F.lit(""), F.lit("b c")))
    return table(spark, d, "part").select("p_partkey", H.entity_text(text).alias("cleaned"), who.alias("who"), F.array_join(found, "|").alias("entities"))


_IN = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_CITIES = ["springfield", "troy"]
#: The cleaner over tokens in rows: neighbours by windows, classes by CASE.
_CLEAN = f"""
WITH k AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\t\\n\\x0B\\f\\r ]+'), lambda x: x <> '') AS ts FROM documents),
t AS (SELECT doc_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM k),
c AS (SELECT *, regexp_replace(lower(t), '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g') AS c FROM t),
n AS (SELECT *, coalesce(lag(c, 1) OVER o, '') AS p, coalesce(lag(c, 2) OVER o, '') AS q, coalesce(lead(c, 1) OVER o, '') AS f FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
d AS (SELECT *, regexp_full_match(c, '[0-9]{{1,2}}') AS cd, regexp_full_match(p, '[0-9]{{1,2}}') AS pd, regexp_full_match(q, '[0-9]{{1,2}}') AS qd, regexp_full_match(f, '[0-9]{{1,2}}') AS fd,
  regexp_full_match(c, '({T.MONTHS})[a-z]*') AS cm, regexp_full_match(p, '({T.MONTHS})[a-z]*') AS pm, regexp_full_match(q, '({T.MONTHS})[a-z]*') AS qm, regexp_full_match(f, '({T.MONTHS})[a-z]*') AS fm FROM n),
s AS (SELECT doc_id, i, t, CASE WHEN c IN {_IN(T.CODE_WORDS)} AND f <> '' THEN '' WHEN p IN {_IN(T.CODE_WORDS)} AND c <> '' THEN '{T.CODE}' WHEN regexp_matches(lower(t), '^({"|".join(T.CODE_WORDS)})[:#]+[a-z0-9]') THEN '{T.CODE}'
  WHEN length(c) >= 12 AND regexp_full_match(c, '[a-z0-9_]+') AND length(regexp_replace(c, '[^0-9]', '', 'g')) >= 5 THEN '{T.CODE}'
  WHEN regexp_full_match(c, '[0-9]{{1,2}}[-/][0-9]{{1,2}}([-/][0-9]{{2,4}})?|[0-9]{{4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,2}}') THEN '{T.DATE}' WHEN cm AND (pd OR fd) THEN '{T.DATE}' WHEN cd AND (pm OR fm) THEN ''
  WHEN regexp_full_match(c, '[0-9]{{2,4}}') AND ((qm AND pd) OR (qd AND pm)) THEN '' END AS whole FROM d),
v AS (SELECT doc_id, i, whole, CASE WHEN whole IS NULL THEN list_filter(regexp_split_to_array(regexp_replace(lower(CASE WHEN regexp_matches(t, '^[A-Z]') THEN regexp_replace(t, '([^A-Z])([A-Z])', '\\1 \\2', 'g') ELSE t END), '([0-9]{{5,}})', ' \\1 ', 'g'), '[^a-z0-9]+'), lambda x: x <> '') ELSE [whole] END AS ws FROM s),
u AS (SELECT doc_id, i, whole, unnest(ws) AS w, generate_subscripts(ws, 1) AS j FROM v),
x AS (SELECT *, length(w) AS n, length(regexp_replace(w, '[^0-9]', '', 'g')) AS g FROM u),
y AS (SELECT doc_id, i, j, CASE WHEN whole IS NOT NULL THEN w WHEN regexp_full_match(w, 'x{{4,}}') THEN '{T.FOUR}' WHEN n = g AND n < 4 THEN '' WHEN n = g AND n = 4 THEN '{T.FOUR}' WHEN n = g THEN '{T.NUMBER}' WHEN g >= 3 OR (g > 0 AND n >= 9) THEN '{T.NUMBER}' WHEN n = 1 THEN ''
  WHEN w IN {_IN(T.STATES)} THEN '{T.STATE}' WHEN w IN {_IN(_CITIES)} THEN '{T.CITY}' WHEN w IN {_IN(T.PAYROLL)} THEN 'payroll' WHEN starts_with(w, 'payroll') AND n > 7 THEN 'payroll ' || regexp_replace(substr(w, 8), 'payroll$', '') WHEN ends_with(w, 'payroll') AND n > 7 THEN 'payroll ' || left(w, n - 7) ELSE w END AS w FROM x),
z AS (SELECT doc_id, regexp_replace(string_agg(w, ' ' ORDER BY i, j), '\\b(direct|dir) (deposit|dep)\\b', 'dir dep', 'g') AS said FROM y WHERE w <> '' GROUP BY doc_id)
SELECT documents.doc_id, CASE WHEN text IS NULL THEN NULL WHEN len(list_filter(string_split(coalesce(said, ''), ' '), lambda w: w <> '' AND w NOT IN {_IN(T.STOP_WORDS)})) = 0 THEN '{T.SILENT}' ELSE said END AS cleaned FROM documents LEFT JOIN z USING (doc_id)"""


@query("clean_for_ngrams", _CLEAN)
def clean_for_ngrams(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clean_for_ngrams(F.col("text"), _CITIES).alias("cleaned"))


@query("clean_for_clusters", f"""
WITH k AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\t\\n\\x0B\\f\\r ]+'), lambda x: x <> '') AS ts FROM documents),
t AS (SELECT doc_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM k),
s AS (SELECT doc_id, i, t FROM t WHERE t NOT IN {_IN(T.STOP_WORDS)}),
o AS (SELECT doc_id, t, min(i) AS i FROM s GROUP BY doc_id, t),
g AS (SELECT doc_id, string_agg(t, ' ' ORDER BY i) AS said FROM o GROUP BY doc_id)
SELECT doc_id, coalesce(said, text) AS cleaned FROM documents LEFT JOIN g USING (doc_id)""")
def clean_for_clusters(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clean_for_clusters(F.col("text")).alias("cleaned"))


@query("label_corrections", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'transfer' WHEN 1 THEN 'payroll' WHEN 2 THEN 'other' ELSE 'gig' END AS label FROM orders")
def label_corrections(spark, d):
    k = F.col("o_orderkey") % 4
    label = F.when(k == 3, "gig").otherwise("loan")
    return table(spark, d, "orders").select("o_orderkey", T.predicted_label(label, F.when(k == 0, "atm deposit").when(k == 1, "ACME payroll").when(k == 2, "transfer fee").otherwise("x")).alias("label"))


@query("card_set_union", "SELECT CAST(c_nationkey AS BIGINT) AS nation, CAST(count(DISTINCT right(lpad(CAST(c_custkey AS VARCHAR), 6, '9'), 4)) AS BIGINT) AS cards FROM customer WHERE c_custkey % 3 > 0 GROUP BY 1")
def card_set_union(spark, d):
    number = F.lpad(F.col("c_custkey").cast("string"), 6, "9")
    text = F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("Card #"), number)).otherwise(F.concat(F.lit("wire transfer fee card "), number))
    rows = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("nation"), F.explode(T.card_tails(text)).alias("tail"))
    # distinct tails travel, not lists of them
    return rows.groupBy("nation").agg(F.size(F.collect_set("tail")).cast("long").alias("cards"))


@query("frequency_with_patterns")
def frequency_with_patterns(spark, d):
    """Frequencies with pay-day patterns deciding between two weeks and half months."""
    import datetime

    from .catalogue_paydays import _pays

    pays = _pays(spark, d).withColumn("amount", F.lit(100.0))
    return _longs(Q.frequency(pays, trim=False, calendar=C.business_calendar(spark, datetime.date(2020, 12, 1), datetime.date(2022, 2, 28))).select("account", "frequency", "regular_day", "holiday_direction"))


@query("score_quantile_map")
def score_quantile_map(spark, d):
    scores = table(spark, d, "customer").select(F.col("c_custkey"), F.col("c_acctbal").alias("score"))
    return S.calibrated(scores, scores.select("score"), table(spark, d, "part").select(F.col("p_retailprice").alias("score")))


_POISSON = [sum(math.exp(-1.0) / math.factorial(k) for k in range(n + 1)) for n in range(15)]
_U = "CAST(CAST('0x' || substr(sha256({}), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0"


@query("augmented_rows", f"""WITH {EVENTS_SQL},
u AS (SELECT account, txn_id, amount, {_U.format("'7:copies:' || txn_id")} AS u FROM ledger),
c AS (SELECT account, txn_id, amount, CAST(unnest(range(1, 1 + {" + ".join(f"CASE WHEN u >= {x!r} THEN 1 ELSE 0 END" for x in _POISSON)})) AS INTEGER) AS copy FROM u)
SELECT account, txn_id, round(amount * ({_U.format("'7:factor:' || txn_id || ':' || copy")} * (1.1 - 0.9) + 0.9), 2) AS amount, copy FROM c""")
def augmented_rows(spark, d):
    return R.augmented(events_ledger(spark, d).select("account", "txn_id", "amount"), 1.0, 0.9, 1.1)
