"""Queries on pay-day patterns, each with the SQL that gives the same rows."""

from __future__ import annotations

import datetime
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calendar as C
from ..operators import frequency as Q
from ..operators import paydays as P
from ..sources.adapters import spread, table
from .catalogue import _longs
from .registry import query

FIRST, LAST = datetime.date(2020, 12, 1), datetime.date(2022, 2, 28)
FREE = "2020-12-25 2021-01-01 2021-01-18 2021-02-15 2021-05-31 2021-06-18 2021-07-05 2021-09-06 2021-10-11 2021-11-11 2021-11-25 2021-12-24 2021-12-31 2022-01-17 2022-02-21".split()

#: Pay days of customers by habit (key modulo 6), moved at free days; every seventh customer is irregular.
PAYS_SQL = f"""cal0 AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2020-12-01', TIMESTAMP '2022-02-28', INTERVAL 1 DAY)) AS DATE) AS t),
cal1 AS (SELECT t, isodow(t) < 6 AND t NOT IN ({", ".join(f"DATE '{d}'" for d in FREE)}) AS bd FROM cal0),
cal AS (SELECT t, bd, max(CASE WHEN bd THEN t END) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prv, min(CASE WHEN bd THEN t END) OVER (ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM cal1),
raw AS (SELECT c_custkey AS c, k, CAST(DATE '2021-01-01' + INTERVAL 1 MONTH * CAST(CASE WHEN c_custkey % 6 IN (4, 5) THEN k // 2 ELSE k END AS INTEGER) AS DATE) AS m FROM customer CROSS JOIN (SELECT unnest(generate_series(0, 11)) AS k)),
plan AS (SELECT c, k, CASE c % 6 WHEN 0 THEN m + 4 WHEN 1 THEN last_day(m) WHEN 2 THEN m + CAST((1 - (isodow(m) - 1) + 7) % 7 + 7 AS INTEGER) WHEN 3 THEN last_day(m) - CAST(((isodow(last_day(m)) - 1) - 4 + 7) % 7 AS INTEGER)
 WHEN 4 THEN CASE WHEN k % 2 = 0 THEN m ELSE m + 14 END ELSE CASE WHEN k % 2 = 0 THEN m + 9 ELSE last_day(m) END END AS t FROM raw WHERE c % 5 > 0 OR k < 3),
days AS (SELECT DISTINCT c, CASE WHEN c % 7 = 0 THEN plan.t + CAST((k * k) % 5 AS INTEGER) WHEN bd THEN plan.t WHEN c % 6 = 0 THEN nxt ELSE prv END AS d FROM plan JOIN cal ON cal.t = plan.t),
reach AS (SELECT t AS d, t, 0 AS how FROM cal UNION ALL SELECT nxt, t, 1 FROM cal WHERE NOT bd UNION ALL SELECT prv, t, 2 FROM cal WHERE NOT bd),
hits AS (SELECT days.c, days.d, t, how, date_trunc('month', t) = date_trunc('month', days.d) AS same FROM days JOIN reach ON reach.d = days.d),
sizes AS (SELECT c, count(*) AS n, count(CASE WHEN day(d) <= 28 THEN 1 END) AS e FROM days GROUP BY c)"""

_KIND = {
    0: ("day(t)", "0", "true"), 1: ("0", "0", "t = last_day(t)"), 2: ("isodow(t) - 1", "0", "same AND month(t + 7) <> month(t)"),
    3: ("isodow(t) - 1", "(day(t) - 1) // 7 + 1", "same AND day(d) <= 28 AND day(t) <= 28"), 4: ("isodow(t) - 1", "0", "abs(date_diff('day', d, t)) < 7"),
}
SUPPORT_SQL = f"""{PAYS_SQL}, feats AS ({" UNION ALL ".join(f"SELECT c, d, how, {k} AS kind, CAST({a} AS BIGINT) AS a, CAST({b} AS BIGINT) AS b FROM hits WHERE {w}" for k, (a, b, w) in _KIND.items())}),
counts AS (SELECT c, kind, a, b, count(CASE WHEN how = 0 THEN 1 END) AS raw, count(CASE WHEN how = 1 THEN 1 END) AS aft, count(CASE WHEN how = 2 THEN 1 END) AS bef, min(CASE WHEN how = 0 THEN d END) AS first FROM feats GROUP BY ALL),
tops AS (SELECT *, max(raw) OVER (PARTITION BY c, kind) AS most FROM counts),
scored AS (SELECT tops.*, CASE WHEN kind = 3 THEN e ELSE n END AS n, CAST(raw + aft + bef AS DOUBLE) / CASE WHEN kind = 3 THEN e ELSE n END AS score FROM tops JOIN sizes ON sizes.c = tops.c WHERE (raw = most AND raw > 0 OR kind = 1) AND CASE WHEN kind = 3 THEN e ELSE n END >= 2),
support AS (SELECT *, CASE WHEN aft + bef > 0 THEN CASE WHEN aft >= bef THEN 'A' ELSE 'B' END END AS direction FROM (SELECT *, row_number() OVER (PARTITION BY c, kind ORDER BY score DESC, first NULLS FIRST, a, b) AS rn FROM scored) WHERE rn = 1)"""


def _pays(spark: SparkSession, d: str) -> DataFrame:
    cal = _calendar(spark)
    owners = spread(table(spark, d, "customer").select(F.col("c_custkey").alias("c"), F.col("c_custkey").cast("string").alias("account")), "account")  # a file of customers makes twelve rows each
    rows = owners.select("c", "account", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k")).where((F.col("c") % 5 > 0) | (F.col("k") < 3))
    habit = F.col("c") % 6
    m = F.add_months(F.lit("2021-01-01").cast("date"), F.when(habit.isin(4, 5), F.floor(F.col("k") / 2)).otherwise(F.col("k")).cast("int"))
    rows = rows.withColumn("m", m)
    m, odd = F.col("m"), F.col("k") % 2 == 1
    plan = F.when(habit == 0, F.date_add(m, 4)).when(habit == 1, F.last_day(m)).when(habit == 2, C.nth_weekday(m, 1, 2)).when(habit == 3, C.nth_weekday(m, 4, -1)).when(habit == 4, F.when(odd, F.date_add(m, 14)).otherwise(m)).otherwise(F.when(odd, F.last_day(m)).otherwise(F.date_add(m, 9)))
    moved = C.shifted(rows.withColumn("plan", plan), "plan", F.when(habit == 0, "A").otherwise("B"), cal)
    date = F.when(F.col("c") % 7 == 0, F.date_add("plan", ((F.col("k") * F.col("k")) % 5).cast("int"))).otherwise(F.col("shifted"))
    return moved.select("account", F.lit("pay").alias("cluster"), date.alias("date")).distinct()


def _calendar(spark: SparkSession) -> DataFrame:
    return C.business_calendar(spark, FIRST, LAST)


def _support(spark: SparkSession, pays: DataFrame, kinds: Iterable[int]) -> DataFrame:
    return P.pattern_support(P.intended_days(pays, _calendar(spark)), kinds)


def _kind_query(name: str, kind: int) -> None:
    sql = f"WITH {SUPPORT_SQL} SELECT CAST(c AS VARCHAR) AS account, a, b, raw, aft AS \"after\", bef AS \"before\", round(score, 6) AS score, direction FROM support WHERE kind = {kind}"

    @query(name, sql)
    def run(spark, d):
        return _longs(_support(spark, _pays(spark, d), [kind]).select("account", "a", "b", "raw", "after", "before", F.round("score", 6).alias("score"), "direction"))


for _name, _number in (("payday_day_of_month", 0), ("payday_last_day", 1), ("payday_last_weekday", 2), ("payday_kth_weekday", 3), ("payday_biweekly_weekday", 4)):
    _kind_query(_name, _number)

TEND_SQL = """off AS (SELECT c, d, CASE WHEN day(d) <= 7 THEN day(d) ELSE day(last_day(d)) - day(d) END AS o FROM days), ends AS (SELECT c, avg(CASE WHEN o <= 3 THEN 1.0 ELSE 0.0 END) AS end_share FROM off GROUP BY c),
near0 AS (SELECT c, g AS target, count(*) AS k FROM days CROSS JOIN (SELECT unnest(generate_series(1, 31)) AS g) WHERE g <= day(last_day(d)) AND abs(day(d) - g) <= 3 GROUP BY 1, 2),
near1 AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY k DESC, target) AS rn FROM near0),
tend AS (SELECT sizes.c, end_share, target, CAST(k AS DOUBLE) / n AS near_share FROM sizes JOIN ends ON ends.c = sizes.c JOIN near1 ON near1.c = sizes.c AND rn = 1 WHERE n >= 2)"""


@query("payday_tendencies", f"WITH {PAYS_SQL}, {TEND_SQL} SELECT CAST(c AS VARCHAR) AS account, round(end_share, 6) AS end_share, CAST(target AS BIGINT) AS target, round(near_share, 6) AS near_share FROM tend")
def payday_tendencies(spark, d):
    return _longs(P.tendencies(_pays(spark, d)).select("account", F.round("end_share", 6).alias("end_share"), "target", F.round("near_share", 6).alias("near_share")))


@query("payday_monthly", f"""WITH {SUPPORT_SQL}, {TEND_SQL}, pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY score DESC, kind DESC) AS r2 FROM support WHERE kind < 4 AND score >= 0.6) WHERE r2 = 1),
j AS (SELECT coalesce(tend.c, pick.c) AS c, end_share, target, near_share, kind, a, b, score, direction FROM tend FULL JOIN pick ON pick.c = tend.c),
p AS (SELECT *, CASE kind WHEN 0 THEN 'day' WHEN 1 THEN 'last_day' WHEN 2 THEN 'last_weekday' WHEN 3 THEN 'kth_weekday' ELSE CASE WHEN end_share >= 0.8 AND end_share >= near_share THEN 'end_of_month' WHEN near_share >= 0.8 THEN 'near_day' END END AS pattern FROM j)
SELECT CAST(c AS VARCHAR) AS account, pattern, CAST(CASE pattern WHEN 'day' THEN a WHEN 'near_day' THEN target END AS BIGINT) AS day, CASE WHEN pattern IN ('last_weekday', 'kth_weekday') THEN a END AS weekday, CASE WHEN pattern = 'kth_weekday' THEN b END AS week,
 round(coalesce(score, CASE WHEN pattern = 'end_of_month' THEN end_share ELSE near_share END), 6) AS score, direction FROM p WHERE pattern IS NOT NULL""")
def payday_monthly(spark, d):
    pays = _pays(spark, d).persist()
    return _longs(P.monthly_pattern(_support(spark, pays, range(P.WEEKDAY)), P.tendencies(pays)).drop("cluster"))


SEMI_SQL = f"""{SUPPORT_SQL}, cand0 AS (SELECT c, day(d) AS g, day(d) <= 23 AS bl FROM days UNION ALL SELECT days.c, day(t), day(d) < 28 AND day(t) <= 23 FROM days JOIN sizes ON sizes.c = days.c AND n <= 3 JOIN cal ON NOT bd AND abs(date_diff('day', d, t)) <= 2 AND date_trunc('month', t) = date_trunc('month', d)),
cand AS (SELECT c, g, bool_or(bl) AS bl FROM cand0 GROUP BY 1, 2),
pairs AS (SELECT x.c, 'two_days' AS pattern, x.g AS day1, y.g AS day2 FROM cand x JOIN cand y ON y.c = x.c AND y.g - x.g >= 7 UNION ALL SELECT c, 'day_and_last', g, 0 FROM cand WHERE bl),
hit AS (SELECT pairs.*, h.d, h.how, row_number() OVER (PARTITION BY pairs.c, pattern, day1, day2, h.d ORDER BY CASE WHEN day(h.t) = day1 THEN 0 ELSE 1 END) AS rn FROM pairs JOIN hits h ON h.c = pairs.c AND h.same AND (day(h.t) = day1 OR day(h.t) = day2 OR day2 = 0 AND h.t = last_day(h.t))),
agg AS (SELECT pairs.c, pairs.pattern, pairs.day1, pairs.day2, count(hit.d) AS matched, count(CASE WHEN how = 1 THEN 1 END) AS aft, count(CASE WHEN how = 2 THEN 1 END) AS bef FROM pairs LEFT JOIN hit ON hit.c = pairs.c AND hit.pattern = pairs.pattern AND hit.day1 = pairs.day1 AND hit.day2 = pairs.day2 AND rn = 1 GROUP BY ALL),
semi0 AS (SELECT agg.*, CAST(matched AS DOUBLE) / n AS score, CASE WHEN aft + bef > 0 THEN CASE WHEN aft >= bef THEN 'A' ELSE 'B' END END AS direction, row_number() OVER (PARTITION BY agg.c, pattern ORDER BY matched DESC, day1, day2) AS rk FROM agg JOIN sizes ON sizes.c = agg.c AND n >= 2),
semis AS (SELECT * FROM semi0 WHERE rk = 1), smi AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY score DESC, CASE WHEN pattern = 'two_days' THEN 0 ELSE 1 END) AS r3 FROM semis WHERE score >= 0.6) WHERE r3 = 1)"""


def _semis(spark: SparkSession, pays: DataFrame) -> DataFrame:
    cal = _calendar(spark)
    return P.semi_monthly_support(P.intended_days(pays, cal), P.candidate_days(pays, cal), cal)


@query("payday_candidate_pairs", f"WITH {SEMI_SQL} SELECT CAST(c AS VARCHAR) AS account, CAST(g AS BIGINT) AS day, bl AS before_last FROM cand")
def payday_candidate_pairs(spark, d):
    return _longs(P.candidate_days(_pays(spark, d), _calendar(spark)).drop("cluster"))


@query("payday_semi_monthly_support", f"WITH {SEMI_SQL} SELECT CAST(c AS VARCHAR) AS account, pattern, CAST(day1 AS BIGINT) AS day1, CAST(day2 AS BIGINT) AS day2, matched, aft AS \"after\", bef AS \"before\", round(score, 6) AS score, direction FROM semis")
def payday_semi_monthly_support(spark, d):
    return _longs(_semis(spark, _pays(spark, d).persist()).select("account", "pattern", "day1", "day2", "matched", "after", "before", F.round("score", 6).alias("score"), "direction"))


@query("payday_semi_monthly", f"WITH {SEMI_SQL} SELECT CAST(c AS VARCHAR) AS account, pattern, CAST(day1 AS BIGINT) AS day1, CAST(CASE WHEN pattern = 'two_days' THEN day2 END AS BIGINT) AS day2, round(score, 6) AS score, direction FROM smi")
def payday_semi_monthly(spark, d):
    return _longs(P.semi_monthly_pattern(_semis(spark, _pays(spark, d).persist())).drop("cluster"))


@query("payday_arbiter", f"""WITH {SEMI_SQL}, w AS (SELECT c, n, a, round(score, 6) AS bs, direction FROM support WHERE kind = 4 AND score >= 0.6),
j AS (SELECT coalesce(w.c, smi.c) AS c, w.n, a, coalesce(bs, 0.0) AS b, w.direction AS bd, pattern, day1, day2, coalesce(round(score, 6), 0.0) AS s, smi.direction AS sd FROM w FULL JOIN smi ON smi.c = w.c),
k AS (SELECT *, CASE WHEN b > s THEN 'B' WHEN s > b THEN 'S' WHEN n <= 3 THEN 'B' ELSE 'S' END AS choice FROM j)
SELECT CAST(c AS VARCHAR) AS account, choice, CASE WHEN choice = 'B' THEN b ELSE s END AS score, CASE WHEN choice = 'B' THEN ['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'][a + 1] END AS weekday,
 CASE WHEN choice = 'S' THEN pattern END AS pattern, CAST(CASE WHEN choice = 'S' THEN day1 END AS BIGINT) AS day1, CAST(CASE WHEN choice = 'S' AND pattern = 'two_days' THEN day2 END AS BIGINT) AS day2, CASE WHEN choice = 'B' THEN bd ELSE sd END AS direction FROM k""")
def payday_arbiter(spark, d):
    pays = _pays(spark, d).persist()  # read five times
    return _longs(P.biweekly_or_semi_monthly(_support(spark, pays, [P.WEEKDAY]), P.semi_monthly_pattern(_semis(spark, pays))).drop("cluster"))


@query("payday_text_roundtrip", """SELECT CAST(c_custkey AS BIGINT) AS c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'day' WHEN 1 THEN 'last_weekday' WHEN 2 THEN 'kth_weekday' WHEN 3 THEN 'near_day' END AS pattern, CAST(CASE WHEN c_custkey % 5 IN (0, 3) THEN c_custkey % 28 + 1 END AS BIGINT) AS day1,
 CAST(CASE WHEN c_custkey % 5 IN (1, 2) THEN c_custkey % 7 END AS BIGINT) AS weekday, CAST(CASE WHEN c_custkey % 5 = 2 THEN c_custkey % 4 + 1 END AS BIGINT) AS week FROM customer""")
def payday_text_roundtrip(spark, d):
    k = F.col("c_custkey")
    pattern = F.when(k % 5 == 0, "day").when(k % 5 == 1, "last_weekday").when(k % 5 == 2, "kth_weekday").when(k % 5 == 3, "near_day")
    text = P.regular_text(pattern, (k % 28 + 1).cast("int"), (k % 7).cast("int"), (k % 4 + 1).cast("int"))
    rows = table(spark, d, "customer").select("c_custkey", P.parsed_text(F.coalesce(text, F.lit("whenever"))).alias("x"))
    return _longs(rows.select("c_custkey", "x.pattern", "x.day1", "x.weekday", "x.week"))


@query("payday_matches_pattern", f"WITH {PAYS_SQL} SELECT CAST(c AS VARCHAR) AS account, CAST(sum(CASE WHEN d = last_day(d) THEN 1 ELSE 0 END) AS BIGINT) AS last_days, CAST(sum(CASE WHEN isodow(d) = 5 AND month(d + 7) <> month(d) THEN 1 ELSE 0 END) AS BIGINT) AS last_fridays, CAST(sum(CASE WHEN day(d) = 1 OR day(d) = 15 THEN 1 ELSE 0 END) AS BIGINT) AS halves FROM days GROUP BY c")
def payday_matches_pattern(spark, d):
    hits = lambda text: F.count_if(P.matches(F.col("date"), P.parsed_text(F.lit(text))))
    return _pays(spark, d).groupBy("account").agg(hits("Last Day").alias("last_days"), hits("Last Friday").alias("last_fridays"), hits("1,15").alias("halves"))


@query("payday_modal_bin", f"WITH {PAYS_SQL}, g AS (SELECT c, date_diff('day', lag(d) OVER (PARTITION BY c ORDER BY d), d) AS gap FROM days), b AS (SELECT c, CASE WHEN gap <= 1 THEN 'D' WHEN gap BETWEEN 6 AND 8 THEN 'W' WHEN gap BETWEEN 13 AND 17 THEN 'B' WHEN gap BETWEEN 25 AND 35 THEN 'M' ELSE 'I' END AS f, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1, 2) SELECT CAST(c AS VARCHAR) AS account, f AS frequency FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, f) AS rn FROM b) WHERE rn = 1")
def payday_modal_bin(spark, d):
    return Q.modal_frequency(_pays(spark, d)).drop("cluster")
