"""Operators on hand-made frames whose results are known."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import text as T
from ledgerline.operators import calendar as C
from ledgerline.operators import clusters as K
from ledgerline.operators import frequency as Q
from ledgerline.operators import income as I
from ledgerline.operators import money as M
from ledgerline.operators import peaks, scoring, text_clusters
from ledgerline.plans import analyze as A
from ledgerline.sources import documents, requests

COLUMNS = "account string, txn_id long, date date, amount double, type string, description string, cluster string"
D = dt.date


def rows(spark, *items):
    return spark.createDataFrame([(a, k, d, float(m), t, x, c) for k, (a, d, m, t, x, c) in enumerate(items)], COLUMNS)


@pytest.fixture(scope="module")
def ledger(spark):
    start = D(2024, 1, 5)
    pays = [("a", start + dt.timedelta(14 * k), 900 + k, "CREDIT", "ACME PAYROLL", "pay") for k in range(8)]
    spends = [("a", start + dt.timedelta(14 * k + 3), 700, "DEBIT", "rent", "rent") for k in range(8)]
    monthly = [("b", D(2024, m, 15), 500, "CREDIT", "SSA benefit", "ssa") for m in range(1, 7)]
    odd = [("b", D(2024, 3, 1), 30, "DEBIT", "NSF fee", "fee"), ("b", D(2024, 6, 1), 30, "DEBIT", "overdraft fee", "fee")]
    return rows(spark, *pays, *spends, *monthly, *odd)


@pytest.fixture(scope="module")
def owners(spark):
    return spark.createDataFrame([("a", 100.0, "CHECKING"), ("b", 5.0, "SAVINGS"), ("c", 7.0, "CHECKING")], "account string, balance double, account_type string")


AS_OF = D(2024, 6, 30)


def test_daily_series_pads_and_accumulates(spark):
    items = [("a", D(2024, 1, 1), 50, "CREDIT", "", ""), ("a", D(2024, 1, 2), 50, "CREDIT", "", ""), ("a", D(2024, 1, 3), 150, "CREDIT", "", ""), ("a", D(2024, 1, 3), 50, "DEBIT", "", ""), ("a", D(2024, 1, 4), 100, "DEBIT", "", "")]
    got = [r.running for r in M.daily_series(rows(spark, *items)).orderBy("date").collect()]
    assert got == [0, 50, 100, 200, 100, 100]


def test_cashflow_and_windows(ledger, owners):
    got = {r.account: r for r in M.cashflow(ledger, owners, AS_OF).collect()}
    period = (AS_OF - D(2024, 1, 5)).days
    assert got["a"].credit == sum(900 + k for k in range(8)) and got["a"].debit == 5600
    assert got["a"].spending == pytest.approx(5600 / (period / 30), abs=0.01) and got["c"].credit == 0
    net = {r.account: r for r in M.net_cashflow(ledger, owners, AS_OF).collect()}
    b90 = sum(500 for m in range(1, 7) if (AS_OF - D(2024, m, 15)).days <= 90) - 30
    assert net["b"].net_cash_flow_3m == pytest.approx(b90 * 30 / 90, abs=0.01) and net["c"].net_cash_flow_all == 0


def test_overdrafts(ledger, owners):
    got = {r.account: r for r in M.overdraft_counters(ledger, owners, AS_OF, [r"\bnsf"], [r"\boverdraft\b"]).collect()}
    assert (got["b"].nsf_all, got["b"].nsf_3m, got["b"].overdraft_fee_3m, got["b"].overdraft_all) == (1, 0, 1, 2) and got["a"].overdraft_all == 0


def test_balances_walk_back(spark, owners):
    one = rows(spark, ("a", D(2024, 6, 29), 40, "DEBIT", "", ""))
    got = {r.account: r for r in M.balance_history(one, owners, AS_OF).collect()}
    assert got["a"].balance_3m == pytest.approx((100 + 140) / 2) and got["c"].balance_all == 7


def test_frequencies(ledger):
    got = {(r.account, r.cluster): r for r in Q.frequency(ledger).collect()}
    assert got["a", "pay"].frequency == "B" and got["a", "pay"].regular_day == "Friday"
    assert got["a", "pay"].monthly_amount == pytest.approx(903.5 * 26 / 12, abs=0.01)
    assert got["b", "ssa"].frequency == "M" and got["b", "ssa"].regular_day == "15" and ("b", "fee") not in got


def test_sources_scores_and_ranks(ledger):
    got = {r.account: r for r in I.ranked(I.income_sources(ledger, AS_OF)).collect()}
    assert got["a"].error_code == 401 and got["a"].source_id == "I1_err_401"  # the last pay is too old
    assert got["b"].error_code == 0 and (got["b"].active_score, got["b"].recurring_score, got["b"].stability_score) == (3, 3, 3)
    assert got["b"].rank == 1 and got["b"].dominant == 1 and got["a"].dominant == 0
    single = I.income_sources(ledger.where("txn_id = 0"), AS_OF).first()
    assert single.error_code == 201 and single.frequency == "I"


def test_calendar(spark):
    cal = {r.date: r for r in C.business_calendar(spark, D(2023, 12, 20), D(2024, 1, 20)).collect()}
    assert not cal[D(2023, 12, 25)].is_business_day and cal[D(2023, 12, 25)].next_bd == D(2023, 12, 26) and cal[D(2024, 1, 15)].previous_bd == D(2024, 1, 12)
    assert len(cal) == 32


def test_next_payday_and_shift(spark):
    base = spark.createDataFrame([("W", D(2024, 5, 24), 4, 1, None), ("M", D(2024, 1, 31), 0, 31, None), ("S", D(2024, 2, 15), 0, 15, 30)], "f string, last date, wd int, d1 int, d2 int")
    got = {r.f: r.n for r in base.select("f", C.next_payday(F.col("last"), F.col("f"), F.col("wd"), F.col("d1"), F.col("d2")).alias("n")).collect()}
    assert got == {"W": D(2024, 5, 31), "M": D(2024, 2, 29), "S": D(2024, 2, 29)}
    cal = C.business_calendar(spark, D(2024, 5, 1), D(2024, 6, 30))
    moved = spark.createDataFrame([(D(2024, 5, 27), "A"), (D(2024, 5, 25), "B")], "day date, way string")
    assert {r.day: r.shifted for r in C.shifted(moved, "day", F.col("way"), cal).collect()} == {D(2024, 5, 27): D(2024, 5, 28), D(2024, 5, 25): D(2024, 5, 24)}


def test_missing_paydays(spark):
    days = spark.createDataFrame([("a", "p", D(2024, 1, 5)), ("a", "p", D(2024, 1, 12)), ("a", "p", D(2024, 2, 2))], "account string, cluster string, date date")
    assert [r.missing for r in C.missing_paydays(days, F.lit("W")).orderBy("missing").collect()] == [D(2024, 1, 19), D(2024, 1, 26)]


def test_shifted_weekday_pattern(spark):
    days = [D(2024, 1, 1) + dt.timedelta(7 * k) for k in range(1, 7)]
    days[1] = D(2024, 1, 16)  # the fifteenth was free
    cal = C.business_calendar(spark, D(2023, 12, 1), D(2024, 3, 1))
    frame = spark.createDataFrame([("a", "p", d) for d in days], "account string, cluster string, date date")
    r = Q.shifted_matches(frame, cal).first()
    assert (r.weekday, r.raw, r.after, r.share, r.direction) == (0, 5, 1, 1.0, "A")


def test_interval_bins(spark):
    values = [None, 1, 2, 5, 6, 8, 9, 12, 13, 17, 18, 24, 25, 35, 36]
    frame = spark.createDataFrame([(v,) for v in values], "gap int")
    assert [r[0] for r in frame.select(K.interval_bin(F.col("gap"))).collect()] == ["36+", "1", "2-5", "2-5", "6-8", "6-8", "9-12", "9-12", "13-17", "13-17", "18-24", "18-24", "24-35", "24-35", "36+"]


def test_text_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(T.distinct_tokens(F.lit("b a b  c a"))) == "b a c" and value(T.without_repeats(F.lit("a a b a"))) == "a b a"
    assert value(T.clean_for_ngrams(F.lit("PAYROLL 12345678 01/02/24 direct deposit TX"))) == "payroll toknum tokdate dir dep tokstate"
    assert value(T.category_text(F.lit('["Food", " Out "]'))) == "Food/Out" and value(T.category_text(F.lit("12"))) == "Other" and value(T.category_text(F.lit(None).cast("string"))) is None
    assert value(T.standard_timestamp(F.lit("2024-01-02"))) == "2024-01-02T23:59:59.999Z" and value(T.standard_timestamp(F.lit("2024-01-02T03:04:05Z"))) == "2024-01-02T03:04:05.999Z"
    assert value(T.card_tails(F.lit("Card ending in 98761234, gift card 55556666"))) == ["1234"]
    assert value(T.name_match(F.lit("Jon B. Smith"), F.lit("Mr. John Smith"))) > 0.9 > value(T.name_match(F.lit("Ann Lee"), F.lit("Bob Gray")))
    assert value(T.log_odds_score(F.lit(0.5))) == int(850 - 100 / 0.6931471805599453 * 4.605170185988092)
    assert value(T.corrected_label(F.lit("transfer"), F.lit("wire fee"), F.lit("DEBIT"))) == "other" and value(T.corrected_label(F.lit("payroll"), F.lit("x"), F.lit("DEBIT"))) == "other"


def test_amount_range(spark):
    low, high = I.amount_range(F.lit(208.0), 2.988, 3.928, 300, 1000)
    assert tuple(spark.range(1).select(low, high).first()) == (620, 820)


def test_average_linkage_groups_similar_texts(spark):
    frame = spark.createDataFrame([("a", t) for t in ("acme pay one", "acme pay two", "rent house", "rent house x", "zzz")], "account string, description string")
    got = {r.text: r.cluster for r in text_clusters.text_clusters(frame, cut=0.4).collect()}
    assert got["acme pay one"] == got["acme pay two"] != got["rent house"] == got["rent house x"] and len(set(got.values())) == 3


def test_peaks():
    import numpy as np

    x = np.array([0, 5, 0, 3, 3, 3, 0, 9, 0], float)
    at, height = peaks.find_peaks(x, 1, 0)
    assert at.tolist() == [1, 4, 7] and height.tolist() == [5, 3, 9]
    assert peaks.find_peaks(x, 4, 0)[0].tolist() == [1, 7] or peaks.find_peaks(x, 4, 0)[0].tolist() == [7, 1]
    days = np.array([0, 600, 590, 580, 300, 100, 0, 0], float)
    assert peaks.good_days(days, 500, 200).tolist() == [False, True, True, True, True, False, False, False]


def test_top_contributions_are_padded(spark):
    frame = spark.createDataFrame([("a", "x", 0.3), ("a", "y", 0.5), ("a", "z", -0.1)], "account string, feature string, contribution double")
    got = {(r.sign, r.rank): r.feature for r in scoring.top_contributions(frame, 2).collect()}
    assert got == {(1, 1): "y", (1, 2): "x", (-1, 1): "z", (-1, 2): None}


def test_quantile_mapping(spark):
    ref = spark.createDataFrame([(float(k),) for k in range(101)], "score double")
    target = spark.createDataFrame([(float(k * 10),) for k in range(101)], "score double")
    got = scoring.calibrated(spark.createDataFrame([(50.0,), (-5.0,), (500.0,)], "score double"), ref, target)
    assert [r.calibrated for r in got.collect()] == [500.0, 0.0, 1000.0]


def test_requests_and_documents(spark):
    good = {"asOfDate": "2024-06-30", "accounts": [{"accountGuid": "a", "currentBalance": "10.5", "currentBalanceDate": "2024-06-30"}, {"accountGuid": "a", "currentBalance": 9, "currentBalanceDate": "2024-06-01"}], "transactions": [{"guid": str(k), "accountGuid": "a", "description": "x", "amount": 5, "date": f"2024-0{k}-01", "type": t} for k, t in ((1, "credit"), (2, "CREDIT"), (3, "DEBIT"), (4, "debit"), (7, "DEBIT"))]}
    bad = {**good, "transactions": good["transactions"][2:]}
    frame = spark.createDataFrame([("g", json.dumps(good)), ("b", json.dumps(bad)), ("e", "{"), ("d", json.dumps({**good, "asOfDate": "?"}))], "request_id string, body string")
    assert {r.request_id: r.code for r in requests.errors(frame).collect()} == {"b": 401, "e": 401, "d": 501}
    ok = requests.valid(frame)
    assert [(r.account, r.balance) for r in requests.accounts(ok).collect()] == [("a", 10.5)]
    assert requests.ledger(ok).count() == 4
    nested = documents.by_account(spark.createDataFrame([("a",), ("z",)], "account string"), {"rows": requests.ledger(ok).select("account", "amount", "type")})
    assert {r.account: len(r.rows) for r in nested.collect()} == {"a": 4, "z": 0}


def test_label_and_analyze(ledger, owners, spark):
    edits = spark.createDataFrame([("a", "rent", None, "housing")], "account string, description string, cluster string, label string")
    labelled = A.label(ledger, edits=edits)
    got = {r.description: (r.label, r.label_source) for r in labelled.collect()}
    assert got["ACME PAYROLL"] == ("payroll", "rules") and got["rent"][0] == "housing" and got["SSA benefit"][0] == "benefit"
    tables = A.analyze(labelled.persist(), owners, AS_OF)
    assert {r.account: r.income_type for r in tables["income_sources"].collect()} == {"a": "Payroll", "b": "Benefit"}
    assert all(isinstance(t.collect(), list) for t in tables.values())


def test_customer_level(ledger, spark):
    both = A.customer_level(ledger, spark.createDataFrame([("a", "C"), ("b", "C"), ("z", "Z")], "account string, customer string"))
    assert both.where("level = 'customer' and account = 'C'").count() == ledger.count() and both.count() == 2 * ledger.count()


def test_order_of_rows_does_not_matter(ledger):
    once, again = Q.frequency(ledger), Q.frequency(ledger.orderBy(F.desc("txn_id")).repartition(7))
    assert sorted(once.collect()) == sorted(again.collect())
