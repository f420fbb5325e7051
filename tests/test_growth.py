"""Queries whose work or memory grew faster than their input: results by brute force, and the step that grew."""

import datetime as dt
from calendar import monthrange

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import text as T
from ledgerline.operators import frequency as Q
from ledgerline.operators import income as I
from ledgerline.operators import money as M
from ledgerline.operators import paydays as P
from ledgerline.plans import catalogue, catalogue_entities, catalogue_paydays, registry
from ledgerline.sources import adapters

SF = "/root/testdata/sf0.01"
AS_OF = dt.date(2024, 6, 30)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def balances(rows, account, balance):
    """The means by a list of days."""
    own = [(d, x if t == "CREDIT" else -x) for a, d, x, t in rows if a == account and d is not None and d <= AS_OF]
    first = max(min([d for d, _ in own], default=AS_OF), AS_OF - dt.timedelta(179))
    days = [(k, balance - sum(x for d, x in own if (AS_OF - d).days <= k)) for k in range((AS_OF - first).days + 1)]
    means = [sum(v) / len(v) for b in range(6) if (v := [x for k, x in days if k // 30 == b])]
    return tuple(round(sum(m) / len(m), 4) for m in (means[:3], means, means))


def test_balances_without_a_row_a_day(spark):
    ages = {"a": [0, 0, 29, 30, 31, 89, 90, 179, 180, 400], "b": [7], "c": [45, 30], "d": [179], "e": [-3, 12, 59], "f": [180], "g": [0], "h": [150, 149, 3]}
    rows = [(a, AS_OF - dt.timedelta(k), 10.0 * i + k % 7, "DEBIT" if i % 3 else "CREDIT") for a, every in ages.items() for i, k in enumerate(every)] + [("b", None, 5.0, "CREDIT")]
    owners = [(a, 100.0 + 3 * i) for i, a in enumerate([*ages, "none"])]
    ledger, accounts = spark.createDataFrame(rows, "account string, date date, amount double, type string"), spark.createDataFrame(owners, "account string, balance double")
    out = M.balance_history(ledger, accounts, AS_OF)
    got = {r.account: tuple(r)[1:] for r in out.collect()}
    assert set(got) == {a for a, _ in owners}
    for account, balance in owners:
        assert got[account] == pytest.approx(balances(rows, account, balance), abs=2e-4), account  # Python rounds halves to even
    assert "Generate" not in plan_of(out)  # before: a row for each account and day
    assert M.balance_history(ledger, accounts, None).count() == 0


def test_pay_days_are_made_in_many_tasks(spark, monkeypatch):
    """Customers are dealt before each makes its pay days, over as many tasks as their count asks for."""
    monkeypatch.setattr(adapters, "SPREAD_ROWS", 100)
    pays = catalogue_paydays._pays(spark, SF)
    assert "RepartitionByExpression [account" in plan_of(pays) and ", 15" in plan_of(pays)  # before: a task a file
    owners = adapters.table(spark, SF, "customer").select("c_custkey")
    dealt = adapters.spread(owners, "c_custkey")
    assert dealt.rdd.getNumPartitions() == 15 and dealt.distinct().count() == owners.count() == pays.select("account").distinct().count()
    assert adapters.spread(owners.limit(0), "c_custkey").count() == 0


def test_plain_texts_need_no_look_at_neighbours(spark):
    """Only texts with a tag or both words of a pair are looked at token by token; all others keep their distinct tokens."""
    said = {
        None: None, "": "", " \t": " \t", "the to": "the to", "b a b  c": "b c", "cash app": "cash app", "cash the app": "cash the app", "x cash the app y": "x y", "app cash cash": "app cash", "los x angelos": "los x angelos",
        "x INDN: bob y": "x y", "x indn#bob y": "x y", "indnx bob": "indnx bob", "indn": "indn", "x cash indn bob app": "x",
    }
    rows = spark.createDataFrame([(t,) for t in said], "text string")
    out = rows.select("text", T.clean_for_clusters(F.col("text")).alias("cleaned"))
    assert {r.text: r.cleaned for r in out.collect()} == said
    assert "array_except(split(" in plan_of(out)  # before: two regular expressions for each token


def test_descriptions_are_made_once(spark, tmp_path):
    """The fit, the tagger and the join share one pass over the texts; texts of fewer than two words have no description."""
    texts = [(0, None), (1, ""), (2, "one one"), (3, "one two"), (4, "THREE four five"), (5, "a b 12")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = catalogue_entities.described(spark, str(tmp_path))
    assert {r.doc_id for r in rows.collect()} == {3, 4} and all(len(r.tokens) == len(r.tags) for r in rows.collect())
    read = rows.join(rows.where("not held_out").select("text"), "text")
    assert "InMemoryRelation" in read._jdf.queryExecution().withCachedData().toString()  # before: the texts were read for each use


def test_sources_are_made_in_one_pass(spark):
    """A cluster's most frequent days, its frequency and its scores come from one aggregation of its pay days; null keys have no frequency."""
    paid = {"a": [1, 8, 15, 22, 29], "b": [5, 36, 64, 95], "c": [3, 9], "d": [2, 4, 4, 33], "e": [None, 6], "f": [10, 41, 11, 42, 70], None: [7]}
    date = lambda k: None if k is None else dt.date(2024, 1, 1) + dt.timedelta(k)
    rows = [(a, "x", date(k), 100.0, "CREDIT") for a, days in paid.items() for k in days] + [("a", None, date(1), 100.0, "CREDIT"), ("a", "low", date(1), 20.0, "CREDIT")]
    ledger = spark.createDataFrame(rows, "account string, cluster string, date date, amount double, type string")
    got = {r.account: r for r in Q.frequency(ledger).collect()}
    assert set(got) == {a for a in paid if a is not None}
    for account, r in got.items():
        days = [date(k) for k in set(paid[account])]
        value = lambda f: sorted({f(d) if d else None for d in days}, key=lambda v: (-sum((f(d) if d else None) == v for d in days), v is not None, v or 0))
        first, *more = value(lambda d: d.day)
        assert (r.n_pays, r.weekday, r.day1) == (len(days), value(lambda d: d.weekday())[0], first), account
        assert r.day2 == (more[0] if more and r.frequency != "M" else None), account
    sources = I.income_sources(ledger, dt.date(2024, 4, 30))
    assert {(r.account, r.cluster): r.pays for r in sources.collect()} == {(a, "x"): len(set(k)) for a, k in paid.items()} | {("a", ""): 1, ("a", "low"): 1}
    assert "Join" not in plan_of(sources)  # before: joins of the parts of the frequency, in one stage
    assert "RepartitionByExpression [account" in plan_of(catalogue.income_sources(spark, SF))


def test_pairs_of_days_by_counts(spark):
    """Pairs by brute force over sets of pay days, with free days in a row so long that one pay day stands for both days of a pair."""
    start = dt.date(2024, 1, 1)
    every = [start + dt.timedelta(k) for k in range(150)]
    free = {d for d in every if d.weekday() > 4 or 8 <= (d - start).days <= 24 or 50 <= (d - start).days <= 59}
    step = lambda d, k: next((x for x in (d + dt.timedelta(k * i) for i in range(1, 40)) if x in every and x not in free), None)
    calendar = spark.createDataFrame([(d, d not in free, step(d, -1), step(d, 1)) for d in every], "date date, is_business_day boolean, previous_bd date, next_bd date")
    paid = {"a": [7, 25, 38, 49, 60, 69], "b": [7, 25], "c": [4, 14, 35, 45, 66, 76], "d": [7, 10, 25, 31, 59, 60, 90, 120], "e": [3]}
    rows = spark.createDataFrame([(a, "x", start + dt.timedelta(k)) for a, days in paid.items() for k in days] + [("f", None, every[0]), ("f", None, every[9])], "account string, cluster string, date date")
    intended, candidates = P.intended_days(rows, calendar), P.candidate_days(rows, calendar)
    tried = {(r.account, r.day): r.before_last for r in candidates.collect()}
    want, shared = {}, 0
    for account, offsets in paid.items():
        days = [start + dt.timedelta(k) for k in offsets]
        stands = [(d, t, 0 if t == d else 1 if step(t, 1) == d else 2) for d in days for t in every if t.month == d.month and (t == d or t in free and d in (step(t, 1), step(t, -1)))]
        for (a, day), early in tried.items():
            for other in [y for x, y in tried if x == a == account and y - day >= 7] + [0] * (early and a == account):
                second = [(d, how) for d, t, how in stands if (t.day == other if other else (t + dt.timedelta(1)).day == 1)]
                first = {d: how for d, t, how in stands if t.day == day}
                shared += any(d in first for d, _ in second)
                hows = [*first.values(), *(how for d, how in second if d not in first)]
                key = (account, "two_days" if other else "day_and_last")
                want[key] = min(want.get(key, (1,)), (-len(hows), day, other, hows.count(1), hows.count(2), len(days)))
    support = P.semi_monthly_support(intended, candidates, calendar)
    got = {(r.account, r.pattern): (-r.matched, r.day1, r.day2, r.after, r.before, r.n) for r in support.collect()}
    assert shared and got == {k: v for k, v in want.items() if v[-1] >= 2}
    assert "collect_list(struct(date" not in plan_of(support)  # before: the pay days of both days of each pair side by side
    assert plan_of(P.pattern_support(intended)).count("Join ") == 1  # the calendar; before: the cluster's pay days too


def test_only_the_kinds_that_are_asked_for(spark):
    """One kind of pattern gives the rows it has among all kinds, and no other kind is counted but that of a cluster's pay days."""
    pays, cal = catalogue_paydays._pays(spark, SF), catalogue_paydays._calendar(spark)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    intended = P.intended_days(pays, cal).persist()
    every = rows(P.pattern_support(intended))
    for kind in range(P.WEEKDAY + 1):
        assert rows(P.pattern_support(intended, [kind])) == [r for r in every if r[2] == kind] != []
    made = lambda df: next(line for line in plan_of(df).split("\n") if "explode(" in line and "kind" in line).count("CASE WHEN")
    names = ("payday_day_of_month", "payday_last_day", "payday_last_weekday", "payday_kth_weekday", "payday_biweekly_weekday")
    assert [made(registry.QUERIES[name](spark, SF)) for name in names] == [0, 1, 1, 1, 1]  # before: 4, all kinds next to that of the days of the month


def test_tendencies_in_one_pass(spark):
    """Tendencies by brute force, with month ends, null dates and null keys; a cluster without a date has none."""
    start = dt.date(2024, 1, 1)
    paid = {"a": [0, 30, 31, 59, 90, 120], "b": [4, 35, 66, 94, None], "c": [27, 58, 87], "d": [14], "e": [None], "f": [None, 9, 40], "g": [2, 28, 57, 93], None: [3, 4]}
    every = [(a, "x", start + dt.timedelta(k) if k is not None else None) for a, days in paid.items() for k in days * 2]
    rows = spark.createDataFrame(every, "account string, cluster string, date date")
    want = {}
    for account, offsets in paid.items():
        days = [start + dt.timedelta(k) for k in offsets if k is not None]
        if account is None or len(offsets) < 2:
            continue
        last = lambda d: monthrange(d.year, d.month)[1]
        near = {g: sum(g <= last(d) and abs(d.day - g) <= 3 for d in days) for g in range(1, 32)}
        target = max(near, key=lambda g: (near[g], -g))
        ends = sum((d.day if d.day <= 7 else last(d) - d.day) <= 3 for d in days)
        want[account] = (len(offsets), ends / len(days), target, near[target] / len(offsets))
    out = P.tendencies(rows)
    assert {r.account: tuple(r)[2:] for r in out.collect()} == want
    assert "Join" not in plan_of(out)  # before: a join of two aggregations, in one stage


def test_pay_days_read_often_are_kept(spark, monkeypatch):
    """Choices between patterns read pay days that are kept, dealt as they were made."""
    monkeypatch.setattr(adapters, "SPREAD_ROWS", 100)
    for name in ("payday_semi_monthly", "payday_semi_monthly_support", "payday_arbiter", "payday_monthly"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().withCachedData().toString()
        assert "InMemoryRelation" in plan and "RepartitionByExpression" not in plan, name  # before: pay days were made for each use, in one stage
    kept = catalogue_paydays._pays(spark, SF)  # the plan that is kept
    assert "InMemoryRelation" in kept._jdf.queryExecution().withCachedData().toString() and kept.rdd.getNumPartitions() == 15
    spark.catalog.clearCache()
