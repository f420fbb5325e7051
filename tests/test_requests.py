"""Requests in one job against each of them alone, and against SQL."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerline.plans import analyze as A
from ledgerline.plans import per_request as P
from ledgerline.plans import catalogue_requests, registry  # noqa: F401

COLUMNS = "request_id string, account string, txn_id long, date date, amount double, type string, description string, cluster string, label string"
SHAPE = "request_id string, as_of date, months int"
SF = "/root/testdata/sf0.01"


def ledger(spark):
    start, items = dt.date(2024, 1, 5), []
    for k in range(12):
        items.append(("a", start + dt.timedelta(14 * k), 900.0 + k, "CREDIT", "payroll", "pay"))
        items.append(("a", start + dt.timedelta(14 * k + 3), 700.0, "DEBIT", "nsf", "rent"))
    items += [("b", dt.date(2024, m, 15), 500.0, "CREDIT", "ssa", "ssa") for m in range(1, 7)]
    items += [("b", dt.date(2024, m, 20), 50.0 + m, "DEBIT", "loan", "lend") for m in range(1, 7)]
    label = {"pay": "payroll", "rent": "other", "ssa": "benefit", "lend": "loan"}
    rows = [(q, a, k, d, m, t, x, c, label[c]) for q in ("late", "early") for k, (a, d, m, t, x, c) in enumerate(items)]
    return spark.createDataFrame(rows, COLUMNS)


def owners(spark):
    rows = [(q, *x) for q in ("late", "early") for x in [("a", 100.0, "CHECKING"), ("b", 5.0, "SAVINGS"), ("c", 7.0, "CHECKING")]]
    return spark.createDataFrame(rows, "request_id string, account string, balance double, account_type string")


def test_each_request_as_if_alone(spark):
    """Two dates and time frames of the same customers: every table has the rows of two separate analyses."""
    rows, accounts = ledger(spark).persist(), owners(spark)
    frames = {"late": (dt.date(2024, 6, 30), None), "early": (dt.date(2024, 4, 10), 2)}
    got = P.analyze_requests(rows, accounts, spark.createDataFrame([(q, *x) for q, x in frames.items()], SHAPE))
    got = {name: table.toPandas() for name, table in got.items()}
    for q, (day, months) in frames.items():
        one = lambda df: df.where(F.col("request_id") == q).drop("request_id")  # noqa: B023, E731
        alone = A.analyze(one(rows), one(accounts), day, A.Config(months=months))
        for name, table in alone.items():
            part = got[name][got[name].request_id == q]
            assert set(part.as_of) <= {day}, name
            tidy = lambda df: sorted(map(str, df[table.columns].astype(object).itertuples(index=False, name=None)))  # noqa: B023, E731
            assert tidy(part) == tidy(table.toPandas()), (q, name)


def test_keys_come_apart(spark):
    """Ids with digits, separators or nothing in them; triples that a plain concatenation would confuse."""
    triples = [("1", "23"), ("12", "3"), ("", "x"), ("3:", "a"), ("3", ":a"), ("ü\n", "é"), ("q", "")]
    rows = spark.createDataFrame([(q, a, dt.date(2024, 2, 29)) for q, a in triples], "request_id string, account string, as_of date")
    keys = rows.withColumn("account", P.key()).drop("as_of", "request_id")
    assert keys.distinct().count() == len(triples)
    assert sorted((r.request_id, r.account) for r in P.split(keys).collect()) == sorted(triples)
    assert {r.as_of for r in P.split(keys).collect()} == {dt.date(2024, 2, 29)}


def test_settings_and_cuts_on_odd_rows(spark):
    day = dt.date(2024, 6, 30)
    odd = spark.createDataFrame([("x", day, 3), ("x", day, None), ("x", dt.date(2023, 1, 1), None), (None, day, 1), ("y", None, 1), ("z", day, 1)], SHAPE)
    assert sorted((r.request_id, r.as_of, r.months) for r in P.settings(odd).collect()) == [("x", day, None), ("z", day, 1)]
    none = ledger(spark).limit(0)
    rows, accounts = P.keyed(none, owners(spark), odd)
    assert rows.count() == 0 and accounts.count() == 0  # accounts of unknown requests go too
    strange = ledger(spark).withColumn("request_id", F.lit("z")).withColumn("as_of", F.lit("clash")).withColumn("months", F.lit(1))
    strange = strange.withColumn("date", F.when(F.col("cluster") != "ssa", F.col("date")))
    rows, _ = P.keyed(strange, owners(spark), odd)
    # rows without a date go; those from the first day of May on stay
    assert rows.agg(F.min("date")).first()[0] >= dt.date(2024, 5, 1) and rows.where("date is null").count() == 0
    assert P.keyed(ledger(spark), owners(spark), odd.limit(0))[0].count() == 0


@pytest.mark.parametrize("name", ["requests_cashflow", "requests_net_cashflow", "requests_monthly_income", "requests_balances"])
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in ("orders", "customer"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.execute(registry.ORACLES[name]).df()
    got = registry.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    assert len(got) and len(got) == len(want)
    got, want = (x.sort_values(["request_id"]).reset_index(drop=True) for x in (got, want))
    assert list(got.request_id) == list(want.request_id) and list(map(str, got.as_of)) == [str(x)[:10] for x in want.as_of]
    for c in want.columns[3:]:
        assert (got[c].fillna(-1) - want[c].fillna(-1)).abs().max() < 0.02, c
