"""Contracts: violations by place and kind, fitted rows, fields removed at every depth, reports to JSON and back."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from ledgerline.plans import analyze as A
from ledgerline.plans import catalogue_contracts, registry  # noqa: F401
from ledgerline.sources import contracts as N

SF = "/root/testdata/sf0.01"


def test_violations_and_fitted_rows(spark):
    contract = Y.StructType.fromDDL("id bigint not null, n int, part struct<a: int not null, b: string>, xs array<struct<v: double not null>>")
    rows = spark.createDataFrame([
        (1, "7", (3, "x"), [("1.5",), ("2",)], "extra"), (2, "seven", (None, "x"), [(None,), ("z",)], ""), (3, None, None, None, ""), (None, "1", (1, None), [], ""), (5, "99999999999", (1, ""), [None], ""),
    ], "id int, n string, part struct<a: int, b: string>, xs array<struct<v: string>>, more string")
    good, errors = N.checked(rows, contract, "id")
    assert [f.simpleString() for f in good.schema] == [f.simpleString() for f in contract]
    assert sorted(map(str, good.collect())) == sorted(map(str, [Y.Row(id=1, n=7, part=Y.Row(a=3, b="x"), xs=[Y.Row(v=1.5), Y.Row(v=2.0)]), Y.Row(id=3, n=None, part=None, xs=None), Y.Row(id=5, n=None, part=Y.Row(a=1, b=""), xs=[None])][:2]))
    got = sorted((r.id or 0, r.field, r.problem, r.value) for r in errors.collect())
    assert got == [(0, "id", "missing", None), (2, "n", "type", "seven"), (2, "part.a", "missing", None), (2, "xs[].v", "missing", None), (2, "xs[].v", "type", "z"), (5, "n", "type", "99999999999")]
    # a column that is not there, one of another kind, no rows
    fewer, broken = N.checked(rows.select("id", F.lit("text").alias("xs")), contract, "id")
    assert fewer.count() == 0 and {(r.field, r.problem) for r in broken.collect()} == {("xs", "type"), ("id", "missing")}
    assert all(df.count() == 0 for df in N.checked(rows.limit(0), contract, "id"))


def test_fields_go_at_every_depth(spark):
    rows = spark.sql("select 'a' as account, 1 as n, named_struct('account', 'a', 'k', array(named_struct('account', 'b', 'v', 2), null)) as s, map('x', named_struct('account', 'c', 'w', 3)) as m, cast(null as struct<account: string, q: int>) as z")
    got = N.without_fields(rows, {"account"})
    assert "account" not in got.schema.simpleString() and got.columns == ["n", "s", "m", "z"]
    row = got.first().asDict(recursive=True)
    assert row == {"n": 1, "s": {"k": [{"v": 2}, None]}, "m": {"x": {"w": 3}}, "z": None}


def test_reports_come_back_from_json(spark):
    start = dt.date(2024, 1, 5)
    items = [("a", k, start + dt.timedelta(14 * k), 900.0 + k, "CREDIT", "payroll", "pay") for k in range(9)] + [("a", 50 + k, start + dt.timedelta(30 * k), 80.5, "DEBIT", "loan", "lend") for k in range(3)]
    ledger = spark.createDataFrame(items, "account string, txn_id long, date date, amount double, type string, label string, cluster string").withColumn("description", F.col("cluster"))
    owners = spark.createDataFrame([("a", 100.0, "CHECKING"), ("b", None, "SAVINGS")], "account string, balance double, account_type string")
    good, errors = N.reports(A.analyze(ledger, owners, dt.date(2024, 6, 30)), owners)
    good = good.persist()
    assert errors.count() == 0 and {r.account: len(r.income_sources) for r in good.collect()} == {"a": 1, "b": 0}
    texts = N.to_text(good)
    again, broken = N.from_text(texts)
    assert broken.count() == 0 and sorted(map(str, again.collect())) == sorted(map(str, good.collect()))
    odd = texts.union(spark.createDataFrame([("x", "{no json"), ("y", '{"account": "y"}'), ("z", None)], "account string, document string"))
    again, broken = N.from_text(odd)
    assert again.count() == 2 and {r.account for r in broken.collect()} == {"x", "y", "z"}


@pytest.mark.parametrize("name", ["contract_errors", "contract_rows"])
def test_against_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    result = db.execute(registry.ORACLES[name])
    names = [c[0] for c in result.description]
    want = sorted(map(str, result.fetchall()))
    got = sorted(str(tuple(r)) for r in registry.QUERIES[name](spark, SF).select(*names).collect())
    assert len(want) > 20 and got == want
