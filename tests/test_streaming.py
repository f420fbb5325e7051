import datetime as dt

from pyspark.sql import functions as F

from ledgerline.streaming import ledgers


def _stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def _run(stream, spark, tmp_path, name, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_daily_net(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 12)
    rows = [("a", t, 10.0, "CREDIT"), ("a", t, 4.0, "DEBIT"), ("b", t + dt.timedelta(1), 1.0, "CREDIT")]
    got = _run(ledgers.daily_net(_stream(spark, tmp_path, rows, "account string, ts timestamp, amount double, type string")), spark, tmp_path, "nets", "complete")
    assert {r.account: (r.net, r.n) for r in got} == {"a": (6.0, 2), "b": (1.0, 1)}


def test_label_state(spark, tmp_path):
    rows = [("a", "k", 1, "x"), ("a", "k", 2, "x"), ("a", "k", 3, "y"), ("a", "k", 4, None), ("a", "q", 5, None)]
    got = _run(ledgers.refreshed_labels(_stream(spark, tmp_path, rows, "account string, cluster string, txn_id long, label string")), spark, tmp_path, "labels_", "append")
    assert {r.txn_id: r.label for r in got} == {1: "x", 2: "x", 3: "y", 4: "x", 5: None}


def test_upsert(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    stream = _stream(spark, tmp_path, [("a", 1, t), ("a", 2, t + dt.timedelta(1)), ("b", 5, t)], "k string, v int, ts timestamp")
    ledgers.upsert(stream, str(tmp_path / "out"), ["k"], str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert {r.k: r.v for r in spark.read.parquet(str(tmp_path / "out" / "0")).select("k", F.col("v")).collect()} == {"a": 2, "b": 5}


def _feed(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def test_upsert_touches_few_partitions(spark, tmp_path):
    """A batch of a few keys rewrites their partitions only; ties are decided; old files go."""
    t, schema, path = dt.datetime(2024, 1, 1), "k string, v int, ts timestamp, at int", str(tmp_path / "out")

    def batch(rows):
        _feed(spark, tmp_path / "in", rows, schema)
        ledgers.upsert(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), path, ["k"], str(tmp_path / "cp"), parts=16, ties=("at",)).trigger(availableNow=True).start().awaitTermination(120)
        return {r.k: r.v for r in ledgers.stored(spark, path).collect()}

    want = {f"k{i}": i for i in range(200)}
    assert batch([(k, v, t, 1) for k, v in want.items()]) == want
    first = ledgers.manifest(spark, path, 0)
    assert len(first) == 16 and set(first.values()) == {0}
    want |= {"k1": -1, "k2": -2}
    assert batch([("k1", -1, t, 3), ("k1", 7, t, 2), ("k2", -2, t + dt.timedelta(1), 0), ("k3", 9, t - dt.timedelta(1), 9)]) == want
    second = ledgers.manifest(spark, path, 1)
    assert sum(v == 1 for v in second.values()) <= 3
    want["new"] = 5
    assert batch([("new", 5, t, 1)]) == want and batch([("new", 4, t, 0)]) == want
    assert ledgers._versions(spark, path) == [2, 3]
