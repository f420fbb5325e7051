"""Observed figures against counted ones, in batch and in streams."""

import datetime as dt
import time

from pyspark.sql import functions as F

from ledgerline.operators import observed as B
from ledgerline.streaming import ledgers


def test_figures_of_a_write(spark, tmp_path):
    rows = spark.createDataFrame([(1, dt.date(2024, 1, 1), "CREDIT", "rules"), (2, None, "DEBIT", "rules"), (3, dt.date(2024, 3, 1), None, "cluster"), (4, dt.date(2024, 2, 1), "odd", None)], "txn_id long, date date, type string, label_source string")
    out, seen = B.watched(rows)
    out, hits = B.label_hits(out)
    out.write.parquet(str(tmp_path / "out"))
    assert seen.get == {"n_rows": 4, "n_undated": 1, "n_credits": 1, "n_untyped": 2, "first_date": dt.date(2024, 1, 1), "last_date": dt.date(2024, 3, 1)}
    assert B.hit_rates(hits) == {"rules": 0.5, "history": 0.0, "cluster": 0.25, "none": 0.0, "other_source": 0.25}
    none, seen = B.label_hits(rows.limit(0))
    none.write.parquet(str(tmp_path / "none"))
    assert set(B.hit_rates(seen).values()) == {0.0}


def test_figures_of_a_stream(spark, tmp_path):
    at = lambda day, hour=0: dt.datetime(2024, 1, day, hour)
    schema = "account string, ts timestamp, amount double, type string"
    # the second file moves the watermark on; rows are late by the watermark that the batch before began with, so the
    # old rows of the fourth file are, and they alone
    for k, days in enumerate([[1, 2, 3], [20, 21], [21], [2, 3]]):
        spark.createDataFrame([("a", at(d), 1.0, "CREDIT") for d in days], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
        time.sleep(1.1)  # files are read in the order of their times
    progress = B.Progress()
    spark.streams.addListener(progress)
    try:
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part=*"))
        out = ledgers.daily_net(rows.observe("seen", F.count(F.lit(1)).alias("n")))
        query = out.writeStream.format("memory").queryName("nets").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
        until = time.time() + 20
        while not progress.of(query.id).get("ended") and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(progress)
    got = progress.of(query.id)
    assert got["ended"] and got["rows"] == 8 and got["dropped"] == 2 and got["batches"] >= 3 and "n" in got["observed"]["seen"]
    assert progress.of("unknown") == {}
