"""Pay-day patterns, truncation per request and the keyed table on hand-made rows."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerline.operators import calendar as C
from ledgerline.operators import money as M
from ledgerline.operators import paydays as P
from ledgerline.streaming import ledgers

D = dt.date


def days(spark, *dates):
    return spark.createDataFrame([("a", "p", d) for d in dates], "account string, cluster string, date date")


def test_day_of_month_with_moved_days(spark):
    cal = C.business_calendar(spark, D(2024, 1, 1), D(2024, 12, 31)).persist()
    # the fifteenth, moved back in June (Saturday) and September (Sunday); in January after a holiday
    rows = days(spark, D(2024, 1, 16), D(2024, 2, 15), D(2024, 3, 15), D(2024, 5, 15), D(2024, 6, 14), D(2024, 9, 13))
    r = P.pattern_support(P.intended_days(rows, cal)).where("kind = 0").first()
    assert (r.a, r.raw, r.after, r.before, r.score, r.direction) == (15, 3, 1, 2, 1.0, "B")


def test_truncation_is_per_request(spark):
    rows = spark.createDataFrame([(1, D(2024, 6, 10)), (1, D(2024, 3, 1)), (1, D(2024, 2, 29)), (2, D(2020, 1, 5)), (2, D(2019, 10, 1)), (2, D(2019, 9, 30)), (2, D(2020, 2, 1))], "request_id int, date date")
    rows = rows.withColumn("as_of", F.when(F.col("request_id") == 1, F.lit(D(2024, 6, 30))).otherwise(F.lit(D(2020, 1, 31))))
    got = sorted((r.request_id, r.date) for r in M.truncate(rows, F.col("as_of"), 3, ("request_id",)).collect())
    assert got == [(1, D(2024, 3, 1)), (1, D(2024, 6, 10)), (2, D(2019, 10, 1)), (2, D(2020, 1, 5))]


def test_late_rows_and_fresh_checkpoints_keep_the_table(spark, tmp_path):
    schema, t = "k string, v int, ts timestamp", dt.datetime(2024, 1, 1)
    spark.createDataFrame([("a", 1, t + dt.timedelta(5)), ("b", 1, t)], schema).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.createDataFrame([("a", 2, t), ("b", 2, t + dt.timedelta(1))], schema).coalesce(1).write.parquet(str(tmp_path / "two"))
    for name in ("one", "two"):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / name))
        ledgers.upsert(stream, str(tmp_path / "out"), ["k"], str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start().awaitTermination(120)
    assert {r.k: r.v for r in ledgers.stored(spark, str(tmp_path / "out")).collect()} == {"a": 1, "b": 2}
