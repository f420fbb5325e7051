"""Streaming forms: daily nets with late rows, sessions, first sightings and label state.

Each takes and returns a streaming (or plain) DataFrame with an event time ``ts``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.money import signed_amount


def daily_net(rows: DataFrame, late: str = "2 days") -> DataFrame:
    """Net of each account and day; rows later than the watermark are dropped."""
    return rows.withWatermark("ts", late).groupBy("account", F.window("ts", "1 day").alias("day")).agg(F.round(F.sum(signed_amount()), 2).alias("net"), F.count("*").alias("n")).select("account", F.col("day.start").alias("day"), "net", "n")


def sessions(rows: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    return rows.withWatermark("ts", late).groupBy("account", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select("account", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def first_seen(rows: DataFrame, keys: list[str], late: str = "7 days") -> DataFrame:
    """Rows without repeats of a key within the watermark."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def refreshed_labels(rows: DataFrame) -> DataFrame:
    """Labels from counts kept per account and cluster: each row gets the most frequent label seen so far.

    ``rows``: account, cluster, txn_id, label (null: new).  State: label counts, one small map per cluster."""

    def of(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, counts = state.get if state.exists else ([], [])
        seen = dict(zip(names, counts))
        frames = list(batches)
        for frame in frames:
            for name, n in frame["label"].value_counts().items():
                seen[name] = seen.get(name, 0) + int(n)
        state.update((list(seen), list(seen.values())))
        best = min(seen, key=lambda k: (-seen[k], k)) if seen else None
        for frame in frames:
            yield pd.DataFrame({"account": key[0], "cluster": key[1], "txn_id": frame["txn_id"], "label": frame["label"].where(frame["label"].notna(), best)})

    return rows.groupBy("account", "cluster").applyInPandasWithState(of, "account string, cluster string, txn_id long, label string", "names array<string>, counts array<bigint>", "append", GroupStateTimeout.NoTimeout)


#: Partitions of a keyed table, by hash of its keys.
TABLE_PARTS = 64


def _file_system(spark, path: str):
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root, root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark, path: str) -> list[int]:
    """Numbers of the versions of a keyed table that are whole, ascending: those whose manifest is."""
    root, fs = _file_system(spark, f"{path}/_manifest")
    names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted(int(n) for n in names if n.isdigit() and fs.exists(path_of(f"{path}/_manifest/{n}/_SUCCESS")))


def manifest(spark, path: str, version: int) -> dict[int, int]:
    """Which version holds each partition of a keyed table, as of ``version``."""
    return {r["part"]: r["version"] for r in spark.read.schema("part int, version int").parquet(f"{path}/_manifest/{version}").collect()}


def _parts(spark, path: str, where: dict[int, int], schema) -> DataFrame:
    return spark.read.schema(schema).parquet(*[f"{path}/{v}/_part={p}" for p, v in sorted(where.items())])


def stored(spark, path: str) -> DataFrame | None:
    """The keyed table as last written, or None."""
    found = _versions(spark, path)
    where = manifest(spark, path, found[-1]) if found else {}
    if not where:
        return None
    part, version = next(iter(where.items()))
    return _parts(spark, path, where, spark.read.parquet(f"{path}/{version}/_part={part}").schema)


def upsert(rows: DataFrame, path: str, keys: list[str], checkpoint: str, parts: int = TABLE_PARTS, ties: tuple[str, ...] = ()):
    """A keyed table kept by micro-batches: the row with the latest ``ts`` of a key stays, whether new or stored; of
    equal times the one that is largest in ``ties`` (an offset, say), or in all other columns.

    The table is cut into ``parts`` by hash of the keys, and a batch writes only the partitions that it touches, as
    files of a new version; a manifest says which version each partition is of.  The manifest is written last, so that
    a batch that fails leaves the table as it was.  A batch that is run again, a late row and a fresh checkpoint on an
    existing table all give the same table.  Files that neither of the last two manifests names are removed."""

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        found = _versions(spark, path)
        where = manifest(spark, path, found[-1]) if found else {}
        order = F.struct("ts", *(ties or sorted(c for c in batch.columns if c not in ("ts", *keys))))
        dealt = batch.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")).persist()
        try:
            touched = [r["_part"] for r in dealt.select("_part").distinct().collect()]  # at most ``parts``
            if not touched:
                return
            both = dealt.drop("_part")
            if old := {p: where[p] for p in touched if p in where}:
                both = both.unionByName(_parts(spark, path, old, batch.schema))
            last = both.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
            version = found[-1] + 1 if found else 0
            last.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")).repartition("_part").write.mode("overwrite").partitionBy("_part").parquet(f"{path}/{version}")
            now = where | {p: version for p in touched}
            spark.createDataFrame(sorted(now.items()), "part int, version int").coalesce(1).write.mode("overwrite").parquet(f"{path}/_manifest/{version}")
        finally:
            dealt.unpersist()
        needed = {*now.items(), *where.items()}
        gone = [f"{path}/_manifest/{v}" for v in found[:-1]]
        if len(found) > 1:
            gone += [f"{path}/{v}/_part={p}" for p, v in manifest(spark, path, found[-2]).items() if (p, v) not in needed]
        for each in gone:
            at, fs = _file_system(spark, each)
            fs.delete(at, True)

    return rows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
