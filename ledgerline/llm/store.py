"""Intermediate tables in the folder that all executors share.

``keep`` writes a DataFrame as Parquet below ``spark.checkpoint.dir`` and reads
it back: lineage is cut, and a lost executor costs nothing because the files
live outside it.  The folder is read from the session; only where none is set
(as in tests on one machine) is a local one made.  Operators delete the tables
that their result does not read (``mark`` and ``drop_since``); what a lazy
result still reads goes with ``sweep`` between jobs.
"""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

PREFIX = "ledgerline-"
#: (name, path) of the tables that this thread has written and not dropped.
_local = threading.local()


def _tables() -> list[tuple[str, str]]:
    if not hasattr(_local, "tables"):
        _local.tables = []
    return _local.tables


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; raises on a cluster that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ledgerline-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found) if spark.conf.isModifiable("spark.checkpoint.dir") else None
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted as tables are."""
    path = f"{shared_dir(spark)}/{PREFIX}{name}-{uuid.uuid4().hex}"
    _tables().append((name, path))
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read back from there."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """The place in this thread's list of tables from which ``drop_since`` deletes."""
    return len(_tables())


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def drop_since(spark: SparkSession, begin: int, *wanted: str) -> None:
    """Delete the tables that this thread has kept since ``begin``, other than those named ``wanted``.

    Only tables of which no later plan reads anything may go."""
    own = _tables()
    gone = [t for t in own[begin:] if t[0] not in wanted]
    own[begin:] = [t for t in own[begin:] if t[0] in wanted]
    _delete(spark, [path for _, path in gone])


#: Rows of an Arrow batch: whole texts go to Python workers, so that the default of 10,000 rows takes much memory.
BATCH_ROWS = 1_000


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, after lowering the session's rows per Arrow batch to BATCH_ROWS if they are more.

    Spark reads the setting when a plan runs, which may be long after this call, so that it stays lowered."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def sweep(spark: SparkSession) -> int:
    """Delete every table that ``keep`` has written; call it between jobs, when no result is still to be read."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = [f.getPath().toString() for f in fs.listStatus(root) if f.getPath().getName().startswith(PREFIX)] if fs.exists(root) else []
    _delete(spark, gone)
    _tables().clear()
    return len(gone)
