"""Cutting lineage between the rounds of an iteration."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the folder that ``spark.checkpoint.dir`` names; a lost executor costs nothing of it.

    Only on one machine, and only if no folder is named, is a temporary one made."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="ledgerline-checkpoints-"))
    return df.checkpoint()
