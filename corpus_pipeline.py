"""From raw documents to packed training sequences.

Each stage is one operator of ``ledgerline.llm`` on all rows that its
predecessor kept; stages are written to the shared folder and read again in
between.  The near-duplicate stage takes five-word shingles and a similarity of
0.8.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import decontam, line_dedup, ngram_join, packing, toxicity
from ledgerline.llm.store import drop_since, keep, mark


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold."""
    return toxicity.without_toxic(docs, _table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier line repeats; a document left without text goes."""
    out = line_dedup.deduplicated(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates."""
    classes = ngram_join.ngram_join(docs, k=5, num=80, den=100)
    others = keep(classes.where("component_id < doc_id").select(F.col("doc_id").alias("__other_id")).distinct(), "others")
    return docs.join(others, docs["doc_id"] == others["__other_id"], "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands."""
    return decontam.decontaminated(docs, _table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL expresses neither the trained filter nor the packing; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    begin = mark()
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
        # what the stage and its predecessor wrote is not read again
        drop_since(spark, begin, f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
