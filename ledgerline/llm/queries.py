"""One thin query per operator: ``opN_<name>`` over the whole of its table, and ``pipeline``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontam import contaminated
from .license_scan import license_scan
from .line_dedup import duplicate_lines
from .ngram_join import ngram_join
from .oracles import SQL
from .packing import packed
from .pii import pii
from .quality_rules import quality
from .resampling import resampled
from .substring_dedup import repeated_spans
from .toxicity import toxicity
from .url_filter import url_filter
from .vector_codes import vector_codes
from .warc import round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_lines(_table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents")).drop("detections")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii(_table(spark, sf_dir, "documents")).drop("found")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_table(spark, sf_dir, "documents"))


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_table(spark, sf_dir, "pages"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(_table(spark, sf_dir, "embeddings"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "pages"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_license_scan": op2_license_scan,
        "op3_toxicity": op3_toxicity,
        "op4_pii": op4_pii,
        "op5_ngram_join": op5_ngram_join,
        "op6_decontam": op6_decontam,
        "op7_quality": op7_quality,
        "op8_url_filter": op8_url_filter,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_packing": op10_packing,
        "op11_vector_codes": op11_vector_codes,
        "op12_warc": op12_warc,
        "op13_resampling": op13_resampling,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
