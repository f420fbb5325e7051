"""Documents against an output contract: those that keep it, and what the others break; with the SQL of both."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as Y

from ..sources import contracts as N
from ..sources.adapters import table
from .registry import query

#: Fields of a text's record; some rows lack one, some have words in place of a number.
RECORD = Y.StructType([
    Y.StructField("doc_id", Y.LongType(), False), Y.StructField("size", Y.IntegerType(), False), Y.StructField("lang", Y.StringType(), True, {"values": ["en", "de"]}),
    Y.StructField("lines", Y.ArrayType(Y.StructType([Y.StructField("n", Y.IntegerType(), False)]), False), False),
])

SEEN = """WITH r AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN source ELSE CAST(n_chars AS VARCHAR) END AS size, lang,
 [CASE WHEN x <> '' THEN length(x) END FOR x IN string_split(text, chr(10))] AS n FROM documents),
bad AS (SELECT doc_id, 'size' AS field, 'missing' AS problem, CAST(NULL AS VARCHAR) AS value FROM r WHERE size IS NULL
 UNION ALL SELECT doc_id, 'size', 'type', size FROM r WHERE size IS NOT NULL AND TRY_CAST(size AS INTEGER) IS NULL
 UNION ALL SELECT doc_id, 'lang', 'value', lang FROM r WHERE lang NOT IN ('en', 'de')
 UNION ALL SELECT doc_id, 'lines', 'missing', NULL FROM r WHERE n IS NULL
 UNION ALL SELECT doc_id, 'lines[].n', 'missing', NULL FROM (SELECT doc_id, unnest(n) AS x FROM r) WHERE x IS NULL)"""


def _records(spark, d):
    line = lambda x: F.struct(F.when(x != "", F.length(x)).alias("n"))
    size = F.when(F.col("doc_id") % 5 == 0, F.lit(None)).when(F.col("doc_id") % 7 == 0, F.col("source")).otherwise(F.col("n_chars").cast("string"))
    rows = table(spark, d, "documents").select("doc_id", size.alias("size"), "lang", F.transform(F.split("text", "\n"), line).alias("lines"), "source")
    return N.checked(rows, RECORD, "doc_id")


@query("contract_errors", f"{SEEN} SELECT doc_id, field, problem, value, count(*) AS n FROM bad GROUP BY ALL")
def contract_errors(spark, d):
    return _records(spark, d)[1].groupBy("doc_id", "field", "problem", "value").agg(F.count("*").alias("n"))


@query("contract_rows", f"{SEEN} SELECT doc_id, CAST(size AS BIGINT) AS size, lang, CAST(len(n) AS BIGINT) AS n_lines, CAST(list_sum(n) AS BIGINT) AS n_chars FROM r WHERE doc_id NOT IN (SELECT doc_id FROM bad)")
def contract_rows(spark, d):
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return _records(spark, d)[0].select("doc_id", F.col("size").cast("long").alias("size"), "lang", F.size("lines").cast("long").alias("n_lines"), total.alias("n_chars"))
