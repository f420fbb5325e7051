"""Repeated passages by hashes of normalised units.

A text is cut into lines and, within them, sentences; each unit is normalised
(A-Z lower-cased, blanks collapsed) and hashed to 128 bits.  Digests are grouped
over all documents; the occurrence with the smallest (id, unit) stays.  Later
ones are marked, and stretches of consecutive marked units that hold at least
``min_words`` words are removed, with their places in the original text kept.
Units of fewer than ``unit_words`` words are not hashed: they go with the
stretch around them.  A short boilerplate sentence alone is thus left in place.

Null and empty texts have no units.  Rows that share an id count as one
document: their equal units have one rank and do not remove each other.  Rows
with a null id rank first and are not reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernel import BASE, BASE_INVERSE, LOWER, U, _powers_of, code_points, mix, prefix_sums, rounds, signed, slices, words
from .store import bounded_batches, keep

UNIT_WORDS = 4
MIN_WORDS = 25
STOPS = np.zeros(256, dtype=bool)
STOPS[[ord(c) for c in ".!?"]] = True


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit_words: int = UNIT_WORDS) -> DataFrame:
    """One row per hashed unit: id, its number, start and end (code points), words and digest (h1, h2)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in rounds(batch.column(1)):
                data = texts.data
                starts, ends, first = words(texts)
                n = len(starts)
                if not n:
                    continue
                hashes = slices(prefix_sums(LOWER[data]), starts, ends)
                breaks = np.concatenate(([0], np.cumsum(data == 10)))
                last = STOPS[data[ends - 1]]
                last[:-1] |= breaks[starts[1:]] > breaks[ends[:-1]]
                tail = first[1:][np.diff(first) > 0] - 1
                last[tail] = True
                stop = np.flatnonzero(last) + 1  # word after each unit
                begin = np.concatenate(([0], stop[:-1]))
                size = stop - begin
                big = size >= unit_words
                begin, stop, size = begin[big], stop[big], size[big]
                text_of = np.searchsorted(first, begin, side="right") - 1
                digests = []
                for salt in (0x0, 0x6C62272E07BB0142):
                    sums = np.concatenate((np.zeros(1, U), np.cumsum(mix(hashes ^ U(salt)) * _powers_of(BASE, n), dtype=U)))
                    digests.append(mix((sums[stop] - sums[begin]) * _powers_of(BASE_INVERSE, n + 1)[begin] + size.astype(U)))
                points = code_points(data)
                base = points[texts.starts[:-1]][text_of]
                number = np.arange(len(begin)) - np.searchsorted(text_of, text_of)
                ids = batch.column(0).slice(a, b - a).take(pa.array(text_of))
                columns = [ids, pa.array(number.astype(np.int32)), pa.array((points[starts[begin]] - base).astype(np.int32)), pa.array((points[ends[stop - 1]] - base).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(signed(digests[0])), pa.array(signed(digests[1]))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "unit", "start", "end", "n_words", "h1", "h2"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return bounded_batches(rows).mapInArrow(of, "id long, unit int, start int, end int, n_words int, h1 long, h2 long")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, unit_words: int = UNIT_WORDS) -> DataFrame:
    """Spans to remove: doc_id, start, end (code points, end exclusive), n_units, n_words and keeper_id,
    the document of the earliest occurrence of the span's first unit."""
    rows = keep(units(docs, id_col, text_col, unit_words), "units")
    place = F.struct("id", "unit")
    # written before the join, so that Spark can split it at a unit that very many documents share
    first = keep(rows.groupBy("h1", "h2").agg(F.min(place).alias("keeper"), F.max(place).alias("latest")).where("latest > keeper").drop("latest"), "first-units")
    marked = rows.join(first, ["h1", "h2"]).where(place > F.col("keeper")).select("id", "unit", "start", "end", "n_words", F.col("keeper.id").alias("keeper_id"))
    order = Window.partitionBy("id").orderBy("unit")
    # repeated ids give a unit twice: it counts once
    marked = marked.where("id is not null").withColumn("before", F.lag("unit").over(order)).where("before is null or before < unit")
    runs = marked.withColumn("run", F.col("unit") - F.row_number().over(order))
    spans = runs.groupBy("id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_units"), F.sum("n_words").alias("n_words"), F.min_by("keeper_id", "unit").alias("keeper_id"))
    return spans.where(F.col("n_words") >= min_words).select(F.col("id").alias(id_col), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "n_units", "n_words", "keeper_id")


def without_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans cut from their texts; all other columns as they are."""
    cuts = spans.groupBy(F.col(id_col).alias("__spans_id")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__spans_cuts"))
    joined = docs.join(cuts, docs[id_col] == cuts["__spans_id"], "left")
    text, cut = F.col(text_col), F.col("__spans_cuts")
    begin = F.transform(F.sequence(F.lit(0), F.size(cut)), lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.element_at(cut, i)["end"]))
    bounds = F.arrays_zip(begin.alias("b"), F.concat(F.transform(cut, lambda c: c["start"]), F.array(F.length(text).cast("long"))).alias("e"))
    rest = F.array_join(F.transform(bounds, lambda x: F.substring(text, (x["b"] + 1).cast("int"), (x["e"] - x["b"]).cast("int"))), "")
    return joined.withColumn(text_col, F.when(cut.isNull(), text).otherwise(rest)).drop("__spans_id", "__spans_cuts")
