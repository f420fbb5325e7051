"""Importance resampling towards a target distribution.

Documents and target texts become bags of hashed features (runs of one to three
words).  What the target says more often than the corpus has a gain, what it
says less often a loss; a document weighs the sum over its features, and the
documents with the largest weight plus Gumbel noise are drawn, which is a sample
without replacement in proportion to the exponentials of the weights.

1. Tasks count buckets into arrays of fixed size; the sums per bucket are added
   in Spark.  Gains are one array of ``buckets`` numbers, so that what is taken
   to the tasks has a fixed size.
2. A second pass looks each feature's gain up and adds.
3. The draw's border is found by radix selection on the digits of the key
   (score falling, doc_id rising): counts of one digit among the rows that share
   the digits found so far say where the k-th key lies.  No row is sorted.
4. Only drawn rows are sorted by range; their ranks are row numbers within a
   range plus the sizes of the ranges before it.

The CRC of a feature comes from those of its words: appending is a linear map of
the 32 bits, applied as four look-ups to all words of a batch at once.

Null and empty texts have no features and weight 0.  A null doc_id hashes like
an empty one and comes after all others on a tie.  Repeated rows are documents of
their own; if some of equal rows are drawn, it is undefined which.  An empty
target has gains as well (all features are as rare in it).  Empty tables give no
rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import LOWER, Texts, rounds, words
from .store import bounded_batches, keep

BUCKETS = 10_000
SMOOTHING = 10_000
#: Bits of the key that one step of the selection looks at.
DIGIT_BITS = 12
#: Everything but digits, lower-case letters and bytes of non-ASCII characters.
BREAKS = np.ones(256, dtype=bool)
BREAKS[48:58] = BREAKS[97:123] = BREAKS[128:] = False

_POLYNOMIAL = 0xEDB88320


def _byte_steps() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(_POLYNOMIAL), np.uint32(0))
    return table


_STEP = _byte_steps()


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & np.uint32(255)] ^ tables[1][(x >> np.uint32(8)) & np.uint32(255)] ^ tables[2][(x >> np.uint32(16)) & np.uint32(255)] ^ tables[3][x >> np.uint32(24)]


def _shifts() -> list[np.ndarray]:
    """For each k, tables of the map that 2**k zero bytes apply to a register."""
    values = np.arange(256, dtype=np.uint32)
    one = np.stack([values << np.uint32(8 * j) for j in range(4)])
    one = _STEP[one & np.uint32(255)] ^ (one >> np.uint32(8))
    out = [one]
    for _ in range(30):
        out.append(np.stack([_apply(out[-1], out[-1][j]) for j in range(4)]))
    return out


_SHIFT = _shifts()


def _shifted(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The registers ``x`` after ``n`` zero bytes each."""
    out = x.copy()
    for k in range(int(n.max(initial=0)).bit_length()):
        at = np.flatnonzero(n >> k & 1)
        out[at] = _apply(_SHIFT[k], out[at])
    return out


def _registers(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC registers of slices, begun at zero; long slices are cut in halves so that steps stay few."""
    out = np.zeros(len(starts), dtype=np.uint32)
    long = lengths > 64
    if long.any():
        half = lengths[long] // 2
        left = _registers(data, starts[long], half)
        right = _registers(data, starts[long] + half, lengths[long] - half)
        out[long] = _shifted(left, lengths[long] - half) ^ right
    order = np.flatnonzero(~long)
    order = order[np.argsort(-lengths[order], kind="stable")]
    place, left, now = starts[order], lengths[order], np.zeros(len(order), dtype=np.uint32)
    for k in range(int(left[0]) if len(left) else 0):
        live = int(np.searchsorted(-left, -k, side="left"))  # slices of more than k bytes
        now[:live] = _STEP[(now[:live] ^ data[place[:live] + k]) & np.uint32(255)] ^ (now[:live] >> np.uint32(8))
    out[order] = now
    return out


def features(texts: Texts, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text of every feature, and the number of words of every text."""
    data = LOWER[texts.data]
    starts, ends, first = words(Texts(data, texts.starts), BREAKS)
    counts = np.diff(first)
    text_of = np.repeat(np.arange(len(counts)), counts)
    lengths = ends - starts
    own = _registers(data, starts, lengths)
    # a blank and the word: what is appended for each further word of a run
    more = _shifted(np.full(len(own), _STEP[32], dtype=np.uint32), lengths) ^ own
    now = _shifted(np.full(len(own), 0xFFFFFFFF, dtype=np.uint32), lengths) ^ own
    out, owners = [now], [text_of]
    for n in (1, 2):
        last = np.flatnonzero(text_of[n:] == text_of[:-n]) + n
        begin, longer = last - n, np.zeros_like(now)
        longer[begin] = _shifted(now[begin], lengths[last] + 1) ^ more[last]
        out.append(longer[begin])
        owners.append(text_of[begin])
        now = longer
    every = np.concatenate(out) ^ np.uint32(0xFFFFFFFF)
    return (every % np.uint32(buckets)).astype(np.int64), np.concatenate(owners), counts


def bucket_counts(rows: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts fall in each bucket that has any."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, texts in rounds(batch.column(0)):
                total += np.bincount(features(texts, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    counted = bounded_batches(rows.select(F.col(text_col).cast("string"))).mapInArrow(of, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket from two tables of counts; at most ``buckets`` rows of each come to the driver."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for into, counted in ((s, corpus), (t, target)):
        for row in counted.collect():
            into[row["bucket"]] = row["n"]
    total_s, total_t = s.sum(), t.sum()
    ratio = (t + 1) * (total_s + SMOOTHING) / ((s + 1) * (total_t + SMOOTHING))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], dtype=np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each document."""
    buckets = len(gain)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, weight = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3))
            for a, b, texts in rounds(batch.column(1)):
                bucket, owner, counts = features(texts, buckets)
                n_words[a:b] = counts
                n_features[a:b] = np.bincount(owner, minlength=b - a)
                np.add.at(weight[a:b], owner, gain[bucket])
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n_words, n_features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return bounded_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string"))).mapInArrow(of, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = 42) -> Column:
    """Gumbel noise in thousandths from the document's id alone, the same in every run."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def border(keys: DataFrame, k: int) -> tuple[int, int | None] | None:
    """The k-th key (score falling, doc_id rising, null ids last) of ``keys``; None if k is 0.

    Each step counts the rows per digit among those that share the digits found before."""
    if k < 1:
        return None
    high, low, first, last = keys.agg(F.max("score"), F.min("score"), F.min("doc_id"), F.max("doc_id")).first()
    # without any id all rows are alike; a null id stands one step after the largest
    ids = 0 if first is None else last - first
    after = F.lit(0) if first is None else F.coalesce(F.col("doc_id") - F.lit(first), F.lit(ids + 1))
    parts = [(F.lit(high) - F.col("score"), high - low), (after, ids + 1)]
    if any(span >= 1 << 62 for _, span in parts):
        raise ValueError("scores or ids are 2**62 or more apart")
    left, found = k, []
    rows = keys
    for value, span in parts:
        at = 0
        for step in reversed(range(-(-max(1, span.bit_length()) // DIGIT_BITS))):
            below = step * DIGIT_BITS
            digit = F.shiftright(value.cast("long"), below).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1))
            for d, n in sorted((r["d"], r["n"]) for r in rows.groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect()):
                if left <= n:
                    break
                left -= n
            at += d << below
            rows = rows.where(F.shiftright(value.cast("long"), below) == (at >> below))
        found.append(at)
    return high - found[0], None if first is None or found[1] > ids else first + found[1]


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` with ``rank`` by score falling and doc_id rising, null beyond ``k``: sorted by ranges, ranks from their sizes."""
    place = F.monotonically_increasing_id()
    sorted_rows = rows.orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    stored = keep(sorted_rows.select("*", F.shiftright(place, 33).alias("__part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("__row")), "drawn")
    # a row for each task of the sort
    before, total = [], 0
    for part, n in sorted((r["__part"], r["n"]) for r in stored.groupBy("__part").agg(F.count("*").alias("n")).collect()):
        before.append((part, total))
        total += n
    # as many rows as the sort had tasks
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, "__part long, __before long"))
    rank = (F.col("__row") + F.col("__before") + 1).cast("long")
    return stored.join(offsets, "__part").withColumn("rank", F.when(rank <= k, rank)).drop("__part", "__row", "__before")


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 5, min_words: int = 20, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """Per document: doc_id, n_features, weight, score and rank (1, 2, 3 … of the drawn, else null).

    ``percent`` of the documents with at least ``min_words`` words are drawn, rounded down."""
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, text_col, buckets), buckets)
    scored = weighted(docs, gain, id_col, text_col).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    stored = keep(scored, "weights")
    able = stored.where(F.col("n_words") >= min_words)
    k = percent * able.count() // 100
    last = border(able.select("score", "doc_id"), k)
    out = ["doc_id", "n_features", "weight", "score"]
    if last is None:
        drawn = F.lit(False)
    else:
        score, doc_id = last
        tied = F.lit(True) if doc_id is None else F.coalesce(F.col("doc_id") <= doc_id, F.lit(False))
        drawn = (F.col("n_words") >= min_words) & ((F.col("score") > score) | ((F.col("score") == score) & tied))
    rest = stored.where(~drawn).select(*out, F.lit(None).cast("long").alias("rank"))
    rows = rest if last is None else ranked(stored.where(drawn).select(*out), k).select(*out, "rank").unionByName(rest)
    return rows.withColumnRenamed("doc_id", id_col)
