"""Entities in descriptions: a sequence tagger trained on labelled texts.

A linear model over hashed features of each token and over pairs of neighbouring tags, fitted by the averaged
structured perceptron on every labelled text.  Every round, shards of the texts train side by side from the same
weights and Spark adds what they changed; texts are decoded exactly (Viterbi) in Arrow batches, each distinct text once.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hashed features; a model has BUCKETS x tags weights and as many more as there are pairs of tags.
BUCKETS = 1 << 16
#: Shards that train side by side at least, and rounds over the texts.
SHARDS, ROUNDS = 8, 4
#: Distinct texts of a shard, about: with more texts there are more shards, and a task stays as it is.
PER_SHARD = 6_250
#: Tag of a token outside of entities.
OUT = "O"
#: Averages are added as integers of this fraction, so that the order of rows does not matter.
UNIT = 1_000_000

TOKEN = re.compile(r"\S+")


def tokens(text: str | None) -> list[str]:
    """Stretches without blanks; none of a null or empty text."""
    return TOKEN.findall(text or "")


def shape(word: str) -> str:
    """Kinds of characters in a row: ``ab12`` is ``a0``."""
    kinds = ["0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else "-" for c in word]
    return "".join(k for i, k in enumerate(kinds) if i == 0 or k != kinds[i - 1])


def features(words: list[str], buckets: int = BUCKETS) -> np.ndarray:
    """Bucket numbers of each token's features (tokens x features): words up to two away, forms up to one away."""
    low = ["<", *(w.lower() for w in words), ">"]
    forms = ["<", *(shape(w) for w in words), ">"]
    rows = []
    for i in range(1, len(words) + 1):
        said = (f"w{low[i]}", f"s{forms[i]}", f"e{low[i][-3:]}", f"p{low[i - 1]}", f"n{low[i + 1]}", f"q{forms[i - 1]}|{forms[i]}", f"r{forms[i]}|{forms[i + 1]}", f"b{low[max(i - 2, 0)]}|{low[i - 1]}", f"u{low[max(i - 2, 0)]}", f"v{low[min(i + 2, len(low) - 1)]}", "1")
        rows.append([zlib.crc32(x.encode()) % buckets for x in said])
    return np.array(rows, dtype=np.int64).reshape(len(rows), -1)


def best_path(scores: np.ndarray, pairs: np.ndarray) -> list[int]:
    """The tags of the largest sum of ``scores`` (tokens x tags) and ``pairs`` (tags and one row for the start, x tags).

    Of equal sums the path whose last tags come first in the list of tags."""
    if not len(scores):
        return []
    k = scores.shape[1]
    reach, back = scores[0] + pairs[k], []
    for row in scores[1:]:
        ways = reach[:, None] + pairs[:k]
        back.append(ways.argmax(axis=0))
        reach = ways.max(axis=0) + row
    path = [int(reach.argmax())]
    for came in reversed(back):
        path.append(int(came[path[-1]]))
    return path[::-1]


@dataclass
class Model:
    """Tags in the order of their numbers, and weights: features x tags, then pairs of tags."""

    tags: list[str]
    weights: np.ndarray
    buckets: int = BUCKETS

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        k = len(self.tags)
        cut = self.buckets * k
        return self.weights[:cut].reshape(-1, k), self.weights[cut:].reshape(k + 1, k)

    def tag(self, words: list[str]) -> list[str]:
        if not words:
            return []
        single, pairs = self.parts()
        return [self.tags[t] for t in best_path(single[features(words, self.buckets)].sum(axis=1), pairs)]

    def save(self, spark: SparkSession, path: str) -> None:
        """Weights other than 0 and the tags as a Parquet table."""
        at = np.flatnonzero(self.weights)
        rows = [("weight", int(i), float(self.weights[i]), None) for i in at] + [("tag", i, 0.0, t) for i, t in enumerate(self.tags)] + [("buckets", self.buckets, 0.0, None)]
        spark.createDataFrame(rows, "kind string, place long, weight double, tag string").coalesce(1).write.mode("errorifexists").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        """A saved model; its size is bounded by its buckets and tags."""
        rows = spark.read.parquet(path).collect()
        tags = [r.tag for r in sorted((r for r in rows if r.kind == "tag"), key=lambda r: r.place)]
        buckets = next(r.place for r in rows if r.kind == "buckets")
        weights = np.zeros(buckets * len(tags) + (len(tags) + 1) * len(tags))
        for r in rows:
            if r.kind == "weight":
                weights[r.place] = r.weight
        return Model(tags, weights, buckets)


def places(feats: np.ndarray, tags: list[int], k: int, buckets: int) -> np.ndarray:
    """The weights that a text with these tags uses, repeats included."""
    t = np.array(tags, dtype=np.int64)
    before = np.concatenate(([k], t[:-1]))
    return np.concatenate(((feats * k + t[:, None]).ravel(), buckets * k + before * k + t))


def trained(start: Model, texts: Iterable[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """What one pass over the texts changes: the last weights' difference and that of their average, from ``start``.

    A text is (words, numbers of its tags) or these and how many copies of it follow one another.  One text is held at a time."""
    model = Model(start.tags, start.weights.copy(), start.buckets)
    single, pairs = model.parts()
    k, late, n = len(model.tags), np.zeros_like(model.weights), 0
    for words, right, *copies in texts:
        feats, end = features(words, model.buckets), n + (copies[0] if copies else 1)
        while n < end:
            got = best_path(single[feats].sum(axis=1), pairs)
            if got == right:
                break  # the copies that are left change nothing
            for tags, sign in ((right, 1.0), (got, -1.0)):
                used = places(feats, tags, k, model.buckets)
                np.add.at(model.weights, used, sign)
                np.add.at(late, used, sign * n)
            n += 1
        n = end
    last = model.weights - start.weights
    return last, last - late / max(n, 1)


def lessons(labelled: DataFrame) -> DataFrame:
    """(tokens, tags, n, h): each distinct row that teaches something, how often it stands there, and the hash of its tokens.

    Rows without tokens or with another number of tags than of tokens teach nothing and are left out."""
    good = labelled.where((F.size("tokens") > 0) & (F.size("tokens") == F.size("tags"))).select("tokens", "tags")
    good = good.where(~F.exists("tokens", lambda t: t.isNull()) & ~F.exists("tags", lambda t: t.isNull()))
    return good.groupBy("tokens", "tags").agg(F.count("*").alias("n")).withColumn("h", F.xxhash64("tokens"))


def fit(labelled: DataFrame, rounds: int = ROUNDS, shards: int = SHARDS, buckets: int = BUCKETS, per_shard: int = PER_SHARD) -> Model:
    """A model of all rows (tokens: array of strings, tags: array of strings), in ``shards`` shards or more.

    A round is one Spark job: shards return only the weights they changed, Spark adds them by place, and the driver
    gets at most one number for each weight of the model.  Without usable rows every token is outside."""
    rows = lessons(labelled)
    shards = max(shards, math.ceil(rows.count() / per_shard))
    rows = rows.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    rows = rows.repartitionById(shards, "shard").sortWithinPartitions("shard", "h", "tokens", "tags").persist()
    try:
        tags = sorted({OUT, *(r[0] for r in rows.select(F.explode("tags")).distinct().collect())})
        k = len(tags)
        weights = np.zeros(buckets * k + (k + 1) * k)
        average = np.zeros_like(weights)
        for _ in range(rounds):
            last, mean = _round(rows, Model(tags, weights, buckets), shards)
            average += weights + mean
            weights = weights + last
    finally:
        rows.unpersist()
    return Model(tags, average / max(rounds, 1), buckets)


def _round(rows: DataFrame, now: Model, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean over shards of what each changes in one pass."""
    held = rows.sparkSession.sparkContext.broadcast(now)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        number = {t: i for i, t in enumerate(model.tags)}
        each = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "tokens", "tags", "n"))))
        for _, own in itertools.groupby(each, key=lambda row: row[0]):  # rows come sorted by shard
            last, mean = trained(model, ((words, [number[t] for t in tags], n) for _, words, tags, n in own))
            at = np.flatnonzero((last != 0) | (mean != 0))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.rint(last[at]).astype(np.int64)), pa.array(np.rint(mean[at] * UNIT).astype(np.int64))], ["place", "last", "mean"])

    moved = rows.mapInArrow(of, "place long, last long, mean long").groupBy("place").agg(F.sum("last").alias("last"), F.sum("mean").alias("mean")).toPandas()
    out = np.zeros((2, len(now.weights)))
    out[0, moved.place] = moved["last"] / shards
    out[1, moved.place] = moved["mean"] / (UNIT * shards)
    held.destroy()
    return out[0], out[1]


def tagged(texts: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(text, tokens, tags) of each distinct text; null and empty texts have none."""
    held = texts.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            said = batch.column(0).to_pylist()
            words = [tokens(t) for t in said]
            tags = [known.tag(w) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(said, pa.string()), pa.array(words, pa.list_(pa.string())), pa.array(tags, pa.list_(pa.string()))], ["text", "tokens", "tags"])

    one = texts.select(F.col(text).cast("string").alias("text")).where("text is not null").distinct()
    return one.mapInArrow(of, "text string, tokens array<string>, tags array<string>")


def spans(rows: DataFrame) -> DataFrame:
    """(text, entities): the runs of equal tags of (text, tokens, tags), as structs (kind, entity, first, n) in order."""
    runs = F.expr(f"""aggregate(sequence(1, size(tags)), cast(array() as array<struct<kind:string,entity:string,first:int,n:int>>), (out, i) -> CASE
 WHEN tags[i - 1] = '{OUT}' THEN out
 WHEN i > 1 AND tags[i - 2] = tags[i - 1] THEN concat(slice(out, 1, size(out) - 1), array(named_struct('kind', tags[i - 1], 'entity', concat_ws(' ', element_at(out, -1).entity, tokens[i - 1]), 'first', element_at(out, -1).first, 'n', element_at(out, -1).n + 1)))
 ELSE concat(out, array(named_struct('kind', tags[i - 1], 'entity', tokens[i - 1], 'first', i - 1, 'n', 1))) END)""")
    none = F.expr("cast(array() as array<struct<kind:string,entity:string,first:int,n:int>>)")
    return rows.select("text", F.when(F.size("tags") > 0, runs).otherwise(none).alias("entities"))


def with_entities(ledger: DataFrame, model: Model, order: tuple[str, ...] = ("ORG", "PERSON"), text: str = "description") -> DataFrame:
    """Adds ``entity``, which ``analyze.label`` clusters by first: the first entity of the first kind in ``order`` that a
    text has, in lower case; null without any.  Each distinct text is decoded once and joined back."""
    found = spans(tagged(ledger, model, text))
    pick = F.coalesce(*[F.try_element_at(F.filter("entities", _is(kind)), F.lit(1))["entity"] for kind in order])
    known = found.select(F.col("text").alias(text), F.lower(pick).alias("entity")).where("entity is not null")
    return ledger.drop("entity").join(known, text, "left").select(*[c for c in ledger.columns if c != "entity"], "entity")


def _is(kind: str):
    return lambda e: e["kind"] == kind


def quality(wanted: DataFrame, model: Model) -> DataFrame:
    """(kind, n_wanted, n_found, n_right, precision, recall, f): whole entities of ``wanted`` (text, tokens, tags), one row a kind.

    A repeated text counts once; nothing found gives precision 0."""
    right = spans(wanted.dropDuplicates(["text"])).select("text", F.explode("entities").alias("e"), F.lit(1).alias("w"), F.lit(0).alias("g"))
    got = spans(tagged(wanted, model)).select("text", F.explode("entities").alias("e"), F.lit(0).alias("w"), F.lit(1).alias("g"))
    each = right.union(got).groupBy("text", "e").agg(F.max("w").alias("w"), F.max("g").alias("g"))
    per = each.groupBy(F.col("e.kind").alias("kind")).agg(F.sum("w").alias("n_wanted"), F.sum("g").alias("n_found"), F.sum(F.col("w") * F.col("g")).alias("n_right"))
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 4)).otherwise(F.lit(0.0))
    n = F.col("n_right")
    return per.select("kind", "n_wanted", "n_found", "n_right", ratio(n, F.col("n_found")).alias("precision"), ratio(n, F.col("n_wanted")).alias("recall"), ratio(2 * n, F.col("n_found") + F.col("n_wanted")).alias("f"))
