"""Toxicity by weak supervision.

Voters are lexicons and patterns.  Lexicons are mined from labelled training
rows (words and word beginnings whose presence goes with the label, in tiers of
precision) or written by hand (insults, threats, contempt, obscenities);
patterns are shouting, exclamation marks, masked words and stretched words.  The
absence of any mined word votes too.  A generative label model estimates every
voter's accuracy and the voters' correlations by expectation-maximisation over
the vote patterns of the training rows (at most 2**voters counts) and gives each
pattern a posterior.  The labels start it and anchor the classes as
pseudo-counts; votes of unlabelled rows are left out, as they let the classes
drift to whatever else many rows share.  A logistic regression on the presence
of the mined features is trained on the posteriors, and its output is calibrated
on the labels.

The labelled rows that the fit reads are a bounded sample (``max_rows``, by hash
of the id); scores cover every row and whole texts.  Null and empty
texts get the score of a text without any feature.  Without labelled rows of
both classes the insults alone decide.  Repeated label rows of one id count
once, toxic if any says so.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import LOWER, U, Texts, mix, prefix_sums, rounds, signed, slices, words
from .store import bounded_batches, keep

#: Labelled rows that a fit reads at most, in expectation; features kept; rows that must show one.
MAX_ROWS, MAX_FEATURES, MIN_ROWS = 20_000, 2_048, 4
#: Likelihood-ratio statistic that a mined feature needs; many are tried, so it is far beyond 3.84.
MIN_GAIN = 15.0
THRESHOLD = 0.3
#: The hand-written lexicons; each is a voter.
LEXICON = "idiot moron stupid loser pathetic scum trash worthless disgusting clown dumb jerk fool creep liar vermin filth imbecile retard bastard".split()
THREATS = "kill die hurt beat punch choke stab shoot hang bleed suffer regret deserve destroy drown".split()
CONTEMPT = "hate despise loathe useless ugly coward hypocrite ignorant garbage rubbish brainless spineless sickening shameful ashamed".split()
OBSCENE = "shit crap bullshit ass asshole bitch fuck fucking fucker piss damn hell slut whore".split()
HAND = (LEXICON, THREATS, CONTEMPT, OBSCENE)
#: Voters beside the mined lexicons: the hand-written ones, four patterns and the absence of any mined word.
PATTERNS = 4
OTHERS = len(HAND) + PATTERNS + 1
BEGINNINGS = (4, 5, 6)
KINDS = 1 + len(BEGINNINGS)
TIERS = (0.95, 0.8, 0.5)
BREAKS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_TABLE_BITS = 20


def _features(texts: Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word index, hash) of whole words and then of beginnings of each length."""
    starts, ends, _ = words(texts, BREAKS)
    sums = prefix_sums(LOWER[texts.data])
    every = np.arange(len(starts))
    yield every, slices(sums, starts, ends)
    for kind, n in enumerate(BEGINNINGS, 1):
        long = every[ends - starts > n]
        yield long, mix(slices(sums, starts[long], starts[long] + n) ^ U(kind))


def _word_hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(slices(prefix_sums(raw), np.array([0]), np.array([len(raw)]))[0])


class Lookup:
    """Finds listed hashes in texts."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.table = np.zeros(1 << _TABLE_BITS, dtype=bool)
        self.table[(self.keys >> U(64 - _TABLE_BITS)).astype(np.int64)] = True

    def present(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, index of the listed hash) pairs."""
        first = words(texts, BREAKS)[2]
        pairs = []
        for word, hashes in _features(texts):
            near = np.flatnonzero(self.table[(hashes >> U(64 - _TABLE_BITS)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.keys, hashes[near]), max(len(self.keys) - 1, 0))
            hit = self.keys[at] == hashes[near] if len(self.keys) else np.zeros(0, bool)
            text = np.searchsorted(first, word[near[hit]], side="right") - 1
            pairs.append(text * max(len(self.keys), 1) + self.order[at[hit]])
        pairs = np.unique(np.concatenate(pairs))
        return pairs // max(len(self.keys), 1), pairs % max(len(self.keys), 1)


@dataclass
class Model:
    """Feature hashes with weights, and the calibrated intercept."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, U))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    intercept: float = -3.0
    #: voter accuracies and pairwise correlations given the class, for inspection
    accuracies: list[float] = field(default_factory=list)
    correlations: list[list[float]] = field(default_factory=list)


def hand_model() -> Model:
    return Model(np.array([_word_hash(w) for w in LEXICON], dtype=U), np.full(len(LEXICON), 6.0))


def mined(rows: DataFrame) -> DataFrame:
    """Rows (text, toxic) to (feature, kind, pos, neg): in how many rows of each class a feature stands."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b, texts in rounds(batch.column(0)):
                first = words(texts, BREAKS)[2]
                toxic = labels[a:b] == 1
                for kind, (word, hashes) in enumerate(_features(texts)):
                    text = np.searchsorted(first, word, side="right") - 1
                    order = np.lexsort((text, hashes))
                    hashes, text = hashes[order], text[order]
                    fresh = np.ones(len(hashes), dtype=bool)
                    fresh[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
                    hashes, text = hashes[fresh], text[fresh]
                    begin = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))) if len(hashes) else np.zeros(0, np.int64)
                    if not len(begin):
                        continue
                    pos = np.add.reduceat(toxic[text].astype(np.int64), begin)
                    total = np.diff(np.append(begin, len(hashes)))
                    yield pa.RecordBatch.from_arrays([pa.array(signed(hashes[begin])), pa.array(np.full(len(begin), kind, np.int32)), pa.array(pos), pa.array(total - pos)], ["feature", "kind", "pos", "neg"])

    counts = bounded_batches(rows.select("text", "toxic")).mapInArrow(of, "feature long, kind int, pos long, neg long")
    return counts.groupBy("feature", "kind").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _votes(texts: Texts, lookup: Lookup, mined_as: np.ndarray, hand_bits: np.ndarray, voters: np.ndarray, n_voters: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Votes of each text, one bit for each voter, and the (text, mined feature) pairs present.

    Voters of mined features come first, then the hand-written lexicons, shouting, exclamations, masked words,
    stretched words and, last, no mined feature at all.  ``lookup`` holds mined features and hand-written words;
    ``mined_as`` and ``hand_bits`` say what each of its keys is."""
    n, data = len(texts), texts.data
    text, found = lookup.present(texts)
    bits = np.zeros(n, dtype=np.int64)
    is_mined = mined_as[found] >= 0
    owner, feature = text[is_mined], mined_as[found[is_mined]]
    kind = voters[feature]
    np.bitwise_or.at(bits, owner, np.where(kind >= 0, np.int64(1) << np.maximum(kind, 0).astype(np.int64), 0))
    bits[bits == 0] |= 1 << (n_voters + OTHERS - 1)
    np.bitwise_or.at(bits, text, hand_bits[found] << n_voters)
    size = np.maximum(np.diff(texts.starts), 1)

    def count(marked: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(marked)))[texts.starts])

    low = LOWER[data]
    letter = (low >= 97) & (low <= 122)
    masked, stretched = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
    sign = np.isin(data, np.frombuffer(b"*#$", dtype=np.uint8))
    masked[1:-1] = letter[:-2] & sign[1:-1] & letter[2:]
    stretched[2:] = letter[2:] & (low[2:] != 119) & (low[2:] == low[1:-1]) & (low[2:] == low[:-2])
    patterns = (2 * count((data >= 65) & (data <= 90)) > size, 50 * count(data == 33) > size, count(masked) > 0, count(stretched) > 0)
    for k, says in enumerate(patterns):
        bits[says] |= 1 << (n_voters + len(HAND) + k)
    return bits, owner, feature


def _voting(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All keys that voters look for; which mined feature each is (or -1), and the hand-written lexicons it is in."""
    lists = [np.array([_word_hash(w) for w in words_], dtype=U) for words_ in HAND]
    every = np.unique(np.concatenate([keys, *lists]))
    mined_as = np.full(len(every), -1, dtype=np.int64)
    mined_as[np.searchsorted(every, keys)] = np.arange(len(keys))
    hand_bits = np.zeros(len(every), dtype=np.int64)
    for k, hashes in enumerate(lists):
        hand_bits[np.searchsorted(every, hashes)] |= 1 << k
    return every, mined_as, hand_bits


def votes_of(rows: DataFrame, keys: np.ndarray, voters: np.ndarray, n_voters: int) -> DataFrame:
    """Rows (text, toxic) to (votes, features, toxic), see ``_votes``."""
    every, mined_as, hand_bits = _voting(keys)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(every)
        for batch in batches:
            for a, b, texts in rounds(batch.column(0)):
                bits, text, feature = _votes(texts, lookup, mined_as, hand_bits, voters, n_voters)
                cuts = np.searchsorted(text, np.arange(b - a + 1))
                names = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(feature.astype(str).tolist(), pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(bits), names, batch.column(1).slice(a, b - a)], ["votes", "features", "toxic"])

    return bounded_batches(rows.select("text", "toxic")).mapInArrow(of, "votes long, features array<string>, toxic int")


def label_model(patterns: list[tuple[int, int, int]], n_voters: int, rounds_: int = 60):
    """Expectation-maximisation over (vote pattern, positive rows, negative rows) of the training labels.

    The labels, which may be wrong, start the voters' rates in either class and stay as pseudo-counts, so that the
    classes keep their meaning where votes go together for another reason (a hot source, copies); the
    posteriors come from the votes alone.  Voters are independent given the class up to pairwise
    correlation: a voter's evidence is divided by one plus the sum of its positive correlations with the
    others.  Returns each pattern's posterior, the voters' accuracies and their correlations.
    """
    code = np.array([p for p, _, _ in patterns], dtype=np.int64)
    by_label = np.array([[n for _, _, n in patterns], [p for _, p, _ in patterns]], dtype=float)
    n = by_label.sum(axis=0)
    votes = ((code[:, None] >> np.arange(n_voters)) & 1).astype(float)
    seen, size = by_label @ votes + 0.5, by_label.sum(axis=1) + 1
    rate, prior = seen / size[:, None], size[1] / size.sum()
    weight = np.ones(n_voters)
    corr = np.zeros((n_voters, n_voters))
    for step in range(rounds_):
        log = [np.log(p) + ((votes * np.log(rate[y]) + (1 - votes) * np.log(1 - rate[y])) * weight).sum(axis=1) for y, p in ((0, 1 - prior), (1, prior))]
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -40, 40)))
        for y, w in ((0, (1 - post) * n), (1, post * n)):
            rate[y] = (w @ votes + seen[y]) / (w.sum() + size[y])
        prior = float((post @ n + size[1]) / (n.sum() + size.sum()))
        if step % 10 == 9:
            pooled = np.zeros_like(corr)
            for y, w in ((0, (1 - post) * n), (1, post * n)):
                centred = votes - rate[y]
                pooled += (centred * w[:, None]).T @ centred
            scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
            corr = pooled / scale[:, None] / scale[None, :]
            weight = 1 / (1 + np.maximum(corr - np.eye(n_voters), 0).sum(axis=1))
    agrees = rate[1] * prior + (1 - rate[0]) * (1 - prior)
    accuracies = np.where(rate[1] >= rate[0], agrees, 1 - agrees)
    return post, accuracies.tolist(), corr.tolist()


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES) -> Model:
    """Learn from the labelled rows for which ``train`` (a condition on the id) holds."""
    wanted = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("id").isNotNull())
    wanted = wanted.withColumnRenamed("id", id_col).where(train).withColumnRenamed(id_col, "id").groupBy("id").agg(F.max("toxic").alias("toxic"))
    total = wanted.count()
    wanted = wanted.where(F.pmod(F.xxhash64("id"), F.lit(max(1, -(-total // max_rows)))) == 0)
    # about max_rows short rows: a bounded side
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(wanted), "id")
    rows = keep(rows.select("text", "toxic"), "toxicity-sample")
    classes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not classes.get(0) or not classes.get(1):
        return hand_model()
    pos, neg = classes[1], classes[0]
    p, q = (F.col("pos") + 0.5) / (pos + 1.0), (F.col("neg") + 0.5) / (neg + 1.0)
    odds = F.log(p / q)
    # likelihood-ratio statistic of presence and class; ties by feature
    share = (F.col("pos") + F.col("neg")) / (pos + neg)
    cell = lambda n, expected: F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)
    gain = 2 * (cell(F.col("pos"), share * pos) + cell(F.col("neg"), share * neg) + cell(pos - F.col("pos"), (1 - share) * pos) + cell(neg - F.col("neg"), (1 - share) * neg))
    wanted = (F.col("pos") + F.col("neg") >= MIN_ROWS) & (F.abs(odds) > 1) & (gain >= MIN_GAIN)
    best = mined(rows).where(wanted).select("feature", "kind", "pos", "neg", gain.alias("gain")).orderBy(F.desc("gain"), "feature").limit(max_features).collect()
    if not best:
        return hand_model()
    keys = np.array([r["feature"] for r in best], dtype=np.int64).view(U)
    precision = np.array([r["pos"] / (r["pos"] + r["neg"] * pos / neg + 0.1) for r in best])
    tier = np.searchsorted(-np.array(TIERS), -precision)
    voters = np.where(tier < len(TIERS), np.array([r["kind"] for r in best]) * len(TIERS) + tier, -1)
    n_lexicons = KINDS * len(TIERS)
    n_voters = n_lexicons + OTHERS
    seen = keep(votes_of(rows, keys, voters, n_lexicons), "toxicity-votes")
    patterns = [(r["votes"], r["pos"], r["neg"]) for r in seen.groupBy("votes").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")).orderBy("votes").collect()]
    post, accuracies, correlations = label_model(patterns, n_voters)
    table = docs.sparkSession.createDataFrame([(int(p[0]), float(x)) for p, x in zip(patterns, post)], "votes long, posterior double")
    soft = seen.join(F.broadcast(table), "votes")  # at most as many rows of two numbers as the sample has
    vectors = CountVectorizerModel.from_vocabulary([str(i) for i in range(len(keys))], "features", "vector", minTF=1.0, binary=True)
    both = soft.select("features", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("posterior").alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("posterior")).alias("weight")))).alias("x")).select("features", "x.*").where("weight > 0.001")
    classes = both.groupBy("label").count().count()
    if classes < 2:
        return hand_model()
    line = LogisticRegression(featuresCol="vector", weightCol="weight", regParam=1e-4, maxIter=40, standardization=False).fit(vectors.transform(both))
    weights, intercept = line.coefficients.toArray(), float(line.intercept)
    # calibration: one slope and intercept on the training labels
    scored = line.transform(vectors.transform(seen)).select(F.col("toxic").cast("double").alias("label"), "rawPrediction")
    scored = VectorAssembler(inputCols=["margin"], outputCol="x").transform(scored.select("label", F.greatest(F.lit(-20.0), F.least(F.lit(20.0), vector_to_array("rawPrediction")[1])).alias("margin")))
    platt = LogisticRegression(featuresCol="x", regParam=1e-3, maxIter=40, standardization=False).fit(scored)
    slope = max(float(platt.coefficients[0]), 0.05)
    return Model(keys, weights * slope, intercept * slope + float(platt.intercept), accuracies, correlations)


def _scores(model: Model, texts: Texts, lookup: Lookup) -> np.ndarray:
    text, feature = lookup.present(texts)
    margin = model.intercept + np.bincount(text, weights=model.weights[feature] if len(model.weights) else None, minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): the probability that a text is toxic."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(model.keys)
        for batch in batches:
            for a, b, texts in rounds(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(_scores(model, texts, lookup))], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return bounded_batches(rows).mapInArrow(of, "doc_id long, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """True for the ids whose labels no fit may read: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    model = fit(docs, labels, ~held_out(id_col), id_col, text_col)
    scored = score(docs, model, id_col, text_col)
    return scored.select(F.col("doc_id").alias(id_col), held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold; a pass over the rows, without a shuffle."""
    model = fit(docs, labels, ~held_out(id_col), id_col, text_col)
    at = docs.columns.index(text_col)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(model.keys)
        for batch in batches:
            for a, b, texts in rounds(batch.column(at)):
                yield batch.slice(a, b - a).filter(pa.array(_scores(model, texts, lookup) < threshold))

    return bounded_batches(docs).mapInArrow(of, docs.schema)
