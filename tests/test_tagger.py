"""The tagger: decoding against all paths, training, held-out quality, odd rows."""

import datetime as dt
import itertools

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.operators import tagger as G
from ledgerline.plans import analyze as A
from ledgerline.plans import catalogue_entities as E

SF = "/root/testdata/sf0.01"


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 5), st.integers(1, 4), st.randoms(use_true_random=False))
def test_best_path_is_best_of_all(n, k, rng):
    draw = lambda *shape: np.array([rng.randint(-3, 3) for _ in range(int(np.prod(shape)))], float).reshape(shape)
    scores, pairs = draw(n, k), draw(k + 1, k)
    total = lambda p: scores[0, p[0]] + pairs[k, p[0]] + sum(pairs[a, b] + scores[i + 1, b] for i, (a, b) in enumerate(zip(p, p[1:])))
    got = G.best_path(scores, pairs)
    assert len(got) == n and total(got) == max(map(total, itertools.product(range(k), repeat=n)))
    assert G.best_path(scores[:0], pairs) == []


def test_average_is_that_of_a_plain_perceptron():
    """The lazily kept average equals the mean of the weights before each text."""
    texts = [(["pay", "acme"], [0, 1]), (["acme", "pay"], [1, 0]), (["to", "ann", "lee"], [0, 1, 1]), (["pay", "ann"], [0, 1])]
    start = G.Model(["O", "X"], np.zeros(64 * 2 + 6), 64)
    last, mean = G.trained(start, texts)
    now, seen = start.weights.copy(), []
    for words, right in texts:
        model = G.Model(start.tags, now, 64)
        got = [start.tags.index(t) for t in model.tag(words)]
        if got != right:
            for tags, sign in ((right, 1), (got, -1)):
                for p in G.places(G.features(words, 64), tags, 2, 64):
                    now[p] += sign
        seen.append(now.copy())
    assert np.allclose(last, now) and np.allclose(mean, np.mean(seen, axis=0))


def labelled(spark, rows):
    return spark.createDataFrame(rows, "text string, tokens array<string>, tags array<string>")


def test_odd_rows(spark):
    nothing = G.fit(labelled(spark, []))
    assert nothing.tags == ["O"] and nothing.tag(["a", "b"]) == ["O", "O"] and nothing.tag([]) == []
    rows = [("to ann", ["to", "ann"], ["O", "PERSON"]), (None, None, None), ("", [], []), ("x y", ["x", "y"], ["O"]), ("z", ["z"], [None]), ("to ann", ["to", "ann"], ["O", "PERSON"])]
    model = G.fit(labelled(spark, rows), rounds=2, shards=2)
    assert model.tags == ["O", "PERSON"] and model.tag(["to", "ann"]) == ["O", "PERSON"]
    long = "to ann " * 3000
    texts = spark.createDataFrame([("to ann",), ("to ann",), (None,), ("",), ("  ",), (long,)], "text string")
    got = {r.text: r for r in G.tagged(texts, model).collect()}
    assert set(got) == {"to ann", "", "  ", long} and got[""].tags == [] and len(got[long].tags) == 6000
    found = {r.text: r.entities for r in G.spans(G.tagged(texts.where(F.length("text") < 10), model)).collect()}
    assert [tuple(e) for e in found["to ann"]] == [("PERSON", "ann", 1, 1)] and found[""] == []
    assert G.tagged(texts.limit(0), model).count() == 0


def test_every_labelled_text_is_learned_from(spark):
    """More than the 50,000 rows that a fit once read: tags that only texts of the largest hashes have, and one behind many copies."""
    many = spark.range(50_100).select(F.array(F.concat(F.lit("k"), "id")).alias("tokens")).withColumn("h", F.xxhash64("tokens"))
    late = many.select("h").orderBy(F.desc("h")).limit(100).collect()[-1].h
    texts = many.select("tokens", F.array(F.when(F.col("h") >= late, "LATE").otherwise("O")).alias("tags"))
    assert texts.where("tags[0] = 'LATE'").count() == 100
    assert G.fit(texts, rounds=1).tags == ["LATE", "O"]
    low, high = sorted(["to ann", "at acme"], key=lambda t: spark.range(1).select(F.xxhash64(F.split(F.lit(t), " "))).first()[0])
    copies = spark.range(60_000).select(F.split(F.lit(low), " ").alias("tokens"), F.expr("array('O', 'LOW')").alias("tags"))
    model = G.fit(copies.union(spark.createDataFrame([(high.split(" "), ["O", "HIGH"])], copies.schema)))
    assert model.tags == ["HIGH", "LOW", "O"] and model.tag(low.split(" ")) == ["O", "LOW"]


def test_fit_is_the_mean_of_plain_shards(spark):
    """Shards grow in number with the distinct texts, and copies count as often as they stand there."""
    words, rows = ["pay", "ann", "lee", "acme", "to", "x9"], []
    for i in range(40):
        said = [words[(i * 7 + 3 * j) % 6] for j in range(1 + i % 4)]
        rows += [(" ".join(said), said, ["X" if (len(w) + i % 3) % 2 else "O" for w in said])] * (1 + i % 5)
    got = G.fit(labelled(spark, rows), rounds=2, shards=2, buckets=64, per_shard=4)
    hashed = {tuple(r.tokens): r.h for r in labelled(spark, rows).select("tokens", F.xxhash64("tokens").alias("h")).collect()}
    each = sorted((hashed[tuple(said)], said, tags) for _, said, tags in rows)
    n = -(-len({(h, *said, *tags) for h, said, tags in each}) // 4)
    weights = average = np.zeros(64 * 2 + 6)
    for _ in range(2):
        own = [G.trained(G.Model(["O", "X"], weights, 64), [(said, [int(t == "X") for t in tags]) for h, said, tags in each if h % n == k]) for k in range(n)]
        average = average + weights + sum(mean for _, mean in own) / n
        weights = weights + sum(last for last, _ in own) / n
    assert n > 2 and got.tags == ["O", "X"] and got.weights.any() and np.allclose(got.weights, average / 2, atol=1e-5)
    repeated, once = [(["pay", "ann"], [0, 1])] * 9 + [(["to"], [1])], [(["pay", "ann"], [0, 1], 9), (["to"], [1], 1)]
    start = G.Model(["O", "X"], np.zeros(64 * 2 + 6), 64)
    assert all(np.array_equal(a, b) for a, b in zip(G.trained(start, repeated), G.trained(start, once)))


def test_runs_become_entities(spark):
    rows = [("t", list("abcdef"), ["X", "X", "O", "X", "Y", "Y"])]
    assert [tuple(e) for e in G.spans(labelled(spark, rows)).first().entities] == [("X", "a b", 0, 2), ("X", "d", 3, 1), ("Y", "e f", 4, 2)]


def test_held_out_quality_and_saving(spark, tmp_path):
    rows = E.described(spark, SF).persist()
    held = rows.where("held_out")
    assert held.count() > 50 and held.join(rows.where("not held_out"), "text").count() == 0
    model = G.fit(rows.where("not held_out"))
    scores = {r.kind: r for r in G.quality(held, model).collect()}
    assert set(scores) == {"ORG", "PERSON"} and min(r.f for r in scores.values()) >= 0.9, scores
    # the fit does not depend on how rows are dealt, and a saved model gives the same tags
    again = G.fit(rows.where("not held_out").orderBy(F.desc("doc_id")).repartition(3))
    assert again.tags == model.tags and np.array_equal(again.weights, model.weights)
    model.save(spark, str(tmp_path / "model"))
    kept = G.Model.load(spark, str(tmp_path / "model"))
    assert kept.tags == model.tags and np.array_equal(kept.weights, model.weights)
    # entities lead the clusters of a ledger
    items = [("a", 1, dt.date(2024, 1, 1), "pos debit blue harbor 1234"), ("a", 2, dt.date(2024, 1, 2), "ach credit blue harbor llc 99"), ("a", 3, dt.date(2024, 1, 3), None), ("a", 4, dt.date(2024, 1, 4), "atm withdrawal 7 main branch")]
    ledger = spark.createDataFrame([(*x, 5.0, "DEBIT") for x in items], "account string, txn_id long, date date, description string, amount double, type string")
    got = {r.txn_id: r.entity for r in G.with_entities(ledger, model).collect()}
    assert got == {1: "blue harbor", 2: "blue harbor", 3: None, 4: None}
    clusters = {r.txn_id: r.cluster for r in A.label(G.with_entities(ledger, model)).collect()}
    assert clusters[1] == clusters[2] != clusters[4]
