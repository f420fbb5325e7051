"""Average linkage by joins against the small matrix, a busy account, and re-clustering."""

import collections
import random

import numpy as np

from ledgerline.operators import text_clusters as X


def plain(texts, cut):
    words = [t.split() for t in texts]
    index = {w: k for k, w in enumerate(sorted({w for t in words for w in t}))}
    counts = np.zeros((len(words), len(index)))
    for row, t in enumerate(words):
        for w in t:
            counts[row, index[w]] += 1
    return X.average_linkage(counts, cut)


def groups(pairs):
    out = collections.defaultdict(set)
    for text, cluster in pairs:
        out[cluster].add(text)
    return {frozenset(g) for g in out.values()}


def test_joins_against_the_matrix(spark):
    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)]
    accounts = {}
    for a in range(3):
        bases = [r.sample(vocabulary, 14) for _ in range(4)]
        texts = set()
        while len(texts) < 25:
            t = [w for w in r.choice(bases) for _ in range(r.choice([1, 1, 1, 2]))]
            for _ in range(r.randrange(5)):
                t[r.randrange(len(t))] = r.choice(vocabulary)
            texts.add(" ".join(t))
        accounts[f"a{a}"] = sorted(texts)
    frame = spark.createDataFrame([(a, t) for a, texts in accounts.items() for t in texts], "account string, text string")
    got = collections.defaultdict(list)
    for row in X.linked(frame, 0.3).collect():
        got[row.account].append((row.text, row.cluster))
    for a, texts in accounts.items():
        assert groups(got[a]) == groups(zip(texts, plain(texts, 0.3)))


def test_a_busy_account(spark):
    """Thousands of texts that share words: no task holds an account, and clusters are those that were planted."""
    n = 2_000
    rows = [("busy", f"payroll company{k % 50} branch{k % 50} office{k % 50} run{k}") for k in range(n)] + [("busy", f"solo{k} thing{k}") for k in range(500)] + [("busy", None), ("small", "a b"), ("small", "a b c")]
    got = X.text_clusters(spark.createDataFrame(rows, "account string, description string")).collect()
    busy = groups((x.text, x.cluster) for x in got if x.account == "busy")
    assert sorted(len(g) for g in busy) == [1] * 500 + [n // 50] * 50
    assert all(len({t.split()[1] for t in g}) == 1 for g in busy)
    assert len({x.cluster for x in got if x.account == "small"}) == 1


def test_reclustering(spark):
    schema = "account string, txn_id int, clean string, entity string, label string, cluster string"
    rows = [
        ("a", 1, "quick lend pay", None, "loan", "x"), ("a", 2, "quick lend fee", None, "loan", "y"), ("a", 3, "quick lend pay", "Lendco", "loan", "z"), ("a", 4, "rent", None, "other", "r"),
        ("a", 5, "acme pay", None, "payroll", "text_1"), ("a", 6, "acme pay", "Acme", "benefit", "who_1"), ("a", 7, "acme pay acme pay", None, "payroll", "text_7"), ("b", 8, "acme pay", None, "payroll", "text_1"), ("a", 9, None, None, "payroll", "text_none"),
    ]
    got = {r.txn_id: (r.label, r.cluster) for r in X.reclustered(spark.createDataFrame(rows, schema)).collect()}
    assert got[4] == ("other", "r") and got[8] == ("payroll", "text_1") and got[9] == ("payroll", "text_none")
    assert got[1][1] == got[3][1] and got[1][1].startswith("loan_who_") and got[2][1].startswith("loan_text_")
    assert got[5] == got[6] == got[7] == ("benefit", "who_1")


def test_entities_first(spark):
    rows = [("a", "card acme 1", "ACME"), ("a", "card acme 2", "acme"), ("a", "card acme 1", None), ("a", "gas", None), ("a", None, None)]
    got = {(r.clean, r.entity): r.cluster for r in X.entity_clusters(spark.createDataFrame(rows, "account string, clean string, entity string")).collect()}
    assert got["card acme 1", None] == got["card acme 1", "ACME"] == got["card acme 2", "acme"] and got["card acme 1", None].startswith("who_")
    assert got["gas", None].startswith("text_") and got[None, None] == "text_none"
