"""Exact attributions against all subsets of features, and their sum against the model."""

import itertools
import math
import random

import numpy as np

from ledgerline.operators import attributions as A
from ledgerline.operators import scoring as S


def expected(node, row, known):
    """A tree's value with only ``known`` features, the others by the shares of training rows."""
    if node.subtreeDepth() == 0:
        return node.prediction()
    split = node.split()
    left, right = node.leftChild(), node.rightChild()
    if split.featureIndex() in known:
        return expected(left if row[split.featureIndex()] <= split.threshold() else right, row, known)
    a, b = left.impurityStats().count(), right.impurityStats().count()
    return (a * expected(left, row, known) + b * expected(right, row, known)) / (a + b)


def test_against_all_subsets(spark):
    r = random.Random(2)
    names = [f"f{k}" for k in range(5)]
    data = []
    for i in range(400):
        x = [r.gauss(0, 1) for _ in range(5)]
        data.append((f"a{i}", *[None if i % 50 == 3 and k == 2 else v for k, v in enumerate(x)], float(x[0] * x[1] + x[2] > r.gauss(0, 0.3))))
    rows = spark.createDataFrame(data, "account string, " + ", ".join(f"{n} double" for n in names) + ", label double").repartition(3)
    model = S.fit_trees(rows.na.drop(), names, "label", trees=4, depth=4)
    some = rows.orderBy("account").limit(12)
    got = {}
    for x in A.contributions(model, some, names).collect():
        got.setdefault(x.account, {})[x.feature] = x.contribution
    base = A.base_value(A.leaves(model))
    scored = {x.account: x.p for x in S.predict(model, some).collect()}
    trees, weights = [t._java_obj.rootNode() for t in model.stages[-1].trees], list(model.stages[-1].treeWeights)
    for x in some.collect():
        row = [math.nan if x[n] is None else x[n] for n in names]
        value = {known: 2 * sum(w * expected(t, row, known) for w, t in zip(weights, trees)) for k in range(6) for known in itertools.combinations(range(5), k)}
        for i, name in enumerate(names):
            want = 0.0
            for known in value:
                if i not in known:
                    k = len(known)
                    want += math.factorial(k) * math.factorial(4 - k) / math.factorial(5) * (value[tuple(sorted((*known, i)))] - value[known])
            assert abs(got[x.account][name] - want) < 1e-9
        p = scored[x.account]
        assert abs(base + sum(got[x.account].values()) - math.log(p / (1 - p))) < 1e-6
    assert A.contributions(model, rows.limit(0), names).count() == 0
    flat = np.array([[0.0] * 5])
    assert abs(A.margins(A.leaves(model), flat)[0] - base - A.shapley(A.leaves(model), flat, 5).sum()) < 1e-9
