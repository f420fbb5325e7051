"""Additive attributions of tree models: exact Shapley values of a feature's part in a row's log-odds.

A leaf is reached if every feature on its path keeps to the path's range.  With a
set of features known, the others keep to it by the shares of training rows that
did at each split, so that a leaf's expected value is a product with one factor a
feature, and the Shapley values of a product come from a small polynomial.  A
model's values are the sums over its leaves.

The model goes to the tasks as a list of leaves, whose size is checked; rows
stream through Arrow batches, and all rows of a batch are treated at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Leaves of a model at most: it is sent to every task whole.
MAX_LEAVES = 200_000


@dataclass(frozen=True)
class Leaf:
    """A weighted leaf and, per feature of its path, the range (low, high] and the share of rows that keep to it."""

    value: float
    features: tuple[int, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    share: tuple[float, ...]


def _leaves(node, weight: float, path: dict[int, tuple[float, float, float]], out: list[Leaf]) -> None:
    """Leaves below a node of Spark's; ``path``: range and share by feature."""
    if node.subtreeDepth() == 0:
        features = tuple(sorted(path))
        low, high, share = zip(*(path[f] for f in features)) if features else ((), (), ())
        out.append(Leaf(weight * node.prediction(), features, low, high, share))
        return
    split = node.split()
    if not hasattr(split, "threshold") or split.getClass().getSimpleName() != "ContinuousSplit":
        raise ValueError("only splits at a threshold are supported")
    feature, at, total = split.featureIndex(), split.threshold(), node.impurityStats().count()
    low, high, share = path.get(feature, (-math.inf, math.inf, 1.0))
    for child, own in ((node.leftChild(), (low, min(high, at))), (node.rightChild(), (max(low, at), high))):
        kept = child.impurityStats().count() / total if total else 0.5
        _leaves(child, weight, path | {feature: (*own, share * kept)}, out)


def leaves(model: PipelineModel) -> list[Leaf]:
    """Leaves of the trees of a pipeline's last stage, in units of log-odds (a boosted classifier's margin counts twice)."""
    trees = model.stages[-1]
    weights = list(trees.treeWeights)
    out: list[Leaf] = []
    for weight, tree in zip(weights, trees.trees):
        _leaves(tree._java_obj.rootNode(), 2.0 * weight, {}, out)
        if len(out) > MAX_LEAVES:
            raise ValueError(f"more than {MAX_LEAVES} leaves")
    return out


def base_value(model: list[Leaf]) -> float:
    """The log-odds with no feature known."""
    return sum(x.value * math.prod(x.share) for x in model)


def margins(model: list[Leaf], rows: np.ndarray) -> np.ndarray:
    """The log-odds of rows."""
    out = np.zeros(len(rows))
    for x in model:
        out += x.value * _keeps(x, rows).all(axis=1)
    return out


def _keeps(leaf: Leaf, rows: np.ndarray) -> np.ndarray:
    """Whether each row keeps to the range of each feature of a path; what is not a number goes right."""
    values = rows[:, leaf.features]
    below = values <= np.array(leaf.high)
    above = ~(values <= np.array(leaf.low))
    return above & (below | (np.isnan(values) & np.isinf(leaf.high)))


def shapley(model: list[Leaf], rows: np.ndarray, n_features: int) -> np.ndarray:
    """Contribution of each feature (columns) to each row's log-odds."""
    out = np.zeros((len(rows), n_features))
    weights: dict[int, list[float]] = {}
    for leaf in model:
        m = len(leaf.features)
        if not m:
            continue
        if m not in weights:
            weights[m] = [math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) for k in range(m)]
        known = _keeps(leaf, rows).astype(float)
        for i, feature in enumerate(leaf.features):
            # coefficient k: sum over sets of k other known features of the product of factors
            poly = np.zeros((len(rows), m))
            poly[:, 0] = 1
            for j in range(m):
                if j != i:
                    poly[:, 1:] = poly[:, 1:] * leaf.share[j] + poly[:, :-1] * known[:, j : j + 1]
                    poly[:, 0] *= leaf.share[j]
            out[:, feature] += leaf.value * (known[:, i] - leaf.share[i]) * (poly @ np.array(weights[m]))
    return out


def contributions(model: PipelineModel, rows: DataFrame, features: list[str], key: str = "account") -> DataFrame:
    """(key, feature, contribution): together with ``base_value`` a row's contributions sum to its log-odds.

    Null features are not numbers.  Repeated rows are explained each."""
    own = leaves(model)
    kind = rows.schema[key].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.column_stack([batch.column(k + 1).to_numpy(zero_copy_only=False).astype(float) for k in range(len(features))])
            parts = shapley(own, values, len(features))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(parts), pa.list_(pa.float64()))], [key, "parts"])

    wide = rows.select(key, *[F.col(f).cast("double").alias(f) for f in features]).mapInArrow(of, f"`{key}` {kind}, parts array<double>")
    names = F.array(*[F.lit(f) for f in features])
    return wide.select(key, F.explode(F.arrays_zip(names.alias("feature"), F.col("parts").alias("contribution"))).alias("x")).select(key, "x.feature", "x.contribution")
