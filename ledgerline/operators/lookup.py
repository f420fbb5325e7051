"""Knowledge-base lookups: prioritised multi-key joins, and label provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a dimension that may be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000


def small(dimension: DataFrame, bound: DataFrame | None = None) -> DataFrame:
    """The dimension with a broadcast hint if it is small by count; ``bound``: rows that are cheaper to count and at
    least as many."""
    counted = dimension if bound is None else bound
    return F.broadcast(dimension) if counted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else dimension


def prioritised(rows: DataFrame, base: DataFrame, shapes: list[list[str]], value: str = "label", shape_col: str = "shape") -> DataFrame:
    """The label of the first key shape that hits.

    ``base`` holds, for shape number k (from 0), rows with shape_col = k, the columns of shapes[k] and the
    label; each shape is one equi-join, and null never matches.  Adds ``value`` (null: no hit) and ``hit``, the shape.
    """
    found = []
    for k, shape in enumerate(shapes):
        side = base.where(F.col(shape_col) == k).groupBy(*shape).agg(F.min(value).alias(f"_hit{k}"))
        rows = rows.join(small(side), shape, "left")
        found.append(F.col(f"_hit{k}"))
    hit = F.coalesce(*[F.when(c.isNotNull(), k) for k, c in enumerate(found)])
    return rows.withColumns({value: F.coalesce(*found), "hit": hit}).drop(*[f"_hit{k}" for k in range(len(shapes))])


#: Key shapes of an entity knowledge base, the most telling first.
ENTITY_SHAPES = [["who", "why", "how"], ["who", "why"], ["why", "how"], ["why"], ["who", "how"], ["who"], ["how"]]


def entity_label(rows: DataFrame, base: DataFrame, undecided: str = "Undecided") -> DataFrame:
    """Adds ``label``: that of the first of ENTITY_SHAPES whose key (columns who, why, how) the base holds."""
    return prioritised(rows, base, ENTITY_SHAPES).withColumn("label", F.coalesce("label", F.lit(undecided)))


def cascade(*steps: tuple[str, Column]) -> tuple[Column, Column]:
    """First label of several sources in order, and the name of the source."""
    return F.coalesce(*[c for _, c in steps]), F.coalesce(*[F.when(c.isNotNull(), n) for n, c in steps])


def agent_override(rows: DataFrame, edits: DataFrame, label: str = "label") -> DataFrame:
    """Labels set by hand, per description of an account or for a whole cluster, win over all others.

    ``edits``: account, description or cluster (the other null), label."""
    by_text = small(edits.where("description is not null").groupBy("account", "description").agg(F.min("label").alias("_text")))
    by_cluster = small(edits.where("cluster is not null").groupBy("account", "cluster").agg(F.min("label").alias("_cluster")))
    joined = rows.join(by_text, ["account", "description"], "left").join(by_cluster, ["account", "cluster"], "left")
    return joined.withColumn(label, F.coalesce("_text", "_cluster", label)).drop("_text", "_cluster")
