"""Connected components by alternating stars over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop_since, keep, mark

#: Edges up to which the minima of a round (two numbers a node) are broadcast; beyond, they are joined by a shuffle.
BROADCAST_EDGES = 250_000


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``edges`` (a, b: long) to rows (node, component), component being the smallest node reached.

    Each round links every node's larger neighbours, then its smaller ones, to the smallest
    neighbour; the edges end as stars, which a round leaves as they are.  The number of rounds grows with the logarithm of the
    longest chain.  Both steps are grouped minima and equi-joins; rounds, and minima that are too many to
    broadcast, are written to the shared folder, so that Spark can split the joins at nodes with very
    many edges, and deleted once the next round stands.  Nulls and loops are ignored; a node without an edge has no row.
    """
    spark = edges.sparkSession
    begin = mark()
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = keep(now, "edges")
    # edges are compared by count and by a sum of their hashes
    look = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    before = look(now)
    for turn in range(max_rounds):
        few = before[0] <= BROADCAST_EDGES
        ready = lambda least: F.broadcast(least) if few else keep(least, "least")  # noqa: B023, E731
        # large star: both directions; v > u goes to the smallest around u
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ready(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = keep(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b"), "edges")
        # small star: a > b; every smaller neighbour of a, and a itself, goes to the smallest
        least = ready(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        now = keep(small, f"stars{turn}")
        drop_since(spark, begin, f"stars{turn}")
        # a round that changes nothing leaves stars
        state = look(now)
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
