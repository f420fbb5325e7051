"""Clusters of an account's texts: average linkage by cosine distance of word counts, cut at a distance.

Only the distinct texts of an account are compared.  An account of at most
``IN_TASK`` of them is a small matrix in one task.  Larger ones are clustered by
joins (``linked``), in rounds in which all pairs of clusters merge that are each
other's nearest, and all clusters that are equally near to each other and nearer
to none: for average linkage this gives the tree that merging the nearest pair
one by one gives, and a cluster without a neighbour within the cut is done for
good.  Nothing there is of the size of an account squared:

* the mean similarity of two clusters is the product of their mean unit vectors,
  so that a cluster is its mean vector;
* two vectors within the cut share one of the words that, in order from rare to
  common, stand before the rest of the vector has a norm below the needed
  similarity; only these words are joined, and only where the rests' norms can
  reach it;
* clusters whose vectors are equal from a shared word on are equally near to each
  other through it, so that each takes one partner of them and one of each other
  kind of rest, never all.

Ties are broken by a hash.  Null texts are in no cluster; a text without words is
one of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut as cut_lineage

DISTANCE = 0.3
#: The looser cut of loans.
LOAN_DISTANCE = 0.5
#: Distinct texts of an account up to which one task compares them.
IN_TASK = 1_000
#: Mean number of equal clusters among which one takes its partner.
_PEERS = 4


def average_linkage(vectors: np.ndarray, cut: float) -> np.ndarray:
    """Cluster numbers (by first member) from merging the nearest pair until it is farther than ``cut``."""
    n = len(vectors)
    norm = np.linalg.norm(vectors, axis=1)
    unit = vectors / np.where(norm == 0, 1, norm)[:, None]
    distance = 1 - unit @ unit.T
    np.fill_diagonal(distance, np.inf)
    size, member = np.ones(n), np.arange(n)
    while n > 1:
        i, j = divmod(int(distance.argmin()), n)
        if not distance[i, j] <= cut:
            break
        i, j = min(i, j), max(i, j)
        merged = (distance[i] * size[i] + distance[j] * size[j]) / (size[i] + size[j])
        distance[i], distance[:, i] = merged, merged
        distance[i, i] = np.inf
        distance[j], distance[:, j] = np.inf, np.inf
        size[i] += size[j]
        member[member == j] = i
    return np.unique(member, return_inverse=True)[1]


def _in_task(texts: DataFrame, cut: float) -> DataFrame:
    def of(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("text")
        words = [t.split() for t in group["text"]]
        index = {w: k for k, w in enumerate(sorted({w for t in words for w in t}))}
        counts = np.zeros((len(words), max(len(index), 1)))
        for row, t in enumerate(words):
            for w in t:
                counts[row, index[w]] += 1
        group["cluster"] = [f"text_{c}" for c in average_linkage(counts, cut)]
        return group

    return texts.groupBy("account").applyInPandas(of, "account string, text string, cluster string")


def _vectors(texts: DataFrame) -> DataFrame:
    """(account, c, size, word, m): each text as a unit vector, a cluster of its own."""
    words = texts.select("account", "c", F.explode(F.filter(F.split("text", "\\s+"), lambda w: w != "")).alias("word")).groupBy("account", "c", "word").agg(F.count("*").alias("n"))
    return words.select("account", "c", F.lit(1).cast("long").alias("size"), "word", (F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("account", "c")))).alias("m"))


def _partners(vectors: DataFrame, least: float, turn: int) -> tuple[DataFrame, DataFrame]:
    """(account, a, b): pairs among which every cluster has one of its nearest, if any is within the cut; and
    (account, c, word, kind, first, alike): the clusters that are ``alike`` near to each other from a word on."""
    often = vectors.groupBy("account", "word").agg(F.count("*").alias("often")).where("often > 1")
    rare_last = Window.partitionBy("account", "c").orderBy(F.desc("often"), F.desc("word")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = vectors.join(often, ["account", "word"]).select("account", "c", "word", F.sqrt(F.sum(F.col("m") * F.col("m")).over(rare_last)).alias("r"), F.bit_xor(F.xxhash64("word", "m")).over(rare_last).alias("kind"))
    able = cut_lineage(rest.where(F.col("r") >= least - 1e-9))
    mixed = lambda c: F.xxhash64(c, F.lit(turn))
    kinds = able.groupBy("account", "word", "kind").agg(F.min("r").alias("q"), F.min("c").alias("first"), F.max("c").alias("last"), F.count("*").alias("n"), F.min_by("c", mixed(F.col("c"))).alias("one"))
    kinds = cut_lineage(kinds)
    # within a kind: the smallest, or for that the largest, of some few
    alike = able.join(kinds.where((F.col("n") > 1) & (F.col("q") * F.col("q") >= least - 1e-9)), ["account", "word", "kind"]).withColumn("few", F.pmod(mixed(F.col("c")), F.greatest(F.lit(1), F.floor(F.col("n") / _PEERS))))
    alike = cut_lineage(alike.select("account", "word", "kind", "c", "few", "first", "last", F.round(F.col("q") * F.col("q"), 9).alias("alike")))
    few = alike.groupBy("account", "word", "kind", "few").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    other = F.when(F.col("c") != F.col("low"), F.col("low")).when(F.col("low") != F.col("high"), F.col("high")).when(F.col("c") != F.col("first"), F.col("first")).otherwise(F.col("last"))
    within = alike.join(few, ["account", "word", "kind", "few"]).select("account", "c", other.alias("d"))
    # between kinds: one of each other kind
    apart = kinds.select("account", "word", F.col("kind").alias("_kind"), "q", F.col("one").alias("d"))
    between = able.join(apart, ["account", "word"]).where((F.col("kind") != F.col("_kind")) & (F.col("r") * F.col("q") >= least - 1e-9)).select("account", "c", "d")
    return within.union(between).select("account", F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).where("a <> b").distinct(), alike


def _nearest(vectors: DataFrame, pairs: DataFrame, least: float, turn: int) -> DataFrame:
    """(account, c, near, likeness): the nearest partner of each cluster that has one within the cut."""
    length = vectors.groupBy("account", "c").agg(F.count("*").alias("n"))
    at = lambda c, n: length.select("account", F.col("c").alias(c), F.col("n").alias(n))
    # from the shorter vector's words to the longer one's
    sided = pairs.join(at("a", "na"), ["account", "a"]).join(at("b", "nb"), ["account", "b"])
    swap = F.col("na") > F.col("nb")
    sided = sided.select("account", F.when(swap, F.col("b")).otherwise(F.col("a")).alias("s"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("l"))
    side = lambda c, m: vectors.select("account", F.col("c").alias(c), "word", F.col("m").alias(m))
    shared = sided.join(side("s", "x"), ["account", "s"]).join(side("l", "y"), ["account", "l", "word"])
    near = shared.groupBy("account", "s", "l").agg(F.round(F.sum(F.col("x") * F.col("y")), 9).alias("likeness")).where(F.col("likeness") >= least - 1e-9)
    both = near.select("account", "likeness", F.xxhash64(F.least("s", "l"), F.greatest("s", "l"), F.lit(turn)).alias("tie"), F.explode(F.array(F.struct(F.col("s").alias("c"), F.col("l").alias("d")), F.struct(F.col("l").alias("c"), F.col("s").alias("d")))).alias("x"))
    return both.groupBy("account", "x.c").agg(F.min(F.struct((-F.col("likeness")).alias("far"), "tie", F.col("x.d").alias("d"))).alias("x")).select("account", "c", F.col("x.d").alias("near"), (-F.col("x.far")).alias("likeness"))


def _merges(near: DataFrame, alike: DataFrame) -> DataFrame:
    """(account, c, into): what merges in this round."""
    tied = near.join(alike, ["account", "c"]).where(F.col("likeness") == F.col("alike"))
    one = tied.groupBy("account", "c").agg(F.min(F.struct("first", "word", "kind")).alias("group"))
    groups = one.groupBy("account", "group").agg(F.min("c").alias("into"), F.count("*").alias("n")).where("n > 1")
    joint = cut_lineage(one.join(groups, ["account", "group"]).select("account", "c", "into"))
    free = near.join(joint.select("account", "c"), ["account", "c"], "left_anti").select("account", "c", "near")
    back = free.select("account", F.col("c").alias("near"), F.col("near").alias("_c"))
    return joint.where("c <> into").union(free.join(back, ["account", "near"]).where("c = _c and c < near").select("account", F.col("near").alias("c"), F.col("c").alias("into")))


def linked(texts: DataFrame, cut: float = DISTANCE) -> DataFrame:
    """(account, text, cluster) of distinct texts, by joins alone; clusters are named after their smallest member's hash."""
    named = texts.select("account", "text", F.xxhash64("text").alias("c"))
    members = cut_lineage(named)
    vectors = cut_lineage(_vectors(named))
    least, turn = 1 - cut, 0
    while True:
        pairs, alike = _partners(vectors, least, turn)
        near = cut_lineage(_nearest(vectors, pairs, least, turn))
        merges = cut_lineage(_merges(near, alike))
        if merges.isEmpty():
            break
        now = F.coalesce("into", "c")
        members = cut_lineage(members.join(merges, ["account", "c"], "left").select("account", "text", now.alias("c")))
        live = vectors.join(near.select("account", "c"), ["account", "c"], "left_semi").join(merges, ["account", "c"], "left").withColumn("to", now)
        sizes = live.select("account", "to", "c", "size").distinct().groupBy("account", "to").agg(F.sum("size").alias("total"))
        sums = live.groupBy("account", "to", "word").agg(F.sum(F.col("size") * F.col("m")).alias("s"))
        vectors = cut_lineage(sums.join(sizes, ["account", "to"]).select("account", F.col("to").alias("c"), F.col("total").alias("size"), "word", (F.col("s") / F.col("total")).alias("m")))
        turn += 1
    return members.select("account", "text", F.concat(F.lit("text_"), F.lower(F.hex("c"))).alias("cluster"))


def text_clusters(ledger: DataFrame, text: str = "description", cut: float = DISTANCE, in_task: int = IN_TASK) -> DataFrame:
    """(account, text, cluster): one row per distinct text of an account."""
    distinct = ledger.select(F.col("account").cast("string").alias("account"), F.col(text).alias("text")).where("text is not null").distinct()
    busy = cut_lineage(distinct.groupBy("account").agg(F.count("*").alias("n")).where(F.col("n") > in_task).select("account"))
    if busy.isEmpty():
        return _in_task(distinct, cut)
    few = distinct.join(busy, "account", "left_anti")
    return _in_task(few, cut).unionByName(linked(distinct.join(busy, "account", "left_semi"), cut))


def _best(cluster: Column) -> Column:
    """Order among the clusters of one text: entities before texts, then by name."""
    return F.struct(F.when(cluster.startswith("who_"), 0).otherwise(1).alias("k"), cluster.alias("cluster"))


def one_cluster_per(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that agree in ``keys`` take the best cluster among them."""
    best = rows.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(F.min(_best(F.col("cluster")))["cluster"].alias("_best"))
    return rows.join(best, keys, "left").withColumn("cluster", F.coalesce("_best", "cluster")).drop("_best")


def entity_clusters(rows: DataFrame, cut: float = DISTANCE) -> DataFrame:
    """Adds ``cluster``: rows with an entity by clusters of the account's entities, the others by those of their texts;
    then rows of one text take the best of their clusters.

    ``rows``: account, clean, entity (null: none).  Rows without text and entity are in ``text_none``."""
    who = text_clusters(rows.where("entity is not null").withColumn("_who", F.lower("entity")), "_who", cut).select("account", F.col("text").alias("_who"), F.regexp_replace("cluster", "^text_", "who_").alias("_w"))
    said = text_clusters(rows.where("entity is null"), "clean", cut).select("account", F.col("text").alias("clean"), F.col("cluster").alias("_t"))
    out = rows.withColumn("_who", F.lower("entity")).join(who, ["account", "_who"], "left").join(said, ["account", "clean"], "left")
    out = out.withColumn("cluster", F.coalesce(F.when(F.col("entity").isNotNull(), F.col("_w")), F.when(F.col("entity").isNull(), F.col("_t")), F.lit("text_none"))).drop("_who", "_w", "_t")
    return one_cluster_per(out, ["account", "clean"])


def reclustered_loans(rows: DataFrame, cut: float = LOAN_DISTANCE) -> DataFrame:
    """Rows labelled as loans in clusters of their own, at a looser cut; all others as they are.

    ``rows``: account, clean, entity, label, cluster."""
    loan = F.coalesce(F.col("label") == "loan", F.lit(False))
    new = entity_clusters(rows.where(loan).drop("cluster"), cut).withColumn("cluster", F.concat(F.lit("loan_"), "cluster"))
    return rows.where(~loan).unionByName(new.select(*rows.columns))


def merged_payroll(rows: DataFrame) -> DataFrame:
    """Payroll and benefit rows of one text in one cluster, clusters that differ by a doubled text in one, and all
    of a cluster that holds both labels as benefit; all other rows as they are.

    ``rows``: account, clean, entity, label, cluster."""
    paid = F.coalesce(F.col("label").isin("payroll", "benefit"), F.lit(False))
    own = one_cluster_per(rows.where(paid), ["account", "clean"])
    for name in ("clean", "entity"):
        # "abc abc" goes with "abc"
        words = F.filter(F.split(name, "\\s+"), lambda w: w != "")
        half = F.size(words) / 2
        doubled = (F.size(words) % 2 == 0) & (F.size(words) > 0) & (F.slice(words, F.lit(1), half.cast("int")) == F.slice(words, half.cast("int") + 1, half.cast("int")))
        own = one_cluster_per(own.withColumn("_once", F.when(doubled, F.array_join(F.slice(words, F.lit(1), half.cast("int")), " ")).otherwise(F.col(name))), ["account", "_once"]).drop("_once")
    both = own.groupBy("account", "cluster").agg((F.count_distinct("label") > 1).alias("_both"))
    own = own.join(both, ["account", "cluster"]).withColumn("label", F.when(F.col("_both"), "benefit").otherwise(F.col("label"))).drop("_both")
    return rows.where(~paid).unionByName(own.select(*rows.columns))


def reclustered(rows: DataFrame) -> DataFrame:
    """Labelled rows after both: loans at a looser cut, payroll and benefits merged."""
    return merged_payroll(reclustered_loans(rows))
