"""Aggregates and windows over an account's clusters (sources) of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("account", "cluster")
#: Clusters that have a frequency and patterns.
KNOWN = "account is not null and cluster is not null"


def same_day(ledger: DataFrame) -> DataFrame:
    """One row per account, cluster and day: pay days come from here."""
    return ledger.groupBy(*KEYS, "date").agg(F.sum("amount").alias("amount"), F.count("*").alias("n"))


def gaps(days: DataFrame) -> DataFrame:
    """Adds the days since the cluster's previous pay day."""
    return days.withColumn("gap", F.datediff("date", F.lag("date").over(Window.partitionBy(*KEYS).orderBy("date"))))


def interval_bin(gap: Column) -> Column:
    """Bins of pay intervals; a first pay day, without one, counts as 36+."""
    cuts = ((1, "1"), (5, "2-5"), (8, "6-8"), (12, "9-12"), (17, "13-17"), (24, "18-24"), (35, "24-35"))
    out = F.when(gap.isNull() | (gap <= 0), "36+")
    for top, name in cuts:
        out = out.when(gap <= top, name)
    return out.otherwise("36+")


def top_intervals(ledger: DataFrame, n: int = 2) -> DataFrame:
    """A cluster's most frequent interval bins with their shares; ties by bin name."""
    binned = gaps(same_day(ledger)).select(*KEYS, interval_bin(F.col("gap")).alias("bin"))
    counts = binned.groupBy(*KEYS, "bin").agg(F.count("*").alias("n"))
    group = Window.partitionBy(*KEYS)
    ranked = counts.select("*", F.row_number().over(group.orderBy(F.desc("n"), "bin")).alias("rank"), F.sum("n").over(group).alias("total"))
    return ranked.where(F.col("rank") <= n).select(*KEYS, "rank", "bin", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def amount_stats(ledger: DataFrame) -> DataFrame:
    days = same_day(ledger)
    r = lambda c: F.round(c, 6)
    return days.groupBy(*KEYS).agg(F.count("*").alias("n"), r(F.avg("amount")).alias("mean"), r(F.min("amount")).alias("low"), r(F.max("amount")).alias("high"), r(F.stddev_samp("amount")).alias("deviation"), r(F.min_by("amount", "date")).alias("first"), r(F.max_by("amount", "date")).alias("last"))


def amount_mode(ledger: DataFrame) -> DataFrame:
    """The most frequent amount and how often it stands; the smallest wins ties."""
    counts = ledger.groupBy(*KEYS, "amount").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("minus"), "amount"))
    return counts.groupBy(*KEYS).agg(best.alias("x")).select(*KEYS, F.col("x.amount").alias("mode"), (-F.col("x.minus")).alias("n"))


def mode_smallest_abs(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mode of an integer column, that of smallest absolute value first on ties, then the negative."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), F.abs(F.col(value)).alias("a"), F.col(value).alias("v")))["v"].alias("mode"))


def majority_label(ledger: DataFrame, label: str = "description") -> DataFrame:
    """A cluster's most frequent label, of its credits if it has any; ties by label."""
    counts = ledger.groupBy(*KEYS, "type", label).agg(F.count("*").alias("n"))
    best = F.min(F.struct(F.when(F.col("type") == "CREDIT", 0).otherwise(1).alias("side"), (-F.col("n")).alias("m"), F.col(label).alias("v")))
    return counts.groupBy(*KEYS).agg(best["v"].alias("label"))


def keyword_flags(ledger: DataFrame, families: dict[str, str], least: float = 0.5) -> DataFrame:
    """Whether at least that share of a cluster's descriptions matches each family."""
    return ledger.groupBy(*KEYS).agg(*[(F.avg(F.coalesce(F.col("description").rlike(p), F.lit(False)).cast("int")) >= least).cast("int").alias(name) for name, p in families.items()])


def unique_text(ledger: DataFrame) -> DataFrame:
    """An account's distinct descriptions, sorted and joined."""
    return ledger.groupBy("account").agg(F.array_join(F.array_sort(F.collect_set("description")), "|").alias("descriptions"))


def all_multiples(ledger: DataFrame, of: int = 5) -> DataFrame:
    return ledger.groupBy(*KEYS).agg(F.bool_and(F.floor("amount") % of == 0).cast("int").alias("all_multiples"))


def extent(ledger: DataFrame) -> DataFrame:
    """Rows with their account's first and last date and the cluster's size: partition values next to rows."""
    a, c = Window.partitionBy("account"), Window.partitionBy(*KEYS)
    return ledger.select("account", "txn_id", "cluster", F.min("date").over(a).alias("first_date"), F.max("date").over(a).alias("last_date"), F.count("*").over(c).alias("cluster_rows"), F.sum(F.when(F.col("type") == "CREDIT", 1).otherwise(0)).over(c).alias("cluster_credits"))


def triage(rows: DataFrame, label: str) -> DataFrame:
    """What each cluster needs: ``keep`` where all rows have a label, ``copy`` where some have (and the majority
    label), ``predict`` where none has."""
    known = rows.groupBy(*KEYS).agg(F.count("*").alias("n"), F.count(label).alias("labelled"))
    counts = rows.where(F.col(label).isNotNull()).groupBy(*KEYS, label).agg(F.count("*").alias("c"))
    major = counts.groupBy(*KEYS).agg(F.min(F.struct((-F.col("c")).alias("m"), F.col(label).alias("v")))["v"].alias("majority"))
    action = F.when(F.col("labelled") == F.col("n"), "keep").when(F.col("labelled") > 0, "copy").otherwise("predict")
    return known.join(major, list(KEYS), "left").select(*KEYS, action.alias("action"), "majority")


def next_pay(days: DataFrame, as_of) -> DataFrame:
    """Each pay day with the next one, the as-of date after the last."""
    w = Window.partitionBy(*KEYS).orderBy("date")
    return days.select(*KEYS, "date", F.coalesce(F.lead("date").over(w), F.lit(as_of)).alias("next_date"))


def islands(series: DataFrame, due: float, least_days: int = 3) -> DataFrame:
    """Stretches of days whose running net stays above ``due``; good ones last at least ``least_days``."""
    w = Window.partitionBy("account").orderBy("date")
    flagged = series.withColumn("enough", F.col("running") > due)
    grouped = flagged.withColumn("island", F.sum((~F.col("enough")).cast("int")).over(w)).where("enough")
    out = grouped.groupBy("account", "island").agg(F.min("date").alias("start"), F.count("*").alias("days"))
    return out.select("account", "start", "days", (F.col("days") >= least_days).cast("int").alias("good"))


def merge_doubled(ledger: DataFrame, text: str = "description", least: float = 0.5) -> DataFrame:
    """Clusters whose dominant text is another's said twice ("x x") take that one's name.

    Dominant: at least that share of the rows.  An equi-join on the doubled text, not a comparison of pairs.
    """
    counts = ledger.groupBy(*KEYS, text).agg(F.count("*").alias("n"))
    total = Window.partitionBy(*KEYS)
    ranked = counts.select("*", (F.col("n") / F.sum("n").over(total)).alias("share"), F.row_number().over(total.orderBy(F.desc("n"), text)).alias("rank"))
    top = ranked.where((F.col("rank") == 1) & (F.col("share") >= least)).select(*KEYS, F.col(text).alias("value"))
    single = top.select("account", F.concat_ws(" ", "value", "value").alias("value"), F.col("cluster").alias("merged")).groupBy("account", "value").agg(F.min("merged").alias("merged"))
    renamed = top.join(single, ["account", "value"]).select(*KEYS, "merged")
    return ledger.join(renamed, list(KEYS), "left").withColumn("cluster", F.coalesce("merged", "cluster")).drop("merged")
