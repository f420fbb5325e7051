"""Regular pay days: which day of the month, weekday or pair of days explains a cluster's pay days.

A pay day may stand for another, intended day: itself, or a free day that the
bank moved to the business day before or after.  ``payable`` lists, for each
calendar day, the days it may stand for; every pattern is then a property of
the intended day, and its support a grouped count.  One join with a small
calendar serves all patterns of all clusters.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .calendar import DAYS, is_last_weekday, week_of_month
from .clusters import KEYS, KNOWN

#: Share of pay days that a pattern, and a tendency, must explain; days around a target; days between two pay days of a month.
LEAST, LEAST_TENDENCY, AROUND, APART = 0.6, 0.8, 3, 7
MONTHLY = ("day", "last_day", "last_weekday", "kth_weekday")
WEEKDAY = len(MONTHLY)


def payable(calendar: DataFrame) -> DataFrame:
    """(date, intended, how): the days that a pay day may stand for; how is 0 for itself, 1 after and 2 before a free day."""
    same = calendar.select("date", F.col("date").alias("intended"), F.lit(0).alias("how"))
    free = calendar.where(~F.col("is_business_day"))
    after = free.select(F.col("next_bd").alias("date"), F.col("date").alias("intended"), F.lit(1).alias("how"))
    before = free.select(F.col("previous_bd").alias("date"), F.col("date").alias("intended"), F.lit(2).alias("how"))
    return same.union(after).union(before).where("date is not null")


def intended_days(days: DataFrame, calendar: DataFrame) -> DataFrame:
    """Pay days (account, cluster, date) with all days they may stand for; a day of the calendar has a handful at most."""
    return days.select(*KEYS, "date").distinct().join(F.broadcast(payable(calendar)), "date").withColumn("same_month", F.trunc("intended", "MM") == F.trunc("date", "MM"))


def direction(after: Column, before: Column) -> Column:
    """A: free days are moved ahead (also on ties), B: back, null: never."""
    return F.when(after + before > 0, F.when(after >= before, "A").otherwise("B"))


def pattern_support(rows: DataFrame, kinds: Iterable[int] = range(WEEKDAY + 1)) -> DataFrame:
    """Best candidate of each of the pattern ``kinds`` per cluster: kind, a, b, raw, after, before, n, score, direction.

    kind indexes MONTHLY (a, b: day; none; weekday; weekday and week) or is WEEKDAY (a).  Candidates are the most
    frequent values as paid; of those the one that explains most wins, the earliest paid on ties.  The last day of
    the month is always a candidate.
    """
    kinds = sorted(set(kinds))
    t, same = F.col("intended"), F.col("same_month")
    early = week_of_month(F.col("date")) <= 4
    kind = lambda k, on, a, b=F.lit(0): F.when(on, F.struct(F.lit(k).alias("kind"), a.cast("int").alias("a"), b.cast("int").alias("b")))
    every = [
        kind(0, F.lit(True), F.dayofmonth(t)), kind(1, t == F.last_day(t), F.lit(0)), kind(2, same & is_last_weekday(t), F.weekday(t)),
        kind(3, same & early & (week_of_month(t) <= 4), F.weekday(t), week_of_month(t)), kind(WEEKDAY, F.abs(F.datediff(t, "date")) < 7, F.weekday(t)),
    ]
    found = F.array_compact(F.array(*[every[k] for k in sorted({0, *kinds})]))  # kind 0 counts the pay days
    long = rows.where(KNOWN).select(*KEYS, "date", "how", F.explode(found).alias("x")).select(*KEYS, "date", "how", "x.*")
    counts = long.groupBy(*KEYS, "kind", "a", "b").agg(F.count_if(F.col("how") == 0).alias("raw"), F.count_if(F.col("how") == 1).alias("after"), F.count_if(F.col("how") == 2).alias("before"), F.min(F.when(F.col("how") == 0, F.col("date"))).alias("first"))
    group, cluster = Window.partitionBy(*KEYS, "kind"), Window.partitionBy(*KEYS)
    # each pay day as paid is one of kind 0, and one of kind 3 unless it is late in the month
    n = F.when(F.col("kind") == 3, F.sum("raw").over(group)).otherwise(F.sum(F.when(F.col("kind") == 0, F.col("raw"))).over(cluster))
    top = counts.select("*", F.max("raw").over(group).alias("most"), n.alias("n")).where((F.col("raw") == F.col("most")) & (F.col("raw") > 0) | (F.col("kind") == 1))
    scored = top.where((F.col("n") >= 2) & F.col("kind").isin(kinds)).withColumn("score", (F.col("raw") + F.col("after") + F.col("before")) / F.col("n"))
    best = scored.groupBy(*KEYS, "kind").agg(F.min(F.struct((-F.col("score")).alias("m"), "first", "a", "b", "raw", "after", "before", "n", "score")).alias("x"))
    return best.select(*KEYS, "kind", "x.a", "x.b", "x.raw", "x.after", "x.before", "x.n", "x.score", direction(F.col("x.after"), F.col("x.before")).alias("direction"))


def tendencies(days: DataFrame) -> DataFrame:
    """Per cluster the looser habits: end_share (pay days at most three days from a month's end) and the target day
    near which most pay days are (target, near_share; the smallest day on ties)."""
    day, last = F.dayofmonth("date"), F.dayofmonth(F.last_day("date"))
    rows = days.select(*KEYS, "date").distinct()
    off = F.when(day <= 7, day).otherwise(last - day)
    # target 0 stands for the pay day itself
    near = F.array_append(F.sequence(F.greatest(day - AROUND, F.lit(1)), F.least(day + AROUND, last)), F.lit(0))
    long = rows.where(KNOWN).select(*KEYS, (off <= AROUND).alias("end"), F.explode(F.coalesce(near, F.array(F.lit(0)))).alias("target"))
    counts = long.groupBy(*KEYS, "target").agg(F.count("*").alias("c"), F.count("end").alias("known"), F.count_if("end").alias("ends"))
    own, c = F.col("target") == 0, F.col("c")
    # a count and its target in one number, the larger the more frequent and then the smaller the target
    per = counts.groupBy(*KEYS).agg(F.sum(F.when(own, c)).alias("n"), F.try_divide(F.sum(F.when(own, F.col("ends"))), F.sum(F.when(own, F.col("known")))).alias("end_share"), F.max(F.when(~own, c * 32 + 31 - F.col("target"))).alias("top"))
    top = F.col("top")
    return per.where("n >= 2 and top is not null").select(*KEYS, "n", "end_share", (31 - top % 32).cast("int").alias("target"), (F.shiftright(top, 5) / F.col("n")).alias("near_share"))


def monthly_pattern(support: DataFrame, tendency: DataFrame) -> DataFrame:
    """One row per cluster with a monthly habit: pattern, day, weekday, week, score and direction.

    The pattern that explains most of at least LEAST wins, on ties the later of MONTHLY; without one the stronger
    tendency of at least LEAST_TENDENCY, "end_of_month" on ties with "near_day"."""
    good = support.where((F.col("kind") < WEEKDAY) & (F.col("score") >= LEAST))
    best = good.groupBy(*KEYS).agg(F.max(F.struct("score", "kind", "a", "b", "direction")).alias("x"))
    every = tendency.join(best, list(KEYS), "full_outer")
    loose = F.when((F.col("end_share") >= LEAST_TENDENCY) & (F.col("end_share") >= F.col("near_share")), "end_of_month").when(F.col("near_share") >= LEAST_TENDENCY, "near_day")
    name = F.get(F.array(*[F.lit(m) for m in MONTHLY]), F.col("x.kind"))
    pattern = F.coalesce(name, loose)
    rows = every.withColumn("pattern", pattern).where("pattern is not null")
    day = F.when(F.col("pattern") == "day", F.col("x.a")).when(F.col("pattern") == "near_day", F.col("target"))
    weekday = F.when(F.col("pattern").isin("last_weekday", "kth_weekday"), F.col("x.a"))
    week = F.when(F.col("pattern") == "kth_weekday", F.col("x.b"))
    score = F.coalesce(F.col("x.score"), F.when(F.col("pattern") == "end_of_month", F.col("end_share")).otherwise(F.col("near_share")))
    return rows.select(*KEYS, "pattern", day.alias("day"), weekday.alias("weekday"), week.alias("week"), F.round(score, 6).alias("score"), F.col("x.direction").alias("direction"))


def candidate_days(days: DataFrame, calendar: DataFrame) -> DataFrame:
    """(account, cluster, day, before_last): days of the month that pay days fall on and, of clusters with up to three
    pay days, free days at most two days off; before_last: those that may go with the last day of the month."""
    rows = days.select(*KEYS, "date").distinct()
    counted = rows.withColumn("n", F.count("*").over(Window.partitionBy(*KEYS)))
    off = counted.where("n <= 3").select(*KEYS, "date", F.explode(F.array(*[F.date_add("date", k) for k in (-2, -1, 1, 2)])).alias("other"))
    free = F.broadcast(calendar.where(~F.col("is_business_day")).select(F.col("date").alias("other")))
    moved = off.join(free, "other").where(F.trunc("other", "MM") == F.trunc("date", "MM"))
    moved = moved.select(*KEYS, F.dayofmonth("other").alias("day"), ((F.dayofmonth("date") < 28) & (F.dayofmonth("other") <= 23)).alias("before_last"))
    own = rows.select(*KEYS, F.dayofmonth("date").alias("day"), (F.dayofmonth("date") <= 23).alias("before_last"))
    return own.union(moved).groupBy(*KEYS, "day").agg(F.bool_or("before_last").alias("before_last"))


def shared_days(calendar: DataFrame) -> DataFrame:
    """(date, day, day2, how): pay days that may stand for two days of a pair at once, with the how of the second (day2 is 0
    for the last day of the month); they come of free days in a row, so there are few."""
    days = payable(calendar).where(F.trunc("intended", "MM") == F.trunc("date", "MM"))
    both = days.select("date", F.dayofmonth("intended").alias("day")).join(days, "date").withColumn("day2", F.dayofmonth("intended"))
    two = both.where(F.col("day2") - F.col("day") >= APART).select("date", "day", "day2", "how")
    last = both.where((F.col("intended") == F.last_day("intended")) & (F.col("day") < F.col("day2"))).select("date", "day", F.lit(0).alias("day2"), "how")
    return two.union(last)


def semi_monthly_support(rows: DataFrame, candidates: DataFrame, calendar: DataFrame) -> DataFrame:
    """Best pair of each kind per cluster: two_days (day1, day2 at least a week apart) and day_and_last (day1 with the
    last day of the month); matched, after, before, n, score, direction.

    A pay day that both days explain counts for the first.  Pairs are of the at most 31 days of a month, whose counts
    (days), with those of pay days that two of them share (shared), are brought together in one row a cluster."""
    same = rows.where("same_month").where(KNOWN)
    hows = [F.count("how").alias("m"), F.count_if(F.col("how") == 1).alias("after"), F.count_if(F.col("how") == 2).alias("before")]
    none, nobody = F.lit(-1), F.lit(None).cast("boolean")
    found = same.select(*KEYS, F.explode(F.array_compact(F.array(F.dayofmonth("intended"), F.when(F.col("intended") == F.last_day("intended"), 0)))).alias("day"), none.alias("day2"), "how", nobody.alias("before_last"))
    twice = same.where("how = 0").join(F.broadcast(shared_days(calendar).withColumnRenamed("how", "how2")), "date").select(*KEYS, "day", "day2", F.col("how2").alias("how"), nobody.alias("before_last"))
    tried = candidates.where(KNOWN).select(*KEYS, "day", none.alias("day2"), F.lit(None).cast("int").alias("how"), "before_last")
    counts = found.union(twice).union(tried).groupBy(*KEYS, "day", "day2").agg(*hows, F.bool_or("before_last").alias("before_last"))
    one = F.col("day2") == -1
    entry = F.struct("day", "day2", "m", "after", "before", "before_last")
    of = lambda on: F.collect_list(F.when(on, entry))
    paid = F.when(one & (F.col("day") > 0), F.col("m") - F.col("after") - F.col("before"))
    per = counts.groupBy(*KEYS).agg(of(F.col("before_last").isNotNull()).alias("days"), of(one & (F.col("day") == 0)).alias("ends"), of(~one).alias("shared"), F.sum(paid).alias("n")).where("n >= 2")
    first = per.select("*", F.explode("days").alias("x"))
    others = F.filter("days", lambda y: y["day"] - F.col("x.day") >= APART)
    last = F.when(F.col("x.before_last"), F.struct(F.lit(0).alias("day"), F.get("ends", F.lit(0)).alias("y")))
    seconds = F.array_compact(F.array_append(F.transform(others, lambda y: F.struct(y["day"].alias("day"), y.alias("y"))), last))
    pairs = first.select(*KEYS, "n", "x", "shared", F.explode(seconds).alias("z")).withColumn("both", F.filter("shared", lambda s: (s["day"] == F.col("x.day")) & (s["day2"] == F.col("z.day"))))
    count = lambda c: F.col(f"x.{c}") + F.coalesce(F.col(f"z.y.{c}"), F.lit(0)) - F.coalesce(F.get("both", F.lit(0))[c], F.lit(0))
    pairs = pairs.select(*KEYS, "n", F.when(F.col("z.day") > 0, "two_days").otherwise("day_and_last").alias("pattern"), F.col("x.day").alias("day1"), F.col("z.day").alias("day2"), count("m").alias("matched"), count("after").alias("after"), count("before").alias("before"))
    best = pairs.groupBy(*KEYS, "pattern").agg(F.min(F.struct((-F.col("matched")).alias("m"), "day1", "day2", "matched", "after", "before")).alias("x"), F.max("n").alias("n"))
    out = best.select(*KEYS, "pattern", "x.day1", "x.day2", "x.matched", "x.after", "x.before", "n")
    return out.select("*", (F.col("matched") / F.col("n")).alias("score"), direction(F.col("after"), F.col("before")).alias("direction"))


def semi_monthly_pattern(support: DataFrame) -> DataFrame:
    """The pair that explains most of at least LEAST per cluster; two days win ties."""
    rank = F.when(F.col("pattern") == "two_days", 0).otherwise(1)
    best = support.where(F.col("score") >= LEAST).groupBy(*KEYS).agg(F.min(F.struct((-F.col("score")).alias("m"), rank.alias("rank"), "pattern", "day1", "day2", "score", "direction")).alias("x"))
    return best.select(*KEYS, "x.pattern", "x.day1", F.when(F.col("x.pattern") == "two_days", F.col("x.day2")).alias("day2"), F.round("x.score", 6).alias("score"), "x.direction")


def biweekly_or_semi_monthly(support: DataFrame, semi: DataFrame) -> DataFrame:
    """B or S per cluster by the larger score; ties: B with up to three pay days, else S.  Clusters without either have no row."""
    weekly = support.where((F.col("kind") == WEEKDAY) & (F.col("score") >= LEAST)).select(*KEYS, "n", F.col("a").alias("weekday"), F.round("score", 6).alias("b_score"), F.col("direction").alias("b_direction"))
    pair = semi.select(*KEYS, "pattern", "day1", "day2", F.col("score").alias("s_score"), F.col("direction").alias("s_direction"))
    rows = weekly.join(pair, list(KEYS), "full_outer")
    b, s = F.coalesce("b_score", F.lit(0.0)), F.coalesce("s_score", F.lit(0.0))
    choice = F.when(b > s, "B").when(s > b, "S").when(F.col("n") <= 3, "B").otherwise("S")
    rows = rows.withColumn("choice", choice)
    name = F.element_at(F.array(*[F.lit(d) for d in DAYS]), F.col("weekday") + 1)
    is_b = F.col("choice") == "B"
    return rows.select(*KEYS, "choice", F.when(is_b, b).otherwise(s).alias("score"), F.when(is_b, name).alias("weekday"), F.when(~is_b, F.col("pattern")).alias("pattern"), F.when(~is_b, F.col("day1")).alias("day1"), F.when(~is_b, F.col("day2")).alias("day2"), F.when(is_b, F.col("b_direction")).otherwise(F.col("s_direction")).alias("direction"))


def regular_text(pattern: Column, day: Column, weekday: Column, week: Column) -> Column:
    """A monthly pattern as text, for reports."""
    name = F.element_at(F.array(*[F.lit(d) for d in DAYS]), weekday + 1)
    return (
        F.when(pattern == "day", day.cast("string")).when(pattern == "last_day", "Last Day").when(pattern == "end_of_month", "Near Month End").when(pattern == "near_day", F.format_string("Near %d", day))
        .when(pattern == "last_weekday", F.concat(F.lit("Last "), name)).when(pattern == "kth_weekday", F.concat(name, F.lit(" of Week "), week.cast("string")))
    )


def parsed_text(text: Column) -> Column:
    """A pay-day text back to its parts: struct (pattern, day1, day2, weekday, week); null where it is none."""
    t = F.trim(text)
    number = lambda p, g=1: F.regexp_extract(t, p, g).try_cast("int")
    names = "|".join(DAYS)
    weekday = F.array_position(F.array(*[F.lit(d) for d in DAYS]), F.regexp_extract(t, f"({names})", 1)).cast("int") - 1
    weekday = F.when(weekday >= 0, weekday)
    pattern = (
        F.when(t.rlike(r"^[0-9]{1,2}$"), "day").when(t.rlike(r"^[0-9]{1,2},[0-9]{1,2}$"), "two_days").when(t == "Last Day", "last_day").when(t == "Near Month End", "end_of_month")
        .when(t.rlike(r"^Near [0-9]{1,2}$"), "near_day").when(t.rlike(f"^Last (?:{names})$"), "last_weekday").when(t.rlike(f"^(?:{names}) of Week [1-4]$"), "kth_weekday").when(t.rlike(f"^(?:{names})$"), "weekday")
    )
    parts = F.struct(pattern.alias("pattern"), number(r"^(?:Near )?([0-9]{1,2})(?:,|$)").alias("day1"), number(r"^[0-9]{1,2},([0-9]{1,2})$").alias("day2"), weekday.alias("weekday"), number(r"of Week ([1-4])$").alias("week"))
    return F.when(pattern.isNotNull(), parts)


def matches(date: Column, parts: Column, around: int = AROUND) -> Column:
    """Whether a date is one on which the pattern (see ``parsed_text``) would pay without a shift."""
    day, last = F.dayofmonth(date), F.dayofmonth(F.last_day(date))
    kind = parts["pattern"]
    clipped = lambda d: F.least(d, last)
    return (
        F.when(kind == "day", day == clipped(parts["day1"])).when(kind == "two_days", (day == clipped(parts["day1"])) | (day == clipped(parts["day2"]))).when(kind == "last_day", day == last)
        .when(kind == "end_of_month", F.when(day <= 7, day).otherwise(last - day) <= around).when(kind == "near_day", F.abs(day - parts["day1"]) <= around)
        .when(kind == "last_weekday", (F.weekday(date) == parts["weekday"]) & is_last_weekday(date)).when(kind == "kth_weekday", (F.weekday(date) == parts["weekday"]) & (week_of_month(date) == parts["week"])).when(kind == "weekday", F.weekday(date) == parts["weekday"])
    )
