"""Business calendar and pay-day arithmetic.

The calendar is a small table of days with business-day columns.  US federal
holidays come from their public rules, so that any span of years can be made.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
#: Holidays on a day of a month, and on the nth (or last: -1) weekday of a month.
FIXED = ((1, 1), (6, 19), (7, 4), (11, 11), (12, 25))
MOVING = ((1, 0, 3), (2, 0, 3), (5, 0, -1), (9, 0, 1), (10, 0, 2), (11, 3, 4))


def weekday(date: Column) -> Column:
    """0 is Monday."""
    return F.weekday(date)


def week_of_month(date: Column) -> Column:
    return F.floor((F.dayofmonth(date) - 1) / 7).cast("int") + 1


def is_last_weekday(date: Column) -> Column:
    return F.month(F.date_add(date, 7)) != F.month(date)


def nth_weekday(month: Column, day: int, n: int) -> Column:
    """Date of the nth weekday ``day`` of the month of ``month``; n = -1 is the last one."""
    name = DAYS[day][:3]
    if n > 0:
        return F.date_add(F.next_day(F.date_sub(F.trunc(month, "MM"), 1), name), 7 * (n - 1))
    return F.date_sub(F.next_day(F.last_day(month), name), 7)


def holidays(spark: SparkSession, first: datetime.date, last: datetime.date) -> DataFrame:
    """Observed US federal holidays (Saturday's on Friday, Sunday's on Monday) between two dates."""
    years = spark.range(first.year - 1, last.year + 2).select(F.col("id").cast("int").alias("y"))
    fixed = [F.make_date("y", F.lit(m), F.lit(d)) for m, d in FIXED]
    moving = [nth_weekday(F.make_date("y", F.lit(m), F.lit(1)), d, n) for m, d, n in MOVING]
    observed = [F.when(F.weekday(x) == 5, F.date_sub(x, 1)).when(F.weekday(x) == 6, F.date_add(x, 1)).otherwise(x) for x in fixed]
    days = years.select(F.explode(F.array(*observed, *moving)).alias("date"))
    return days.where(F.col("date").between(F.lit(first), F.lit(last))).distinct()


def business_calendar(spark: SparkSession, first: datetime.date, last: datetime.date, holidays_: DataFrame | None = None) -> DataFrame:
    """Every day of the span with is_business_day, the nearest business days before and after, and bd_index, the
    number of business days up to it.  One row per day: a bounded table, small enough to broadcast."""
    n = (last - first).days + 41
    days = spark.range(n).select(F.date_add(F.lit(first), F.col("id").cast("int") - 20).alias("date"))
    free = (holidays_ if holidays_ is not None else holidays(spark, first, last)).select(F.col("date").alias("free")).distinct()
    rows = days.join(F.broadcast(free), F.col("date") == F.col("free"), "left").select("date", ((F.weekday("date") < 5) & F.col("free").isNull()).alias("is_business_day"))
    order = Window.partitionBy(F.lit(1)).orderBy("date")
    back, ahead = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    bd = F.when(F.col("is_business_day"), F.col("date"))
    return rows.select("date", "is_business_day", F.last(bd, True).over(back).alias("previous_bd"), F.first(bd, True).over(ahead).alias("next_bd"), F.sum(F.col("is_business_day").cast("int")).over(order).alias("bd_index")).where(F.col("date").between(F.lit(first), F.lit(last)))


def month_distance(a: Column, b: Column) -> Column:
    """Circular distance of two days of the month, modulo 30."""
    return F.least(F.pmod(a - b, F.lit(30)), F.pmod(b - a, F.lit(30)))


def missing_paydays(days: DataFrame, frequency: Column) -> DataFrame:
    """Pay days that should have been between two that were: (account, cluster, missing).

    A weekly gap from 9 days, a bi-weekly one from 18 and a monthly one from 35 is filled in steps of 7, 14
    or 30 days; a last step within two (monthly: five) days of the next pay day is not missing.
    """
    step = F.when(frequency == "W", 7).when(frequency == "B", 14).when(frequency == "M", 30)
    least = F.when(frequency == "W", 9).when(frequency == "B", 18).when(frequency == "M", 35)
    slack = F.when(frequency == "M", 5).otherwise(2)
    w = Window.partitionBy("account", "cluster").orderBy("date")
    rows = days.select("account", "cluster", "date", F.lead("date").over(w).alias("next"), step.alias("step"), least.alias("least"), slack.alias("slack"))
    rows = rows.where(F.datediff("next", "date") >= F.col("least")).withColumn("n", F.floor((F.datediff("next", "date") - F.col("slack") - 1) / F.col("step")).cast("int")).where("n > 0")
    return rows.select("account", "cluster", F.explode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda k: F.date_add(F.col("date"), k * F.col("step")))).alias("missing"))


def next_payday(last: Column, frequency: Column, weekday_: Column, day1: Column, day2: Column) -> Column:
    """The next pay day before business-day shifts.

    Weekly and bi-weekly: 7 or 14 days on, moved to the nearest expected weekday.  Monthly and semi-monthly: of
    the labelled days in this and the next two months more than three days later, the nearest to 30 or 15 days on.
    """
    hop = F.when(frequency == "W", 7).otherwise(14)
    there = F.date_add(last, hop)
    shift = F.pmod(weekday_ - F.weekday(there), F.lit(7))
    weekly = F.date_add(there, F.when(shift > 3, shift - 7).otherwise(shift))

    def day_of(months: int, day: Column) -> Column:
        start = F.trunc(F.add_months(last, months), "MM")
        return F.date_add(start, F.least(day, F.dayofmonth(F.last_day(start))) - 1)

    target = F.date_add(last, F.when(frequency == "M", 30).otherwise(15))
    options = F.array_compact(F.array(*[day_of(m, d) for m in (0, 1, 2) for d in (day1, day2)]))
    late = F.filter(options, lambda x: F.datediff(x, last) > 3)
    best = F.array_min(F.transform(late, lambda x: F.struct(F.abs(F.datediff(x, target)).alias("d"), x.alias("x"))))["x"]
    return F.when(frequency.isin("W", "B"), weekly).when(frequency.isin("M", "S"), best)


def shifted(rows: DataFrame, date: str, direction: Column, calendar: DataFrame) -> DataFrame:
    """Adds ``shifted``: a non-business day moves forward where direction is A, else back."""
    # one row per day of a bounded span
    c = F.broadcast(calendar.select(F.col("date").alias("_d"), "is_business_day", "previous_bd", "next_bd"))
    joined = rows.join(c, F.col(date) == F.col("_d"), "left")
    moved = F.when(F.coalesce("is_business_day", F.lit(True)), F.col(date)).when(direction == "A", F.col("next_bd")).otherwise(F.col("previous_bd"))
    return joined.withColumn("shifted", moved).drop("_d", "is_business_day", "previous_bd", "next_bd")


def holiday_direction(days: DataFrame, expected: Column, calendar: DataFrame, reach: int = 3) -> DataFrame:
    """A or B per cluster: whether pay days off their expected weekday come after or before a free day.

    Off-pattern pay days meet free weekdays at most ``reach`` business days away (an equi-join on the distance);
    the most frequent sign decides, the smallest distance first on ties.
    """
    off = days.where(F.weekday("date") != expected).select("account", "cluster", "date")
    near = off.select("*", F.explode(F.sequence(F.date_sub("date", reach + 2), F.date_add("date", reach + 2))).alias("free"))
    cal = calendar.select("date", "bd_index", "is_business_day")
    free = F.broadcast(cal.where(~F.col("is_business_day") & (F.weekday("date") < 5)).select(F.col("date").alias("free"), F.col("bd_index").alias("free_index")))
    own = F.broadcast(cal.select("date", "bd_index"))
    found = near.join(free, "free").join(own, "date").withColumn("distance", F.col("bd_index") - F.col("free_index")).where(F.abs("distance") <= reach)
    counts = found.where("distance <> 0 or date > free").groupBy("account", "cluster", F.when(F.col("date") > F.col("free"), "A").otherwise("B").alias("direction")).agg(F.count("*").alias("n"), F.min(F.abs("distance")).alias("near"))
    return counts.groupBy("account", "cluster").agg(F.min(F.struct((-F.col("n")).alias("m"), "near", "direction"))["direction"].alias("direction"))
