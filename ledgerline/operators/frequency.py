"""Pay frequency, regular pay day and scores of every cluster, set-at-a-time.

A pay day is a date with its summed amount.  Patterns are tested as candidates:
each cluster's most frequent weekday or days of the month are exploded and
counted against its pay days with a business calendar, so that one job covers
every account.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .calendar import DAYS, month_distance
from .clusters import KEYS, KNOWN, gaps, same_day
from .paydays import biweekly_or_semi_monthly, candidate_days, intended_days, monthly_pattern, pattern_support, regular_text, semi_monthly_pattern, semi_monthly_support, tendencies

#: Days after which a source is not recent, by frequency; variation cuts; pays that a score needs.
RECENCY = {"W": 10, "B": 18, "S": 18, "M": 35}
RECENCY_OTHER = 30
VARIATION = (0.33, 0.5)
LEAST_PAYS = {"M": 2, "B": 2, "S": 2, "W": 2}
LEAST_PAYS_OTHER = 4
GAP, GAP_MONTHLY = 35, 40
#: What ``judged`` says of a cluster.
JUDGED = ("frequency", "monthly_amount", "monthly_pays", "weekday", "day1", "day2", "regular_day", "same_day_share")
SMALL_AMOUNT, TRIM_ROWS, TRIM_SHARE = 50, 4, 0.3


def by_frequency(frequency: Column, values: dict[str, int], other: int) -> Column:
    return F.coalesce(*[F.when(frequency == k, F.lit(v)) for k, v in values.items()], F.lit(other))


def kept(amount: Column) -> Column:
    """Whether a row's amount is above 50 and, in clusters with four of these, at least 0.3 of their median."""
    cluster, large = Window.partitionBy(*KEYS), amount > SMALL_AMOUNT
    known = F.when(large, amount)
    return large & ((F.count(known).over(cluster) < TRIM_ROWS) | (amount >= TRIM_SHARE * F.percentile(known, F.lit(0.5)).over(cluster)))


def trimmed(ledger: DataFrame) -> DataFrame:
    """Rows that are ``kept``."""
    return ledger.withColumn("kept", kept(F.col("amount"))).where("kept").drop("kept")


def _mode(rows: DataFrame, value: str, n: int) -> DataFrame:
    """A cluster's n most frequent values, smallest first on ties, and their share of its pay days."""
    counts = rows.groupBy(*KEYS, value).agg(F.count("*").alias("c"))
    group = Window.partitionBy(*KEYS)
    ranked = counts.select("*", F.row_number().over(group.orderBy(F.desc("c"), value)).alias("r"), F.sum("c").over(group).alias("total")).where(F.col("r") <= n)
    return ranked.groupBy(*KEYS).agg(F.max(F.when(F.col("r") == 1, F.col(value))).alias(value), F.max(F.when(F.col("r") == 2, F.col(value))).alias(f"{value}2"), (F.sum("c") / F.max("total")).alias(f"{value}_share"))


#: A count and a place among the values in one number, the larger the more frequent and then the smaller the value.
PLACES = 64


def mode_codes(value: Column, values: range, on: Column) -> Column:
    """An aggregate for ``modes``: how often null and each of the few ``values`` stand among the rows where ``on`` holds."""
    return F.array(*[F.count_if(on & is_it) * PLACES + (PLACES - 1 - i) for i, is_it in enumerate([value.isNull(), *[value == v for v in values]])])


def modes(codes: Column, first: int) -> list[tuple[Column, Column]]:
    """The two most frequent values (null without a second one; nulls first on ties, then the smallest) with their counts."""
    top = F.array_max(codes)
    place = lambda code: PLACES - 1 - code % PLACES
    return [(F.when((code >= PLACES) & (place(code) > 0), (place(code) - 1 + first).cast("int")), F.shiftright(code, 6)) for code in (top, F.array_max(F.array_remove(codes, top)))]


def pay_counts(amount: str = "amount", gap: str = "gap", on: str = "true") -> list[Column]:
    """Aggregates over the pay days of a cluster where ``on`` holds, from which ``judged`` makes its frequency."""
    gap, on = F.col(gap), F.expr(on)
    of = lambda c: F.when(on, F.col(c))
    return [
        F.count_if(on).alias("n_pays"), F.avg(of(amount)).alias("mean_amount"), F.datediff(F.max(of("date")), F.min(of("date"))).alias("span"), F.max(of("date")).alias("last_date"),
        F.count_if(on & (gap == 7)).alias("w"), F.count_if(on & gap.between(13, 17)).alias("b"), F.count_if(on & gap.between(25, 35)).alias("m"), F.count_if(on & (gap % 7 == 0)).alias("seven"),
        mode_codes(F.weekday("date"), range(7), on).alias("weekdays"), mode_codes(F.dayofmonth("date"), range(1, 32), on).alias("month_days"),
    ]


def pay_patterns(days: DataFrame, calendar: DataFrame) -> DataFrame:
    """Per cluster: the arbiter's choice between two weeks and half months, and the monthly habit."""
    intended = intended_days(days, calendar)
    support = pattern_support(intended).persist()  # a few rows a cluster, read by both choices
    pair = biweekly_or_semi_monthly(support, semi_monthly_pattern(semi_monthly_support(intended, candidate_days(days, calendar), calendar)))
    pair = pair.select(*KEYS, "choice", F.col("score").alias("choice_score"), F.coalesce("weekday", F.concat_ws(",", F.col("day1").cast("string"), F.coalesce(F.col("day2").cast("string"), F.lit("Last Day")))).alias("choice_day"), F.col("direction").alias("choice_direction"))
    month = monthly_pattern(support, tendencies(days))
    month = month.select(*KEYS, regular_text(F.col("pattern"), F.col("day"), F.col("weekday"), F.col("week")).alias("month_day"), F.col("direction").alias("month_direction"))
    return pair.join(month, list(KEYS), "full_outer")


def frequency(ledger: DataFrame, trim: bool = True, calendar: DataFrame | None = None) -> DataFrame:
    """Per cluster: n_pays, mean_amount, span, frequency (W, B, S, M or I), monthly_amount, monthly_pays,
    weekday, day1, day2, regular_day and same_day_share; with a business calendar that spans the ledger also
    holiday_direction, and pay-day patterns (``paydays``) decide between B and S and name the day of M and S."""
    days = gaps(same_day(trimmed(ledger) if trim else ledger))
    if calendar is not None:
        days = days.persist()  # every pattern reads the pay days
    rows = days.where(KNOWN).groupBy(*KEYS).agg(*pay_counts())
    if calendar is not None:
        rows = rows.join(pay_patterns(days, calendar), list(KEYS), "left")
    rows = judged(rows, calendar is not None)
    return rows.select(*KEYS, "n_pays", F.round("mean_amount", 2).alias("mean_amount"), "span", "last_date", *JUDGED, *(["holiday_direction"] if calendar is not None else []))


def judged(rows: DataFrame, patterns: bool = False) -> DataFrame:
    """Adds the columns JUDGED to clusters with their ``pay_counts`` and, where ``patterns`` says so, ``pay_patterns``."""
    (weekday, often), = modes(F.col("weekdays"), 0)[:1]
    (day, most), (day2, next_) = modes(F.col("month_days"), 1)
    total = F.nullif("n_pays", F.lit(0))
    rows = rows.withColumns({"weekday": weekday, "weekday_share": often / total, "day": day, "day2": day2, "day_share": (most + next_) / total})
    n = F.greatest(F.col("n_pays") - 1, F.lit(1))
    cut = F.when(F.col("n_pays") > 3, 0.4999).otherwise(0.5)
    weekly, fort, monthly, seven = (F.col(c) / n > cut for c in ("w", "b", "m", "seven"))
    semi = F.col("weekday_share") <= F.col("day_share")
    half = F.when(~semi, F.when(F.col("weekday_share") > cut, "B").otherwise("I")).otherwise(F.when(F.col("day2").isNotNull() & (F.col("day_share") > cut), "S").otherwise("I"))
    if patterns:
        half = F.when(F.col("choice").isNotNull(), F.when(F.col("choice_score") > cut, F.col("choice")).otherwise("I")).otherwise(half)
    code = (
        F.when(weekly, F.when(F.col("weekday_share") > cut, "W").otherwise("I"))
        .when(fort, half)
        .when(monthly, "M")
        .when(seven & (F.col("n_pays") > 3) & (F.col("w") > F.col("b")), "W")
        .when(seven & (F.col("n_pays") > 3) & (F.col("b") > F.col("w")), "B")
        .otherwise("I")
    )
    rows = rows.withColumn("frequency", code)
    f = F.col("frequency")
    scaled = F.when(F.col("span") >= 30, F.col("n_pays") * 30 / F.col("span")).otherwise(F.col("n_pays").cast("double"))
    pays = F.when(f == "W", 52 / 12).when(f == "B", 26 / 12).when(f == "S", 2.0).when(f == "M", 1.0).otherwise(scaled)
    name = F.element_at(F.array(*[F.lit(d) for d in DAYS]), F.col("weekday") + 1)
    two = F.concat_ws(",", F.least("day", "day2").cast("string"), F.greatest("day", "day2").cast("string"))
    loose = (f == "I") & (F.col("n_pays") > 4)
    regular = F.when(f.isin("W", "B"), name).when(f == "M", F.col("day").cast("string")).when(f == "S", two).when(loose & (F.col("weekday_share") > cut), name).when(loose, two)
    same = F.when(f.isin("W", "B"), F.col("weekday_share")).when(f.isin("M", "S"), F.col("day_share")).when(loose & (F.col("weekday_share") > cut), F.col("weekday_share")).when(loose, F.col("day_share")).otherwise(0.0)
    direction = {}
    if patterns:
        regular = F.when(f.isin("B", "S") & (f == F.col("choice")), F.col("choice_day")).when(f == "M", F.coalesce("month_day", regular)).otherwise(regular)
        direction = {"holiday_direction": F.when(f.isin("B", "S") & (f == F.col("choice")), F.col("choice_direction")).when(f == "M", F.col("month_direction"))}
    return rows.withColumns({"monthly_amount": F.round(F.col("mean_amount") * pays, 2), "monthly_pays": F.round(pays, 4), "day1": F.col("day"), "day2": F.when(f != "M", F.col("day2")), "regular_day": regular, "same_day_share": F.round(same, 4), **direction})


def enough_pays(freq: Column, n: Column) -> Column:
    return n >= by_frequency(freq, LEAST_PAYS, LEAST_PAYS_OTHER)


def scores(ledger: DataFrame, frequencies: DataFrame, as_of: datetime.date, regular_income: bool = True) -> DataFrame:
    """Scores 0 to 3 per cluster: activity, recurrence and stability, with the coefficient of variation (1 at most)."""
    per = gaps(same_day(ledger)).groupBy(*KEYS).agg(*score_counts())
    known = frequencies.select(*KEYS, "frequency", "day1", "day2", "weekday", "regular_day", "same_day_share")
    rows = scored(per.join(known, list(KEYS)), as_of, regular_income)
    return rows.select(*KEYS, "active_score", "recurring_score", "stability_score", F.round("variation", 4).alias("variation"))


def score_counts() -> list[Column]:
    """Aggregates over a cluster's pay days, from which ``scored`` makes its scores."""
    left, day = F.datediff(F.last_day("date"), "date"), F.dayofmonth("date")
    return [
        F.count("*").alias("n"), F.max("date").alias("last"), F.max("gap").alias("gap"), F.avg("amount").alias("mean"), F.stddev_samp("amount").alias("deviation"),
        F.count_if(left <= 3).alias("ends"), F.array(*[F.count_if((left > 3) & (day == d)) for d in range(1, 28)]).alias("others"),
    ]


def scored(rows: DataFrame, as_of: datetime.date, regular_income: bool = True) -> DataFrame:
    """Adds active_score, recurring_score, stability_score and variation to clusters with their ``score_counts`` and frequency."""
    f = F.col("frequency")
    enough = enough_pays(f, F.col("n")) if regular_income else F.col("n") >= LEAST_PAYS_OTHER
    recent = F.datediff(F.lit(as_of), "last") <= by_frequency(f, RECENCY, RECENCY_OTHER)
    limit = F.when(f.isin("M", "I") & F.lit(regular_income), GAP_MONTHLY).otherwise(GAP)
    active = F.when(~enough, 0).when(~recent, 1).when(F.col("gap") >= limit, 2).otherwise(3)
    near = lambda day, label: F.coalesce(month_distance(day, F.col(label)) <= 3, F.lit(False))
    by_day = F.transform("others", lambda c, i: F.when(near(i + 1, "day1") | near(i + 1, "day2"), c).otherwise(F.lit(0).cast("long")))
    close = F.when(f.isin("W", "B"), F.lit(1.0)).otherwise((F.col("ends") + F.aggregate(by_day, F.lit(0).cast("long"), lambda a, c: a + c)) / F.col("n"))
    rows = rows.withColumn("close", close)
    recurring = F.when(~enough, 0).when(F.col("regular_day").isNull() | (F.col("close") < 0.75), 1).when(F.col("same_day_share") >= 0.75, 3).otherwise(2)
    variation = F.least(F.coalesce(F.col("deviation") / F.when(F.col("mean") != 0, F.col("mean")), F.lit(1.0)), F.lit(1.0))
    stable = F.when(~enough, 0).when(variation <= VARIATION[0], 3).when(variation <= VARIATION[1], 2).otherwise(1)
    return rows.withColumns({"active_score": active, "recurring_score": recurring, "stability_score": stable, "variation": variation})


def shifted_matches(days: DataFrame, calendar: DataFrame) -> DataFrame:
    """How well each cluster's pay days fit its most frequent weekday, counting those moved by a free day.

    A pay day off the weekday counts if the weekday before or after it was free and it is the business day next
    to that.  Ties of the weekday are all tried; the best share wins, the first weekday on ties.
    Columns: account, cluster, weekday, raw, after, before, share, direction.
    """
    counted = days.withColumn("weekday", F.weekday("date"))
    counts = counted.groupBy(*KEYS, "weekday").agg(F.count("*").alias("raw"))
    group = Window.partitionBy(*KEYS)
    candidates = counts.select("*", F.max("raw").over(group).alias("most"), F.sum("raw").over(group).alias("n")).where("raw = most").select(*KEYS, "weekday", "raw", "n")
    off = candidates.join(days.select(*KEYS, "date"), list(KEYS)).where(F.weekday("date") != F.col("weekday"))
    ahead = F.pmod(F.col("weekday") - F.weekday("date"), F.lit(7))
    intended = off.select(*KEYS, "weekday", "date", F.explode(F.array(F.date_add("date", ahead), F.date_sub("date", 7 - ahead))).alias("intended"))
    # one row per day of a bounded span
    free = F.broadcast(calendar.where(~F.col("is_business_day")).select(F.col("date").alias("intended"), "previous_bd", "next_bd"))
    moved = intended.join(free, "intended").groupBy(*KEYS, "weekday").agg(F.sum((F.col("date") == F.col("next_bd")).cast("int")).alias("after"), F.sum((F.col("date") == F.col("previous_bd")).cast("int")).alias("before"))
    rows = candidates.join(moved, [*KEYS, "weekday"], "left").na.fill(0, ["after", "before"])
    rows = rows.withColumn("share", (F.col("raw") + F.col("after") + F.col("before")) / F.col("n"))
    best = rows.groupBy(*KEYS).agg(F.min(F.struct((-F.col("share")).alias("m"), "weekday", "raw", "after", "before", "share")).alias("x"))
    way = F.when(F.col("x.after") + F.col("x.before") == 0, None).when(F.col("x.after") >= F.col("x.before"), "A").otherwise("B")
    return best.select(*KEYS, "x.weekday", "x.raw", "x.after", "x.before", F.round("x.share", 6).alias("share"), way.alias("direction"))


def modal_frequency(days: DataFrame) -> DataFrame:
    """(account, cluster, frequency): the code of a cluster's most frequent pay interval; ties by code."""
    gap = F.col("gap")
    code = F.when(gap <= 1, "D").when(gap.between(6, 8), "W").when(gap.between(13, 17), "B").when(gap.between(25, 35), "M").otherwise("I")
    counts = gaps(days).where("gap is not null").groupBy(*KEYS, code.alias("frequency")).agg(F.count("*").alias("n"))
    return counts.groupBy(*KEYS).agg(F.min(F.struct((-F.col("n")).alias("m"), "frequency"))["frequency"].alias("frequency"))
