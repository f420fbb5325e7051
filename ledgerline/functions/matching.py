"""Matching what an applicant claims with what the bank says; and texts of entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import without_repeats


def numeric_text(value: Column) -> Column:
    """Numbers without leading zeros; other texts as they are."""
    return F.when(value.rlike("^[0-9]+$"), F.regexp_replace(value, "^0+(?=.)", "")).otherwise(value)


def one_of(value: Column, known: Column) -> Column:
    """Whether a text is in a list, whatever its case and blanks around; null in either is no match."""
    plain = lambda x: F.lower(F.trim(x))
    return F.coalesce(F.exists(known, lambda k: plain(k) == plain(value)), F.lit(False))


def address_match(city: Column, state: Column, zip_: Column, cities: Column, states: Column, zips: Column) -> dict[str, Column]:
    """City, state (without a country before a dash) and zip (its first five digits) in the bank's lists."""
    short = lambda x: F.element_at(F.split(x, "-"), -1)
    five = lambda x: F.substring_index(x, "-", 1)
    return {"city": one_of(city, cities), "state": one_of(short(state), F.transform(states, short)), "zip": one_of(five(zip_), F.transform(zips, five))}


def phone_match(value: Column, known: Column) -> Column:
    """Whether the last ten digits of a phone number are among those of a list."""
    last = lambda x: F.right(F.regexp_replace(x, "[^0-9]", ""), F.lit(10))
    return F.coalesce(F.exists(known, lambda k: (last(k) == last(value)) & (F.length(last(value)) >= 7)), F.lit(False))


def bank_brand(names: Column, brands: list[str]) -> Column:
    """Whether any bank name of a list holds one of the brands as a word."""
    return F.coalesce(F.exists(names, lambda n: n.rlike("(?i)\\b(?:" + "|".join(brands) + ")\\b")), F.lit(False))


def found_in(texts: Column, wanted: Column) -> tuple[Column, Column]:
    """Aggregates: whether any text holds the wanted one as words, whatever the case, and how many do."""
    padded = lambda x: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " ")), F.lit(" "))
    hit = F.coalesce((F.trim(wanted) != "") & F.contains(padded(texts), padded(wanted)), F.lit(False))
    return F.bool_or(hit), F.count_if(hit)


def entity_text(text: Column) -> Column:
    """Descriptions for a tagger: digits stand alone, slashes, stars and punctuation become blanks."""
    t = F.regexp_replace(text, "(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^A-Za-z0-9 ]+", " "), " +", " "))


def entities(found: Column) -> Column:
    """Distinct entities in lower case, each without repeated words, in the order found."""
    return F.array_distinct(F.filter(F.transform(found, lambda e: without_repeats(F.lower(e))), lambda e: e != ""))


def who_or_text(who: Column, text: Column) -> Column:
    """The entity, or the letters of the description where there is none."""
    letters = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z ]+", " "), " +", " "))
    return F.coalesce(F.when(F.trim(who) != "", who), F.when(letters != "", letters), F.lit("none"))


def claim_ratio(claimed: Column, seen: Column) -> Column:
    """Seen over claimed income, two digits; null without a claim."""
    return F.when(claimed > 0, F.round(seen / claimed, 2) + F.lit(0.0))
