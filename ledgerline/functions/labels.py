"""Label columns: defaults, checks, renames and one-hot forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes of labels, and bins of the days between payments.
CATEGORIES = ("payroll", "benefit", "transfer", "deposit", "gig")
BINS = ("1", "2-5", "6-8", "9-12", "13-17", "18-24", "24-35", "36+")
#: Columns of labelled rows as they come back, and their names as input.
INPUT_NAMES = {"category_label": "label", "label_from": "label_source", "who_label": "who", "how_label": "how", "what_label": "what"}


def category_flags(label: Column) -> list[Column]:
    return [F.coalesce(F.lower(label) == c, F.lit(False)).alias(f"is_{c}") for c in CATEGORIES]


def with_defaults(rows: DataFrame, names: list[str], value: str = "None") -> DataFrame:
    """Label columns that are missing or null hold ``value``."""
    return rows.withColumns({n: F.coalesce(F.col(n), F.lit(value)) if n in rows.columns else F.lit(value) for n in names})


def as_input(rows: DataFrame, names: dict[str, str] = INPUT_NAMES) -> DataFrame:
    """Labelled output as the input of a next run."""
    return rows.withColumnsRenamed({a: b for a, b in names.items() if a in rows.columns})


def unknown_labels(rows: DataFrame, known: list[str], label: str = "label") -> DataFrame:
    """(request_id, code, message) of requests that bring labels that are not known, each once."""
    bad = rows.where(F.col(label).isNotNull() & ~F.col(label).isin(*known)).groupBy("request_id").agg(F.array_join(F.array_sort(F.collect_set(label)), ", ").alias("names"))
    return bad.select("request_id", F.lit(501).alias("code"), F.concat(F.lit("unknown labels: "), "names").alias("message"))


def bin_flags(bin_: Column, prefix: str) -> list[Column]:
    """One column a bin; a bin that is not listed gives zeros."""
    return [F.coalesce((bin_ == b).cast("int"), F.lit(0)).alias(f"{prefix}_{k}") for k, b in enumerate(BINS)]


#: Cuts of amounts and of shares that agree.
AMOUNT_CUTS, SHARE_CUTS = (10, 100, 1000), (0.9, 0.7, 0.5)


def amount_class(amount: Column) -> Column:
    return F.when(amount < AMOUNT_CUTS[0], "minor").when(amount < AMOUNT_CUTS[1], "small").when(amount < AMOUNT_CUTS[2], "medium").when(amount.isNotNull(), "major")


def consistency_class(share: Column) -> Column:
    return F.when(share >= SHARE_CUTS[0], "high").when(share >= SHARE_CUTS[1], "medium").when(share >= SHARE_CUTS[2], "low").otherwise("none")


def whole_percent(share: Column) -> Column:
    """Cut, not rounded; a hair is added, so that 0.29 gives 29."""
    return F.floor(share * 100 + 1e-9).cast("long")


def ngram_presence(text: Column, vocabulary: list[str]) -> list[Column]:
    """Whether each word n-gram of a vocabulary stands in a text."""
    padded = F.concat(F.lit(" "), F.array_join(F.filter(F.split(text, "\\s+"), lambda t: t != ""), " "), F.lit(" "))
    return [F.contains(padded, F.lit(f" {v} ")).cast("int").alias(f"has_{k}") for k, v in enumerate(vocabulary)]


def without_fields(nested: Column, names: list[str]) -> Column:
    """An array of structs without some of their fields."""
    return F.transform(nested, lambda x: x.dropFields(*names))


def clean_output(rows: DataFrame, renames: dict[str, str], key: str = "account") -> DataFrame:
    """Rows of known accounts, renamed; empty and "None" labels become null and vanish from JSON."""
    texts = [c for c, t in rows.dtypes if t == "string" and c != key]
    out = rows.where(F.col(key).isNotNull()).withColumns({c: F.when(~F.col(c).isin("", "None"), F.col(c)) for c in texts})
    return out.withColumnsRenamed(renames)
