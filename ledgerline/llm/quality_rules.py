"""Quality rules with adaptive thresholds.

Per document, in one pass of array functions: words, characters in words,
symbols, repeated lines and words inside repeated 8-word windows.  Fixed base
rules fail a document outright.  The verdict on the others compares integer
ratios with fences around the quartiles of their language and source.  The
quartiles come from log-linear histograms: a value's bucket keeps its five
leading bits, so a quantile is off by at most a sixteenth, buckets of any two
parts of the data merge by adding counts, and the result does not depend on
the order of rows.  Only documents that pass the base rules are counted.  A
group's quartiles are drawn towards its language's, and these towards those of
all documents, as if ``weight`` documents of the wider kind stood in each: large
groups stand for themselves, small ones lean on the wider ones, without a step
at any size.  The fences are joined to the documents' measures.

Null texts count as empty and fail the base rules.  Null languages and sources
are groups of their own.  Repeated rows count once each.  A group without a document that
passes the base rules has no fences and needs none.  Windows are compared
by 64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import keep

WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Documents of the wider kind that a group's quartiles count in; fences are this many spreads beyond the quartiles.
WEIGHT, REACH = 200, 3
#: metric: least spread, whether low values fail too.  Ratios are per thousand, word length in hundredths.
METRICS = {"symbols": (30, False), "dup_lines": (100, False), "repeats": (50, False), "word_length": (50, True)}
BLANKS = "[ \\t\\n\\x0B\\f\\r]+"


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", window: int = WINDOW) -> DataFrame:
    """One row per document: id, lang, source and its counts (long)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), text.alias("text"))
    rows = rows.withColumns({
        "words": F.array_remove(F.split("text", BLANKS), ""),
        "lines": F.filter(F.split("text", "\n"), lambda line: line.rlike("[^ \\t\\n\\x0B\\f\\r]")),
        "n_symbols": F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long"),
    })
    rows = rows.select(
        "id", "lang", "source", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    # a window is hashed from its words' hashes
    at = F.sequence(F.lit(0), F.size("h") - window)
    hashed = F.transform(at, lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(window)]))
    rows = rows.withColumn("w", F.when(F.size("h") >= window, hashed).otherwise(F.array().cast("array<bigint>"))).drop("h")
    # only texts with a repeated window are sorted
    twice = F.size(F.array_distinct("w")) < F.size("w")
    rows = rows.withColumn("sorted", F.when(twice, F.sort_array(F.transform("w", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("w")
    same = lambda x, k: F.coalesce(F.get("sorted", k)["h"] == x["h"], F.lit(False))
    repeated = F.filter("sorted", lambda x, k: F.when(k > 0, same(x, k - 1)).otherwise(F.lit(False)) | same(x, k + 1))
    rows = rows.withColumn("at", F.array_sort(F.transform(repeated, lambda x: x["i"]))).drop("sorted")
    covered = F.transform("at", lambda i, k: F.least(F.lit(window), F.coalesce(F.get("at", k + 1) - i, F.lit(window))).cast("long"))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(total, F.lit(0).cast("long")).alias("n_repeat_words"))


def base_failed(min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def ratios(rows: DataFrame) -> DataFrame:
    """Adds the integer metrics of METRICS."""
    per = lambda a, b, n: F.expr(f"({n} * {a}) div greatest({b}, 1)").cast("long")
    return rows.withColumns({
        "symbols": per("n_symbols", "n_words", 1000),
        "dup_lines": per("n_dup_lines", "n_lines", 1000),
        "repeats": per("n_repeat_words", "n_words", 1000),
        "word_length": per("word_chars", "n_words", 100),
    })


def bucket(value: Column) -> Column:
    """Bucket of a non-negative integer: itself below 32, else by its five leading bits."""
    shift = F.greatest(F.length(F.bin(value)) - 5, F.lit(0))
    return (16 * shift + F.call_function("shiftright", value, shift)).cast("long")


def bucket_low(b: Column) -> Column:
    """The smallest value of a bucket."""
    shift = F.greatest(F.floor(b / 16) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", b - 16 * shift, shift).cast("long")


def sketches(rows: DataFrame) -> DataFrame:
    """Histograms (lang, source, metric, bucket, n) of rows with the metrics; two tables merge by adding n."""
    long = rows.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bucket(F.col(m)).alias("bucket")) for m in METRICS])).alias("x"))
    return long.groupBy("lang", "source", "x.metric", "x.bucket").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, q1, q3, docs) from histograms that are first merged over the other columns."""
    merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "metric")
    below = merged.select("*", F.sum("n").over(group.orderBy("bucket")).alias("upto"), F.sum("n").over(group).alias("docs"))
    reach = lambda quarter: F.min(F.when(4 * F.col("upto") >= quarter * F.col("docs"), F.col("bucket")))
    found = below.groupBy(*keys, "metric").agg(reach(1).alias("b1"), reach(3).alias("b3"), F.max("docs").alias("docs"))
    return found.select(*keys, "metric", bucket_low(F.col("b1")).alias("q1"), bucket_low(F.col("b3")).alias("q3"), "docs")


def fences(sketch: DataFrame, weight: int = WEIGHT, reach: int = REACH) -> DataFrame:
    """One row per language and source: low and high bound of each metric."""
    own, wide, every = quartiles(sketch, ["lang", "source"]), quartiles(sketch, ["lang"]), quartiles(sketch, [])
    name = lambda df, tag: df.select(*[c for c in ("lang", "source") if c in df.columns], "metric", *[F.col(c).alias(f"{c}_{tag}") for c in ("q1", "q3", "docs")])
    w = name(wide, "w").withColumnRenamed("lang", "w_lang").withColumnRenamed("metric", "w_metric")
    # one row for each metric: a fixed handful
    e = F.broadcast(name(every, "e").withColumnRenamed("metric", "e_metric"))
    o = name(own, "o")
    all_ = o.join(w, o["lang"].eqNullSafe(w["w_lang"]) & (o["metric"] == w["w_metric"])).join(e, F.col("metric") == F.col("e_metric"))
    wider = lambda c: f"((docs_w * {c}_w + {weight} * {c}_e) div (docs_w + {weight}))"
    pick = lambda c: F.expr(f"(docs_o * {c}_o + {weight} * {wider(c)}) div (docs_o + {weight})")
    spread = F.greatest(pick("q3") - pick("q1"), F.coalesce(*[F.when(F.col("metric") == m, F.lit(s)) for m, (s, _) in METRICS.items()]))
    bounds = all_.select("lang", "source", "metric", (pick("q1") - reach * spread).alias("low"), (pick("q3") + reach * spread).alias("high"))
    cell = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{m}_{c}")
    return bounds.groupBy("lang", "source").agg(*[cell(m, c) for m in METRICS for c in ("low", "high")])


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", weight: int = WEIGHT, reach: int = REACH) -> DataFrame:
    """Per row of ``docs``: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    rows = ratios(keep(measures(docs, id_col, text_col, lang_col, source_col), "measures"))
    limits = fences(sketches(rows.where(~base_failed())), weight, reach)
    limits = limits.withColumnsRenamed({"lang": "f_lang", "source": "f_source"})
    judged = rows.join(limits, rows["lang"].eqNullSafe(limits["f_lang"]) & rows["source"].eqNullSafe(limits["f_source"]), "left")
    inside = F.lit(True)
    for m, (_, both) in METRICS.items():
        inside = inside & (F.col(m) <= F.col(f"{m}_high"))
        if both:
            inside = inside & (F.col(m) >= F.col(f"{m}_low"))
    return judged.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & F.coalesce(inside, F.lit(False))).alias("kept"))
