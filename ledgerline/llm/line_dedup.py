"""Line dedup by a deletion-neighbourhood join.

A line is a text's part between newlines; its words (blanks split, lower-cased)
are what is compared, and edits are counted in words.  A line that is not blank
goes when an earlier line, by (id, line number), equals it; one of at least
``min_words`` words also when an earlier line of as many is within one edit.
The earliest such line is its keeper.  (Of shorter lines one word is so large a
part that another one is another line; in scripts without blanks a whole line
counts as a word.)

1. Equal lines collapse to their first occurrence.
2. A line within one edit of another shares its first or its last words with it
   (half of the shorter one's, of which eight are enough to compare).  Lines that
   share neither with another line are done: only the others can have a neighbour.
3. Each of these is cut into about as many regions as a region has words, once by
   its own length and once by that less one (as the longer partner).  Two lines
   within one edit agree outside of one region: what lies outside is hashed, and
   only regions in which another line agrees go on.
4. Such a region emits its variants within the bound as hashed keys: for every
   gap between two words the region as it is, and for every word the region
   without it, keyed by the place, the rest of the line and the words.  Lines
   with equal variants are within one edit of each other, so each key's earliest
   line is a neighbour of all others under the key: the join is with that one
   line, never of all pairs.
5. The earliest neighbour found is verified on the words themselves.

Only built-in functions run.  Nulls and empty texts have no lines that take
part.  Rows with a null id neither lose lines nor make others lose them.  Rows
that share an id have equal rank: lines at the same number that are equal do not
remove each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import drop_since, keep, mark

MIN_WORDS = 5


HALVES = [f"half{k}" for k in range(4)]
#: Words of a shared half that are compared at most.
HALF_WORDS = 8


def normal(text: Column) -> Column:
    """Lower-cased, with single blanks between words; newlines stay.  Most texts have no blanks to replace."""
    odd = text.rlike("[\\t\\x0B\\f\\r]") | F.contains(text, F.lit("  "))
    return F.lower(F.when(odd, F.regexp_replace(text, "[ \\t\\x0B\\f\\r]+", " ")).otherwise(text))


def word_count(line: Column) -> Column:
    """Words of a trimmed normal line."""
    return F.when(line == "", 0).otherwise(F.size(F.split(line, " ")))


def _halves(line: Column, n: Column) -> list[Column]:
    """Keys of the first and last words, for a partner as long or longer and for one that is shorter; the lowest
    bit says which side."""
    out = []
    for side in (0, 1):
        for less in (0, 1):
            p = F.least(F.floor((n - less) / 2), F.lit(HALF_WORDS)).cast("int")
            part = F.call_function("substring_index", line, F.lit(" "), p if side == 0 else -p)
            out.append(F.xxhash64(p, part).bitwiseAND(F.lit(-2)).bitwiseOR(F.lit(side)))
    return [h.alias(name) for h, name in zip(out, HALVES)]


def digest(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per line that takes part: id, line, words, digest (h1, h2) and half keys (null for a short line)."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.posexplode(F.split(normal(F.col(text_col).cast("string")), "\n")).alias("line", "body"))
    rows = rows.where(F.length("body") >= 1).select("id", "line", F.trim("body").alias("text"))
    rows = rows.withColumn("n", word_count(F.col("text"))).where(F.col("n") >= 1)
    halves = [F.when(F.col("n") >= min_words, h).alias(name) for h, name in zip(_halves(F.col("text"), F.col("n")), HALVES)]
    return rows.select("id", "line", "n", *digest(F.col("text")), *halves)


def _cut(k: Column, short: Column) -> Column:
    """Where region k of a line with ``short`` words, or of one with a word more, begins."""
    return F.floor(k * (short + 1) / _regions(short)).cast("int")


def _regions(short: Column) -> Column:
    return F.floor(F.sqrt(short + 1)).cast("int")


def _role(words: Column, longer: bool) -> Column:
    """A line as the shorter or the longer of two that differ by a word: hashes of its regions, aligned with the
    partner's first words and with its last."""
    short = F.size(words) - int(longer)
    ks = F.sequence(F.lit(0), _regions(short) - 1)
    hashes = lambda shift: F.transform(ks, lambda k: F.xxhash64(F.slice(words, F.greatest(_cut(k, short) + shift, F.lit(1)), _cut(k + 1, short) - _cut(k, short))))
    return F.struct(short.alias("short"), F.lit(longer).alias("longer"), hashes(1).alias("head"), hashes(1 if longer else 0).alias("tail"))


def _outsides(head: Column, tail: Column, short: Column) -> Column:
    """For every region, the hash of all other regions."""
    return F.transform(F.sequence(F.lit(0), F.size(head) - 1), lambda r: F.struct(r.alias("region"), F.xxhash64(short, r, F.slice(head, F.lit(1), r), F.slice(tail, r + 2, F.size(tail))).alias("outside")))


def _variants(words: Column, short: Column, longer: Column, region: Column, outside: Column) -> Column:
    """Keys of a region's variants: without each of its words (longer), or as it is for each of its gaps."""
    begin = _cut(region, short)
    length = _cut(region + 1, short) - begin
    cut = lambda o: F.concat(F.slice(words, begin + 1, o), F.slice(words, begin + o + 2, length - o - 1))
    return F.transform(F.sequence(F.lit(0), length - 1), lambda o: F.xxhash64(outside, o, F.when(longer, cut(o)).otherwise(F.slice(words, begin + 1, length - 1))))


def _within_one(a: Column, b: Column) -> Column:
    """Whether two word arrays are within one insertion, deletion or substitution."""
    longer, shorter = F.when(F.size(a) >= F.size(b), a).otherwise(b), F.when(F.size(a) >= F.size(b), b).otherwise(a)
    differs = lambda x, y: F.coalesce(x != y, F.lit(True))
    same = F.size(F.filter(F.zip_with(a, b, differs), lambda d: d)) <= 1
    first = F.array_position(F.zip_with(longer, shorter, differs), True).cast("int")
    gone = F.concat(F.slice(longer, F.lit(1), first - 1), F.slice(longer, first + 1, F.size(longer))) == shorter
    return F.when(F.size(a) == F.size(b), same).when(F.size(longer) == F.size(shorter) + 1, gone).otherwise(F.lit(False))


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per line to remove: doc_id, line (from 0), keeper_id, keeper_line and edits (0 or 1)."""
    begin = mark()
    every = keep(lines(docs, id_col, text_col, min_words), "lines")
    place = F.struct("id", "line")
    distinct = keep(every.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("copies"), *[F.any_value(h).alias(h) for h in HALVES]), "distinct-lines")

    # lines that share a half with another
    near = distinct.where(f"{HALVES[0]} is not null")
    halves = near.select("h1", F.col("first.id").alias("id"), F.col("first.line").alias("line"), F.explode(F.array_distinct(F.array(*HALVES))).alias("half"))
    # minima are written before they are joined, so that Spark can split a join by a key that very many rows share
    shared = keep(halves.groupBy("half").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select("half"), "shared-halves")
    wanted = halves.drop("h1").join(shared, "half").groupBy(F.col("id").alias("_id")).agg(F.collect_set("line").alias("wanted"))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.split(normal(F.col(text_col).cast("string")), "\n").alias("body"))
    found = texts.join(wanted, "_id").select("_id", F.explode(F.transform("wanted", lambda w: F.struct(w.alias("line"), F.get("body", w).alias("text")))).alias("x"))
    bodies = found.select(F.struct(F.col("_id").alias("id"), F.col("x.line").alias("line")).alias("first"), F.trim(F.col("x.text")).alias("text"))
    # dealt evenly, for what follows is heavy and the rows are few; equal lines are one (a repeated id may carry another text)
    bodies = bodies.select("first", *digest(F.col("text")), F.split("text", " ").alias("words")).where(F.size("words") >= min_words)
    bodies = keep(bodies.repartition("h1", "h2").dropDuplicates(["h1", "h2"]), "near-lines")

    # regions outside of which another line is the same
    words = F.col("words")
    roles = bodies.select("first", "h1", F.explode(F.array(_role(words, False), _role(words, True))).alias("role")).select("first", "h1", "role.*")
    outsides = roles.select("first", "h1", "short", "longer", F.inline(_outsides(F.col("head"), F.col("tail"), F.col("short"))))
    outsides = keep(outsides, "outsides")
    agree = keep(outsides.groupBy("outside").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select("outside"), "agreeing")
    regions = outsides.join(agree, "outside").join(bodies.select("first", "h1", "words"), ["first", "h1"])

    # their variants
    variants = keep(regions.select("first", F.explode(_variants(words, F.col("short"), F.col("longer"), F.col("region"), F.col("outside"))).alias("key")), "variants")
    earliest = keep(variants.groupBy("key").agg(F.min("first").alias("near"), F.max("first").alias("last")).where("last > near").select("key", "near"), "earliest")
    pairs = variants.join(earliest, "key").where("first > near").groupBy("first").agg(F.min("near").alias("near"))

    left, right = bodies.select("first", "h1", "h2", F.col("words").alias("a")), bodies.select(F.col("first").alias("near"), F.col("words").alias("b"))
    verified = pairs.join(left, "first").join(right, "near").where(_within_one(F.col("a"), F.col("b"))).select("h1", "h2", "near")

    # all occurrences: of lines with copies, and of lines with an earlier neighbour
    known = distinct.select("h1", "h2", "first", "copies").join(verified, ["h1", "h2"], "left").where("copies > 1 or near is not null")
    known = keep(known.select("h1", "h2", F.coalesce(F.least("near", "first"), F.col("first")).alias("keeper"), F.when(F.col("near") < F.col("first"), 1).otherwise(0).alias("edits")), "keepers")
    drop_since(docs.sparkSession, begin, "lines", "keepers")
    removed = every.select("id", "line", "h1", "h2").join(known, ["h1", "h2"]).where(place > F.col("keeper"))
    return removed.select(F.col("id").alias(id_col), F.col("line").cast("long").alias("line"), F.col("keeper.id").alias("keeper_id"), F.col("keeper.line").cast("long").alias("keeper_line"), F.col("edits").cast("long").alias("edits"))


def without_lines(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines cut from their texts; a document that loses lines and keeps only blanks goes."""
    key, gone = "__line_dedup_id", "__line_dedup_gone"  # apart from any column of docs
    sets = removed.groupBy(F.col(id_col).alias(key)).agg(F.collect_set("line").alias(gone))
    joined = docs.join(sets, docs[id_col] == sets[key], "left")
    # the numbers that are left come from a difference of sets, so that a document of many removed lines stays linear
    left = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0).cast("long"), F.size(lines).cast("long") - 1), F.col(gone)), lambda i: F.get(lines, i.cast("int")))
    rest = F.array_join(F.transform(F.array(F.split(text_col, "\n")), left)[0], "\n")
    out = joined.withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(rest))
    said = F.exists(F.split(text_col, "\n"), lambda line: F.trim(normal(line)) != "")
    return out.where(F.col(gone).isNull() | said).drop(key, gone)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` after line dedup, all other columns as they are."""
    return without_lines(docs, keep(duplicate_lines(docs, id_col, text_col, min_words), "removed-lines"), id_col, text_col)
