"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

A URL's host stands after the first "://" up to "/", "?", "#" or the end, its
A-Z lower-cased; the path follows up to "?", "#" or the end.  The longest rule
whose host is the URL's host or a parent domain and whose path begins the URL's
path decides.  Other URLs are judged by a model trained from a small labelled
table of URLs: n-grams of host and of path are hashed into a fixed number of
columns, so the model's size does not depend on the data.

Null URLs and those without "://" have an empty host and path, fit no rule and
are blocked, as there is nothing to fetch.  Repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values: (verdict, host, path) of the rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
GRAMS = (3, 4)
COLUMNS = 1 << 13
#: Words that hosts and paths of either kind are made of.
BLOCK_WORDS = """casino roulette blackjack jackpot poker bingo slots betting sportsbet lottery gambling porn xxx nude escort hotcams camgirl erotic hardcore sexdating
 viagra cialis pills pharmacy steroids weightloss replica handbags rolex followers backlinks linkfarm spamblog spinner payday forex doubler getrich quickcash
 warez keygen cracked torrent pirate giveaway freeprize clickbait phishing malware""".split()
ALLOW_WORDS = """library museum archive encyclopedia university science journal geology botany astronomy history language grammar poetry theatre orchestra cinema recipes kitchen bakery
 garden roses birds climbing cycling sailing chess knitting weather transport trains harbour parliament council court health hospital clinic school kindergarten
 standards compiler dataset statistics manual tutorial forum newspaper magazine radio village charity hotel farmers mathematics museumshop observatory""".split()
#: Shapes of hosts and paths, the same for both kinds, so that only words tell them apart.
HOSTS = ("{w}.example", "www.{w}.test", "my{w}.example", "{w}-online.test", "the-{w}-site.example", "{w}24.test", "blog.{w}.example", "best{w}.test")
PATHS = ("/", "/page/2", "/index.html", "/2021/05/post", "/about", "/item?id=7", "/{w}/list", "/read/{w}", "")


def _table(words: list[str], label: int, each: int = 3) -> list[tuple[str, int]]:
    """The labelled table is built from the words: ``each`` URLs a word, in shapes that go round."""
    return [("https://" + (HOSTS[(k + 3 * j) % len(HOSTS)] + PATHS[(2 * k + 5 * j) % len(PATHS)]).format(w=w), label) for k, w in enumerate(words) for j in range(each)]


LABELLED = tuple(_table(BLOCK_WORDS, 1) + _table(ALLOW_WORDS, 0))


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url.cast("string"), F.lit(""))
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, parts, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(url, parts, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for what, domain, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        rule, verdict = F.when(fits, domain + start).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def grams(host: Column, path: Column, sizes: tuple[int, ...] = GRAMS) -> Column:
    """Character n-grams of host and of path, marked by where they come from; whole texts."""
    out = []
    for mark, text in (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", F.concat(path, F.lit("$")))):
        for n in sizes:
            at = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
            out.append(_cut(at, mark, text, n))
    return F.concat(*out)


def _cut(at: Column, mark: str, text: Column, n: int) -> Column:
    return F.transform(at, lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(n))))


def _vectors(rows: DataFrame, columns: int) -> DataFrame:
    """Adds ``vector``, the presence of hashed n-grams."""
    return HashingTF(numFeatures=columns, binary=True, inputCol="grams", outputCol="vector").transform(rows.withColumn("grams", grams(F.col("host"), F.col("path"))))


def train(spark: SparkSession, labelled=LABELLED, columns: int = COLUMNS) -> LogisticRegressionModel:
    """Fit on (url, label) pairs or a DataFrame of such; 1 is block."""
    if not isinstance(labelled, DataFrame):
        table = F.array(*[F.struct(F.lit(u).alias("url"), F.lit(float(y)).alias("label")) for u, y in labelled])
        labelled = spark.range(1).select(F.explode(table).alias("x")).select("x.*")
    host, path = host_and_path(F.col("url"))
    rows = labelled.select(host.alias("host"), path.alias("path"), F.col("label").cast("double").alias("label")).coalesce(1)
    return LogisticRegression(featuresCol="vector", regParam=0.01, maxIter=60, standardization=False).fit(_vectors(rows, columns))


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, labelled=LABELLED, columns: int = COLUMNS) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the model's probability of block, null where a rule decides)."""
    model = train(pages.sparkSession, labelled, columns)
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict})
    scored = model.transform(_vectors(rows, columns))
    chance = F.when(F.col("host") == "", F.lit(1.0)).otherwise(vector_to_array("probability")[1])
    judged = F.when(F.col("ruled").isNotNull(), F.col("ruled")).when(chance >= 0.5, "block").otherwise("allow")
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", judged.alias("verdict"), F.when(F.col("ruled").isNull(), chance).alias("score"))
