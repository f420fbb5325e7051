"""An entity tagger trained on descriptions made of the documents' words, and its entities of all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tagger as G
from ..sources.adapters import table
from .registry import query

#: Descriptions: places in braces are names of their kind, {NUMBER} a number outside of entities.
FORMS = [
    "pos debit {ORG} {NUMBER}", "{ORG} payroll ppd id {NUMBER}", "zelle to {PERSON} ref {NUMBER}", "check card {NUMBER} {ORG} inc", "atm withdrawal {NUMBER} main branch", "transfer from {PERSON} savings",
    "ach credit {ORG} llc {NUMBER}", "transfer to {ORG} llc {NUMBER}",
]
#: Of so many names one part is held out: no name of a description in it is trained on.
FOLDS = 4


def described(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text, tokens, tags, held_out): a description per document.  Its name is two of the words of the whole
    text, those of the smallest hashes; documents with fewer than two words have none."""
    docs = table(spark, d, "documents").select("doc_id", F.array_distinct(F.expr("regexp_extract_all(lower(text), '[a-z]{3,}', 0)")).alias("words"))
    ranked = F.sort_array(F.transform("words", lambda w: F.struct(F.xxhash64(w, "doc_id").alias("h"), w.alias("w"))))
    docs = docs.select("doc_id", F.transform(F.slice(ranked, 1, 2), lambda x: x["w"]).alias("name"))
    form = F.element_at(F.array(*[F.array(*map(F.lit, f.split(" "))) for f in FORMS]), F.pmod(F.xxhash64("doc_id"), F.lit(len(FORMS))).cast("int") + 1)
    number = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)).cast("string")
    out = "O"

    def piece(p):
        kind = F.regexp_extract(p, r"^\{(ORG|PERSON)\}$", 1)
        plain = F.array(F.struct(F.when(p == "{NUMBER}", number).otherwise(p).alias("token"), F.lit(out).alias("tag")))
        return F.when(kind != "", F.transform("name", lambda w: F.struct(w.alias("token"), kind.alias("tag")))).otherwise(plain)

    rows = docs.withColumn("pieces", F.flatten(F.transform(form, piece))).select("doc_id", "name", F.col("pieces.token").alias("tokens"), F.col("pieces.tag").alias("tags"))
    held = F.pmod(F.xxhash64(F.array_join(F.array_sort("name"), " ")), F.lit(FOLDS)) == 0
    rows = rows.select("doc_id", "name", F.array_join("tokens", " ").alias("text"), "tokens", "tags", held.alias("held_out"))
    # the fit, the tagger and the join read the descriptions, not the texts again
    return rows.persist().where(F.size("name") > 1).drop("name")


@query("entity_tags")
def entity_tags(spark, d):
    """Entities of every description, found by a model of those not held out."""
    rows = described(spark, d)
    model = G.fit(rows.where("not held_out"))
    found = G.spans(G.tagged(rows, model))
    cell = F.transform("entities", lambda e: F.concat(e["kind"], F.lit(":"), e["first"].cast("string"), F.lit(":"), e["entity"]))
    return rows.join(found, "text").select("doc_id", "held_out", "text", F.array_join(cell, ",").alias("entities"))


@query("entity_quality")
def entity_quality(spark, d):
    """Precision, recall and F of whole entities of the held-out descriptions, by kind."""
    rows = described(spark, d)
    return G.quality(rows.where("held_out"), G.fit(rows.where("not held_out")))
