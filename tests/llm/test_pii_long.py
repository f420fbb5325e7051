"""Spans of long texts, places and overlaps against plain versions, and gazetteers from a table."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import pii


def test_a_megabyte_of_tokens(spark):
    """The work grows with the text: a text eight times as long takes far less than 64 times as long."""

    def seconds(n):
        docs = spark.createDataFrame([(1, " ".join(f"item{i}" for i in range(n)))], "doc_id long, text string")
        began = time.time()
        pii.scan(docs).write.format("noop").mode("overwrite").save()
        return time.time() - began

    seconds(100)
    short, long = seconds(12_000), seconds(96_000)
    print("seconds:", short, long)
    assert long < 30 and long < 20 * max(short, 0.3)


def test_places_against_finditer(spark):
    r = random.Random(3)
    texts = ["".join(r.choice(["a1", " ", "é", "x", "漢 ", "9@", "\n", "q q"]) for _ in range(r.randrange(60))) for _ in range(200)]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    plain = re.compile("(?<![^\x20\x09-\x0d])[^\x20\x09-\x0d0-9@]*[0-9@][^\x20\x09-\x0d]*")
    for row in frame.select("i", pii.places(F.col("text"), pii.TOKEN).alias("p"), pii.in_context(F.col("text"), pii.TOKEN).alias("c")).collect():
        want = [(m.start(), m.end(), m[0]) for m in plain.finditer(texts[row.i])]
        assert [(x.start, x.end, x.token) for x in row.p] == want
        assert [(x.start, x.end, x.token) for x in row.c] == want
        for x in row.c:
            assert texts[row.i][: x.start].endswith(x.before) and texts[row.i][x.end :].startswith(x.after)
            assert x.start < 3 or x.before and x.before[-1] == texts[row.i][x.start - 1]


def test_overlaps_against_all_pairs(spark):
    r = random.Random(4)
    rows = []
    for i in range(120):
        spans = [(s, s + r.randrange(1, 9)) for s in (r.randrange(100) for _ in range(r.randrange(8)))]
        cands = [(s, s + r.randrange(1, 9), 5, 7) for s in (r.randrange(100) for _ in range(r.randrange(12)))]
        rows.append((i, spans, cands))
    frame = spark.createDataFrame(rows, "i int, spans array<struct<start:int,end:int>>, cands array<struct<start:int,end:int,votes:int,shape:int>>")
    for row in frame.select("i", pii.free_of(F.col("cands"), F.col("spans")).alias("x")).collect():
        _, spans, cands = rows[row.i]
        assert sorted(tuple(c) for c in row.x) == sorted(c for c in cands if not any(s < c[1] and e > c[0] for s, e in spans))


def test_no_upper_bounds(spark):
    secret, name = "z" * 300, "Anna " + "Q" + "u" * 80
    texts = {1: f"password: {secret} and on", 2: f"signed: {name} here", 3: "a" * 90 + " at " + "b" * 90 + " dot com"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.id: [(w.start, w.end) for w in r.wides] for r in pii.scan(docs).collect()}
    assert got == {1: [(10, 10 + len(secret))], 2: [(8, 8 + len(name))], 3: [(0, len(texts[3]))]}


def test_gazetteers_from_a_table(spark):
    table = spark.createDataFrame([("given", "Zorblax"), ("surname", "Quux"), ("given", " "), (None, "x")], "kind string, word string")
    names = pii.Gazetteers.of(table)
    docs = spark.createDataFrame([(1, "signed: Zorblax Quux, here"), (2, "signed: Anna Smith, here")], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.pii(docs, names=names).collect()}
    assert got == {1: "name:8:20", 2: ""}
    with pytest.raises(ValueError):
        pii.Gazetteers.of(spark.createDataFrame([("colour", "red")], table.schema))
