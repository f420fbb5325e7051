"""Weights, noise, draw and ranks against a plain version."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ledgerline.llm import kernel, resampling

from .conftest import prose

AZ = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def bag(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain(docs, target, percent=5, least=20):
    bags = {i: bag(t) for i, t in docs.items()}
    s, t = [0] * 10_000, [0] * 10_000
    for into, all_ in ((s, [b for _, b in bags.values()]), (t, [bag(x)[1] for x in target])):
        for b in itertools.chain(*all_):
            into[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10_000) / ((a + 1) * (sum(t) + 10_000)))) for a, b in zip(s, t)]
    out = {}
    for i, (n, b) in bags.items():
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x] for x in b)
        out[i] = (n, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
    able = sorted((i for i in out if out[i][0] >= least), key=lambda i: (-out[i][3], i is None, i))
    rank = {i: k + 1 for k, i in enumerate(able[: percent * len(able) // 100])}
    return {i: (*x[1:], rank.get(i)) for i, x in out.items()}


TEXTS = {i: prose(i, 5 + 3 * i % 90) for i in range(200)}
TEXTS |= {300: None, 301: "", 302: " \n- !", 303: "x" * 70_000 + " Y" * 3, 304: "é漢 \U0001f600 Ab9-cd_E " * 40, 305: prose(3, 20_000), -7: prose(4, 60), None: prose(5, 60), 1 << 40: prose(4, 60)}
TARGET = [prose(1000 + i, 30) for i in range(10)] + [None, ""]


@pytest.mark.parametrize("percent", [0, 5, 37, 100])
def test_against_a_plain_version(spark, percent):
    docs = spark.createDataFrame([(i, t, 1, "w") for i, t in TEXTS.items()], "doc_id long, text string, score int, weight string").repartition(4)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in resampling.resampled(docs, target, percent=percent).collect()}
    assert got == plain(TEXTS, TARGET, percent)


def test_empty_tables_and_repeated_rows(spark):
    docs = spark.createDataFrame([(i % 7, TEXTS[20 + i % 7]) for i in range(70)], "doc_id long, text string")
    none = docs.limit(0)
    assert resampling.resampled(none, docs).count() == 0
    rows = resampling.resampled(docs, none.select("text"), percent=50).collect()
    assert len(rows) == 70 and sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 36))
    low = min(r.score for r in rows if r["rank"])
    assert all(r.score <= low for r in rows if not r["rank"])
    lone = resampling.resampled(spark.createDataFrame([(None, prose(1, 40))] * 4, "doc_id long, text string"), docs, percent=50).collect()
    assert sorted(r["rank"] or 0 for r in lone) == [0, 0, 1, 2]


def test_border_by_digits(spark):
    """The k-th key among ties, wide ids and nulls, for every k."""
    r = random.Random(1)
    keys = [(r.choice([-5_000_000, 0, 1, 77, 1 << 40]), r.choice([None, -(1 << 50), 0, 3, 1 << 60])) for _ in range(60)]
    frame = spark.createDataFrame(keys, "score long, doc_id long")
    order = sorted(keys, key=lambda x: (-x[0], x[1] is None, x[1]))
    for k in (1, 2, 17, 31, 59, 60):
        assert resampling.border(frame, k) == order[k - 1]
    assert resampling.border(frame, 0) is None


def test_crc_of_features():
    texts = ["a", "", "Ab cd-EF " * 50, "q" * 5_000 + " r", "é 漢字 x1y2", "one two", "z"]
    (_, _, held), = kernel.rounds(pa.array(texts))
    bucket, owner, counts = resampling.features(held)
    assert counts.tolist() == [bag(t)[0] for t in texts]
    assert all(sorted(bucket[owner == k].tolist()) == sorted(bag(t)[1]) for k, t in enumerate(texts))
    (_, _, none), = kernel.rounds(pa.array([""]))
    assert len(resampling.features(none)[0]) == 0 and np.array_equal(resampling.features(none)[2], [0])
