"""Items with lost bytes at the borders of a text, against all alignments."""

import pytest

from ledgerline.llm import decontam

from .conftest import prose

ITEM = " ".join(prose(77, 40).replace("\n", " ").replace(".", "").split())
K = int(0.05 * len(ITEM))


def least(item, text):
    """Edits of the best part of the text, and of the text as a whole."""
    part, whole = [0] * (len(text) + 1), list(range(len(text) + 1))
    for c in item:
        rows = []
        for row in (part, whole):
            new = [row[0] + 1]
            for j, d in enumerate(text):
                new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
            rows.append(new)
        part, whole = rows
    return min(part), whole[-1]


def cases():
    n = len(ITEM)
    for loss in (1, 6, K, K + 1):
        for name, at in (("begin", 0), ("early", 20), ("middle", n // 2), ("late", n - 40), ("end", n - loss)):
            yield f"-{loss} {name}", ITEM[:at] + ITEM[at + loss :]
    yield "+6 middle", ITEM[: n // 2] + "zqzqzq" + ITEM[n // 2 :]
    yield "two losses", ITEM[5 : n // 2] + ITEM[n // 2 + K - 5 :]
    yield "loss and change", ITEM[:40] + ITEM[44:90] + "q" + ITEM[91:]


@pytest.mark.parametrize("before, after", [("", ""), (prose(5, 20) + "\n", ""), ("", "\n" + prose(6, 20)), ("ab ", " cd"), (prose(7, 20) + " ", " " + prose(8, 20))])
def test_losses(spark, before, after):
    texts = {i: before + body + after for i, (_, body) in enumerate(cases())}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.contaminated(docs, bench).collect()}
    fold = lambda t: decontam.fold(decontam.Texts(*_raw(t)))[0].tobytes().decode()
    for i, (name, _) in enumerate(cases()):
        edits = least(fold(ITEM), fold(texts[i]))[0]
        assert (i in got) == (edits <= K), (name, edits)
        if i in got:
            assert got[i].edits == edits and least(fold(ITEM), fold(texts[i][got[i].start : got[i].end]))[1] <= edits + 1, name
    left = {r.doc_id for r in decontam.decontaminated(docs, bench).collect()}
    assert left == set(texts) - set(got)


def _raw(text):
    import numpy as np

    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    return raw, np.array([0, len(raw)])
