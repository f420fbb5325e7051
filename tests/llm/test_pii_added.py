"""Spans that the method adds: recall on planted ones, and no additions on plain prose."""

from ledgerline.llm import pii

from .conftest import prose

PLANTED = {
    "name": ["Anna Smith", "Dr. Robert Miller", "Maria L. Garcia"],
    "address": ["742 Evergreen Terrace", "12b Old Mill Road"],
    "contact": ["jane.doe at example dot com", "(415) 555-2671"],
    "secret": ["correct-horse", "9f86d081884c7d659a2feaa0c55ad015"],
}
BEFORE = {"name": "signed: ", "address": "lives at ", "contact": "phone: ", "secret": "password: "}


def test_added_spans(spark):
    rows, want, i = [], {}, 0
    for kind, texts in PLANTED.items():
        for planted in texts:
            text = prose(7_000 + i, 20).replace("\n", " ") + " " + BEFORE[kind] + planted + ", " + prose(8_000 + i, 20)
            rows.append((i, text))
            want[i] = f"{kind}:{text.index(planted)}:{text.index(planted) + len(planted)}"
            i += 1
    clean = [(1_000 + k, prose(9_000 + k, 60) + f" {k} items on page {k + 3}, In May The report of April Rain") for k in range(40)]
    got = {r.doc_id: r.spans for r in pii.pii(spark.createDataFrame(rows + clean, "doc_id long, text string")).collect()}
    missed = {i: (w, got[i]) for i, w in want.items() if w not in got[i].split(",")}
    assert not missed
    assert not {i: got[i] for i, _ in clean if got[i]}


def test_added_spans_do_not_touch(spark):
    text = "Mr. John Smith, 12 Main Street, Boston john.smith@example.com +1 (415) 555-2671 password=aB3dE5gH7jK9 Anna Smith"
    (row,) = pii.pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    ends = [(f.start, f.end) for f in row.found]
    assert ends == sorted(ends) and all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
    assert {"email", "phone", "name", "address"} <= {f.kind for f in row.found}
