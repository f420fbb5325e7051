"""Every operator on odd rows and on an empty table: no crash, one result row where one per document is promised."""

import pytest

from ledgerline.llm import decontam, license_scan, line_dedup, ngram_join, packing, pii, quality_rules, substring_dedup, toxicity, url_filter


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 1), (1, 1, 0), (6, 0, 0), (None, 1, 1), (9, None, None), (77, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "short"), (None, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")


PER_ROW = {
    "license": lambda d, x: license_scan.license_scan(d),
    "toxicity": lambda d, x: toxicity.toxicity(d, x[0]),
    "pii": lambda d, x: pii.pii(d),
    "ngram": lambda d, x: ngram_join.ngram_join(d),
    "quality": lambda d, x: quality_rules.quality(d),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_per_document(name, odd, none, labels, items):
    assert PER_ROW[name](odd, (labels, items)).count() == odd.count()
    assert PER_ROW[name](none, (labels, items)).count() == 0


def test_line_dedup(odd, none):
    removed = {(r.doc_id, r.line) for r in line_dedup.duplicate_lines(odd).collect()}
    assert {i for i, _ in removed} <= {5, 8, 9, 10} and 10 in {i for i, _ in removed}
    out = line_dedup.deduplicated(odd)
    assert out.columns == odd.columns
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert 10 not in ids and ids.count(6) == 2 and ids.count(None) == 2
    assert line_dedup.deduplicated(none).count() == 0


def test_substring_dedup(odd, none):
    spans = substring_dedup.repeated_spans(odd)
    assert 10 in {r.doc_id for r in spans.collect()} and 6 not in {r.doc_id for r in spans.collect()}
    assert substring_dedup.without_spans(odd, spans).columns == odd.columns
    assert substring_dedup.repeated_spans(none).count() == 0


def test_decontamination(odd, none, items):
    assert decontam.contaminated(odd, items).count() == 0
    assert decontam.decontaminated(odd, items).count() == odd.count()
    assert decontam.contaminated(none, items).count() == 0 and decontam.contaminated(odd, items.limit(0)).count() == 0


def test_packing(odd, none):
    rows = packing.packed(odd).collect()
    assert len([r for r in rows if r.doc_id == 6]) == 2
    assert all(r.length >= 1 for r in rows) and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert packing.packed(none).count() == 0


def test_toxic_filter(odd, none, labels):
    out = toxicity.without_toxic(odd, labels)
    assert out.columns == odd.columns and out.count() > 0
    assert toxicity.without_toxic(none, labels).count() == 0 and toxicity.toxicity(odd, labels.limit(0)).count() == odd.count()


def test_url_filter(spark):
    pages = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "no scheme", 1), (3, "http://A.NET/", 1), (3, "http://A.NET/", 1), (4, "x://" + "a" * 5000 + "/" + "b" * 5000, 1), (5, "http://u.example.net/en/1#a", 1), (6, "http://net", 1), (7, "https://www.Example.com/de/x?y", 1), (8, "a\nb://q.org/fr/é", 1)], "page_id long, url string, host int")
    got = {r.page_id: r for r in url_filter.url_filter(pages).collect()}
    assert got[3].rule == "net/" and got[3].verdict == "block" and got[3].host == "a.net"
    assert got[5].rule == "example.net/en/" and got[5].verdict == "allow"
    assert got[6].rule is None and got[6].path == ""
    assert got[7].rule == "example.com/de/" and got[7].path == "/de/x"
    assert got[8].rule == "org/fr/" and got[8].verdict == "allow"
    assert got[1].host == "" and got[1].verdict == "block"
    assert url_filter.url_filter(pages.limit(0)).count() == 0
