"""Equal lines of any length go; lines of few words have no edits."""

import pytest

import corpus_pipeline
from ledgerline.llm import line_dedup

TEXTS = {
    1: "Read more\na line of mine that has words\n漢字文章的一行",
    2: "another line with words of its own\n  read  MORE\n漢字文章的一行\n\n \nnot read more",
    3: "the third one has its own words\nread more\nnot read it\nxx\nxx",
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")


def test_equal_short_lines_go(docs, spark):
    left = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    assert left == {1: TEXTS[1], 2: "another line with words of its own\n\n \nnot read more", 3: "the third one has its own words\nnot read it\nxx"}


def test_short_lines_have_no_edits(docs):
    got = {(r.doc_id, r.line): (r.keeper_id, r.keeper_line, r.edits) for r in line_dedup.duplicate_lines(docs).collect()}
    assert got == {(2, 1): (1, 0, 0), (2, 2): (1, 2, 0), (3, 1): (1, 0, 0), (3, 4): (3, 3, 0)}
