"""What the pipeline's line dedup leaves of a document that loses lines."""

import pytest

import corpus_pipeline
from ledgerline.llm import line_dedup

LINE = "all of this stands in the first document"


@pytest.fixture(scope="module")
def left(spark):
    texts = {
        1: LINE,
        2: f"{LINE}\nof my own\nand again mine\n漢字文章的一行",
        3: f"{LINE}\n \t\n",
        4: f"{LINE}\n{LINE}\nx",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}


def test_unique_short_lines_stay(left):
    assert left[2] == "of my own\nand again mine\n漢字文章的一行" and left[4] == "x"


def test_documents_without_text_go(left):
    assert left[1] == LINE and set(left) == {1, 2, 4}


def test_very_many_removed_lines(spark):
    """Half of 60,000 lines go; what is left keeps its order."""
    lines = [f"line number {i} of this text" for i in range(60_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "short")], "doc_id long, text string")
    removed = spark.range(0, 60_000, 2).selectExpr("1L AS doc_id", "id AS line")
    out = {r.doc_id: r.text for r in line_dedup.without_lines(docs, removed).collect()}
    assert out == {1: "\n".join(lines[1::2]), 2: "short"}
