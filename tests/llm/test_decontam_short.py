"""Items too short for the usual q-grams, and every place of an item."""

from ledgerline.llm import decontam


def test_short_items_and_all_places(spark):
    items = {1: "yes", 2: "a twenty byte item x", 3: "zoë 5", 4: "the one and only sentence of this benchmark item", 5: " .. ", 6: "ab"}
    texts = {
        1: "He said: YES! And yes again; yesterday not.",
        2: "see a twenty bite item x here",
        3: "Zoë\n5",
        4: "The one and only sentence of this benchmark item. Then the one and only sentence of this benchmark itm, and the one and only sentence of this benchmark item",
        5: "eyes abc a b",
        6: "ab",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, texts[r.doc_id][r.start : r.end].lower(), r.edits) for r in decontam.contaminated(docs, bench).collect())
    full = items[4]
    assert got == [(1, 1, "yes", 0), (1, 1, "yes", 0), (2, 2, "a twenty bite item x", 1), (3, 3, "zoë\n5", 0), (4, 4, full, 0), (4, 4, full, 0), (4, 4, full.replace("item", "itm"), 1), (6, 6, "ab", 0)]
    assert {r.doc_id for r in decontam.decontaminated(docs, bench).collect()} == {5}
