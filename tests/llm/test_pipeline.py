"""The pipeline's stages on odd rows, and a whole run against what each stage must leave."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

from .conftest import prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean documents, toxic ones, exact and near copies, repeated lines and benchmark passages."""
    r, root = random.Random(9), tmp_path_factory.mktemp("corpus")
    docs, labels = {}, []
    for i in range(160):
        body = prose(20_000 + i, 60).replace("\n", " ").split(" ")
        if i % 5 == 0:
            body[r.randrange(60)] = r.choice(["idiot", "scum", "vermin"])
        docs[i] = " ".join(body)
        labels.append((i, 1, int(i % 5 == 0)))
    docs[201] = docs[1]  # an exact copy of one line: line dedup leaves nothing of it
    base = prose(30_001, 150).replace("\n", " ").split(" ")
    docs[210] = "\n".join(" ".join(base[k : k + 50]) for k in (0, 50, 100))
    edited = list(base)
    edited[20], edited[22], edited[120], edited[122] = "quux", "quuy", "quuz", "quuw"
    docs[211] = "\n".join(" ".join(edited[k : k + 75]) for k in (0, 75))
    docs[220] = docs[2] + "\n" + prose(40_000, 30).replace("\n", " ")  # loses its first line
    item = prose(50_000, 30).replace("\n", " ")
    docs[230] = prose(50_001, 20).replace("\n", " ") + " " + item + " " + prose(50_002, 20).replace("\n", " ")
    rows = [(i, t, "en", "s", len(t)) for i, t in docs.items()] + [(300, None, None, None, None), (301, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return f"file://{root}", docs


def test_whole_run(spark, folder):
    path, docs = folder
    rows = corpus_pipeline.run(spark, path).collect()
    left = dict(docs) | {300: "", 301: ""}
    for i in [*range(0, 160, 5), 201, 211, 230]:
        del left[i]
    left[220] = docs[220].split("\n")[1]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(left)
    for i, text in left.items():
        ids, at = [*tokenizer.encode(text, add_special_tokens=False).ids, 0], 0
        for r in sorted(by_doc[i], key=lambda r: r.piece):
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_stages_on_odd_rows(spark, odd, none, folder):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for frame in (docs, none.select(docs.columns)):
        before = frame.count()
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, folder[0])
            assert out.columns == docs.columns and out.count() <= before
        assert corpus_pipeline.pack(spark, frame, folder[0]).count() >= before
