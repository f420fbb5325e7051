"""Token ids equal those of the vocabulary's own file, also where a text says an added token."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from ledgerline.llm import packing

TEXTS = ["a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|>\n\n y<|endoftext|><|endoftext|> z", "<|endoftext", "\t  \n\n   é 漢字 \U0001f600  ", " " * 700, "ab" * 3000, "'ll don't I'VE 12345 ***", ""]


def test_ids(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.packed(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), capacity=1 << 20).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        ids = [*tokenizer.encode(TEXTS[r.doc_id], add_special_tokens=False).ids, 0]
        assert (r.length, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
