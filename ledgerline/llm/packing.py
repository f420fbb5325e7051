"""Best-fit packing by the sum-of-squares rule.

Every document becomes token ids plus one end id.  A document longer than a
sequence is cut so that only its first piece may be short.  Pieces are dealt row by
row into shards of a bounded number of rows (the number of shards grows with
the table); within a shard, pieces are placed largest first, each where the sum
of the squared counts of open sequences per residual gap becomes smallest, the
tighter gap on a tie.  Sequences of different shards never mix, which costs at
most a few open sequences a shard.

Null texts count as empty: one piece that holds the end id alone.  Repeated rows
are packed as documents of their own.  Empty tables give no rows.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches, keep

CAPACITY = 2048
END_ID = 0
#: Mean rows of a shard, which one task packs.
SHARD_ROWS = 50_000

#: The vocabulary's added tokens; where a text says one it is that id, as in byte_bpe_50k.json.
ADDED = {"<|endoftext|>": 50256}

_encoders: dict[str, object] = {}


def _encoder(ranks_path: str | None):
    """Byte-level BPE of the public 50k vocabulary; with the added tokens a rank file gives the ids of the JSON one, faster."""
    import public_tokenizers
    import tiktoken

    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path not in _encoders:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)
    return _encoders[path]


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``length`` ids."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, length, capacity)]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, ranks_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks_path)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            kept: list[np.ndarray] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array(encoder.encode(text.as_py() or "", allowed_special="all") + [END_ID], dtype="<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + length]
                    for column, value in zip(rows, (doc, k, start, length, zlib.crc32(part.tobytes()))):
                        column.append(value)
                    if with_ids:
                        kept.append(part.astype(np.int32))
            columns = [pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return bounded_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))).mapInArrow(of, schema)


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each item, in the order given; lengths are 1 to ``capacity``."""
    count = np.zeros(capacity + 1, dtype=np.int64)  # open sequences by gap
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    used: list[int] = []
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, size in enumerate(lengths.tolist()):
        # change of the sum of squares, halved: joining gap g makes it g - size; gap 0 is closed and does not count
        change = 2 * (count[: capacity + 1 - size] - count[size:]) + 2
        change[0] -= 1 + 2 * count[0]
        change[count[size:] == 0] = np.iinfo(np.int64).max
        fresh = 2 * count[capacity - size] + 1 if size < capacity else 0
        best = int(change.argmin())
        if change[best] <= fresh:
            gap = best + size
            bin_ = open_by_gap[gap].pop()
            count[gap] -= 1
        else:
            gap, bin_ = capacity, len(used)
            used.append(0)
        sequence[i], offset[i] = bin_, used[bin_]
        used[bin_] += size
        if gap > size:
            open_by_gap[gap - size].append(bin_)
            count[gap - size] += 1
    return sequence, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Rows of ``pieces`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    ``pieces`` is a stored table: a task that is run again deals its rows as before."""
    shards = -(-max(pieces.count(), 1) // shard_rows)
    # by the row's place in the stored files, so that repeated rows and null ids spread too
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))

    def of(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        sequence, offset = place(shard["length"].to_numpy(), capacity)
        shard["sequence_id"] = shard.pop("shard").to_numpy() * (1 << 32) + sequence
        shard["offset"] = offset
        return shard

    return dealt.groupBy("shard").applyInPandas(of, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, ranks_path: str | None = None) -> DataFrame:
    """Tokenise, cut and pack ``docs``; the token counts pass the shared folder, the ids do not."""
    return pack(keep(pieces(docs, id_col, text_col, capacity, ranks_path), "pieces"), capacity, shard_rows)
