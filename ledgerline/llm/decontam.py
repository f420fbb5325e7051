"""Benchmark decontamination by q-gram filtering in overlapping diagonal bands.

Texts and benchmark items are folded (A-Z lower-cased, every run of other ASCII
characters than letters and digits to one blank).  An item of m bytes that
stands in a text with at most k edits (k: ``error_rate`` of m) shares at least
m + 1 - q - kq of its q-grams with the text, on diagonals no more than 2k apart.
q is ``q``, or less for items so short that the bound would say nothing.

1. Texts are scanned with a rolling hash against the items' q-grams.  An item's
   most frequent q-grams (half as many as it must share) are left out there, so
   that a phrase common to many items does not bring them all up; an item must
   share the rest of the bound.
2. Pairs left are counted in bands of twice 2k + 1 diagonals that overlap by
   half; bands that meet the bound are verified by banded alignment.

The filter loses nothing.  Items are taken to the tasks in blocks of at most
``block_bytes`` of text (or a single longer item), one pass over the documents
for each, so what a task holds has a fixed bound.

Null or empty texts and items match nothing.  An item of fewer than ``q`` bytes
after folding stands in a text where its very words stand.  Repeated rows of
documents are reported once each.  Distances count bytes of the folded UTF-8
text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import BASE_INVERSE, LOWER, U, Texts, _powers_of, code_points, mix, prefix_sums, rounds
from .store import bounded_batches

Q = 12
ERROR_RATE = 0.05
BLOCK_BYTES = 16 << 20
FOLD = LOWER.copy()
FOLD[[c for c in range(128) if not chr(c).isalnum()]] = 32
_TABLE_BITS = 22


def fold(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, the original place of each, and where each text begins in them."""
    folded = FOLD[texts.data]
    blank = folded == 32
    before = np.ones_like(blank)
    before[1:] = blank[:-1]
    border = texts.starts[:-1]
    before[border[border < len(blank)]] = True
    place = np.flatnonzero(~(blank & before))
    return folded[place], place, np.searchsorted(place, texts.starts)


def _grams(data: np.ndarray, q: int) -> np.ndarray:
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, U)
    sums = prefix_sums(data)
    return mix((sums[q:] - sums[:-q]) * _powers_of(BASE_INVERSE, n))


class Items:
    """An index of the q-grams of items that share q."""

    def __init__(self, ids: list, bodies: list[bytes], q: int, edits: list[int], whole_words: bool):
        self.q, self.ids, self.items, self.whole_words = q, ids, bodies, whole_words
        self.lengths = np.array([len(b) for b in bodies], dtype=np.int64)
        self.edits = np.array(edits, dtype=np.int64)
        self.least = self.lengths + 1 - q - self.edits * q
        self.grams = [_grams(np.frombuffer(b, dtype=np.uint8), q) for b in bodies]
        every = np.concatenate(self.grams)
        item = np.repeat(np.arange(len(bodies)), self.lengths + 1 - q)
        common, place = np.unique(every, return_inverse=True)
        frequency = np.bincount(place)[place]
        # each item's grams, most frequent first: as many as half its bound are not looked up
        order = np.lexsort((place, -frequency, item))
        rank = np.arange(len(every)) - np.repeat(np.cumsum(self.lengths + 1 - q) - (self.lengths + 1 - q), self.lengths + 1 - q)
        probe = order[rank >= (self.least // 2)[item[order]]]
        probe = probe[np.argsort(every[probe], kind="stable")]
        self.wanted = self.least - self.least // 2
        self.keys, self.first = np.unique(every[probe], return_index=True)
        self.first = np.append(self.first, len(probe))
        self.item = item[probe]
        self.table = np.zeros(1 << _TABLE_BITS, dtype=bool)
        self.table[(self.keys >> U(64 - _TABLE_BITS)).astype(np.int64)] = True


def indexes(ids: list, texts: list[str], q: int, error_rate: float) -> list[Items]:
    """One index for each q that the items need."""
    groups: dict[tuple[int, bool], list] = {}
    for item, text in zip(ids, texts):
        raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
        body = fold(Texts(raw, np.array([0, len(raw)])))[0].tobytes().strip(b" ")
        if body:
            edits = int(len(body) * error_rate)
            groups.setdefault((min(q, max(len(body) // (edits + 1), 1)), len(body) < q), []).append((item, body, edits))
    return [Items([x[0] for x in group], [x[1] for x in group], own, [x[2] for x in group], whole) for (own, whole), group in sorted(groups.items())]


def align(item: np.ndarray, region: np.ndarray, free: int | None = None) -> tuple[int, int]:
    """Least edits that turn ``item`` into a part of ``region``, and where that part ends.

    One row for each byte of the item over the band of diagonals that the region spans.  A part may
    begin anywhere, or after ``free`` bytes at a cost of one for each byte more.
    """
    width = max(len(region) - len(item), 0) + 1
    index = np.arange(width)
    padded = np.full(len(item) + width, -1, dtype=np.int16)
    padded[: len(region)] = region
    cost = np.zeros(width, dtype=np.int64) if free is None else np.maximum(index - free, 0)
    for i, byte in enumerate(item):
        step = cost + (padded[i : i + width] != byte)
        step[:-1] = np.minimum(step[:-1], cost[1:] + 1)
        cost = np.minimum.accumulate(step - index) + index
    best = int(cost.argmin())
    return int(cost[best]), min(len(item) + best, len(region))


def _verify(items: Items, item: int, body: np.ndarray, low: int, high: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the item among the diagonals [low, high) of a folded text."""
    k, m = int(items.edits[item]), int(items.lengths[item])
    a, b = max(0, low - k), min(len(body), high + m + k)
    region = body[a:b]
    found = region.tobytes().find(items.items[item])
    if found >= 0:
        return 0, a + found, a + found + m
    wanted = np.frombuffer(items.items[item], dtype=np.uint8)
    # bytes that equal none stand for what lies outside of the text, so that a loss at its borders has its diagonals
    framed = lambda part, before, after: np.pad(part.astype(np.int16), (before, after), constant_values=-1)
    before = a - (low - k)
    edits, end = align(wanted, framed(region, before, high + m + k - b))
    if edits > k:
        return None
    end = min(end - before, len(region))
    part = region[max(0, end - m - k) : end][::-1]
    back = align(wanted[::-1], framed(part, k, m + k - len(part)), free=k)[1] - k
    return edits, a + end - min(back, len(part)), a + end


#: Looked-up q-grams that are spread to items at a time.
_CHUNK = 1 << 21


def _pairs(items: Items, grams: np.ndarray, body: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, item) pairs that share enough looked-up q-grams."""
    at = np.flatnonzero(items.table[(grams >> U(64 - _TABLE_BITS)).astype(np.int64)])
    key = np.searchsorted(items.keys, grams[at])
    real = items.keys[np.minimum(key, len(items.keys) - 1)] == grams[at]
    at, key = at[real], key[real]
    text = np.searchsorted(begin, at, side="right") - 1
    inside = at + items.q <= begin[text + 1]
    key, text = key[inside], text[inside]
    many = items.first[key + 1] - items.first[key]
    ends, pairs, counts = np.cumsum(many), np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(_CHUNK, ends[-1] if len(ends) else 0, _CHUNK)), len(many)))
    low = 0
    for high in cuts.tolist():
        m = many[low:high]
        entry = np.repeat(items.first[key[low:high]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        new, n = np.unique(np.repeat(text[low:high], m) * len(items.ids) + items.item[entry], return_counts=True)
        both, where = np.unique(np.concatenate((pairs, new)), return_inverse=True)
        counts = np.bincount(where, weights=np.concatenate((counts, n)), minlength=len(both)).astype(np.int64)
        pairs, low = both, high
    pairs = pairs[counts >= items.wanted[pairs % len(items.ids)]] if len(pairs) else pairs
    return pairs // len(items.ids), pairs % len(items.ids)


def _diagonals(wanted: np.ndarray, own: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many q-grams an item shares with a text on each diagonal, the lowest being that of the item's last q-gram."""
    ranked = own[order]
    low, high = np.searchsorted(ranked, wanted, side="left"), np.searchsorted(ranked, wanted, side="right")
    out = np.zeros(len(own) + len(wanted), dtype=np.int64)
    many = high - low
    ends = np.cumsum(many)
    a = 0
    while a < len(wanted):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _CHUNK, side="right")))
        m = many[a:b]
        place = order[np.repeat(low[a:b], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
        out += np.bincount(place - np.repeat(np.arange(a, b), m) + len(wanted), minlength=len(out))
        a = b
    return out


def _occurrences(items: Items, j: int, own: np.ndarray, grams: np.ndarray, order: np.ndarray, one: bool) -> list[tuple[int, int, int]]:
    """(edits, start, end) of the occurrences of item j that do not overlap, best first; with ``one`` any single one."""
    if items.whole_words:
        text, item = b" " + own.tobytes().strip(b" ") + b" ", b" " + items.items[j] + b" "
        lead = int(len(own) > 0 and own[0] == 32)
        out, at = [], text.find(item)
        while at >= 0:
            out.append((0, at + lead, at + lead + len(item) - 2))
            at = -1 if one else text.find(item, at + len(item) - 1)
        return out
    width = 2 * int(items.edits[j]) + 1
    counts = _diagonals(items.grams[j], grams, order)
    sums = np.concatenate(([0], np.cumsum(counts)))
    begin = np.arange(-width, len(counts), width)
    inside = lambda x: np.clip(x, 0, len(counts))
    shared = sums[inside(begin + 2 * width)] - sums[inside(begin)]
    good = np.flatnonzero(shared >= items.least[j])
    found = []
    for b in good[np.argsort(-shared[good], kind="stable")].tolist():
        low = int(begin[b]) - len(items.grams[j])
        got = _verify(items, j, own, low, low + 2 * width)
        if got:
            found.append(got)
            if one:
                break
    out: list[tuple[int, int, int]] = []
    for edits, start, end in sorted(set(found)):
        if all(end <= a or start >= b for _, a, b in out):
            out.append((edits, start, end))
    return out


def _found(index: list[Items], texts: Texts, one: bool = False) -> Iterator[tuple[int, object, int, int, int]]:
    """(text, item id, start, end, edits), places as bytes of the original text; with ``one`` an occurrence for each text and item."""
    body, place, begin = fold(texts)
    for items in index:
        if len(body) < items.q:
            continue
        grams = _grams(body, items.q)
        seen, own, order = -1, None, None
        for t, j in zip(*(x.tolist() for x in _pairs(items, grams, body, begin))):
            if t != seen:
                seen, own = t, grams[begin[t] : max(begin[t + 1] - items.q + 1, begin[t])]
                order = np.argsort(own, kind="stable")
            for edits, start, end in _occurrences(items, j, body[begin[t] : begin[t + 1]], own, order, one):
                first = place[begin[t] + start] - texts.starts[t]
                last = place[begin[t] + end - 1] - texts.starts[t] + 1
                yield t, items.ids[j], int(first), int(last), edits


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[list, list]]:
    """Ids and texts of the items, in blocks of bounded size."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).where("length(text) > 0")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    # a block's expected text is half the bound, so that uneven hashing stays within it
    blocks = max(1, -(-2 * total // block_bytes))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        yield [r["item"] for r in rows], [r["text"] for r in rows]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", q: int = Q, error_rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per place where an item stands in a document: doc_id, item_id, start, end (code points of the
    original text, end exclusive) and edits.  Of places that overlap the one with the fewest edits counts."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for block in _blocks(benchmark, item_col, item_text_col, block_bytes):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def of(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = indexes(*held.value, q, error_rate)
            for batch in batches:
                rows: list[list] = [[], [], [], [], []]
                for a, _, texts in rounds(batch.column(1)):
                    points = None
                    for t, j, start, end, edits in _found(index, texts):
                        points = code_points(texts.data) if points is None else points
                        base = int(texts.starts[t])
                        for column, value in zip(rows, (batch.column(0)[a + t].as_py(), j, int(points[base + start] - points[base]), int(points[base + end] - points[base]), edits)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], ["doc_id", "item_id", "start", "end", "edits"])

        found = bounded_batches(texts).mapInArrow(of, "doc_id long, item_id long, start long, end long, edits long")
        out = found if out is None else out.unionByName(found)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", q: int = Q, error_rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows that hold an item, whatever their other columns; passes over the rows, no shuffle."""
    at = docs.columns.index(text_col)
    for block in _blocks(benchmark, item_col, item_text_col, block_bytes):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def of(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = indexes(*held.value, q, error_rate)
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                for a, _, texts in rounds(batch.column(at)):
                    clean[[a + t for t, *_ in _found(index, texts, one=True)]] = False
                yield batch.filter(pa.array(clean))

        docs = bounded_batches(docs).mapInArrow(of, docs.schema)
    return docs
