"""Vectorised text kernels for Arrow batches inside tasks.

A batch's texts are one run of bytes; word borders, word hashes and rolling
hashes are computed for all texts at once with NumPy.  Hashes are 64-bit:
polynomials modulo 2**64 with an odd base, so that the hash of any slice comes
from two prefix sums, finished by a mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text that one round of kernels takes; a longer single text is a round of its own.
ROUND_BYTES = 1 << 20

_powers: dict[str, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for the life of the worker."""
    got = _powers.get(str(base))
    if got is None or len(got) < n:
        steps = np.full(max(n, ROUND_BYTES + 1024), base, dtype=U)
        steps[0] = 1
        got = _powers[str(base)] = np.cumprod(steps, dtype=U)
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class Texts:
    """Bytes of many texts and where each begins."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        self.data = data
        self.starts = starts  # n + 1 entries

    def __len__(self) -> int:
        return len(self.starts) - 1


def rounds(column: pa.Array) -> Iterator[tuple[int, int, Texts]]:
    """Rows [a, b) of a string column as ``Texts`` of bounded size; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64, count=n + 1 + column.offset)[column.offset :]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + ROUND_BYTES, side="right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b, Texts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        a = b


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Blanks of the contracts' words: space and the bytes 9 to 13.
BLANK = np.zeros(256, dtype=bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True


def words(texts: Texts, breaks: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of the first word of each text (n + 1 entries)."""
    inside = ~breaks[texts.data]
    before = np.empty_like(inside)
    if len(inside):
        before[0] = False
        before[1:] = inside[:-1]
        border = texts.starts[:-1]
        before[border[border < len(inside)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros_like(inside)
    if len(inside):
        after[:-1] = inside[1:]
        border = texts.starts[1:-1] - 1
        after[border[border >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, texts.starts)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, dtype=U)
    np.cumsum((data.astype(U) + U(1)) * _powers_of(BASE, len(data)), out=out[1:])
    return out


def slices(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of slices, the same wherever a slice stands."""
    return mix((sums[ends] - sums[starts]) * _powers_of(BASE_INVERSE, len(sums))[starts] + (ends - starts).astype(U))


def word_hashes(texts: Texts, data: np.ndarray, breaks: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of ``data`` (the texts' bytes after folding), and the first word of each text."""
    starts, ends, first = words(texts, breaks)
    return slices(prefix_sums(data), starts, ends), first


def shingle_sets(texts: Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles, and the first of each text (n + 1 entries).

    A text of fewer than k words has one shingle, its whole sequence; one without words has none.
    """
    hashes, first = word_hashes(texts, LOWER[texts.data])
    counts = np.diff(first)
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    at = np.concatenate(([0], np.cumsum(sizes)))
    text_of = np.repeat(np.arange(len(counts)), sizes)
    begin = first[:-1][text_of] + (np.arange(at[-1]) - at[:-1][text_of])
    length = np.minimum(counts, k)[text_of]
    out = length.astype(U) * U(0xD6E8FEB86659FD93)
    padded = np.concatenate((hashes, np.zeros(k, dtype=U)))
    for j in range(k):
        out += np.where(j < length, padded[begin + j], U(0)) * U(pow(0xA0761D6478BD642F, j + 1, 1 << 64) | 1)
    out = mix(out)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a > 1:
            out[a:b].sort()
    fresh = np.ones(len(out), dtype=bool)
    fresh[1:] = (out[1:] != out[:-1]) | (text_of[1:] != text_of[:-1])
    return out[fresh], np.concatenate(([0], np.cumsum(np.bincount(text_of[fresh], minlength=len(counts)))))


def code_points(data: np.ndarray) -> np.ndarray:
    """Number of code points before each byte (n + 1 entries)."""
    out = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
