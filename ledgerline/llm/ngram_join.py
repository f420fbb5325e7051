"""N-gram Jaccard join by signature trees.

Documents link when the Jaccard similarity of their sets of k-word shingles
reaches num/den.  The search is exact:

1. Every text gives its set of shingle hashes, a fingerprint of the whole set
   (equal sets are one node from here on) and pigeonhole keys.  Two linked sets
   of sizes a and b differ in at most d elements; the universe is cut into more
   than d parts, so some part is the same in both.  The hash of each non-empty
   part, with its size band, is a key.  The few sets that leave so many parts
   empty that only empty parts may agree add the hashes of their prefix (their
   smallest elements), one of which any two linked sets share.
2. Nodes that share a key fall into one block (connected components over
   key-to-smallest-node edges, so a key of any frequency makes one row for each
   member; a task that meets a key again sends an edge to the first node it met
   instead of the key, so that a frequent key makes about a row for each task).
3. Each block is searched by signature trees: nodes carry the OR of their
   members' shingle bitmaps, the range of set sizes and the largest number of
   shingles that share a bit.  A dual traversal drops node pairs whose greatest
   possible overlap is too small, and pairs that are one component already.
   Signatures alone (about a byte for a shingle) go through this stage; what
   they leave are smaller blocks, mostly true families of near copies.
4. These are searched again by the same trees on the texts themselves.
   Links found become components.

Blocks over a bounded size first part into groups that share a key, so that
chains of chance do not bring sets together.  Of groups still too large every
member is first compared with the one of the smallest id, in chunks; what
links with it is one component.  The rest is cut into tiles by size band and
hash; a pair of tiles is a unit of its own if it may hold a link that is not
within that component, so no task holds more than two tiles.  Within one group
of that kind the number of units grows with the square of its tiles.

Nulls and empty texts have no shingles and link with nothing; their component
is their own id.  Repeated rows keep one output row each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .kernel import U, mix, rounds, shingle_sets, signed
from .store import bounded_batches, drop_since, keep, mark

#: Words of a shingle and the similarity of a link.
SHINGLE, NUM, DEN = 4, 85, 100
#: Sets and shingles of a tile at most, in expectation; a unit holds two tiles.
TILE_SETS, TILE_SHINGLES = 1024, 2_000_000
#: Members of a leaf and children of a node.
LEAF, FANOUT = 8, 8
#: Rows (of five numbers) that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Frequent keys of which one task remembers the first node.
SEEN_KEYS = 200_000
#: Fingerprints that one task remembers in order not to send keys of a set again.
SEEN_SETS = 500_000


class Bands:
    """Size bands and, for each, how many parts its sets are cut into.

    Linked sizes fall into one band or two that are adjacent.
    """

    def __init__(self, num: int, den: int, largest: int):
        self.lows, self.parts, self.differ = [1], [], []
        while self.lows[-1] <= largest:
            low = self.lows[-1]
            self.lows.append(max(low + 1, low * den // num + 1))
            high = self.lows[-1] - 1
            both = high + high * den // num
            differ = (den - num) * both // (den + num)
            parts = differ + 1
            empty = parts * math.exp(-low / parts)
            self.differ.append(differ)
            self.parts.append(parts + 1 + math.ceil(empty + 2 * math.sqrt(empty)))
        self.lows = np.array(self.lows)
        self.parts = np.array(self.parts)
        self.differ = np.array(self.differ)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lows, sizes, side="right") - 1


def _fingerprints(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate((np.zeros(1, U), np.cumsum(mix(sets ^ U(0x5851F42D4C957F2D)), dtype=U)))
    return mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(U))


def _keys(sets: np.ndarray, first: np.ndarray, take: np.ndarray, bands: Bands, num: int, den: int):
    """Keys of the texts ``take`` and, for each key, the text."""
    sizes = np.diff(first)
    mixed = mix(sets ^ U(0x2545F4914F6CDD1D))
    sums = np.concatenate((np.zeros(1, U), np.cumsum(mixed, dtype=U)))
    own = bands.of(np.maximum(sizes, 1))
    out, who = [], []
    for down in (0, 1):
        band = own - down
        rows = take[(band[take] >= 0) & (sizes[take] > 0)]
        rows = rows[bands.differ[band[rows]] > 0]
        if not len(rows):
            continue
        lengths = sizes[rows]
        at = np.repeat(first[rows], lengths) + (np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths))
        text = np.repeat(rows, lengths)
        # sets are sorted and the part follows the high bits, so that parts are runs
        part = ((sets[at] >> U(32)) * bands.parts[band[text]].astype(U)) >> U(32)
        new = np.ones(len(at), dtype=bool)
        new[1:] = (part[1:] != part[:-1]) | (text[1:] != text[:-1])
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(at))
        total = sums[at[end - 1] + 1] - sums[at[begin]]
        key_text = text[begin]
        out.append(mix(total + part[begin] * U(0x9FB21C651E98DF25) + (band[key_text].astype(U) + U(1)) * U(0xD1342543DE82EF95)))
        who.append(key_text)
        filled = np.bincount(key_text, minlength=len(sizes))[rows]
        for row in rows[filled <= bands.differ[band[rows]]].tolist():
            prefix = int(sizes[row]) - -(-num * int(sizes[row]) // den) + 1
            out.append(mix(sets[first[row] : first[row] + prefix] ^ U(0xBF58476D1CE4E5B9)))
            who.append(np.full(prefix, row))
    if not out:
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(who)


def _bands_for(cache: list, num: int, den: int, largest: int) -> Bands:
    if not cache or cache[0].lows[-1] <= largest:
        cache[:] = [Bands(num, den, max(1 << 20, 2 * largest))]
    return cache[0]


def shingle_nodes(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """Per row: id, n_shingles, the fingerprint ``node`` of its set (null for an empty set) and its signature."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in rounds(batch.column(1)):
                sets, first = shingle_sets(texts, k)
                sizes = np.diff(first)
                node = pa.array(signed(_fingerprints(sets, first)), mask=sizes == 0)
                signs = [Sign.of(sets[first[i] : first[i + 1]]) for i in range(b - a)]
                least = np.array([s.least for s in signs], dtype=U)
                columns = [pa.array(sizes), node, pa.array([s.excess for s in signs], pa.int32()), pa.array(signed(least)), pa.array([s.words.tobytes() for s in signs], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], ["id", "n_shingles", "node", "excess", "least", "sign"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return bounded_batches(rows).mapInArrow(of, "id long, n_shingles long, node long, excess int, least long, sign binary")


def _combined(key: np.ndarray, node: np.ndarray, known: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows (key, node), one for each key that is not ``known``, and edges (node, hub) for all others that hold a key.

    ``known`` are sorted keys and their first nodes; keys held by several nodes are added to it while it has room."""
    once, at, inverse, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    hub = node[at]
    place = np.minimum(np.searchsorted(known[0], once), max(len(known[0]) - 1, 0))
    old = known[0][place] == once if len(known[0]) else np.zeros(len(once), dtype=bool)
    hub[old] = known[1][place[old]]
    apart = node != hub[inverse]
    a, b = node[apart], hub[inverse][apart]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    more = np.flatnonzero(~old & (counts > 1))[: max(0, SEEN_KEYS - len(known[0]))]
    if len(more):
        keys = np.concatenate((known[0], once[more]))
        order = np.argsort(keys)
        known[:] = [keys[order], np.concatenate((known[1], hub[more]))[order]]
    return once[~old], hub[~old], a[new], b[new]


def _key_rows(docs: DataFrame, text_col: str, k: int, num: int, den: int) -> DataFrame:
    """Rows (key, node) and, with ``hub`` set, edges, whose key only spreads them."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: list = []
        seen: set[int] = set()
        known = [np.zeros(0, U), np.zeros(0, U)]
        for batch in batches:
            for _, _, texts in rounds(batch.column(0)):
                sets, first = shingle_sets(texts, k)
                nodes = _fingerprints(sets, first)
                take = np.sort(np.unique(nodes, return_index=True)[1])
                fresh = [i for i, node in zip(take.tolist(), nodes[take].tolist()) if node not in seen]
                if len(seen) < SEEN_SETS:
                    seen.update(nodes[fresh].tolist())
                largest = int(np.diff(first).max(initial=1))
                key, who = _keys(sets, first, np.array(fresh, dtype=np.int64), _bands_for(cache, num, den, largest), num, den)
                key, node, a, b = _combined(key, nodes[who], known)
                for keys, ends, hubs in ((key, node, None), (mix(a ^ U(0x94D049BB133111EB)), a, b)):
                    for c in range(0, len(keys), 200_000):
                        part = slice(c, c + 200_000)
                        hub = pa.nulls(len(keys[part]), pa.int64()) if hubs is None else pa.array(signed(hubs[part]))
                        yield pa.RecordBatch.from_arrays([pa.array(signed(keys[part])), pa.array(signed(ends[part])), hub], ["key", "node", "hub"])

    return bounded_batches(docs.select(F.col(text_col).cast("string").alias("text"))).mapInArrow(of, "key long, node long, hub long")


#: Bytes that hold a signature's least part; a signature has at least SPREAD bits for each element of its set.
LEAST_BITS, SPREAD = 64, 4


class Sign:
    """Size, signature (a bitmap as 64-bit words), elements that share a bit with another, and smallest element of a set."""

    __slots__ = ("excess", "least", "size", "words")

    def __init__(self, size: int, excess: int, least: int, words: np.ndarray):
        self.size, self.excess, self.least, self.words = size, excess, least, words

    @classmethod
    def of(cls, own: np.ndarray) -> Sign:
        width = max(LEAST_BITS, 1 << (SPREAD * len(own) - 1).bit_length()) if len(own) else LEAST_BITS
        bits = np.zeros(width, dtype=bool)
        bits[(own & U(width - 1)).astype(np.int64)] = True
        return cls(len(own), len(own) - int(np.count_nonzero(bits)), int(own[0]) if len(own) else 0, np.packbits(bits, bitorder="little").view(U))


def _widened(words: np.ndarray, width: int) -> np.ndarray:
    """A signature at a larger width: where an element may stand, repeated."""
    return words if len(words) == width else np.tile(words, width // len(words))


class Tree:
    """A signature tree, built bottom-up in order of size and smallest element.

    A node holds the OR of its members' signatures at their largest width, their least and largest size and the
    largest number of elements that share a bit.  Elements that two sets share fall on bits that both nodes have;
    all but as many as share bits fall on different ones, whatever the common width."""

    def __init__(self, signs: list[Sign], order: list[int]):
        self.order = order
        own = [signs[i] for i in order]
        #: of each level, members first: signatures, least and largest sizes, most shared bits
        self.levels = [([s.words for s in own], np.array([s.size for s in own]), np.array([s.size for s in own]), np.array([s.excess for s in own]))]
        self.stacks: dict[int, np.ndarray] = {}
        width = LEAF
        while len(self.levels[-1][1]) > 1:
            words, low, high, more = self.levels[-1]
            at = np.arange(0, len(low), width)
            joined = []
            for a in at.tolist():
                most = max(len(w) for w in words[a : a + width])
                joined.append(np.bitwise_or.reduce([_widened(w, most) for w in words[a : a + width]], axis=0))
            self.levels.append((joined, np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(more, at)))
            width = FANOUT

    def children(self, level: int, i: int) -> range:
        width = LEAF if level == 1 else FANOUT
        return range(i * width, min((i + 1) * width, len(self.levels[level - 1][1])))

    def stack(self, leaf: int) -> np.ndarray:
        """The signatures of a leaf's members as one array."""
        if leaf not in self.stacks:
            words = [self.levels[0][0][c] for c in self.children(1, leaf)]
            most = max(map(len, words))
            self.stacks[leaf] = np.array([_widened(w, most) for w in words])
        return self.stacks[leaf]


class Links:
    """Union-find over the sets of a unit."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets reach the similarity."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    place = np.searchsorted(y, x)
    shared = int((y[np.minimum(place, len(y) - 1)] == x).sum())
    return shared * den >= num * (len(x) + len(y) - shared)


def search(signs: list[Sign], left: list[int], right: list[int] | None, num: int, den: int, sets: list[np.ndarray] | None = None) -> Links:
    """Link all pairs of ``left`` (with ``right``: of one from each) whose similarity reaches num/den.

    Without ``sets`` pairs link that their signatures do not rule out.  Pairs that are one component already are
    not compared again.
    """
    links = Links(len(signs))
    by = lambda i: (signs[i].size, signs[i].least)
    one = Tree(signs, sorted(left, key=by))
    two = one if right is None else Tree(signs, sorted(right, key=by))

    def uniform(tree: Tree, level: int, i: int, memo: dict) -> int:
        """The component of all members, or -1."""
        if level == 0:
            return links.find(tree.order[i])
        known = memo.get((level, i))
        if known is not None:
            return links.find(known)
        root = -1
        for c in tree.children(level, i):
            other = uniform(tree, level - 1, c, memo)
            if other < 0 or root >= 0 and other != root:
                return -1
            root = other
        memo[level, i] = root
        return root

    def leaves(a: int, b: int, same: bool) -> None:
        """Compare the members of two leaves; their bounds come at once."""
        x, y = one.stack(a), two.stack(b)
        width = max(x.shape[1], y.shape[1])
        x, y = (s if s.shape[1] == width else np.tile(s, width // s.shape[1]) for s in (x, y))
        ca, cb = one.children(1, a), two.children(1, b)
        size_a, size_b = one.levels[0][1][ca.start : ca.stop], two.levels[0][1][cb.start : cb.stop]
        excess = np.minimum.outer(one.levels[0][3][ca.start : ca.stop], two.levels[0][3][cb.start : cb.stop])
        most = np.bitwise_count(x[:, None, :] & y[None, :, :]).sum(axis=2, dtype=np.int64) + excess
        most = np.minimum(most, np.minimum.outer(size_a, size_b))
        good = most * (num + den) >= num * np.add.outer(size_a, size_b)
        if same:
            good = np.triu(good, 1)
        for p, q in np.argwhere(good).tolist():
            i, j = one.order[ca.start + p], two.order[cb.start + q]
            if links.find(i) != links.find(j) and (sets is None or similar(sets[i], sets[j], num, den)):
                links.join(i, j)

    memos: tuple[dict, dict] = ({}, {})
    second = memos[0] if two is one else memos[1]
    for tree in {id(one): one, id(two): two}.values():
        if len(tree.levels) == 1:  # a single member is a leaf of its own
            words, low, high, more = tree.levels[0]
            tree.levels.append((list(words), low, high, more))
    stack = [(len(one.levels) - 1, 0, len(two.levels) - 1, 0)]
    while stack:
        la, a, lb, b = stack.pop()
        same = two is one and la == lb and a == b
        if not same:
            (bits_a, low_a, high_a, more_a), (bits_b, low_b, high_b, more_b) = one.levels[la], two.levels[lb]
            if high_a[a] * den < num * low_b[b] or high_b[b] * den < num * low_a[a]:
                continue
            x, y = bits_a[a], bits_b[b]
            width = max(len(x), len(y))
            most = int(np.bitwise_count(_widened(x, width) & _widened(y, width)).sum()) + int(min(more_a[a], more_b[b]))
            if min(most, int(high_a[a]), int(high_b[b])) * (num + den) < num * int(low_a[a] + low_b[b]):
                continue
        root = uniform(one, la, a, memos[0])
        if root >= 0 and root == uniform(two, lb, b, second):
            continue
        if la == 1 and lb == 1:
            leaves(a, b, same)
        elif same:
            kids = list(one.children(la, a))
            stack.extend((la - 1, c, la - 1, d) for k, c in enumerate(kids) for d in kids[k + 1 :])
            stack.extend((la - 1, c, la - 1, c) for c in kids)  # popped first: inner links spare cross pairs
        elif la > 1 and la >= lb:
            stack.extend((la - 1, c, lb, b) for c in one.children(la, a))
        else:
            stack.extend((la, a, lb - 1, d) for d in two.children(lb, b))
    return links


def against(hub: int, others: list[int], signs: list[Sign], num: int, den: int, sets: list[np.ndarray] | None) -> list[int]:
    """Those of ``others`` that link with ``hub``, as ``search`` links."""
    h, out = signs[hub], []
    for i in others:
        s = signs[i]
        if s.size * den < num * h.size or h.size * den < num * s.size:
            continue
        width = max(len(s.words), len(h.words))
        most = int(np.bitwise_count(_widened(s.words, width) & _widened(h.words, width)).sum()) + min(s.excess, h.excess)
        if min(most, s.size, h.size) * (num + den) >= num * (s.size + h.size) and (sets is None or similar(sets[i], sets[hub], num, den)):
            out.append(i)
    return out


#: How the members of a unit meet: two tiles, tiles of which one is absorbed, a chunk with the block's first member.
FREE, HALF, CHUNK = 0, 1, 2
#: side of a unit's rows where the two tiles are one
BOTH = 2


class Unit:
    """Members of one unit as its rows arrive, and its links."""

    def __init__(self, kind: int):
        self.kind, self.names, self.sides, self.signs, self.sets = kind, {}, [], [], []

    def add(self, node: int, side: int, sign: Sign, own: np.ndarray | None) -> None:
        if node in self.names:
            return
        self.names[node] = len(self.signs)
        self.sides.append(side)
        self.signs.append(sign)
        if own is not None:
            self.sets.append(own)

    def edges(self, num: int, den: int) -> pa.RecordBatch | None:
        """(a, b): stars of the unit's components."""
        left = [i for i, s in enumerate(self.sides) if s != 1]
        right = [i for i, s in enumerate(self.sides) if s == 1]
        names, sets = list(self.names), self.sets or None
        if not left or BOTH not in self.sides and not right or len(names) < 2:
            return None
        if self.kind == CHUNK:
            pairs = [(names[i], names[left[0]]) for i in against(left[0], right, self.signs, num, den, sets)]
        else:
            found = search(self.signs, left, None if BOTH in self.sides else right, num, den, sets)
            pairs = [(names[i], names[r]) for i in range(len(names)) if (r := found.find(i)) != i]
        return pa.RecordBatch.from_arrays([pa.array([p[s] for p in pairs], pa.int64()) for s in (0, 1)], ["a", "b"])


def _by_unit(rows: DataFrame, num: int, den: int, read) -> DataFrame:
    """Edges of rows (unit, kind, node, side, ...); ``read`` yields (place, sign, set) of a batch's rows."""
    rows = rows.repartition("unit").sortWithinPartitions("unit")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members = None, None
        for batch in batches:
            unit, kind, node, side = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            for i, sign, own in read(batch):
                if unit[i] != now:
                    if members is not None and (out := members.edges(num, den)) is not None:
                        yield out
                    now, members = unit[i], Unit(int(kind[i]))
                members.add(int(node[i]), int(side[i]), sign, own)
        if members is not None and (out := members.edges(num, den)) is not None:
            yield out

    return bounded_batches(rows).mapInArrow(of, "a long, b long")


def _wanted(units: DataFrame, *more: str) -> DataFrame:
    one = (F.col("unit.kind") == FREE) & (F.col("unit.band") == F.col("unit.other")) & (F.col("unit.i") == F.col("unit.j"))
    return units.select(F.xxhash64("unit").alias("unit"), F.col("unit.kind").alias("kind"), "node", F.when(one, BOTH).otherwise(F.col("side")).alias("side"), *more)


def possible_links(units: DataFrame, num: int, den: int) -> DataFrame:
    """Edges between nodes that signatures do not rule out, as stars; no text is read."""

    def read(batch: pa.RecordBatch) -> Iterator[tuple[int, Sign, None]]:
        size, excess, least = (batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5, 6))
        for i, sign in enumerate(batch.column(7)):
            yield i, Sign(int(size[i]), int(excess[i]), int(least[i]) & 0xFFFFFFFFFFFFFFFF, np.frombuffer(sign.as_py(), dtype=U)), None

    return _by_unit(_wanted(units, *SIGN_COLUMNS), num, den, read)


def _with_texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``wanted`` (rep, ...) with the texts of those ids; few rows by count go to the texts, else both are shuffled."""
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, "rep")


def links(docs: DataFrame, units: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int) -> DataFrame:
    """Edges (a, b) between nodes, as stars of each unit's components."""
    wanted = keep(_wanted(units, "rep"), "wanted")
    rows = _with_texts(docs, wanted, id_col, text_col).select("unit", "kind", "node", "side", "text")

    def read(batch: pa.RecordBatch) -> Iterator[tuple[int, Sign, np.ndarray]]:
        node = batch.column(2).to_numpy(zero_copy_only=False)
        for a, b, chunk in rounds(batch.column(4)):
            sets, first = shingle_sets(chunk, k)
            prints = signed(_fingerprints(sets, first))
            for i in range(a, b):
                if prints[i - a] == node[i]:  # else a repeated id with another text
                    own = sets[first[i - a] : first[i - a + 1]].copy()
                    yield i, Sign.of(own), own

    return _by_unit(rows, num, den, read)


def _sized(members: DataFrame, tile_sets: int, tile_shingles: int) -> tuple[DataFrame, DataFrame]:
    """Members of blocks that one unit holds, and members of larger blocks, these with their block's first member
    (``first``) and the number of chunks that it is cut into."""
    large = (F.count("*") > 2 * tile_sets) | (F.sum("size") > 2 * tile_shingles)
    chunks = F.ceil(F.greatest(F.count("*") / tile_sets, F.sum("size") / tile_shingles)).cast("int")
    total = keep(members.groupBy("block").agg(large.alias("large"), chunks.alias("chunks"), F.min(F.struct("rep", "node"))["node"].alias("first")).where("large").drop("large"), "large-blocks")
    return members.join(total, "block", "left_anti"), members.join(total, "block")


def _unit(kind, block, band, i, other, j) -> Column:
    return F.struct(block.alias("block"), F.lit(kind).alias("kind"), band.alias("band"), i.alias("i"), other.alias("other"), j.alias("j"))


def _whole(small: DataFrame, more: list[str]) -> DataFrame:
    """Units of blocks that are searched in one go."""
    zero = F.lit(0)
    return small.select("node", "rep", _unit(FREE, F.col("block"), zero, zero, zero, zero).alias("unit"), zero.alias("side"), *more)


def _chunks(large: DataFrame, more: list[str]) -> DataFrame:
    """Units of large blocks that compare a chunk of members with the block's first member; that one goes to every chunk."""
    rows = large.withColumn("is_hub", F.col("node") == F.col("first"))
    own = F.pmod(F.hash("node"), F.col("chunks")).cast("int")
    rows = rows.withColumn("chunk", F.explode(F.when(F.col("is_hub"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(own))))
    zero = F.lit(0)
    return rows.select("node", "rep", _unit(CHUNK, F.col("block"), zero, F.col("chunk"), zero, zero).alias("unit"), F.when(F.col("is_hub"), 0).otherwise(1).alias("side"), *more)


def _tiled(large: DataFrame, num: int, den: int, tile_sets: int, tile_shingles: int, more: list[str]) -> DataFrame:
    """Rows (node, size, rep, block, absorbed) to rows with ``unit`` and ``side``: the searches a set takes part in.

    Members are cut into tiles by size band, by ``absorbed`` (1: linked to the block's first member already) and
    by hash.  Two tiles meet if their bands are near, but not two tiles of absorbed members: those are one
    component."""
    ratio = math.log(den / num)
    band = F.floor(F.log(F.col("size").cast("double")) / F.lit(ratio)).cast("int")
    rows = large.select("node", "rep", "size", "block", "absorbed", band.alias("band"), *[c for c in more if c != "size"])
    count = F.ceil(F.greatest(F.count("*") / tile_sets, F.sum("size") / tile_shingles)).cast("int")
    tiles = rows.groupBy("block", "band", "absorbed").agg(count.alias("tiles"))
    # a log at a border may fall into either band; two bands away is then possible
    reach = (-2, -1, 0, 1, 2)
    spread = tiles.select("block", "absorbed", "tiles", F.explode(F.array(*[F.struct((F.col("band") - s).alias("band"), F.lit(s).alias("step")) for s in reach])).alias("x"))
    name = lambda flag, s: f"{'ra'[flag]}{s + 2}"
    around = spread.groupBy("block", F.col("x.band").alias("band")).agg(*[F.coalesce(F.max(F.when((F.col("absorbed") == flag) & (F.col("x.step") == s), F.col("tiles"))), F.lit(0)).alias(name(flag, s)) for flag in (0, 1) for s in reach])
    rows = rows.join(keep(around, "tiles"), ["block", "band"])
    free, b = F.col("absorbed") == 0, F.col("band")
    mine = F.pmod(F.hash("node"), F.when(free, F.col(name(0, 0))).otherwise(F.col(name(1, 0)))).cast("int")
    rows = rows.withColumn("i", mine)
    i = F.col("i")
    unit = lambda kind, b1, i1, b2, i2, side: F.struct(_unit(kind, F.col("block"), b1, i1, b2, i2).alias("unit"), F.lit(side).alias("side"))
    empty = F.array().cast("array<int>")

    def upto(on, n):
        return F.when(on & (n > 0), F.sequence(F.lit(0), n - 1)).otherwise(empty)

    def each(on, n, make):
        return F.transform(upto(on, n), make)

    joins = [each(free, F.col(name(0, 0)), lambda j: F.when(j >= i, unit(FREE, b, i, b, j, 0)).otherwise(unit(FREE, b, j, b, i, 1)))]
    for s in (1, 2):
        joins.append(each(free, F.col(name(0, s)), _maker(unit, FREE, b, i, s, 0)))
        joins.append(each(free, F.col(name(0, -s)), _maker(unit, FREE, b, i, -s, 1)))
    for s in reach:
        joins.append(each(free, F.col(name(1, s)), _maker(unit, HALF, b, i, s, 0)))
        joins.append(each(~free, F.col(name(0, s)), _maker(unit, HALF, b, i, s, 1)))
    return rows.select("node", "rep", F.explode(F.concat(*joins)).alias("x"), *more).select("node", "rep", "x.unit", "x.side", *more)


def _maker(unit, kind: int, band, i, step: int, side: int):
    """Units of a tile with tile j of the band ``step`` away; the first side of a unit comes first in its name."""
    if side == 0:
        return lambda j: unit(kind, band, i, band + step, j, 0)
    return lambda j: unit(kind, band + step, j, band, i, 1)


def _joined(small: DataFrame, large: DataFrame, read, num: int, den: int, tile_sets: int, tile_shingles: int, more: list[str]) -> DataFrame:
    """Edges among the members of every block, by ``read`` of units."""
    if not large.limit(1).count():
        return read(_whole(small, more))
    near = keep(read(_chunks(large, more)), "near-first")
    known = near.select(F.col("a").alias("node"), F.col("b").alias("block_first")).groupBy("node").agg(F.collect_set("block_first").alias("firsts"))
    flagged = large.join(known, "node", "left")
    absorbed = (F.col("node") == F.col("first")) | F.coalesce(F.array_contains("firsts", F.col("first")), F.lit(False))
    flagged = flagged.withColumn("absorbed", absorbed.cast("int"))
    return read(_whole(small, more).unionByName(_tiled(flagged, num, den, tile_sets, tile_shingles, more))).union(near)


def _by_key(edges: DataFrame, large: DataFrame) -> DataFrame:
    """Members of large blocks again, a block for each hub: sets that a chain of chance keys has brought together
    part, and those that share a key still meet.

    A set belongs to the hubs of its own keys.  Where a task has sent an edge instead of the key, it belongs to
    that edge's hub and to the hubs of the latter's keys."""
    own, sent = edges.where(~F.col("local")).select("node", "hub"), edges.where("local").select("node", "hub")
    beyond = sent.join(own.select(F.col("node").alias("hub"), F.col("hub").alias("next")), "hub").select("node", F.col("next").alias("hub"))
    itself = edges.select(F.col("hub").alias("node"), "hub")
    groups = own.union(sent).union(beyond).union(itself).distinct().withColumnRenamed("hub", "block")
    return keep(large.drop("block", "chunks", "first").join(groups, "node"), "key-groups")


SIGN_COLUMNS = ["size", "excess", "least", "sign"]


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, num: int = NUM, den: int = DEN, tile_sets: int = TILE_SETS, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """One row per row of ``docs``: its id, n_shingles and component_id, the smallest id reachable by links."""
    begin = mark()
    rows = keep(shingle_nodes(docs, id_col, text_col, k), "shingles")
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("rep"), F.max("n_shingles").alias("size"))
    keyed = _key_rows(docs, text_col, k, num, den)
    # one shuffle by key; each row meets the smallest node of its key (each task sends few rows of a key, see _key_rows)
    hub = F.coalesce("hub", F.min("node").over(Window.partitionBy("key")))
    edges = keep(keyed.select("node", hub.alias("hub"), F.col("hub").isNotNull().alias("local")).where("node <> hub").distinct(), "candidates")
    blocks = components(edges.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    signs = rows.select(F.col("id").alias("rep"), "node", "excess", "least", "sign")
    members = nodes.join(blocks.withColumnRenamed("component", "block"), "node").join(signs, ["rep", "node"]).dropDuplicates(["node"])
    members = keep(members.select("node", "rep", "block", *SIGN_COLUMNS), "members")
    small, large = _sized(members, tile_sets, tile_shingles)
    if large.limit(1).count():
        more_small, large = _sized(_by_key(edges, large), tile_sets, tile_shingles)
        small = small.unionByName(more_small)
    possible = keep(_joined(small, large, lambda units: possible_links(units, num, den), num, den, tile_sets, tile_shingles, SIGN_COLUMNS), "possible")

    # blocks that signatures leave, by texts
    left = components(possible).withColumnRenamed("component", "block")
    left = keep(members.select("node", "rep", "size").join(left, "node"), "left")
    small, large = _sized(left, tile_sets, tile_shingles)
    found = keep(_joined(small, large, lambda units: links(docs, units, id_col, text_col, k, num, den), num, den, tile_sets, tile_shingles, []), "links")
    classes = nodes.join(components(found), "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
    classes = keep(classes, "classes")
    least = keep(classes.groupBy("component").agg(F.min("rep").alias("component_id")), "class-ids")
    drop_since(docs.sparkSession, begin, "shingles", "classes", "class-ids")
    of_node = classes.join(least, "component").select("node", "component_id")
    out = rows.select("id", "n_shingles", "node").join(of_node, "node", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
