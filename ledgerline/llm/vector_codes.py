"""Product codes of vectors, trained by Lloyd rounds that filter entries with kd-trees.

A vector is cut into ``parts`` equal parts and each part position has a codebook
of its own.  In every round a task builds, for a bounded batch of vectors and
each part position, a kd-tree over that part with the box, the sum and the count
of every node.  Entries that cannot be the nearest for any point of a node's box
are dropped on the way down; where one entry is left, the whole subtree goes to
it by its cached sum and count.  Leaves compare what is left.  All nodes of a
level are handled at once.

Tasks give sums and counts per part and entry (bounded by the codebooks,
whatever the number of vectors), Spark adds them, and the driver receives one
row for each entry.  Trees live for one batch only: a lost executor costs its
running tasks.

Components become integers floor(``scale`` x).  Distances are whole numbers, so
that results do not depend on how vectors are dealt; ties go to the lower index.
Vectors that are null or hold null or non-finite components are dropped, also
those of another length than the vector with the smallest id has (no codebook
fits them).  Lengths that ``parts`` does not divide, and components beyond
2**24 after scaling (where summed squares leave 64 bits), raise an error.
A null id counts as the largest; repeated rows count once each; fewer vectors
than entries give smaller codebooks; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import keep

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Vectors over which one set of trees is built, and points of a leaf at most.
BATCH_VECTORS = 1 << 15
LEAF = 16
#: Largest component after scaling, so that a vector's squared distance has room in a long.
LARGEST = 1 << 24
#: Nodes whose boxes are held against all entries at once.
_NODES = 2048


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """(vec_id, label, q): the usable vectors as arrays of integers, stored."""
    x = F.col(vector_col).cast("array<double>")
    usable = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    rows = vectors.where(usable).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.transform(x, lambda v: F.floor(v * scale)).alias("q"))
    stored = keep(rows, "vectors")
    first = stored.agg(F.min_by(F.size("q"), F.struct(F.col("vec_id").isNull(), "vec_id", "q")).alias("n")).first()["n"]
    if first is None:
        return stored
    if first % parts:
        raise ValueError(f"{parts} equal parts of {first} components do not exist")
    fitting = stored.where(F.size("q") == first)
    if fitting.where(F.exists("q", lambda v: F.abs(v) > LARGEST)).limit(1).count():
        raise ValueError(f"a component is larger than {LARGEST} after scaling")
    return fitting


class Tree:
    """A kd-tree over points (n x d): leaves of at most LEAF points, halved by rank along the widest side.

    Level l has 2**l nodes; node i of it holds the points ``order[bound[l][i] : bound[l][i + 1]]``."""

    def __init__(self, points: np.ndarray):
        n, d = points.shape
        self.points, self.order = points, np.arange(n)
        self.bound = [np.array([0, n])]
        self.low, self.high = [], []
        while True:
            bound = self.bound[-1]
            ordered = points[self.order]
            self.low.append(np.minimum.reduceat(ordered, bound[:-1]))
            self.high.append(np.maximum.reduceat(ordered, bound[:-1]))
            if np.diff(bound).max() <= LEAF:
                break
            widest = (self.high[-1] - self.low[-1]).argmax(axis=1)
            node = np.repeat(np.arange(len(bound) - 1), np.diff(bound))
            self.order = self.order[np.lexsort((ordered[np.arange(n), widest[node]], node))]
            middle = (bound[:-1] + bound[1:]) // 2
            self.bound.append(np.sort(np.concatenate((bound, middle))))
        # sums of any run of ordered points come from prefix sums, so every node's is at hand
        self.sums = np.zeros((n + 1, d), dtype=np.int64)
        np.cumsum(points[self.order], axis=0, out=self.sums[1:])

    def assign(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest entry of every point, and the sums (k x d) and counts of what each entry was given."""
        k, d = entries.shape
        codes = np.empty(len(self.points), dtype=np.int64)  # by place in ``order``
        sums, counts = np.zeros((k, d), dtype=np.int64), np.zeros(k, dtype=np.int64)
        live, alive = np.zeros(1, dtype=np.int64), np.ones((1, k), dtype=bool)
        for level, bound in enumerate(self.bound):
            for a in range(0, len(live), _NODES):
                alive[a : a + _NODES] = _filtered(entries, alive[a : a + _NODES], self.low[level][live[a : a + _NODES]], self.high[level][live[a : a + _NODES]])
            single = alive.sum(axis=1) == 1
            begin, end = bound[live], bound[live + 1]
            entry = alive.argmax(axis=1)
            np.add.at(sums, entry[single], self.sums[end[single]] - self.sums[begin[single]])
            np.add.at(counts, entry[single], (end - begin)[single])
            place, of = _runs(begin[single], end[single])
            codes[place] = entry[single][of]
            live, alive = live[~single], alive[~single]
            if level + 1 < len(self.bound) and len(live):
                live = np.repeat(2 * live, 2)
                live[1::2] += 1
                alive = np.repeat(alive, 2, axis=0)
        if len(live):
            place, of = _runs(bound[live], bound[live + 1])
            for a in range(0, len(place), _NODES * LEAF):
                here = place[a : a + _NODES * LEAF]
                points = self.points[self.order[here]]
                # less what all entries share; doubles are faster and just as exact while they hold every whole number
                exact = float if d * max(abs(points).max(), abs(entries).max()) ** 2 < 1 << 50 else np.int64
                far = (entries * entries).sum(axis=1).astype(exact) - 2 * (points.astype(exact) @ entries.T.astype(exact))
                far[~alive[of[a : a + _NODES * LEAF]]] = np.inf if exact is float else np.iinfo(np.int64).max
                codes[here] = entry = far.argmin(axis=1)
                for j in range(d):
                    sums[:, j] += np.bincount(entry, weights=points[:, j], minlength=k).astype(np.int64)
                counts += np.bincount(entry, minlength=k)
        out = np.empty_like(codes)
        out[self.order] = codes
        return out, sums, counts


def _runs(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the runs, and the run of each."""
    size = end - begin
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) - (np.cumsum(size) - size)[of] + begin[of], of


def _filtered(entries: np.ndarray, alive: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """``alive`` without the entries that lose everywhere in a node's box against the one nearest to its middle."""
    norm = (entries * entries).sum(axis=1)
    # four times the distance to the middle, less what all entries share
    middle = 4 * norm - 4 * ((low + high) @ entries.T)
    best = np.where(alive, middle, np.iinfo(np.int64).max).argmin(axis=1)
    # how much farther an entry is than the best one is linear in the point: least at a corner of the box
    apart = entries[None, :, :] - entries[best][:, None, :]
    corner = np.where(apart > 0, high[:, None, :], low[:, None, :])
    least = norm[None, :] - norm[best][:, None] - 2 * (corner * apart).sum(axis=2)
    index = np.arange(len(entries))[None, :]
    loses = (least > 0) | ((least == 0) & (index > best[:, None]))
    return alive & ~loses


def _batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray]]:
    """Arrow batches gathered to at most BATCH_VECTORS rows (or one batch), and the integers of ``column`` as a matrix."""

    def matrix(group: list[pa.RecordBatch]) -> np.ndarray:
        flat = np.concatenate([b.column(column).flatten().to_numpy(zero_copy_only=False) for b in group])
        return flat.reshape(sum(b.num_rows for b in group), -1).astype(np.int64)

    group: list[pa.RecordBatch] = []
    for batch in batches:
        if group and sum(b.num_rows for b in group) + batch.num_rows > BATCH_VECTORS:
            yield group, matrix(group)
            group = []
        if batch.num_rows:
            group.append(batch)
    if group:
        yield group, matrix(group)


def first_entries(rows: DataFrame, entries: int = ENTRIES, parts: int = PARTS) -> np.ndarray:
    """Codebooks (parts x entries x width) of the vectors with the smallest ids."""
    got = rows.orderBy(F.asc_nulls_last("vec_id"), "q").limit(entries).select("q").collect()
    width = len(got[0]["q"]) // parts if got else 0
    return np.array([r["q"] for r in got], dtype=np.int64).reshape(len(got), parts, width).transpose(1, 0, 2)


def improved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after one round: each entry the floor of the mean of its parts, or as it was without any."""
    parts, size, width = books.shape

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, dtype=np.int64), np.zeros(books.shape[:2], dtype=np.int64)
        for _, q in _batches(batches, 0):
            for part in range(parts):
                _, s, c = Tree(q[:, part * width : (part + 1) * width]).assign(books[part])
                sums[part] += s
                counts[part] += c
        part, entry = np.nonzero(counts)
        total = [pa.array(x) for x in (part, entry, counts[part, entry])]
        yield pa.RecordBatch.from_arrays([*total, *(pa.array(sums[part, entry, j]) for j in range(width))], ["part", "entry", "n", *(f"s{j}" for j in range(width))])

    columns = ["n", *(f"s{j}" for j in range(width))]
    tasks = rows.select("q").mapInArrow(of, ", ".join(f"{c} long" for c in ("part", "entry", *columns)))
    out = books.copy()
    for r in tasks.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in columns]).collect():  # a row for each entry
        out[r["part"], r["entry"]] = [r[f"s{j}"] // r["n"] for j in range(width)]
    return out


def encoded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of each vector."""
    parts, _, width = books.shape

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, q in _batches(batches, 2):
            codes = np.zeros((len(q), parts), dtype=np.uint8)
            error = np.zeros(len(q), dtype=np.int64)
            for part in range(parts if width else 0):
                points = q[:, part * width : (part + 1) * width]
                codes[:, part] = nearest = Tree(points).assign(books[part])[0]
                error += ((points - books[part][nearest]) ** 2).sum(axis=1)
            text = codes.tobytes().hex()
            table = pa.Table.from_batches(group)
            yield from pa.table([table.column(0), table.column(1), [text[2 * parts * i : 2 * parts * (i + 1)] for i in range(len(q))], error], names=["vec_id", "label", "code", "error"]).to_batches()

    label = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(of, f"vec_id long, label {label}, code string, error long")


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, turns: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """Per usable vector: vec_id, code (two hex digits a part), error, label_error (the errors of its label) and codebooks_sha256."""
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hex digits: 1 to 256 entries")
    rows = quantised(vectors, id_col, vector_col, label_col, scale, parts)
    books = first_entries(rows, entries, parts)
    for _ in range(turns if books.size else 0):
        books = improved(rows, books)
    coded = keep(encoded(rows, books), "codes")
    # stored, so that Spark sees how small it is; a label with very many vectors can be split in the join
    errors = keep(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "__label"), "label-errors")
    out = coded.join(errors, F.col("label").eqNullSafe(F.col("__label")))
    return out.select(F.col("vec_id").alias(id_col), "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))
