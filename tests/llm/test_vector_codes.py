"""Codes and codebooks against plain Lloyd rounds in whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from ledgerline.llm import vector_codes as vc


def plain(rows, parts, entries, turns, scale=256):
    """rows: (vec_id, vector, label), ids distinct."""
    kept = [(i, [math.floor(scale * np.float64(x)) for x in v], c) for i, v, c in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0]))
    width = len(kept[0][1]) // parts if kept else 0
    cut = lambda q, p: q[p * width : (p + 1) * width]
    books = [[cut(q, p) for _, q, _ in kept[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(turns):
        for p in range(parts):
            own = [near(cut(q, p), books[p])[1] for _, q, _ in kept]
            for k in range(len(books[p])):
                members = [cut(q, p) for (_, q, _), o in zip(kept, own) if o == k]
                if members:
                    books[p][k] = [sum(m[j] for m in members) // len(members) for j in range(width)]
    out, by_label = {}, {}
    for i, q, c in kept:
        got = [near(cut(q, p), books[p]) for p in range(parts)]
        out[i] = ("".join(f"{k:02x}" for _, k in got), sum(d for d, _ in got), c)
        by_label[c] = by_label.get(c, 0) + out[i][1]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return {i: (code, error, by_label[c], digest) for i, (code, error, c) in out.items()}


def compare(spark, rows, parts, entries, turns):
    df = spark.createDataFrame([(i, v, c, "z", 1) for i, v, c in rows], "vec_id long, embedding array<float>, label int, code string, error int")
    got = {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in vc.vector_codes(df.repartition(3), parts=parts, entries=entries, turns=turns).collect()}
    assert got == plain([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], c) for i, v, c in rows], parts, entries, turns)
    return got


@pytest.mark.parametrize("parts, entries, spread", [(4, 8, 3.0), (2, 16, 0.02), (8, 64, 1.0)])
def test_against_plain_rounds(spark, parts, entries, spread):
    r = random.Random(parts)
    centres = [[r.gauss(0, spread) for _ in range(16)] for _ in range(5)]
    rows = [(i * 3 - 50, [x + r.gauss(0, spread / 4) for x in centres[i % 5]], i % 4 or None) for i in range(300)]
    rows[7] = (rows[7][0], None, 1)
    rows[8] = (rows[8][0], [None, *rows[8][1][1:]], 1)
    rows[9] = (rows[9][0], [float("nan"), *rows[9][1][1:]], 1)
    rows[10] = (rows[10][0], [float("-inf"), *rows[10][1][1:]], 1)
    rows[40:140] = [(i, rows[200][1], c) for i, _, c in rows[40:140]]  # copies, and ties between equal entries
    assert len(compare(spark, rows, parts, entries, 2)) == 296


def test_few_vectors_and_equal_points(spark):
    compare(spark, [(i, [0.5] * 8, None) for i in range(60)], 2, 64, 2)
    compare(spark, [(5, [1.0, -2.0], 3), (4, [0.25, 9.0], 3)], 2, 64, 2)


def test_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vc.vector_codes(spark.createDataFrame([], schema)).count() == 0
    assert vc.vector_codes(spark.createDataFrame([(1, None, 1), (None, None, None)], schema)).count() == 0
    v = [float(k) for k in range(16)]
    # repeated rows, a null id and one of another length, which goes
    rows = vc.vector_codes(spark.createDataFrame([(1, v, 1), (1, v, 1), (None, v[::-1], None), (2, v[:8], 1), (3, [], 1)], schema)).collect()
    assert sorted((r.vec_id is None, r.vec_id, r.error) for r in rows if r.vec_id) == [(False, 1, 0), (False, 1, 0)] and len(rows) == 3
    with pytest.raises(ValueError):
        vc.vector_codes(spark.createDataFrame([(1, v[:9], 1)], schema))
    with pytest.raises(ValueError):
        vc.vector_codes(spark.createDataFrame([(1, [1e30] * 16, 1)], schema))


def test_filtering_drops_only_losers():
    """Whole subtrees are assigned, and every point still has its nearest entry."""
    r = np.random.default_rng(3)
    points = np.concatenate([r.normal(c, 5, (4000, 4)) for c in (-300, 0, 280)]).astype(np.int64)
    entries = np.concatenate([r.normal(c, 20, (12, 4)) for c in (-300, 0, 280)]).astype(np.int64)
    entries[5] = entries[3]
    tree = vc.Tree(points)
    codes, sums, counts = tree.assign(entries)
    far = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (codes == far.argmin(axis=1)).all() and (counts == np.bincount(codes, minlength=36)).all()
    assert all((sums[k] == points[codes == k].sum(axis=0)).all() for k in range(36))
    left = vc._filtered(entries, np.ones((1, 36), bool), tree.low[2][:1], tree.high[2][:1])
    assert 1 <= left.sum() <= 24
