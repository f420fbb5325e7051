"""Components against union-find: chains, stars, cycles, repeated edges, loops and nulls."""

import random

import pytest

from ledgerline.llm.components import components


@pytest.mark.parametrize("seed", [1, 2])
def test_against_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(50)] + [(5, 5), (None, 3), (7, None)]
    edges += edges[:30]
    up = {}

    def find(i):
        up.setdefault(i, i)
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in up}


def test_no_edges(spark):
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
