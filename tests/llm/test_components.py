import random

import pytest

from docmill.llm.components import components


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {n: find(n) for n in root}


@pytest.mark.parametrize("small", [0, 250_000])
@pytest.mark.parametrize("edges", [[], [(1, 1)], [(None, 2), (3, None)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(100, 101), (101, 100)]])
def test_shapes(spark, edges, small):
    """By rounds over all and in one task, on both sides of the size that decides."""
    got = components(spark.createDataFrame(edges, "a long, b long"), small=small)
    assert {r.node: r.component for r in got.collect()} == brute(edges)


@pytest.mark.parametrize("small", [129, 130])
def test_random(spark, small):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)]
    assert {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), small=small).collect()} == brute(edges)
