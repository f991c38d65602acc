"""Connected components on the graphs that are slow for label propagation."""

import random

import pytest

from canopyflow.operators.components import components


def least_reachable(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {x: root(x) for x in parent}


def path(ids):
    return list(zip(ids, ids[1:]))


N = 1000
SHAPES = {
    "rising": path(list(range(N))),
    "falling": path(list(range(N, 0, -1))),
    "random": path(random.Random(3).sample(range(10 * N), N)),
    "alternating": path([i // 2 if i % 2 else N + i // 2 for i in range(N)]),
    "star of the largest": [(N, i) for i in range(N)] + [(i, i + 2 * N) for i in range(N)],
    "two apart": path(list(range(0, 40))) + path(list(range(100, 140))) + [(7, 7), (3, 2), (2, 3)],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_components_settle(spark, shape):
    edges = SHAPES[shape]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == least_reachable(edges)


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []
