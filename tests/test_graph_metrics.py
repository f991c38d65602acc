"""Diameters and strong components against searches from every node."""

import random

import numpy as np
import pytest

from canopyflow.operators import graph_metrics as G


def graph(seed):
    r = random.Random(seed)
    n = r.choice([30, 90])
    edges = [(r.randrange(n), r.randrange(n)) for _ in range(int(n * r.uniform(0.6, 1.6)))]
    return edges + [(1000 + i, 1001 + i) for i in range(r.randrange(1, 12))] + [(2000, 2000)]


def reach(edges, both):
    out = {}
    nodes = {x for e in edges for x in e}
    near = {v: set() for v in nodes}
    for a, b in edges:
        near[a].add(b)
        if both:
            near[b].add(a)
    for s in nodes:
        d, front, k = {s: 0}, [s], 0
        while front:
            k += 1
            front = [w for w in {w for v in front for w in near[v]} if w not in d]
            d.update({w: k for w in front})
        out[s] = d
    return out


@pytest.mark.parametrize("seed", range(40))
def test_one_component(seed):
    r = random.Random(seed)
    edges = [(i, r.randrange(i)) for i in range(1, r.choice([2, 10, 60]))]
    edges += [(r.randrange(len(edges) + 1), r.randrange(len(edges) + 1)) for _ in range(r.choice([0, 3, 30]))]
    a, b = np.array(edges).T
    assert G.diameter(a, b) == max(max(d.values()) for d in reach(edges, True).values())
    directed = [(x, y) if r.random() < 0.6 else (y, x) for x, y in graph(seed)]
    far = reach(directed, False)
    got = dict(zip(*(x.tolist() for x in G.strong(*np.array(directed).T))))
    assert got == {v: min(w for w in far[v] if v in far[w]) for v in far}


@pytest.mark.parametrize(("seed", "small"), [(0, 2048), (1, 3), (2, 12)])
def test_all_components(spark, seed, small):
    edges = graph(seed)
    d = spark.createDataFrame(edges, "a long, b long").repartition(3)
    far, one_way = reach(edges, True), reach(edges, False)
    want = {min(x): (len(x), max(max(far[v].values()) for v in x)) for x in far.values() if len(x) > 1}
    assert {r["component"]: (r["size"], r["diameter"]) for r in G.diameters(d, small).collect()} == want
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert {r["node"]: r["component"] for r in G.strong_components(d, small).collect()} == {v: min(w for w in one_way[v] if v in one_way[w]) for v in linked}


def test_summary(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (7, 8)]
    nodes = spark.createDataFrame([(x,) for x in (1, 2, 3, 4, 7, 8, 9)], "node long")
    r = G.graph_summary(nodes, spark.createDataFrame(edges, "a long, b long")).first()
    assert (r["num_nodes"], r["num_edges"], r["weak_components"], r["largest_weak"], r["strong_components"], r["largest_strong"]) == (7, 5, 3, 4, 5, 3)
    assert (r["max_diameter"], r["average_diameter"], r["median_diameter"], r["zero_out_degree"], r["zero_in_degree"]) == (2, 1.0, 1.0, 3, 2)
    none = G.graph_summary(nodes.limit(0), spark.createDataFrame([], "a long, b long")).first()
    assert (none["num_nodes"], none["weak_components"], none["max_diameter"]) == (0, 0, None)
