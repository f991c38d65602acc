"""Warping distances and clusters against the plain kernels, one pair and one merge at a time."""

import numpy as np
import pytest

from canopyflow.operators import clustering as C
from canopyflow.operators import sequences as Q


def points(seed, n):
    return np.random.default_rng(seed).normal(size=(n, 3))


def distances(spark, x):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    rows = [(i, j, float(d[i, j])) if (i + j) % 2 else (j, i, float(d[i, j])) for i in range(len(x)) for j in range(i + 1, len(x))]
    return d, spark.createDataFrame(rows, "a long, b long, distance double")


@pytest.mark.parametrize("method", ["ward", "average"])
@pytest.mark.parametrize("n, small", [(300, 60), (30, 0), (25, 512)])
def test_heights_and_cuts_equal_the_sequence(spark, method, n, small):
    d, pairs = distances(spark, points(n, n))
    plain = Q.linkage(d, method)
    merges = C.agglomerate(pairs, method=method, small=small)
    got = merges.collect()
    np.testing.assert_allclose(sorted(r["height"] for r in got), sorted(m[2] for m in plain), rtol=1e-9)
    assert sorted(r["size"] for r in got) == sorted(m[3] for m in plain)
    rows = spark.range(n).withColumnRenamed("id", "tree")
    for clusters in (1, 7):
        own = {r["tree"]: r["cluster"] for r in C.cut(merges, rows, "tree", clusters).collect()}
        assert [own[i] for i in range(n)] == Q.cut_tree(plain, n, clusters).tolist()


@pytest.mark.parametrize("small", [0, 512])
def test_ties_repeated_pairs_and_nulls(spark, small):
    rows = [(i, j, 1.0) for i in range(6) for j in range(i)] + [(0, 1, 3.0), (2, 2, 0.0), (None, 1, 1.0), (1, 2, None), (1, 2, float("nan"))]
    got = C.agglomerate(spark.createDataFrame(rows, "a int, b int, distance double"), method="average", small=small).collect()
    assert [r["height"] for r in got] == [1.0] * 5 and sorted(r["right"] for r in got) == [1, 2, 3, 4, 5]


def test_no_pairs_and_missing_pairs(spark):
    none = spark.createDataFrame([], "a string, b string, distance double")
    merges = C.agglomerate(none)
    assert merges.count() == 0
    own = C.cut(merges, spark.createDataFrame([("x",), ("y",), (None,)], "tree string"), "tree", 3)
    assert sorted(map(tuple, own.collect())) == [("x", 1), ("y", 2)]
    with pytest.raises(ValueError, match="missing"):
        C.agglomerate(spark.createDataFrame([("x", "y", 1.0), ("y", "z", 1.0)], none.schema))


@pytest.mark.parametrize("window, most", [(0, None), (2, None), (2, 4.0), (0, 5.0), (3, 0.0)])
def test_warping_distances_of_all_pairs(spark, window, most):
    r = np.random.default_rng(window)
    series = [(i, r.normal(size=r.choice([5, 6, 6])).cumsum().tolist(), r.normal(size=6).tolist()) for i in range(150)] + [(200, [1.0, 2.0, 3.0, 4.0, 5.0], [0.0] * 6), (201, [1.0, 2.0, 3.0, 4.0, 5.0], [0.0] * 6)]
    odd = [(300, None, [1.0]), (301, [], [1.0]), (302, [1.0, None], [1.0]), (303, [float("nan")], [1.0]), (None, [1.0], [1.0])]
    got = C.dtw_pairs(spark.createDataFrame(series + odd, "tree int, v array<double>, u array<double>"), "tree", ["v", "u"], window, most).collect()
    want = {}
    for i, (k, v, u) in enumerate(series):
        for m, p, q in series[:i]:
            d = (Q.dtw(np.array(v), np.array(p), window) + Q.dtw(np.array(u), np.array(q), window)) / 2
            if most is None or d <= most:
                want[min(k, m), max(k, m)] = d
    assert len(got) == len(want)
    for row in got:
        assert row["distance"] == pytest.approx(want[row["tree"], row["tree_b"]], rel=1e-12, abs=1e-12)
