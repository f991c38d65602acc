"""Geometry, sequence and assignment kernels against closed forms and brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopyflow.functions import geometry as G
from canopyflow.functions import overlay as O
from canopyflow.functions import names as N
from canopyflow.functions import spectral as S
from canopyflow.operators import sequences as Q
from canopyflow.operators.alignment import phase_shift
from canopyflow.operators.matching import hungarian

SQUARE = np.array([[0, 0], [2, 0], [2, 2], [0, 2]], float)
ELL = np.array([[0, 0], [3, 0], [3, 1], [1, 1], [1, 3], [0, 3]], float)


def test_intersection_of_concave_rings():
    assert G.intersection_area(ELL, SQUARE) == pytest.approx(3.0)
    assert G.intersection_area(SQUARE, SQUARE + 1) == pytest.approx(1.0)
    assert G.intersection_area(SQUARE, SQUARE + 5) == 0
    assert G.intersection_area(SQUARE, np.zeros((0, 2))) == 0


def test_intersection_against_a_grid():
    rng = np.random.default_rng(1)
    for _ in range(5):
        rings = []
        for _ in range(2):
            t = np.sort(rng.uniform(0, 2 * math.pi, 9))
            r = rng.uniform(0.5, 1.5, 9)
            rings.append(np.column_stack([r * np.cos(t), r * np.sin(t)]) + rng.uniform(-0.3, 0.3, 2))
        grid = G.raster_area(rings, lambda s: (s < 0).all(0), 0.01)
        assert G.intersection_area(*rings) == pytest.approx(grid, abs=0.02)


def test_rectangle_hull_and_offsets():
    turn = np.array([[math.cos(0.4), -math.sin(0.4)], [math.sin(0.4), math.cos(0.4)]])
    box = np.array([[0, 0], [4, 0], [4, 1], [0, 1]], float) @ turn.T
    assert G.eccentricity(box) == pytest.approx(0.25)
    assert O.region_area(O.buffer(O.region(SQUARE), -0.5)) == pytest.approx(1.0)
    assert O.region_area(O.buffer_to_area(O.region(SQUARE), 1.0)) == pytest.approx(1.0, rel=1e-6)
    assert G.covered_within(SQUARE * 0.5 + 0.5, SQUARE) and not G.covered_within(SQUARE + 1, SQUARE)
    assert G.covered_within(SQUARE + 0.3, SQUARE, 0.5)
    assert len(G.simplify(np.array([[0, 0], [1, 0.01], [2, 0], [2, 2], [0, 2]], float), 0.1)) == 4


def test_affine_round_trip():
    m = (1.2, 0.3, 5.0, -0.2, 0.9, 7.0)
    assert G.affine_compose(m, G.affine_inverse(*m)) == pytest.approx((1, 0, 0, 0, 1, 0))
    assert G.affine_inverse(0, 0, 3, 0, 0, 4) == (1, 0, -3, 0, 1, -4)


def test_ring_columns(spark):
    one = spark.createDataFrame([([(0.0, 0.0), (3.0, 0.0), (3.0, 1.0), (1.0, 1.0), (1.0, 3.0), (0.0, 3.0)],)], f"ring {G.RING}")
    r = F.col("ring")
    turned = F.concat(F.slice(r, 3, 6), F.slice(r, 1, 2))
    row = one.select(G.area(r).alias("a"), G.perimeter(r).alias("p"), G.centroid(r).alias("c"), (G.geometry_key(r) == G.geometry_key(F.reverse(turned))).alias("same"), G.contains_point(r, F.lit(0.5), F.lit(2.5)).alias("in"), G.contains_point(r, F.lit(2.0), F.lit(2.0)).alias("out")).first()
    assert (row["a"], row["p"]) == (pytest.approx(5.0), pytest.approx(12.0))
    assert (row["c"]["x"], row["c"]["y"]) == (pytest.approx(1.1), pytest.approx(1.1))
    assert row["same"] and row["in"] and not row["out"]


def test_utm_round_trip(spark):
    p = spark.createDataFrame([(75.0, 18.5), (77.9, -3.2), (73.0, 45.0)], "lon double, lat double")
    u = G.utm(F.col("lon"), F.col("lat"), 43)
    back = p.withColumn("u", u).withColumn("g", G.utm_inverse(F.col("u.x"), F.col("u.y"), 43))
    for r in back.collect():
        assert (r["g"]["lon"], r["g"]["lat"]) == (pytest.approx(r["lon"], abs=1e-8), pytest.approx(r["lat"], abs=1e-8))
    assert back.first()["u"]["x"] == pytest.approx(500000.0)


def test_hungarian_against_permutations():
    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (3, 3), (3, 5), (5, 3), (4, 4)):
        c = rng.uniform(size=(n, m))
        got = sum(c[a, b] for a, b in hungarian(c))
        small = c if n <= m else c.T
        best = min(sum(small[i, p[i]] for i in range(len(small))) for p in itertools.permutations(range(small.shape[1]), len(small)))
        assert got == pytest.approx(best)
    assert hungarian(np.zeros((0, 0))) == []


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(3)
    cost = np.array([[0, 0.5, 1.0], [1.0, 0, 0.5], [0.5, 1.0, 0]])
    s = rng.normal(size=(5, 3))
    value = lambda p: sum(s[t, k] for t, k in enumerate(p)) - sum(cost[a, b] for a, b in zip(p, p[1:]))
    assert value(Q.viterbi(s, cost)) == pytest.approx(max(value(p) for p in itertools.product(range(3), repeat=5)))


def test_dtw_linkage_and_phase():
    assert Q.dtw(np.array([0, 1, 2.0]), np.array([0, 0, 1, 2.0])) == 0
    assert Q.dtw(np.array([1.0]), np.array([3.0])) == 2
    x = np.array([0.0, 0.1, 5.0, 5.2, 9.0])
    d = np.abs(x[:, None] - x[None])
    assert Q.cut_tree(Q.linkage(d, "average"), 5, 3).tolist() == [1, 1, 2, 2, 3]
    assert Q.cut_tree(Q.linkage(d), 5, 2).tolist() == [1, 1, 2, 2, 2]
    image = np.random.default_rng(4).normal(size=(32, 32))
    dy, dx, _ = phase_shift(image, np.roll(image, (3, -5), (0, 1)))
    assert (round(dy), round(dx)) == (-3, 5)


def test_names(spark):
    rows = spark.createDataFrame([("lhc_05-11-24_a", "S3_x.tif", "s3_tree_12.tif"), ("lhc_5_1_24", "A12_y.tif", "other.tif"), ("lhc_31-02-24", "foo.gpkg", None), (None, None, "")], "stem string, file string, image string")
    got = rows.select(N.stem_date(F.col("stem")).cast("string"), N.area_of_file(F.col("file")), N.image_crown_uid(F.col("image"), 1)).collect()
    assert [tuple(r) for r in got] == [("2024-11-05", "SV_S3", "SV_S3:crown_0013"), ("2024-01-05", "A12", None), (None, "foo", None), (None, None, None)]
    tag = spark.range(1).select(N.threshold_tag(F.lit(0.2)).alias("t")).select("t", N.tag_threshold(F.col("t")), N.tag_threshold(F.lit("conf_0p2")), N.tag_threshold(F.lit("x"))).first()
    assert tuple(tag) == ("conf_0p20", 0.2, 0.2, None)


def test_colours(spark):
    import colorsys

    rows = [(r / 255, g / 255, b / 255) for r, g, b in ((0, 0, 0), (255, 255, 255), (10, 200, 30), (200, 10, 30), (30, 10, 200), (200, 10, 190))]
    got = spark.createDataFrame(rows, "r double, g double, b double").select("*", S.rgb_to_hsv(F.col("r"), F.col("g"), F.col("b")).alias("x")).collect()
    for q in got:
        assert tuple(q["x"]) == pytest.approx(colorsys.rgb_to_hsv(q["r"], q["g"], q["b"]))
