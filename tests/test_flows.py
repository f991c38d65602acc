"""The end-to-end flows and the operators that have no SQL, on small made tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopyflow.functions import geometry as G
from canopyflow.functions import overlay as O
from canopyflow.operators import aggregates as A
from canopyflow.operators import evaluation as E
from canopyflow.operators import matching as M
from canopyflow.operators import raster as R
from canopyflow.operators import sequences as Q
from canopyflow.operators import timeseries as T
from canopyflow.operators.components import components
from canopyflow.operators.consensus import buffered, buffered_to_area, consensus, consensus_polygons, intersection_core, layer_tracks, merge_splits, polygon_union, rings_area, union_shrink
from canopyflow.plans import tracking
from canopyflow.sources import tables as S


def disc(x, y, r, n=12):
    return [{"x": x + r * math.cos(2 * math.pi * k / n), "y": y + r * math.sin(2 * math.pi * k / n)} for k in range(n)]


@pytest.fixture(scope="module")
def crowns(spark):
    r = random.Random(1)
    rows = []
    for om in (1, 2, 3):
        for i in range(25):
            x, y = 40.0 * (i % 5) + 3.0 * (om - 1), 40.0 * (i // 5) - 2.0 * (om - 1)
            rows.append((om, i, disc(x + r.uniform(-0.3, 0.3), y + r.uniform(-0.3, 0.3), 8 + r.uniform(-0.3, 0.3))))
    return spark.createDataFrame(rows, f"om_id int, crown_idx long, ring {G.RING}")


def test_tracking_finds_every_tree(crowns):
    out = tracking.track(crowns, 3, tracking.TrackingConfig(min_partial_len=3))
    shift = {r["om_id"]: (r["dx"], r["dy"]) for r in out["shifts"].collect()}
    assert shift[1] == (0, 0) and shift[3] == (pytest.approx(-6, abs=0.5), pytest.approx(4, abs=0.5))
    kinds = {r["category"]: r["n"] for r in out["categories"].groupBy("category").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"full_width1": 25}
    for r in out["chains"].collect():
        assert r["node"]["crown_idx"] == r["start"]["crown_idx"]
    areas = out["consensus"].select(G.area(F.col("ring")).alias("a"), "quality").collect()
    assert len(areas) == 25 and all(100 < a["a"] < 230 and a["quality"] == "Clean" for a in areas)


def test_tracking_fills_gaps_and_drops_duplicates(spark, crowns):
    """Tree 7 is missing in the last flight, tree 8 in the first one; lower layers have them, and a copy of tree 9. Tree 12 is there twice."""
    gone = (F.col("crown_idx") == 7) & (F.col("om_id") == 3) | (F.col("crown_idx") == 8) & (F.col("om_id") == 1)
    twice = crowns.where("crown_idx = 12").withColumns({"crown_idx": F.lit(200).cast("long"), "ring": G.translate(F.col("ring"), F.lit(0.05), F.lit(0.0))})
    above = crowns.where(~gone).unionByName(twice)
    lower = crowns.where(gone | (F.col("crown_idx") == 9)).withColumn("threshold", F.when(F.col("crown_idx") == 7, 0.25).otherwise(0.3))
    lower = lower.unionByName(lower.where("crown_idx = 7").withColumn("threshold", F.lit(0.1)))
    config = tracking.TrackingConfig(min_partial_len=3, align=False)
    plain, out = tracking.track(above, 3, config), tracking.track(above, 3, config, lower)
    fills = {(r["prev"]["om_id"], r["prev"]["crown_idx"] % 201, r["curr"]["om_id"], r["curr"]["crown_idx"] % 201): r for r in out["edges"].where("case = 'gap_fill'").collect()}
    assert set(fills) == {(2, 7, 3, 7), (1, 8, 2, 8)} and all(r["similarity"] == r["iou"] > 0.2 for r in fills.values())
    assert out["nodes"].count() == plain["nodes"].count() + 2
    length = {r["start"]["crown_idx"] % 201: r["length"] for r in out["categories"].collect()}
    assert length[7] == length[8] == 3 and {r["start"]["crown_idx"]: r["length"] for r in plain["categories"].collect()}[7] == 2
    got, before = {r["chain_id"]["crown_idx"] % 201 for r in out["consensus"].collect()}, {r["chain_id"]["crown_idx"] % 201 for r in plain["consensus"].collect()}
    assert got - before == {7, 8} and len(got & {12, 200}) == 1 and got >= set(range(25)) - {12}
    rings = {str(r["ring"]) for r in crowns.unionByName(twice).select(F.col("ring")).collect()}
    assert all(str(r["ring"]) in rings for r in out["consensus"].collect())  # medoids are members
    assert out["consensus"].where("avg_similarity is null").isEmpty() and set(out["consensus"].select("quality").distinct().toPandas()["quality"]) <= {"Clean", "Mixed", "Pure"}


def test_consensus_shapes():
    a = np.array([[0, 0], [4, 0], [4, 4], [0, 4]], float)
    core = intersection_core([a, a + 1], 0.0)
    assert len(core) == 1 and G.signed_area(core[0]) == pytest.approx(9)
    assert intersection_core([a, a + 100]) is None
    # a cross of 22 shrunk by 0.15 of the radius of 16: six convex corners, two reflex ones
    d = 0.15 * math.sqrt(16 / math.pi)
    corner = 8 * math.sin(math.pi / 32)
    assert O.region_area(union_shrink([a, a + 1])) == pytest.approx(23 - 20 * d + (6 - 2 * corner) * d * d, rel=1e-6)
    assert len(union_shrink([a, a + 100])) == 2 and union_shrink([a], 2.0) is None


def ell(w, h, x=0.0, y=0.0):
    return np.array([(0, 0), (w, 0), (w, h / 2), (w / 2, h / 2), (w / 2, h), (0, h)], float) + [x, y]


def test_consensus_of_concave_crowns():
    same = [ell(8, 6)] * 3
    core = intersection_core(same, 0.5)
    fillet = 0.25 * (1 - 8 * math.sin(math.pi / 32))  # growing and shrinking rounds the reflex corner
    assert len(core) == 1 and O.region_area(core) == pytest.approx(36 + fillet, abs=0.01)
    moved = [ell(8, 6), ell(8, 6, 0.4, 0.3), ell(8, 6, -0.3, 0.2)]
    signed = lambda p, g: np.where(G.inside(p, g), -1.0, 1.0) * G.boundary_distance(p, g)
    grid = np.random.default_rng(1).uniform(-2, 10, (40_000, 2))
    grown = np.max([signed(r, grid) for r in moved], axis=0) < 0.5
    made = O.buffer(O.intersection([O.buffer(O.region(r), 0.5) for r in moved]), 1e-9)
    assert (np.sum([G.inside(r, grid) for r in made], axis=0) == grown).mean() > 0.999
    assert O.region_area(intersection_core(moved, 0.5)) < 36
    union = O.union([O.region(r) for r in moved])
    d = 0.15 * math.sqrt(36 / math.pi)
    inner = np.max([G.boundary_distance(r, grid) * np.where(G.inside(r, grid), 1, -1) for r in union], axis=0) > d
    assert (np.sum([G.inside(r, grid) for r in union_shrink(moved)], axis=0) == inner).mean() > 0.999


def test_medoid_and_columns_of_regions(spark):
    rows = [(1, 1, disc(0, 0, 5)), (1, 2, disc(1, 0, 5)), (1, 3, disc(9, 0, 5)), (2, 1, disc(0, 0, 3)), (3, 1, None)]
    d = M.with_measures(spark.createDataFrame(rows, f"chain_id long, om_id int, ring {G.RING}")).withColumn("node", F.struct("om_id", "chain_id"))
    got = {r["chain_id"]: r["x"] for r in consensus(d.where("ring is not null")).select("chain_id", G.centroid(F.col("ring"))["x"].alias("x")).collect()}
    assert got == {1: pytest.approx(1), 2: pytest.approx(0)}
    with pytest.raises(ValueError):
        consensus(d, "mean")
    both = {r["chain_id"]: r["a"] for r in polygon_union(d, ["chain_id"]).select("chain_id", rings_area("rings").alias("a")).collect()}
    assert both[3] == 0 and both[2] == pytest.approx(27, abs=0.1) and 75 < both[1] < 225
    size = {(r["chain_id"], r["om_id"]): r["a"] for r in buffered_to_area(d, F.lit(50.0)).select("chain_id", "om_id", rings_area("rings").alias("a")).collect()}
    assert size.pop((3, 1)) is None and all(a == pytest.approx(50, abs=1e-5) for a in size.values())
    gone = {r["chain_id"]: r["n"] for r in buffered(d.where("om_id = 1"), F.lit(-4)).select("chain_id", F.size("rings").alias("n")).collect()}
    assert (gone[1], gone[2]) == (1, 0)


def test_consensus_and_splits(spark):
    rows = [(1, 1, 0, disc(0, 0, 5)), (1, 2, 0, disc(1, 0, 5)), (2, 1, 0, disc(0, 0, 3)), (2, 2, 0, disc(50, 0, 4))]
    d = spark.createDataFrame(rows, f"chain_id long, om_id int, g int, ring {G.RING}")
    got = {r["chain_id"]: r["a"] for r in consensus_polygons(d).select("chain_id", G.area(F.col("ring")).alias("a")).collect()}
    assert 50 < got[1] < 75 and 2 not in got  # apart: no consensus
    assert merge_splits(d, ["g"], 0.6).count() == 3


def test_greedy_one_to_one_equals_the_sequence(spark):
    r = random.Random(2)
    pairs = [(a, b, round(r.random(), 3)) for a in range(12) for b in range(12) if r.random() < 0.4]
    left, right, want = set(), set(), set()
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in left and b not in right:
            left.add(a), right.add(b), want.add((a, b))
    got = M.greedy_one_to_one(spark.createDataFrame(pairs, "l long, r long, s double"), "l", "r", [("s", True)])
    assert {(x["l"], x["r"]) for x in got.collect()} == want


def test_case_presets_apply_their_own_weights(spark):
    names = "case spatial_similarity area_similarity shape_similarity iou base_similarity overlap_prev overlap_curr balanced_area_ratio distance mean_radius".split()
    rows = [(case, 0.9, 0.8, 0.7, iou, 0.5, 0.6, 0.7, 0.8, 3.0, 4.0) for case in ("one_to_one", "containment", "nearby") for iou in (0.05, 0.4)]
    d = spark.createDataFrame(rows, names)

    def scores(cases):
        return {(r["case"], r["iou"]): (round(r["base_similarity"], 9), round(r["score"], 9)) for r in M.scored_candidates(d, cases).collect()}

    relaxed, strict = scores(M.ultra_relaxed_cases()), scores(M.strict_aligned_cases())
    assert len(relaxed) == 6 and sorted(strict) == [("containment", 0.4), ("nearby", 0.4), ("one_to_one", 0.4)]
    base = 0.35 * 0.4 + 0.45 * 0.9 + 0.15 * 0.8 + 0.05 * 0.7
    assert strict["nearby", 0.4] == (pytest.approx(base), pytest.approx(0.6 * base + 0.4 * 0.75))
    base = 0.5 * 0.9 + 0.15 * 0.8 + 0.05 * 0.7 + 0.3 * 0.05
    assert relaxed["one_to_one", 0.05] == (pytest.approx(base), pytest.approx(0.6 * base + 0.1 * 0.05 + 0.05 * 0.6 + 0.05 * 0.7 + 0.2 * 0.75))
    several = spark.createDataFrame([(1, 2, 5, b, "one_to_one", 0, 0.9 - b / 10) for b in range(4)], "om_id int, om_id_b int, prev int, curr int, case string, priority int, score double")
    assert M.greedy_select(several, M.ultra_relaxed_cases(), ["om_id", "om_id_b"], "prev", "curr").count() == 3
    assert M.greedy_select(several, M.strict_aligned_cases(), ["om_id", "om_id_b"], "prev", "curr").count() == 2


def test_greedy_one_to_one_of_a_long_tied_chain(spark):
    n = 104
    pairs = [(i, j, 0.5) for i in range(n) for j in (i, i + 1)] + [(0, 0, 0.5)]
    got = M.greedy_one_to_one(spark.createDataFrame(pairs, "l long, r long, s double").coalesce(1), "l", "r", [("s", True)])
    assert sorted((x["l"], x["r"]) for x in got.collect()) == [(i, i) for i in range(n)]


def test_layer_tracks(spark):
    rows = [(1, 10, 20, 0.9), (1, 11, 20, 0.5), (2, 20, 30, 0.8), (2, 21, 31, 0.7)]
    got = layer_tracks(spark.createDataFrame(rows, "om_id int, prev long, curr long, iou double"), [1, 2, 3]).collect()
    assert {(r["om_id"], r["node"], r["track"]) for r in got} == {(1, 10, 10), (1, 11, 11), (2, 20, 10), (2, 21, 21), (3, 30, 10), (3, 31, 21)}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(10)}, 100: 100, 101: 100}


def test_weights_blur_change(spark, crowns):
    w = R.fractional_weights(crowns.where("om_id = 1"), "crown_idx", 4.0).groupBy("crown_idx").agg(F.sum("weight").alias("s"))
    assert all(r["s"] == pytest.approx(1) for r in w.collect())
    px = spark.createDataFrame([(1, d, i, j, 5.0 + d * (i == j)) for d in (1, 2) for i in range(6) for j in range(6)], "k int, date int, row int, col int, v double")
    flat = R.blurred(px.withColumn("one", F.lit(3.0)), ["k", "date"], "one")
    assert all(r["blurred"] == pytest.approx(3) for r in flat.collect())
    change = R.change_map(px, ["k"], "date", "v").where("date = 2").collect()
    assert all(abs(r["difference"]) < 1e-9 for r in change)
    patch = R.square_patch(px.where("date = 1"), ["k"], 4, ["v"]).first()
    assert len(patch["v"]) == 16


def test_clip_and_json(spark, crowns):
    px = spark.range(400).select((F.col("id") % 20).cast("int").alias("col"), F.floor(F.col("id") / 20).cast("int").alias("row"))
    one = spark.createDataFrame([(1, disc(10, 10, 5, 60))], f"chain_id int, ring {G.RING}")
    n = S.clip_pixels(px, one, F.col("col") + 0.5, F.col("row") + 0.5).count()
    assert abs(n - math.pi * 25) < 6
    assert '"Polygon"' in S.feature_json(crowns, ["om_id", "crown_idx"]).first()["feature"]
    twice = crowns.withColumns({"threshold": F.lit(0.45)}).unionByName(crowns.withColumns({"threshold": F.lit(0.30)}))
    assert S.multithreshold(twice, 0.45).count() == 75
    assert S.threshold_cache(twice, 0.45).count() == 75


def test_discovery(spark):
    stems = spark.createDataFrame([("lhc_05-11-24",), ("lhc_05-01-24",), ("lhc_dateUnknown",), ("lhc_dateNotConfirmed",), ("sit_om3",), ("bad",)], "stem string")
    got = [r["stem"] for r in S.discover(stems, ["bad"]).orderBy("om_id").collect()]
    assert got == ["lhc_05-01-24", "lhc_05-11-24", "sit_om3", "lhc_dateNotConfirmed"]
    ok = S.validate_store(spark.createDataFrame([("conf_0p45",), ("conf_0p2",)], "tag string"), [0.45, 0.2, 0.3]).first()
    assert (ok["missing"], ok["ok"]) == ([0.3], False)


def test_geojson_and_coco(spark, tmp_path):
    (tmp_path / "a.geojson").write_text('{"features":[{"properties":{"species":"x"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,2],[0,0]]]}}]}')
    r = S.read_features(spark, str(tmp_path / "a.geojson"), "species:string").first()
    assert (r["species"], r["source_index"], len(r["ring"])) == ("x", 0, 4)
    (tmp_path / "c.json").write_text('{"annotations":[{"id":5,"segmentation":[[0,0,4,0,4,4]]},{"id":6,"segmentation":[[1,1]]}]}')
    got = S.read_coco(spark, str(tmp_path / "c.json")).collect()
    assert [(r["gt_id"], len(r["ring"]), r["pixel_space"]) for r in got] == [(5, 3, True)]


def test_leaf_shed_edge_cases(spark):
    rows = [(1, d, v, v, v * 100, False) for d, v in zip((1, 2, 3, 4), (0.9, 0.1, 0.05, 0.8))] + [(2, 1, 0.5, 0.4, 3.0, True), (3, 2, 0.6, 0.4, 3.0, False)]
    f = spark.createDataFrame(rows, "chain_id int, om_id int, veg_fraction_hsv double, gcc_mean double, laplacian_var double, is_bad_observation boolean")
    scores, phases = T.leaf_shed(f, [1, 2, 3, 4], {"threshold": 0.7})
    got = {r["chain_id"]: r for r in scores.collect()}
    assert got[1]["is_deciduous"] and (got[1]["leaf_off_start_om"], got[1]["full_leaf_off_om"], got[1]["leaf_on_return_om"]) == (2, 3, 4)
    assert got[2]["min_veg"] == 0.0 and got[2]["deciduous_score"] >= 0.30 and not got[3]["is_deciduous"]
    assert {r["phenophase"] for r in phases.where("chain_id = 3").collect()} == {"stable"}


def test_label_spreading_and_pca(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 0.3, (30, 3)), rng.normal(4, 0.3, (30, 3))])
    d = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    seeds = spark.createDataFrame([(0, 0), (59, 1)], "id long, y int")
    p = {r["id"]: r["p"] for r in Q.label_spreading(Q.knn_graph(d, "id", "v", 5, block=25), seeds, alpha=0.9, rounds=5).collect()}
    assert all((p[i] < 0.5) == (i < 30) for i in p if p[i] is not None) and sum(v is not None for v in p.values()) > 30
    wide = d.select(*[F.col("v")[k].alias(f"f{k}") for k in range(3)])
    first = Q.pca(wide, ["f0", "f1", "f2"], 2).orderBy("component").first()
    assert first["explained"] > 0.95 and all(abs(abs(w) - 3**-0.5) < 0.05 for w in first["loadings"])


def test_harmonics_recover_a_curve(spark):
    t = lambda d: 2 * math.pi * d / 365.25
    rows = [(1, d, 0.5 + 0.3 * math.sin(t(d)) - 0.1 * math.cos(2 * t(d))) for d in range(0, 1400, 9)]
    df = spark.createDataFrame(rows, "k int, d int, v double").withColumn("day", F.date_add(F.lit("2014-01-01").cast("date"), F.col("d")))
    c = Q.harmonic_fit(df, "k", "day", "v")
    assert c.first()["coefficients"] == pytest.approx([0.5, 0, 0.3, 0, 0, -0.1], abs=1e-6)
    assert Q.reconstructed(c, "k").count() == 365


def test_metrics_and_samples(spark):
    rows = spark.createDataFrame([(i, i % 3, (i * 7) % 3, float(i)) for i in range(90)], "id int, y int, p int, size double")
    m = E.metrics(rows, "y", "p").first()
    hits = sum((i % 3) == (i * 7) % 3 for i in range(90))
    assert m["accuracy"] == pytest.approx(hits / 90)
    assert A.diverse_sample(rows, "id", "size", "y", 24).count() == 24
    split = E.stratified_split(rows, "id", "y").groupBy("y").agg(F.count_if("is_test").alias("n")).collect()
    assert {r["n"] for r in split} == {9}


def test_stream_equals_batch(spark, tmp_path):
    from canopyflow.streaming.composites import windowed

    rows = spark.range(200).select((F.col("id") % 3).alias("k"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 86400).alias("ts"), F.col("id").cast("double").alias("v"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windowed(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "k", "ts", "v")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, windowed(rows, "k", "ts", "v").collect()))
