"""Near pairs are never broadcast, and the chains of the best edges are those of all edges."""

import random

from pyspark.sql import functions as F

from canopyflow.operators import matching as M
from canopyflow.operators import tracking_graph as X
from canopyflow.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_copied_sides_are_not_broadcast(spark):
    rows = spark.range(50).select("id", F.rand(1).alias("x"), F.rand(2).alias("y"))
    assert "Broadcast" not in plan(M.near_pairs(rows, rows, 0.2, F.col("id") < F.col("id_b")))
    for name in ("j4_relaxed_scores", "j7_strict_scores", "j15_virtual_pairs"):
        assert "Broadcast" not in plan(catalog.queries()[name](spark, SF)), name


def test_conditions_on_scores_stay_above_the_join(spark):
    for name in ("j4_relaxed_scores", "j7_strict_scores"):
        joins = [x for x in plan(catalog.queries()[name](spark, SF)).splitlines() if "SortMergeJoin" in x]
        assert joins and all("CASE" not in x and "compactness" not in x.split("Inner")[1] for x in joins)


def test_reach_leaves_out_only_what_the_gate_does(spark):
    r = random.Random(3)
    boxes = [(k % 3, k, x := r.uniform(0, 100), y := r.uniform(0, 100), x + r.uniform(2, 20), y + r.uniform(2, 20)) for k in range(300)]
    c = spark.createDataFrame(boxes, "om_id int, crown_idx long, minx double, miny double, maxx double, maxy double")
    w, h = F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")
    c = c.withColumns({"x": (F.col("minx") + F.col("maxx")) / 2, "y": (F.col("miny") + F.col("maxy")) / 2, "area": w * h, "compactness": F.lit(1.0), "eccentricity": w / h})
    box = lambda s: {k: F.col(k + s) for k in ("minx", "miny", "maxx", "maxy")}
    found = [{(p.crown_idx, p.crown_idx_b, p.score) for p in M.virtual_pairs(c, lambda a, b: M.box_intersection(box(a), box(b)), reach=reach).collect()} for reach in (None, 0.52 * 20)]
    assert found[0] == found[1] and len(found[0]) > 50


def test_chains_of_best_edges(spark):
    r = random.Random(5)
    nodes = [(om, k) for om in range(1, 6) for k in range(40)]
    edges = [((om, a), (om + 1, b), r.randint(1, 4) / 4, r.choice(["one_to_one", "nearby"])) for om in range(1, 5) for a in range(40) for b in r.sample(range(40), 3) if a % 7]
    n = spark.createDataFrame([(x,) for x in nodes], "node struct<om_id:int,crown_idx:long>")
    e = spark.createDataFrame(edges, "prev struct<om_id:int,crown_idx:long>, curr struct<om_id:int,crown_idx:long>, similarity double, case string")
    tops = X.edge_summary(e, similarity=F.col("similarity"))
    want = {tuple(x) for x in X.degrees(n, e).collect() if x.in_degree or x.out_degree}
    assert {(x.node, x.in_degree, x.out_degree) for x in tops.collect()} == want
    best = e.join(tops.select(F.col("node").alias("prev"), F.col("similarity").alias("top")), "prev").where("similarity >= top").drop("top")
    assert best.count() < e.count()
    both = [{tuple(x) for x in c.collect()} for c in (X.chains(n, e, 5), X.chains(n, best, 5, reached=tops.where("in_degree > 0")))]
    assert both[0] == both[1]
