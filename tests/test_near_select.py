"""Selections over near pairs that are not written equal those over written ones."""

import random

from pyspark.sql import functions as F

from canopyflow.operators import matching as M
from canopyflow.operators import tracking_graph as X


def test_selections_of_near_rows(spark):
    r = random.Random(11)
    boxes = [(k, x := r.uniform(0, 120), y := r.uniform(0, 120), x + r.uniform(2, 20), y + r.uniform(2, 20), r.randint(1, 5), r.choice(list(X.CATEGORY_WEIGHTS))) for k in range(300)]
    boxes += [(300 + k, *boxes[k][1:]) for k in range(20)]  # the same place again: the key decides
    w, h = F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")
    c = spark.createDataFrame(boxes, "chain_id long, minx double, miny double, maxx double, maxy double, chain_length long, chain_category string")
    c = c.withColumns({"x": (F.col("minx") + F.col("maxx")) / 2, "y": (F.col("miny") + F.col("maxy")) / 2, "area": w * h, "avg_similarity": F.lit(0.5)})
    shared = lambda a, b: M.box_intersection(*({k: F.col(k + s) for k in ("minx", "miny", "maxx", "maxy")} for s in (a, b)))
    i = shared("", "_b")
    iou = (i / (F.col("area") + F.col("area_b") - i)).alias("iou")
    all_pairs = M.near_pairs(c, c, 60.0, F.col("chain_id") != F.col("chain_id_b")).select("chain_id", "chain_id_b", iou, (i >= F.col("area_b") * (1 - 1e-9)).alias("contains"))
    once = M.near_pairs(c, c, 60.0, F.col("chain_id") < F.col("chain_id_b")).select("chain_id", "chain_id_b", iou, (i / F.col("area")).alias("share_a"), (i / F.col("area_b")).alias("share_b"))
    ids = lambda d: sorted(x.chain_id for x in d.select("chain_id").collect())
    for near in (M.Near(60.0, shared), M.Near(60.0, shared, 16.0)):
        assert ids(X.spatial_dedup(c, near, 0.75)) == ids(X.spatial_dedup(c, all_pairs, 0.75))
        assert ids(X.spatial_dedup_by_score(c, near, 0.5, 0.2)) == ids(X.spatial_dedup_by_score(c, once, 0.5, 0.2))


def test_nearest_pairs_are_found_among_few(spark):
    from pyspark.sql import Window as W

    r = random.Random(2)
    rows = spark.createDataFrame([(k, float(r.randint(0, 40)), float(r.randint(0, 40))) for k in range(200)], "id long, x double, y double")
    left, right = rows.where("id % 2 = 0"), rows.where("id % 2 = 1").withColumnsRenamed({"id": "k"})
    pairs = M.near_pairs(left, right, 5.0, F.lit(True))
    w = lambda k, other: F.row_number().over(W.partitionBy(k).orderBy("distance", other))
    ranked = pairs.withColumns({"a": w("id", "k_b"), "b": w("k_b", "id")}).where("a = 1")
    as_set = lambda d: {(x.id, x.k_b, x.distance) for x in d.collect()}
    both = M.mutual_nearest(left, right, 5.0, "id", "k")
    assert as_set(both) == as_set(ranked.where("b = 1")) and as_set(M.mutual_nearest(left, right, 5.0, "id", "k", mutual=False)) == as_set(ranked)
    assert "__least" in both._jdf.queryExecution().optimizedPlan().toString()
