"""Collections written for readers of whole files."""

from pyspark.sql import functions as F


def test_collections_have_a_file_each(spark, tmp_path):
    from canopyflow.sources import tables as T

    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (1, 0), (0, 1))])
    rows = spark.range(40).select("id", (F.col("id") % 20).alias("k"), ring.alias("ring"))
    lines = T.feature_json(rows, ["id"], keep=["k"])
    files = lines.groupBy("k").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("feature"), ","), F.lit("]}")).alias("value"))
    T.write_documents(files.coalesce(1), str(tmp_path / "features"), ["k"])
    assert sorted(x.id for x in T.read_features(spark, str(tmp_path / "features"), "id:long").collect()) == list(range(40))


def test_pixels_are_compared_with_bounds_before_rings(spark):
    import random

    from canopyflow.functions import geometry as G
    from canopyflow.sources import tables as T

    r = random.Random(1)
    rings = [(k, [(x + r.uniform(-30, 30), y + r.uniform(-30, 30)) for _ in range(r.randint(3, 8))]) for k in range(30) for x, y in [(r.uniform(0, 100), r.uniform(0, 100))]]
    rings += [(30, [(0.0, 0.0), (50.0, 0.0), (50.0, 50.0), (0.0, 50.0), (0.0, 0.0)]), (31, []), (32, None)]
    crowns = spark.createDataFrame(rings, f"k int, ring {G.RING}")
    pixels = spark.range(1500).select("id", (F.col("id") % 50 * 2.0).alias("px"), (F.floor(F.col("id") / 50) * 3.0).alias("py"))
    made = T.clip_pixels(pixels, crowns, F.col("px"), F.col("py"))
    want = pixels.crossJoin(crowns).where(G.contains_point(F.col("ring"), F.col("px"), F.col("py")))
    both = [{(x.id, x.k) for x in d.collect()} for d in (made, want)]
    assert both[0] == both[1] and len(both[0]) > 200
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "__minx" in next(x for x in plan.splitlines() if "SortMergeJoin" in x)
