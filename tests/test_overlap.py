"""Windows of two rasters and bilinear matching against plain arithmetic."""

import math

from pyspark.sql import functions as F

from canopyflow.operators import raster as R

GRID = "struct<left:double,top:double,size_x:double,size_y:double,height:int,width:int>"


def test_windows_and_matching(spark):
    rows = [
        (1, (0.0, 6.0, 1.0, 1.0, 6, 6), (2.0, 5.0, 2.0, 0.5, 8, 3)),
        (2, (0.0, 6.0, 1.0, 1.0, 6, 6), (0.0, 6.0, 1.0, 1.0, 6, 6)),
        (3, (0.0, 6.0, 1.0, 1.0, 6, 6), (6.0, 6.0, 1.0, 1.0, 6, 6)),
        (4, (0.0, 6.0, 1.0, 1.0, 6, 6), (5.0, 6.0, 1.0, 1.0, 6, 6)),
        (5, None, (0.0, 6.0, 1.0, 1.0, 6, 6)),
    ]
    windows = R.overlap_windows(spark.createDataFrame(rows, f"id int, ref {GRID}, mov {GRID}"))
    got = {r["id"]: r["ref_window"] and (tuple(r["ref_window"]), tuple(r["mov_window"])) for r in windows.collect()}
    assert got == {1: ((1, 2, 4, 4), (0, 0, 8, 2)), 2: ((0, 0, 6, 6), (0, 0, 6, 6)), 3: None, 4: None, 5: None}

    value = lambda i, j: float(i * i + 3 * j)
    pixels = [(k, i, j, None if (i, j) == (7, 1) else value(i, j)) for k in (1, 2) for i in range(9) for j in range(6) if (i, j) != (0, 0)]
    made = R.matched(spark.createDataFrame(pixels, "id int, row int, col int, v double").where(F.col("row") < F.when(F.col("id") == 1, 9).otherwise(6)), windows, ["id"], "v")
    found = {(r["id"], r["row"], r["col"]): r["v"] for r in made.collect()}
    assert {k[1:]: v for k, v in found.items() if k[0] == 2} == {(i, j): value(i, j) for i in range(6) for j in range(6) if (i, j) != (0, 0)}
    for i in range(4):
        for j in range(4):
            y, x = (i + 0.5) * 2 - 0.5, min(max((j + 0.5) / 2 - 0.5, 0), 1)
            near = [((1 - abs(y - p)) * (1 - abs(x - q)), value(p, q)) for p in range(math.floor(y), math.floor(y) + 2) for q in (0, 1) if abs(x - q) < 1 and (p, q) not in ((0, 0), (7, 1))]
            assert abs(found[1, i, j] - sum(w * v for w, v in near) / sum(w for w, _ in near)) < 1e-9
    assert R.matched(spark.createDataFrame([], "id int, row int, col int, v double"), windows, ["id"], "v").isEmpty()
