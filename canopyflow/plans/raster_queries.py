"""Queries over two rasters of one place (R6). Every patch of PIXELS is the reference on a grid of ones and, on a shifted
grid of pixels of 1.6 by 1.5, the moving raster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyflow.operators import raster as R
from canopyflow.plans import standins as D
from canopyflow.plans.catalog import register


def grids(patches: DataFrame) -> DataFrame:
    """chain_id, ref, mov."""
    grid = lambda left, top, x, y: F.struct(left.cast("double").alias("left"), top.cast("double").alias("top"), F.lit(x).alias("size_x"), F.lit(y).alias("size_y"), F.lit(8).alias("height"), F.lit(8).alias("width"))
    k = F.col("chain_id")
    return patches.select("chain_id").distinct().select(k, grid(F.lit(0), F.lit(8), 1.0, 1.0).alias("ref"), grid(k % 11 - 5, 8 + F.floor(k / 11) % 9 - 4, 1.6, 1.5).alias("mov"))


GRIDS_SQL = f"""{D.PIXELS_SQL}, g AS (SELECT DISTINCT chain_id, chain_id % 11 - 5.0::DOUBLE AS x, 4.0::DOUBLE + chain_id // 11 % 9 AS y FROM pixels),
b AS (SELECT *, greatest(0, x) AS l, least(8, x + 12.8) AS r, least(8, y) AS t, greatest(0, y - 12) AS u FROM g),
o AS (SELECT *, floor(l + 1e-6) AS rc, floor(8 - t + 1e-6) AS rr, floor((l - x) / 1.6 + 1e-6) AS mc, floor((y - t) / 1.5 + 1e-6) AS mr FROM b WHERE l < r AND u < t),
w AS (SELECT chain_id, rr::INTEGER AS rr, rc::INTEGER AS rc, mr::INTEGER AS mr, mc::INTEGER AS mc, least(floor(t - u + 0.5), 8 - rr)::INTEGER AS rh, least(floor(r - l + 0.5), 8 - rc)::INTEGER AS rw,
  least(floor((t - u) / 1.5 + 0.5), 8 - mr)::INTEGER AS mh, least(floor((r - l) / 1.6 + 0.5), 8 - mc)::INTEGER AS mw FROM o),
windows AS (SELECT * FROM w WHERE rh >= 2 AND rw >= 2 AND mh >= 2 AND mw >= 2)"""


@register("r6_overlap_windows", f"WITH {GRIDS_SQL} SELECT chain_id, rr AS ref_row, rc AS ref_col, rh AS ref_height, rw AS ref_width, mr AS mov_row, mc AS mov_col, mh AS mov_height, mw AS mov_width FROM windows")
def r6_windows(spark: SparkSession, sf: str) -> DataFrame:
    found = R.overlap_windows(grids(D.pixels(spark, sf))).where(F.col("ref_window").isNotNull())
    return found.select("chain_id", *[F.col(f"{s}_window.{f}").alias(f"{s}_{f}") for s in ("ref", "mov") for f in ("row", "col", "height", "width")])


@register("r6_matched", f"""WITH {GRIDS_SQL}, i AS (SELECT *, unnest(range(0, rh))::INTEGER AS row FROM windows), j AS (SELECT *, unnest(range(0, rw))::INTEGER AS col FROM i),
s AS (SELECT *, least(greatest((row + 0.5) * mh / rh - 0.5, 0), mh - 1) AS y, least(greatest((col + 0.5) * mw / rw - 0.5, 0), mw - 1) AS x FROM j),
m AS (SELECT s.chain_id, s.row, s.col, (1 - abs(s.y + mr - p.row)) * (1 - abs(s.x + mc - p.col)) AS weight, p.g FROM s JOIN pixels p ON p.chain_id = s.chain_id AND abs(s.y + mr - p.row) < 1 - 1e-9 AND abs(s.x + mc - p.col) < 1 - 1e-9)
SELECT chain_id, row, col, round(sum(weight * g) / sum(weight), 6) AS g FROM m GROUP BY 1, 2, 3""")
def r6_matched(spark: SparkSession, sf: str) -> DataFrame:
    pixels = D.pixels(spark, sf)
    made = R.matched(pixels, R.overlap_windows(grids(pixels)), ["chain_id"], "g")
    return made.select("chain_id", "row", "col", F.round("g", 6).alias("g"))
