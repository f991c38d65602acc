"""Pixel-table kernels (R1-R7, W24): coverage weights, smoothing, change maps, square patches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from canopyflow.functions import geometry as G


def fractional_weights(crowns: DataFrame, key: str, size: float, ring: str = "ring") -> DataFrame:
    """R2: (key, row, col, weight): share of each crown's area that each grid pixel of side `size` covers.

    Pixel (row, col) spans [col, col + 1) x [row, row + 1) times size. A crown meets the pixels of its bounds only.
    """
    b = G.bounds(F.col(ring))
    at = lambda v: F.floor(v / size).cast("int")
    cells = crowns.select(key, F.col(ring).alias("ring"), F.explode(F.sequence(at(b["miny"]), at(b["maxy"]))).alias("row"), at(b["minx"]).alias("c0"), at(b["maxx"]).alias("c1"))
    cells = cells.select(key, "ring", "row", F.explode(F.sequence("c0", "c1")).alias("col"))

    @F.pandas_udf("double")
    def share(rings: pd.Series, row: pd.Series, col: pd.Series) -> pd.Series:
        out = []
        for r, i, j in zip(rings, row, col):
            p = G.as_points(r)
            box = np.array([[j, i], [j + 1, i], [j + 1, i + 1], [j, i + 1]], float) * size
            whole = abs(G.signed_area(p))
            out.append(G.intersection_area(p, box) / whole if whole > 0 else 0.0)
        return pd.Series(out, dtype="float64")

    return cells.select(key, "row", "col", share("ring", "row", "col").alias("weight")).where("weight > 0")


def blurred(pixels: DataFrame, keys: list[str], value: str, out: str = "blurred", kernel: tuple[float, ...] = (0.0625, 0.25, 0.375, 0.25, 0.0625)) -> DataFrame:
    """Separable smoothing along columns, then rows, of dense patches; at the rim the weights that fall outside are left out."""
    half = len(kernel) // 2

    def along(df: DataFrame, source: str, target: str, fixed: str, axis: str) -> DataFrame:
        w = W.partitionBy(*keys, fixed).orderBy(axis)
        total, weight = F.lit(0.0), F.lit(0.0)
        for k, share in enumerate(kernel):
            v = F.lag(source, half - k).over(w)
            total, weight = total + F.coalesce(v * share, F.lit(0.0)), weight + F.when(v.isNotNull(), share).otherwise(0.0)
        return df.withColumn(target, total / weight)

    return along(along(pixels, value, "__h", "row", "col"), "__h", out, "col", "row").drop("__h")


def change_map(pixels: DataFrame, keys: list[str], date: str, value: str) -> DataFrame:
    """Per pixel and date the z-score within the date, its difference to the date before, and the variance over dates."""
    day = W.partitionBy(*keys, date)
    spot = W.partitionBy(*keys, "row", "col")
    z = (F.col(value) - F.avg(value).over(day)) / F.nullif(F.stddev_pop(value).over(day), F.lit(0.0))
    scored = pixels.withColumn("z", z)
    return scored.withColumns({"difference": F.col("z") - F.lag("z").over(spot.orderBy(date)), "variance": F.var_pop("z").over(spot)})


def square_patch(pixels: DataFrame, keys: list[str], side: int, bands: list[str]) -> DataFrame:
    """Per key a side x side array of each band around the mean pixel of the crown, 0 where there is none."""
    centre = pixels.groupBy(*keys).agg(F.floor(F.avg("row")).cast("int").alias("__r"), F.floor(F.avg("col")).cast("int").alias("__c"))
    near = pixels.join(centre, keys).withColumns({"__i": F.col("row") - F.col("__r") + side // 2, "__j": F.col("col") - F.col("__c") + side // 2}).where(F.col("__i").between(0, side - 1) & F.col("__j").between(0, side - 1))
    index = F.col("__i") * side + F.col("__j")
    made = near.groupBy(*keys).agg(*[F.map_from_entries(F.collect_list(F.struct(index, F.col(b).cast("double")))).alias(b) for b in bands])
    dense = lambda m: F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda k: F.coalesce(F.try_element_at(m, k), F.lit(0.0)))
    return made.withColumns({b: dense(F.col(b)) for b in bands})


def _window(grid, left, top, right, bottom):
    """The pixels of a grid that bounds take: offsets rounded down, lengths to the nearest, inside of the grid."""
    start = lambda v: F.greatest(F.floor(v + 1e-6), F.lit(0)).cast("int")
    col, row = start((left - grid["left"]) / grid["size_x"]), start((grid["top"] - top) / grid["size_y"])
    length = lambda v, at, most: F.least(F.floor(v + 0.5).cast("int"), most - at)
    height, width = length((top - bottom) / grid["size_y"], row, grid["height"]), length((right - left) / grid["size_x"], col, grid["width"])
    return F.struct(row.alias("row"), col.alias("col"), height.alias("height"), width.alias("width"))


def overlap_windows(grids: DataFrame, ref: str = "ref", mov: str = "mov") -> DataFrame:
    """Grids with ref_window and mov_window (row, col, height, width): what two north-up rasters share, in the pixels of each.

    ref and mov: structs of left, top, size_x, size_y (map units, sizes positive), height and width (pixels). Both windows
    are null where the rasters do not meet, where one takes fewer than two rows or columns, or where a field is null.
    """
    a, b = F.col(ref), F.col(mov)
    right, bottom = (lambda g: g["left"] + g["width"] * g["size_x"]), (lambda g: g["top"] - g["height"] * g["size_y"])
    both = [F.when(a[f].isNotNull() & b[f].isNotNull(), end(a[f], b[f])) for f, end in (("left", F.greatest), ("top", F.least))]
    both += [F.when(edge(a).isNotNull() & edge(b).isNotNull(), end(edge(a), edge(b))) for edge, end in ((right, F.least), (bottom, F.greatest))]
    made = grids.withColumns({"ref_window": _window(a, *both), "mov_window": _window(b, *both)})
    large = (both[0] < both[2]) & (both[3] < both[1])
    for w in ("ref_window", "mov_window"):
        large &= (F.col(f"{w}.height") >= 2) & (F.col(f"{w}.width") >= 2)
    large = F.coalesce(large, F.lit(False))
    return made.withColumn("__large", large).withColumns({w: F.when(F.col("__large"), F.col(w)) for w in ("ref_window", "mov_window")}).drop("__large")


def matched(pixels: DataFrame, windows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, row, col, value): the moving raster's window, bilinear, in the shape of the reference's window.

    pixels: keys, row, col, value of the moving rasters. row and col count from the corner of the reference's window. Each pixel is the
    weighted mean of up to four pixels around its centre; missing pixels and null values are left out, and a pixel without any has no row. No smoothing goes before.
    """

    def places(side: str, n: str, axis: str):
        count, own = F.col(f"ref_window.{n}"), F.col(f"mov_window.{n}")
        spot = lambda i: F.least(F.greatest((i + 0.5) * own / count - 0.5, F.lit(0.0)), own - 1.0)
        low = lambda i: F.floor(spot(i)).cast("int")
        one = lambda i, up: F.struct(i.alias(axis), (F.col(f"mov_window.{axis}") + low(i) + up).alias("at"), (spot(i) - low(i) if up else 1.0 - (spot(i) - low(i))).alias("weight"))
        return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.array(one(i, 0), one(i, 1)))), lambda p: p["weight"] > 0).alias(side)

    found = windows.where(F.col("ref_window").isNotNull()).select(*keys, F.inline(F.array(F.struct("ref_window", "mov_window"))))  # computed once a patch
    rows = found.select(*keys, places("__r", "height", "row"), places("__c", "width", "col"))
    rows = rows.select(*keys, F.explode("__r").alias("__r"), "__c").select(*keys, "__r", F.explode("__c").alias("__c"))
    want = rows.select(*keys, F.col("__r.row").alias("__row"), F.col("__c.col").alias("__col"), F.col("__r.at").alias("row"), F.col("__c.at").alias("col"), (F.col("__r.weight") * F.col("__c.weight")).alias("__w"))
    met = want.join(pixels.where(F.col(value).isNotNull()).select(*keys, "row", "col", value), [*keys, "row", "col"])
    mean = F.sum(F.col("__w") * F.col(value)) / F.sum("__w")
    return met.groupBy(*keys, "__row", "__col").agg(mean.alias(value)).withColumnsRenamed({"__row": "row", "__col": "col"})
