"""Flight alignment by crown centroids and by image phase correlation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from canopyflow.operators.matching import near_pairs


def centroid_shifts(crowns: DataFrame, radius: float = 30.0, least: int = 15) -> DataFrame:
    """(om_id, dx, dy, n): median shift of every flight to the one before, over mutual nearest crowns; null for too few.

    crowns: om_id, crown_idx, x, y.
    """
    rows = crowns.select("om_id", "crown_idx", "x", "y")
    pairs = near_pairs(rows, rows, radius, F.col("om_id_b") == F.col("om_id") + 1)
    first = F.row_number().over(W.partitionBy("om_id", "crown_idx").orderBy("distance", "crown_idx_b"))
    second = F.row_number().over(W.partitionBy("om_id_b", "crown_idx_b").orderBy("distance", "crown_idx"))
    met = pairs.withColumns({"__p": first, "__q": second}).where("__p = 1 and __q = 1")
    ok = F.count("*") >= least
    return met.groupBy(F.col("om_id_b").alias("om_id")).agg(F.when(ok, F.median(F.col("x") - F.col("x_b"))).alias("dx"), F.when(ok, F.median(F.col("y") - F.col("y_b"))).alias("dy"), F.count("*").alias("n"))


def consecutive_shifts(crowns: DataFrame, radius: float = 30.0, least: int = 15, relaxed_radius: float = 50.0, relaxed_least: int = 5) -> DataFrame:
    """(om_id, dx, dy, n, relaxed): shifts of successive flights; a flight without enough pairs is tried again with relaxed limits."""
    strict = centroid_shifts(crowns, radius, least).where("dx is not null").select("om_id", "dx", "dy", "n", F.lit(False).alias("relaxed"))
    again = centroid_shifts(crowns, relaxed_radius, relaxed_least).join(strict.select("om_id"), "om_id", "left_anti").select("om_id", "dx", "dy", "n", F.lit(True).alias("relaxed"))
    return strict.union(again)


def cumulative_shifts(shifts: DataFrame, flights: DataFrame) -> DataFrame:
    """L1: (om_id, dx, dy) relative to the first flight; a flight without a shift of its own carries the one before."""
    w = W.orderBy("om_id")  # a row for each flight
    return flights.select("om_id").join(shifts, "om_id", "left").select("om_id", F.sum(F.coalesce("dx", F.lit(0.0))).over(w).alias("dx"), F.sum(F.coalesce("dy", F.lit(0.0))).over(w).alias("dy"))


def nearest_distances(crowns: DataFrame, radius: float = 30.0) -> DataFrame:
    """(om_id, median, p90, n) of the distance from each crown to the nearest one of the flight before."""
    rows = crowns.select("om_id", "crown_idx", "x", "y")
    pairs = near_pairs(rows, rows, radius, F.col("om_id_b") == F.col("om_id") - 1)
    near = pairs.groupBy("om_id", "crown_idx").agg(F.min("distance").alias("d"))
    return near.groupBy("om_id").agg(F.median("d").alias("median"), F.percentile("d", F.lit(0.9)).alias("p90"), F.count("*").alias("n"))


def phase_shift(ref: np.ndarray, mov: np.ndarray) -> tuple[float, float, float]:
    """L2: (rows, columns, peak) by which `mov` must be moved to meet `ref`; sub-pixel by a parabola through the peak."""
    a, b = ref - ref.mean(), mov - mov.mean()
    cross = np.fft.fft2(a) * np.conj(np.fft.fft2(b))
    r = np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12)).real
    p, q = np.unravel_index(int(r.argmax()), r.shape)

    def fine(left: float, mid: float, right: float) -> float:
        d = left - 2 * mid + right
        return 0.0 if d == 0 else 0.5 * (left - right) / d

    n, m = r.shape
    dy = p + fine(r[p - 1, q], r[p, q], r[(p + 1) % n, q])
    dx = q + fine(r[p, q - 1], r[p, q], r[p, (q + 1) % m])
    return float(dy - n if dy > n / 2 else dy), float(dx - m if dx > m / 2 else dx), float(r[p, q])


def tile_shifts(tiles: DataFrame, least_std: float = 2.0) -> DataFrame:
    """L2 / L3: (om_id, tile, dy, dx, peak) per tile; flat tiles are left out.

    tiles: om_id, tile, rows, cols, ref and mov as arrays of double in row order.
    """

    def run(batches):
        for b in batches:
            out = []
            for om, tile, n, m, ref, mov in zip(b["om_id"], b["tile"], b["rows"], b["cols"], b["ref"], b["mov"]):
                x, y = np.asarray(ref, float).reshape(n, m), np.asarray(mov, float).reshape(n, m)
                if min(x.std(), y.std()) >= least_std:
                    out.append((om, tile, *phase_shift(x, y)))
            yield pd.DataFrame(out, columns=["om_id", "tile", "dy", "dx", "peak"])

    return tiles.select("om_id", "tile", "rows", "cols", "ref", "mov").mapInPandas(run, "om_id int, tile int, dy double, dx double, peak double")


def robust_tile_shift(shifts: DataFrame, sigmas: float = 3.0, least: int = 4) -> DataFrame:
    """L3: (om_id, dy, dx, n_inliers): median over tiles within sigmas x 1.4826 MAD of the median in both axes; null for too few tiles."""
    med = shifts.groupBy("om_id").agg(F.median("dy").alias("__my"), F.median("dx").alias("__mx"))
    c = shifts.join(med, "om_id")
    mad = c.groupBy("om_id").agg(F.median(F.abs(F.col("dy") - F.col("__my"))).alias("__ay"), F.median(F.abs(F.col("dx") - F.col("__mx"))).alias("__ax"))
    near = lambda v, m, a: F.abs(F.col(v) - F.col(m)) <= F.greatest(sigmas * 1.4826 * F.col(a), F.lit(1e-6))
    inlier = c.join(mad, "om_id").where(near("dy", "__my", "__ay") & near("dx", "__mx", "__ax"))
    ok = F.count("*") >= least
    return inlier.groupBy("om_id").agg(F.when(ok, F.median("dy")).alias("dy"), F.when(ok, F.median("dx")).alias("dx"), F.count("*").alias("n_inliers"))
