"""Crown matching across flights (J1-J20, J31-J34): range joins, pair measures, cases, scores, selection.

Crowns are rows (om_id, crown_idx, ring) with measures. Candidate pairs come from a grid equi-join: every
crown goes to its cell, and the other side is copied to the 3 x 3 cells around its own, so only near pairs meet.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import BooleanType, DoubleType

from canopyflow.functions import geometry as G


def with_measures(crowns: DataFrame, ring: str = "ring") -> DataFrame:
    """C1-C4 of every crown: x, y, area, perimeter, compactness, aspect_ratio, and eccentricity by an Arrow function."""

    @F.pandas_udf(DoubleType())
    def eccentricity(rings: pd.Series) -> pd.Series:
        return rings.map(lambda r: G.eccentricity(G.as_points(r)) if r is not None else None)

    r = F.col(ring)
    c = G.centroid(r)
    return crowns.withColumns({"x": c["x"], "y": c["y"], "area": G.area(r), "perimeter": G.perimeter(r), "compactness": G.compactness(r), "aspect_ratio": G.aspect_ratio(r), "eccentricity": eccentricity(r)})


def near_pairs(left: DataFrame, right: DataFrame, radius: float, on: Column, x: str = "x", y: str = "y", suffix: str = "_b", reach: float | None = None) -> DataFrame:
    """Pairs of rows no further apart than radius for which `on` holds, with `distance`.

    The right side's columns get the suffix; `on` is written with it. A hot cell is split by the join's skew handling.
    reach: what the caller knows its pairs to lie apart along an axis at most, if that is less than the radius; cells are
    of that size then, and other pairs are left out. The join is never a broadcast: Spark's estimate of the copied side does
    not know of the nine copies, so that a table of a few MB would pass through the driver nine times over.
    """
    other = right.withColumnsRenamed({c: c + suffix for c in right.columns})
    size = radius if reach is None else min(radius, reach)
    cell = lambda c: F.floor(F.col(c) / size).cast("long")
    a = left.withColumns({"__cx": cell(x), "__cy": cell(y)})
    around = F.sequence(F.lit(-1), F.lit(1))
    b = other.withColumn("__dx", F.explode(around)).withColumn("__dy", F.explode(around))
    b = b.withColumns({"__bx": cell(x + suffix) + F.col("__dx"), "__by": cell(y + suffix) + F.col("__dy")})
    dx, dy = F.col(x) - F.col(x + suffix), F.col(y) - F.col(y + suffix)
    met = a.join(b.hint("merge"), (F.col("__cx") == F.col("__bx")) & (F.col("__cy") == F.col("__by")) & on)
    if size < radius:
        met = met.where((F.abs(dx) <= size) & (F.abs(dy) <= size))
    return met.withColumn("distance", F.sqrt(dx * dx + dy * dy)).where(F.col("distance") <= radius).drop("__cx", "__cy", "__bx", "__by", "__dx", "__dy")


@dataclass(frozen=True)
class Near:
    """Pairs of near rows that are met when they are asked for and never written: their radius, their shared area by the suffixes of both sides,
    and what pairs that matter lie apart along an axis at most, if the caller knows (see near_pairs)."""

    radius: float
    shared: Callable[[str, str], Column]
    reach: float | None = None


def with_near(rows: DataFrame, others: DataFrame, near: Near, on: Column, without: bool = False) -> DataFrame:
    """The rows that have one of the others near for which `on` holds (or have none); the others' columns end in _b. A row's search ends at the first one."""
    size = near.radius if near.reach is None else min(near.radius, near.reach)
    cell = lambda c: F.floor(F.col(c) / size).cast("long")
    dx, dy = F.col("x") - F.col("x_b"), F.col("y") - F.col("y_b")
    around = F.sequence(F.lit(-1), F.lit(1))
    b = others.withColumnsRenamed({c: c + "_b" for c in others.columns}).withColumn("__dx", F.explode(around)).withColumn("__dy", F.explode(around))
    b = b.withColumns({"__bx": cell("x_b") + F.col("__dx"), "__by": cell("y_b") + F.col("__dy")}).drop("__dx", "__dy")
    met = (F.col("__cx") == F.col("__bx")) & (F.col("__cy") == F.col("__by")) & (dx * dx + dy * dy <= near.radius * near.radius) & on
    return rows.withColumns({"__cx": cell("x"), "__cy": cell("y")}).join(b.hint("merge"), met, "left_anti" if without else "left_semi").drop("__cx", "__cy")


def settled(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows with the columns computed once each: a filter on them stays above them.

    Else Spark writes the whole expression of such a filter into the join's condition, every part as often as it is named, and the
    generated method becomes too long to be compiled.
    """
    return rows.select(*[c for c in rows.columns if c not in columns], F.inline(F.array(F.struct(*columns))))


def box_intersection(a: Column, b: Column) -> Column:
    """Area shared by two bounds."""
    w = F.least(a["maxx"], b["maxx"]) - F.greatest(a["minx"], b["minx"])
    h = F.least(a["maxy"], b["maxy"]) - F.greatest(a["miny"], b["miny"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def _padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rings of an Arrow column as ring_batch() gives them; null is a ring without vertices."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    points = lists.flatten()
    values = np.stack([points.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")], 1)
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return G.ring_batch(values, np.concatenate([[0], np.cumsum(size)]).astype(np.int64))


@F.arrow_udf(DoubleType())
def ring_intersection(a: pa.Array, b: pa.Array) -> pa.Array:
    """Area shared by two rings."""
    return pa.array(G.batch_intersections(*_padded(a), *_padded(b)), pa.float64())


@F.pandas_udf(BooleanType())
def ring_covers(outer: pd.Series, inner: pd.Series) -> pd.Series:
    """The first ring holds the second."""
    return pd.Series([G.covered_within(G.as_points(q), G.as_points(p)) for p, q in zip(outer, inner)], dtype="bool")


def pair_measures(pairs: DataFrame, intersection: Column, max_dist: float = 100.0, suffix: str = "_b", contains: tuple[Column, Column] | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """Overlap, IoU, radius, area balance, containment and similarity of pairs with measures of both sides.

    contains: whether the first holds the second and the other way round; by default from the shared area, with
    a tolerance of 1e-9.
    """
    a, b = F.greatest(F.col("area"), F.lit(1e-6)), F.greatest(F.col("area" + suffix), F.lit(1e-6))
    out = pairs.withColumn("intersection", intersection)
    i = F.col("intersection")
    out = out.withColumns(
        {
            "iou": F.coalesce(i / F.nullif(F.col("area") + F.col("area" + suffix) - i, F.lit(0.0)), F.lit(0.0)),
            "overlap_prev": i / a,
            "overlap_curr": i / b,
            "mean_radius": F.greatest((F.sqrt(a / F.pi()) + F.sqrt(b / F.pi())) / 2.0, F.lit(1e-3)),
            "balanced_area_ratio": F.least(a, b) / F.greatest(a, b),
            "prev_contains_curr": contains[0] if contains else i >= b * (1 - 1e-9),
            "curr_contains_prev": contains[1] if contains else i >= a * (1 - 1e-9),
        }
    )
    side = lambda s: {k: F.col(k + s) if k + s in out.columns else F.lit(0.0) for k in ("x", "y", "area", "compactness", "eccentricity")}
    parts = G.pair_similarity(side(""), side(suffix), F.col("iou"), weights, max_dist)
    return out.withColumns({f"{k}_similarity" if k != "similarity" else "base_similarity": c for k, c in parts.items() if k != "iou"})


def overlap_counts(pairs: DataFrame, prev: list[str], curr: list[str], gate: float) -> DataFrame:
    """How many partners each side overlaps by at least the gate, as prev_count and curr_count."""
    hit = F.count_if((F.col("overlap_prev") >= gate) | (F.col("overlap_curr") >= gate))
    return pairs.withColumns({"prev_count": hit.over(W.partitionBy(*prev)), "curr_count": hit.over(W.partitionBy(*curr))})


def match_case(gate: float, mode: str = "balanced") -> Column:
    """Containment, one_to_one, nearby or none, over pair_measures() and overlap_counts()."""
    p, c, iou, d = F.col("overlap_prev"), F.col("overlap_curr"), F.col("iou"), F.col("distance")
    # Least overlap, least IoU, greatest distance of one_to_one; near gate and distance of nearby.
    overlap, least_iou, far, near, near_far = {
        "strict": (max(gate, 0.30), max(gate / 2, 0.10), float("inf"), gate, 30.0),
        "lite": (max(gate, 0.10), max(gate * 0.5, 0.04), 50.0, max(gate * 0.5, 0.01), 50.0),
        "balanced": (max(gate, 0.15), max(gate * 0.5, 0.05), 40.0, max(gate * 0.5, 0.02), 35.0),
    }[mode]
    one = (p >= overlap) & (c >= overlap) & (iou >= least_iou) & (d < far)
    if mode == "strict":
        one = one & (F.col("prev_count") == 1) & (F.col("curr_count") == 1)
    nearby = (d < near_far) & ((p >= near) | (c >= near))
    return F.when(F.col("prev_contains_curr") | F.col("curr_contains_prev"), "containment").when(one, "one_to_one").when(nearby, "nearby").otherwise("none")


def trim(pairs: DataFrame, prev: list[str], curr: list[str], per_prev: int | None = None, per_curr: int | None = None) -> DataFrame:
    """The best per_prev pairs of each earlier crown, then the best per_curr of each later one, by IoU, then distance."""
    for keys, other, k in ((prev, curr, per_prev), (curr, prev, per_curr)):
        if k:
            order = W.partitionBy(*keys).orderBy(F.desc("iou"), "distance", *other)
            pairs = pairs.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k).drop("__r")
    return pairs


@dataclass(frozen=True)
class CaseConfig:
    """Limits and weights of one match case."""

    name: str
    similarity_threshold: float
    scoring: dict[str, float]
    base_weights: dict[str, float] = field(default_factory=dict)
    max_centroid_dist: float | None = None
    min_iou: float = 0.0
    min_overlap_prev: float = 0.0
    min_overlap_curr: float = 0.0
    max_per_prev: int | None = None
    max_per_curr: int | None = None
    allow_multiple: bool = False


def ultra_relaxed_cases() -> list[CaseConfig]:
    """The tracker's own cases, in order of priority."""
    return [
        CaseConfig("one_to_one", 0.25, {"base": 0.60, "iou": 0.10, "overlap_prev": 0.05, "overlap_curr": 0.05, "centroid": 0.20}, {"spatial": 0.50, "area": 0.15, "shape": 0.05, "iou": 0.30}, 50.0, 0.01, 0.10, 0.10, 3, 3, True),
        CaseConfig("containment", 0.25, {"base": 0.40, "overlap_prev": 0.30, "overlap_curr": 0.30}, {"spatial": 0.50, "area": 0.20, "shape": 0.10, "iou": 0.20}, 150.0, 0.0, 0.25, 0.25, 2, 2, True),
        CaseConfig("nearby", 0.20, {"base": 0.70, "centroid": 0.30}, {"spatial": 0.85, "area": 0.10, "shape": 0.03, "iou": 0.02}, 200.0, 0.0, 0.05, 0.05, 2, 2, True),
    ]


def strict_aligned_cases() -> list[CaseConfig]:
    """The cases for aligned flights, in order of priority."""
    return [
        CaseConfig("one_to_one", 0.40, {"base": 0.40, "iou": 0.30, "overlap_prev": 0.10, "overlap_curr": 0.10, "centroid": 0.10}, {"iou": 0.45, "spatial": 0.35, "area": 0.15, "shape": 0.05}, 10.0, 0.30, 0.20, 0.20, 2, 2, True),
        CaseConfig("containment", 0.35, {"base": 0.30, "overlap_prev": 0.35, "overlap_curr": 0.35}, {"iou": 0.40, "spatial": 0.35, "area": 0.20, "shape": 0.05}, 15.0, 0.30, 0.30, 0.30, 2, 2, True),
        CaseConfig("nearby", 0.30, {"base": 0.60, "centroid": 0.40}, {"iou": 0.35, "spatial": 0.45, "area": 0.15, "shape": 0.05}, 20.0, 0.10, 0.10, 0.10, 2, 2, True),
    ]


def case_base(config: CaseConfig) -> Column:
    """The similarity by the case's own weights; without any, base_similarity as it is."""
    if not config.base_weights:
        return F.col("base_similarity")
    out = F.lit(0.0)
    for name, w in config.base_weights.items():
        out = out + w * F.col("iou" if name == "iou" else f"{name}_similarity")
    return out


def case_score(config: CaseConfig, base: Column | None = None) -> Column:
    """Weighted sum of the components that the config names; base: case_base(), where it is a column already."""
    parts = {
        "base": case_base(config) if base is None else base, "spatial": F.col("spatial_similarity"), "area": F.col("area_similarity"), "shape": F.col("shape_similarity"), "iou": F.col("iou"),
        "overlap_prev": F.col("overlap_prev"), "overlap_curr": F.col("overlap_curr"), "area_balance": F.col("balanced_area_ratio"),
        "centroid": F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), F.col("distance") / (F.col("mean_radius") * 3.0))),
    }
    out = F.lit(0.0)
    for name, w in config.scoring.items():
        out = out + w * parts[name]
    return out


def scored_candidates(pairs: DataFrame, configs: list[CaseConfig], min_base: float = 0.0) -> DataFrame:
    """Pairs that pass their case's limits, with score, priority (the case's place in configs) and the case's base_similarity."""
    parts = ("iou", "overlap_prev", "overlap_curr", "spatial_similarity", "area_similarity", "shape_similarity", "balanced_area_ratio", "mean_radius", "distance", "case", "base_similarity")
    rated = settled(pairs, *[c for c in parts if c in pairs.columns])
    own, score, priority = F.col("base_similarity"), F.lit(None).cast("double"), F.lit(None).cast("int")
    for c in configs:
        own = F.when(F.col("case") == c.name, case_base(c)).otherwise(own)
    rated = settled(rated.withColumn("__base", own), "__base")
    for c in configs:
        score = F.when(F.col("case") == c.name, case_score(c, F.col("__base"))).otherwise(score)
    rated = settled(rated.withColumn("score", score), "score")
    for k, c in enumerate(configs):
        ok = (F.col("case") == c.name) & (F.col("iou") >= c.min_iou) & (F.col("overlap_prev") >= c.min_overlap_prev) & (F.col("overlap_curr") >= c.min_overlap_curr) & (F.col("__base") >= min_base)
        if c.max_centroid_dist is not None:
            ok = ok & (F.col("distance") <= c.max_centroid_dist)
        priority = F.when(ok & (F.col("score") >= c.similarity_threshold), k).otherwise(priority)
    rated = settled(rated.withColumn("priority", priority), "priority").where(F.col("priority").isNotNull())
    return rated.withColumn("base_similarity", F.col("__base")).drop("__base")


def greedy_select(pairs: DataFrame, configs: list[CaseConfig], group: list[str], prev: str, curr: str) -> DataFrame:
    """Per group (a pair of flights) candidates by priority, then score; the caps of a crown count over all cases.

    Equal scores keep (prev, curr) order. One task holds the candidates of one pair of flights.
    """
    caps = {k: (c.max_per_prev, c.max_per_curr, c.allow_multiple) for k, c in enumerate(configs)}

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["priority", "score", prev, curr], ascending=[True, False, True, True], kind="stable")
        of_prev: dict = {}
        of_curr: dict = {}
        keep = []
        for a, b, k in zip(rows[prev], rows[curr], rows["priority"]):
            most_prev, most_curr, several = caps[k]
            x, y = of_prev.get(a, 0), of_curr.get(b, 0)
            ok = not ((not several and (x or y)) or (most_prev is not None and x >= most_prev) or (most_curr is not None and y >= most_curr))
            keep.append(ok)
            if ok:
                of_prev[a], of_curr[b] = x + 1, y + 1
        return rows[keep]

    return pairs.groupBy(*group).applyInPandas(pick, pairs.schema)


def mutual_best(pairs: DataFrame, prev: list[str], curr: list[str], score: str = "score") -> DataFrame:
    """Pairs that are the best of both their ends; ties go to the lesser partner."""
    best = lambda keys, other: F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(score), *other))
    return pairs.withColumns({"__p": best(prev, curr), "__c": best(curr, prev)}).where("__p = 1 and __c = 1").drop("__p", "__c")


def greedy_one_to_one(pairs: DataFrame, left: str, right: str, order: list[tuple[str, bool]], path: str | None = None) -> DataFrame:
    """Pairs taken best first, each side once: rounds of pairs that are the best of both their ends.

    order: (column, descending). The result equals the sequential greedy choice; a round drops the pairs whose
    end is taken, and rounds go on until no pair is open. Every round takes the best open pair at least, so they
    end; a chain of ties needs a round for each of its pairs. Of repeated pairs the best one counts.
    Intermediate tables go below the session's shared folder.
    """
    from canopyflow.session import materialise, shared_dir

    spark, path = pairs.sparkSession, path or shared_dir(pairs.sparkSession)
    keys = [F.desc(c) if d else F.asc(c) for c, d in order] + [F.asc(left), F.asc(right)]
    once = F.row_number().over(W.partitionBy(left, right).orderBy(*keys))
    open_pairs, taken = materialise(pairs.withColumn("__n", once).where("__n = 1").drop("__n"), f"{path}/open0"), []
    while not open_pairs.isEmpty():
        k = len(taken) + 1
        ranked = open_pairs.withColumns({"__l": F.row_number().over(W.partitionBy(left).orderBy(*keys)), "__r": F.row_number().over(W.partitionBy(right).orderBy(*keys))})
        won = materialise(ranked.where("__l = 1 and __r = 1").drop("__l", "__r"), f"{path}/won{k}")
        taken.append(f"{path}/won{k}")
        for c in (left, right):
            ends = won.select(F.col(c).alias("__end"))
            open_pairs = open_pairs.join(ends, F.col(c).eqNullSafe(F.col("__end")), "left_anti")
        open_pairs = materialise(open_pairs, f"{path}/open{k}")
    return spark.read.schema(open_pairs.schema).parquet(*taken) if taken else pairs.limit(0)


def hungarian(cost) -> list[tuple[int, int]]:
    """Optimal assignment of a cost matrix (rows <= columns after transposition), by shortest augmenting paths."""
    c = np.asarray(cost, dtype=float)
    if c.size == 0:
        return []
    flip = c.shape[0] > c.shape[1]
    c = c.T if flip else c
    n, m = c.shape
    u, v, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = ~used[1:]
            slack = c[i0 - 1] - u[i0] - v[1:]
            better = free & (slack < least[1:])
            least[1:][better], way[1:][better] = slack[better], j0
            j1 = int(np.where(free, least[1:], np.inf).argmin()) + 1
            d = least[j1]
            u[match[used]] += d
            v[used] -= d
            least[~used] -= d
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    pairs = [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)


def assign_groups(pairs: DataFrame, group: list[str], left: str, right: str, cost: str, missing: float = 1.0) -> DataFrame:
    """J11 per group: the optimal one-to-one assignment; absent pairs cost `missing` and are not returned."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        grid = rows.pivot_table(index=left, columns=right, values=cost, aggfunc="min")
        chosen = {(grid.index[a], grid.columns[b]) for a, b in hungarian(grid.fillna(missing).to_numpy())}
        return rows[[(a, b) in chosen for a, b in zip(rows[left], rows[right])]].drop_duplicates([left, right])

    return pairs.groupBy(*group).applyInPandas(solve, pairs.schema)


def threshold_pairs(pairs: DataFrame, threshold: float = 0.3, max_dist: float | None = None, min_iou: float | None = None, top: int | None = None, prev: list[str] = ("om_id", "crown_idx")) -> DataFrame:
    """Pairs of at least a similarity, with optional gates and the best `top` of each earlier crown."""
    ok = F.col("base_similarity") >= threshold
    if max_dist is not None:
        ok = ok & (F.col("distance") <= max_dist)
    if min_iou is not None:
        ok = ok & (F.col("iou") >= min_iou)
    out = pairs.where(ok)
    if top:
        w = W.partitionBy(*prev).orderBy(F.desc("base_similarity"), *[c + "_b" for c in prev])
        out = out.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= top).drop("__r")
    return out


def gap_score(score: Column, gap: Column, alpha: float = 0.9) -> Column:
    """Score * exp(-alpha (gap - 1))."""
    return score * F.exp(-alpha * (gap - 1))


def virtual_pairs(crowns: DataFrame, intersection, max_dist: float = 75.0, gate: float = 0.48, min_base: float = 0.35, alpha: float = 0.9, max_gap: int | None = None, reach: float | None = None) -> DataFrame:
    """Candidate edges of every pair of flights in order, with `gap` (flights between them) and `score`, the
    similarity less the gap's penalty. Either side overlaps the other by the gate and the similarity is at least min_base.

    intersection: a function of the pair's suffixes ("", "_b") that gives the shared area as a Column.
    reach: what pairs that pass the gate lie apart along an axis at most, if the caller knows.
    """
    on = F.col("om_id") < F.col("om_id_b")
    if max_gap:
        on = on & (F.col("om_id_b") - F.col("om_id") <= max_gap)
    pairs = pair_measures(near_pairs(crowns, crowns, max_dist, on, reach=reach), intersection("", "_b"), max_dist)
    kept = settled(pairs, "overlap_prev", "overlap_curr", "base_similarity").where(((F.col("overlap_prev") >= gate) | (F.col("overlap_curr") >= gate)) & (F.col("base_similarity") >= min_base))
    gap = F.col("om_id_b") - F.col("om_id")
    return kept.withColumns({"gap": gap, "score": gap_score(F.col("base_similarity"), gap, alpha)})


def reference_matches(references: DataFrame, crowns: DataFrame, intersection, key: str, max_dist: float = 35.0) -> DataFrame:
    """For each reference polygon and flight the crown of the greatest IoU - distance / max_dist; the least crown on ties.

    Both sides have x, y, area; crowns have om_id, crown_idx; intersection as in virtual_pairs().
    """
    pairs = near_pairs(references, crowns, max_dist, F.lit(True))
    i = intersection("", "_b")
    rated = pairs.withColumn("iou", i / (F.col("area") + F.col("area_b") - i)).withColumn("score", F.col("iou") - F.col("distance") / max_dist)
    w = W.partitionBy(key, "om_id_b").orderBy(F.desc("score"), "crown_idx_b")
    return rated.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def mutual_nearest(left: DataFrame, right: DataFrame, radius: float, a: str = "id", b: str = "id", mutual: bool = True, path: str | None = None) -> DataFrame:
    """For each left row its nearest right row within radius; mutual keeps pairs that are nearest both ways; the least partner on ties.

    Pairs are met twice: for the least distance of every row, then for the pairs that reach one, which alone are dealt out and ranked.
    So disk grows with the rows, not with the pairs. Rows without a key take no part. The least distances go below the shared folder.
    """
    from canopyflow.session import materialise, shared_dir

    left, right, other = left.where(F.col(a).isNotNull()), right.where(F.col(b).isNotNull()), f"{b}_b"
    met = near_pairs(left, right, radius, F.lit(True)).select(a, other, "distance")
    least = materialise(met.groupingSets([[a], [other]], a, other).agg(F.min("distance").alias("__least")), f"{path or shared_dir(left.sparkSession)}/least")
    own = lambda key, name: least.where(F.col(key).isNotNull()).select(F.col(key).alias(name), "__least").hint("merge")
    pairs = near_pairs(left.join(own(a, a), a), right.join(own(other, b), b), radius, F.lit(True))
    pairs = settled(pairs, "distance").where((F.col("distance") <= F.col("__least")) | (F.col("distance") <= F.col("__least_b"))).drop("__least", "__least_b")
    w = lambda k, of: F.row_number().over(W.partitionBy(k).orderBy("distance", of))
    out = pairs.withColumns({"__a": w(a, other), "__b": w(other, a)}).where("__a = 1")
    return (out.where("__b = 1") if mutual else out).drop("__a", "__b")


def detection_matches(pairs: DataFrame, threshold: float, truth: str = "gt_id", pred: str = "pred_id") -> DataFrame:
    """Each prediction's best truth with IoU of at least the threshold; a truth may have several."""
    w = W.partitionBy(pred).orderBy(F.desc("iou"), truth)
    return pairs.where(F.col("iou") >= threshold).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def detection_one_to_one(pairs: DataFrame, threshold: float, truth: str = "gt_id", pred: str = "pred_id", order: str | None = None) -> DataFrame:
    """Predictions in their order (by default of their ids) each take the free truth of greatest IoU, at least the threshold; a truth is taken once."""
    return greedy_one_to_one(pairs.where(F.col("iou") >= threshold), truth, pred, [(order or pred, False), ("iou", True)])


def detection_metrics(matches: DataFrame, n_truth: int, n_pred: int, truth: str = "gt_id") -> DataFrame:
    """Tp (truths found), fp, fn, precision, recall, f1 and mean IoU of the matches."""
    base = matches.agg(F.count_distinct(truth).alias("tp"), F.count("*").alias("matched"), F.avg("iou").alias("mean_iou"))
    p, r = F.col("tp") / F.nullif(F.lit(float(n_pred)), F.lit(0.0)), F.col("tp") / F.nullif(F.lit(float(n_truth)), F.lit(0.0))
    return base.select("tp", (F.lit(n_pred) - F.col("matched")).alias("fp"), (F.lit(n_truth) - F.col("tp")).alias("fn"), p.alias("precision"), r.alias("recall"), (2 * p * r / F.nullif(p + r, F.lit(0.0))).alias("f1"), "mean_iou")


def error_classes(pairs: DataFrame, truths: DataFrame, preds: DataFrame, iou: float = 0.5, poor: float = 0.15, size_diff: float = 0.3) -> DataFrame:
    """(kind, gt_id, pred_id): tp, split, merge, poor_overlap, boundary, missing and false_positive.

    pairs: gt_id, pred_id, iou, area (truth), area_b (prediction).
    """
    hits = F.count_if(F.col("iou") >= poor)
    p = pairs.withColumns({"__of_gt": hits.over(W.partitionBy("gt_id")), "__of_pred": hits.over(W.partitionBy("pred_id")), "__r": F.row_number().over(W.partitionBy("gt_id").orderBy(F.desc("iou"), "pred_id"))})
    unlike = F.abs(F.col("area") - F.col("area_b")) / F.greatest(F.col("area"), F.col("area_b")) > size_diff
    kind = F.when(F.col("iou") >= iou, "tp").when(F.col("__of_gt") > 1, "split").when(F.col("__of_pred") > 1, "merge").when(F.col("iou") < poor, "poor_overlap").when(unlike, "boundary").otherwise("poor_overlap")
    found = p.where("__r = 1").select(kind.alias("kind"), "gt_id", "pred_id")
    missing = truths.select("gt_id").join(pairs.select("gt_id").distinct(), "gt_id", "left_anti").select(F.lit("missing").alias("kind"), "gt_id", F.lit(None).cast("long").alias("pred_id"))
    false = preds.select("pred_id").join(pairs.select("pred_id").distinct(), "pred_id", "left_anti").select(F.lit("false_positive").alias("kind"), F.lit(None).cast("long").alias("gt_id"), "pred_id")
    return found.unionByName(missing).unionByName(false)


def not_overlapping(rows: DataFrame, others: DataFrame, pairs: DataFrame, key: list[str], least_iou: float) -> DataFrame:
    """Rows that overlap no row of the other frame by least_iou or more."""
    return rows.join(pairs.where(F.col("iou") >= least_iou).select(*key).distinct(), key, "left_anti")


def potential_splits(pairs: DataFrame, prev: list[str], gate: float) -> DataFrame:
    """Earlier crowns that overlap at least two later ones by the gate, with the number of them."""
    return pairs.where((F.col("overlap_prev") >= gate) | (F.col("overlap_curr") >= gate)).groupBy(*prev).agg(F.count("*").alias("n_successors"), F.max("iou").alias("max_iou")).where("n_successors >= 2")


def candidate_flow(pairs: DataFrame, group: list[str], gate: float) -> DataFrame:
    """Pairs per stage of a pair of flights: all, overlapping, with a case, scored."""
    return pairs.groupBy(*group).agg(
        F.count("*").alias("n_pairs"), F.count_if((F.col("overlap_prev") >= gate) | (F.col("overlap_curr") >= gate)).alias("n_overlapping"), F.count_if(F.col("case") != "none").alias("n_cased")
    )
