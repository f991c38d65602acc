"""The end-to-end flows as functions of DataFrames (J8, M17, M18, X6-X14): tracking and phenology."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyflow.operators import matching as M
from canopyflow.operators import timeseries as T
from canopyflow.operators import tracking_graph as X
from canopyflow.operators.alignment import centroid_shifts, cumulative_shifts
from canopyflow.operators.consensus import consensus
from canopyflow.functions.geometry import area, bounds, centroid, translate
from canopyflow.session import materialise, shared_dir


@dataclass(frozen=True)
class TrackingConfig:
    """The defaults of a tracking run, whose flights are aligned; M.ultra_relaxed_cases() are for others."""

    base_max_dist: float = 30.0
    overlap_gate: float = 0.10
    min_base_similarity: float = 0.30
    mode: str = "balanced"
    align: bool = True
    align_radius: float = 30.0
    align_pairs: int = 15
    min_partial_len: int = 5
    min_ratio: float = 0.9
    consensus: str = "medoid"
    fill_gaps: bool = True
    gap_min_threshold: float = 0.15
    gap_max_dist: float = 25.0
    gap_min_iou: float = 0.20
    gap_duplicate_iou: float = 0.70
    dedup_iou: float = 0.75
    cases: list[M.CaseConfig] = field(default_factory=M.strict_aligned_cases)


def aligned(crowns: DataFrame, config: TrackingConfig) -> tuple[DataFrame, DataFrame]:
    """Crowns moved by their flight's cumulative shift, and the shifts."""
    shifts = cumulative_shifts(centroid_shifts(crowns, config.align_radius, config.align_pairs), crowns.select("om_id").distinct())
    return moved(crowns, shifts), shifts


def moved(crowns: DataFrame, shifts: DataFrame) -> DataFrame:
    """Crowns with ring, x and y moved by the shift of their flight."""
    by = crowns.join(F.broadcast(shifts), "om_id").withColumn("ring", translate(F.col("ring"), F.col("dx"), F.col("dy")))  # a row for each flight
    return by.withColumns({"x": F.col("x") + F.col("dx"), "y": F.col("y") + F.col("dy")}).drop("dx", "dy")


def deduplicated(consensus_: DataFrame, iou: float, path: str) -> DataFrame:
    """U3 over consensus crowns (chain_id, ring, chain_length, avg_similarity): without those that a larger one holds or nearly equals.

    Crowns meet if their boxes can: within the sum of the two greatest half diagonals.
    """
    rows = consensus_.select("chain_id", "chain_length", "avg_similarity", "ring")
    c, b = centroid(F.col("ring")), bounds(F.col("ring"))
    rows = materialise(rows.withColumns({"x": c["x"], "y": c["y"], "area": area(F.col("ring")), "wide": F.hypot(b["maxx"] - b["minx"], b["maxy"] - b["miny"])}), f"{path}/consensus")
    reach = rows.agg(F.max("wide")).first()[0]
    if not reach:
        return consensus_
    pairs = M.near_pairs(rows.select("chain_id", "x", "y", "area", "ring"), rows.select("chain_id", "x", "y", "area", "ring"), reach, F.col("chain_id") < F.col("chain_id_b")).withColumn("i", M.ring_intersection("ring", "ring_b")).where("i > 0")
    rated = pairs.select("chain_id", "chain_id_b", (F.col("i") / (F.col("area") + F.col("area_b") - F.col("i"))).alias("iou"), (F.col("i") >= F.col("area_b") * (1 - 1e-9)).alias("contains"), (F.col("i") >= F.col("area") * (1 - 1e-9)).alias("held"))
    back = rated.select(F.col("chain_id_b").alias("chain_id"), F.col("chain_id").alias("chain_id_b"), "iou", F.col("held").alias("contains"))
    kept = X.spatial_dedup(rows, rated.drop("held").unionByName(back), iou, path=f"{path}/dedup").select("chain_id")
    return consensus_.join(kept, "chain_id", "left_semi")


def track(crowns: DataFrame, flights: int, config: TrackingConfig | None = None, lower: DataFrame | None = None) -> dict[str, DataFrame]:
    """nodes, edges, chains, categories, consensus, report and shifts of crowns (om_id, crown_idx, ring).

    lower: crowns of lower thresholds (om_id, crown_idx, threshold, ring), moved by the same shifts; partial chains are prolonged by
    them (edges of case `gap_fill`) and assembled again before a consensus is taken. Of consensus crowns that are
    duplicates one stays. Measures, edges and chains are written below the shared folder once, so no result computes them again.
    """
    config = config or TrackingConfig()
    path = shared_dir(crowns.sparkSession)
    rows, out = M.with_measures(crowns.select("om_id", "crown_idx", "ring")), {}
    if lower is not None:
        lower = M.with_measures(lower.where(F.col("threshold") >= config.gap_min_threshold).select("om_id", "crown_idx", "threshold", "ring"))
    if config.align:
        rows, shifts = aligned(materialise(rows, f"{path}/measures"), config)
        out["shifts"] = shifts
        lower = moved(lower, shifts) if lower is not None else None
    rows = materialise(rows, f"{path}/crowns")
    pairs = M.near_pairs(rows, rows, config.base_max_dist, F.col("om_id_b") == F.col("om_id") + 1)
    contains = (M.ring_covers("ring", "ring_b"), M.ring_covers("ring_b", "ring"))
    measured = M.pair_measures(pairs, M.ring_intersection("ring", "ring_b"), config.base_max_dist, contains=contains)
    counted = M.overlap_counts(measured, ["om_id", "crown_idx"], ["om_id_b", "crown_idx_b"], config.overlap_gate)
    cased = counted.withColumn("case", M.match_case(config.overlap_gate, config.mode)).drop("ring", "ring_b")
    chosen = M.greedy_select(M.scored_candidates(cased, config.cases, config.min_base_similarity), config.cases, ["om_id", "om_id_b"], "crown_idx", "crown_idx_b")
    node = lambda s: F.struct(F.col("om_id" + s).alias("om_id"), F.col("crown_idx" + s).alias("crown_idx"))
    edges = chosen.select(node("").alias("prev"), node("_b").alias("curr"), F.col("score").alias("similarity"), "case", "iou", "distance")
    edges = materialise(edges, f"{path}/edges")

    def assembled(name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        nodes = rows.select(node("").alias("node"))
        chains = materialise(X.chains(nodes, edges, flights), f"{path}/{name}")
        return nodes, chains, X.categories(chains, X.degrees(nodes, edges), flights)

    nodes, chains, categories = assembled("chains")
    if lower is not None and config.fill_gaps:
        lower = materialise(lower, f"{path}/lower")
        partial = materialise(categories.where(F.col("category").isin("partial_long", "partial_short")).select("start"), f"{path}/partial")
        more, leads = X.augmented(chains, partial, rows, lower, edges, flights, config.gap_max_dist, config.gap_min_iou, config.gap_duplicate_iou, f"{path}/gaps")
        rows, edges = rows.unionByName(more), edges.unionByName(leads)
        nodes, chains, categories = assembled("filled_chains")
    sources = X.consensus_sources(categories, X.one_to_one_ratio(chains, edges), True, config.min_partial_len, config.min_ratio)
    similar = X.chain_edges(chains, edges).groupBy("start").agg(F.avg("similarity").alias("avg_similarity"))
    sources = sources.join(similar, "start", "left").select(F.col("start").alias("chain_id"), F.col("length").alias("chain_length"), "quality", "avg_similarity")
    placed = rows.select(node("").alias("node"), "om_id", "x", "y", "area", "ring")
    members = chains.withColumnRenamed("start", "chain_id").join(sources.select("chain_id"), "chain_id", "left_semi").join(placed, "node")
    shapes = consensus(members, config.consensus).join(sources, "chain_id")
    shapes = deduplicated(materialise(shapes, f"{path}/shapes"), config.dedup_iou, path)
    return out | {"nodes": nodes, "edges": edges, "chains": chains, "categories": categories, "consensus": shapes, "report": X.quality_report(nodes, edges)}


def phenology(features: DataFrame, dates: list[int], config: dict[str, float] | None = None) -> dict[str, DataFrame]:
    """scores, phases, summary and observations of patch features (chain_id, om_id, three signals, is_bad_observation)."""
    scores, phases = T.leaf_shed(features, dates, config)
    signals = ["veg_fraction_hsv", "gcc_mean", "laplacian_var"]
    return {"scores": scores, "phases": phases, "summary": T.temporal_summary(features, signals), "observations": T.observations(features, dates, signals)}
