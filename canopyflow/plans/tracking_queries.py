"""Scores, gates, virtual edges, detection matching and chain reports (J, X, G) on box crowns with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyflow.operators import alignment as L
from canopyflow.operators import matching as M
from canopyflow.operators import reports as P
from canopyflow.operators import tracking_graph as X
from canopyflow.plans import standins as D
from canopyflow.plans.catalog import register
from canopyflow.plans.geometry_queries import BOX, C_SQL, CHAIN_SQL, E_SQL, P_SQL, box_pairs, crowns, nodes, overlap, plain_edges, walked, widest
from canopyflow.plans.series_queries import r9, rounded
from canopyflow.session import table

#: Pairs with the parts of the similarity, the centre factor and the balance.
S_SQL = f"""{P_SQL}, k AS (SELECT *, greatest(0, 1 - distance / 30.0) AS spatial, least(aa, ab) / greatest(aa, ab) AS balance,
  greatest(0, 1 - least(1, distance / (greatest((sqrt(aa / pi()) + sqrt(ab / pi())) / 2, 1e-3) * 3))) AS centre FROM n)"""


def case_sql(configs: list[M.CaseConfig]) -> str:
    """CASE expressions of J4 and J7 for each kind."""
    part = {"spatial": "spatial", "area": "balance", "shape": "shape", "iou": "iou", "overlap_prev": "op", "overlap_curr": "oc", "centroid": "centre", "area_balance": "balance"}
    base, score, ok = "CASE kind", "CASE kind", "CASE kind"
    for c in configs:
        b = " + ".join(f"{w} * {part[k]}" for k, w in c.base_weights.items())
        s = " + ".join(f"{w} * ({b})" if k == "base" else f"{w} * {part[k]}" for k, w in c.scoring.items())
        gates = f"iou >= {c.min_iou} AND op >= {c.min_overlap_prev} AND oc >= {c.min_overlap_curr} AND distance <= {c.max_centroid_dist} AND ({s}) >= {c.similarity_threshold} AND ({b}) >= 0.1"
        base, score, ok = f"{base} WHEN '{c.name}' THEN {b}", f"{score} WHEN '{c.name}' THEN {s}", f"{ok} WHEN '{c.name}' THEN {gates}"
    return f"SELECT prev, curr, kind, round({base} END, 8) AS base, round({score} END, 8) AS score FROM k WHERE {ok} ELSE FALSE END"


def scored(spark: SparkSession, sf: str, configs: list[M.CaseConfig]) -> DataFrame:
    made = M.scored_candidates(box_pairs(spark, sf), configs, 0.1)
    return made.select(F.col("crown_idx").alias("prev"), F.col("crown_idx_b").alias("curr"), F.col("case").alias("kind"), F.round("base_similarity", 8).alias("base"), F.round("score", 8).alias("score"))


@register("j4_relaxed_scores", f"WITH {S_SQL} {case_sql(M.ultra_relaxed_cases())}")
def j4(spark: SparkSession, sf: str) -> DataFrame:
    """The tracker's own cases."""
    return scored(spark, sf, M.ultra_relaxed_cases())


@register("j7_strict_scores", f"WITH {S_SQL} {case_sql(M.strict_aligned_cases())}")
def j7(spark: SparkSession, sf: str) -> DataFrame:
    """The cases for aligned flights."""
    return scored(spark, sf, M.strict_aligned_cases())


@register("j13_threshold_pairs", f"WITH {P_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY om_id, prev ORDER BY similarity DESC, om_id + 1, curr) AS r FROM n WHERE similarity >= 0.3 AND distance <= 25 AND iou >= 0.02) SELECT prev, curr, round(similarity, 9) AS similarity FROM t WHERE r <= 2")
def j13(spark: SparkSession, sf: str) -> DataFrame:
    made = M.threshold_pairs(box_pairs(spark, sf), 0.3, 25.0, 0.02, 2)
    return made.select(F.col("crown_idx").alias("prev"), F.col("crown_idx_b").alias("curr"), r9("base_similarity").alias("similarity"))


VIRTUAL_SQL = f"""{C_SQL}, p AS (SELECT a.om_id AS om_prev, a.crown_idx AS prev, b.om_id AS om_curr, b.crown_idx AS curr, a.area AS aa, b.area AS ab, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS distance,
    greatest(least(a.maxx, b.maxx) - greatest(a.minx, b.minx), 0) * greatest(least(a.maxy, b.maxy) - greatest(a.miny, b.miny), 0) AS i, (2 - abs(a.compactness - b.compactness) - abs(a.eccentricity - b.eccentricity)) / 2 AS shape
  FROM c a JOIN c b ON b.om_id > a.om_id AND abs(a.x - b.x) <= 75 AND abs(a.y - b.y) <= 75),
v AS (SELECT *, 0.4 * greatest(0, 1 - distance / 75.0) + 0.2 * least(aa, ab) / greatest(aa, ab) + 0.2 * shape + 0.2 * i / (aa + ab - i) AS similarity, om_curr - om_prev AS gap FROM p WHERE distance <= 75),
w AS (SELECT prev, curr, gap, similarity * exp(-0.9 * (gap - 1)) AS score FROM v WHERE (i / aa >= 0.48 OR i / ab >= 0.48) AND similarity >= 0.35)"""


def virtual(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes one of which the other covers by the gate share a side of at least the gate times its own, so their centres lie
    (a + b) / 2 - 0.48 min(a, b) apart along an axis at most: 0.52 times the widest."""
    c = crowns(spark, sf).drop("size", "brand")
    return M.virtual_pairs(c, overlap, reach=0.52 * widest(c) + 1e-6)


@register("j15_virtual_pairs", f"WITH {VIRTUAL_SQL} SELECT prev, curr, gap::INTEGER AS gap, round(score, 9) AS score FROM w")
def j15(spark: SparkSession, sf: str) -> DataFrame:
    return virtual(spark, sf).select(F.col("crown_idx").alias("prev"), F.col("crown_idx_b").alias("curr"), F.col("gap").cast("int").alias("gap"), r9("score").alias("score"))


@register("j14_virtual_edges")
def j14(spark: SparkSession, sf: str) -> DataFrame:
    """The virtual pairs, best first, every end once over all flights."""
    pairs = virtual(spark, sf).select(F.col("crown_idx").alias("prev"), F.col("crown_idx_b").alias("curr"), F.round("score", 9).alias("score"))
    return M.greedy_one_to_one(pairs, "prev", "curr", [("score", True)])


@register("x19_patched_edges")
def x19(spark: SparkSession, sf: str) -> DataFrame:
    node = lambda s: F.struct(F.col("om_id" + s).alias("om_id"), F.col("crown_idx" + s).alias("crown_idx"))
    candidates = virtual(spark, sf).select(node("").alias("prev"), node("_b").alias("curr"), F.round("score", 9).alias("score"))
    made = X.patched_edges(nodes(spark, sf), plain_edges(spark, sf), candidates)
    return made.select(F.col("prev.crown_idx").alias("prev"), F.col("curr.crown_idx").alias("curr"), "score")


NEAR_SQL = f"""{C_SQL}, g AS (SELECT * FROM c WHERE crown_idx % 2 = 0), d AS (SELECT * FROM c WHERE crown_idx % 2 = 1),
p AS (SELECT g.crown_idx AS gt_id, d.crown_idx AS pred_id, sqrt(power(g.x - d.x, 2) + power(g.y - d.y, 2)) AS distance, g.area AS area, d.area AS area_b,
  greatest(least(g.maxx, d.maxx) - greatest(g.minx, d.minx), 0) * greatest(least(g.maxy, d.maxy) - greatest(g.miny, d.miny), 0) AS i FROM g JOIN d ON abs(g.x - d.x) <= 30 AND abs(g.y - d.y) <= 30),
u AS (SELECT *, round(i / (area + area_b - i), 9) AS iou FROM p WHERE distance <= 30)"""


def detections(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Even crowns as truths, odd ones as predictions, and their near pairs with IoU."""
    c = crowns(spark, sf).drop("size", "brand")
    t, p = c.where("crown_idx % 2 = 0"), c.where("crown_idx % 2 = 1")
    i = overlap("", "_b")
    pairs = M.near_pairs(t, p, 30.0, F.lit(True)).withColumn("iou", F.round(i / (F.col("area") + F.col("area_b") - i), 9))
    return t.select(F.col("crown_idx").alias("gt_id")), p.select(F.col("crown_idx").alias("pred_id")), pairs.select(F.col("crown_idx").alias("gt_id"), F.col("crown_idx_b").alias("pred_id"), "iou", "area", "area_b", "distance")


@register("j17_mutual_nearest", f"WITH {NEAR_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY gt_id ORDER BY distance, pred_id) AS a, row_number() OVER (PARTITION BY pred_id ORDER BY distance, gt_id) AS b FROM u) SELECT gt_id, pred_id, round(distance, 9) AS distance FROM r WHERE a = 1 AND b = 1")
def j17(spark: SparkSession, sf: str) -> DataFrame:
    c = crowns(spark, sf).select(F.col("crown_idx").alias("id"), "x", "y")
    made = M.mutual_nearest(c.where("id % 2 = 0"), c.where("id % 2 = 1"), 30.0)
    return made.select(F.col("id").alias("gt_id"), F.col("id_b").alias("pred_id"), r9("distance").alias("distance"))


@register("j18_detection_metrics", f"""WITH {NEAR_SQL}, m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pred_id ORDER BY iou DESC, gt_id) AS r FROM u WHERE iou >= 0.3) WHERE r = 1),
s AS (SELECT count(DISTINCT gt_id) AS tp, count(*) AS k, avg(iou) AS mean_iou, (SELECT count(*) FROM g) AS ng, (SELECT count(*) FROM d) AS nd FROM m)
SELECT tp, nd - k AS fp, ng - tp AS fn, round(tp / nd::DOUBLE, 9) AS precision, round(tp / ng::DOUBLE, 9) AS recall, round(2.0 * (tp / nd::DOUBLE) * (tp / ng::DOUBLE) / nullif(tp / nd::DOUBLE + tp / ng::DOUBLE, 0), 9) AS f1, round(mean_iou, 9) AS mean_iou FROM s""")
def j18m(spark: SparkSession, sf: str) -> DataFrame:
    t, p, pairs = detections(spark, sf)
    return rounded(M.detection_metrics(M.detection_matches(pairs, 0.3), t.count(), p.count()), "precision", "recall", "f1", "mean_iou")


@register("j19_one_to_one_detections")
def j19(spark: SparkSession, sf: str) -> DataFrame:
    return M.detection_one_to_one(detections(spark, sf)[2].select("gt_id", "pred_id", "iou"), 0.2)


ERRORS_SQL = f"""{NEAR_SQL}, h AS (SELECT *, count(*) FILTER (WHERE iou >= 0.15) OVER (PARTITION BY gt_id) AS of_gt, count(*) FILTER (WHERE iou >= 0.15) OVER (PARTITION BY pred_id) AS of_pred, row_number() OVER (PARTITION BY gt_id ORDER BY iou DESC, pred_id) AS r FROM u),
e AS (SELECT CASE WHEN iou >= 0.5 THEN 'tp' WHEN of_gt > 1 THEN 'split' WHEN of_pred > 1 THEN 'merge' WHEN iou < 0.15 THEN 'poor_overlap' WHEN abs(area - area_b) / greatest(area, area_b) > 0.3 THEN 'boundary' ELSE 'poor_overlap' END AS kind, gt_id, pred_id FROM h WHERE r = 1
  UNION ALL SELECT 'missing', crown_idx, NULL FROM g WHERE crown_idx NOT IN (SELECT gt_id FROM u) UNION ALL SELECT 'false_positive', NULL, crown_idx FROM d WHERE crown_idx NOT IN (SELECT pred_id FROM u))"""


def errors(spark: SparkSession, sf: str) -> DataFrame:
    t, p, pairs = detections(spark, sf)
    return M.error_classes(pairs, t, p)


@register("j20_error_classes", f"WITH {ERRORS_SQL} SELECT kind, gt_id, pred_id FROM e")
def j20(spark: SparkSession, sf: str) -> DataFrame:
    return errors(spark, sf)


@register("g30_conditional_metrics", f"""WITH {ERRORS_SQL}, s AS (SELECT * FROM (VALUES {", ".join(f"('{k}', [{', '.join(repr(x) for x in v)}]::VARCHAR[])" for k, v in P.SCENARIOS.items())}) t(scenario, left_out)),
k AS (SELECT scenario, count(*) FILTER (WHERE kind = 'tp') AS tp, count(*) FILTER (WHERE kind = 'false_positive' AND NOT list_contains(left_out, kind)) AS fp, count(*) FILTER (WHERE kind = 'missing' AND NOT list_contains(left_out, kind)) AS fn,
  count(*) FILTER (WHERE kind IN ('split', 'merge', 'poor_overlap', 'boundary') AND NOT list_contains(left_out, kind)) AS o FROM e CROSS JOIN s GROUP BY 1), q AS (SELECT *, coalesce(tp / nullif((tp + fp + o)::DOUBLE, 0), 0) AS p, coalesce(tp / nullif((tp + fn + o)::DOUBLE, 0), 0) AS r FROM k)
SELECT scenario, tp, fp, fn, round(p, 9) AS precision, round(r, 9) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 9) AS f1 FROM q""")
def g30(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.conditional_metrics(errors(spark, sf)), "precision", "recall", "f1")


@register("j31_reference_matches", f"""WITH {C_SQL}, p AS (SELECT a.crown_idx AS ref, b.om_id, b.crown_idx AS crown, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS distance, a.area AS aa, b.area AS ab,
    greatest(least(a.maxx, b.maxx) - greatest(a.minx, b.minx), 0) * greatest(least(a.maxy, b.maxy) - greatest(a.miny, b.miny), 0) AS i FROM c a JOIN c b ON a.om_id = 1 AND abs(a.x - b.x) <= 35 AND abs(a.y - b.y) <= 35),
s AS (SELECT *, round(i / (aa + ab - i) - distance / 35.0, 9) AS score FROM p WHERE distance <= 35) SELECT ref, om_id, crown, score + 0.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY ref, om_id ORDER BY i / (aa + ab - i) - distance / 35.0 DESC, crown) AS r FROM s) WHERE r = 1""")
def j31(spark: SparkSession, sf: str) -> DataFrame:
    c = crowns(spark, sf).drop("size", "brand")
    made = M.reference_matches(c.where("om_id = 1"), c, overlap, "crown_idx")
    return made.select(F.col("crown_idx").alias("ref"), F.col("om_id_b").alias("om_id"), F.col("crown_idx_b").alias("crown"), r9("score").alias("score"))


@register("j32_not_overlapping", f"WITH {P_SQL} SELECT om_id, crown_idx FROM boxes WHERE crown_idx NOT IN (SELECT prev FROM n WHERE iou >= 0.01)")
def j32(spark: SparkSession, sf: str) -> DataFrame:
    pairs = box_pairs(spark, sf)
    return M.not_overlapping(D.boxes(spark, sf), D.boxes(spark, sf), pairs, ["om_id", "crown_idx"], 0.01).select("om_id", "crown_idx")


@register("g20_matching_details", f"""WITH {P_SQL} SELECT kind, om_id, count(*) AS n_edges, round(count(*) / (SELECT count(*) FROM n)::DOUBLE, 9) AS share, round(avg(similarity), 9) AS similarity_mean, round(min(similarity), 9) AS similarity_min, round(max(similarity), 9) AS similarity_max,
  round(median(similarity), 9) AS similarity_median, round(avg(iou), 9) + 0.0 AS iou_mean FROM n GROUP BY 1, 2""")
def g20(spark: SparkSession, sf: str) -> DataFrame:
    edges = box_pairs(spark, sf).select("om_id", F.col("case").alias("kind"), F.col("base_similarity").alias("similarity"), "iou")
    made = P.matching_details(edges, ["kind", "om_id"])
    return rounded(made, "share", "similarity_mean", "similarity_min", "similarity_max", "similarity_median", "iou_mean")


STEPS_SQL = f"""{CHAIN_SQL}, st AS (SELECT start, position, node, lead(node) OVER (PARTITION BY start ORDER BY position) AS nxt FROM chains),
se AS (SELECT start, position, node, nxt, n.kind, round(n.similarity, 9) AS s FROM st LEFT JOIN n ON n.prev = st.node AND n.curr = st.nxt WHERE nxt IS NOT NULL),
ln AS (SELECT start, count(*) AS length FROM chains GROUP BY 1)"""


@register("g19_chain_lengths", f"WITH RECURSIVE {STEPS_SQL} SELECT length, count(*) AS n_chains FROM ln GROUP BY 1")
def g19l(spark: SparkSession, sf: str) -> DataFrame:
    return X.length_histogram(walked(spark, sf)[2])


@register("x3_chain", f"WITH RECURSIVE {STEPS_SQL}, f AS (SELECT min(start) AS s FROM ln WHERE length = (SELECT max(length) FROM ln)) SELECT position::INTEGER AS position, node FROM chains JOIN f ON start = s")
def x3(spark: SparkSession, sf: str) -> DataFrame:
    c = walked(spark, sf)[2]
    longest = c.groupBy("start").agg(F.count("*").alias("length")).orderBy(F.desc("length"), "start.crown_idx").limit(1)
    return X.chain_of(c.join(F.broadcast(longest.select("start")), "start"), F.col("start")).select("position", F.col("node.crown_idx").alias("node"))


@register("x5_backbones", f"""WITH RECURSIVE {STEPS_SQL}, o AS (SELECT chains.start, chains.position, n.curr, CASE kind WHEN 'one_to_one' THEN 3 WHEN 'containment' THEN 2 WHEN 'nearby' THEN 1 ELSE 0 END AS quality, round(similarity, 9) AS s FROM chains JOIN n ON n.prev = chains.node WHERE kind <> 'none')
SELECT start, position::INTEGER AS position, curr, quality::INTEGER AS quality FROM (SELECT *, row_number() OVER (PARTITION BY start, position ORDER BY quality DESC, s DESC, curr) AS r FROM o) WHERE r = 1""")
def x5(spark: SparkSession, sf: str) -> DataFrame:
    _, e, c = walked(spark, sf, "backbone")
    return X.backbone(c, e).select(F.col("start.crown_idx").alias("start"), "position", F.col("curr.crown_idx").alias("curr"), "quality")


@register("x8_consensus_sources", f"""WITH RECURSIVE {STEPS_SQL}, deg AS (SELECT crown_idx AS node, (SELECT count(*) FROM e WHERE curr = crown_idx) AS i, (SELECT count(*) FROM e WHERE prev = crown_idx) AS o FROM boxes),
b AS (SELECT start, bool_or(i > 1 OR o > 1) AS branches FROM chains JOIN deg ON deg.node = chains.node GROUP BY 1), q AS (SELECT start, avg(CASE WHEN kind = 'one_to_one' THEN 1.0 ELSE 0.0 END) AS ratio FROM se GROUP BY 1)
SELECT start, length, quality FROM (SELECT ln.start, length, CASE WHEN length >= 5 AND NOT branches THEN 'Clean' WHEN length >= 5 THEN 'Mixed' WHEN length >= 2 AND coalesce(ratio, 0) >= 0.5 THEN 'Pure' END AS quality FROM ln JOIN b ON b.start = ln.start LEFT JOIN q ON q.start = ln.start) WHERE quality IS NOT NULL""")
def x8(spark: SparkSession, sf: str) -> DataFrame:
    """X6, X8, X10."""
    degrees, e, c = walked(spark, sf)
    made = X.consensus_sources(X.categories(c, degrees, 5), X.one_to_one_ratio(c, e), True, 2, 0.5)
    return made.select(F.col("start.crown_idx").alias("start"), "length", "quality")


@register("x17_edge_votes", f"""WITH {P_SQL}, r AS (SELECT k, prev, curr FROM n CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS k) t WHERE similarity >= 0.3 + 0.1 * k) SELECT prev, curr, round(count(*) / 4.0, 9) AS frequency FROM r GROUP BY 1, 2 HAVING count(*) >= 2""")
def x17(spark: SparkSession, sf: str) -> DataFrame:
    """Four runs of rising thresholds."""
    pairs = box_pairs(spark, sf).select(F.col("crown_idx").alias("prev"), F.col("crown_idx_b").alias("curr"), "base_similarity")
    runs = pairs.withColumn("run", F.explode(F.array(*[F.lit(k) for k in range(4)]))).where(F.col("base_similarity") >= F.lit(0.3) + F.col("run") * 0.1)
    return rounded(X.edge_votes(runs, 0.5), "frequency")


@register("x18_longest_chains", f"WITH RECURSIVE {STEPS_SQL} SELECT node, start, length FROM (SELECT node, chains.start, length, row_number() OVER (PARTITION BY node ORDER BY length DESC, b.om_id, chains.start) AS r FROM chains JOIN ln ON ln.start = chains.start JOIN boxes b ON b.crown_idx = chains.start) WHERE r = 1")
def x18(spark: SparkSession, sf: str) -> DataFrame:
    made = X.longest_chain_of_node(walked(spark, sf)[2])
    return made.select(F.col("node.crown_idx").alias("node"), F.col("start.crown_idx").alias("start"), "length")


@register("x20_high_confidence", f"WITH RECURSIVE {STEPS_SQL} SELECT start FROM se GROUP BY 1 HAVING bool_and(coalesce(s >= 0.45 AND kind IN ('one_to_one', 'containment'), FALSE))")
def x20(spark: SparkSession, sf: str) -> DataFrame:
    _, e, c = walked(spark, sf)
    return X.high_confidence(c, e, 0.45, ["one_to_one", "containment"]).select(F.col("start.crown_idx").alias("start"))


@register("u4_dedup_by_score")
def u4(spark: SparkSession, sf: str) -> DataFrame:
    category = F.element_at(F.array(*[F.lit(k) for k in X.CATEGORY_WEIGHTS]), (F.col("crown_idx") % 5 + 1).cast("int"))
    c = crowns(spark, sf).select(F.col("crown_idx").alias("chain_id"), "x", "y", "area", *BOX, (F.col("size") % 6).cast("long").alias("chain_length"), category.alias("chain_category"))
    # boxes with a fifth of their union in common lie four fifths of the widest side apart along an axis at most, one half in another half of it
    return X.spatial_dedup_by_score(c, M.Near(60.0, overlap, 0.8 * widest(c) + 1e-6), 0.5, 0.2).select("chain_id", "area")


@register("x9_gap_fill")
def x9(spark: SparkSession, sf: str) -> DataFrame:
    """Chains over two thirds of the crowns; the rest are the lower layer, next to copies that duplicate them."""
    from canopyflow.session import materialise, shared_dir

    c = D.rings(crowns(spark, sf)).select("om_id", "crown_idx", "x", "y", "area", "ring")
    kept, cut = c.where("crown_idx % 3 <> 0"), c.where("crown_idx % 3 = 0").withColumn("threshold", F.lit(0.25))
    cache = cut.unionByName(kept.where("crown_idx % 5 = 0").withColumn("threshold", F.lit(0.35)))
    path, own = shared_dir(spark), "prev.crown_idx % 3 <> 0 and curr.crown_idx % 3 <> 0"
    tops = materialise(X.edge_summary(plain_edges(spark, sf).where(own), similarity=F.col("similarity")), f"{path}/tops")
    best = materialise(plain_edges(spark, sf, tops).where(own), f"{path}/best")
    n = kept.select(F.struct("om_id", "crown_idx").alias("node"))
    made = X.fill_gaps(X.chains(n, best, 5, reached=tops.where("in_degree > 0")), n.select(F.col("node").alias("start")), kept, cache, 5)
    return made.select(F.col("start.crown_idx").alias("start"), "om_id", "crown_idx", "threshold", r9("iou").alias("iou"), "direction")


TILES_SQL = """t AS (SELECT l_linenumber AS om_id, l_quantity * 0.1 - 2 AS dy, l_discount * 100 - l_tax * 50 AS dx FROM lineitem), m AS (SELECT om_id, median(dy) AS my, median(dx) AS mx FROM t GROUP BY 1), a AS (SELECT t.om_id, median(abs(dy - my)) AS ay, median(abs(dx - mx)) AS ax FROM t JOIN m ON m.om_id = t.om_id GROUP BY 1),
r AS (SELECT t.om_id, median(dy) AS dy, median(dx) AS dx, count(*) AS n_inliers FROM t JOIN m ON m.om_id = t.om_id JOIN a ON a.om_id = t.om_id WHERE abs(dy - my) <= greatest(1.5 * 1.4826 * ay, 1e-6) AND abs(dx - mx) <= greatest(1.5 * 1.4826 * ax, 1e-6) GROUP BY 1)"""


def tiles(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("om_id"), (F.col("l_quantity") * 0.1 - 2).alias("dy"), (F.col("l_discount") * 100 - F.col("l_tax") * 50).alias("dx"))
    return L.robust_tile_shift(rows, 1.5)


@register("l3_robust_shifts", f"WITH {TILES_SQL} SELECT om_id, round(dy, 8) + 0.0 AS dy, round(dx, 8) + 0.0 AS dx, n_inliers FROM r")
def l3(spark: SparkSession, sf: str) -> DataFrame:
    return tiles(spark, sf).select("om_id", (F.round("dy", 8) + F.lit(0.0)).alias("dy"), (F.round("dx", 8) + F.lit(0.0)).alias("dx"), "n_inliers")


@register("l1_cumulative_shifts", f"WITH {TILES_SQL} SELECT f.om_id, round(sum(coalesce(dx, 0)) OVER (ORDER BY f.om_id), 8) + 0.0 AS dx, round(sum(coalesce(dy, 0)) OVER (ORDER BY f.om_id), 8) + 0.0 AS dy FROM (SELECT unnest(range(1, 10))::INTEGER AS om_id) f LEFT JOIN r ON r.om_id = f.om_id AND f.om_id % 2 = 0")
def l1(spark: SparkSession, sf: str) -> DataFrame:
    flights = spark.range(1, 10).select(F.col("id").cast("int").alias("om_id"))
    made = L.cumulative_shifts(tiles(spark, sf).where("om_id % 2 = 0").select("om_id", "dx", "dy"), flights)
    return made.select("om_id", (F.round("dx", 8) + F.lit(0.0)).alias("dx"), (F.round("dy", 8) + F.lit(0.0)).alias("dy"))


@register("l7_consecutive_shifts", f"""WITH {P_SQL}, q AS (SELECT m.om_id, a.x - b.x AS dx, a.y - b.y AS dy, row_number() OVER (PARTITION BY prev ORDER BY distance, curr) AS r, row_number() OVER (PARTITION BY curr ORDER BY distance, prev) AS s FROM m JOIN c a ON a.crown_idx = prev JOIN c b ON b.crown_idx = curr)
SELECT (om_id + 1)::INTEGER AS om_id, CASE WHEN count(*) >= 3 THEN round(median(dx), 9) + 0.0 END AS dx, CASE WHEN count(*) >= 3 THEN round(median(dy), 9) + 0.0 END AS dy, count(*) AS n, count(*) < 40 AS relaxed FROM q WHERE r = 1 AND s = 1 GROUP BY 1""")
def l7(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(L.consecutive_shifts(crowns(spark, sf), 30.0, 40, 30.0, 3), "dx", "dy")
