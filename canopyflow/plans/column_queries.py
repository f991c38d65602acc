"""Column functions (B, C) and scans and sinks (A) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyflow.functions import geometry as G
from canopyflow.functions import names as N
from canopyflow.functions import spectral as S
from canopyflow.operators import evaluation as E
from canopyflow.plans import standins as D
from canopyflow.plans.catalog import register
from canopyflow.plans.label_queries import BASE_SQL, base
from canopyflow.plans.series_queries import r9, rounded
from canopyflow.session import materialise, shared_dir, table
from canopyflow.sources import tables as X


def event_stem() -> F.Column:
    """Stems of three kinds: dated, numbered, plain."""
    k = F.col("event_id") % 3
    return F.when(k == 0, F.concat(F.lit("lhc_"), F.date_format("ts", "dd-MM-yy"))).when(k == 1, F.concat(F.lit("sit_om"), (F.col("event_id") % 50).cast("string"))).otherwise(F.concat(F.lit("zeta"), (F.col("event_id") % 50).cast("string")))


@register("b2_sort_keys", "SELECT event_id, (event_id % 3)::INTEGER AS tier, CASE event_id % 3 WHEN 0 THEN date_diff('day', DATE '1970-01-01', ts::DATE) WHEN 1 THEN event_id % 50 ELSE 0 END AS value FROM events")
def b2(spark: SparkSession, sf: str) -> DataFrame:
    k = N.stem_sort_key(event_stem())
    return table(spark, sf, "events").select("event_id", k["tier"].alias("tier"), k["value"].alias("value"))


@register("b3_canonical_stems", "SELECT 'f' || user_id || '_dateUnknown_x' AS stem, count(*) AS n FROM events GROUP BY 1")
def b3(spark: SparkSession, sf: str) -> DataFrame:
    stem = F.concat(F.lit("f"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, "_dateUnknown_x").otherwise("_dateNotConfirmed_x"))
    return table(spark, sf, "events").groupBy(N.canonical_stem(stem).alias("stem")).agg(F.count("*").alias("n"))


@register("b6_areas", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'SV_S' || (p_size % 4 + 1) WHEN 1 THEN 'SIT' WHEN 2 THEN 'MITTAL' WHEN 3 THEN 'A' || p_size ELSE 'plot.' || p_size END AS area FROM part")
def b6(spark: SparkSession, sf: str) -> DataFrame:
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    name = F.when(k == 0, F.concat(F.lit("S"), (F.col("p_size") % 4 + 1).cast("string"), F.lit("_crowns.gpkg"))).when(k == 1, "SIT_crowns.gpkg").when(k == 2, "mittal.gpkg").when(k == 3, F.concat(F.lit("a"), size, F.lit("_x.gpkg"))).otherwise(F.concat(F.lit("dir/plot."), size, F.lit(".gpkg")))
    return table(spark, sf, "part").select("p_partkey", N.area_of_file(name).alias("area"))


@register("b9_traits", """SELECT p_partkey, CASE WHEN lower(p_type) LIKE '%econ%' OR lower(p_name) LIKE '%ring%' THEN 2 WHEN lower(p_type) LIKE '%stan%' OR lower(p_type) LIKE '%promo%' THEN 1 WHEN lower(p_type) LIKE '%small%' THEN 0 ELSE -1 END::INTEGER AS leaf_shed,
  lower(p_name) LIKE '%small%' OR lower(p_name) LIKE '%hot%' AS showy FROM part""")
def b9(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.col("p_type"), F.when(F.col("p_name").contains("ring"), " Ring").otherwise(""))
    return table(spark, sf, "part").select("p_partkey", N.leaf_shed_class(text, ["econ", "ring"], ["stan", "promo"], ["small"]).alias("leaf_shed"), N.showy(F.col("p_name"), ("small", "hot")).alias("showy"))


@register("b10_tree_types", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END::INTEGER AS label FROM part")
def b10(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    return table(spark, sf, "part").select("p_partkey", N.tree_type_label(F.when(k == 0, "Non-Acacia").when(k == 1, "ACACIA sp.").otherwise("other")).alias("label"))


@register("b13_renamed", "SELECT d.doc_id AS crown_id, coalesce(l.quality, -1)::INTEGER AS quality, coalesce(l.toxic, -1)::INTEGER AS label_toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def b13(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return N.renamed(rows, {"doc_id": "crown_id", "toxic": "label_toxic", "absent": "never"}, ["quality", "label_toxic"])


@register("b15_feature_columns", "SELECT unnest(['l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS name")
def b15(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").withColumn("label_x", F.lit(1))
    return spark.createDataFrame([(c,) for c in N.feature_columns(rows, ["l_orderkey"])], "name string")


@register("b16_labelled", f"WITH {BASE_SQL} SELECT source, count(*) AS n FROM b WHERE quality <> -1 OR rule <> -1 GROUP BY 1")
def b16(spark: SparkSession, sf: str) -> DataFrame:
    return N.labelled(base(spark, sf), "quality", "rule").groupBy("source").agg(F.count("*").alias("n"))


@register("b17_polygons", f"WITH {D.BOXES_SQL} SELECT crown_idx FROM boxes WHERE crown_idx % 6 >= 3 AND crown_idx % 6 < 5")
def b17(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("crown_idx") % 6
    ring = F.when(k < 5, F.slice("ring", 1, k.cast("int")))
    return D.rings(D.boxes(spark, sf)).where(G.is_polygon(ring)).select("crown_idx")


@register("b18_large_crowns", "SELECT d.p_partkey, coalesce(s.s_acctbal, 0.0) AS area_m2 FROM part d LEFT JOIN supplier s ON s.s_suppkey = d.p_partkey WHERE coalesce(s.s_acctbal, 0.0) >= 500")
def b18(spark: SparkSession, sf: str) -> DataFrame:
    areas = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("p_partkey"), F.col("s_acctbal").alias("area_m2"))
    return E.large_crowns(table(spark, sf, "part").select("p_partkey"), areas, "p_partkey", 500.0)


S2_SQL = """x AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_discount * 10000 + 100) / 10000 AS b, l_quantity * 50 / 10000 AS g, (l_tax * 10000 + 50) / 10000 AS r, l_linenumber * 300 / 10000.0 AS e, l_quantity * 100 / 10000 AS n, l_quantity * 90 / 10000 AS m,
  l_extendedprice / 20 / 10000 AS s, (l_linenumber * 200 + 10) / 10000.0 AS t FROM lineitem)"""


@register("b19_s2_indices", f"""WITH {S2_SQL} SELECT l_orderkey, l_linenumber, l_partkey, round((n - r) / (n + r), 8) + 0.0 AS ndvi, round((n - g) / (n + g), 8) + 0.0 AS gndvi, round((m - e) / (m + e), 8) + 0.0 AS ndre, round((n - s) / (n + s), 8) + 0.0 AS ndmi, round((n - t) / (n + t), 8) + 0.0 AS nbr,
  round(2.5 * (n - r) / nullif(n + 6 * r - 7.5 * b + 1, 0), 8) + 0.0 AS evi, round(r / greatest(r + g + b, 1e-4), 8) AS red_ratio, round(g / greatest(r + g + b, 1e-4), 8) AS green_ratio, round(b / greatest(r + g + b, 1e-4), 8) AS blue_ratio, round((g + r) / greatest(r + g + b, 1e-4), 8) AS yellow_proxy FROM x""")
def b19(spark: SparkSession, sf: str) -> DataFrame:
    q, line = F.col("l_quantity"), F.col("l_linenumber")
    made = S.s2_indices(F.col("l_discount") * 10000 + 100, q * 50, F.col("l_tax") * 10000 + 50, line * 300, q * 100, q * 90, F.col("l_extendedprice") / 20, line * 200 + 10)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *[(F.round(c, 8) + F.lit(0.0)).alias(k) for k, c in made.items()])


@register("b21_guarded", "WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_quantity - 30) / nullif(l_quantity - 20, 0) AS v FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN v BETWEEN -1 AND 1 THEN round(v, 9) + 0.0 END AS ndvi FROM x")
def b21(spark: SparkSession, sf: str) -> DataFrame:
    v = S.ratio(F.col("l_quantity") - 30, F.col("l_quantity") - 20)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r9(S.guarded(v, -1.0, 1.0)).alias("ndvi"))


@register("b23_clear_surface", "SELECT l_linestatus, count(*) FILTER (WHERE (l_partkey % 12) NOT IN (0, 1, 3, 6, 8, 9, 10, 11) AND nullif(l_discount, 0.0) IS NOT NULL) AS n_clear, count(*) FILTER (WHERE (l_partkey % 256)::INTEGER & 30 = 0) AS n_fmask FROM lineitem GROUP BY 1")
def b23(spark: SparkSession, sf: str) -> DataFrame:
    """Both masks."""
    clear = S.clear_surface(F.col("l_partkey") % 12, F.nullif("l_discount", F.lit(0.0)))
    return table(spark, sf, "lineitem").groupBy("l_linestatus").agg(F.count_if(clear).alias("n_clear"), F.count_if(S.fmask_clear(F.col("l_partkey") % 256)).alias("n_fmask"))


@register("b31_windows", f"""SELECT w AS window, count(*) AS n FROM (SELECT {D.SEASON_CASE.replace('l_shipdate', 'o_orderdate')} AS w FROM orders WHERE year(o_orderdate) + CASE WHEN month(o_orderdate) = 12 THEN 1 ELSE 0 END = 1996
  UNION ALL SELECT ['jan', 'feb', 'mar', 'apr', 'may'][month(o_orderdate)] FROM orders WHERE year(o_orderdate) = 1996 AND month(o_orderdate) <= 5) GROUP BY 1""")
def b31(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.explode(S.in_window(F.col("o_orderdate"), 1996)).alias("window")).groupBy("window").agg(F.count("*").alias("n"))


@register("b33_utm_epsg", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 32643 WHEN s_acctbal >= 0 THEN 32600 + s_suppkey % 60 ELSE 32700 + s_suppkey % 60 END::INTEGER AS epsg FROM supplier")
def b33(spark: SparkSession, sf: str) -> DataFrame:
    k, zone = F.col("s_suppkey"), F.lpad((F.col("s_suppkey") % 60).cast("string"), 2, "0")
    tile, item = F.when(k % 3 == 1, F.concat(zone, F.lit("QGD"))), F.concat(F.lit("S2A_T"), zone, F.lit("QGD_2024"))
    return table(spark, sf, "supplier").select("s_suppkey", S.utm_epsg(F.when(k % 3 == 0, F.lit(32643)), tile, item, F.col("s_acctbal")).alias("epsg"))


@register("b34_stretch", """WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.02) AS a, quantile_cont(l_extendedprice, 0.98) AS b FROM lineitem GROUP BY 1)
SELECT l_returnflag, v, count(*) AS n FROM (SELECT l_returnflag, floor(greatest(0.0, least(1.0, (l_extendedprice - a) / nullif(b - a, 0))) * 255)::INTEGER AS v FROM lineitem JOIN q USING (l_returnflag)) GROUP BY 1, 2""")
def b34(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    q = x.groupBy("l_returnflag").agg(F.percentile("l_extendedprice", F.lit(0.02)).alias("a"), F.percentile("l_extendedprice", F.lit(0.98)).alias("b"))
    return x.join(F.broadcast(q), "l_returnflag").groupBy("l_returnflag", S.stretched(F.col("l_extendedprice"), F.col("a"), F.col("b")).alias("v")).agg(F.count("*").alias("n"))


@register("b35_softmax", """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount * 10 AS a, l_tax * 10 AS b, l_quantity / 100 AS c FROM lineitem), y AS (SELECT *, greatest(a, b, c) AS m FROM x)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN a = m THEN 'fresh' WHEN b = m THEN 'mature' ELSE 'old' END AS label, round(1.0 / (exp(a - m) + exp(b - m) + exp(c - m)), 9) AS confidence FROM y""")
def b35(spark: SparkSession, sf: str) -> DataFrame:
    s = S.softmax_argmax({"fresh": F.col("l_discount") * 10, "mature": F.col("l_tax") * 10, "old": F.col("l_quantity") / 100})
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", s["label"].alias("label"), r9(s["confidence"]).alias("confidence"))


@register("b36_leaf_states", f"""WITH {D.OBS_SQL} SELECT chain_id, om_id, round(0.6 * coalesce(veg_fraction_hsv, 0) + 0.4 * coalesce(gcc_mean, 0) - (CASE WHEN is_bad_observation THEN 0.25 ELSE 0 END), 9) + 0.0 AS fresh,
  round(-0.5 * coalesce(gcc_mean, 0) + 0.001 * coalesce(laplacian_var, 0) - (CASE WHEN is_bad_observation THEN 0.25 ELSE 0 END), 9) + 0.0 AS old FROM obs""")
def b36(spark: SparkSession, sf: str) -> DataFrame:
    weights = {"fresh": {"veg": 0.6, "gcc": 0.4}, "old": {"gcc": -0.5, "lap": 0.001}}
    made = S.linear_scores({"veg": F.col("veg_fraction_hsv"), "gcc": F.col("gcc_mean"), "lap": F.col("laplacian_var")}, weights, F.when(F.col("is_bad_observation"), 0.25).otherwise(0.0))
    return D.obs(spark, sf).select("chain_id", "om_id", *[r9(c).alias(k) for k, c in made.items()])


@register("b39_non_trees", f"""WITH {D.OBS_SQL}, t AS (SELECT chain_id, max(gcc_mean) - min(gcc_mean) AS ga, max(veg_fraction_hsv) - min(veg_fraction_hsv) AS va, avg(gcc_mean) AS gm, avg(veg_fraction_hsv) AS vm FROM obs GROUP BY 1)
SELECT chain_id, ga <= 0.05 AS one, coalesce(ga <= 0.05, FALSE) AND coalesce(va <= 0.2, FALSE) AS two, coalesce(ga <= 0.05, FALSE) AND coalesce(va <= 0.2, FALSE) AND coalesce(gm <= 0.12, FALSE) AND coalesce(vm <= 0.15, FALSE) AS four FROM t""")
def b39(spark: SparkSession, sf: str) -> DataFrame:
    t = D.obs(spark, sf).groupBy("chain_id").agg((F.max("gcc_mean") - F.min("gcc_mean")).alias("ga"), (F.max("veg_fraction_hsv") - F.min("veg_fraction_hsv")).alias("va"), F.avg("gcc_mean").alias("gm"), F.avg("veg_fraction_hsv").alias("vm"))
    limits = {"gcc_amp": 0.05, "veg_amp": 0.2, "gcc_mean": 0.12, "veg_mean": 0.15}
    of = lambda *names: S.non_tree(F.col("ga"), F.col("va"), F.col("gm"), F.col("vm"), {k: limits[k] for k in names})
    return t.select("chain_id", of("gcc_amp").alias("one"), of("gcc_amp", "veg_amp").alias("two"), of(*limits).alias("four"))


@register("b40_literals", "SELECT event_id, value AS k, user_id::DOUBLE AS u FROM events")
def b40(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("{'k': "), F.col("value").cast("string"), F.lit(", 'none': None, 'u': "), F.col("user_id").cast("string"), F.lit("}"))
    return table(spark, sf, "events").select("event_id", S.literal_map(text)["k"].alias("k"), S.literal_map(text)["u"].alias("u"))


@register("b41_change_classes", "SELECT l_returnflag, CASE WHEN abs(l_quantity - 25) < 5 THEN 'stable' WHEN l_quantity - 25 >= 5 THEN 'increase' ELSE 'decrease' END AS kind, count(*) AS n FROM lineitem GROUP BY 1, 2")
def b41(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_returnflag", S.change_class(F.col("l_quantity") - 25, 5.0).alias("kind")).agg(F.count("*").alias("n"))


def bounds_of(ring: F.Column, places: int = 6) -> list[F.Column]:
    b = G.bounds(ring)
    return [(F.round(b[k], places) + F.lit(0.0)).alias(k) for k in ("minx", "miny", "maxx", "maxy")]


@register("c8_affine", f"WITH {D.BOXES_SQL} SELECT crown_idx, round(2 * minx + 5, 6) AS minx, round(3 * miny - 7, 6) AS miny, round(2 * maxx + 5, 6) AS maxx, round(3 * maxy - 7, 6) AS maxy FROM boxes")
def c8(spark: SparkSession, sf: str) -> DataFrame:
    """A map, its inverse and the map again, composed."""
    m = (2.0, 0.0, 5.0, 0.0, 3.0, -7.0)
    again = G.affine_compose(m, G.affine_compose(G.affine_inverse(*m), m))
    return D.rings(D.boxes(spark, sf)).select("crown_idx", *bounds_of(G.affine(F.col("ring"), *again)))


@register("c9_translate", f"WITH {D.BOXES_SQL} SELECT crown_idx, minx + om_id AS minx, miny - 2.5 AS miny, maxx + om_id AS maxx, maxy - 2.5 AS maxy FROM boxes")
def c9(spark: SparkSession, sf: str) -> DataFrame:
    return D.rings(D.boxes(spark, sf)).select("crown_idx", *bounds_of(G.translate(F.col("ring"), F.col("om_id"), -2.5)))


@register("c12_largest", f"WITH {D.BOXES_SQL} SELECT crown_idx, CASE WHEN crown_idx % 2 = 0 THEN minx * 2 ELSE minx END AS minx, CASE WHEN crown_idx % 2 = 0 THEN miny * 2 ELSE miny END AS miny, CASE WHEN crown_idx % 2 = 0 THEN maxx * 2 ELSE maxx END AS maxx, CASE WHEN crown_idx % 2 = 0 THEN maxy * 2 ELSE maxy END AS maxy FROM boxes")
def c12(spark: SparkSession, sf: str) -> DataFrame:
    k = F.when(F.col("crown_idx") % 2 == 0, 2.0).otherwise(0.5)
    parts = F.array(F.col("ring"), G.affine(F.col("ring"), k, 0, 0, 0, k, 0), F.slice("ring", 1, 2))
    return D.rings(D.boxes(spark, sf)).select("crown_idx", *bounds_of(G.largest(parts)))


@register("c14_contains", f"""WITH {D.BOXES_SQL}, p AS (SELECT *, minx + (crown_idx % 90) - 10.5 AS px, miny + (crown_idx % 70) - 10.25 AS py FROM boxes)
SELECT crown_idx, px > minx AND px < maxx AND py > miny AND py < maxy AS inside, power(px - minx, 2) + power(py - miny, 2) <= 900 AS in_disc FROM p""")
def c14(spark: SparkSession, sf: str) -> DataFrame:
    x, y = F.col("minx") + F.col("crown_idx") % 90 - 10.5, F.col("miny") + F.col("crown_idx") % 70 - 10.25
    return D.rings(D.boxes(spark, sf)).select("crown_idx", G.contains_point(F.col("ring"), x, y).alias("inside"), G.in_disc(x, y, F.col("minx"), F.col("miny"), 30.0).alias("in_disc"))


@register("c16_world_to_pixel", f"WITH {D.BOXES_SQL} SELECT crown_idx, round((minx - 100) / 0.5, 6) + 0.0 AS minx, round((2000 - maxy) / 0.25, 6) AS miny, round((maxx - 100) / 0.5, 6) + 0.0 AS maxx, round((2000 - miny) / 0.25, 6) AS maxy FROM boxes")
def c16(spark: SparkSession, sf: str) -> DataFrame:
    return D.rings(D.boxes(spark, sf)).select("crown_idx", *bounds_of(G.world_to_pixel(F.col("ring"), 100.0, 2000.0, 0.5, 0.25)))


@register("c17_expanded", f"WITH {D.BOXES_SQL}, m AS (SELECT *, 0.25 * greatest(maxx - minx, maxy - miny) AS m FROM boxes) SELECT crown_idx, minx - m AS minx, miny - m AS miny, maxx + m AS maxx, maxy + m AS maxy FROM m")
def c17(spark: SparkSession, sf: str) -> DataFrame:
    e = G.expanded(G.bounds(F.col("ring")))
    return D.rings(D.boxes(spark, sf)).select("crown_idx", *[e[k].alias(k) for k in ("minx", "miny", "maxx", "maxy")])


@register("c18_geometry_keys", f"WITH {D.BOXES_SQL} SELECT om_id, count(DISTINCT (minx, miny, maxx, maxy)) AS n FROM boxes GROUP BY 1")
def c18(spark: SparkSession, sf: str) -> DataFrame:
    """Every ring also turned round, begun elsewhere and closed; each geometry stays once."""
    from canopyflow.operators.aggregates import distinct_by

    rows = D.rings(D.boxes(spark, sf)).select("om_id", "crown_idx", "ring")
    other = rows.withColumn("ring", F.concat(F.reverse(F.concat(F.slice("ring", 3, 2), F.slice("ring", 1, 2))), F.slice(F.col("ring"), 2, 1)))
    return distinct_by(rows.unionByName(other), F.struct("om_id", G.geometry_key(F.col("ring"))), [F.col("crown_idx")]).groupBy("om_id").agg(F.count("*").alias("n"))


@register("a1_discover", "SELECT row_number() OVER (ORDER BY d) AS om_id, stem FROM (SELECT DISTINCT ts::DATE AS d, 'lhc_' || strftime(ts, '%d-%m-%y') AS stem FROM events)")
def a1(spark: SparkSession, sf: str) -> DataFrame:
    stems = table(spark, sf, "events").select(F.concat(F.lit("lhc_"), F.date_format("ts", "dd-MM-yy")).alias("stem")).distinct()
    return X.discover(stems.union(spark.createDataFrame([("left_out",)], "stem string")), ["left_out"]).select(F.col("om_id").cast("long").alias("om_id"), "stem")


@register("a2_pair_files", "SELECT p_partkey AS n, 'om' || p_partkey || '_crowns' AS crowns, CASE WHEN p_partkey % 2 = 0 THEN 'ortho_' || p_partkey END AS ortho FROM part")
def a2(spark: SparkSession, sf: str) -> DataFrame:
    p, key = table(spark, sf, "part"), F.col("p_partkey").cast("string")
    return X.pair_files(p.select(F.concat(F.lit("om"), key, F.lit("_crowns")).alias("stem")), p.where("p_partkey % 2 = 0").select(F.concat(F.lit("ortho_"), key).alias("stem")))


@register("a4_layers", "SELECT DISTINCT round(l_discount, 2) AS threshold FROM lineitem WHERE round(l_discount, 2) IN (0.02, 0.05, 0.10, 0.45)")
def a4(spark: SparkSession, sf: str) -> DataFrame:
    return X.threshold_layers(table(spark, sf, "lineitem").select(N.threshold_tag(F.col("l_discount")).alias("tag")), [0.02, 0.05, 0.10, 0.45])


@register("a28_validate_store", "SELECT array_to_string(list_sort(list_filter([0.02, 0.05, 0.45, 0.65], lambda t: NOT list_contains(have, t))), ' ') AS missing, FALSE AS ok FROM (SELECT list(DISTINCT round(l_discount, 2)) AS have FROM lineitem)")
def a28(spark: SparkSession, sf: str) -> DataFrame:
    made = X.validate_store(table(spark, sf, "lineitem").select(N.threshold_tag(F.col("l_discount")).alias("tag")), [0.02, 0.05, 0.45, 0.65])
    return made.select(F.array_join(F.transform("missing", lambda t: t.cast("string")), " ").alias("missing"), "ok")


LAYERS_SQL = f"{D.BOXES_SQL}, layers AS (SELECT b.*, t.threshold FROM boxes b CROSS JOIN (SELECT unnest([0.25, 0.45, 0.65])::DOUBLE AS threshold) t WHERE (b.crown_idx + (t.threshold * 100)::INTEGER) % 3 <> 0)"


def layers(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes in up to three threshold layers."""
    each = D.rings(D.boxes(spark, sf)).withColumn("threshold", F.explode(F.array(F.lit(0.25), F.lit(0.45), F.lit(0.65))))
    return each.where((F.col("crown_idx") + F.round(F.col("threshold") * 100).cast("int")) % 3 != 0)


@register("a6_multithreshold", f"WITH {LAYERS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY om_id, minx, miny, maxx, maxy ORDER BY threshold DESC, crown_idx) AS r FROM layers WHERE om_id > 1 OR threshold = 0.45) SELECT om_id, crown_idx, threshold FROM k WHERE r = 1")
def a6(spark: SparkSession, sf: str) -> DataFrame:
    return X.multithreshold(layers(spark, sf), 0.45).select("om_id", "crown_idx", "threshold")


@register("a7_threshold_cache", f"WITH {LAYERS_SQL} SELECT om_id, threshold, count(*) AS n FROM layers WHERE threshold < 0.65 AND threshold >= 0.3 GROUP BY 1, 2")
def a7(spark: SparkSession, sf: str) -> DataFrame:
    return X.threshold_cache(layers(spark, sf), 0.65, 0.3).groupBy("om_id", "threshold").agg(F.count("*").alias("n"))


@register("a8_single_threshold", f"WITH {LAYERS_SQL} SELECT om_id, count(*) AS n, min(crown_idx) AS first FROM layers WHERE threshold = 0.65 GROUP BY 1")
def a8(spark: SparkSession, sf: str) -> DataFrame:
    return X.single_threshold(layers(spark, sf), 0.65).groupBy("om_id").agg(F.count("*").alias("n"), F.min("crown_idx").alias("first"))


@register("a3_layer_pairs", f"WITH {LAYERS_SQL} SELECT om_id, 'om' || om_id || '_crowns' AS crowns, CASE WHEN om_id < 5 THEN 'ortho' || om_id END AS ortho, string_agg(DISTINCT 'conf_0p' || lpad((threshold * 100)::INTEGER::VARCHAR, 2, '0'), ' ' ORDER BY 'conf_0p' || lpad((threshold * 100)::INTEGER::VARCHAR, 2, '0')) AS layers FROM layers GROUP BY 1")
def a3(spark: SparkSession, sf: str) -> DataFrame:
    own = layers(spark, sf).select(F.concat(F.lit("om"), F.col("om_id").cast("string"), F.lit("_crowns")).alias("stem"), N.threshold_tag(F.col("threshold")).alias("tag")).distinct()
    orthos = spark.createDataFrame([(f"ortho{k}",) for k in range(1, 5)], "stem string")
    made = X.pair_layers(own, orthos, [0.25, 0.45, 0.65])
    return made.select(F.col("n").cast("int").alias("om_id"), "crowns", "ortho", F.array_join(F.transform("thresholds", lambda t: N.threshold_tag(t)), " ").alias("layers"))


@register("a9_downsample", f"WITH {D.PIXELS_SQL} SELECT chain_id, (row // 4)::INTEGER AS row, (col // 4)::INTEGER AS col, round(avg(r), 9) AS r, round(avg(g), 9) AS g FROM pixels GROUP BY 1, 2, 3")
def a9(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.downsample(D.pixels(spark, sf), ["chain_id"], 4, ["r", "g"]), "r", "g")


@register("a10_clip_pixels", f"""WITH {D.BOXES_SQL}, p AS (SELECT l_orderkey, l_linenumber, (l_partkey * 17 % 1000) + 0.5 AS x, (l_suppkey * 101 % 1009) + 0.25 AS y FROM lineitem)
SELECT crown_idx, count(*) AS n FROM p JOIN boxes ON x > minx AND x < maxx AND y > miny AND y < maxy GROUP BY 1""")
def a10(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels of one place are clipped once and counted as many as they are."""
    p = table(spark, sf, "lineitem").groupBy((F.col("l_partkey") * 17 % 1000 + 0.5).alias("px"), (F.col("l_suppkey") * 101 % 1009 + 0.25).alias("py")).agg(F.count("*").alias("n"))
    return X.clip_pixels(p, D.rings(D.boxes(spark, sf)).select("crown_idx", "ring"), F.col("px"), F.col("py")).groupBy("crown_idx").agg(F.sum("n").alias("n"))


@register("a17_drop_empty", "SELECT count(*) AS n FROM lineitem WHERE NOT (l_discount = 0 AND l_tax = 0)")
def a17(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem").select(F.nullif("l_discount", F.lit(0.0)).alias("d"), F.nullif("l_tax", F.lit(0.0)).alias("t"))
    return X.drop_empty(x, ["d", "t"]).agg(F.count("*").alias("n"))


@register("a18_features", f"WITH {D.BOXES_SQL} SELECT crown_idx, brand, round((maxx - minx) * (maxy - miny), 6) AS area FROM boxes")
def a18(spark: SparkSession, sf: str) -> DataFrame:
    """Written as GeoJSON collections, one for each flight and 10,000 keys, and read again."""
    path = f"{shared_dir(spark)}/features"
    lines = X.feature_json(D.rings(D.boxes(spark, sf)).withColumn("part", F.floor(F.col("crown_idx") / 10_000)), ["crown_idx", "brand", "om_id"], keep=["om_id", "part"])
    files = lines.groupBy("om_id", "part").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("feature"), ","), F.lit("]}")).alias("value"))
    X.write_documents(files, path, ["om_id", "part"])
    return X.read_features(spark, path, "crown_idx:long,brand:string").select("crown_idx", "brand", F.round(G.area(F.col("ring")), 6).alias("area"))


@register("a19_coco", f"WITH {D.BOXES_SQL} SELECT crown_idx AS gt_id, round((maxx - minx) * (maxy - miny), 6) AS area, TRUE AS pixel_space FROM boxes")
def a19(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_dir(spark)}/coco"
    one = F.to_json(F.struct(F.col("crown_idx").alias("id"), F.array(F.flatten(F.transform("ring", lambda p: F.array(p["x"], p["y"])))).alias("segmentation")))
    rows = D.rings(D.boxes(spark, sf)).select((F.col("crown_idx") % 3).alias("k"), F.floor(F.col("crown_idx") / 10_000).alias("part"), one.alias("a")).groupBy("k", "part").agg(F.concat(F.lit('{"annotations":['), F.array_join(F.collect_list("a"), ","), F.lit("]}")).alias("value"))
    X.write_documents(rows, path, ["k", "part"])
    return X.read_coco(spark, path).select("gt_id", F.round(G.area(F.col("ring")), 6).alias("area"), "pixel_space")


@register("a20_reports", f"WITH {D.BOXES_SQL} SELECT crown_idx, om_id, minx, brand FROM boxes")
def a20(spark: SparkSession, sf: str) -> DataFrame:
    """Through CSV and JSON."""
    path, rows = shared_dir(spark), D.boxes(spark, sf).select("crown_idx", "om_id", "minx", "brand")
    X.write_report(rows, f"{path}/csv", "csv")
    back = spark.read.schema(rows.schema).option("header", "true").csv(f"{path}/csv")
    X.write_report(back, f"{path}/json", "json")
    return spark.read.schema(rows.schema).json(f"{path}/json")


@register("a23_documents", f"""WITH {D.OBS_SQL} SELECT chain_id, count(*) AS n_observations, sum(om_id)::BIGINT AS om_sum, (chain_id % 2 = 0) AS deciduous FROM obs GROUP BY 1""")
def a23(spark: SparkSession, sf: str) -> DataFrame:
    o = D.obs(spark, sf)
    series = o.groupBy("chain_id").agg(F.array_sort(F.collect_list(F.struct("om_id", "n"))).alias("observations"))
    crowns = o.select("chain_id").distinct()
    documents = X.master_documents(crowns, series, crowns.withColumn("deciduous", F.col("chain_id") % 2 == 0))
    parsed = F.from_json("document", "ids struct<chain_id:long>,classification struct<deciduous:boolean>,observations array<struct<om_id:int,n:long>>")
    d = documents.select(parsed.alias("d"))
    return d.select(F.col("d.ids.chain_id").alias("chain_id"), F.size("d.observations").cast("long").alias("n_observations"), F.aggregate("d.observations", F.lit(0).cast("long"), lambda a, x: a + x["om_id"]).alias("om_sum"), F.col("d.classification.deciduous").alias("deciduous"))


@register("a5_crowns", f"WITH {D.BOXES_SQL} SELECT crown_idx, CASE WHEN crown_idx % 2 = 0 THEN 0.5 ELSE 1.0 END AS confidence, 0.0 AS threshold, FALSE AS is_augmented FROM boxes")
def a5(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.rings(D.boxes(spark, sf)).select("om_id", "crown_idx", F.lit(None).cast("double").alias("threshold"), F.when(F.col("crown_idx") % 2 == 0, 0.5).alias("confidence"), F.lit("o").alias("orthomosaic"), F.lit(None).cast("boolean").alias("is_augmented"), "ring")
    path = f"{shared_dir(spark)}/crowns"
    materialise(rows, path)
    return X.read_crowns(spark, path).select("crown_idx", "confidence", "threshold", "is_augmented")


@register("c15_utm_round_trip", "SELECT c_custkey, round(72.5 + c_custkey % 500 / 100.0, 8) AS lon, round(5 + c_custkey % 700 / 10.0, 8) AS lat FROM customer")
def c15(spark: SparkSession, sf: str) -> DataFrame:
    """Degrees to metres and back."""
    lon, lat = F.col("c_custkey") % 500 / 100.0 + 72.5, F.col("c_custkey") % 700 / 10.0 + 5
    there = table(spark, sf, "customer").select("c_custkey", G.utm(lon, lat, 43).alias("p"))
    back = G.utm_inverse(F.col("p.x"), F.col("p.y"), 43)
    fields = [f.name for f in there.select(back.alias("b")).schema["b"].dataType.fields]
    return there.select("c_custkey", F.round(back[fields[0]], 8).alias("lon"), F.round(back[fields[1]], 8).alias("lat"))
