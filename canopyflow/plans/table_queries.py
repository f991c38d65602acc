"""Aggregate, zonal, pixel, scene and reshape queries (A, G, R, U) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyflow.functions import spectral as S
from canopyflow.operators import aggregates as A
from canopyflow.plans import standins as D
from canopyflow.plans.catalog import register
from canopyflow.plans.series_queries import q9, r9, rounded
from canopyflow.session import table
from canopyflow.sources import tables as X


@register(
    "g11_weekly",
    "SELECT event_type, weekofyear(ts)::INTEGER AS iso_week, round(median(value), 9) AS median, round(quantile_cont(value, 0.25), 9) AS p25, round(quantile_cont(value, 0.75), 9) AS p75, count(value) AS n_obs, count(DISTINCT year(ts)) AS n_years FROM events GROUP BY 1, 2 HAVING count(value) >= 3",
)
def g11(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.weekly(table(spark, sf, "events"), ["event_type"], "value", "ts", 3), "median", "p25", "p75")


@register("g12_coverage", "SELECT user_id, count(DISTINCT ts::DATE) AS n_dates, count(*) FILTER (WHERE event_type <> 'error') AS n_valid, round(median(value), 9) AS median_fraction FROM events GROUP BY 1")
def g12(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.coverage(table(spark, sf, "events"), ["user_id"], "ts", F.col("event_type") != "error", "value"), "median_fraction")


@register(
    "g13_cloud_sweep",
    f"""WITH {D.SCENES_SQL}, t AS (SELECT unnest([10.0, 30.0, 50.0, 70.0])::DOUBLE AS threshold)
SELECT threshold, count(*) AS n_items, count(DISTINCT datetime::DATE) AS n_dates, count(DISTINCT (isoyear(datetime), weekofyear(datetime))) AS n_weeks, count(DISTINCT year(datetime)) AS n_years FROM scenes JOIN t ON cloud_cover <= threshold GROUP BY 1""",
)
def g13(spark: SparkSession, sf: str) -> DataFrame:
    return A.cloud_sweep(D.scenes(spark, sf), [10.0, 30.0, 50.0, 70.0])


@register("a11_best_scenes", f"WITH {D.SCENES_SQL} SELECT season, id, round(cloud_cover, 9) AS cloud_cover FROM (SELECT *, row_number() OVER (PARTITION BY season ORDER BY cloud_cover, datetime, id) AS r FROM scenes WHERE cloud_cover < 70) WHERE r <= 12")
def a11(spark: SparkSession, sf: str) -> DataFrame:
    return X.best_scenes(D.scenes(spark, sf)).select("season", "id", r9("cloud_cover").alias("cloud_cover"))


@register("a13_one_per_date", f"WITH {D.SCENES_SQL} SELECT id, round(cloud_cover, 9) AS cloud_cover FROM (SELECT *, row_number() OVER (PARTITION BY datetime::DATE ORDER BY cloud_cover, id) AS r FROM scenes) WHERE r = 1")
def a13(spark: SparkSession, sf: str) -> DataFrame:
    return X.one_per_date(D.scenes(spark, sf)).select("id", r9("cloud_cover").alias("cloud_cover"))


@register(
    "a12_dominant_orbit",
    f"WITH {D.SCENES_SQL}, top AS (SELECT relative_orbit FROM scenes GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT platform, count(*) AS n FROM scenes WHERE relative_orbit IN (SELECT relative_orbit FROM top) GROUP BY 1",
)
def a12(spark: SparkSession, sf: str) -> DataFrame:
    return X.dominant_orbit(D.scenes(spark, sf)).groupBy("platform").agg(F.count("*").alias("n"))


@register("g7_composite", f"SELECT l_suppkey, {D.SEASON_CASE} AS season, count(*) AS n FROM lineitem GROUP BY 1, 2")
def g7n(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_suppkey", S.season(F.month("l_shipdate")).alias("season"), F.monotonically_increasing_id().alias("scene"), "l_quantity")
    return A.composite(rows, ["l_suppkey", "season"], "scene", "l_quantity").select("l_suppkey", "season", F.col("n_scenes").alias("n"))


@register(
    "g7_scene_median",
    f"WITH e AS (SELECT l_suppkey, {D.SEASON_CASE} AS season, l_shipdate::DATE AS scene, median(l_quantity) AS m FROM lineitem GROUP BY 1, 2, 3) SELECT l_suppkey, season, round(median(m), 9) AS l_quantity, count(m) AS n_scenes FROM e GROUP BY 1, 2",
)
def g7(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").withColumns({"season": S.season(F.month("l_shipdate")), "scene": F.to_date("l_shipdate")})
    return rounded(A.composite(rows, ["l_suppkey", "season"], "scene", "l_quantity"), "l_quantity")


@register(
    "g10_observation_features",
    """SELECT l_suppkey, count(l_quantity) AS n_obs, count(DISTINCT year(l_shipdate)) AS n_years, round(median(l_quantity), 9) AS l_quantity_median, round(avg(l_quantity), 9) AS l_quantity_mean, round(stddev_pop(l_quantity), 9) AS l_quantity_std,
  round(max(l_quantity) - min(l_quantity), 9) AS l_quantity_amp, round(median(CASE WHEN l_returnflag = 'A' THEN l_quantity END), 9) AS "l_quantity_A", round(median(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 9) AS "l_quantity_R" FROM lineitem GROUP BY 1""",
)
def g10(spark: SparkSession, sf: str) -> DataFrame:
    out = A.observation_features(table(spark, sf, "lineitem"), "l_suppkey", "l_quantity", "l_returnflag", ["A", "R"], "l_shipdate")
    return rounded(out, *[c for c in out.columns if c.startswith("l_quantity_")])


@register("g5_weighted_mean", "SELECT l_partkey, round(sum(l_quantity * l_tax) / nullif(sum(CASE WHEN l_tax IS NOT NULL THEN l_quantity END), 0), 9) AS l_tax, round(sum(l_quantity), 9) AS coverage FROM lineitem GROUP BY 1")
def g5(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.zonal_weighted_mean(table(spark, sf, "lineitem"), ["l_partkey"], ["l_tax"], "l_quantity"), "l_tax", "coverage")


@register("g4_zonal_median", "SELECT l_partkey, CASE WHEN count(l_tax) >= 20 THEN round(median(l_tax), 9) END AS l_tax, count(l_tax) AS valid_pixels FROM lineitem GROUP BY 1")
def g4(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.zonal_median(table(spark, sf, "lineitem"), ["l_partkey"], ["l_tax"], 20), "l_tax")


@register(
    "g6_zonal_mean",
    "SELECT l_suppkey, round(avg(CASE WHEN l_returnflag <> 'N' THEN l_discount END), 9) AS l_discount_mean, count(*) FILTER (WHERE l_returnflag <> 'N') AS valid_pixels, count(*) AS total_pixels, round(count(*) FILTER (WHERE l_returnflag <> 'N') / count(*)::DOUBLE, 9) AS valid_fraction FROM lineitem GROUP BY 1",
)
def g6(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.zonal_mean(table(spark, sf, "lineitem"), ["l_suppkey"], ["l_discount"], F.col("l_returnflag") != "N"), "l_discount_mean", "valid_fraction")


HSV_SQL = f"""{D.PIXELS_SQL}, c AS (
  SELECT *, r > 0 OR g > 0 OR b > 0 AS valid, r / 255.0::DOUBLE AS rr, g / 255.0::DOUBLE AS gg, b / 255.0::DOUBLE AS bb FROM pixels
), m AS (SELECT *, greatest(rr, gg, bb) AS hi, greatest(rr, gg, bb) - least(rr, gg, bb) AS d, 0.299 * rr + 0.587 * gg + 0.114 * bb AS gray FROM c
), hsv AS (SELECT *, CASE WHEN d = 0 THEN 0.0 WHEN hi = rr THEN (CASE WHEN (gg - bb) / d < 0 THEN (gg - bb) / d + 6.0 ELSE (gg - bb) / d END) WHEN hi = gg THEN (bb - rr) / d + 2.0 ELSE (rr - gg) / d + 4.0 END / 6.0 AS h,
  CASE WHEN hi = 0 THEN 0.0 ELSE d / hi END AS s FROM m)"""


@register(
    "g1_patch_features",
    f"""WITH {HSV_SQL}, lap AS (SELECT chain_id, om_id, var_pop(l) AS laplacian_var FROM (SELECT a.chain_id, a.om_id, 255.0 * (u.gray + n.gray + w.gray + e.gray - 4 * a.gray) AS l FROM hsv a
  JOIN hsv u ON u.chain_id = a.chain_id AND u.row = a.row - 1 AND u.col = a.col JOIN hsv n ON n.chain_id = a.chain_id AND n.row = a.row + 1 AND n.col = a.col
  JOIN hsv w ON w.chain_id = a.chain_id AND w.row = a.row AND w.col = a.col - 1 JOIN hsv e ON e.chain_id = a.chain_id AND e.row = a.row AND e.col = a.col + 1) GROUP BY 1, 2
), hist AS (SELECT chain_id, om_id, least(floor(gray * 64), 63) AS bin, count(*) AS k FROM hsv WHERE valid GROUP BY 1, 2, 3
), ent AS (SELECT chain_id, om_id, -sum(p * log2(p)) AS gray_entropy FROM (SELECT chain_id, om_id, k / sum(k) OVER (PARTITION BY chain_id, om_id)::DOUBLE AS p FROM hist) GROUP BY 1, 2
), f AS (SELECT chain_id, om_id, count(*) AS n_pixels, count(*) FILTER (WHERE valid) AS n_valid, count(*) FILTER (WHERE valid) / count(*)::DOUBLE AS valid_pixel_fraction,
  count(*) FILTER (WHERE valid AND hi < 0.2) / nullif(count(*) FILTER (WHERE valid)::DOUBLE, 0) AS shadow_fraction,
  count(*) FILTER (WHERE valid AND h BETWEEN 0.18 AND 0.48 AND s >= 0.15 AND hi >= 0.12) / nullif(count(*) FILTER (WHERE valid)::DOUBLE, 0) AS veg_fraction_hsv,
  avg(CASE WHEN valid THEN gg / (rr + gg + bb + 1e-8) END) AS gcc_mean, avg(CASE WHEN valid THEN rr / (rr + gg + bb + 1e-8) END) AS rcc_mean FROM hsv GROUP BY 1, 2)
SELECT f.chain_id, f.om_id, n_pixels, n_valid, {q9('valid_pixel_fraction', 'shadow_fraction', 'veg_fraction_hsv', 'gcc_mean', 'rcc_mean', 'gray_entropy')}, round(laplacian_var, 4) AS laplacian_var,
  coalesce(n_valid < 20 OR valid_pixel_fraction < 0.6 OR shadow_fraction > 0.55 OR laplacian_var < 25, TRUE) AS is_bad_observation
FROM f LEFT JOIN ent ON ent.chain_id = f.chain_id LEFT JOIN lap ON lap.chain_id = f.chain_id""",
)
def g1(spark: SparkSession, sf: str) -> DataFrame:
    out = A.patch_features(D.pixels(spark, sf))
    return rounded(out, "valid_pixel_fraction", "shadow_fraction", "veg_fraction_hsv", "gcc_mean", "rcc_mean", "gray_entropy").withColumn("laplacian_var", F.round("laplacian_var", 4))


@register(
    "r5_glcm",
    f"""WITH {D.PIXELS_SQL}, q AS (SELECT chain_id, row, col, CAST(least(floor(g / 256.0 * 8), 7) AS INTEGER) AS i FROM pixels), s AS (SELECT * FROM (VALUES (0, 1, 0), (1, 1, 1), (1, 0, 2), (1, -1, 3)) t(dr, dc, d)),
p AS (SELECT a.chain_id, s.d, a.i AS i, b.i AS j FROM q a CROSS JOIN s JOIN q b ON b.chain_id = a.chain_id AND b.row = a.row + s.dr AND b.col = a.col + s.dc),
n AS (SELECT chain_id, d, i, j, count(*) AS k FROM (SELECT chain_id, d, i, j FROM p UNION ALL SELECT chain_id, d, j, i FROM p) GROUP BY 1, 2, 3, 4),
w AS (SELECT *, k / sum(k) OVER (PARTITION BY chain_id, d)::DOUBLE AS pr FROM n),
e AS (SELECT chain_id, d, sum(pr * (i - j) * (i - j)) AS c, sum(pr / (1 + (i - j) * (i - j))) AS h, sqrt(sum(pr * pr)) AS e FROM w GROUP BY 1, 2)
SELECT chain_id, round(avg(c), 9) AS glcm_contrast, round(avg(h), 9) AS glcm_homogeneity, round(avg(e), 9) AS glcm_energy FROM e GROUP BY 1""",
)
def r5(spark: SparkSession, sf: str) -> DataFrame:
    px = D.pixels(spark, sf).withColumn("q", F.col("g") / 256.0)
    return rounded(A.glcm(px, ["chain_id"], "q", 8), "glcm_contrast", "glcm_homogeneity", "glcm_energy")


@register(
    "g29_grid_cells",
    f"""WITH {D.PIXELS_SQL}, x AS (SELECT *, min(row) OVER w AS r0, max(row) OVER w AS r1, min(col) OVER w AS c0, max(col) OVER w AS c1 FROM pixels WINDOW w AS (PARTITION BY chain_id))
SELECT chain_id, CAST(least(1, floor((row - r0) * 2 / (r1 - r0 + 1)::DOUBLE)) AS INTEGER) AS cell_row, CAST(least(1, floor((col - c0) * 2 / (c1 - c0 + 1)::DOUBLE)) AS INTEGER) AS cell_col, count(*) AS n, round(median(g), 9) AS g FROM x GROUP BY 1, 2, 3 HAVING count(*) >= 5""",
)
def g29(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.grid_cells(D.pixels(spark, sf), ["chain_id"], 2, ["g"]), "g")


@register(
    "b37_flower_vote",
    f"""WITH {D.PIXELS_SQL}, x AS (SELECT chain_id, row // 2 AS cr, col // 2 AS cc, r::DOUBLE AS r, g::DOUBLE AS g, b::DOUBLE AS b FROM pixels),
m AS (SELECT chain_id, cr, cc, median(r / nullif(r + g + b, 0)) AS rcc, median(g / nullif(r + g + b, 0)) AS gcc, median((r + g - 2 * b) / nullif(r + g + b, 0)) AS yi, median(1.4 * r - g - (2 * g - r - b)) AS x FROM x GROUP BY 1, 2, 3),
k AS (SELECT chain_id, CASE WHEN rcc IS NULL OR gcc IS NULL THEN 'unknown' WHEN rcc > 0.38 AND gcc < 0.32 AND x > 0 THEN 'red' WHEN yi > 0.10 AND gcc > 0.50 AND rcc > 0.28 THEN 'yellow' WHEN gcc > 0.38 AND rcc < 0.38 THEN 'green' ELSE 'mixed' END AS colour FROM m),
n AS (SELECT chain_id, colour, count(*) AS n FROM k GROUP BY 1, 2),
t AS (SELECT *, n / sum(n) OVER (PARTITION BY chain_id)::DOUBLE AS fraction, row_number() OVER (PARTITION BY chain_id ORDER BY n DESC, colour) AS rk FROM n)
SELECT chain_id, CASE WHEN fraction >= 0.6 THEN colour ELSE colour || ' [weak]' END AS winner, round(fraction, 9) AS fraction FROM t WHERE rk = 1""",
)
def b37(spark: SparkSession, sf: str) -> DataFrame:
    px = D.pixels(spark, sf)
    idx = S.flower_indices(*(F.col(c).cast("double") for c in "rgb"))
    cells = px.groupBy("chain_id", F.floor(F.col("row") / 2).alias("cr"), F.floor(F.col("col") / 2).alias("cc")).agg(*[F.median(idx[k]).alias(k) for k in ("rcc", "gcc", "yi", "exr_exg")])
    return rounded(A.vote(cells.withColumn("colour", S.flower_colour(*(F.col(k) for k in ("rcc", "gcc", "yi", "exr_exg")))), "chain_id", "colour"), "fraction")


@register(
    "b20_indices",
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity / 100 AS blue, l_discount AS green, l_tax AS red, l_extendedprice / 100000 AS nir FROM lineitem)
SELECT l_orderkey, l_linenumber, round((nir - red) / nullif(nir + red, 0), 9) + 0.0 AS ndvi, round((nir - green) / nullif(nir + green, 0), 9) + 0.0 AS gndvi, round((green - nir) / nullif(green + nir, 0), 9) + 0.0 AS ndwi FROM x""",
)
def b19(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem")
    idx = S.planet_indices(F.col("l_quantity") / 100, F.col("l_discount"), F.col("l_tax"), F.col("l_extendedprice") / 100000)
    return x.select("l_orderkey", "l_linenumber", *[r9(idx[k]).alias(k) for k in ("ndvi", "gndvi", "ndwi")])


@register("b22_sar", "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0 THEN round(10 * log10(l_tax), 9) + 0.0 END AS vv_db, CASE WHEN l_discount > 0 THEN round(10 * log10(l_discount), 9) + 0.0 END AS vh_db, round(l_discount / nullif(l_tax, 0), 9) AS vh_vv_ratio FROM lineitem")
def b22(spark: SparkSession, sf: str) -> DataFrame:
    f = S.sar_features(F.col("l_tax"), F.col("l_discount"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[r9(f[k]).alias(k) for k in ("vv_db", "vh_db", "vh_vv_ratio")])


@register("b32_calendar", "SELECT event_id, year(ts)::INTEGER AS year, isoyear(ts)::INTEGER AS iso_year, weekofyear(ts)::INTEGER AS iso_week, month(ts)::INTEGER AS month FROM events")
def b32(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", *[c.cast("int").alias(k) for k, c in S.calendar(F.col("ts")).items()])


@register("a18_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def a18(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@register("g15_value_counts", "SELECT * FROM (SELECT 'quality' AS \"column\", CAST(quality AS VARCHAR) AS value, count(*) AS n FROM labels GROUP BY 2 UNION ALL SELECT 'toxic', CAST(toxic AS VARCHAR), count(*) FROM labels GROUP BY 2)")
def g15(spark: SparkSession, sf: str) -> DataFrame:
    return A.value_counts(table(spark, sf, "labels"), ["quality", "toxic"])


@register("g17_crosstab", "SELECT source, count(*) FILTER (WHERE lang = 'de') AS n_de, count(*) FILTER (WHERE lang = 'en') AS n_en, count(*) FILTER (WHERE lang = 'es') AS n_es, count(*) FILTER (WHERE lang = 'fr') AS n_fr FROM documents GROUP BY 1")
def g17(spark: SparkSession, sf: str) -> DataFrame:
    return A.crosstab(table(spark, sf, "documents"), "source", "lang", ["de", "en", "es", "fr"], "n_")


@register("g18_class_season", f"SELECT l_returnflag, {D.SEASON_CASE} AS season, round(avg(l_quantity), 9) AS mean, round(quantile_cont(l_quantity, 0.25), 9) AS p25, round(quantile_cont(l_quantity, 0.75), 9) AS p75, count(l_quantity) AS n FROM lineitem GROUP BY 1, 2")
def g18(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").withColumn("season", S.season(F.month("l_shipdate")))
    return rounded(A.quantile_summary(rows, ["l_returnflag", "season"], "l_quantity"), "mean", "p25", "p75")


@register("g35_area_class", f"WITH e AS (SELECT l_returnflag, l_linestatus, {D.SEASON_CASE} AS s, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1, 2, 3) SELECT l_returnflag, l_linestatus, round(avg(m), 4) AS mean, round(max(m) - min(m), 4) AS seasonal_range FROM e GROUP BY 1, 2")
def g35(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").withColumn("season", S.season(F.month("l_shipdate")))
    out = A.area_class_summary(rows, ["l_returnflag", "l_linestatus"], "season", "l_extendedprice")
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "seasonal_range")})


@register(
    "g24_cohen_d",
    "WITH x AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_quantity AS q, l_discount AS d FROM lineitem) SELECT 'q' AS feature, round((avg(q) FILTER (WHERE y = 1) - avg(q) FILTER (WHERE y = 0)) / sqrt((var_pop(q) FILTER (WHERE y = 1) + var_pop(q) FILTER (WHERE y = 0)) / 2), 9) AS d FROM x UNION ALL SELECT 'd', round((avg(d) FILTER (WHERE y = 1) - avg(d) FILTER (WHERE y = 0)) / sqrt((var_pop(d) FILTER (WHERE y = 1) + var_pop(d) FILTER (WHERE y = 0)) / 2), 9) FROM x",
)
def g24(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"))
    return rounded(A.cohen_d(x, "y", ["q", "d"]), "d")


@register(
    "g25_quartile_error",
    "WITH c AS (SELECT quantile_cont(p_retailprice, 0.25) AS a, quantile_cont(p_retailprice, 0.5) AS b, quantile_cont(p_retailprice, 0.75) AS c FROM part) SELECT CASE WHEN p_retailprice <= a THEN 1 WHEN p_retailprice <= b THEN 2 WHEN p_retailprice <= c THEN 3 ELSE 4 END::INTEGER AS quartile, count(*) AS n, round(avg((p_size > 25)::INTEGER), 9) AS accuracy FROM part CROSS JOIN c GROUP BY 1",
)
def g25(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.quartile_error(table(spark, sf, "part").withColumn("ok", F.col("p_size") > 25), "p_retailprice", "ok"), "accuracy")


@register("g32_dominant", "SELECT o_custkey, o_orderpriority, n FROM (SELECT o_custkey, o_orderpriority, count(*) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS r FROM orders GROUP BY 1, 2) WHERE r = 1")
def g32(spark: SparkSession, sf: str) -> DataFrame:
    return A.dominant(table(spark, sf, "orders"), ["o_custkey"], "o_orderpriority")


@register("g37_missingness", "SELECT 'value' AS \"column\", round(avg((value IS NULL)::INTEGER), 9) AS null_fraction, round(median(value), 9) AS median FROM events UNION ALL SELECT 'user_id', round(avg((user_id IS NULL)::INTEGER), 9), round(median(user_id), 9) FROM events")
def g37(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.missingness(table(spark, sf, "events"), ["value", "user_id"]), "null_fraction", "median")


@register("g38_string_counts", "SELECT lang, string_agg(source || '=' || n, '; ' ORDER BY source || '=' || n) AS counts FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1")
def g38(spark: SparkSession, sf: str) -> DataFrame:
    return A.string_counts(table(spark, sf, "documents"), "lang", "source")


@register("u6_set_difference", "SELECT c_nationkey AS nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def u6(spark: SparkSession, sf: str) -> DataFrame:
    rich = table(spark, sf, "supplier").where("s_acctbal > 5000").select("s_nationkey")
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("nationkey")).subtract(rich)


@register(
    "u7_multiset",
    "WITH a AS (SELECT c_nationkey AS k, count(*) AS expected FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS actual FROM supplier GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, coalesce(expected, 0) AS expected, coalesce(actual, 0) AS actual FROM a FULL JOIN b ON a.k = b.k WHERE coalesce(expected, 0) <> coalesce(actual, 0)",
)
def u7(spark: SparkSession, sf: str) -> DataFrame:
    return A.multiset_difference(table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")), ["k"])


@register("u8_wide", f"WITH {D.OBS_SQL} SELECT chain_id, {', '.join(f'round(max(CASE WHEN om_id = {d} THEN gcc_mean END), 9) AS om_{d}' for d in D.DATES)} FROM obs GROUP BY 1")
def u8(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.long_to_wide(D.obs(spark, sf), "chain_id", "om_id", D.DATES, "gcc_mean", "om_"), *[f"om_{d}" for d in D.DATES])


@register(
    "q1_revenue",
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
)
def q1(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))
