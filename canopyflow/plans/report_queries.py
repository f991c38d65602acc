"""Reports, label logic, votes and reshapes (G, J, K, M, U) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyflow.operators import aggregates as A
from canopyflow.operators import evaluation as E
from canopyflow.operators import raster as R
from canopyflow.operators import reports as P
from canopyflow.operators import timeseries as T
from canopyflow.plans import standins as D
from canopyflow.plans.catalog import register
from canopyflow.plans.label_queries import BASE_SQL, base
from canopyflow.plans.series_queries import LEAF_SQL, q9, r9, rounded
from canopyflow.session import table


@register("g2_rich_patches", f"""WITH {D.PIXELS_SQL}, x AS (SELECT chain_id, r / 255.0::DOUBLE AS r, g / 255.0::DOUBLE AS g, b / 255.0::DOUBLE AS b FROM pixels WHERE r > 0 OR g > 0 OR b > 0)
SELECT chain_id, round(avg(2 * g / (r + g + b + 1e-8) - r / (r + g + b + 1e-8) - b / (r + g + b + 1e-8)), 8) + 0.0 AS exg_mean, round(stddev_pop(0.299 * r + 0.587 * g + 0.114 * b), 8) + 0.0 AS gray_std,
  round(avg(r) * 255, 6) + 0.0 AS r_mean, round(stddev_pop(g) * 255, 6) + 0.0 AS g_std, round(stddev_pop(b) / nullif(avg(b), 0), 8) + 0.0 AS b_cv FROM x GROUP BY 1""")
def g2(spark: SparkSession, sf: str) -> DataFrame:
    return A.patch_features(D.pixels(spark, sf), rich=True).where("n_valid > 0").select("chain_id", *[(F.round(c, 6 if c in ("r_mean", "g_std") else 8) + F.lit(0.0)).alias(c) for c in ("exg_mean", "gray_std", "r_mean", "g_std", "b_cv")])


@register("g8_amplitudes", f"WITH {D.OBS_SQL}, w AS (SELECT chain_id, {', '.join(f'max(CASE WHEN om_id = {d} THEN gcc_mean END) AS om_{d}' for d in D.DATES)} FROM obs GROUP BY 1) SELECT chain_id, round(greatest({', '.join(f'om_{d}' for d in D.DATES)}) - least({', '.join(f'om_{d}' for d in D.DATES)}), 9) + 0.0 AS amplitude FROM w")
def g8(spark: SparkSession, sf: str) -> DataFrame:
    wide = A.long_to_wide(D.obs(spark, sf), "chain_id", "om_id", D.DATES, "gcc_mean", "om_")
    return wide.select("chain_id", r9(A.wide_amplitude([f"om_{d}" for d in D.DATES])).alias("amplitude"))


@register("g9_orbit_features", """SELECT o_custkey, count(o_totalprice) AS n_obs, count(DISTINCT year(o_orderdate)) AS n_years, round(median(o_totalprice), 6) AS med, round(avg(o_totalprice), 6) AS mean, round(stddev_pop(o_totalprice), 6) + 0.0 AS std,
  round(max(o_totalprice) - min(o_totalprice), 6) AS amp, round(median(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 6) AS f, round(median(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 6) AS o FROM orders GROUP BY 1""")
def g9(spark: SparkSession, sf: str) -> DataFrame:
    made = A.observation_features(table(spark, sf, "orders"), "o_custkey", "o_totalprice", "o_orderstatus", ["F", "O"], "o_orderdate")
    names = {"med": "median", "mean": "mean", "std": "std", "amp": "amp", "f": "F", "o": "O"}
    return made.select("o_custkey", "n_obs", "n_years", *[(F.round(f"o_totalprice_{c}", 6) + F.lit(0.0)).alias(k) for k, c in names.items()])


@register("g14_species_counts", "SELECT source, coalesce(CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lang END, '(missing)') AS lang, count(*) AS n FROM documents GROUP BY 1, 2")
def g14(spark: SparkSession, sf: str) -> DataFrame:
    return A.named_counts(table(spark, sf, "documents").withColumn("lang", F.when(F.col("doc_id") % 7 != 0, F.col("lang"))), ["source"], "lang")


@register("g16_label_packages", f"WITH {BASE_SQL} SELECT source, count(*) AS n, count(*) FILTER (WHERE toxic <> -1) AS n_labelled, count(*) FILTER (WHERE toxic = 1) AS n_positive, count(*) FILTER (WHERE toxic = 0) AS n_negative, count(DISTINCT CASE WHEN toxic <> -1 THEN lang END) AS n_sources FROM b GROUP BY 1")
def g16(spark: SparkSession, sf: str) -> DataFrame:
    return A.label_summary(base(spark, sf), "source", "toxic", "lang")


@register("g21_score_summary", f"WITH {LEAF_SQL} SELECT count(*) AS n_trees, count(*) FILTER (WHERE deciduous_score >= 0.6) AS n_positive, round(count(*) FILTER (WHERE deciduous_score >= 0.6) / count(*)::DOUBLE, 9) AS positive_fraction, round(avg(deciduous_score), 9) AS score_mean, round(median(deciduous_score), 9) AS score_median, round(min(deciduous_score), 9) AS score_min, round(max(deciduous_score), 9) AS score_max FROM ds")
def g21(spark: SparkSession, sf: str) -> DataFrame:
    scores, _ = T.leaf_shed(D.obs(spark, sf), D.DATES, {"threshold": 0.6})
    return rounded(P.score_summary(scores, "deciduous_score", F.col("is_deciduous")), "positive_fraction", "score_mean", "score_median", "score_min", "score_max")


@register("g21_flight_features", f"""WITH {D.OBS_SQL}, c AS (SELECT * FROM obs WHERE NOT is_bad_observation)
SELECT om_id, 'gcc_mean' AS feature, round(avg(gcc_mean), 9) AS mean, round(median(gcc_mean), 9) AS median, count(gcc_mean) AS n FROM c GROUP BY 1
UNION ALL SELECT om_id, 'veg_fraction_hsv', round(avg(veg_fraction_hsv), 9), round(median(veg_fraction_hsv), 9), count(veg_fraction_hsv) FROM c GROUP BY 1""")
def g21f(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.flight_features(D.obs(spark, sf), "om_id", ["gcc_mean", "veg_fraction_hsv"], "is_bad_observation"), "mean", "median")


@register("g22_flight_quality", f"WITH {D.OBS_SQL} SELECT om_id, count(*) AS n, round(avg((n > 2)::INTEGER), 9) AS patch_exists_rate, round(avg(is_bad_observation::INTEGER), 9) AS bad_rate, round(median(gcc_mean), 9) AS gcc_mean_median FROM obs GROUP BY 1")
def g22(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.flight_quality(D.obs(spark, sf), "om_id", F.col("n") > 2, "is_bad_observation", ["gcc_mean"]), "patch_exists_rate", "bad_rate", "gcc_mean_median")


RZ_SQL = f"""{D.OBS_SQL}, m AS (SELECT om_id, median(gcc_mean) AS med, median(laplacian_var) AS lmed FROM obs GROUP BY 1), d AS (SELECT o.om_id, median(abs(gcc_mean - med)) AS mad, median(abs(laplacian_var - lmed)) AS lmad FROM obs o JOIN m ON m.om_id = o.om_id GROUP BY 1),
z AS (SELECT o.chain_id, CASE WHEN mad > 0 THEN (gcc_mean - med) / (1.4826 * mad + 1e-8) END AS a, CASE WHEN lmad > 0 THEN (laplacian_var - lmed) / (1.4826 * lmad + 1e-8) END AS b FROM obs o JOIN m ON m.om_id = o.om_id JOIN d ON d.om_id = o.om_id),
s AS (SELECT chain_id, median(abs(v)) AS outlier_median, max(abs(v)) AS outlier_max FROM (SELECT chain_id, a AS v FROM z UNION ALL SELECT chain_id, b FROM z) GROUP BY 1)"""


def outliers(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.robust_z_by_group(D.obs(spark, sf), "gcc_mean", ["om_id"], "a")
    return P.outlier_scores(T.robust_z_by_group(rows, "laplacian_var", ["om_id"], "b"), "chain_id", ["a", "b"])


@register("g23_outlier_scores", f"WITH {RZ_SQL} SELECT chain_id, {q9('outlier_median', 'outlier_max')} FROM s")
def g23(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(outliers(spark, sf), "outlier_median", "outlier_max")


@register("k4_top_outliers", f"WITH {RZ_SQL} SELECT chain_id, {q9('outlier_max')} FROM s ORDER BY round(outlier_max, 9) DESC NULLS LAST, chain_id LIMIT 20")
def k4(spark: SparkSession, sf: str) -> DataFrame:
    return P.top_rows(rounded(outliers(spark, sf), "outlier_max"), "outlier_max", 20, ["chain_id"]).select("chain_id", "outlier_max")


@register("g26_run_summary", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 9) AS l_quantity_mean, round(stddev_samp(l_quantity), 9) AS l_quantity_std, round(avg(l_tax), 9) AS l_tax_mean, round(stddev_samp(l_tax), 9) AS l_tax_std FROM lineitem GROUP BY 1, 2")
def g26(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.run_summary(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_tax"]), "l_quantity_mean", "l_quantity_std", "l_tax_mean", "l_tax_std")


@register("g27_crown_votes", """WITH m AS (SELECT l_partkey, avg(l_discount * 10) AS acacia, avg(1 - l_discount * 10) AS other, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_partkey, round(other, 9) + 0.0 AS other, round(acacia, 9) AS acacia, n, CASE WHEN round(acacia, 9) >= 0.5 THEN 'acacia' ELSE 'other' END AS predicted FROM m""")
def g27(spark: SparkSession, sf: str) -> DataFrame:
    proba = table(spark, sf, "lineitem").select("l_partkey", (1 - F.col("l_discount") * 10).alias("other"), (F.col("l_discount") * 10).alias("acacia"))
    return rounded(A.crown_vote(proba, "l_partkey", ["other", "acacia"], 0.5 - 1e-10), "other", "acacia")


@register("g31_confidences", """WITH g AS (SELECT unnest([0.02, 0.04, 0.06, 0.08])::DOUBLE AS c), n AS (SELECT a.l_suppkey, c, count(l.l_suppkey) AS n FROM (SELECT DISTINCT l_suppkey FROM lineitem) a CROSS JOIN g LEFT JOIN lineitem l ON l.l_suppkey = a.l_suppkey AND l.l_discount >= c GROUP BY 1, 2),
t AS (SELECT floor(median(n)) AS t FROM n) SELECT l_suppkey, c AS confidence, n FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY abs(n - t), c DESC) AS r FROM n CROSS JOIN t) WHERE r = 1""")
def g31(spark: SparkSession, sf: str) -> DataFrame:
    return P.choose_confidence(table(spark, sf, "lineitem").select("l_suppkey", "l_discount"), "l_suppkey", "l_discount", [0.02, 0.04, 0.06, 0.08])


@register("g33_cluster_profiles", f"WITH {D.OBS_SQL} SELECT (chain_id % 4)::INTEGER AS cluster, om_id, round(median(gcc_mean), 9) AS median, round(quantile_cont(gcc_mean, 0.25), 9) AS p25, round(quantile_cont(gcc_mean, 0.75), 9) AS p75, count(gcc_mean) AS n FROM obs GROUP BY 1, 2")
def g33(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.cluster_profile(D.obs(spark, sf).withColumn("cluster", (F.col("chain_id") % 4).cast("int")), ["cluster", "om_id"], "gcc_mean"), "median", "p25", "p75")


@register("g36_signatures", f"WITH {D.SEASONAL_SQL} SELECT season, band, round(avg(value), 9) AS mean, round(quantile_cont(value, 0.25), 9) AS p25, round(quantile_cont(value, 0.75), 9) AS p75, count(value) AS n FROM seasonal GROUP BY 1, 2")
def g36(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.quantile_summary(D.seasonal(spark, sf), ["season", "band"], "value"), "mean", "p25", "p75")


@register("g39_best_by_family", """WITH b AS (SELECT l_returnflag AS holdout, max(l_discount) FILTER (WHERE l_linestatus = 'F') AS F, max(l_discount) FILTER (WHERE l_linestatus = 'O') AS O FROM lineitem WHERE l_quantity > 20 GROUP BY 1)
SELECT p.place, p.holdout, b.F, b.O FROM (VALUES (0, 'R'), (1, 'none'), (2, 'A')) p(place, holdout) LEFT JOIN b ON b.holdout = p.holdout""")
def g39(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").where("l_quantity > 20").withColumnRenamed("l_returnflag", "holdout")
    return P.best_by_family(rows, "holdout", ["R", "none", "A"], "l_linestatus", ["F", "O"], "l_discount")


@register("k2_review_candidates", "SELECT s_nationkey, s_suppkey, s_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier) WHERE r <= 3")
def k2(spark: SparkSession, sf: str) -> DataFrame:
    """K2, K6: the first three of each group."""
    return A.top_per_group(table(spark, sf, "supplier"), ["s_nationkey"], [F.desc("s_acctbal"), F.col("s_suppkey")], 3).select("s_nationkey", "s_suppkey", "s_acctbal")


@register("k7_best_variant", """WITH x AS (SELECT l_linenumber, l_returnflag, avg(l_quantity) AS q, avg(l_discount) AS d FROM lineitem GROUP BY 1, 2) SELECT l_linenumber, l_returnflag, round(0.5 * q + 10.0 * coalesce(d, 0), 9) AS composite FROM x ORDER BY round(0.5 * q + 10.0 * d, 12) DESC, l_linenumber, l_returnflag LIMIT 1""")
def k7(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "lineitem").groupBy("l_linenumber", "l_returnflag").agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"))
    return rounded(P.best_variant(runs, {"q": 0.5, "d": 10.0}, ["l_linenumber", "l_returnflag"]).select("l_linenumber", "l_returnflag", "composite"), "composite")


@register("j22_fusion", """WITH a AS (SELECT l_suppkey, count(*) AS n, max(l_tax) AS t FROM lineitem GROUP BY 1), b AS (SELECT l_suppkey, min(l_discount) AS d FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT s.s_suppkey AS uid, s.s_acctbal, a.n AS s2_n, a.t AS s2_t, b.d AS s1_d FROM supplier s JOIN a ON a.l_suppkey = s.s_suppkey JOIN b ON b.l_suppkey = s.s_suppkey""")
def j22(spark: SparkSession, sf: str) -> DataFrame:
    """Feature tables joined to a label table."""
    x = table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "uid")
    s2 = x.groupBy("uid").agg(F.count("*").alias("n"), F.max("l_tax").alias("t"))
    s1 = x.where("l_returnflag = 'R'").groupBy("uid").agg(F.min("l_discount").alias("d"))
    return E.fuse(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("uid"), "s_acctbal"), {"s2_": s2, "s1_": s1}, "uid")


@register("j26_relabelled", f"WITH {BASE_SQL} SELECT doc_id, quality::INTEGER AS rule FROM b")
def j26(spark: SparkSession, sf: str) -> DataFrame:
    rows, labels = base(spark, sf).select("doc_id", "rule"), table(spark, sf, "labels").select("doc_id", F.col("quality").alias("rule"))
    return E.relabel(rows, labels, "doc_id", ["rule"])[0].select("doc_id", "rule")


@register("j26_changed_cells", f"WITH {BASE_SQL} SELECT count(*) FILTER (WHERE rule <> quality) AS rule, count(*) FILTER (WHERE toxic <> coalesce((SELECT l.toxic FROM labels l WHERE l.doc_id = b.doc_id AND l.quality = 1), -1)) AS toxic FROM b")
def j26c(spark: SparkSession, sf: str) -> DataFrame:
    rows = base(spark, sf).select("doc_id", "rule", "toxic")
    labels = table(spark, sf, "labels")
    own = labels.select("doc_id", F.col("quality").alias("rule"), F.when(F.col("quality") == 1, F.col("toxic")).alias("toxic"))
    return E.relabel(rows, own, "doc_id", ["rule", "toxic"])[1]


@register("j27_members", "SELECT lang, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)) AS n_in, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)) AS n_out FROM documents d GROUP BY 1")
def j27m(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels")
    side = lambda inside: E.members(docs, labels, ["doc_id"], inside).withColumn("inside", F.lit(inside))
    return side(True).union(side(False)).groupBy("lang").agg(F.count_if("inside").alias("n_in"), F.count_if(~F.col("inside")).alias("n_out"))


@register("j30_alignment_check", "SELECT o AS \"offset\", count(*) AS n_matched, count(*) FILTER (WHERE a.label % 2 = b.label % 2) AS n_agree FROM embeddings a CROSS JOIN (SELECT unnest([-1, 0, 1]) AS o) t JOIN embeddings b ON b.vec_id = a.vec_id + o GROUP BY 1")
def j30(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", (F.col("label") % 2).alias("label"))
    return E.alignment_check(e, e, "vec_id", "label", "label", [-1, 0, 1])


@register("m1_leave_area_out", f"WITH {BASE_SQL}, s AS (SELECT min(source) AS s FROM b) SELECT doc_id, source = s AS is_test FROM b CROSS JOIN s WHERE quality <> -1")
def m1l(spark: SparkSession, sf: str) -> DataFrame:
    rows = base(spark, sf)
    first = rows.agg(F.min("source")).first()[0]
    return E.leave_out(rows, "source", first, "quality").select("doc_id", "is_test")


@register("m4_kappa", f"""WITH {BASE_SQL}, x AS (SELECT source, quality AS t, CASE WHEN lang IN ('en', 'de') THEN 1 ELSE 0 END AS p FROM b WHERE quality <> -1),
k AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (WHERE t = p) / count(*)::DOUBLE AS a, (count(*) FILTER (WHERE t = 1)::DOUBLE * count(*) FILTER (WHERE p = 1) + count(*) FILTER (WHERE t = 0)::DOUBLE * count(*) FILTER (WHERE p = 0)) / (count(*)::DOUBLE * count(*)) AS e FROM x GROUP BY 1)
SELECT source, round((a - e) / nullif(1 - e, 0), 9) + 0.0 AS kappa FROM k""")
def m4k(spark: SparkSession, sf: str) -> DataFrame:
    x = base(spark, sf).where("quality <> -1").withColumn("p", F.col("lang").isin("en", "de").cast("int"))
    return rounded(E.metrics(x, "quality", "p", ["source"]).select("source", "kappa"), "kappa")


@register("u1_union", "SELECT 'c' AS kind, c_custkey AS id, c_nationkey AS nation, NULL::VARCHAR AS name FROM customer UNION ALL SELECT 's', s_suppkey, NULL, s_name FROM supplier")
def u1(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    s = table(spark, sf, "supplier").select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return A.union_all(c, s)


@register("u2_first_of_key", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def u2(spark: SparkSession, sf: str) -> DataFrame:
    return A.distinct_by(table(spark, sf, "orders"), F.struct("o_custkey", "o_orderstatus"), [F.desc("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@register("u9_unpivot", f"WITH {D.OBS_SQL} SELECT chain_id, om_id, 'gcc_mean' AS metric, round(gcc_mean, 9) AS value FROM obs WHERE gcc_mean IS NOT NULL UNION ALL SELECT chain_id, om_id, 'veg_fraction_hsv', round(veg_fraction_hsv, 9) FROM obs WHERE veg_fraction_hsv IS NOT NULL")
def u9(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.wide_to_long(D.obs(spark, sf), ["chain_id", "om_id"], ["gcc_mean", "veg_fraction_hsv"], "metric", "value").where("value is not null"), "value")


@register("u10_expand", "SELECT p_partkey, k AS copy, p_size FROM part CROSS JOIN (SELECT unnest([1, 2, 3])::INTEGER AS k) t")
def u10(spark: SparkSession, sf: str) -> DataFrame:
    return A.expand_rows(table(spark, sf, "part"), 3).select("p_partkey", "copy", "p_size")


@register("w24_change_maps", f"""WITH {D.PIXELS_SQL}, d AS (SELECT chain_id // 100000 AS site, (chain_id % 100000)::INTEGER AS day, row, col, g FROM pixels), z AS (SELECT *, (g - avg(g) OVER (PARTITION BY site, day)) / nullif(stddev_pop(g) OVER (PARTITION BY site, day), 0) AS z FROM d)
SELECT site, day, row, col, round(z, 8) + 0.0 AS z, round(z - lag(z) OVER (PARTITION BY site, row, col ORDER BY day), 8) + 0.0 AS difference, round(var_pop(z) OVER (PARTITION BY site, row, col), 8) + 0.0 AS variance FROM z""")
def w24(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.pixels(spark, sf).select(F.floor(F.col("chain_id") / 100000).alias("site"), (F.col("chain_id") % 100000).cast("int").alias("day"), "row", "col", "g")
    made = R.change_map(rows, ["site"], "day", "g")
    return made.select("site", "day", "row", "col", *[(F.round(c, 8) + F.lit(0.0)).alias(c) for c in ("z", "difference", "variance")])


BLUR = (0.0625, 0.25, 0.375, 0.25, 0.0625)


def blur_sql(source: str, fixed: str, axis: str, name: str, value: str, out: str) -> str:
    terms = [f"lag({value}, {2 - k}) OVER w" if k < 2 else (value if k == 2 else f"lead({value}, {k - 2}) OVER w") for k in range(5)]
    total = " + ".join(f"coalesce({t} * {s}, 0)" for t, s in zip(terms, BLUR))
    weight = " + ".join(f"CASE WHEN {t} IS NULL THEN 0 ELSE {s} END" for t, s in zip(terms, BLUR))
    return f"{name} AS (SELECT *, ({total}) / ({weight}) AS {out} FROM {source} WINDOW w AS (PARTITION BY chain_id, {fixed} ORDER BY {axis}))"


@register("r4_blur", f"WITH {D.PIXELS_SQL}, f AS (SELECT chain_id, row, col, g::DOUBLE AS g FROM pixels), {blur_sql('f', 'row', 'col', 'h', 'g', 'hv')}, {blur_sql('h', 'col', 'row', 'v', 'hv', 'vv')} SELECT chain_id, row, col, round(vv, 8) AS blurred FROM v")
def r4(spark: SparkSession, sf: str) -> DataFrame:
    made = R.blurred(D.pixels(spark, sf).select("chain_id", "row", "col", F.col("g").cast("double").alias("g")), ["chain_id"], "g")
    return made.select("chain_id", "row", "col", F.round("blurred", 8).alias("blurred"))


@register("r2_pixel_weights", f"""WITH {D.BOXES_SQL}, c AS (SELECT *, unnest(range(floor(minx / 16)::INTEGER, floor(maxx / 16)::INTEGER + 1)) AS col FROM boxes), d AS (SELECT *, unnest(range(floor(miny / 16)::INTEGER, floor(maxy / 16)::INTEGER + 1)) AS row FROM c),
w AS (SELECT crown_idx, row, col, greatest(0, least(maxx, col * 16 + 16) - greatest(minx, col * 16)) * greatest(0, least(maxy, row * 16 + 16) - greatest(miny, row * 16)) / ((maxx - minx) * (maxy - miny)) AS weight FROM d)
SELECT crown_idx, row::INTEGER AS row, col::INTEGER AS col, round(weight, 8) AS weight FROM w WHERE weight > 1e-9""")
def r2(spark: SparkSession, sf: str) -> DataFrame:
    made = R.fractional_weights(D.rings(D.boxes(spark, sf)).select("crown_idx", "ring"), "crown_idx", 16.0)
    return made.where("weight > 1e-9").select("crown_idx", "row", "col", F.round("weight", 8).alias("weight"))


@register("w22_reconstructed", """WITH d AS (SELECT unnest(range(1, 366)) AS doy) SELECT p_partkey, doy::INTEGER AS doy, round(p_size / 10.0 + p_size % 7 * sin(2 * pi() * doy / 365.0) + p_size % 5 * cos(2 * pi() * doy / 365.0) + p_size % 3 * sin(4 * pi() * doy / 365.0) + 1.5 * cos(4 * pi() * doy / 365.0), 7) + 0.0 AS value FROM part CROSS JOIN d""")
def w22(spark: SparkSession, sf: str) -> DataFrame:
    from canopyflow.operators.sequences import reconstructed

    s = F.col("p_size").cast("double")
    fits = table(spark, sf, "part").select("p_partkey", F.array(s / 10.0, F.lit(9.0), s % 7, s % 5, s % 3, F.lit(1.5)).alias("coefficients"))
    return reconstructed(fits, "p_partkey").select("p_partkey", "doy", (F.round("value", 7) + F.lit(0.0)).alias("value"))
