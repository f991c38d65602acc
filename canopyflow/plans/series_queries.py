"""Series, seasonal and ranking queries (W, K) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyflow.operators import aggregates as A
from canopyflow.operators import sequences as Q
from canopyflow.operators import timeseries as T
from canopyflow.plans import standins as D
from canopyflow.plans.catalog import register
from canopyflow.session import table

DATES_SQL = "(SELECT unnest([1, 2, 3, 4, 5, 6])::INTEGER AS om_id)"


def r9(c) -> F.Column:
    """Rounded to nine places, without negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 9) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r9(c) for c in columns})


def q9(*columns: str) -> str:
    return ", ".join(f"round({c}, 9) + 0.0 AS {c}" for c in columns)


FILLED_SQL = f"""{D.OBS_SQL}, grid AS (
  SELECT c.chain_id, d.om_id, CASE WHEN NOT coalesce(o.is_bad_observation, FALSE) THEN o.veg_fraction_hsv END AS v,
    CASE WHEN NOT coalesce(o.is_bad_observation, FALSE) THEN o.gcc_mean END AS g, CASE WHEN NOT coalesce(o.is_bad_observation, FALSE) THEN o.laplacian_var END AS t
  FROM (SELECT DISTINCT chain_id FROM obs) c CROSS JOIN {DATES_SQL} d LEFT JOIN obs o ON o.chain_id = c.chain_id AND o.om_id = d.om_id
), filled AS (
  SELECT chain_id, om_id, {', '.join(f'''coalesce({c},
    last_value({c} IGNORE NULLS) OVER p + (first_value({c} IGNORE NULLS) OVER f - last_value({c} IGNORE NULLS) OVER p) * (om_id - last_value(CASE WHEN {c} IS NOT NULL THEN om_id END IGNORE NULLS) OVER p)
      / nullif(first_value(CASE WHEN {c} IS NOT NULL THEN om_id END IGNORE NULLS) OVER f - last_value(CASE WHEN {c} IS NOT NULL THEN om_id END IGNORE NULLS) OVER p, 0),
    last_value({c} IGNORE NULLS) OVER p, first_value({c} IGNORE NULLS) OVER f, 0.0) AS {c}''' for c in 'vgt')}
  FROM grid WINDOW p AS (PARTITION BY chain_id ORDER BY om_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    f AS (PARTITION BY chain_id ORDER BY om_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
)"""


@register("w9_interpolate", f"WITH {FILLED_SQL} SELECT chain_id, om_id, round(v, 9) + 0.0 AS veg FROM filled")
def w9(spark: SparkSession, sf: str) -> DataFrame:
    filled = T.interpolated(T.dense_series(D.obs(spark, sf), D.DATES, values=["veg_fraction_hsv"]), "veg_fraction_hsv")
    return filled.select("chain_id", "om_id", r9("veg_fraction_hsv_hat").alias("veg"))


LEAF_SQL = f"""{FILLED_SQL}, trees AS (
  SELECT chain_id, max(v) - min(v) AS a_veg, max(g) - min(g) AS a_gcc, max(t) - min(t) AS a_tex, min(v) AS min_veg, arg_min(om_id, (v, om_id)) AS trough_om FROM filled GROUP BY 1
), norms AS (SELECT quantile_cont(a_veg, 0.9) AS nv, quantile_cont(a_gcc, 0.9) AS ng, quantile_cont(a_tex, 0.9) AS nt FROM trees
), scored AS (
  SELECT chain_id, a_veg, a_gcc, a_tex, min_veg, trough_om, CASE WHEN nv > 1e-12 THEN least(1.0, greatest(0.0, a_veg / nv)) END AS s_veg_amp,
    CASE WHEN min_veg < 0.3 THEN least(1.0, (0.3 - min_veg) / 0.3) ELSE 0.0 END AS s_depth,
    CASE WHEN ng > 1e-12 THEN least(1.0, greatest(0.0, a_gcc / ng)) END AS s_gcc_amp, CASE WHEN nt > 1e-12 THEN least(1.0, greatest(0.0, a_tex / nt)) END AS s_tex
  FROM trees CROSS JOIN norms
), ds AS (SELECT *, 0.35 * s_veg_amp + 0.30 * s_depth + 0.25 * s_gcc_amp + 0.10 * s_tex AS deciduous_score FROM scored
), phases AS (
  SELECT f.chain_id, f.om_id, f.v, lead(f.om_id) OVER (PARTITION BY f.chain_id ORDER BY f.om_id) AS next_om, d.trough_om, coalesce(d.deciduous_score >= 0.6, FALSE) AS dec,
    CASE WHEN max(v) OVER w - min(v) OVER w <= 1e-9 THEN 0.0 ELSE (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) END AS norm
  FROM filled f JOIN ds d ON d.chain_id = f.chain_id WINDOW w AS (PARTITION BY f.chain_id)
), states AS (SELECT *, CASE WHEN NOT dec THEN 'stable' WHEN norm >= 0.65 THEN 'leaf_on' WHEN norm <= 0.35 THEN 'leaf_off' ELSE 'transitioning' END AS phenophase FROM phases)"""


@register(
    "w13_leaf_shed",
    f"""WITH {LEAF_SQL}, events_ AS (
  SELECT chain_id, arg_max(next_om, CASE WHEN phenophase = 'leaf_on' AND om_id < trough_om THEN om_id END) AS leaf_off_start_om, any_value(trough_om) AS full_leaf_off_om,
    min(CASE WHEN phenophase = 'leaf_on' AND om_id >= trough_om THEN om_id END) AS leaf_on_return_om FROM states WHERE dec GROUP BY 1)
SELECT d.chain_id, {q9('a_veg', 'a_gcc', 'a_tex', 'min_veg', 's_veg_amp', 's_depth', 's_gcc_amp', 's_tex', 'deciduous_score')}, coalesce(deciduous_score >= 0.6, FALSE) AS is_deciduous,
  leaf_off_start_om::DOUBLE AS leaf_off_start_om, full_leaf_off_om::DOUBLE AS full_leaf_off_om, leaf_on_return_om::DOUBLE AS leaf_on_return_om FROM ds d LEFT JOIN events_ e ON e.chain_id = d.chain_id""",
)
def w13(spark: SparkSession, sf: str) -> DataFrame:
    scores, _ = T.leaf_shed(D.obs(spark, sf), D.DATES, {"threshold": 0.6})
    scores = scores.withColumns({c: F.col(c).cast("double") for c in ("leaf_off_start_om", "full_leaf_off_om", "leaf_on_return_om")})
    return rounded(scores, "a_veg", "a_gcc", "a_tex", "min_veg", "s_veg_amp", "s_depth", "s_gcc_amp", "s_tex", "deciduous_score")


@register("w14_phenophase", f"WITH {LEAF_SQL} SELECT chain_id, om_id, round(v, 9) + 0.0 AS veg, round(norm, 9) + 0.0 AS level, phenophase, trough_om FROM states")
def w14(spark: SparkSession, sf: str) -> DataFrame:
    _, phases = T.leaf_shed(D.obs(spark, sf), D.DATES, {"threshold": 0.6})
    return phases.select("chain_id", "om_id", r9("veg_fraction_hsv_hat").alias("veg"), r9("veg_fraction_hsv_norm").alias("level"), "phenophase", "trough_om")


@register(
    "w1_robust_z",
    f"""WITH {D.OBS_SQL}, m AS (SELECT om_id, median(gcc_mean) AS med FROM obs GROUP BY 1), d AS (SELECT o.om_id, median(abs(gcc_mean - med)) AS mad FROM obs o JOIN m ON m.om_id = o.om_id GROUP BY 1)
SELECT o.chain_id, o.om_id, CASE WHEN mad > 0 THEN round((gcc_mean - med) / (1.4826 * mad + 1e-8), 9) + 0.0 END AS rz FROM obs o JOIN m ON m.om_id = o.om_id JOIN d ON d.om_id = o.om_id""",
)
def w1(spark: SparkSession, sf: str) -> DataFrame:
    return T.robust_z_by_group(D.obs(spark, sf), "gcc_mean", ["om_id"]).select("chain_id", "om_id", r9("rz").alias("rz"))


@register(
    "w2_percent_rank",
    f"""WITH {D.OBS_SQL}, s AS (SELECT * FROM obs WHERE veg_fraction_hsv IS NOT NULL)
SELECT chain_id, om_id, round((rank() OVER (PARTITION BY om_id ORDER BY veg_fraction_hsv) + (count(*) OVER (PARTITION BY om_id, veg_fraction_hsv) - 1) / 2.0) / count(*) OVER (PARTITION BY om_id), 9) AS pct FROM s
UNION ALL SELECT chain_id, om_id, NULL FROM obs WHERE veg_fraction_hsv IS NULL""",
)
def w2(spark: SparkSession, sf: str) -> DataFrame:
    return T.average_percent_rank(D.obs(spark, sf), "veg_fraction_hsv", ["om_id"]).select("chain_id", "om_id", r9("pct").alias("pct"))


@register(
    "w3_robust_z_iqr",
    f"""WITH {D.OBS_SQL}, q AS (SELECT chain_id, median(gcc_mean) AS m, quantile_cont(gcc_mean, 0.75) - quantile_cont(gcc_mean, 0.25) AS iqr FROM obs GROUP BY 1)
SELECT o.chain_id, om_id, CASE WHEN iqr < 1e-12 THEN 0.0 ELSE round((gcc_mean - m) / (0.5 * iqr), 9) + 0.0 END AS rz FROM obs o JOIN q ON q.chain_id = o.chain_id""",
)
def w3(spark: SparkSession, sf: str) -> DataFrame:
    return T.robust_z_iqr(D.obs(spark, sf), "gcc_mean", "chain_id").select("chain_id", "om_id", r9("rz").alias("rz"))


@register(
    "w4_midrank",
    f"""WITH {D.OBS_SQL} SELECT chain_id, om_id, CASE WHEN count(*) OVER (PARTITION BY chain_id) >= 2 THEN round((rank() OVER (PARTITION BY chain_id ORDER BY gcc_mean) - 1
  + 0.5 * count(*) OVER (PARTITION BY chain_id, gcc_mean)) / count(*) OVER (PARTITION BY chain_id), 9) END AS pct FROM obs""",
)
def w4(spark: SparkSession, sf: str) -> DataFrame:
    return T.midrank(D.obs(spark, sf), "gcc_mean", "chain_id").select("chain_id", "om_id", r9("pct").alias("pct"))


@register(
    "w8_temporal_summary",
    f"""WITH {D.OBS_SQL}, c AS (SELECT chain_id, om_id, is_bad_observation, CASE WHEN NOT is_bad_observation THEN veg_fraction_hsv END AS v, CASE WHEN NOT is_bad_observation THEN gcc_mean END AS g FROM obs)
SELECT chain_id, count(*) FILTER (WHERE NOT is_bad_observation) AS n_obs_clean, min(om_id) AS om_start, max(om_id) AS om_end,
  CASE WHEN count(v) >= 2 THEN round(max(v) - min(v), 9) END AS veg_amplitude, CASE WHEN count(v) >= 2 THEN round(regr_slope(v, om_id), 9) + 0.0 END AS veg_slope,
  CASE WHEN count(g) >= 2 THEN round(max(g) - min(g), 9) END AS gcc_amplitude, CASE WHEN count(g) >= 2 THEN round(regr_slope(g, om_id), 9) + 0.0 END AS gcc_slope FROM c GROUP BY 1""",
)
def w8(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.obs(spark, sf).withColumnsRenamed({"veg_fraction_hsv": "veg", "gcc_mean": "gcc"})
    return rounded(T.temporal_summary(rows, ["veg", "gcc"]), "veg_amplitude", "veg_slope", "gcc_amplitude", "gcc_slope")


@register(
    "w12_direction_changes",
    f"""WITH {FILLED_SQL}, d AS (SELECT chain_id, om_id, v - lag(v) OVER (PARTITION BY chain_id ORDER BY om_id) AS d FROM filled),
s AS (SELECT chain_id, sign(d) <> lag(sign(d)) OVER (PARTITION BY chain_id ORDER BY om_id) AS flip FROM d WHERE abs(d) > 0.05)
SELECT c.chain_id, coalesce(sum(CASE WHEN flip THEN 1 ELSE 0 END), 0)::BIGINT AS dir_changes FROM (SELECT DISTINCT chain_id FROM filled) c LEFT JOIN s ON s.chain_id = c.chain_id GROUP BY 1""",
)
def w12(spark: SparkSession, sf: str) -> DataFrame:
    filled = T.interpolated(T.dense_series(D.obs(spark, sf), D.DATES, values=["veg_fraction_hsv"]), "veg_fraction_hsv", out="v")
    return T.direction_changes(filled, "v")


@register(
    "w16_phenometrics",
    f"""WITH {FILLED_SQL}, l AS (SELECT chain_id, om_id, 'v' AS metric, v AS x FROM filled UNION ALL SELECT chain_id, om_id, 'g', g FROM filled)
SELECT chain_id, metric, round(max(x) - min(x), 9) AS amplitude, arg_min(om_id, (-x, om_id)) AS peak_om, arg_min(om_id, (x, om_id)) AS trough_om, round(regr_slope(x, om_id), 9) + 0.0 AS slope FROM l GROUP BY 1, 2""",
)
def w16(spark: SparkSession, sf: str) -> DataFrame:
    dense = T.dense_series(D.obs(spark, sf), D.DATES, values=["veg_fraction_hsv", "gcc_mean"]).withColumnsRenamed({"veg_fraction_hsv": "v", "gcc_mean": "g"})
    return rounded(T.phenometrics(dense, ["v", "g"]).drop("dir_changes"), "amplitude", "slope")


@register(
    "w18_temporal_features",
    f"""WITH {D.SEASONAL_SQL}, y AS (SELECT crown_uid, band, min(year) AS y0, max(year) AS y1 FROM seasonal GROUP BY 1, 2)
SELECT s.crown_uid, s.band, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS std, round(max(value) - min(value), 9) AS amplitude,
  round(avg(CASE WHEN year = y1 THEN value END) - avg(CASE WHEN year = y0 THEN value END), 9) + 0.0 AS late_minus_early FROM seasonal s JOIN y ON y.crown_uid = s.crown_uid AND y.band = s.band GROUP BY 1, 2""",
)
def w18(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.temporal_features(D.seasonal(spark, sf)), "mean", "std", "amplitude", "late_minus_early")


@register(
    "w18_season_trends",
    f"WITH {D.SEASONAL_SQL} SELECT crown_uid, season, band, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS std, round(regr_slope(value, year), 9) + 0.0 AS slope FROM seasonal GROUP BY 1, 2, 3",
)
def w18b(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.season_trends(D.seasonal(spark, sf)), "mean", "std", "slope")


@register("w19_rolling_median", f"WITH {D.OBS_SQL} SELECT chain_id, om_id, round(median(gcc_mean) OVER (PARTITION BY chain_id ORDER BY om_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 9) AS smooth FROM obs")
def w19(spark: SparkSession, sf: str) -> DataFrame:
    return D.obs(spark, sf).select("chain_id", "om_id", r9(T.rolling_median("gcc_mean", "chain_id", "om_id")).alias("smooth"))


@register(
    "w20_composite_16d",
    """SELECT l_suppkey, CAST(DATE '1995-01-01' + CAST(floor((date_diff('day', DATE '1995-01-01', l_shipdate::DATE) + 8) / 16.0) AS INTEGER) * 16 AS VARCHAR) AS grid_day, count(l_quantity) AS n, round(median(l_quantity), 9) AS median
FROM lineitem GROUP BY l_suppkey, CAST(floor((date_diff('day', DATE '1995-01-01', l_shipdate::DATE) + 8) / 16.0) AS INTEGER)""",
)
def w20(spark: SparkSession, sf: str) -> DataFrame:
    out = T.tumbling_composite(table(spark, sf, "lineitem"), "l_suppkey", "l_shipdate", "l_quantity", "1995-01-01")
    return out.select("l_suppkey", F.col("grid_day").cast("string").alias("grid_day"), "n", r9("median").alias("median"))


@register("w21_harmonic_fit")
def w21(spark: SparkSession, sf: str) -> DataFrame:
    fits = Q.harmonic_fit(table(spark, sf, "lineitem"), "l_suppkey", "l_shipdate", "l_quantity", "1995-01-01")
    return fits.select("l_suppkey", "n", F.transform("coefficients", lambda x: F.round(x, 4)).alias("coefficients"))


@register("w17_viterbi")
def w17(spark: SparkSession, sf: str) -> DataFrame:
    filled = T.dense_series(D.obs(spark, sf), D.DATES, values=["veg_fraction_hsv", "gcc_mean", "laplacian_var"])
    rows = filled.select("chain_id", "om_id", F.col("veg_fraction_hsv").alias("fresh"), F.col("gcc_mean").alias("mature"), (F.col("laplacian_var") / 1000.0).alias("old"))
    return Q.smooth_states(rows, "chain_id", "om_id", ["fresh", "mature", "old"], [[0.0, 0.55, 1.1], [1.1, 0.0, 0.55], [0.55, 1.1, 0.0]])


@register("w25_observations", f"""WITH {D.OBS_SQL} SELECT c.chain_id, string_agg(CASE WHEN o.n IS NULL THEN 'missing' WHEN o.is_bad_observation THEN 'bad' ELSE 'ok' END, ',' ORDER BY d.om_id) AS statuses
FROM (SELECT DISTINCT chain_id FROM obs) c CROSS JOIN {DATES_SQL} d LEFT JOIN obs o ON o.chain_id = c.chain_id AND o.om_id = d.om_id GROUP BY 1""")
def w25(spark: SparkSession, sf: str) -> DataFrame:
    return T.observations(D.obs(spark, sf), D.DATES, ["gcc_mean"]).select("chain_id", F.array_join("observations.status", ",").alias("statuses"))


@register("k1_best_row", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def k1(spark: SparkSession, sf: str) -> DataFrame:
    return A.best_rows(table(spark, sf, "orders"), ["o_custkey"], ["o_totalprice"], ["o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@register(
    "k8_threshold_sweep",
    """WITH t AS (SELECT unnest([0.2, 0.4, 0.6, 0.8]) AS threshold), r AS (SELECT l_discount * 10 AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS truth FROM lineitem), n AS (SELECT sum(truth) AS pos FROM r)
SELECT threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, (pos - tp)::BIGINT AS fn, round(tp / nullif((tp + fp)::DOUBLE, 0), 9) AS precision, round(tp / pos::DOUBLE, 9) AS recall FROM (
  SELECT threshold, coalesce(sum(truth) FILTER (WHERE score >= threshold), 0) AS tp, coalesce(sum(1 - truth) FILTER (WHERE score >= threshold), 0) AS fp FROM r CROSS JOIN t GROUP BY 1) CROSS JOIN n""",
)
def k8(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select((F.col("l_discount") * 10).alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("truth"))
    return rounded(A.threshold_sweep(rows, "score", "truth", [0.2, 0.4, 0.6, 0.8]).drop("f1"), "precision", "recall")


@register(
    "k3_holdout_areas",
    """SELECT source AS area, count(*) AS n, least(count(*) FILTER (WHERE quality = 1), count(*) FILTER (WHERE quality = 0)) AS min_class FROM documents d JOIN labels l ON l.doc_id = d.doc_id
GROUP BY 1 HAVING least(count(*) FILTER (WHERE quality = 1), count(*) FILTER (WHERE quality = 0)) > 0 ORDER BY 3 DESC, 2 DESC, 1 LIMIT 6""",
)
def k3(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.col("source").alias("area")).join(table(spark, sf, "labels"), "doc_id")
    return A.holdout_areas(rows, "area", "quality")
