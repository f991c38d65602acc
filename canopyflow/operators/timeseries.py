"""Per-tree series over ordered dates (W1-W19, W25): robust scores, gap filling, leaf-shed scores, events.

Series are long tables (tree, date id, value). A window partition is one tree's series, whose length is the
number of dates; statistics over all trees of a date are aggregates that are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def robust_z_by_group(rows: DataFrame, value: str, group: list[str], out: str = "rz") -> DataFrame:
    """(x - median) / (1.4826 MAD + 1e-8) per group; null where MAD is 0 or any value of the group is null."""
    med = rows.groupBy(*group).agg(F.median(value).alias("__med"), (F.count("*") - F.count(value)).alias("__gaps"))
    centred = rows.join(med, group)
    mad = centred.groupBy(*group).agg(F.median(F.abs(F.col(value) - F.col("__med"))).alias("__mad"))
    scored = centred.join(mad, group)
    z = (F.col(value) - F.col("__med")) / (F.lit(1.4826) * F.col("__mad") + 1e-8)
    return scored.withColumn(out, F.when((F.col("__mad") > 0) & (F.col("__gaps") == 0), z)).drop("__med", "__mad", "__gaps")


def average_percent_rank(rows: DataFrame, value: str, group: list[str], out: str = "pct") -> DataFrame:
    """Average rank of equal values over the number of non-null values."""
    w = W.partitionBy(*group).orderBy(value)
    some = rows.where(F.col(value).isNotNull())
    ranked = some.withColumn(out, (F.rank().over(w) + (F.count("*").over(W.partitionBy(*group, value)) - 1) / 2.0) / F.count("*").over(W.partitionBy(*group)))
    return ranked.unionByName(rows.where(F.col(value).isNull()).withColumn(out, F.lit(None).cast("double")))


def robust_z_iqr(rows: DataFrame, value: str, tree: str, out: str = "rz") -> DataFrame:
    """(x - median) / (IQR / 2) per tree; 0 where the IQR is under 1e-12."""
    q = rows.groupBy(tree).agg(F.median(value).alias("__m"), (F.percentile(value, F.lit(0.75)) - F.percentile(value, F.lit(0.25))).alias("__iqr"))
    x = F.col(value)
    z = F.when(x.isNull(), F.lit(None)).when(F.col("__iqr") < 1e-12, 0.0).otherwise((x - F.col("__m")) / (0.5 * F.col("__iqr")))
    return rows.join(q, tree).withColumn(out, z).drop("__m", "__iqr")


def midrank(rows: DataFrame, value: str, tree: str, out: str = "pct") -> DataFrame:
    """(values below + half of the equal ones) / n of each tree; null for fewer than two values."""
    some = rows.where(F.col(value).isNotNull())
    w = W.partitionBy(tree)
    n, less, same = F.count("*").over(w), F.rank().over(w.orderBy(value)) - 1, F.count("*").over(W.partitionBy(tree, value))
    return some.withColumn(out, F.when(n >= 2, (less + 0.5 * same) / n))


def dense_series(rows: DataFrame, dates: list[int], tree: str = "chain_id", date: str = "om_id", values: list[str] = (), bad: str | None = "is_bad_observation") -> DataFrame:
    """A row for every tree and date; values of bad observations and of missing dates are null."""
    trees = rows.select(tree).where(F.col(tree).isNotNull()).distinct()
    grid = trees.withColumn(date, F.explode(F.array(*[F.lit(d).cast("int") for d in dates])))
    keep = ~F.coalesce(F.col(bad), F.lit(False)) if bad else F.lit(True)
    own = rows.groupBy(tree, date).agg(*[F.first(F.when(keep, F.col(v)), ignorenulls=True).cast("double").alias(v) for v in values])
    return grid.join(own, [tree, date], "left")


def interpolated(rows: DataFrame, value: str, tree: str = "chain_id", date: str = "om_id", out: str | None = None) -> DataFrame:
    """Linear between known dates, constant beyond them; one known date gives a constant, none gives 0."""
    before = W.partitionBy(tree).orderBy(date).rowsBetween(W.unboundedPreceding, 0)
    after = W.partitionBy(tree).orderBy(date).rowsBetween(0, W.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col(date))
    x0, x1 = F.last(at, True).over(before), F.first(at, True).over(after)
    y0, y1 = F.last(value, True).over(before), F.first(value, True).over(after)
    line = y0 + (y1 - y0) * (F.col(date) - x0) / F.nullif(x1 - x0, F.lit(0))
    return rows.withColumn(out or f"{value}_hat", F.coalesce(F.col(value), line, y0, y1, F.lit(0.0)))


def minmax(value: str | Column, tree: str = "chain_id") -> Column:
    """(x - min) / (max - min) of the tree; 0 where the range is at most 1e-9."""
    c = F.col(value) if isinstance(value, str) else value
    w = W.partitionBy(tree)
    span = F.max(c).over(w) - F.min(c).over(w)
    return F.when(span <= 1e-9, 0.0).otherwise((c - F.min(c).over(w)) / span)


def amplitude(value: str) -> Column:
    """Max - min, null for fewer than two values (an aggregate)."""
    return F.when(F.count(value) >= 2, F.max(value) - F.min(value))


def slope(value: str, date: str = "om_id") -> Column:
    """Least-squares slope, null for fewer than two values (an aggregate)."""
    return F.when(F.count(value) >= 2, F.regr_slope(F.col(value), F.when(F.col(value).isNotNull(), F.col(date)).cast("double")))


def temporal_summary(rows: DataFrame, values: list[str], tree: str = "chain_id", date: str = "om_id", bad: str | None = "is_bad_observation") -> DataFrame:
    """Clean observations, first and last date, amplitude and slope of every value, in one aggregation."""
    ok = ~F.coalesce(F.col(bad), F.lit(False)) if bad else F.lit(True)
    clean = rows.withColumns({v: F.when(ok, F.col(v)) for v in values})
    made = [F.count_if(ok).alias("n_obs_clean"), F.min(date).alias("om_start"), F.max(date).alias("om_end")]
    for v in values:
        made += [amplitude(v).alias(f"{v}_amplitude"), slope(v, date).alias(f"{v}_slope")]
    return clean.groupBy(tree).agg(*made)


def trough(value: str, date: str = "om_id") -> Column:
    """The first date of the least value (an aggregate)."""
    return F.min(F.struct(F.col(value), F.col(date)))[date]


def peak(value: str, date: str = "om_id") -> Column:
    """The first date of the greatest value (an aggregate)."""
    return F.max(F.struct(F.col(value), (-F.col(date)).alias("__d")))["__d"] * -1


def direction_changes(rows: DataFrame, value: str, tree: str = "chain_id", date: str = "om_id", least: float = 0.05) -> DataFrame:
    """(tree, dir_changes): sign changes between successive differences of more than `least`."""
    w = W.partitionBy(tree).orderBy(date)
    steps = rows.withColumn("__d", F.col(value) - F.lag(value).over(w)).where(F.abs("__d") > least).withColumn("__s", F.signum("__d"))
    flips = steps.withColumn("__f", (F.lag("__s").over(w) != F.col("__s")).cast("int")).groupBy(tree).agg(F.coalesce(F.sum("__f"), F.lit(0)).alias("dir_changes"))
    return rows.select(tree).distinct().join(flips, tree, "left").select(tree, F.coalesce("dir_changes", F.lit(0)).cast("long").alias("dir_changes"))


# Defaults of the leaf-shed score.
LEAF_SHED = {"w_veg_amp": 0.35, "w_depth": 0.30, "w_gcc_amp": 0.25, "w_tex": 0.10, "quantile": 0.90, "veg_min": 0.30, "threshold": 0.85, "on": 0.65, "off": 0.35}


def leaf_shed(rows: DataFrame, dates: list[int], config: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(scores, phases) from veg_fraction_hsv, gcc_mean, laplacian_var and is_bad_observation.

    scores: amplitudes, component scores, deciduous_score, is_deciduous and the event dates of each chain_id.
    phases: per chain_id and om_id the filled and normalised cover, its phase, and the trough date.
    An amplitude score is null where the amplitudes' quantile over all trees is at most 1e-12; then the
    score is null and the tree is not deciduous.
    """
    c = LEAF_SHED | (config or {})
    names = ["veg_fraction_hsv", "gcc_mean", "laplacian_var"]
    filled = dense_series(rows, sorted(dates), values=names)
    for v in names:
        filled = interpolated(filled, v)
    trees = filled.groupBy("chain_id").agg(
        (F.max("veg_fraction_hsv_hat") - F.min("veg_fraction_hsv_hat")).alias("a_veg"),
        (F.max("gcc_mean_hat") - F.min("gcc_mean_hat")).alias("a_gcc"),
        (F.max("laplacian_var_hat") - F.min("laplacian_var_hat")).alias("a_tex"),
        F.min("veg_fraction_hsv_hat").alias("min_veg"),
        trough("veg_fraction_hsv_hat").alias("trough_om"),
    )
    norms = trees.agg(*[F.percentile(a, F.lit(c["quantile"])).alias(f"n_{a}") for a in ("a_veg", "a_gcc", "a_tex")])
    scored = trees.join(F.broadcast(norms))  # one row
    part = lambda a: F.when(F.col(f"n_{a}") > 1e-12, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(a) / F.col(f"n_{a}"))))
    depth = F.when(F.col("min_veg") < c["veg_min"], F.least(F.lit(1.0), (c["veg_min"] - F.col("min_veg")) / max(c["veg_min"], 1e-12))).otherwise(0.0)
    scored = scored.withColumns({"s_veg_amp": part("a_veg"), "s_depth": depth, "s_gcc_amp": part("a_gcc"), "s_tex": part("a_tex")})
    score = c["w_veg_amp"] * F.col("s_veg_amp") + c["w_depth"] * F.col("s_depth") + c["w_gcc_amp"] * F.col("s_gcc_amp") + c["w_tex"] * F.col("s_tex")
    scored = scored.withColumn("deciduous_score", score).withColumn("is_deciduous", F.coalesce(F.col("deciduous_score") >= c["threshold"], F.lit(False))).drop("n_a_veg", "n_a_gcc", "n_a_tex")
    level = minmax("veg_fraction_hsv_hat")
    state = F.when(~F.col("is_deciduous"), "stable").when(F.col("level") >= c["on"], "leaf_on").when(F.col("level") <= c["off"], "leaf_off").otherwise("transitioning")
    phases = filled.select("chain_id", "om_id", "veg_fraction_hsv_hat", level.alias("level")).join(scored.select("chain_id", "is_deciduous", "trough_om"), "chain_id")
    phases = phases.select("chain_id", "om_id", "veg_fraction_hsv_hat", F.col("level").alias("veg_fraction_hsv_norm"), state.alias("phenophase"), "trough_om", "is_deciduous", F.lead("om_id").over(W.partitionBy("chain_id").orderBy("om_id")).alias("next_om"))
    on = F.col("phenophase") == "leaf_on"
    events = phases.where("is_deciduous").groupBy("chain_id").agg(
        F.max_by("next_om", F.when(on & (F.col("om_id") < F.col("trough_om")), F.col("om_id"))).alias("leaf_off_start_om"),
        F.first("trough_om").alias("full_leaf_off_om"),
        F.min(F.when(on & (F.col("om_id") >= F.col("trough_om")), F.col("om_id"))).alias("leaf_on_return_om"),
    )
    return scored.join(events, "chain_id", "left").drop("trough_om"), phases.drop("next_om", "is_deciduous")


def phenometrics(rows: DataFrame, metrics: list[str], tree: str = "chain_id", date: str = "om_id", least: float = 0.05) -> DataFrame:
    """(tree, metric, amplitude, peak_om, trough_om, slope, dir_changes) of gap-filled metrics; changes on the normalised series."""
    filled = rows
    for m in metrics:
        filled = interpolated(filled, m, tree, date, m)
    long = filled.unpivot([tree, date], metrics, "metric", "value")
    base = long.groupBy(tree, "metric").agg(
        (F.max("value") - F.min("value")).alias("amplitude"), peak("value", date).alias("peak_om"), trough("value", date).alias("trough_om"), slope("value", date).alias("slope")
    )
    w = W.partitionBy(tree, "metric")
    span = F.max("value").over(w) - F.min("value").over(w)
    norm = long.withColumn("norm", F.when(span <= 1e-9, 0.0).otherwise((F.col("value") - F.min("value").over(w)) / span)).withColumn("__k", F.struct(tree, "metric"))
    flips = direction_changes(norm, "norm", "__k", date, least).select(F.col(f"__k.{tree}").alias(tree), F.col("__k.metric").alias("metric"), "dir_changes")
    return base.join(flips, [tree, "metric"])


def temporal_features(rows: DataFrame, key: str = "crown_uid") -> DataFrame:
    """W18 over (key, year, season, band, value): mean, std (ddof 1), amplitude, and mean of the last year less that
    of the first, of each band."""
    w = W.partitionBy(key, "band")
    known = rows.withColumns({"__first": F.min("year").over(w), "__last": F.max("year").over(w)})
    of = lambda year: F.avg(F.when(F.col("year") == F.col(year), F.col("value")))
    return known.groupBy(key, "band").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), (F.max("value") - F.min("value")).alias("amplitude"), (of("__last") - of("__first")).alias("late_minus_early")
    )


def season_trends(rows: DataFrame, key: str = "crown_uid") -> DataFrame:
    """(key, season, band, mean, std, slope) over the years."""
    return rows.groupBy(key, "season", "band").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.regr_slope(F.col("value"), F.col("year").cast("double")).alias("slope"))


def rolling_median(value: str, tree: str, order: str, width: int = 3) -> Column:
    """Centred median over `width` rows; at the ends over the rows that exist."""
    half = width // 2
    return _array_median(F.collect_list(value).over(W.partitionBy(tree).orderBy(order).rowsBetween(-half, half)))


def _array_median(values: Column) -> Column:
    s, n = F.array_sort(values), F.size(values)
    low, high = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return (low + high) / 2.0


def tumbling_composite(rows: DataFrame, key: str, day: str, value: str, start: str, step: int = 16) -> DataFrame:
    """Median of the observations in [g - step / 2, g + step / 2) for grid dates g = start + k step; (key, grid_day, n, median)."""
    k = F.floor((F.datediff(F.col(day).cast("date"), F.lit(start).cast("date")) + step // 2) / F.lit(step)).cast("int")
    grid = F.date_add(F.lit(start).cast("date"), k * step)
    return rows.where(F.col(value).isNotNull()).groupBy(key, grid.alias("grid_day")).agg(F.count(value).alias("n"), F.median(value).alias("median"))


def observations(rows: DataFrame, dates: list[int], values: list[str], tree: str = "chain_id", date: str = "om_id", bad: str = "is_bad_observation") -> DataFrame:
    """One row a tree with its dates in order, each ok, bad or missing, and the values of the ok ones."""
    own = rows.groupBy(tree, date).agg(F.first(F.coalesce(F.col(bad), F.lit(False))).alias("__bad"), *[F.first(v).alias(v) for v in values])
    grid = rows.select(tree).distinct().withColumn(date, F.explode(F.array(*[F.lit(d).cast("int") for d in dates])))
    status = F.when(F.col("__bad").isNull(), "missing").when(F.col("__bad"), "bad").otherwise("ok")
    full = grid.join(own, [tree, date], "left").withColumn("status", status)
    item = F.struct(date, "status", *[F.when(F.col("status") == "ok", F.col(v)).alias(v) for v in values])
    return full.groupBy(tree).agg(F.array_sort(F.collect_list(item)).alias("observations"))
