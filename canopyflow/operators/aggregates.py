"""Patch, zonal, seasonal, coverage, label and run aggregates (G1-G39, K1-K8, U1-U10) over long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from canopyflow.functions import spectral as S


def patch_features(pixels: DataFrame, keys: list[str] = ("chain_id", "om_id"), rich: bool = False, least_pixels: int = 20) -> DataFrame:
    """Patch statistics of pixels (keys, row, col, r, g, b in 0..255; all zero: no data).

    valid_pixel_fraction over all pixels; the rest over the valid ones, but sharpness (laplacian_var) over all.
    rich adds excess green, channel means, deviations (ddof 0) and their ratio.
    """
    keys = list(keys)
    r, g, b = (F.col(c).cast("double") / 255.0 for c in "rgb")
    valid = (F.col("r") > 0) | (F.col("g") > 0) | (F.col("b") > 0)
    hsv = S.rgb_to_hsv(r, g, b)
    index = S.rgb_indices(r, g, b)
    rows = pixels.withColumns({"__valid": valid, "__veg": S.vegetation(hsv), "__dark": S.shadow(hsv, 0.2), "__gray": S.luminance(r, g, b), "__gcc": index["gcc"], "__rcc": index["rcc"], "__exg": index["exg"]})
    of = lambda c: F.when(F.col("__valid"), F.col(c))
    share = lambda c: F.count_if(F.col("__valid") & F.col(c)) / F.nullif(F.count_if("__valid").cast("double"), F.lit(0.0))
    made = [
        F.count("*").alias("n_pixels"), F.count_if("__valid").alias("n_valid"), (F.count_if("__valid") / F.count("*")).alias("valid_pixel_fraction"),
        share("__dark").alias("shadow_fraction"), share("__veg").alias("veg_fraction_hsv"), F.avg(of("__gcc")).alias("gcc_mean"), F.avg(of("__rcc")).alias("rcc_mean"),
    ]
    if rich:
        made += [F.avg(of("__exg")).alias("exg_mean"), F.stddev_pop(of("__gray")).alias("gray_std")]
        for c in "rgb":
            made += [F.avg(of(c)).alias(f"{c}_mean"), F.stddev_pop(of(c)).alias(f"{c}_std"), (F.stddev_pop(of(c)) / F.nullif(F.avg(of(c)), F.lit(0.0))).alias(f"{c}_cv")]
    base = rows.groupBy(*keys).agg(*made)
    texture = gray_entropy(rows.where("__valid"), keys, "__gray").join(laplacian_variance(rows.withColumn("__g255", F.col("__gray") * 255.0), keys, "__g255"), keys, "full")
    out = base.join(texture, keys, "left")
    bad = S.bad_observation(F.col("valid_pixel_fraction"), F.col("shadow_fraction"), F.col("laplacian_var"), F.col("n_valid"), least_pixels=least_pixels)
    return out.withColumn("is_bad_observation", F.coalesce(bad, F.lit(True)))


def gray_entropy(pixels: DataFrame, keys: list[str], gray: str, bins: int = 64) -> DataFrame:
    """Shannon entropy (bits) of a histogram of `bins` equal bins on [0, 1]."""
    hist = pixels.groupBy(*keys, F.least(F.floor(F.col(gray) * bins), F.lit(bins - 1)).alias("__bin")).agg(F.count("*").alias("__n"))
    p = F.col("__n") / F.sum("__n").over(W.partitionBy(*keys))
    return hist.withColumn("__p", p).groupBy(*keys).agg((-F.sum(F.col("__p") * F.log2("__p"))).alias("gray_entropy"))


def laplacian_variance(pixels: DataFrame, keys: list[str], gray: str) -> DataFrame:
    """Population variance of the 4-neighbour Laplacian over the pixels with all four neighbours."""
    row, col = W.partitionBy(*keys, "row").orderBy("col"), W.partitionBy(*keys, "col").orderBy("row")
    near = lambda w, axis, step: F.when(F.lag(axis, step).over(w) == F.col(axis) - step, F.lag(gray, step).over(w))
    value = near(row, "col", 1) + near(row, "col", -1) + near(col, "row", 1) + near(col, "row", -1) - 4.0 * F.col(gray)
    return pixels.withColumn("__lap", value).groupBy(*keys).agg(F.var_pop("__lap").alias("laplacian_var"))


def glcm(pixels: DataFrame, keys: list[str], gray: str, levels: int = 32) -> DataFrame:
    """Contrast, homogeneity and energy of symmetric, normalised co-occurrence at distance 1, mean of four directions."""
    q = F.least(F.floor(F.col(gray) * levels), F.lit(levels - 1)).cast("int")
    one = pixels.select(*keys, "row", "col", q.alias("__i"))
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc"), F.lit(k).alias("d")) for k, (a, b) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1)))]))
    moved = one.withColumn("__s", step).select(*keys, (F.col("row") + F.col("__s.dr")).alias("row"), (F.col("col") + F.col("__s.dc")).alias("col"), F.col("__s.d").alias("__d"), F.col("__i").alias("__j"))
    met = moved.join(one, [*keys, "row", "col"]).groupBy(*keys, "__d", "__i", "__j").agg(F.count("*").alias("__n"))
    both = met.unionByName(met.withColumnsRenamed({"__i": "__t"}).withColumnsRenamed({"__j": "__i"}).withColumnsRenamed({"__t": "__j"})).groupBy(*keys, "__d", "__i", "__j").agg(F.sum("__n").alias("__n"))
    p = both.withColumn("__p", F.col("__n") / F.sum("__n").over(W.partitionBy(*keys, "__d")))
    d2 = (F.col("__i") - F.col("__j")) * (F.col("__i") - F.col("__j"))
    each = p.groupBy(*keys, "__d").agg(F.sum(F.col("__p") * d2).alias("c"), F.sum(F.col("__p") / (1 + d2)).alias("h"), F.sqrt(F.sum(F.col("__p") * F.col("__p"))).alias("e"))
    return each.groupBy(*keys).agg(F.avg("c").alias("glcm_contrast"), F.avg("h").alias("glcm_homogeneity"), F.avg("e").alias("glcm_energy"))


def zonal_median(pixels: DataFrame, keys: list[str], bands: list[str], least: int) -> DataFrame:
    """Median of the non-null pixels of each band, null for fewer than `least`; and the valid pixels of the first band."""
    return pixels.groupBy(*keys).agg(*[F.when(F.count(b) >= least, F.median(b)).alias(b) for b in bands], F.count(bands[0]).alias("valid_pixels"))


def zonal_weighted_mean(pixels: DataFrame, keys: list[str], bands: list[str], weight: str = "weight") -> DataFrame:
    """Mean weighted by pixel coverage, over the non-null pixels; coverage is the weight of all pixels."""
    mean = lambda b: F.sum(F.col(weight) * F.col(b)) / F.nullif(F.sum(F.when(F.col(b).isNotNull(), F.col(weight))), F.lit(0.0))
    return pixels.groupBy(*keys).agg(*[mean(b).alias(b) for b in bands], F.sum(weight).alias("coverage"))


def zonal_mean(pixels: DataFrame, keys: list[str], bands: list[str], valid: Column) -> DataFrame:
    """Means over valid pixels, valid and total pixels, and their ratio."""
    made = [F.avg(F.when(valid, F.col(b))).alias(f"{b}_mean") for b in bands]
    return pixels.groupBy(*keys).agg(*made, F.count_if(valid).alias("valid_pixels"), F.count("*").alias("total_pixels"), (F.count_if(valid) / F.count("*")).alias("valid_fraction"))


def composite(scenes: DataFrame, keys: list[str], scene: str, value: str) -> DataFrame:
    """Median over scenes of each scene's median, with the scenes' number."""
    each = scenes.groupBy(*keys, scene).agg(F.median(value).alias("__m"))
    return each.groupBy(*keys).agg(F.median("__m").alias(value), F.count("__m").alias("n_scenes"))


def wide_amplitude(columns: list[str]) -> Column:
    """Greatest less least of the columns, without nulls."""
    return F.greatest(*[F.col(c) for c in columns]) - F.least(*[F.col(c) for c in columns])


def observation_features(obs: DataFrame, key: str, value: str, group: str, groups: list, day: str | None = None, ddof: int = 0) -> DataFrame:
    """Count, distinct years, median, mean, std, amplitude of a value, and its median for each listed group."""
    std = F.stddev_pop(value) if ddof == 0 else F.stddev_samp(value)
    years = [F.count_distinct(F.year(day)).alias("n_years")] if day else []
    parts = [F.median(F.when(F.col(group) == g, F.col(value))).alias(f"{value}_{g}") for g in groups]
    return obs.groupBy(key).agg(F.count(value).alias("n_obs"), *years, F.median(value).alias(f"{value}_median"), F.avg(value).alias(f"{value}_mean"), std.alias(f"{value}_std"), (F.max(value) - F.min(value)).alias(f"{value}_amp"), *parts)


def weekly(obs: DataFrame, keys: list[str], value: str, day: str, least: int = 1) -> DataFrame:
    """Per key and ISO week the median, quartiles, observations and years; weeks with fewer than `least` are left out."""
    made = obs.groupBy(*keys, F.weekofyear(day).alias("iso_week")).agg(
        F.median(value).alias("median"), F.percentile(value, F.lit(0.25)).alias("p25"), F.percentile(value, F.lit(0.75)).alias("p75"), F.count(value).alias("n_obs"), F.count_distinct(F.year(day)).alias("n_years")
    )
    return made.where(F.col("n_obs") >= least)


def coverage(obs: DataFrame, keys: list[str], day: str, valid: Column, fraction: str) -> DataFrame:
    """Distinct dates, valid observations and the median valid fraction."""
    return obs.groupBy(*keys).agg(F.count_distinct(F.to_date(day)).alias("n_dates"), F.count_if(valid).alias("n_valid"), F.median(fraction).alias("median_fraction"))


def cloud_sweep(scenes: DataFrame, thresholds: list[float], cloud: str = "cloud_cover", day: str = "datetime") -> DataFrame:
    """For every threshold the items at or below it, their dates, ISO weeks and years; one pass over the scenes."""
    limits = F.explode(F.array_compact(F.array(*[F.when(F.col(cloud) <= t, F.lit(float(t))) for t in thresholds])))
    d = F.to_date(day)
    return scenes.withColumn("threshold", limits).groupBy("threshold").agg(
        F.count("*").alias("n_items"), F.count_distinct(d).alias("n_dates"), F.count_distinct(F.struct(F.extract(F.lit("YEAROFWEEK"), d), F.weekofyear(d))).alias("n_weeks"), F.count_distinct(F.year(d)).alias("n_years")
    )


def value_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) of several columns."""
    return rows.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value").groupBy("column", "value").agg(F.count("*").alias("n"))


def named_counts(rows: DataFrame, keys: list[str], value: str, missing: str = "(missing)") -> DataFrame:
    """Counts with a placeholder for null."""
    return rows.groupBy(*keys, F.coalesce(F.col(value), F.lit(missing)).alias(value)).agg(F.count("*").alias("n"))


def label_summary(rows: DataFrame, area: str, label: str, source: str) -> DataFrame:
    """Per area the labelled rows, positives, negatives, and the number of sources."""
    has = F.coalesce(F.col(label) != -1, F.lit(False))
    return rows.groupBy(area).agg(F.count("*").alias("n"), F.count_if(has).alias("n_labelled"), F.count_if(F.col(label) == 1).alias("n_positive"), F.count_if(F.col(label) == 0).alias("n_negative"), F.count_distinct(F.when(has, F.col(source))).alias("n_sources"))


def crosstab(rows: DataFrame, row: str, column: str, values: list, prefix: str = "") -> DataFrame:
    """Counts of each listed value by row, 0 where there are none."""
    return rows.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(f"{prefix}{v}") for v in values])


def quantile_summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, quartiles and n."""
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.percentile(value, F.lit(0.25)).alias("p25"), F.percentile(value, F.lit(0.75)).alias("p75"), F.count(value).alias("n"))


def area_class_summary(rows: DataFrame, keys: list[str], season: str, value: str) -> DataFrame:
    """Mean of the seasons' means, and their greatest less their least."""
    each = rows.groupBy(*keys, season).agg(F.avg(value).alias("__m"))
    return each.groupBy(*keys).agg(F.avg("__m").alias("mean"), (F.max("__m") - F.min("__m")).alias("seasonal_range"))


def missingness(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, null_fraction, median)."""
    long = rows.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    return long.groupBy("column").agg(F.avg(F.col("value").isNull().cast("double")).alias("null_fraction"), F.median("value").alias("median"))


def cohen_d(rows: DataFrame, label: str, features: list[str]) -> DataFrame:
    """(feature, d): difference of the class means over the root mean class variance (ddof 0)."""
    of = lambda f, c: F.when(F.col(label) == c, F.col(f))
    d = lambda f: (F.avg(of(f, 1)) - F.avg(of(f, 0))) / F.nullif(F.sqrt((F.var_pop(of(f, 1)) + F.var_pop(of(f, 0))) / 2.0), F.lit(0.0))
    return rows.agg(*[d(f).alias(f) for f in features]).unpivot([], features, "feature", "d")


def quartile_error(rows: DataFrame, value: str, correct: str, keys: list[str] = ()) -> DataFrame:
    """Count and mean of `correct` by quartile of a value (bounds belong to the lower quartile)."""
    cuts = rows.agg(*[F.percentile(value, F.lit(q / 4)).alias(f"__q{q}") for q in (1, 2, 3)])
    q = F.when(F.col(value) <= F.col("__q1"), 1).when(F.col(value) <= F.col("__q2"), 2).when(F.col(value) <= F.col("__q3"), 3).otherwise(4)
    return rows.where(F.col(value).isNotNull()).join(F.broadcast(cuts)).groupBy(*keys, q.alias("quartile")).agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("double")).alias("accuracy"))


def vote(cells: DataFrame, key: str, colour: str, majority: float = 0.60) -> DataFrame:
    """The colour of most cells; without `majority` of them it is marked weak. Ties go to the first name."""
    n = cells.groupBy(key, colour).agg(F.count("*").alias("__n"))
    share = F.col("__n") / F.sum("__n").over(W.partitionBy(key))
    top = n.withColumn("fraction", share).withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("__n"), colour))).where("__r = 1")
    return top.select(key, F.when(F.col("fraction") >= majority, F.col(colour)).otherwise(F.concat(F.col(colour), F.lit(" [weak]"))).alias("winner"), "fraction")


def grid_cells(pixels: DataFrame, keys: list[str], n: int, values: list[str], least: int = 5) -> DataFrame:
    """Medians of an n x n grid laid over each patch's extent; cells with fewer than `least` pixels are left out."""
    w = W.partitionBy(*keys)
    place = lambda c: F.least(F.lit(n - 1), F.floor((F.col(c) - F.min(c).over(w)) * n / (F.max(c).over(w) - F.min(c).over(w) + 1))).cast("int")
    celled = pixels.withColumns({"cell_row": place("row"), "cell_col": place("col")})
    return celled.groupBy(*keys, "cell_row", "cell_col").agg(F.count("*").alias("n"), *[F.median(v).alias(v) for v in values]).where(F.col("n") >= least)


def crown_vote(proba: DataFrame, uid: str, classes: list[str], threshold: float = 0.5) -> DataFrame:
    """Mean probability of each class; two classes are decided by a threshold on the second, more by the largest."""
    mean = proba.groupBy(uid).agg(*[F.avg(c).alias(c) for c in classes], F.count("*").alias("n"))
    if len(classes) == 2:
        return mean.withColumn("predicted", F.when(F.col(classes[1]) >= threshold, classes[1]).otherwise(classes[0]))
    top, out = F.greatest(*classes), F.when(F.lit(False), F.lit(None).cast("string"))
    for c in classes:
        out = out.when(F.col(c) == top, c)
    return mean.withColumn("predicted", out)


def dominant(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value; the least on ties."""
    n = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = W.partitionBy(*keys).orderBy(F.desc("n"), value)
    return n.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def string_counts(rows: DataFrame, key: str, value: str) -> DataFrame:
    """`value=count` strings of each key, in order, joined by `; `."""
    n = rows.groupBy(key, value).agg(F.count("*").alias("__n"))
    return n.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.col(value).cast("string"), F.lit("="), F.col("__n").cast("string")))), "; ").alias("counts"))


def best_rows(rows: DataFrame, keys: list[str], order: list[str], tie: list[str]) -> DataFrame:
    """K1: the first row of each group by the order columns, descending, then the tie columns."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order], *tie)
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def top_per_group(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """K2-K6: the first k rows of each group."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= k).drop("__r")


def holdout_areas(rows: DataFrame, area: str, label: str, top: int = 6) -> DataFrame:
    """K3: areas with both classes by their smaller class, then size; the first `top`."""
    n = rows.where(F.col(label) != -1).groupBy(area).agg(F.count("*").alias("n"), F.least(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).alias("min_class"))
    return n.where("min_class > 0").orderBy(F.desc("min_class"), F.desc("n"), area).limit(top)


def threshold_sweep(rows: DataFrame, score: str, truth: str, thresholds: list[float]) -> DataFrame:
    """K8 / M5: tp, fp, fn, precision, recall and f1 at every threshold; rows are aggregated once."""
    bin_of = sum((F.when(F.col(score) >= t, 1).otherwise(0) for t in thresholds[1:]), F.when(F.col(score) >= thresholds[0], 1).otherwise(0))
    n = rows.groupBy(bin_of.alias("__k")).agg(F.count_if(F.col(truth) == 1).alias("__p"), F.count_if(F.col(truth) == 0).alias("__n"))
    grid = rows.sparkSession.createDataFrame([(k + 1, float(t)) for k, t in enumerate(sorted(thresholds))], "__t int, threshold double")
    met = grid.join(n, n["__k"] >= grid["__t"], "left").groupBy("threshold").agg(F.coalesce(F.sum("__p"), F.lit(0)).alias("tp"), F.coalesce(F.sum("__n"), F.lit(0)).alias("fp"))
    total = n.agg(F.sum("__p").alias("__all"))
    p, r = F.col("tp") / F.nullif((F.col("tp") + F.col("fp")).cast("double"), F.lit(0.0)), F.col("tp") / F.nullif(F.col("__all").cast("double"), F.lit(0.0))
    return met.join(F.broadcast(total)).select("threshold", "tp", "fp", (F.col("__all") - F.col("tp")).alias("fn"), p.alias("precision"), r.alias("recall"), (2 * p * r / F.nullif(p + r, F.lit(0.0))).alias("f1"))


def diverse_sample(rows: DataFrame, key: str, size: str, stratum: str, n: int, quantiles: int = 4, seed: int = 0) -> DataFrame:
    """Equal shares of strata (quantile of size x stratum), topped up over all by seeded hash order; n rows."""
    cuts = rows.agg(*[F.percentile(size, F.lit(k / quantiles)).alias(f"__c{k}") for k in range(1, quantiles)])
    part = sum((F.when(F.col(size) > F.col(f"__c{k}"), 1).otherwise(0) for k in range(2, quantiles)), F.when(F.col(size) > F.col("__c1"), 1).otherwise(0))
    dealt = rows.join(F.broadcast(cuts)).withColumn("__s", F.struct(part.alias("q"), F.col(stratum).alias("s"))).drop(*[f"__c{k}" for k in range(1, quantiles)])
    h = F.xxhash64(F.lit(seed), key)
    ranked = dealt.withColumn("__r", F.row_number().over(W.partitionBy("__s").orderBy(h, key)))
    return ranked.orderBy("__r", h, key).limit(n).drop("__s", "__r")


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all tables; columns that a table lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def distinct_by(rows: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row, by order, of each key."""
    return rows.withColumn("__k", key).withColumn("__r", F.row_number().over(W.partitionBy("__k").orderBy(*order))).where("__r = 1").drop("__k", "__r")


def multiset_difference(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose numbers differ, with both numbers."""
    a, b = expected.groupBy(*keys).agg(F.count("*").alias("expected")), actual.groupBy(*keys).agg(F.count("*").alias("actual"))
    both = a.join(b, keys, "full").select(*keys, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual"))
    return both.where("expected <> actual")


def long_to_wide(rows: DataFrame, key: str, column: str, values: list, value: str, prefix: str) -> DataFrame:
    """U8: one column for each listed value, null where there is no row."""
    return rows.groupBy(key).agg(*[F.first(F.when(F.col(column) == v, F.col(value)), ignorenulls=True).alias(f"{prefix}{v}") for v in values])


def wide_to_long(rows: DataFrame, keys: list[str], columns: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    """One row for each key and listed column; values as double."""
    return rows.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(keys), columns, name, value)


def expand_rows(rows: DataFrame, k: int, noise: dict[str, float] | None = None, seed: int = 0) -> DataFrame:
    """Each row k times, numbered, with normal noise of the given deviation on columns."""
    out = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return out.withColumns({c: F.col(c) + F.randn(seed + i) * d for i, (c, d) in enumerate((noise or {}).items())}) if noise else out
