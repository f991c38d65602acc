"""Run summaries, quality tables and choices over results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def matching_details(edges: DataFrame, keys: list[str], similarity: str = "similarity", iou: str = "iou") -> DataFrame:
    """Per case, pair of flights or gap (the keys) the edges, their share of all, and mean, least, greatest and median similarity, mean IoU."""
    total = edges.agg(F.count("*").alias("__all"))
    made = edges.groupBy(*keys).agg(
        F.count("*").alias("n_edges"), F.avg(similarity).alias("similarity_mean"), F.min(similarity).alias("similarity_min"), F.max(similarity).alias("similarity_max"),
        F.median(similarity).alias("similarity_median"), F.avg(iou).alias("iou_mean"),
    )
    return made.join(F.broadcast(total)).withColumn("share", F.col("n_edges") / F.col("__all")).drop("__all")


def score_summary(trees: DataFrame, score: str, positive: Column) -> DataFrame:
    """One row: trees, those for which `positive` holds, their share, and mean, median, least and greatest score."""
    return trees.agg(
        F.count("*").alias("n_trees"), F.count_if(positive).alias("n_positive"), (F.count_if(positive) / F.count("*")).alias("positive_fraction"),
        F.avg(score).alias("score_mean"), F.median(score).alias("score_median"), F.min(score).alias("score_min"), F.max(score).alias("score_max"),
    )


def flight_features(obs: DataFrame, flight: str, features: list[str], bad: str) -> DataFrame:
    """(flight, feature, mean, median, n): each feature over the flight's clean observations."""
    clean = obs.where(~F.coalesce(F.col(bad), F.lit(True))).select(flight, *[F.col(f).cast("double").alias(f) for f in features])
    return clean.unpivot([flight], features, "feature", "value").groupBy(flight, "feature").agg(F.avg("value").alias("mean"), F.median("value").alias("median"), F.count("value").alias("n"))


def flight_quality(obs: DataFrame, flight: str, exists: Column, bad: str, medians: list[str]) -> DataFrame:
    """Per flight the observations, the share whose patch exists, the share of bad ones, and medians of features."""
    return obs.groupBy(flight).agg(F.count("*").alias("n"), F.avg(exists.cast("double")).alias("patch_exists_rate"), F.avg(F.col(bad).cast("double")).alias("bad_rate"), *[F.median(m).alias(f"{m}_median") for m in medians])


def outlier_scores(rows: DataFrame, tree: str, scores: list[str]) -> DataFrame:
    """Per tree the median and the greatest magnitude of its robust scores over all dates and the named columns."""
    long = rows.select(tree, F.explode(F.array(*[F.abs(F.col(c).cast("double")) for c in scores])).alias("__z"))
    return long.groupBy(tree).agg(F.median("__z").alias("outlier_median"), F.max("__z").alias("outlier_max"))


def run_summary(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Count, and mean and sample deviation of each value, by method, split or whatever the keys are."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[c for v in values for c in (F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_std"))])


#: Names of scenarios with the kinds of errors that each leaves out.
SCENARIOS = {
    "all": [], "no_missing": ["missing"], "no_false_positive": ["false_positive"], "no_split": ["split"], "no_merge": ["merge"], "no_split_merge": ["split", "merge"],
    "no_poor_overlap": ["poor_overlap"], "no_boundary": ["boundary"], "detected_only": ["missing", "false_positive"],
}


def conditional_metrics(errors: DataFrame, scenarios: dict[str, list[str]] | None = None, kind: str = "kind") -> DataFrame:
    """Per scenario precision, recall and F1 without the kinds it leaves out. Splits, merges, poor and boundary
    overlaps count as detections and as truths that are not true positives; a ratio of nothing is 0."""
    counts = errors.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("n"))
    cases = F.explode(F.array(*[F.struct(F.lit(s).alias("scenario"), F.array(*[F.lit(k) for k in out]).cast("array<string>").alias("left_out")) for s, out in (scenarios or SCENARIOS).items()]))
    rows = counts.select("kind", "n", cases.alias("c")).select("c.scenario", F.when(~F.array_contains("c.left_out", F.col("kind")), F.col("n")).otherwise(0).alias("n"), "kind")
    of = lambda *kinds: F.sum(F.when(F.col("kind").isin(*kinds), F.col("n")).otherwise(0))
    n = rows.groupBy("scenario").agg(of("tp").alias("tp"), of("false_positive").alias("fp"), of("missing").alias("fn"), of("split", "merge", "poor_overlap", "boundary").alias("other"))
    share = lambda below: F.coalesce(F.col("tp") / F.nullif(below.cast("double"), F.lit(0.0)), F.lit(0.0))
    p, r = share(F.col("tp") + F.col("fp") + F.col("other")), share(F.col("tp") + F.col("fn") + F.col("other"))
    return n.select("scenario", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)).alias("f1"))


def choose_confidence(detections: DataFrame, flight: str, confidence: str, grid: list[float]) -> DataFrame:
    """Per flight the confidence whose number of detections is nearest to the median over all flights and
    confidences (as a whole number); the higher one on ties."""
    at = F.explode(F.array_compact(F.array(*[F.when(F.col(confidence) >= g, F.lit(float(g))) for g in grid])))
    grid_rows = detections.select(flight).distinct().withColumn("confidence", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    n = grid_rows.join(detections.withColumn("confidence", at).groupBy(flight, "confidence").agg(F.count("*").alias("n")), [flight, "confidence"], "left").na.fill(0, ["n"])
    target = n.agg(F.floor(F.median("n")).alias("target"))
    w = W.partitionBy(flight).orderBy(F.abs(F.col("n") - F.col("target")), F.desc("confidence"))
    return n.join(F.broadcast(target)).withColumn("__r", F.row_number().over(w)).where("__r = 1").select(flight, "confidence", "n")


def cluster_profile(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per cluster (and date) the median and quartiles of a value, and the number of rows."""
    return rows.groupBy(*keys).agg(F.median(value).alias("median"), F.percentile(value, F.lit(0.25)).alias("p25"), F.percentile(value, F.lit(0.75)).alias("p75"), F.count(value).alias("n"))


def best_by_family(rows: DataFrame, row: str, rows_in_order: list, family: str, families: list, value: str) -> DataFrame:
    """(place, row, one column for each family): the best value of each; rows stand in the given order, also those without any."""
    spark = rows.sparkSession
    order = spark.createDataFrame([(k, r) for k, r in enumerate(rows_in_order)], f"place int, {row} {rows.schema[row].dataType.simpleString()}")
    best = rows.groupBy(row).agg(*[F.max(F.when(F.col(family) == f, F.col(value))).alias(str(f)) for f in families])
    return order.join(best, row, "left").select("place", row, *[str(f) for f in families])


def top_rows(rows: DataFrame, order: str, k: int = 20, tie: list[str] = ()) -> DataFrame:
    """K4: the k rows of the greatest value; ties by the tie columns."""
    return rows.orderBy(F.desc_nulls_last(order), *tie).limit(k)


def best_variant(runs: DataFrame, weights: dict[str, float], parameters: list[str]) -> DataFrame:
    """K7: the run of the greatest weighted sum of its measures (null counts as 0), with it as `composite`; ties by the parameters."""
    score = F.lit(0.0)
    for name, w in weights.items():
        score = score + w * F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    return runs.withColumn("composite", score).orderBy(F.desc("composite"), *parameters).limit(1)
