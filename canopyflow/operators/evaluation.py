"""Splits, label logic, metrics, tuning and model training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def seeded(key: str, seed: int) -> Column:
    """A hash to order by that any engine can give: md5 of `seed:key`."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def stratified_split(rows: DataFrame, key: str, label: str, test_share: float = 0.3, seed: int = 42) -> DataFrame:
    """M1: rows with is_test; in each class the first share by the md5 of seed:key."""
    w = W.partitionBy(label)
    rank = F.row_number().over(w.orderBy(seeded(key, seed), key))
    return rows.withColumn("is_test", rank <= F.ceil(F.count("*").over(w) * test_share))


def leave_out(rows: DataFrame, column: str, value, label: str) -> DataFrame:
    """M1: rows with a label, is_test where the column (area, species) has the value."""
    return rows.where(F.col(label) != -1).withColumn("is_test", F.coalesce(F.col(column) == value, F.lit(False)))


def folds(rows: DataFrame, key: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """M5: stratified fold numbers from 0."""
    return rows.withColumn("fold", F.pmod(F.row_number().over(W.partitionBy(label).orderBy(seeded(key, seed), key)) - 1, F.lit(k)).cast("int"))


def confusion(rows: DataFrame, truth: str, predicted: str, keys: list[str] = ()) -> DataFrame:
    """M4: (keys, truth, predicted, n)."""
    return rows.groupBy(*keys, F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def metrics(rows: DataFrame, truth: str, predicted: str, keys: list[str] = ()) -> DataFrame:
    """M4: n, accuracy, balanced_accuracy (mean recall of the classes that occur), macro_f1 (over true and predicted classes), kappa."""
    keys = list(keys)
    c = confusion(rows, truth, predicted, keys)
    t = c.groupBy(*keys, F.col("truth").alias("cls")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    p = c.groupBy(*keys, F.col("predicted").alias("cls")).agg(F.sum("n").alias("guessed"))
    both = t.join(p, [*keys, "cls"], "full").na.fill(0, ["support", "hit", "guessed"])
    total = F.sum("support")
    f1 = F.avg(2.0 * F.col("hit") / (F.col("support") + F.col("guessed")))
    chance = F.sum(F.col("support").cast("double") * F.col("guessed")) / (total * total)
    accuracy = F.sum("hit") / total
    return both.groupBy(*keys).agg(
        total.alias("n"), accuracy.alias("accuracy"), F.avg(F.when(F.col("support") > 0, F.col("hit") / F.col("support"))).alias("balanced_accuracy"), f1.alias("macro_f1"),
        ((accuracy - chance) / F.nullif(1.0 - chance, F.lit(0.0))).alias("kappa"),
    )


def tune_threshold(rows: DataFrame, score: str, truth: str, fold: str = "fold", low: float = 0.10, high: float = 0.90, step: float = 0.05) -> DataFrame:
    """M5: (threshold, balanced_accuracy): the mean over folds at every threshold, the best first; lower ones win ties."""
    n = int(round((high - low) / step)) + 1
    grid = F.explode(F.array(*[F.lit(round(low + k * step, 10)) for k in range(n)]))
    hit = rows.withColumn("threshold", grid).withColumn("__p", (F.col(score) >= F.col("threshold")).cast("int"))
    share = lambda c: F.count_if((F.col(truth) == c) & (F.col("__p") == c)) / F.nullif(F.count_if(F.col(truth) == c).cast("double"), F.lit(0.0))
    each = hit.groupBy("threshold", fold).agg(((share(1) + share(0)) / 2.0).alias("__b"))
    return each.groupBy("threshold").agg(F.avg("__b").alias("balanced_accuracy")).orderBy(F.desc("balanced_accuracy"), "threshold")


def priority_label(sources: dict[str, Column], missing: int = -1) -> dict[str, Column]:
    """Label, source of the first source that has one, and whether sources disagree."""
    known = {k: F.nullif(c.cast("int"), F.lit(missing)) for k, c in sources.items()}
    which = F.when(F.lit(False), F.lit(None).cast("string"))
    for k, c in known.items():
        which = which.when(c.isNotNull(), k)
    return {"label": F.coalesce(*known.values(), F.lit(missing)), "label_source": which, "conflict": F.size(F.array_distinct(F.array_compact(F.array(*known.values())))) > 1}


def label_join(rows: DataFrame, labels: DataFrame, key: str, columns: list[str], missing: int = -1) -> DataFrame:
    """Left join of label columns, missing ones as -1."""
    own = labels.select(key, *[F.col(c).cast("int").alias(c) for c in columns])
    return rows.join(own, key, "left").withColumns({c: F.coalesce(F.col(c), F.lit(missing)) for c in columns})


def relabel(rows: DataFrame, labels: DataFrame, key: str, columns: list[str], missing: int = -1) -> tuple[DataFrame, DataFrame]:
    """Rows with label columns overwritten, and one row with the number of changed cells of each."""
    old = rows.withColumnsRenamed({c: f"__old_{c}" for c in columns})
    new = label_join(old, labels, key, columns, missing)
    changed = new.agg(*[F.count_if(~F.col(c).eqNullSafe(F.col(f"__old_{c}"))).alias(c) for c in columns])
    return new.drop(*[f"__old_{c}" for c in columns]), changed


def agreement(rows: DataFrame, pairs: list[tuple[str, str]], missing: int = -1) -> DataFrame:
    """(a, b, n_comparable, n_agree, agreement) of pairs of label columns; one pass."""
    both = lambda a, b: (F.col(a) != missing) & (F.col(b) != missing)
    made = rows.agg(*[F.struct(F.count_if(both(a, b)).alias("n"), F.count_if(both(a, b) & (F.col(a) == F.col(b))).alias("k")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    items = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}.n").alias("n_comparable"), F.col(f"p{i}.k").alias("n_agree")) for i, (a, b) in enumerate(pairs)]))
    return made.select(items.alias("x")).select("x.*").withColumn("agreement", F.col("n_agree") / F.nullif(F.col("n_comparable").cast("double"), F.lit(0.0)))


def fuse(base: DataFrame, tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Inner joins of feature tables on a key; a table's columns get its prefix."""
    out = base
    for prefix, t in tables.items():
        out = out.join(t.select(key, *[F.col(c).alias(f"{prefix}{c}") for c in t.columns if c != key]), key)
    return out


def large_crowns(rows: DataFrame, areas: DataFrame, key: str, least: float, area: str = "area_m2") -> DataFrame:
    """Rows with their area from another table (0 where it has none) that is at least `least`."""
    return rows.join(areas.select(key, area), key, "left").withColumn(area, F.coalesce(area, F.lit(0.0))).where(F.col(area) >= least)


def members(rows: DataFrame, others: DataFrame, keys: list[str], inside: bool = True) -> DataFrame:
    """Rows whose key the other table has, or (inside=False) has not."""
    return rows.join(others.select(*keys).distinct(), list(keys), "left_semi" if inside else "left_anti")


def alignment_check(left: DataFrame, right: DataFrame, key: str, a: str, b: str, offsets: list[int]) -> DataFrame:
    """(offset, n_matched, n_agree): rows of left whose key, moved by the offset, right has, and how many of their labels agree."""
    moved = left.withColumn("offset", F.explode(F.array(*[F.lit(o) for o in offsets]))).select("offset", (F.col(key) + F.col("offset")).alias("__k"), F.col(a).alias("__a"))
    return moved.join(right.select(F.col(key).alias("__k"), F.col(b).alias("__b")), "__k").groupBy("offset").agg(F.count("*").alias("n_matched"), F.count_if(F.col("__a") == F.col("__b")).alias("n_agree"))


def mixed_areas(rows: DataFrame, area: str, label: str) -> DataFrame:
    """Rows of areas that have both classes."""
    both = rows.where(F.col(label) != -1).groupBy(area).agg(F.count_distinct(label).alias("__k")).where("__k >= 2").select(area)
    return rows.join(both, area, "left_semi")


def quality_subset(rows: DataFrame, area_m2: str, drop_share: float) -> DataFrame:
    """Rows above the area's drop_share quantile."""
    cut = rows.agg(F.percentile(area_m2, F.lit(drop_share)).alias("__cut"))
    return rows.join(F.broadcast(cut)).where(F.col(area_m2) > F.col("__cut")).drop("__cut")


def random_forest(train: DataFrame, features: list[str], label: str, trees: int = 500, leaf: int = 2, depth: int = 12, seed: int = 42):
    """Median imputation, class-balanced weights and a random forest, as one fitted pipeline.

    Its transform() adds prediction and probability.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import Imputer, VectorAssembler

    n = train.groupBy(label).agg(F.count("*").alias("__n"))
    total, kinds = train.count(), n.count()
    weighted = train.join(F.broadcast(n), label).withColumn("__w", total / (F.lit(float(kinds)) * F.col("__n")))
    filled = [f"__i_{f}" for f in features]
    stages = [Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="__x"), RandomForestClassifier(featuresCol="__x", labelCol=label, weightCol="__w", numTrees=trees, minInstancesPerNode=leaf, maxDepth=depth, seed=seed)]
    return Pipeline(stages=stages).fit(weighted)


def self_training(train: DataFrame, unlabelled: DataFrame, features: list[str], label: str, least: float = 0.85, rounds: int = 3, **forest):
    """M9: refit with unlabelled rows whose class probability is at least `least`; the last fitted pipeline."""
    from pyspark.ml.functions import vector_to_array

    model = random_forest(train, features, label, **forest)
    for _ in range(rounds):
        sure = model.transform(unlabelled).withColumn("__c", F.array_max(vector_to_array("probability"))).where(F.col("__c") >= least)
        more = sure.select(*features, F.col("prediction").cast("double").alias(label))
        model = random_forest(train.select(*features, F.col(label).cast("double").alias(label)).unionByName(more), features, label, **forest)
    return model
