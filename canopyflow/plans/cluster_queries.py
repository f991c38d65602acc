"""Queries over series of trees: warping distances and clusters (W23, X22). A tree is a supplier, its series the mean quantities of twelve months,
four kinds of trees far apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyflow.operators import clustering as C
from canopyflow.plans.catalog import register
from canopyflow.session import table

_MONTHS = ", ".join(f"coalesce(avg(CASE WHEN month(l_shipdate) = {m} THEN l_quantity END), 0) + 1000 * (l_suppkey % 4)" for m in range(1, 13))
MONTHS_SQL = f"s AS (SELECT l_suppkey AS tree, [{_MONTHS}] AS v FROM lineitem GROUP BY l_suppkey)"


def months(spark: SparkSession, sf: str) -> DataFrame:
    """tree, v: an array of twelve values."""
    rows = table(spark, sf, "lineitem")
    value = lambda m: F.coalesce(F.avg(F.when(F.month("l_shipdate") == m, F.col("l_quantity"))), F.lit(0.0)) + 1000 * (F.col("l_suppkey") % 4)
    return rows.groupBy("l_suppkey").agg(F.array(*[value(m).cast("double") for m in range(1, 13)]).alias("v")).withColumnRenamed("l_suppkey", "tree")


@register("w23_near_series", f"WITH {MONTHS_SQL}, p AS (SELECT x.tree, y.tree AS tree_b, sqrt(list_sum([(x.v[i] - y.v[i]) ** 2 FOR i IN range(1, 13)])) AS d FROM s x JOIN s y ON x.tree < y.tree)"
          " SELECT tree, tree_b, round(d, 6) AS distance FROM p WHERE d <= 500")  # fmt: skip
def w23_near(spark: SparkSession, sf: str) -> DataFrame:
    """Without a window the warping distance is the Euclidean one, which SQL can say."""
    found = C.dtw_pairs(months(spark, sf), "tree", ["v"], window=0, most=500.0)
    return found.select("tree", "tree_b", F.round("distance", 6).alias("distance"))


@register("x22_clusters", "WITH f AS (SELECT tree, min(tree) OVER (PARTITION BY tree % 4) AS least FROM (SELECT DISTINCT l_suppkey AS tree FROM lineitem)) SELECT tree, CAST(dense_rank() OVER (ORDER BY least) AS INTEGER) AS cluster FROM f")
def x22_clusters(spark: SparkSession, sf: str) -> DataFrame:
    series = months(spark, sf)
    return C.cut(C.agglomerate(C.dtw_pairs(series, "tree", ["v"]), "tree", "tree_b"), series, "tree", 4)
