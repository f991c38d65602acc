"""Queries over the tracking graph as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyflow.operators import graph_metrics as K
from canopyflow.plans.catalog import register
from canopyflow.plans.geometry_queries import E_SQL, nodes, plain_edges

WAYS_SQL = f"""{E_SQL}, u AS (SELECT prev AS a, curr AS b FROM e UNION SELECT curr, prev FROM e),
far(src, node, dist) USING KEY (src, node) AS (SELECT DISTINCT a, a, 0 FROM u
  UNION SELECT far.src, u.b, min(far.dist) + 1 FROM far JOIN u ON u.a = far.node LEFT JOIN recurring.far AS r ON r.src = far.src AND r.node = u.b WHERE r.src IS NULL GROUP BY 1, 2),
wide AS (SELECT component, count(*) AS size, max(most)::BIGINT AS diameter FROM (SELECT src, min(node) AS component, max(dist) AS most FROM far GROUP BY 1) GROUP BY 1)"""
#: The edges, and those back again whose ends' sum is a multiple of three: circles of flights there and back.
ROUND_SQL = f"""{E_SQL}, w AS (SELECT prev AS a, curr AS b FROM e UNION SELECT curr, prev FROM e WHERE (prev + curr) % 3 = 0),
ends AS (SELECT a AS node FROM w UNION SELECT b FROM w), reach(src, node) AS (SELECT node, node FROM ends UNION SELECT reach.src, w.b FROM reach JOIN w ON w.a = reach.node),
firm AS (SELECT x.src AS node, min(x.node) AS component FROM reach x JOIN reach y ON y.src = x.node AND y.node = x.src GROUP BY 1)"""


def ways(spark: SparkSession, sf: str) -> DataFrame:
    return plain_edges(spark, sf).select(F.col("prev.crown_idx").alias("a"), F.col("curr.crown_idx").alias("b"))


@register("x15_diameters", f"WITH RECURSIVE {WAYS_SQL} SELECT component, size, diameter FROM wide")
def x15_diameters(spark: SparkSession, sf: str) -> DataFrame:
    return K.diameters(ways(spark, sf))


@register("x15_strong_components", f"WITH RECURSIVE {ROUND_SQL} SELECT node, component FROM firm")
def x15_strong(spark: SparkSession, sf: str) -> DataFrame:
    w = ways(spark, sf)
    return K.strong_components(w.unionByName(w.where((F.col("a") + F.col("b")) % 3 == 0).select(F.col("b").alias("a"), F.col("a").alias("b"))))


@register("x15_graph_summary", f"""WITH RECURSIVE {WAYS_SQL}, alone AS (SELECT count(*) AS n FROM boxes WHERE crown_idx NOT IN (SELECT a FROM u)), every AS (SELECT diameter FROM wide UNION ALL SELECT 0 FROM boxes WHERE crown_idx NOT IN (SELECT a FROM u))
SELECT (SELECT count(*) FROM boxes) AS num_nodes, (SELECT count(*) FROM e) AS num_edges, (SELECT count(*) FROM boxes WHERE crown_idx NOT IN (SELECT prev FROM e)) AS zero_out_degree, (SELECT count(*) FROM boxes WHERE crown_idx NOT IN (SELECT curr FROM e)) AS zero_in_degree,
  (SELECT count(*) FROM every) AS weak_components, coalesce((SELECT max(size) FROM wide), 1) AS largest_weak, max(diameter) AS max_diameter, round(avg(diameter), 9) AS average_diameter, median(diameter) AS median_diameter FROM every""")
def x15_summary(spark: SparkSession, sf: str) -> DataFrame:
    n = nodes(spark, sf).select(F.col("node.crown_idx").alias("node"))
    s = K.graph_summary(n, ways(spark, sf))
    return s.select("num_nodes", "num_edges", "zero_out_degree", "zero_in_degree", "weak_components", "largest_weak", "max_diameter", F.round("average_diameter", 9).alias("average_diameter"), "median_diameter")
