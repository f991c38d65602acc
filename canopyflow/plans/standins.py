"""Deterministic stand-ins for crown tables, made of the provided tables; each has the same rows as SQL.

OBS: tree = user, six dates a month, signals from `value`. BOXES: axis-aligned crowns from parts.
SEASONAL: supplier x year x season x band from line items. SCENES: a scene catalogue from orders.
PIXELS: small patches from line items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyflow.session import table

DATES = [1, 2, 3, 4, 5, 6]

OBS_SQL = """obs AS (
  SELECT user_id AS chain_id, CAST(least((day(ts) - 1) // 5 + 1, 6) AS INTEGER) AS om_id,
    avg(CASE WHEN event_type <> 'error' THEN value END) / 500.0 AS veg_fraction_hsv,
    median(value) / 500.0 AS gcc_mean, max(value) AS laplacian_var,
    count(*) AS n, (count(*) < 2 OR sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) * 2 > count(*)) AS is_bad_observation
  FROM events GROUP BY 1, 2)"""


def obs(spark: SparkSession, sf: str) -> DataFrame:
    """OBS: chain_id, om_id, veg_fraction_hsv, gcc_mean, laplacian_var, n, is_bad_observation."""
    e = table(spark, sf, "events")
    om = F.least(F.floor((F.dayofmonth("ts") - 1) / 5) + 1, F.lit(6)).cast("int")
    error = F.count_if(F.col("event_type") == "error")
    return e.groupBy(F.col("user_id").alias("chain_id"), om.alias("om_id")).agg(
        (F.avg(F.when(F.col("event_type") != "error", F.col("value"))) / 500.0).alias("veg_fraction_hsv"), (F.median("value") / 500.0).alias("gcc_mean"), F.max("value").alias("laplacian_var"),
        F.count("*").alias("n"), ((F.count("*") < 2) | (error * 2 > F.count("*"))).alias("is_bad_observation"),
    )


BOXES_SQL = """boxes AS (
  SELECT CAST(p_partkey % 5 + 1 AS INTEGER) AS om_id, p_partkey AS crown_idx,
    (p_partkey * 37 % 1000) * 1.0 AS minx, (p_partkey * 91 % 1009) * 1.0 AS miny,
    (p_partkey * 37 % 1000) + 6.0 + p_size AS maxx, (p_partkey * 91 % 1009) + 5.0 + (p_size * 7 % 50) AS maxy,
    p_size AS size, p_brand AS brand
  FROM part)"""


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """BOXES: om_id, crown_idx, bounds, size, brand."""
    p = table(spark, sf, "part")
    k, s = F.col("p_partkey"), F.col("p_size")
    x, y = (k * 37 % 1000).cast("double"), (k * 91 % 1009).cast("double")
    return p.select((k % 5 + 1).cast("int").alias("om_id"), k.alias("crown_idx"), x.alias("minx"), y.alias("miny"), (x + 6.0 + s).alias("maxx"), (y + 5.0 + s * 7 % 50).alias("maxy"), s.alias("size"), F.col("p_brand").alias("brand"))


def rings(boxes_: DataFrame, angle: float = 0.0) -> DataFrame:
    """BOXES with ring, turned around the origin by an angle: areas and overlaps do not change."""
    import math

    from canopyflow.functions.geometry import affine

    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(corner("minx", "miny"), corner("maxx", "miny"), corner("maxx", "maxy"), corner("minx", "maxy"))
    c, s = math.cos(angle), math.sin(angle)
    return boxes_.withColumn("ring", affine(ring, c, -s, 0, s, c, 0) if angle else ring)


SEASON_CASE = "CASE WHEN month(l_shipdate) IN (12, 1, 2) THEN 'winter' WHEN month(l_shipdate) IN (3, 4, 5) THEN 'premonsoon' WHEN month(l_shipdate) IN (6, 7, 8, 9) THEN 'monsoon' ELSE 'postmonsoon' END"
SEASONAL_SQL = f"""seasonal AS (
  SELECT l_suppkey AS crown_uid, CAST(year(l_shipdate) AS INTEGER) AS year, {SEASON_CASE} AS season, 'qty' AS band, median(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3
  UNION ALL
  SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER), {SEASON_CASE}, 'disc', median(l_discount) FROM lineitem GROUP BY 1, 2, 3)"""


def seasonal(spark: SparkSession, sf: str) -> DataFrame:
    """SEASONAL: crown_uid, year, season, band, value."""
    from canopyflow.functions.spectral import season

    rows = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("crown_uid"), F.year("l_shipdate").alias("year"), season(F.month("l_shipdate")).alias("season")).agg(F.median("l_quantity").alias("qty"), F.median("l_discount").alias("disc"))
    return rows.unpivot(["crown_uid", "year", "season"], ["qty", "disc"], "band", "value")


SCENES_SQL = """scenes AS (
  SELECT o_orderkey AS id, o_orderdate AS datetime, o_totalprice % 100 AS cloud_cover, o_orderpriority AS season, o_custkey % 3 AS relative_orbit, o_orderstatus AS platform FROM orders)"""


def scenes(spark: SparkSession, sf: str) -> DataFrame:
    """SCENES: id, datetime, cloud_cover, season, relative_orbit, platform."""
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("datetime"), (F.col("o_totalprice") % 100).alias("cloud_cover"), F.col("o_orderpriority").alias("season"), (F.col("o_custkey") % 3).alias("relative_orbit"), F.col("o_orderstatus").alias("platform"))


PIXELS_SQL = """pixels AS (
  SELECT l_suppkey * 100000 + k // 64 AS chain_id, 1 AS om_id, CAST(k % 64 // 8 AS INTEGER) AS row, CAST(k % 8 AS INTEGER) AS col, r, g, b FROM (
    SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS k,
      CAST(l_quantity * 37 % 256 AS INTEGER) AS r, CAST(l_partkey * 13 % 256 AS INTEGER) AS g, CAST(l_orderkey * 7 % 256 AS INTEGER) AS b FROM lineitem))"""


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """PIXELS: chain_id, om_id, row, col, r, g, b: every line item in an 8 x 8 patch; chain_id numbers a supplier's patches (the last may be part filled)."""
    from pyspark.sql import Window as W

    k = F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")) - 1
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_quantity", "l_partkey", "l_orderkey", k.cast("long").alias("k"))
    byte = lambda c, f: (F.col(c) * f % 256).cast("int")
    return rows.select((F.col("l_suppkey") * 100000 + F.floor(F.col("k") / 64)).alias("chain_id"), F.lit(1).alias("om_id"), F.floor(F.col("k") % 64 / 8).cast("int").alias("row"), (F.col("k") % 8).cast("int").alias("col"), byte("l_quantity", 37).alias("r"), byte("l_partkey", 13).alias("g"), byte("l_orderkey", 7).alias("b"))
