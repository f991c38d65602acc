"""Scans and sinks (A1-A29): discovery, pairing, layers, scene catalogues, GeoJSON and COCO, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from canopyflow.functions import geometry as G
from canopyflow.functions import names as N

CROWN_SCHEMA = f"om_id int, crown_idx long, threshold double, confidence double, orthomosaic string, is_augmented boolean, ring {G.RING}"


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name, stem, bytes, modified) of the files below a folder of any store that Spark reads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.regexp_replace(name, r"(?<=.)\.[^.]*$", "").alias("stem"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def discover(stems: DataFrame, exclude: list[str] = ()) -> DataFrame:
    """A1: (om_id, stem): one stem for each canonical name (a `dateNotConfirmed` one is preferred), without the excluded, in flight order from 1."""
    rows = stems.where(~F.col("stem").isin(list(exclude))) if exclude else stems
    w = W.partitionBy(N.canonical_stem(F.col("stem"))).orderBy(F.when(F.col("stem").contains(N.PLACEHOLDERS[0]), 0).otherwise(1), "stem")
    one = rows.withColumn("__r", F.row_number().over(w)).where("__r = 1")
    return one.select(F.row_number().over(W.orderBy(N.stem_sort_key(F.col("stem")))).alias("om_id"), "stem")  # a row for each flight


def pair_files(crowns: DataFrame, orthos: DataFrame) -> DataFrame:
    """A2: crown files with the orthomosaic of the same first integer; without one the orthomosaic is null. (stem) each."""
    n = lambda d: d.select(N.first_integer(F.col("stem")).alias("n"), F.col("stem"))
    first = n(orthos).groupBy("n").agg(F.min("stem").alias("ortho"))
    return n(crowns).join(first, "n", "left").select("n", F.col("stem").alias("crowns"), "ortho")


def threshold_layers(layers: DataFrame, expected: list[float]) -> DataFrame:
    """A4: (threshold) that a store has and the run expects, ascending. layers: (tag)."""
    own = layers.select(N.tag_threshold(F.col("tag")).alias("threshold")).where("threshold is not null").distinct()
    return own.where(F.round("threshold", 6).isin([round(t, 6) for t in expected])).orderBy("threshold")


def validate_store(layers: DataFrame, expected: list[float]) -> DataFrame:
    """One row: missing thresholds, and ok."""
    have = layers.agg(F.collect_set(F.round(N.tag_threshold(F.col("tag")), 6)).alias("have"))
    missing = F.array_sort(F.array_except(F.array(*[F.lit(round(t, 6)) for t in expected]), F.col("have")))
    return have.select(missing.alias("missing"), (F.size(missing) == 0).alias("ok"))


def read_crowns(spark: SparkSession, path: str) -> DataFrame:
    """A5: the crown table with the reference columns; null confidence is 1, null threshold 0, null augmentation false."""
    rows = spark.read.schema(CROWN_SCHEMA).parquet(path)
    return rows.withColumns({"confidence": F.coalesce("confidence", F.lit(1.0)), "threshold": F.coalesce("threshold", F.lit(0.0)), "is_augmented": F.coalesce("is_augmented", F.lit(False))})


def multithreshold(crowns: DataFrame, base: float) -> DataFrame:
    """Of the first flight the base layer, of the others all layers, without repeated geometries (the highest threshold stays)."""
    first = crowns.agg(F.min("om_id").alias("__first"))
    rows = crowns.join(F.broadcast(first)).where((F.col("om_id") > F.col("__first")) | (F.abs(F.col("threshold") - base) < 1e-9)).drop("__first")
    w = W.partitionBy("om_id", "__k").orderBy(F.desc("threshold"), "crown_idx")
    return rows.withColumn("__k", G.geometry_key(F.col("ring"))).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__k", "__r")


def single_threshold(crowns: DataFrame, layer: float) -> DataFrame:
    """The crowns of one layer of every flight."""
    return crowns.where(F.abs(F.col("threshold") - layer) < 1e-9)


def pair_layers(layers: DataFrame, orthos: DataFrame, expected: list[float]) -> DataFrame:
    """A3: (n, crowns, ortho, thresholds): stores with their expected layers, ascending, and the orthomosaic of the same first integer.

    layers: (stem, tag). A store without any expected layer is left out.
    """
    known = layers.select("stem", N.tag_threshold(F.col("tag")).alias("t")).where(F.round("t", 6).isin([round(t, 6) for t in expected]))
    own = known.groupBy("stem").agg(F.array_sort(F.collect_set("t")).alias("thresholds"))
    return pair_files(own.select("stem"), orthos).join(own.withColumnRenamed("stem", "crowns"), "crowns").select("n", "crowns", "ortho", "thresholds")


def threshold_cache(crowns: DataFrame, base: float, least: float = 0.0) -> DataFrame:
    """The layers from `least` up to below the base, for gap filling."""
    return crowns.where((F.col("threshold") < base - 1e-9) & (F.col("threshold") >= least))


def downsample(pixels: DataFrame, keys: list[str], factor: int, bands: list[str]) -> DataFrame:
    """Means of factor x factor pixels."""
    return pixels.groupBy(*keys, F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col")).agg(*[F.avg(b).alias(b) for b in bands])


def clip_pixels(pixels: DataFrame, crowns: DataFrame, x: Column, y: Column, cell: float = 16.0) -> DataFrame:
    """Pixels whose centre lies in a crown's ring, with the crown's columns.

    crowns: ring and keys. Both sides go to grid cells; a crown is copied to the cells that its bounds touch. Bounds are compared in the
    join, rings only of crowns that are no boxes. The copied side is not broadcast, as Spark's estimate does not know of the copies.
    """
    ends = ("minx", "miny", "maxx", "maxy")
    at = lambda v: F.floor(v / cell).cast("int")
    bounded = crowns.withColumns({"__b": G.bounds(F.col("ring")), "__box": G.is_box(F.col("ring"))}).withColumns({f"__{k}": F.col("__b")[k] for k in ends}).drop("__b")
    spread = bounded.withColumn("__gx", F.explode(F.sequence(at(F.col("__minx")), at(F.col("__maxx"))))).withColumn("__gy", F.explode(F.sequence(at(F.col("__miny")), at(F.col("__maxy")))))
    placed = pixels.withColumns({"__x": x, "__y": y}).withColumns({"__gx": at(F.col("__x")), "__gy": at(F.col("__y"))})
    met = lambda some: placed.join(spread.where(some).hint("merge"), ["__gx", "__gy"])
    boxes = met("__box").where("__x >= __minx and __x < __maxx and __y >= __miny and __y < __maxy")  # as casting a ray says
    rings = met("not __box").where("__x >= __minx and __x <= __maxx and __y >= __miny and __y <= __maxy").where(G.contains_point(F.col("ring"), F.col("__x"), F.col("__y")))
    return boxes.unionByName(rings).drop("__gx", "__gy", "__x", "__y", "__box", *[f"__{k}" for k in ends])


def best_scenes(scenes: DataFrame, season: str = "season", max_cloud: float = 70.0, limit: int = 12) -> DataFrame:
    """Per season the `limit` least cloudy scenes under the bound, by cloud, time, id."""
    w = W.partitionBy(season).orderBy("cloud_cover", "datetime", "id")
    return scenes.where(F.col("cloud_cover") < max_cloud).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= limit).drop("__r")


def one_per_date(scenes: DataFrame, keys: list[str] = (), order: list[str] = ("cloud_cover", "id")) -> DataFrame:
    """The first scene of each date."""
    w = W.partitionBy(*keys, F.to_date("datetime")).orderBy(*order)
    return scenes.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def dominant_orbit(scenes: DataFrame, orbit: str = "relative_orbit") -> DataFrame:
    """Scenes of the orbit that has most; the least orbit on ties."""
    top = scenes.groupBy(orbit).agg(F.count("*").alias("__n")).orderBy(F.desc("__n"), orbit).limit(1)
    return scenes.join(F.broadcast(top.select(orbit)), orbit, "left_semi")


def drop_empty(rows: DataFrame, bands: list[str]) -> DataFrame:
    """Without rows whose bands are all null."""
    return rows.dropna(how="all", subset=bands)


def read_features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of a GeoJSON collection: its properties by DDL schema, the outer ring, source_file and source_index."""
    shape = f"features array<struct<properties:struct<{properties}>,geometry:struct<type:string,coordinates:array<array<array<double>>>>>>"
    rows = spark.read.schema(shape).option("multiLine", "true").json(path)
    one = rows.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_file"), F.posexplode("features").alias("source_index", "f"))
    ring = F.transform(F.get(F.col("f.geometry.coordinates"), 0), lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y")))
    return one.select("source_file", "source_index", "f.properties.*", ring.alias("ring"))


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def read_coco(spark: SparkSession, path: str) -> DataFrame:
    """(gt_id, ring, pixel_space): first segment of every annotation; pixel space if no coordinate is negative and none exceeds 100000."""
    shape = "annotations array<struct<id:long,segmentation:array<array<double>>>>"
    rows = spark.read.schema(shape).option("multiLine", "true").json(path).select(F.explode("annotations").alias("a"))
    flat = F.get(F.col("a.segmentation"), 0)
    ring = F.transform(F.sequence(F.lit(0), (F.size(flat) / 2).cast("int") - 1), lambda i: F.struct(F.get(flat, 2 * i).alias("x"), F.get(flat, 2 * i + 1).alias("y")))
    return rows.where(F.size(flat) >= 6).select(F.col("a.id").alias("gt_id"), ring.alias("ring"), ((F.array_min(flat) >= -5.0) & (F.array_max(flat) <= 100000.0)).alias("pixel_space"))


def feature_json(rows: DataFrame, properties: list[str], ring: str = "ring", keep: list[str] = ()) -> DataFrame:
    """One GeoJSON feature a row, as text, beside the columns to keep."""
    closed = F.concat(F.col(ring), F.slice(F.col(ring), 1, 1))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(closed, lambda p: F.array(p["x"], p["y"]))).alias("coordinates"))
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))).alias("feature"), *keep)


def write_documents(documents: DataFrame, path: str, key: list[str]) -> None:
    """Whole documents (value), one row a key, as files of one document each: a reader of whole files takes the first document of a file only."""
    documents.write.mode("overwrite").partitionBy(*key).text(path)


def master_documents(crowns: DataFrame, observations: DataFrame, scores: DataFrame, key: str = "chain_id") -> DataFrame:
    """One nested document a crown: ids, classification, and its observations in order, as JSON."""
    joined = crowns.join(scores, key, "left").join(observations, key, "left")
    ids, kind = F.struct(F.col(key)), F.struct(*[c for c in scores.columns if c != key])
    return joined.select(key, F.to_json(F.struct(ids.alias("ids"), kind.alias("classification"), F.col("observations"))).alias("document"))


def write_report(rows: DataFrame, path: str, kind: str = "json") -> None:
    """A result as JSON, CSV or Parquet at a URI."""
    writer = rows.write.mode("overwrite")
    writer.option("header", "true").csv(path) if kind == "csv" else getattr(writer, kind)(path)


def inventory(crowns: DataFrame) -> DataFrame:
    """Detections of each flight and layer, with mean confidence and area."""
    return crowns.groupBy("om_id", "threshold").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.sum(G.area(F.col("ring"))).alias("area"))
