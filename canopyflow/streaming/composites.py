"""An extension: running composites over a stream of observations. The batch operators are in operators/."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(stream: DataFrame, key: str, time: str, value: str, width: str = "16 days", late: str = "32 days") -> DataFrame:
    """(key, start, n, mean, least, greatest) per tumbling window; rows later than `late` behind the newest are left out."""
    rows = stream.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    made = rows.groupBy(F.window("__t", width).alias("w"), key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("greatest"))
    return made.select(key, F.col("w.start").alias("start"), "n", "mean", "least", "greatest")
