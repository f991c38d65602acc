"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

A row's ring position and its priority are two parts of the md5 of its key. The ring has
shards x virtual_nodes points; a row belongs to the next point clockwise, and where that shard is full
it goes on clockwise to the next shard with room. Rows are taken in order of priority, so the result
does not depend on how the table lies.

That order is realised on cells: all rows between two points of the ring that share a priority step are
one cell. Their number is fixed (points x steps), one aggregation gives each cell's load, the driver
walks over the cells, and the map cell -> shard goes back as a table whose size is bounded by the
number of cells, whatever the input. No shard holds more than (1 + slack) times the mean load plus one cell.

A cell of several rows above 1/HOT of the mean load (a null or repeated key) is split: its rows get a new place from key,
size, checksum and a salt below SALTS, which is the row's number among its full repeats. So a cell holds little
more than 1/HOT of the mean or one row, and what a salt is does not depend on how the table lies.

Defined results: null text has size 1 and the checksum of the empty text; a null key is the empty key;
rows of one key share a cell, unless it is split, and are told apart by size and checksum, full repeats in any order; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from canopyflow.session import materialise, shared_dir


# A cell above 1/HOT of the mean load is split; salts of full repeats; tasks that number one row's repeats.
HOT, SALTS, DEALS = 64, 4096, 256


def ring(shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """Sorted (position, shard) of the virtual nodes; positions are 32-bit."""
    return sorted((int(hashlib.md5(f"shard-{s}/{v}".encode()).hexdigest()[:8], 16), s) for s in range(shards) for v in range(virtual_nodes))


def assign(loads: dict[tuple[int, int], int], points: list[tuple[int, int]], shards: int, slack: float) -> dict[tuple[int, int], int]:
    """Shard of each cell (step, arc). loads: load of each cell that has rows.

    Cells come in order of (step, arc). A cell goes to the first shard clockwise that stays within
    (1 + slack) times the mean load; if none does, to the one with the least load.
    """
    bound = (1 + slack) * sum(loads.values()) / shards
    used = [0] * shards
    clockwise: dict[int, list[int]] = {}
    out = {}
    for step, arc in sorted(loads):
        if arc not in clockwise:
            clockwise[arc] = list(dict.fromkeys(points[(arc + i) % len(points)][1] for i in range(len(points))))
        load = loads[step, arc]
        shard = next((s for s in clockwise[arc] if used[s] + load <= bound), None)
        if shard is None:
            shard = min(clockwise[arc], key=lambda s: used[s])
        used[shard] += load
        out[step, arc] = shard
    return out


def _arc(position: Column, points: list[tuple[int, int]]) -> Column:
    """Index of the first point at or after position, 0 past the last: a search in a literal array."""
    places = [p for p, _ in points]
    # a table of the 4096 top 12-bit prefixes narrows the search to the few points that share the prefix
    starts = [bisect.bisect_left(places, x << 20) for x in range(4097)]
    deepest = max(b - a for a, b in zip(starts, starts[1:]))
    array, begin = F.array(*[F.lit(p) for p in places]), F.get(F.array(*[F.lit(s) for s in starts]), F.shiftright(position, 20).cast("int"))
    steps = [F.when(F.get(array, begin + i) < position, 1).otherwise(0) for i in range(deepest)]
    found = begin
    for s in steps:
        found = found + s
    return F.pmod(found, F.lit(len(points)))


def _placed(rows: DataFrame, name: Column, points: list[tuple[int, int]], steps: int) -> DataFrame:
    """Rows with step and arc from the md5 of name."""
    number = lambda a, n: F.conv(F.substring("h", a, n), 16, 10).cast("long")
    rows = rows.withColumn("h", F.md5(name.cast("binary"))).withColumns({"position": number(1, 8), "step": F.pmod(number(9, 8), F.lit(steps)).cast("int")})
    return rows.withColumn("arc", _arc(F.col("position"), points).cast("int")).drop("h", "position")


def _cells(rows: DataFrame) -> list:
    """Load and number of rows of each cell: at most points x steps rows."""
    return rows.groupBy("step", "arc").agg(F.sum("size").alias("load"), F.count("*").alias("n")).collect()


def _split(rows: DataFrame, hot: DataFrame, points: list[tuple[int, int]], steps: int) -> DataFrame:
    """Rows, those of the hot cells with a new step and arc.

    Full repeats are numbered from 0: each deal by itself, beginning after the deals before it, so no task
    sorts all repeats of a row.
    """
    same = ["doc_id", "size", "text_crc32"]
    some = rows.join(hot, ["step", "arc"], "left_semi").select(*same, "deal")
    before = F.sum("n").over(W.partitionBy(*same).orderBy("deal")) - F.col("n")
    start = some.groupBy(*same, "deal").agg(F.count("*").alias("n")).select(*[F.col(c).alias(f"s_{c}") for c in [*same, "deal"]], before.alias("before"))
    k = F.row_number().over(W.partitionBy(*same, "deal").orderBy(F.lit(0)))
    alike = [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in [*same, "deal"]]
    numbered = some.withColumn("k", k - 1).join(start, alike)
    salt = F.pmod(F.col("k") + F.col("before"), F.lit(SALTS))
    name = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "text_crc32", salt)
    moved = _placed(numbered.withColumn("name", name).select(*same, "deal", "name"), F.col("name"), points, steps)
    return rows.join(hot, ["step", "arc"], "left_anti").select(*same, "step", "arc", "deal").unionByName(moved.select(*same, "step", "arc", "deal"))


def shard(docs: DataFrame, shards: int = 16, virtual_nodes: int = 32, steps: int = 64, slack: float = 0.002, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot (gapless from 0 in each shard), grown_shard (null).

    The loads are bytes. steps: priority steps; more steps make cells smaller and the driver's walk longer.
    path: where the table of keys goes; by default below the session's shared folder.
    """
    spark, path = docs.sparkSession, path or shared_dir(docs.sparkSession)
    points = ring(shards, virtual_nodes)
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"))
    rows = _placed(rows, F.coalesce(F.col("doc_id").cast("string"), F.lit("")), points, steps)
    rows = materialise(rows.withColumn("deal", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(DEALS)).cast("int")), f"{path}/keys")
    cells = _cells(rows)
    limit = sum(c["load"] for c in cells) / shards / HOT
    hot = [(c["step"], c["arc"]) for c in cells if c["n"] > 1 and c["load"] > limit]  # fewer than shards x HOT
    if hot:
        rows = materialise(_split(rows, F.broadcast(spark.createDataFrame(hot, "step int, arc int")), points, steps), f"{path}/split")
        cells = _cells(rows)
    home = assign({(c["step"], c["arc"]): c["load"] for c in cells}, points, shards, slack)
    number_of = {(c["step"], c["arc"]): c["n"] for c in cells}
    first, used = {}, [0] * shards
    for cell in sorted(home):
        first[cell] = used[home[cell]]
        used[home[cell]] += number_of[cell]
    homes = spark.createDataFrame([(s, a, home[s, a], first[s, a]) for s, a in sorted(home)], "step int, arc int, shard int, first long")
    within = F.row_number().over(W.partitionBy("step", "arc").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32")) - 1
    placed = rows.withColumn("within", within.cast("long")).join(F.broadcast(homes), ["step", "arc"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("within")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
