"""Warping distances of all pairs of series and their hierarchical clustering, as joins and aggregations."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from canopyflow.operators.components import components
from canopyflow.operators.sequences import linkage
from canopyflow.session import materialise, shared_dir

#: Clusters up to which the rest of a clustering is done in one group.
SMALL = 512


def dtw_batch(a: np.ndarray, b: np.ndarray, window: int = 2) -> np.ndarray:
    """The warping distances of the rows of a (pairs x n) from those of b (pairs x m), all pairs at once."""
    n, m = a.shape[1], b.shape[1]
    w = max(window, abs(n - m))
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    last, row = np.full((m + 1, a.shape[1]), np.inf), np.full((m + 1, a.shape[1]), np.inf)
    last[0] = 0.0
    for i in range(1, n + 1):
        lo, hi = max(1, i - w), min(m, i + w)
        row[lo - 1] = np.inf
        for j in range(lo, hi + 1):
            step = a[i - 1] - b[j - 1]
            row[j] = step * step + np.minimum(np.minimum(last[j], row[j - 1]), last[j - 1])
        row[hi + 1 : hi + 2] = np.inf
        last, row = row, last
    return np.sqrt(last[m])


def _outside(v: np.ndarray, u: np.ndarray, window: int) -> np.ndarray:
    """How far rows of v lie outside the envelopes of rows of u of their length: never more than their warping distances."""
    total = np.zeros(len(v))
    for i in range(v.shape[1]):
        near = u[:, max(0, i - window) : i + window + 1]
        low, high = near.min(1), near.max(1)
        over = np.maximum(np.maximum(v[:, i] - high, low - v[:, i]), 0)
        total += over * over
    return np.sqrt(total)


def _alike(rows: pa.Table, arrays: int) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """Rows whose arrays have the same lengths: their numbers, and a matrix of each array."""
    lists = [rows.column(f"__v{i}").combine_chunks() for i in range(arrays)]
    sizes = np.stack([pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in lists], 1)
    out = []
    for size in np.unique(sizes, axis=0):
        at = np.flatnonzero((sizes == size).all(1))
        out.append((at, [x.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), n) for x, n in zip(lists, size)]))
    return out


def dtw_pairs(series: DataFrame, key: str, arrays: list[str], window: int = 2, most: float | None = None, block: int = 1024) -> DataFrame:
    """(key, key_b, distance) of every pair of series, key < key_b; the distance is the mean over the metrics.

    series: one row a tree with an array for each metric. most: pairs farther apart are left out; those whose ends or envelopes
    show it never run the dynamic programme. Pairs meet by blocks of about `block` series, so a task holds two blocks
    and their pairs at a time, and a series is copied once for each block. Series with a null key, or with a null or empty array, or one that
    holds null or NaN, take no part; keys are taken to be unique.
    """
    sound = F.col(key).isNotNull()
    for c in arrays:
        sound &= F.coalesce((F.size(c) > 0) & F.forall(F.col(c).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))
    rows = series.where(sound).select(F.col(key).alias("__k"), *[F.col(c).cast("array<double>").alias(f"__v{i}") for i, c in enumerate(arrays)])
    rows = materialise(rows, f"{shared_dir(series.sparkSession)}/series")
    n = max(1, -(-rows.count() // block))
    rows = rows.withColumn("__g", F.pmod(F.xxhash64("__k"), F.lit(n)).cast("int"))
    left = rows.withColumn("__h", F.explode(F.sequence(F.col("__g"), F.lit(n - 1))))
    right = rows.withColumnsRenamed({c: c + "b" for c in rows.columns}).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__gb"))))
    kind, count = dict(rows.dtypes)["__k"], len(arrays)

    def meet(p: pa.Table, q: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(p) and len(q):
            same = p.column("__g")[0].as_py() == p.column("__h")[0].as_py()
            q = p if same else q.rename_columns([c.removesuffix("b") for c in q.column_names])
            for ii, v in _alike(p, count):
                for jj, u in _alike(q, count):
                    open_ = ii[:, None] < jj if same else np.ones((len(ii), len(jj)), bool)
                    if most is not None:  # both ends of two series meet, whatever the warping
                        open_ &= sum(np.maximum(np.abs(x[:, :1] - y[:, 0]), np.abs(x[:, -1:] - y[:, -1])) for x, y in zip(v, u)) * (1 - 1e-12) <= most * count
                    a, b = np.nonzero(open_)
                    for lo in range(0, len(a), 16_384):
                        i, j = a[lo : lo + 16_384], b[lo : lo + 16_384]
                        if most is not None and window and all(x.shape[1] == y.shape[1] for x, y in zip(v, u)):
                            apart = sum(np.maximum(_outside(x[i], y[j], window), _outside(y[j], x[i], window)) for x, y in zip(v, u))
                            near = apart * (1 - 1e-12) <= most * count
                            i, j = i[near], j[near]
                        d = sum(dtw_batch(x[i], y[j], window) for x, y in zip(v, u)) / count
                        near = slice(None) if most is None else d <= most
                        found.append((ii[i[near]], jj[j[near]], d[near]))
        i, j, d = (np.concatenate(x) for x in zip(*found))
        other = q.column("__k" if "__k" in q.column_names else "__kb")
        return pa.table({"a": p.column("__k").combine_chunks().take(pa.array(i)), "b": other.combine_chunks().take(pa.array(j)), "distance": d})

    met = left.groupBy("__g", "__h").cogroup(right.groupBy("__other", "__gb")).applyInArrow(meet, f"a {kind}, b {kind}, distance double")
    return met.select(F.least("a", "b").alias(key), F.greatest("a", "b").alias(f"{key}_b"), "distance")


def agglomerate(pairs: DataFrame, a: str = "a", b: str = "b", distance: str = "distance", method: str = "ward", small: int = SMALL, path: str | None = None) -> DataFrame:
    """(left, right, height, size, round): the merges of an agglomerative clustering, "ward" or "average".

    pairs: the distance of every pair of rows. A cluster goes by its least member, so `right` names each merge. In a round all
    pairs of clusters that are nearest to each other merge at once, which both methods allow: no later merge can come
    between them. A new distance is a weighted sum over the old ones (for Ward of squared distances between centres, less the
    spread within), so a round is one aggregation; when at most `small` clusters are left, one bounded group ends it.
    Ties go to the pair of lesser names. Rows with a null end or distance and pairs of a row with itself are ignored; of a repeated
    pair the least distance counts; a pair that is missing is an error. No pairs give no merges. Intermediate tables go below the shared folder.
    """
    if method not in ("ward", "average"):
        raise ValueError(f"no such method: {method}")
    ward, path = method == "ward", path or shared_dir(pairs.sparkSession)
    x, one = F.col(distance).cast("double"), F.lit(1.0)
    rows = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & x.isNotNull() & ~F.isnan(x) & (F.col(a) != F.col(b)))
    rows = rows.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), (x * x if ward else x).alias("x")).groupBy("a", "b").agg(F.min("x").alias("x"))
    state = materialise(rows.select("a", "b", "x", one.alias("na"), one.alias("nb")), f"{path}/state0")
    left = state.select("a").union(state.select("b")).distinct().count()
    if state.count() != left * (left - 1) // 2:
        raise ValueError("the distance of some pair is missing")
    kind, done, k = dict(state.dtypes)["a"], [], 0
    schema = f"left {kind}, right {kind}, height double, size long, round int, step int"
    while left > max(small, 1):
        apart = F.col("x") * 2 * F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")) if ward else F.col("x")
        near = state.select("a", "b", F.struct(apart.alias("w"), "a", "b", "x", "na", "nb").alias("best"))
        near = near.select(F.col("a").alias("c"), "best").union(near.select("b", "best")).groupBy("c").agg(F.min("best").alias("best"))
        won = near.groupBy("best").count().where(F.col("count") == 2).select("best.*")
        won = materialise(won, f"{path}/won{k}")
        height = F.sqrt("w") if ward else F.col("w")
        done.append(won.select(F.col("a").alias("left"), F.col("b").alias("right"), height.alias("height"), (F.col("na") + F.col("nb")).cast("long").alias("size"), F.lit(k).alias("round"), F.lit(0).alias("step")))
        total = F.col("na") + F.col("nb")
        fates = won.select(F.explode(F.array("a", "b")).alias("old"), F.col("a").alias("new"), total.alias("n"), (F.col("na") * F.col("nb") / (total * total) * F.col("x")).alias("within"))
        moved = state
        for end in ("a", "b"):
            fate = fates.select(F.col("old").alias(end), F.struct("new", "n", "within").alias(f"f{end}"))
            moved = moved.join(fate, end, "left").withColumn(f"f{end}", F.coalesce(f"f{end}", F.struct(F.col(end).alias("new"), F.col(f"n{end}").alias("n"), F.lit(0.0).alias("within"))))
        ends = moved.where("fa.new <> fb.new").select(F.least("fa", "fb").alias("p"), F.greatest("fa", "fb").alias("q"), (F.col("na") * F.col("nb") * F.col("x")).alias("x"))
        mean = F.col("x") / (F.col("p.n") * F.col("q.n"))
        state = ends.groupBy("p", "q").agg(F.sum("x").alias("x")).select(F.col("p.new").alias("a"), F.col("q.new").alias("b"), (F.greatest(mean - F.col("p.within") - F.col("q.within"), F.lit(0.0)) if ward else mean).alias("x"), F.col("p.n").alias("na"), F.col("q.n").alias("nb"))
        k += 1
        state = materialise(state, f"{path}/state{k}")
        left -= won.count()

    def finish(rest: pd.DataFrame) -> pd.DataFrame:
        names, ends = np.unique(np.concatenate([rest["a"], rest["b"]]), return_inverse=True)
        i, j = ends[: len(rest)], ends[len(rest) :]
        size, d = np.ones(len(names)), np.zeros((len(names), len(names)))
        size[i], size[j] = rest["na"], rest["nb"]
        apart = np.sqrt(rest["x"] * 2 * rest["na"] * rest["nb"] / (rest["na"] + rest["nb"])) if ward else rest["x"]
        d[i, j] = d[j, i] = apart
        first, out = list(names), []
        for step, (p, q, h, s) in enumerate(linkage(d, method, size)):
            lo, hi = sorted((first[p], first[q]))
            first.append(lo)
            out.append((lo, hi, h, s, k, step))
        return pd.DataFrame(out, columns=["left", "right", "height", "size", "round", "step"])

    found = state.withColumn("rest", F.lit(0)).groupBy("rest").applyInPandas(finish, schema)
    for part in done:
        found = found.unionByName(part)
    return materialise(found, f"{path}/merges")


def cut(merges: DataFrame, rows: DataFrame, key: str, clusters: int, path: str | None = None) -> DataFrame:
    """(key, cluster int) of the rows, in at most `clusters` clusters numbered from 1 by least member.

    The clusters - 1 last merges (greatest height first) are undone. Null keys are left out; a row without merges is a cluster of its own, besides.
    """
    last = merges.orderBy(F.desc("height"), F.desc("round"), F.desc("step"), F.desc("right")).limit(clusters - 1)
    kept = merges.join(last.select("right"), "right", "left_anti").select(F.col("left").alias("a"), F.col("right").alias("b"))
    label = components(kept, path)
    own = rows.select(key).where(F.col(key).isNotNull()).distinct().join(label.withColumnRenamed("node", key), key, "left").withColumn("component", F.coalesce("component", F.col(key)))
    number = own.select("component").distinct().withColumn("cluster", F.row_number().over(W.orderBy("component")))
    return own.join(number, "component").select(key, "cluster")
