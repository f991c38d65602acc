"""Nearest neighbours by a hash-prefix forest.

Each tree is a sorted array of long hash strings (one bit per random hyperplane). A query descends
in every tree to its longest-prefix matches; then all trees ascend together, one symbol at a time,
until the matching ranges hold enough different rows besides the query's own, at least k of them, or
the whole shard. Candidates are scored by the exact inner product in
double precision.

For inner products of vectors of any length, an index vector x of a shard with greatest norm M is hashed
as (x, sqrt(M^2 - |x|^2)) and a query as (q, 0): the angle then orders like the inner product.

Rows are dealt to shards of about shard_rows by a hash of their id; each shard is a forest of its own,
searched by every block of queries, and a query's nearest over all shards are kept. Of equal vectors
only the `k + 1` least ids are indexed, which is exact, because ties go to the lesser id.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part;
vectors meet only vectors of their own length;
a product beyond the range of doubles has the score that double arithmetic gives it (infinite, or NaN as the last); a query without any candidate has no rows; rows with a
null id take no part; a repeated id counts as another row but never as its own neighbour; further columns
are ignored. Measured recall is in the README.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from canopyflow.session import materialise, shared_dir


def hash_strings(x: np.ndarray, trees: int, bits: int, seed: int) -> np.ndarray:
    """(trees, rows) uint64: bits symbols of each row in each tree, the first symbol the most significant."""
    rng = np.random.default_rng(seed)
    out = np.empty((trees, len(x)), dtype=np.uint64)
    weights = np.uint64(1) << np.arange(bits - 1, -1, -1, dtype=np.uint64)
    for t in range(trees):
        planes = rng.standard_normal((x.shape[1], bits))
        out[t] = ((x @ planes) > 0).astype(np.uint64) @ weights
    return out


def scaled(x: np.ndarray) -> np.ndarray:
    """x by a power of two, its largest component then in [0.5, 1): products neither overflow nor lose digits of large ones."""
    return np.ldexp(x, -int(np.frexp(np.abs(x).max(initial=0.0))[1]))


class Forest:
    """Sorted arrays over one shard."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, trees: int, bits: int, seed: int):
        self.ids, self.x, self.trees, self.bits, self.seed = ids, x, trees, bits, seed
        self.scaled = scaled(x)
        norms = (self.scaled * self.scaled).sum(1)
        self.longest = float(np.sqrt(norms.max()))
        lifted = np.column_stack([self.scaled, np.sqrt(np.maximum(norms.max() - norms, 0))])
        codes = hash_strings(lifted, trees, bits, seed)
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.codes = np.take_along_axis(codes, self.order, 1)

    def ranges(self, codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(trees, queries) first and one past last position of the rows that share `depth` symbols."""
        shift = np.uint64(self.bits - depth)
        first, last = np.empty(codes.shape, np.int64), np.empty(codes.shape, np.int64)
        for t in range(self.trees):
            short, want = self.codes[t] >> shift, codes[t] >> shift
            first[t], last[t] = np.searchsorted(short, want, "left"), np.searchsorted(short, want, "right")
        return first, last

    def union(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Positions of the different rows in one query's ranges."""
        found = np.zeros(len(self.x), dtype=bool)
        for t in range(self.trees):
            found[self.order[t, first[t] : last[t]]] = True
        return np.flatnonzero(found)

    def search(self, q_ids: np.ndarray, q: np.ndarray, k: int, candidates: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(query position, ids, scores) of up to k nearest found.

        A query ascends until its ranges hold max(k, candidates) different rows of other ids, or to the whole shard.
        """
        codes = hash_strings(np.column_stack([[scaled(v) for v in q], np.zeros(len(q))]), self.trees, self.bits, self.seed)
        waiting, need, out = np.arange(len(q)), max(k, candidates), []
        for depth in range(self.bits, 0, -1):
            if not len(waiting):
                break
            a, b = self.ranges(codes[:, waiting], depth)
            done = np.zeros(len(waiting), dtype=bool)
            for j in np.flatnonzero((b - a).sum(0) >= need):  # a row counts once a tree here, so fewer cannot hold enough
                at = self.union(a[:, j], b[:, j])
                at = at[self.ids[at] != q_ids[waiting[j]]]
                if len(at) >= need:
                    done[j] = True
                    out.append(self.best(waiting[j], at, q[waiting[j]], k))
            waiting = waiting[~done]
        for i in waiting:
            at = np.flatnonzero(self.ids != q_ids[i])
            if len(at):
                out.append(self.best(i, at, q[i], k))
        return out

    def best(self, i: int, at: np.ndarray, v: np.ndarray, k: int) -> tuple[int, np.ndarray, np.ndarray]:
        """(i, ids, scores) of the k rows of `at` with the largest inner product."""
        if len(at) > k:  # a product by another order of sums discards what is below the k-th by more than rounding explains
            v1 = scaled(v)
            rough = self.scaled[at] @ v1
            slack = 4 * (len(v) + 2) * np.finfo(float).eps * self.longest * float(np.sqrt(v1 @ v1)) + 1e-300
            at = at[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - slack]
        with np.errstate(over="ignore", invalid="ignore"):
            exact = (self.x[at] * v).sum(1)
        top = np.lexsort((self.ids[at], -exact))[:k]
        return i, self.ids[at][top], exact[top]


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part."""
    v = F.col(f"`{embedding}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(sound).where(F.exists("v", lambda x: x != 0))


def nearest(
    vectors: DataFrame, k: int = 20, every: int = 20, trees: int = 128, bits: int = 24, candidate_factor: float = 0.5, shard_rows: int = 16384, block_rows: int = 16384,
    seed: int = 11, vec_id: str = "vec_id", embedding: str = "embedding", path: str | None = None,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose id is divisible by `every`.

    candidate_factor: the ascent ends when the trees' ranges hold this share of the shard's rows, each counted
    once, and at least k of them besides the query's own. path: where the cleaned vectors go; by default below the shared folder.
    """
    rows = materialise(usable(vectors, vec_id, embedding), f"{path or shared_dir(vectors.sparkSession)}/vectors")
    total = rows.count()
    shards, blocks = max(1, -(-total // shard_rows)), max(1, -(-total // (every * block_rows)))
    salted = F.row_number().over(W.partitionBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id"))
    kept = rows.withColumn("r", salted).where(F.col("r") <= k + 1)
    kept = kept.withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    index = kept.select("vec_id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    queries = rows.where(F.col("vec_id") % every == 0).select(
        F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.size("v").alias("q_dim"),
        F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(blocks)).cast("int").alias("q_block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("q_shard"),
    )
    index = index.withColumn("shard", F.col("shard").cast("int"))

    def search(some: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(some) and len(asked):
            some = some.sort_values("vec_id", kind="stable")
            x, q = np.stack(some["v"].to_numpy()), np.stack(asked["q"].to_numpy())
            q_ids = asked["query_id"].to_numpy()
            forest = Forest(some["vec_id"].to_numpy(), x, trees, bits, seed)
            for i, ids, scores in forest.search(q_ids, q, k, int(candidate_factor * len(x))):
                parts.append(pd.DataFrame({"query_id": q_ids[i], "vec_id": ids, "score": scores}))
        return pd.concat(parts) if parts else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})

    found = index.groupBy("dim", "shard", "block").cogroup(queries.groupBy("q_dim", "q_shard", "q_block")).applyInPandas(search, "query_id long, vec_id long, score double")
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
