"""Sequence and model kernels that SQL cannot say, as Arrow functions per tree or pair."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def viterbi(scores: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """The state path of greatest summed score less the transition costs; lower states win ties."""
    total, back = scores[0].copy(), np.zeros(scores.shape, dtype=int)
    for t in range(1, len(scores)):
        step = total[:, None] - penalty
        back[t] = step.argmax(0)
        total = step.max(0) + scores[t]
    path = [int(total.argmax())]
    for t in range(len(scores) - 1, 0, -1):
        path.append(int(back[t, path[-1]]))
    return np.array(path[::-1])


def smooth_states(rows: DataFrame, tree: str, date: str, scores: list[str], penalty: list[list[float]]) -> DataFrame:
    """(tree, date, state): per tree the smoothed state names over its dates; a null score counts as 0."""
    cost = np.array(penalty, dtype=float)
    kinds = dict(rows.dtypes)

    def run(one: pd.DataFrame) -> pd.DataFrame:
        one = one.sort_values(date)
        path = viterbi(one[scores].fillna(0.0).to_numpy(float), cost)
        return pd.DataFrame({tree: one[tree], date: one[date], "state": [scores[k] for k in path]})

    return rows.select(tree, date, *scores).groupBy(tree).applyInPandas(run, f"{tree} {kinds[tree]}, {date} {kinds[date]}, state string")


def harmonic_terms(t) -> list:
    """The regressors 1, t, sin t, cos t, sin 2t, cos 2t of a Column t in radians."""
    return [F.lit(1.0), t, F.sin(t), F.cos(t), F.sin(2 * t), F.cos(2 * t)]


def harmonic_fit(rows: DataFrame, key: str, day: str, value: str, origin: str = "2014-01-01") -> DataFrame:
    """(key, n, coefficients): least squares on harmonic_terms with t = 2 pi years since the origin.

    Spark sums the normal equations; only their 6 x 6 systems are solved in Python. Null for fewer than six values.
    """
    t = F.datediff(F.col(day).cast("date"), F.lit(origin).cast("date")) / 365.25 * (2 * math.pi)
    x = harmonic_terms(t)
    pairs = [(i, j) for i in range(6) for j in range(i, 6)]
    made = [F.sum(x[i] * x[j]).alias(f"a{i}{j}") for i, j in pairs] + [F.sum(x[i] * F.col(value)).alias(f"b{i}") for i in range(6)]
    sums = rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), *made)

    @F.pandas_udf("array<double>")
    def solve(n: pd.Series, a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
        out = []
        for k in range(len(n)):
            m = np.zeros((6, 6))
            for (i, j), v in zip(pairs, a.iloc[k]):
                m[i, j] = m[j, i] = v
            out.append(np.linalg.lstsq(m, b.iloc[k].to_numpy(float), rcond=None)[0].tolist() if n.iloc[k] >= 6 else None)
        return pd.Series(out)

    return sums.select(key, "n", solve("n", F.struct(*[f"a{i}{j}" for i, j in pairs]), F.struct(*[f"b{i}" for i in range(6)])).alias("coefficients"))


def reconstructed(fits: DataFrame, key: str, days: int = 365) -> DataFrame:
    """(key, doy, value): the periodic part and mean of the fit for every day of a year; the trend is left out."""
    c = F.col("coefficients")
    rows = fits.where("coefficients is not null").withColumn("doy", F.explode(F.sequence(F.lit(1), F.lit(days))))
    t = F.col("doy") / float(days) * (2 * math.pi)
    return rows.select(key, "doy", (c[0] + c[2] * F.sin(t) + c[3] * F.cos(t) + c[4] * F.sin(2 * t) + c[5] * F.cos(2 * t)).alias("value"))


def dtw(a: np.ndarray, b: np.ndarray, window: int = 2) -> float:
    """Root of the least summed squared difference of a warping inside the band."""
    n, m = len(a), len(b)
    w = max(window, abs(n - m))
    d = np.full((n + 1, m + 1), np.inf)
    d[0, 0] = 0.0
    for i in range(1, n + 1):
        for j in range(max(1, i - w), min(m, i + w) + 1):
            d[i, j] = (a[i - 1] - b[j - 1]) ** 2 + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
    return float(math.sqrt(d[n, m]))


def linkage(d: np.ndarray, method: str = "ward", sizes: np.ndarray | None = None) -> list[tuple[int, int, float, int]]:
    """Agglomeration of a distance matrix by Lance-Williams: (cluster, cluster, height, size), as merges go on. sizes: of clusters to begin with."""
    n = len(d)
    dist = d.astype(float) ** 2 if method == "ward" else d.astype(float).copy()
    np.fill_diagonal(dist, np.inf)
    size, name, alive, out = np.ones(n) if sizes is None else np.array(sizes, float), list(range(n)), np.ones(n, bool), []
    for k in range(n - 1):
        live = np.flatnonzero(alive)
        sub = dist[np.ix_(live, live)]
        i, j = (live[x] for x in np.unravel_index(int(sub.argmin()), sub.shape))
        i, j = min(i, j), max(i, j)
        h = dist[i, j]
        for m in live:
            if m not in (i, j):
                if method == "ward":
                    new = ((size[i] + size[m]) * dist[i, m] + (size[j] + size[m]) * dist[j, m] - size[m] * h) / (size[i] + size[j] + size[m])
                else:
                    new = (size[i] * dist[i, m] + size[j] * dist[j, m]) / (size[i] + size[j])
                dist[i, m] = dist[m, i] = new
        out.append((name[i], name[j], float(math.sqrt(h) if method == "ward" else h), int(size[i] + size[j])))
        size[i] += size[j]
        alive[j], name[i] = False, n + k
    return out


def cut_tree(merges: list[tuple[int, int, float, int]], n: int, clusters: int) -> np.ndarray:
    """Labels 1.. of the partition into at most `clusters` clusters, numbered by first member."""
    parent = list(range(n + len(merges)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, b, _, _) in enumerate(merges[: max(0, n - clusters)]):
        parent[root(a)] = parent[root(b)] = n + k
    roots: dict[int, int] = {}
    return np.array([roots.setdefault(root(i), len(roots) + 1) for i in range(n)])


def pca(rows: DataFrame, features: list[str], k: int = 6) -> DataFrame:
    """(component, explained, loadings) of standardised features, by the covariances that Spark sums; signs make the largest loading positive."""
    z = {f: (F.col(f) - F.col(f"__m_{f}")) / F.nullif(F.col(f"__s_{f}"), F.lit(0.0)) for f in features}
    stats = rows.agg(*[F.avg(f).alias(f"__m_{f}") for f in features], *[F.stddev_pop(f).alias(f"__s_{f}") for f in features])
    sums = rows.join(F.broadcast(stats)).agg(*[F.avg(z[a] * z[b]).alias(f"c_{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features) if j >= i]).first()
    c = np.array([[sums[f"c_{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(features))] for i in range(len(features))])
    values, vectors = np.linalg.eigh(c)
    order = np.argsort(-values)[: min(k, len(features))]
    made = [(r + 1, float(values[o] / values.sum()), [float(x) for x in vectors[:, o] * np.sign(vectors[np.abs(vectors[:, o]).argmax(), o])]) for r, o in enumerate(order)]
    return rows.sparkSession.createDataFrame(made, "component int, explained double, loadings array<double>")


def knn_graph(rows: DataFrame, key: str, vector: str, k: int = 15, block: int = 16_384) -> DataFrame:
    """(a, b, weight): the k nearest rows of every row by Euclidean distance, weight 1 / (distance + 1e-8), made symmetric by the larger weight.

    All rows meet all rows in blocks, each pair of blocks once for both sides, 512 rows of one at a time: the label-spreading input is the labelled
    set, whose size the caller bounds. A row is copied for every block once, in its own type.
    """
    n = max(1, -(-rows.count() // block))
    base = rows.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("block"))
    left = base.select("id", "v", F.col("block").alias("ga"), F.explode(F.sequence("block", F.lit(n - 1))).alias("gb"))
    right = base.select(F.col("id").alias("id_b"), F.col("v").alias("v_b"), F.col("block").alias("hb"), F.explode(F.sequence(F.lit(0), "block")).alias("ha"))
    kind = dict(rows.dtypes)[key]

    def nearest(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> list[pd.DataFrame]:
        out, length = [], (y * y).sum(1)
        for lo in range(0, len(a), 512):
            u = x[lo : lo + 512]
            d = np.sqrt(np.maximum((u * u).sum(1)[:, None] + length - 2 * u @ y.T, 0))
            d[a[lo : lo + 512, None] == b] = np.inf
            last = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if len(b) > k else np.inf
            i, j = np.nonzero((d <= last) & np.isfinite(d))  # with all that are as near as the last one
            out.append(pd.DataFrame({"a": a[lo + i], "b": b[j], "distance": d[i, j]}))
        return out

    def meet(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return pd.DataFrame({"a": [], "b": [], "distance": []})
        a, b = p["id"].to_numpy(), q["id_b"].to_numpy()
        x, y = np.stack(p["v"].to_numpy()).astype(float), np.stack(q["v_b"].to_numpy()).astype(float)
        return pd.concat(nearest(a, x, b, y) + ([] if p["ga"].iloc[0] == p["gb"].iloc[0] else nearest(b, y, a, x)))

    found = left.groupBy("ga", "gb").cogroup(right.groupBy("ha", "hb")).applyInPandas(meet, f"a {kind}, b {kind}, distance double")
    near = found.withColumn("r", F.row_number().over(W.partitionBy("a").orderBy("distance", "b"))).where(F.col("r") <= k)
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return near.select(F.explode(both).alias("e"), (1.0 / (F.col("distance") + 1e-8)).alias("weight")).groupBy("e.a", "e.b").agg(F.max("weight").alias("weight"))


def label_spreading(graph: DataFrame, labels: DataFrame, alpha: float = 0.2, rounds: int = 30, tolerance: float = 1e-5, path: str | None = None) -> DataFrame:
    """(id, p): spread binary labels (id, y in 0/1) over a weighted graph: F <- alpha S F + (1 - alpha) Y with S = D^-1 W.

    p is the share of class 1 of a node's mass; null where no label reaches it. Rounds end when no value moves by the tolerance.
    """
    from canopyflow.session import materialise, shared_dir

    path = path or shared_dir(graph.sparkSession)
    total = graph.groupBy("a").agg(F.sum("weight").alias("__d"))
    s = materialise(graph.join(total, "a").select("a", "b", (F.col("weight") / F.col("__d")).alias("s")), f"{path}/s")
    seed = s.select(F.col("a").alias("id")).distinct().join(labels.select("id", "y"), "id", "left")
    state = materialise(seed.select("id", *[F.coalesce((F.col("y") == c).cast("double"), F.lit(0.0)).alias(f"y{c}") for c in (0, 1)]).withColumns({"f0": F.col("y0"), "f1": F.col("y1")}), f"{path}/f0")
    for k in range(1, rounds + 1):
        moved = s.join(state.select(F.col("id").alias("b"), "f0", "f1"), "b").groupBy("a").agg(F.sum(F.col("s") * F.col("f0")).alias("g0"), F.sum(F.col("s") * F.col("f1")).alias("g1"))
        new = state.join(moved, state.id == moved.a, "left").select("id", "y0", "y1", *[(alpha * F.coalesce(f"g{c}", F.lit(0.0)) + (1 - alpha) * F.col(f"y{c}")).alias(f"f{c}") for c in (0, 1)], F.col("f0").alias("o0"), F.col("f1").alias("o1"))
        new = materialise(new, f"{path}/f{k}")
        far = new.agg(F.max(F.greatest(F.abs(F.col("f0") - F.col("o0")), F.abs(F.col("f1") - F.col("o1")))).alias("d")).first()["d"]
        state = new.drop("o0", "o1")
        if far is None or far < tolerance:
            break
    return state.select("id", (F.col("f1") / F.nullif(F.col("f0") + F.col("f1"), F.lit(0.0))).alias("p"))
